"""Queries of the window operators: returns, z-scores, betas, correlations and run states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import series as S
from tidemark.operators.temporal import first_per_key
from tidemark.registry import query, table


def prices(spark: SparkSession, d: str) -> DataFrame:
    """The events as price bars: user as symbol, value as close."""
    return table(spark, d, "events").select(F.col("user_id").alias("symbol"), "ts", "event_id", F.col("value").alias("close"), "event_type")


KEY, ORDER = ["symbol"], ["ts", "event_id"]
BARS = "bars AS (SELECT user_id AS symbol, ts, event_id, value AS close, event_type FROM events), rets AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id))"
Z = """z AS (SELECT *, CASE WHEN count(ret) OVER f >= 10 AND stddev_samp(ret) OVER f > 1e-12 THEN (ret - avg(ret) OVER f) / stddev_samp(ret) OVER f END AS z FROM rets
  WINDOW f AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))"""


def returns(spark: SparkSession, d: str) -> DataFrame:
    w = S.ordered(KEY, ORDER)
    return prices(spark, d).withColumn("ret", S.simple_return(F.col("close"), w))


@query(f"""WITH {BARS}, {Z}, last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS k FROM z)
SELECT symbol, round(close, 6) AS close, round(ret, 6) AS ret, round(z, 6) AS z, abs(z) >= 1.0 OR (z IS NULL AND abs(ret) >= 0.0075) AS significant,
  row_number() OVER (ORDER BY z IS NULL, round(abs(z), 9) DESC, round(abs(ret), 9) DESC NULLS LAST, symbol) AS place FROM last WHERE k = 1 QUALIFY place <= 50""")
def movers(spark: SparkSession, d: str) -> DataFrame:
    """Latest bar a symbol, those with a z first, by size; the 50 largest."""
    w = S.ordered(KEY, ORDER)
    rows = returns(spark, d).withColumn("z", S.z_score(F.col("ret"), w))
    last = first_per_key(rows, KEY, [F.col("ts").desc(), F.col("event_id").desc()])
    significant = F.coalesce(F.abs("z") >= 1.0, F.lit(False)) | (F.col("z").isNull() & (F.abs("ret") >= 0.0075))
    order = [F.col("z").isNull(), F.round(F.abs("z"), 9).desc(), F.round(F.abs("ret"), 9).desc_nulls_last(), F.col("symbol")]
    top = last.orderBy(*order).limit(50)
    top = top.withColumn("place", F.row_number().over(W.orderBy(*order)).cast("long"))
    return top.select("symbol", *[F.round(c, 6).alias(c) for c in ("close", "ret", "z")], significant.alias("significant"), "place")


@query(f"WITH {BARS} SELECT symbol, event_id, round(ret, 6) AS ret FROM rets")
def w07_simple_return(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("symbol", "event_id", F.round("ret", 6).alias("ret"))


@query(f"WITH {BARS}, {Z} SELECT symbol, event_id, round(z, 6) AS z FROM z")
def w08_rolling_z(spark: SparkSession, d: str) -> DataFrame:
    z = S.z_score(F.col("ret"), S.ordered(KEY, ORDER))
    return returns(spark, d).withColumn("z", z).select("symbol", "event_id", F.round("z", 6).alias("z"))


@query(f"""WITH {BARS} SELECT symbol, event_id, round(CASE WHEN count(ret) OVER f >= 40 AND stddev_samp(ret) OVER f > 1e-12 THEN (ret - avg(ret) OVER f) / stddev_samp(ret) OVER f END, 6) AS z
FROM rets WINDOW f AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 119 PRECEDING AND CURRENT ROW)""")
def w09_hourly_z(spark: SparkSession, d: str) -> DataFrame:
    z = S.z_score(F.col("ret"), S.ordered(KEY, ORDER), 120, 40)
    return returns(spark, d).withColumn("z", z).select("symbol", "event_id", F.round("z", 6).alias("z"))


@query("""WITH v AS (SELECT user_id AS symbol, ts, event_id, ln(value) AS lv FROM events WHERE value > 0)
SELECT symbol, event_id, round(CASE WHEN count(lv) OVER f >= 30 AND stddev_pop(lv) OVER f > 1e-12 THEN (lv - avg(lv) OVER f) / stddev_pop(lv) OVER f END, 6) AS z
FROM v WINDOW f AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def w10_log_volume_z(spark: SparkSession, d: str) -> DataFrame:
    v = prices(spark, d).where("close > 0").withColumn("lv", F.log("close"))
    return v.select("symbol", "event_id", F.round(S.surprise_z(F.col("lv"), S.ordered(KEY, ORDER), 30), 6).alias("z"))


@query(f"""WITH {BARS} SELECT symbol, event_id, round(CASE WHEN count(ret) OVER f >= 30 AND stddev_pop(ret) OVER f > 1e-12 THEN ret / stddev_pop(ret) OVER f END, 6) AS z
FROM rets WINDOW f AS (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def w11_abnormal_return(spark: SparkSession, d: str) -> DataFrame:
    return returns(spark, d).select("symbol", "event_id", F.round(S.scaled(F.col("ret"), S.ordered(KEY, ORDER), 30), 6).alias("z"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """A daily panel: mean value per user and day, five sectors."""
    daily = table(spark, d, "events").groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("ret"))
    return daily.withColumn("sector", F.col("symbol") % 5)


PANEL = "panel AS (SELECT user_id AS symbol, ts::DATE AS day, round(avg(value), 6) AS ret, user_id % 5 AS sector FROM events GROUP BY ALL)"
PARTS = f"""{PANEL}, market AS (SELECT day, avg(ret) AS market_ret FROM panel GROUP BY day),
b AS (SELECT *, CASE WHEN count(ret) OVER f >= 5 THEN regr_slope(ret, market_ret) OVER f END AS beta FROM panel JOIN market USING (day)
  WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, beta * market_ret AS market, ret - beta * market_ret AS residual FROM b WHERE beta IS NOT NULL),
parts AS (SELECT *, avg(residual) OVER (PARTITION BY sector, day) AS sector_part, residual - avg(residual) OVER (PARTITION BY sector, day) AS idio FROM r)"""


@query(f"WITH {PARTS} SELECT symbol, day, round(beta, 6) AS beta FROM parts")
def w12_rolling_beta(spark: SparkSession, d: str) -> DataFrame:
    return S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5).select("symbol", "day", F.round("beta", 6).alias("beta"))


@query(f"WITH {PARTS} SELECT symbol, day, round(market, 5) AS market, round(sector_part, 5) AS sector_part, round(idio, 5) AS idio, abs(market + sector_part + idio - ret) < 1e-6 AS adds_up FROM parts")
def w13_decomposition(spark: SparkSession, d: str) -> DataFrame:
    p = S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5)
    whole = F.abs(F.col("market") + F.col("sector_part") + F.col("idio") - F.col("ret")) < 1e-6
    return p.select("symbol", "day", *[F.round(c, 5).alias(c) for c in ("market", "sector_part", "idio")], whole.alias("adds_up"))


@query(f"""WITH {PARTS} SELECT symbol, day, round(CASE WHEN count(idio) OVER f >= 5 AND stddev_pop(idio) OVER f > 1e-12 THEN abs(idio / stddev_pop(idio) OVER f) END, 5) AS sigma
FROM parts WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)""")
def w14_idiosyncratic_sigma(spark: SparkSession, d: str) -> DataFrame:
    return S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5).select("symbol", "day", F.round("sigma", 5).alias("sigma"))


@query(f"""WITH {PANEL}, m AS (SELECT day, avg(ret) AS mk FROM panel GROUP BY day),
j AS (SELECT symbol, day, ret, mk, count(*) OVER f AS n, covar_samp(ret, mk) OVER f AS c, var_pop(mk) OVER f AS v FROM panel JOIN m USING (day) WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, round(CASE WHEN n >= 5 THEN c / nullif(v, 0) END, 6) AS beta FROM j""")
def w15_mixed_moment_beta(spark: SparkSession, d: str) -> DataFrame:
    """Sample covariance over population variance, as the live variant has it."""
    p = panel(spark, d)
    p = p.join(p.groupBy("day").agg(F.avg("ret").alias("mk")), "day")
    f = S.ordered(["symbol"], ["day"]).rowsBetween(-14, -1)
    b = F.when(F.count("*").over(f) >= 5, F.try_divide(F.covar_samp("ret", "mk").over(f), F.var_pop("mk").over(f)))
    return p.select("symbol", "day", F.round(b, 6).alias("beta"))


def pair_panel(spark: SparkSession, d: str) -> DataFrame:
    """Days of every other symbol against the reference symbol 0."""
    p = panel(spark, d).select("symbol", "day", "ret")
    base = p.where("symbol = 0").select("day", F.col("ret").alias("base"))
    return p.where("symbol <> 0").join(base, "day")


PAIRS = f"{PANEL}, pairs AS (SELECT p.symbol, p.day, p.ret, b.ret AS base FROM panel p JOIN panel b ON b.day = p.day AND b.symbol = 0 WHERE p.symbol <> 0)"


@query(f"""WITH {PAIRS} SELECT symbol, day, round(CASE WHEN count(*) OVER f >= 6 THEN corr(ret, base) OVER f END, 6) AS corr
FROM pairs WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def w16_rolling_pair_corr(spark: SparkSession, d: str) -> DataFrame:
    return pair_panel(spark, d).select("symbol", "day", F.round(S.rolling_corr(F.col("ret"), F.col("base"), S.ordered(["symbol"], ["day"]), 10, 6), 6).alias("corr"))


@query("""WITH e AS (SELECT user_id AS symbol, ts, event_id, value > 50 AS on_ FROM events),
n AS (SELECT *, row_number() OVER w - 1 AS n, (on_ IS DISTINCT FROM lag(on_) OVER w)::INT AS new FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY n) AS run FROM n)
SELECT symbol, run::BIGINT AS run, any_value(on_) AS active, min(n)::BIGINT AS first_n, max(n)::BIGINT AS last_n, count(*) AS length FROM r GROUP BY symbol, run""")
def w17_runs(spark: SparkSession, d: str) -> DataFrame:
    e = prices(spark, d).withColumn("active", F.col("close") > 50)
    r = S.runs(e, KEY, ORDER, "active")
    return r.select("symbol", F.col("run").cast("long"), "active", F.col("first_n").cast("long"), F.col("last_n").cast("long"), "length")


@query("""WITH e AS (SELECT user_id AS symbol, ts, event_id, value > 50 AS on_ FROM events),
n AS (SELECT *, row_number() OVER w - 1 AS n, (on_ IS DISTINCT FROM lag(on_) OVER w)::INT AS new FROM e WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY symbol ORDER BY n) AS run FROM n),
g AS (SELECT symbol, run, any_value(on_) AS on_, min(n) AS first_n, count(*) AS len FROM r GROUP BY symbol, run),
l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY run DESC) AS back FROM g WHERE len >= 3),
t AS (SELECT symbol, sum(len) AS n, sum(len) FILTER (WHERE on_) AS on_n, count(*) AS n_runs, arg_max(on_, run) AS now FROM g GROUP BY symbol),
p AS (SELECT symbol, max(on_::INT) FILTER (WHERE back = 1) = 1 AS last_on, max(first_n) FILTER (WHERE back = 1) AS last_first, max(on_::INT) FILTER (WHERE back = 2) = 1 AS before_on, max(first_n) FILTER (WHERE back = 2) AS before_first FROM l GROUP BY symbol)
SELECT t.symbol, t.n::BIGINT AS n, n_runs, CASE WHEN t.n < 6 THEN 'INSUFFICIENT' WHEN coalesce(on_n, 0) = 0 THEN 'NEVER'
  WHEN before_first > 0 AND t.n - last_first >= 6 AND before_on AND NOT last_on AND NOT now THEN 'ENDED'
  WHEN before_first > 0 AND t.n - last_first >= 6 AND NOT before_on AND last_on AND now THEN 'EMERGING'
  WHEN before_first > 0 AND t.n - last_first < 6 THEN 'UNCONFIRMED' WHEN on_n / t.n >= 0.7 THEN 'PERSISTENT' WHEN n_runs >= 5 THEN 'EPISODIC' WHEN now THEN 'PERSISTENT' ELSE 'NEVER' END AS state
FROM t LEFT JOIN p USING (symbol)""")
def w17_run_states(spark: SparkSession, d: str) -> DataFrame:
    s = S.run_states(prices(spark, d).withColumn("active", F.col("close") > 50), KEY, ORDER, "active")
    return s.select("symbol", F.col("n").cast("long"), "n_runs", "state")


@query("""WITH n AS (SELECT user_id AS symbol, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT symbol, round(regr_slope(value, k), 6) AS slope FROM n WHERE k > c - c // 3 GROUP BY symbol HAVING count(*) >= 2""")
def w18_tail_slope(spark: SparkSession, d: str) -> DataFrame:
    n = prices(spark, d).withColumn("k", F.row_number().over(S.ordered(KEY, ORDER))).withColumn("c", F.count("*").over(W.partitionBy("symbol")))
    tail = n.where(F.col("k") > F.col("c") - F.floor(F.col("c") / 3)).groupBy("symbol").agg(F.round(F.regr_slope("close", "k"), 6).alias("slope"), F.count("*").alias("n"))
    return tail.where("n >= 2").drop("n")


@query("SELECT event_id, round(lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 6) AS prior, round(value, 6) AS actual FROM events")
def w19_prior_value(spark: SparkSession, d: str) -> DataFrame:
    p = prices(spark, d)
    return p.select("event_id", F.round(F.lag("close").over(S.ordered(["symbol", "event_type"], ORDER)), 6).alias("prior"), F.round("close", 6).alias("actual"))


@query("""WITH q AS (SELECT o_custkey, year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS q, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
y AS (SELECT a.o_custkey, a.q, a.v - b.v AS diff FROM q a JOIN q b ON a.o_custkey = b.o_custkey AND b.q = a.q - 4),
h AS (SELECT *, count(diff) OVER f AS n, stddev_pop(diff) OVER f AS sd FROM y WINDOW f AS (PARTITION BY o_custkey ORDER BY q ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT o_custkey, q::BIGINT AS q, round(diff / sd, 4) AS sue FROM h WHERE n >= 2 AND sd > 1e-9""")
def w20_standardised_surprise(spark: SparkSession, d: str) -> DataFrame:
    """Change on the year-ago quarter over the deviation of up to eight earlier changes."""
    o = table(spark, d, "orders")
    q = o.groupBy("o_custkey", (F.year("o_orderdate") * 4 + F.quarter("o_orderdate") - 1).cast("long").alias("q")).agg(F.sum("o_totalprice").alias("v"))
    before = q.select("o_custkey", (F.col("q") + 4).alias("q"), F.col("v").alias("v0"))
    y = q.join(before, ["o_custkey", "q"]).withColumn("diff", F.col("v") - F.col("v0"))
    f = S.ordered(["o_custkey"], ["q"]).rowsBetween(-8, -1)
    y = y.withColumn("n", F.count("diff").over(f)).withColumn("sd", F.stddev_pop("diff").over(f)).where("n >= 2 AND sd > 1e-9")
    return y.select("o_custkey", "q", F.round(F.col("diff") / F.col("sd"), 4).alias("sue"))


@query(f"WITH {BARS} SELECT event_id, round(lead(ret) OVER w * CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END, 6) AS signed_next FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)")
def w21_forward_return(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return returns(spark, d).select("event_id", F.round(F.lead("ret").over(S.ordered(KEY, ORDER)) * sign, 6).alias("signed_next"))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return prices(spark, d).withColumn("i", F.row_number().over(S.ordered(KEY, ORDER)))


INDEXED = "indexed AS (SELECT user_id AS symbol, event_type, value AS close, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@query(f"""WITH {INDEXED}, a AS (SELECT symbol, i FROM indexed WHERE close > 95)
SELECT (s.i - a.i)::INT AS "offset", count(s.close) AS n, round(avg(s.close), 6) AS mean FROM a JOIN indexed s ON s.symbol = a.symbol AND s.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY 1""")
def w22_event_profile(spark: SparkSession, d: str) -> DataFrame:
    s = indexed(spark, d)
    out = S.event_profile(s, s.where("close > 95").select("symbol", "i"), "symbol", "i", "close", 3)
    return out.select(F.col("offset").cast("int"), "n", F.round("mean", 6).alias("mean"))


@query(f"""WITH {INDEXED}, a AS (SELECT symbol, i FROM indexed WHERE close > 95),
l AS (SELECT s.symbol, s.i, max(CASE WHEN s.i = a.i THEN 3 WHEN s.i > a.i THEN 2 ELSE 1 END) AS m FROM a JOIN indexed s ON s.symbol = a.symbol AND s.i BETWEEN a.i - 3 AND a.i + 3 GROUP BY ALL)
SELECT event_id, CASE m WHEN 3 THEN 'impact' WHEN 2 THEN 'post' WHEN 1 THEN 'pre' ELSE 'baseline' END AS part FROM indexed LEFT JOIN l USING (symbol, i)""")
def w23_day_sets(spark: SparkSession, d: str) -> DataFrame:
    """Rows around anchors as pre, impact or post; impact wins over post over pre, others are baseline."""
    s = indexed(spark, d)
    a = s.where("close > 95").select("symbol", F.col("i").alias("a"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("o"))
    near = a.groupBy("symbol", (F.col("a") + F.col("o")).alias("i")).agg(F.max(F.when(F.col("o") == 0, 3).when(F.col("o") > 0, 2).otherwise(1)).alias("m"))
    part = F.when(F.col("m") == 3, "impact").when(F.col("m") == 2, "post").when(F.col("m") == 1, "pre").otherwise("baseline")
    return s.join(near, ["symbol", "i"], "left").select("event_id", part.alias("part"))


@query(f"""WITH {INDEXED} SELECT event_id, round(ln(stddev_pop(close) OVER post / nullif(stddev_pop(close) OVER pre, 0)), 6) AS ratio FROM indexed
WINDOW pre AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), post AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)
QUALIFY count(close) OVER pre >= 7 AND count(close) OVER post >= 7""")
def w24_volatility_ratio(spark: SparkSession, d: str) -> DataFrame:
    w = S.ordered(["symbol"], ["i"])
    pre, post = w.rowsBetween(-10, -1), w.rowsBetween(1, 10)
    s = indexed(spark, d).withColumn("n0", F.count("close").over(pre)).withColumn("n1", F.count("close").over(post))
    s = s.withColumn("ratio", F.round(F.log(F.try_divide(F.stddev_pop("close").over(post), F.stddev_pop("close").over(pre))), 6))
    return s.where("n0 >= 7 AND n1 >= 7").select("event_id", "ratio")


@query(f"""WITH {PAIRS}, s AS (SELECT symbol, day, count(*) OVER f AS n, sum(ret) OVER f AS x, sum(base) OVER f AS y, sum(ret * ret) OVER f AS xx, sum(base * base) OVER f AS yy, sum(ret * base) OVER f AS xy FROM pairs
  WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
SELECT symbol, day, round((n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)), 6) AS corr FROM s WHERE n >= 6""")
def w25_corr_from_sums(spark: SparkSession, d: str) -> DataFrame:
    f = S.ordered(["symbol"], ["day"]).rowsBetween(-9, 0)
    p = pair_panel(spark, d).withColumn("n", F.count("*").over(f)).withColumn("corr", F.round(S.corr(F.col("ret"), F.col("base"), f), 6))
    return p.where("n >= 6").select("symbol", "day", "corr")


@query("""SELECT event_id, md5(event_type) IS DISTINCT FROM lag(md5(event_type)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events""")
def w26_change_detection(spark: SparkSession, d: str) -> DataFrame:
    h = F.md5(F.col("event_type").cast("binary"))
    return prices(spark, d).select("event_id", (~h.eqNullSafe(F.lag(h).over(S.ordered(KEY, ORDER)))).alias("changed"))


@query("SELECT event_id, min(ts) OVER (PARTITION BY user_id, event_type) AS first_print FROM events")
def w28_first_print(spark: SparkSession, d: str) -> DataFrame:
    return prices(spark, d).select("event_id", F.min("ts").over(W.partitionBy("symbol", "event_type")).alias("first_print"))


@query(f"WITH {PANEL} SELECT symbol, day, round(avg(ret) OVER (PARTITION BY sector, day), 4) AS sector_mean FROM panel QUALIFY count(*) OVER (PARTITION BY sector, day) >= 3")
def w29_sector_day_mean(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("sector", "day")
    p = panel(spark, d).withColumn("n", F.count("*").over(w)).withColumn("sector_mean", F.round(F.avg("ret").over(w), 4))
    return p.where("n >= 3").select("symbol", "day", "sector_mean")


@query(f"""WITH {PANEL}, n AS (SELECT count(DISTINCT symbol) AS n FROM panel)
SELECT day, round(avg(ret), 4) AS market, count(*) AS names FROM panel, n GROUP BY day, n.n HAVING count(*) >= least(greatest(8, 0.3 * n.n), n.n)""")
def w30_market_factor(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    all_ = p.agg(F.countDistinct("symbol").alias("all_names"))
    daily = p.groupBy("day").agg(F.round(F.avg("ret"), 4).alias("market"), F.count("*").alias("names"))
    return daily.join(F.broadcast(all_)).where("names >= least(greatest(8, 0.3 * all_names), all_names)").drop("all_names")
