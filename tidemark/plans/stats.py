"""Queries of the statistics, linear algebra and domain operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.operators import linear as L
from tidemark.operators import series as S
from tidemark.operators import stats as N
from tidemark.operators.temporal import first_per_key
from tidemark.plans.aggregates import quotes
from tidemark.plans.maps import solved
from tidemark.plans.windows import PANEL, PARTS, panel
from tidemark.registry import query, table


@query(f"WITH {PANEL}, m AS (SELECT day, avg(ret) AS mk FROM panel GROUP BY 1) SELECT symbol, round(corr(ret, mk), 6) AS corr, round(covar_pop(ret, mk), 4) AS pop, round(covar_samp(ret, mk), 4) AS samp FROM panel JOIN m USING (day) GROUP BY 1")
def n01_pearson(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    p = p.join(p.groupBy("day").agg(F.avg("ret").alias("mk")), "day").groupBy("symbol")
    return p.agg(F.round(F.corr("ret", "mk"), 6).alias("corr"), F.round(F.covar_pop("ret", "mk"), 4).alias("pop"), F.round(F.covar_samp("ret", "mk"), 4).alias("samp"))


RANKS = f"{PANEL}, s AS (SELECT *, round(ret * 7 % 11 + symbol / 10.0, 6) AS sig FROM panel), r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY sig, symbol) AS a, row_number() OVER (PARTITION BY day ORDER BY ret, symbol) AS b, row_number() OVER (PARTITION BY day ORDER BY symbol) AS c FROM s)"


def signals(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark, d).withColumn("sig", F.round(F.col("ret") * 7 % 11 + F.col("symbol") / 10, 6))


@query(f"WITH {RANKS} SELECT day, round(corr(a, b), 6) AS ic, count(*) AS n FROM r GROUP BY 1 HAVING count(*) >= 5")
def n02_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return N.rank_ic(signals(spark, d), ["day"], "sig", "ret", ["symbol"]).select("day", F.round("ic", 6).alias("ic"), "n")


@query(f"WITH {RANKS}, k AS (SELECT day, corr(a, b) AS xy, corr(a, c) AS xz, corr(b, c) AS yz FROM r GROUP BY 1) SELECT day, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 5) AS partial FROM k")
def n03_partial_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    r = N.ordinal_ranks(signals(spark, d), ["day"], ["sig", "ret", "symbol"], ["symbol"])
    k = r.groupBy("day").agg(F.corr("sig_rank", "ret_rank").alias("xy"), F.corr("sig_rank", "symbol_rank").alias("xz"), F.corr("ret_rank", "symbol_rank").alias("yz"))
    return k.select("day", F.round(N.partial_corr(F.col("xy"), F.col("xz"), F.col("yz")), 5).alias("partial"))


@query(f"WITH {RANKS}, i AS (SELECT day, corr(a, b) AS ic FROM r GROUP BY 1 HAVING count(*) >= 5) SELECT count(*) AS days, round(avg(ic), 6) AS mean, round(stddev_samp(ic) / sqrt(count(*)), 6) AS se FROM i")
def n14_daily_ic_summary(spark: SparkSession, d: str) -> DataFrame:
    i = N.rank_ic(signals(spark, d), ["day"], "sig", "ret", ["symbol"])
    return i.agg(F.count("*").alias("days"), F.round(F.avg("ic"), 6).alias("mean"), F.round(F.stddev_samp("ic") / F.sqrt(F.count("*")), 6).alias("se"))


@query()
def n04_bootstrap_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.bootstrap_mean(table(spark, d, "events"), ["event_id"], "value", 400)


@query()
def n05_bootstrap_dates(spark: SparkSession, d: str) -> DataFrame:
    return N.bootstrap_mean(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["day"], "value")


@query()
def n06_bootstrap_clusters(spark: SparkSession, d: str) -> DataFrame:
    return N.bootstrap_mean(table(spark, d, "events"), ["user_id"], "value")


@query("""WITH m AS (SELECT avg(value) AS m, count(*) AS n FROM events), c AS (SELECT user_id, sum(value - m) AS g FROM events, m GROUP BY 1)
SELECT round(any_value(m), 6) AS mean, any_value(n) AS n, count(*) AS clusters, round(sqrt(sum(g * g) * count(*) / (count(*) - 1)) / any_value(n), 6) AS se FROM c, m""")
def n08_clustered_se(spark: SparkSession, d: str) -> DataFrame:
    c = N.clustered_se(table(spark, d, "events"), "value", ["user_id"])
    return c.select(F.round("mean", 6).alias("mean"), "n", "clusters", F.round("se", 6).alias("se"))


PAIRSUM = "pr AS (SELECT l_suppkey AS a, 1000000 + l_partkey % 50 AS b, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(f"""WITH {PAIRSUM}, m AS (SELECT avg(v) AS m, count(*) AS n FROM pr), u AS (SELECT a, b, v - m AS u FROM pr, m), k AS (SELECT a AS k, u FROM u UNION ALL SELECT b, u FROM u), s AS (SELECT sum(u) AS s FROM k GROUP BY k)
SELECT round(m, 6) AS mean, n, round(sqrt(greatest((SELECT sum(s * s) FROM s) - (SELECT sum(u * u) FROM u), 0)) / n, 6) AS se FROM m""")
def n07_dyadic_se(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("a"), (1000000 + F.col("l_partkey") % 50).alias("b")).agg(F.avg("l_quantity").alias("v"))
    return N.dyadic_se(p, "a", "b", "v").select(F.round("mean", 6).alias("mean"), "n", F.round("se", 6).alias("se"))


@query("""WITH c AS (SELECT event_type, count(*) AS n, avg((value > 50)::INT) AS p FROM events GROUP BY 1)
SELECT event_type, round((p + 1.64 * 1.64 / (2 * n) - 1.64 * sqrt(p * (1 - p) / n + 1.64 * 1.64 / (4 * n * n))) / (1 + 1.64 * 1.64 / n), 6) AS low, round((p + 1.64 * 1.64 / (2 * n) + 1.64 * sqrt(p * (1 - p) / n + 1.64 * 1.64 / (4 * n * n))) / (1 + 1.64 * 1.64 / n), 6) AS high FROM c""")
def n09_wilson(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    low, high = A.wilson(F.col("k"), F.col("n"))
    return c.select("event_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {PANEL}, x AS (SELECT symbol, day, ret, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM panel WHERE symbol IN (1, 2)),
a AS (SELECT * FROM x WHERE symbol = 1), b AS (SELECT * FROM x WHERE symbol = 2), s AS (SELECT k FROM range(1, 25) r(k)),
c AS (SELECT k, abs(corr(a.ret, b.ret)) AS c FROM s, a JOIN b ON b.i = (a.i + k) % b.n GROUP BY k) SELECT round(quantile_cont(c, 0.95), 5) AS band, count(*) AS shifts FROM c""")
def n10_circular_shift(spark: SparkSession, d: str) -> DataFrame:
    """Null band of a correlation from 24 circular shifts of one series; the pair asked for is symbols 1 and 2."""
    p = panel(spark, d).where("symbol IN (1, 2)")
    x = p.withColumn("i", F.row_number().over(S.ordered(["symbol"], ["day"])) - 1).withColumn("n", F.count("*").over(W.partitionBy("symbol")))
    b = x.where("symbol = 2").select(F.col("i").alias("j"), F.col("ret").alias("other"), "n")
    count = b.agg(F.max("n").alias("m"))
    a = x.where("symbol = 1").select("i", "ret", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("k")).join(F.broadcast(count))
    c = a.withColumn("j", (F.col("i") + F.col("k")) % F.col("m")).join(b, "j").groupBy("k").agg(F.abs(F.corr("ret", "other")).alias("c"))
    return c.agg(F.round(F.percentile("c", 0.95), 5).alias("band"), F.count("*").alias("shifts"))


@query()
def n11_market_null(spark: SparkSession, d: str) -> DataFrame:
    """Band of the outcome share if every contract pays with probability its price; 50 hashed draws."""
    q = quotes(spark, d).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(50))))
    u = F.pmod(F.xxhash64("event_id", "b"), F.lit(1 << 30)) / (1 << 30)
    shares = q.groupBy("event_type", "b").agg(F.avg((u < F.col("price")).cast("int")).alias("share"))
    return shares.groupBy("event_type").agg(F.percentile("share", 0.05).alias("low"), F.avg("share").alias("mean"), F.percentile("share", 0.95).alias("high"))


@query("""WITH x AS (SELECT quality, n_chars % 97 AS s FROM labels JOIN documents USING (doc_id)), p AS (SELECT s FROM x WHERE quality = 1), n AS (SELECT s FROM x WHERE quality = 0)
SELECT round(avg(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END), 8) AS auc, (SELECT count(*) FROM p) AS positives, (SELECT count(*) FROM x) AS n FROM p, n""")
def n15_auc(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").withColumn("s", F.col("n_chars") % 97)
    return N.auc(x, "quality", "s").select(F.round("auc", 8).alias("auc"), "positives", "n")


@query("""WITH x AS (SELECT (o_totalprice > 100000)::INT AS a, (o_orderpriority < '3')::INT AS b FROM orders), k AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS p, count(*) FILTER (a = 0 AND b = 1) AS q FROM x)
SELECT p AS only_a, q AS only_b, round(greatest(abs(p - q) - 1, 0) ** 2 / (p + q), 6) AS chi2 FROM k""")
def n16_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select((F.col("o_totalprice") > 100000).cast("int").alias("a"), (F.col("o_orderpriority") < "3").cast("int").alias("b"))
    return N.mcnemar(x, "a", "b").select("only_a", "only_b", F.round("chi2", 6).alias("chi2"))


@query(f"""WITH {PANEL}, r AS (SELECT symbol, day, abs(ret / nullif(lag(ret) OVER w, 0) - 1) AS move FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)), k AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY symbol) * 10 // 100) AS k FROM r WHERE move IS NOT NULL)
SELECT symbol, day, round(move, 6) AS move FROM k QUALIFY rank() OVER (PARTITION BY symbol ORDER BY move DESC) <= k""")
def n17_jumps(spark: SparkSession, d: str) -> DataFrame:
    """The largest tenth of each series' absolute returns, one at least; all that equal the smallest of them count."""
    r = panel(spark, d).withColumn("move", F.abs(F.try_divide("ret", F.lag("ret").over(W.partitionBy("symbol").orderBy("day"))) - 1)).where("move IS NOT NULL")
    k = r.withColumn("k", F.greatest(F.lit(1), F.floor(F.count("*").over(W.partitionBy("symbol")) * 10 / 100)))
    k = k.withColumn("place", F.rank().over(W.partitionBy("symbol").orderBy(F.desc("move")))).where(F.col("place") <= F.col("k"))
    return k.select("symbol", "day", F.round("move", 6).alias("move"))


@query("""WITH t AS (SELECT ntile(10) OVER (ORDER BY value DESC, event_id) AS step, (event_id % 3 = 0)::INT AS c FROM events), p AS (SELECT step, sum(c) AS c, count(*) AS n FROM t GROUP BY 1)
SELECT step::INT AS step, (sum(n) OVER w)::BIGINT AS n, round(sum(c) OVER w / sum(n) OVER w, 6) AS accuracy FROM p WINDOW w AS (ORDER BY step)""")
def n18_risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_id") % 3 == 0)
    return N.risk_coverage(e, "value", "ok", "event_id").select("step", "n", F.round("accuracy", 6).alias("accuracy"))


@query("SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'train' ELSE 'test' END AS part FROM orders")
def n20_temporal_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "train").otherwise("test").alias("part"))


@query(f"""WITH {PANEL}, l AS (SELECT symbol, day, ln(1 + abs(ret)) AS lv, lag(ln(1 + abs(ret)), 1) OVER w AS l1, lag(ln(1 + abs(ret)), 2) OVER w AS l2, (dayofweek(day) = 1)::INT AS monday, lead(ln(1 + abs(ret))) OVER w AS target FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day, round(lv, 6) AS lv, round(l1, 6) AS l1, round(l2, 6) AS l2, monday, round(target, 6) AS target FROM l WHERE l2 IS NOT NULL AND target IS NOT NULL""")
def n21_design_matrix(spark: SparkSession, d: str) -> DataFrame:
    w = S.ordered(["symbol"], ["day"])
    p = panel(spark, d).withColumn("lv", F.log(1 + F.abs("ret")))
    p = p.select("symbol", "day", "lv", F.lag("lv", 1).over(w).alias("l1"), F.lag("lv", 2).over(w).alias("l2"), (F.dayofweek("day") == 2).cast("int").alias("monday"), F.lead("lv").over(w).alias("target"))
    return p.where("l2 IS NOT NULL AND target IS NOT NULL").select("symbol", "day", "monday", *[F.round(c, 6).alias(c) for c in ("lv", "l1", "l2", "target")])


def _rows(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], f"i int, {name} double")


@query()
def m01_ridge_transport(spark: SparkSession, d: str) -> DataFrame:
    """Singular values of the ridge map from each vector to the next one."""
    v = table(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    w = L.ridge(v.join(b, "vec_id"), "embedding", "following", 1.0)
    return _rows(spark, L.channels(w, 8)[0], "singular")


@query(f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, CASE WHEN label > 4 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM embeddings),
{solved("probe", "SELECT 0 AS g, vec_id AS pair, e AS a, list_prepend(y, list_transform(e[2:], lambda x: 0.0)) AS b FROM v")}
SELECT (i - 1)::INTEGER AS i, round(w[1][i], 8) AS weight FROM probe, range(1, (SELECT max(len(e)) + 1 FROM v)) t(i)""")
def m03_ridge_probe(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("y", (F.col("label") > 4).cast("double") * 2 - 1)
    return _rows(spark, L.probe(v, "embedding", "y", 1.0), "weight").withColumn("weight", F.round("weight", 8))


@query()
def m04_gist_removal(spark: SparkSession, d: str) -> DataFrame:
    """Length of each vector with the three leading directions taken out."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    directions, _ = L.principal(v, "embedding", 3)
    left = L.without(v, "embedding", directions, "rest")
    return left.select("vec_id", F.sqrt(F.aggregate("rest", F.lit(0.0), lambda s, x: s + x * x)).alias("length"))


@query(f"""WITH {PANEL}, m AS (SELECT day, avg(ret) AS mk FROM panel GROUP BY 1) SELECT symbol, count(*) AS n, round(regr_intercept(ret, mk), 5) AS intercept, round(regr_slope(ret, mk), 6) AS slope FROM panel JOIN m USING (day) GROUP BY 1 HAVING count(*) >= 5""")
def m25_ols_residual(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d)
    p = p.join(p.groupBy("day").agg(F.avg("ret").alias("mk")), "day")
    o = L.per_group_ols(p, "symbol", "ret", ["mk"])
    return o.select("symbol", "n", F.round(F.col("coefficients")[0], 5).alias("intercept"), F.round(F.col("coefficients")[1], 6).alias("slope"))


@query()
def m18_pca_share(spark: SparkSession, d: str) -> DataFrame:
    _, share = L.principal(table(spark, d, "embeddings").select("embedding"), "embedding", 8, centre=True)
    return _rows(spark, share, "share")


@query(f"""WITH {PANEL}, x AS (SELECT day, avg(ret) FILTER (sector = 0) AS a, avg(ret) FILTER (sector = 1) AS b, avg(ret) FILTER (sector = 2) AS c FROM panel GROUP BY 1),
z AS (SELECT day, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS za, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS zb, (c - avg(c) OVER ()) / stddev_pop(c) OVER () AS zc FROM x) SELECT day, round(za - zb - 0.5 * zc, 5) AS risk_on FROM z""")
def m14_risk_on(spark: SparkSession, d: str) -> DataFrame:
    """z(first) - z(second) - z(third) / 2 over the sample; the moments are one row, not a global window."""
    x = panel(spark, d).groupBy("day").pivot("sector", [0, 1, 2]).agg(F.avg("ret"))
    m = x.agg(*[f(str(i)).alias(f"{n}{i}") for i in range(3) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = lambda i: (F.col(str(i)) - F.col(f"m{i}")) / F.col(f"s{i}")
    return x.join(F.broadcast(m)).select("day", F.round(z(0) - z(1) - 0.5 * z(2), 5).alias("risk_on"))


@query(f"""WITH {PARTS}, sg AS (SELECT symbol, day, CASE WHEN count(idio) OVER f >= 5 AND stddev_pop(idio) OVER f > 1e-12 THEN abs(idio / stddev_pop(idio) OVER f) END AS sigma FROM parts WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
ev AS (SELECT user_id AS symbol, ts::DATE AS day, event_type AS cls FROM events WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY ALL), ob AS (SELECT cls, symbol, day, sigma FROM ev JOIN sg USING (symbol, day) WHERE sigma IS NOT NULL),
g AS (SELECT unnest([DATE '2024-01-15', DATE '2024-01-22']) AS as_of), pr AS (SELECT cls, as_of, count(*) AS n, avg(sigma) AS prior, stddev_pop(sigma) AS sd FROM g JOIN ob ON day >= as_of - 10 AND day < as_of GROUP BY ALL HAVING count(*) >= 18),
ct AS (SELECT as_of, avg(sigma) AS control FROM g JOIN (SELECT sg.* FROM sg ANTI JOIN ev USING (symbol, day) WHERE sigma IS NOT NULL) ON day >= as_of - 10 AND day < as_of GROUP BY 1),
j AS (SELECT ob.cls, symbol, day, sigma, (SELECT max(as_of) FROM g WHERE as_of <= day) AS as_of FROM ob WHERE day >= DATE '2024-01-15'),
v AS (SELECT j.cls, symbol, day, sigma, prior, sd, control, sigma - prior AS surprise FROM j JOIN ct USING (as_of) LEFT JOIN pr ON pr.cls = j.cls AND pr.as_of = j.as_of)
SELECT cls, symbol, day, CASE WHEN prior IS NULL THEN 'class_not_measurable' WHEN sigma < control THEN 'below_control' WHEN prior <= control THEN 'class_not_distinguishable' WHEN surprise <= 0 THEN 'no_surprise' END AS gate_failed,
CASE WHEN prior IS NULL OR sigma < control OR prior <= control OR surprise <= 0 THEN 'INSUFFICIENT' WHEN surprise / sd < 0.35 THEN 'WEAK' WHEN surprise / sd < 0.9 THEN 'MODERATE' ELSE 'STRONG' END AS confidence FROM v""")
def x01_gate_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on each event's residual move: trailing class prior and control in force on its day, never later ones."""
    sg = S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5).select("symbol", "day", "sigma").where("sigma IS NOT NULL")
    ev = table(spark, d, "events").where("event_type IN ('purchase', 'error', 'signup')").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"), F.col("event_type").alias("cls")).distinct()
    ob = ev.join(sg, ["symbol", "day"])
    grid = spark.range(2).select(F.expr("date_add(DATE '2024-01-15', CAST(7 * id AS INT))").alias("day"))
    prior = A.rolling_prior(ob, "cls", "day", "sigma", grid, 10, 18).drop("n")
    quiet = sg.join(ev.select("symbol", "day").distinct(), ["symbol", "day"], "left_anti").withColumn("any", F.lit("control"))
    control = A.rolling_prior(quiet, "any", "day", "sigma", grid, 10, 1).select("as_of", F.col("prior").alias("control"))
    held = ob.where("day >= DATE '2024-01-15'").withColumn("as_of", F.when(F.col("day") >= F.lit("2024-01-22").cast("date"), F.lit("2024-01-22").cast("date")).otherwise(F.lit("2024-01-15").cast("date")))
    rows = held.join(F.broadcast(control), "as_of").join(F.broadcast(prior), ["cls", "as_of"], "left")
    v = A.gate_verdict(F.col("sigma"), F.col("prior"), F.col("prior_sd"), F.col("control"))
    return rows.select("cls", "symbol", "day", v["gate_failed"].alias("gate_failed"), v["confidence"].alias("confidence"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice AS actual, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prior, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice * 0.9 END AS expected FROM orders)
SELECT o_orderkey, round(actual - coalesce(expected, prior), 4) AS surprise, round((actual - coalesce(expected, prior)) / abs(nullif(coalesce(expected, prior), 0)), 6) AS pct FROM p""")
def x06_event_surprise(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    prior = F.lag("o_totalprice").over(S.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"]))
    base = F.coalesce(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 0.9), prior)
    rows = o.select("o_orderkey", F.col("o_totalprice").alias("actual"), base.alias("base"))
    gap = F.col("actual") - F.col("base")
    return rows.select("o_orderkey", F.round(gap, 4).alias("surprise"), F.round(F.try_divide(gap, F.abs("base")), 6).alias("pct"))


@query("""SELECT event_type AS region, round(sum(w), 5) AS weight, round(sum(w * s) / sqrt(sum(w)), 5) AS pressure, round(sum(w) FILTER (s < 0) / sum(w), 6) AS risk_off FROM (SELECT event_type, power(0.5, date_diff('day', ts::DATE, DATE '2024-01-31') / 7.0) AS w, CASE WHEN value > 66 THEN 1 WHEN value < 33 THEN -1 ELSE 0 END AS s FROM events) GROUP BY 1""")
def x18_risk_region(spark: SparkSession, d: str) -> DataFrame:
    """Directional pressure with weights that halve every week."""
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    e = table(spark, d, "events").select(F.col("event_type").alias("region"), F.pow(F.lit(0.5), age / 7).alias("w"), F.when(F.col("value") > 66, 1).when(F.col("value") < 33, -1).otherwise(0).alias("s"))
    return e.groupBy("region").agg(F.round(F.sum("w"), 5).alias("weight"), F.round(F.sum(F.col("w") * F.col("s")) / F.sqrt(F.sum("w")), 5).alias("pressure"), F.round(F.sum(F.when(F.col("s") < 0, F.col("w"))) / F.sum("w"), 6).alias("risk_off"))


@query("""WITH s AS (SELECT 1 AS section, doc_id, lang AS claim FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 2, doc_id, source FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 3, doc_id, lang FROM documents WHERE doc_id % 3 = 2)
SELECT section, doc_id, claim FROM s QUALIFY row_number() OVER (PARTITION BY claim ORDER BY section, doc_id) = 1""")
def x19_brief_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Sections in order; a claim stays where it comes first."""
    docs = table(spark, d, "documents")
    part = lambda k, r, c: docs.where(f"doc_id % 3 = {r}").select(F.lit(k).alias("section"), "doc_id", F.col(c).alias("claim"))
    rows = part(1, 0, "lang").unionByName(part(2, 1, "source")).unionByName(part(3, 2, "lang"))
    return first_per_key(rows, ["claim"], [F.col("section"), F.col("doc_id")])


@query("SELECT count(*) AS all_rows, count(*) FILTER (value > 20) AS g1, count(*) FILTER (value > 20 AND event_type <> 'view') AS g2, count(*) FILTER (value > 20 AND event_type <> 'view' AND user_id % 2 = 0) AS g3 FROM events")
def x10_minting_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Staged filters with a counter each, in one pass."""
    g1 = F.col("value") > 20
    g2 = g1 & (F.col("event_type") != "view")
    return table(spark, d, "events").agg(F.count("*").alias("all_rows"), F.count_if(g1).alias("g1"), F.count_if(g2).alias("g2"), F.count_if(g2 & (F.col("user_id") % 2 == 0)).alias("g3"))
