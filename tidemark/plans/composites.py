"""Queries that put operators together: explained moves, priors as of a day, routed and filtered retrieval, gates, fits and nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import retrieval as R
from tidemark.operators import series as S
from tidemark.operators.temporal import first_per_key
from tidemark.plans.retrieval import LINKS, NEAR, query_set, vectors
from tidemark.plans.windows import PANEL, PARTS, panel
from tidemark.registry import query, table


def moves(spark: SparkSession, d: str) -> DataFrame:
    """``symbol, day, sector, market, sector_part, idio`` of each day with a trailing beta."""
    return S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5).where("market IS NOT NULL")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Which classes of event a symbol has on a day."""
    return table(spark, d, "events").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"), F.col("event_type").alias("class")).distinct()


def priors(spark: SparkSession, d: str) -> DataFrame:
    """``class, day, n, prior, sd`` of the idiosyncratic size over strictly earlier days; one row a class and day."""
    size = F.abs("idio")
    daily = moves(spark, d).join(cells(spark, d), ["symbol", "day"]).groupBy("class", "day").agg(F.sum(size).alias("s"), F.sum(size * size).alias("ss"), F.count("*").alias("c"))
    w = W.partitionBy("class").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    n, s, ss = (F.sum(x).over(w) for x in ("c", "s", "ss"))
    sums = daily.select("class", "day", n.alias("n"), s.alias("s"), ss.alias("ss"))
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), F.lit(0.0)))
    return sums.select("class", "day", F.coalesce("n", F.lit(0)).alias("n"), (F.col("s") / F.col("n")).alias("prior"), sd.alias("sd"))


CELLS = "cells AS (SELECT DISTINCT user_id AS symbol, ts::DATE AS day, event_type AS class FROM events)"
PRIORS = f"""{PARTS}, {CELLS}, daily AS (SELECT class, day, sum(abs(idio)) AS s, sum(idio * idio) AS ss, count(*) AS c FROM parts JOIN cells USING (symbol, day) GROUP BY ALL),
sums AS (SELECT class, day, sum(c) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM daily WINDOW w AS (PARTITION BY class ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
priors AS (SELECT class, day, coalesce(n, 0)::BIGINT AS n, s / n AS prior, sqrt(greatest(ss / n - (s / n) * (s / n), 0)) AS sd FROM sums)"""


@query(f"WITH {PRIORS} SELECT class, day, n, round(prior, 6) AS prior, round(sd, 6) AS sd FROM priors")
def x03_priors_as_of(spark: SparkSession, d: str) -> DataFrame:
    return priors(spark, d).select("class", "day", "n", F.round("prior", 6).alias("prior"), F.round("sd", 6).alias("sd"))


@query(f"""WITH {PRIORS}, best AS (SELECT symbol, day, class, prior FROM cells JOIN priors USING (class, day) QUALIFY row_number() OVER (PARTITION BY symbol, day ORDER BY round(prior, 9) DESC NULLS LAST, class) = 1)
SELECT symbol, day, round(idio, 6) AS idio, CASE WHEN abs(idio) >= greatest(abs(market), abs(sector_part)) THEN 'firm' WHEN abs(market) >= abs(sector_part) THEN 'market' ELSE 'sector' END AS channel, class, round(prior, 6) AS prior,
  CASE WHEN prior IS NULL THEN 'no prior' WHEN abs(idio) >= 1.5 * prior THEN 'explained' WHEN abs(idio) >= prior THEN 'weak' ELSE 'ordinary' END AS verdict FROM parts JOIN best USING (symbol, day)""")
def x02_explain_move(spark: SparkSession, d: str) -> DataFrame:
    """Each day's move by its largest part, the class of its news with the largest prior as of the day, and a verdict."""
    known = cells(spark, d).join(priors(spark, d), ["class", "day"])
    best = first_per_key(known, ["symbol", "day"], [F.round("prior", 9).desc_nulls_last(), F.col("class")]).select("symbol", "day", "class", "prior")
    size, market, sector = F.abs("idio"), F.abs("market"), F.abs("sector_part")
    channel = F.when(size >= F.greatest(market, sector), "firm").when(market >= sector, "market").otherwise("sector")
    verdict = F.when(F.col("prior").isNull(), "no prior").when(size >= 1.5 * F.col("prior"), "explained").when(size >= F.col("prior"), "weak").otherwise("ordinary")
    return moves(spark, d).join(best, ["symbol", "day"]).select("symbol", "day", F.round("idio", 6).alias("idio"), channel.alias("channel"), "class", F.round("prior", 6).alias("prior"), verdict.alias("verdict"))


@query(f"""WITH {PARTS}, {CELLS}, m AS (SELECT symbol, day, abs(idio) AS size FROM parts), c AS (SELECT symbol, avg(size) AS control, count(*) AS days FROM m GROUP BY 1)
SELECT symbol, class, count(*) AS n, round(avg(size), 6) AS size, round(avg(size) / any_value(control), 6) AS ratio FROM m JOIN cells USING (symbol, day) JOIN c USING (symbol) GROUP BY ALL""")
def x03_risk_profile(spark: SparkSession, d: str) -> DataFrame:
    """A symbol's mean idiosyncratic size by class of news, and its ratio to all its days."""
    m = moves(spark, d).select("symbol", "day", F.abs("idio").alias("size"))
    control = m.groupBy("symbol").agg(F.avg("size").alias("control"))
    g = m.join(cells(spark, d), ["symbol", "day"]).groupBy("symbol", "class").agg(F.count("*").alias("n"), F.avg("size").alias("size")).join(control, "symbol")
    return g.select("symbol", "class", "n", F.round("size", 6).alias("size"), F.round(F.col("size") / F.col("control"), 6).alias("ratio"))


@query("SELECT ts::DATE AS day, count(*) AS stories, count(DISTINCT user_id) AS names, count(*) >= 100 AS deep FROM events GROUP BY 1")
def x03_covered_days(spark: SparkSession, d: str) -> DataFrame:
    """Stories and names of each day, and whether it is covered deeply."""
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("stories"), F.countDistinct("user_id").alias("names"), (F.count("*") >= 100).alias("deep"))


@query(f"""WITH {PARTS}, {CELLS}, m AS (SELECT sector, symbol, day, abs(idio) AS size FROM parts), news AS (SELECT DISTINCT symbol, day FROM cells WHERE class IN ('error', 'purchase')),
k AS (SELECT sector, avg(size) AS control FROM m ANTI JOIN news ON news.symbol = m.symbol AND news.day = m.day GROUP BY 1)
SELECT sector, class, count(*) AS n, round(avg(size), 6) AS size, round(avg(size) / any_value(control), 6) AS ratio FROM m JOIN cells USING (symbol, day) JOIN k USING (sector) WHERE class IN ('error', 'purchase') GROUP BY ALL HAVING count(*) >= 5""")
def a39_sector_class_cells(spark: SparkSession, d: str) -> DataFrame:
    """Size by sector and class of news against the sector's days without any."""
    m = moves(spark, d).select("sector", "symbol", "day", F.abs("idio").alias("size"))
    c = cells(spark, d).where("class IN ('error', 'purchase')")
    control = m.join(c, ["symbol", "day"], "left_anti").groupBy("sector").agg(F.avg("size").alias("control"))
    g = m.join(c, ["symbol", "day"]).groupBy("sector", "class").agg(F.count("*").alias("n"), F.avg("size").alias("size")).where("n >= 5").join(F.broadcast(control), "sector")
    return g.select("sector", "class", "n", F.round("size", 6).alias("size"), F.round(F.col("size") / F.col("control"), 6).alias("ratio"))


@query(f"""WITH {PARTS} SELECT symbol, day, round(idio, 6) AS idio, row_number() OVER (PARTITION BY symbol ORDER BY round(abs(idio), 9) DESC, day) AS place FROM parts WHERE abs(idio) < 60 AND EXISTS (SELECT 1 FROM events WHERE user_id = symbol AND ts::DATE = day AND event_type = 'error') QUALIFY place <= 8""")
def o26_notable_moves(spark: SparkSession, d: str) -> DataFrame:
    """A firm's eight largest moves that have news and are no data error."""
    m = moves(spark, d).where(F.abs("idio") < 60).join(cells(spark, d).where("class = 'error'"), ["symbol", "day"], "left_semi")
    top = first_per_key(m, ["symbol"], [F.round(F.abs("idio"), 9).desc(), F.col("day")], rank="place", most=8)
    return top.select("symbol", "day", F.round("idio", 6).alias("idio"), F.col("place").cast("long").alias("place"))


@query(f"""WITH {PANEL}, s AS (SELECT symbol, day, ret - avg(ret) OVER f AS surprise, count(*) OVER f AS n FROM panel WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, round(surprise, 6) AS surprise FROM s WHERE n >= 5 ORDER BY round(surprise, 6) DESC, symbol, day LIMIT 20""")
def o18_surprise_top(spark: SparkSession, d: str) -> DataFrame:
    """The twenty largest surprises over the trailing mean."""
    f = S.ordered(["symbol"], ["day"]).rowsBetween(-10, -1)
    s = panel(spark, d).select("symbol", "day", F.round(F.col("ret") - F.avg("ret").over(f), 6).alias("surprise"), F.count("*").over(f).alias("n")).where("n >= 5")
    return s.orderBy(F.desc("surprise"), "symbol", "day").limit(20).select("symbol", "day", "surprise")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS confidence, o_totalprice AS strength FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY confidence, strength DESC, o_orderkey) AS place FROM x QUALIFY place <= 3""")
def o19_driver_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A name's three strongest drivers, by class of confidence, then by prior strength."""
    p = F.col("o_orderpriority")
    o = table(spark, d, "orders").withColumn("confidence", F.when(p == "1-URGENT", 0).when(p == "2-HIGH", 1).when(p == "3-MEDIUM", 2).otherwise(3))
    top = first_per_key(o, ["o_custkey"], [F.col("confidence"), F.col("o_totalprice").desc(), F.col("o_orderkey")], rank="place", most=3)
    return top.select("o_custkey", "o_orderkey", F.col("place").cast("long").alias("place"))


@query(f"""WITH {PANEL}, s AS (SELECT symbol, day, ret - lag(ret, 4) OVER w AS diff FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)),
z AS (SELECT symbol, day, diff, stddev_samp(diff) OVER f AS sd, count(diff) OVER f AS n FROM s WINDOW f AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT symbol, day, round(diff / sd, 6) AS sue FROM z WHERE diff IS NOT NULL AND n >= 4 AND sd > 1e-9""")
def x07_standardised_unexpected(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal difference over the standard deviation of its own earlier values."""
    w = S.ordered(["symbol"], ["day"])
    f = w.rowsBetween(-8, -1)
    s = panel(spark, d).withColumn("diff", F.col("ret") - F.lag("ret", 4).over(w))
    s = s.withColumn("sd", F.stddev_samp("diff").over(f)).withColumn("n", F.count("diff").over(f))
    return s.where("diff IS NOT NULL AND n >= 4 AND sd > 1e-9").select("symbol", "day", F.round(F.col("diff") / F.col("sd"), 6).alias("sue"))


FIT = f"""{PANEL}, x AS (SELECT symbol, day, ret AS y, lag(ret) OVER w AS x1, avg(ret) OVER (PARTITION BY day) AS mk FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day)), f AS (SELECT *, day < DATE '2024-01-16' AS train FROM x WHERE x1 IS NOT NULL)"""


def _lagged(spark: SparkSession, d: str) -> DataFrame:
    p = panel(spark, d).withColumn("x1", F.lag("ret").over(S.ordered(["symbol"], ["day"])))
    p = p.join(p.groupBy("day").agg(F.avg("ret").alias("mk")), "day").where("x1 IS NOT NULL")
    return p.select("symbol", "day", F.col("ret").alias("y"), "x1", "mk", (F.col("day") < F.lit("2024-01-16").cast("date")).alias("train"))


@query(f"""WITH {FIT}, b AS (SELECT regr_slope(y, mk) AS m, regr_intercept(y, mk) AS a, avg(y) AS base FROM f WHERE train),
e AS (SELECT sum(pow(y - a - m * mk, 2)) AS sse, sum(pow(y - base, 2)) AS sst, count(*) AS n FROM f, b WHERE NOT train) SELECT n, round(1 - sse / sst, 6) AS oos_r2 FROM e""")
def n13_oos_r2(spark: SparkSession, d: str) -> DataFrame:
    """R2 on later days of a line fitted on earlier ones, against their mean."""
    f = _lagged(spark, d)
    b = f.where("train").agg(F.regr_slope("y", "mk").alias("m"), F.regr_intercept("y", "mk").alias("a"), F.avg("y").alias("base"))
    e = f.where("NOT train").join(F.broadcast(b)).agg(F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("a") - F.col("m") * F.col("mk"), 2)).alias("sse"), F.sum(F.pow(F.col("y") - F.col("base"), 2)).alias("sst"))
    return e.select("n", F.round(1 - F.col("sse") / F.col("sst"), 6).alias("oos_r2"))


@query(f"""WITH {FIT}, c AS (SELECT corr(y, x1) AS y1, corr(y, mk) AS y2, corr(x1, mk) AS r, count(*) AS n FROM f) SELECT n, round(y1 * y1, 6) AS base_r2, round((y1 * y1 + y2 * y2 - 2 * y1 * y2 * r) / (1 - r * r) - y1 * y1, 6) AS added_r2 FROM c""")
def n13_incremental_r2(spark: SparkSession, d: str) -> DataFrame:
    """What a second regressor adds to R2, from the three correlations."""
    c = _lagged(spark, d).agg(F.count("*").alias("n"), F.corr("y", "x1").alias("y1"), F.corr("y", "mk").alias("y2"), F.corr("x1", "mk").alias("r"))
    y1, y2, r = F.col("y1"), F.col("y2"), F.col("r")
    return c.select("n", F.round(y1 * y1, 6).alias("base_r2"), F.round((y1 * y1 + y2 * y2 - 2 * y1 * y2 * r) / (1 - r * r) - y1 * y1, 6).alias("added_r2"))


@query(f"""WITH {FIT}, w AS (SELECT symbol % 5 AS sector, y, x1 AS x, 1 / (1 + abs(x1)) AS w FROM f), s AS (SELECT sector, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy, sum(w * y * y) AS syy, count(*) AS n FROM w GROUP BY 1),
b AS (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS slope FROM s), r AS (SELECT *, (sy - slope * sx) / sw AS base, syy - sy * sy / sw AS sst FROM b), e AS (SELECT *, sst - slope * (sxy - sx * sy / sw) AS sse FROM r)
SELECT sector, n, round(slope, 6) AS slope, round(base, 6) AS intercept, round(sse / (n - 2) * sw / (sw * sxx - sx * sx), 8) AS slope_var, round(1 - sse / sst, 6) AS r2 FROM e""")
def m26_weighted_fit(spark: SparkSession, d: str) -> DataFrame:
    """Weighted least squares by sector with the slope's variance and R2, from weighted sums."""
    f = _lagged(spark, d).select((F.col("symbol") % 5).alias("sector"), "y", F.col("x1").alias("x"), (1 / (1 + F.abs("x1"))).alias("w"))
    sums = {"sw": "w", "sx": "w * x", "sy": "w * y", "sxx": "w * x * x", "sxy": "w * x * y", "syy": "w * y * y"}
    s = f.groupBy("sector").agg(F.count("*").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in sums.items()])
    s = s.withColumn("slope", F.expr("(sw * sxy - sx * sy) / (sw * sxx - sx * sx)")).withColumn("base", F.expr("(sy - slope * sx) / sw"))
    s = s.withColumn("sst", F.expr("syy - sy * sy / sw")).withColumn("sse", F.expr("sst - slope * (sxy - sx * sy / sw)"))
    var = F.expr("sse / (n - 2) * sw / (sw * sxx - sx * sx)")
    return s.select("sector", "n", F.round("slope", 6).alias("slope"), F.round("base", 6).alias("intercept"), F.round(var, 8).alias("slope_var"), F.round(F.expr("1 - sse / sst"), 6).alias("r2"))


@query(f"""WITH {FIT}, p AS (SELECT symbol, seed, y, mk, row_number() OVER (PARTITION BY symbol, seed ORDER BY day) AS i, row_number() OVER (PARTITION BY symbol, seed ORDER BY md5(seed::VARCHAR || '/' || day::VARCHAR || '/' || symbol::VARCHAR)) AS j FROM f, range(5) s(seed)),
c AS (SELECT a.seed, corr(a.y, b.mk) AS c FROM p a JOIN p b ON a.symbol = b.symbol AND a.seed = b.seed AND a.i = b.j GROUP BY 1), o AS (SELECT corr(y, mk) AS real FROM f)
SELECT round(any_value(real), 6) AS observed, round(avg(c), 6) AS null_mean, any_value(real) > avg(c) + 3 * stddev_samp(c) AS signal, count(*) AS draws FROM c, o""")
def n12_permutation_null(spark: SparkSession, d: str) -> DataFrame:
    """A correlation against five seeded shuffles of the days within each symbol; signal beyond three standard deviations."""
    f = _lagged(spark, d)
    key = F.md5(F.concat_ws("/", F.col("seed").cast("string"), F.col("day").cast("string"), F.col("symbol").cast("string")))
    w = W.partitionBy("symbol", "seed")
    p = f.withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4)))).withColumn("i", F.row_number().over(w.orderBy("day"))).withColumn("j", F.row_number().over(w.orderBy(key)))
    both = p.select("symbol", "seed", "i", "y").join(p.select("symbol", "seed", F.col("j").alias("i"), "mk"), ["symbol", "seed", "i"])
    c = both.groupBy("seed").agg(F.corr("y", "mk").alias("c"))
    null = c.agg(F.avg("c").alias("m"), F.stddev_samp("c").alias("sd"), F.count("*").alias("draws"))
    real = f.agg(F.corr("y", "mk").alias("real")).join(F.broadcast(null))
    return real.select(F.round("real", 6).alias("observed"), F.round("m", 6).alias("null_mean"), (F.col("real") > F.col("m") + 3 * F.col("sd")).alias("signal"), "draws")


@query(f"""WITH {NEAR}, ents AS (SELECT vec_id, [label, 100 + vec_id % 7, 200 + vec_id % 11] AS e FROM embeddings), top AS (SELECT query, list(DISTINCT x) AS have FROM (SELECT query, unnest(e) AS x FROM dense JOIN ents USING (vec_id) WHERE rank <= 5) GROUP BY 1)
SELECT query, vec_id, len(list_intersect(e, have)) AS shared FROM dense JOIN ents USING (vec_id) JOIN top USING (query) WHERE rank <= 40 QUALIFY row_number() OVER (PARTITION BY query ORDER BY shared DESC, rank) <= 10""")
def v04_entity_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hits by how many entities they share with the five best ones."""
    v = vectors(spark, d)
    ents = v.select("vec_id", F.array(F.col("label").cast("long"), 100 + F.col("vec_id") % 7, 200 + F.col("vec_id") % 11).alias("e"))
    pool = R.top_k(query_set(spark, d), v, 40).join(ents, "vec_id")
    have = pool.where("rank <= 5").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("have"))
    pool = pool.join(have, "query").withColumn("shared", F.size(F.array_intersect("e", "have")).cast("long"))
    return first_per_key(pool, ["query"], [F.col("shared").desc(), F.col("rank")], most=10).select("query", "vec_id", "shared")


@query(f"""WITH {NEAR}, f AS (SELECT n.query, n.vec_id, n.score, n.vec_id % 50 AS doc FROM near n JOIN embeddings e USING (vec_id) WHERE e.label <= 7 AND e.label <> 3), g AS (SELECT query, doc, max(score) AS score, arg_max(vec_id, (score, -vec_id)) AS chunk FROM f GROUP BY ALL)
SELECT query, doc, chunk, round(score, 6) AS score FROM g QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) <= 5""")
def v06_filtered_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Best five documents by their best chunk, after filters on tier and exclusion; the filters reach the scan."""
    chunks = vectors(spark, d).where("label <= 7 AND label <> 3").select("vec_id", "embedding", (F.col("vec_id") % 50).alias("doc"))
    best = first_per_key(R.best_chunks(query_set(spark, d), chunks, "doc"), ["query"], [F.round("score", 9).desc(), F.col("doc")], most=5)
    return best.select("query", "doc", F.col("vec_id").alias("chunk"), F.round("score", 6).alias("score"))


@query(f"""WITH {PARTS}, c AS (SELECT symbol, sector, day, CASE WHEN abs(idio) >= 0.6 * (abs(idio) + abs(market) + abs(sector_part)) THEN 'idio' WHEN abs(sector_part) >= 0.6 * (abs(idio) + abs(market) + abs(sector_part)) THEN 'sector' WHEN abs(market) >= 0.6 * (abs(idio) + abs(market) + abs(sector_part)) THEN 'macro' ELSE 'mixed' END AS channel FROM parts)
SELECT c.symbol, c.day, c.channel, count(e.event_id) AS hits FROM c LEFT JOIN (SELECT user_id, ts::DATE AS day, event_id, event_type FROM events) e ON e.day = c.day AND CASE c.channel WHEN 'idio' THEN e.user_id = c.symbol WHEN 'sector' THEN e.user_id % 5 = c.sector WHEN 'macro' THEN e.event_type = 'error' ELSE e.user_id = c.symbol END GROUP BY ALL""")
def v09_channel_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each move's channel decides which stories of its day count: the firm's, its sector's or macro ones; counts meet by key, not story by story."""
    m = moves(spark, d)
    whole = F.abs("idio") + F.abs("market") + F.abs("sector_part")
    channel = F.when(F.abs("idio") >= 0.6 * whole, "idio").when(F.abs("sector_part") >= 0.6 * whole, "sector").when(F.abs("market") >= 0.6 * whole, "macro").otherwise("mixed")
    m = m.select("symbol", "sector", "day", channel.alias("channel"))
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    firm = e.groupBy("day", F.col("user_id").alias("symbol")).agg(F.count("*").alias("firm"))
    sector = e.groupBy("day", (F.col("user_id") % 5).alias("sector")).agg(F.count("*").alias("in_sector"))
    macro = e.where("event_type = 'error'").groupBy("day").agg(F.count("*").alias("macro"))
    m = m.join(firm, ["day", "symbol"], "left").join(sector, ["day", "sector"], "left").join(macro, "day", "left")
    hits = F.when(F.col("channel") == "sector", F.col("in_sector")).when(F.col("channel") == "macro", F.col("macro")).otherwise(F.col("firm"))
    return m.select("symbol", "day", "channel", F.coalesce(hits, F.lit(0)).alias("hits"))


@query("""WITH c AS (SELECT item_id, left(md5(item_id::VARCHAR), 3) AS prefix, text FROM benchmark), d AS (SELECT left(md5(doc_id::VARCHAR), 3) AS prefix, count(*) AS n, min(doc_id) AS doc_id FROM documents GROUP BY 1),
r AS (SELECT item_id, c.text, coalesce(n, 0) AS n, CASE WHEN n = 1 THEN d.doc_id END AS doc_id FROM c LEFT JOIN d USING (prefix))
SELECT r.item_id, r.doc_id, CASE WHEN n = 0 THEN 'MISSING' WHEN n > 1 THEN 'AMBIGUOUS' WHEN len(list_filter(regexp_extract_all(lower(r.text), '[a-z]{4,}'), lambda w: contains(lower(x.text), w))) >= 2 THEN 'OK' ELSE 'WEAK' END AS status FROM r LEFT JOIN documents x ON x.doc_id = r.doc_id""")
def v14_citation_gate(spark: SparkSession, d: str) -> DataFrame:
    """Citations name a document by a prefix, which must be unique; the document must hold some of the claim's words."""
    short = lambda c: F.substring(F.md5(F.col(c).cast("string")), 1, 3).alias("prefix")
    docs = table(spark, d, "documents")
    claims = table(spark, d, "benchmark").select("item_id", short("item_id"), "text")
    named = docs.groupBy(short("doc_id")).agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    r = claims.join(named, "prefix", "left").select("item_id", "text", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("doc_id")).alias("doc_id"))
    r = r.join(docs.select("doc_id", F.lower("text").alias("low")), "doc_id", "left")
    held = F.size(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)), lambda w: F.contains(F.col("low"), w)))
    status = F.when(F.col("n") == 0, "MISSING").when(F.col("n") > 1, "AMBIGUOUS").when(held >= 2, "OK").otherwise("WEAK")
    return r.select("item_id", "doc_id", status.alias("status"))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS fact, l_returnflag = 'R' AS causal, l_discount AS confidence FROM lineitem), s AS (SELECT DISTINCT doc FROM f WHERE fact = 1)
SELECT f.doc, f.fact, round(0.7 * confidence, 6) AS score FROM f JOIN s ON s.doc = f.doc AND f.fact <> 1 QUALIFY row_number() OVER (PARTITION BY f.doc ORDER BY causal DESC, confidence DESC, f.fact) <= 2""")
def g19_sibling_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Two more facts of a hit's document, causal ones first, then by confidence, at 0.7 of it."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("fact"), (F.col("l_returnflag") == "R").alias("causal"), F.col("l_discount").alias("confidence"))
    rest = f.where("fact <> 1").join(f.where("fact = 1").select("doc"), "doc", "left_semi")
    top = first_per_key(rest, ["doc"], [F.col("causal").desc(), F.col("confidence").desc(), F.col("fact")], most=2)
    return top.select("doc", "fact", F.round(0.7 * F.col("confidence"), 6).alias("score"))


@query("""SELECT l_suppkey % 40 AS a, l_partkey % 40 AS b, round(sum(CASE l_returnflag WHEN 'R' THEN 3.0 WHEN 'A' THEN 1.5 ELSE 1.0 END * (CASE WHEN l_linestatus = 'O' THEN 2.0 ELSE 1.0 END)), 3) AS weight FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY ALL""")
def g07_intent_weights(spark: SparkSession, d: str) -> DataFrame:
    """Edge weights under an intent: causal edges count thrice, predicates by their multiplier."""
    kind = F.element_at(F.create_map(F.lit("R"), F.lit(3.0), F.lit("A"), F.lit(1.5)), F.col("l_returnflag"))
    weight = F.coalesce(kind, F.lit(1.0)) * F.when(F.col("l_linestatus") == "O", 2.0).otherwise(1.0)
    l = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"), weight.alias("w")).where("a <> b")
    return l.groupBy("a", "b").agg(F.round(F.sum("w"), 3).alias("weight"))


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), s AS (SELECT s_suppkey AS node, s_nationkey AS nation FROM supplier), p(nation, node, n) AS (SELECT nation, node, 0 FROM s UNION SELECT nation, e.b, n + 1 FROM p JOIN e ON p.node = e.a WHERE n < 4),
r AS (SELECT nation, min(n) AS n FROM p WHERE node IN (SELECT node FROM s WHERE nation = 7) GROUP BY 1) SELECT DISTINCT s.nation, coalesce(r.n, 9) AS hops FROM s LEFT JOIN r USING (nation)""")
def g25_set_distance(spark: SparkSession, d: str) -> DataFrame:
    """Hops between the entities of each nation and those of nation 7, up to four; 9 if none."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")).distinct()
    e = l.union(l.select("b", "a")).distinct()
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("node"))
    goal = s.where("nation = 7").select("node")
    front, seen = [s.withColumn("n", F.lit(0))], s
    for n in range(1, 5):
        step = front[-1].select("nation", F.col("node").alias("a")).join(e, "a").select("nation", F.col("b").alias("node")).distinct().join(seen, ["nation", "node"], "left_anti")
        seen = seen.union(step)
        front.append(step.withColumn("n", F.lit(n)))
    found = reduce(DataFrame.union, front).join(goal, "node", "left_semi").groupBy("nation").agg(F.min("n").alias("n"))
    return s.select("nation").distinct().join(found, "nation", "left").select("nation", F.coalesce("n", F.lit(9)).alias("hops"))


@query("""WITH q AS (SELECT event_id, event_type AS domain, user_id, value, value >= 80 AS cached FROM events), m AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY value DESC, event_id) AS k FROM q WHERE NOT cached)
SELECT event_id, 'cache' AS how FROM q WHERE cached UNION ALL SELECT event_id, CASE WHEN k <= 25 THEN 'fetch' ELSE 'later' END FROM m""")
def r06_budgeted_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Cached links first; of the others each domain's budget is fetched and the rest waits."""
    q = table(spark, d, "events").select("event_id", F.col("event_type").alias("domain"), "value")
    fetch = first_per_key(q.where("value < 80"), ["domain"], [F.col("value").desc(), F.col("event_id")], most=25).select("event_id", F.lit("fetch").alias("fetch"))
    how = F.when(F.col("value") >= 80, "cache").otherwise(F.coalesce("fetch", F.lit("later")))
    return q.where("value IS NOT NULL").join(fetch, "event_id", "left").select("event_id", how.alias("how"))
