"""Queries of the probes: direct pairs against siblings, impact, latency, sparse targets and learned metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import linear as L
from tidemark.operators import neighbours as K
from tidemark.operators import probes as P
from tidemark.operators import stats as N
from tidemark.operators import transport as M
from tidemark.operators.graph import saved
from tidemark.operators.order import rank_all
from tidemark.operators.temporal import first_per_key
from tidemark.plans.maps import STRENGTH, UNIT, carry, cos, fitted, pairs, solved, unit_vectors
from tidemark.plans.stats import m14_risk_on
from tidemark.plans.windows import PANEL
from tidemark.registry import query, table

#: A vector causes those so many places on; hashes of pairs that split and balance them.
STEPS = [1, 4, 9]
HASH = "(x * 2654435761 + y * 40503) % 1000003"
EDGES = f"v AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)), edges AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e AS ea, b.e AS eb FROM v a JOIN v b ON b.vec_id - a.vec_id IN ({', '.join(map(str, STEPS))}))"


@query(f"""WITH RECURSIVE {EDGES}, {solved("one", "SELECT 0 AS g, a * 100 + b - a AS pair, ea AS a, eb AS b FROM edges")},
m AS (SELECT vec_id, e, t, [label, 100 + vec_id % 7] AS names FROM (SELECT vec_id, label, e, {carry("e", "w")} AS t FROM v, one)),
ring AS (SELECT b AS x, coalesce(lead(b) OVER r, first_value(b) OVER r) AS y FROM edges WINDOW r AS (PARTITION BY a ORDER BY b * 2654435761 % 1000003, b)),
neg AS (SELECT x, y FROM (SELECT x, y FROM ring WHERE x <> y UNION SELECT y, x FROM ring WHERE x <> y) ANTI JOIN edges ON a = x AND b = y),
every AS (SELECT a AS x, b AS y, 1 AS label FROM edges UNION ALL SELECT x, y, 0 FROM neg), least AS (SELECT min(n) AS n FROM (SELECT label, count(*) AS n FROM every GROUP BY 1)),
kept AS (SELECT x, y, label, {HASH} AS h FROM every QUALIFY row_number() OVER (PARTITION BY label ORDER BY h, x, y) <= (SELECT n FROM least)),
f AS (SELECT k.x, k.y, k.label, h % 100 < 70 AS train, [{cos("p.t", "q.e")}, {cos("q.t", "p.e")}, list_inner_product(p.e, q.e), len(list_intersect(p.names, q.names)) / len(list_distinct(p.names || q.names))] AS f FROM kept k JOIN m p ON p.vec_id = k.x JOIN m q ON q.vec_id = k.y),
{solved("probe", "SELECT 0 AS g, x * 100000 + y AS pair, f AS a, [label::DOUBLE, 0, 0, 0] AS b FROM f WHERE train", "4")},
s AS (SELECT label, round(list_inner_product(f, w[1]), 9) AS s, round(f[3], 9) AS c FROM f, probe WHERE NOT train),
auc AS (SELECT avg(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END) AS probe, avg(CASE WHEN p.c > n.c THEN 1 WHEN p.c = n.c THEN 0.5 ELSE 0 END) AS cosine FROM s p JOIN s n ON p.label = 1 AND n.label = 0)
SELECT (SELECT count(*) FROM s) AS tests, round(auc.probe, 6) AS probe_auc, round(auc.cosine, 6) AS cosine_auc, round((SELECT avg(((s >= 0.5)::INT = label)::INT) FROM s), 6) AS accuracy,
  round(w[1][1], 5) AS ahead, round(w[1][2], 5) AS back, round(w[1][3], 5) AS cosine, round(w[1][4], 5) AS entities FROM auc, probe""")
def m11_confound_probe(spark: SparkSession, d: str) -> DataFrame:
    """Direct pairs against pairs that only share a cause: a probe of four features, held out, beside plain cosine."""
    v = saved(unit_vectors(spark, d))
    both = v.select(F.col("vec_id").alias("a"), F.explode(F.array(*[F.lit(s) for s in STEPS])).alias("s")).select("a", (F.col("a") + F.col("s")).alias("b"))
    edges = saved(both.join(v.select(F.col("vec_id").alias("b")), "b", "left_semi").select("a", "b"))
    side = lambda c: v.select(F.col("vec_id").alias(c), F.col("e").alias(f"e{c}"))
    w = L.ridge(edges.join(side("a"), "a").join(side("b"), "b"), "ea", "eb", STRENGTH)
    h = (F.col("x") * F.lit(2654435761) + F.col("y") * F.lit(40503)) % F.lit(1000003)
    kept = P.balanced(edges.toDF("x", "y"), P.siblings(edges, F.col("b") * F.lit(2654435761) % F.lit(1000003)), h)
    m = M.carried(v, "e", w, "m").withColumn("names", F.array(F.col("label").cast("long"), 100 + F.col("vec_id") % 7))
    f = saved(P.pair_features(kept, m, "vec_id", "e", "m", "names").withColumn("train", F.col("h") % 100 < 70))
    weights = L.probe(f.where("train"), "features", "label", STRENGTH)
    score = V.dot(F.col("features"), F.array(*[F.lit(float(x)) for x in weights]))
    s = saved(f.where("NOT train").select("label", F.round(score, 9).alias("s"), F.round(F.col("features")[2], 9).alias("c")))
    right = s.agg(F.avg(((F.col("s") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("accuracy"))
    rows = N.auc(s, "label", "s").select(F.col("n").alias("tests"), F.round("auc", 6).alias("probe_auc")).join(N.auc(s, "label", "c").select(F.round("auc", 6).alias("cosine_auc"))).join(right)
    named = [F.lit(round(float(x), 5)).alias(c) for x, c in zip(weights, ("ahead", "back", "cosine", "entities"), strict=True)]
    return rows.select("tests", "probe_auc", "cosine_auc", F.round("accuracy", 6).alias("accuracy"), *named)


#: A user is a document; its impact is the largest standardised value of its events.
IMPACT = f"""{UNIT}, z AS (SELECT user_id, abs(value - avg(value) OVER w) / stddev_samp(value) OVER w AS z FROM events WINDOW w AS (PARTITION BY user_id)), y AS (SELECT user_id AS vec_id, max(z) AS y FROM z GROUP BY 1),
sup AS (SELECT v.vec_id, e, y, (label + 1) / 10 AS confidence FROM v JOIN y USING (vec_id)), cut AS (SELECT quantile_disc(vec_id, 0.7) AS edge FROM v),
kind AS (SELECT CASE WHEN count(*) FILTER (vec_id >= edge) >= 30 THEN 'temporal' ELSE 'hash' END AS split FROM sup, cut),
parts AS (SELECT sup.*, CASE WHEN split = 'temporal' THEN vec_id >= edge ELSE vec_id * 2654435761 % 100 < 30 END AS test, split FROM sup, cut, kind)"""


@query(f"""WITH RECURSIVE {IMPACT}, {solved("probe", "SELECT 0 AS g, vec_id AS pair, e AS a, list_prepend(y, list_transform(e[2:], lambda x: 0.0)) AS b FROM parts WHERE NOT test")},
t AS (SELECT vec_id, split, y, confidence, round(list_inner_product(e, w[1]), 9) AS p FROM parts, probe WHERE test),
r AS (SELECT *, row_number() OVER (ORDER BY p, vec_id) AS rp, row_number() OVER (ORDER BY y, vec_id) AS ry, row_number() OVER (ORDER BY confidence, vec_id) AS rc, row_number() OVER (ORDER BY p DESC, vec_id) AS place, greatest(ceil(count(*) OVER () * 0.1), 1) AS k FROM t)
SELECT any_value(split) AS split, (SELECT count(*) FROM parts WHERE NOT test) AS train, count(*) AS test, round(corr(rp, ry), 6) AS spearman, round(corr(rc, ry), 6) AS of_confidence, max(k)::BIGINT AS top, round(avg(y), 6) AS base, round(avg(y) FILTER (place <= k) / avg(y), 6) AS lift FROM r""")
def m12_impact(spark: SparkSession, d: str) -> DataFrame:
    """Impact from the vector alone, tested on later documents, or on a hash of them where too few are later."""
    v = saved(unit_vectors(spark, d))
    ev = table(spark, d, "events")
    of = ev.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    y = ev.join(of, "user_id").groupBy(F.col("user_id").alias("vec_id")).agg(F.max(F.try_divide(F.abs(F.col("value") - F.col("mean")), F.col("sd"))).alias("y"))
    sup = saved(v.join(y, "vec_id").withColumn("confidence", (F.col("label") + 1) / 10))
    edge = v.agg(F.expr("percentile_disc(0.7) WITHIN GROUP (ORDER BY vec_id)")).first()[0]
    parts, kind = P.split_by_time(sup, F.col("vec_id") >= F.lit(edge), F.col("vec_id") * F.lit(2654435761) % 100 < 30)
    train = parts.where("NOT test")
    weights = L.probe(train, "e", "y", STRENGTH)
    t = saved(parts.where("test").withColumn("p", F.round(V.dot(F.col("e"), F.array(*[F.lit(float(x)) for x in weights])), 9)).select("vec_id", "y", "confidence", "p"))
    k, base, lift = P.top_lift(t, "p", "y", "vec_id")
    row = (kind, train.count(), t.count(), P.spearman(t, "p", "y", "vec_id"), P.spearman(t, "confidence", "y", "vec_id"), k, base, lift)
    made = spark.createDataFrame([row], "split string, train long, test long, spearman double, of_confidence double, top long, base double, lift double")
    return made.select("split", "train", "test", "top", *[F.round(c, 6).alias(c) for c in ("spearman", "of_confidence", "base", "lift")])


#: A pair's effect follows its cause by so many days; those of up to 30 count.
LAGS = f"""{UNIT}, lags AS (SELECT a.vec_id, a.label, a.e, 1 + a.vec_id * 7 % 40 AS lag, a.vec_id % 5 = 0 AS test FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 WHERE 1 + a.vec_id * 7 % 40 <= 30),
{solved("probe", "SELECT 0 AS g, vec_id AS pair, e AS a, list_prepend(lag::DOUBLE, list_transform(e[2:], lambda x: 0.0)) AS b FROM lags WHERE NOT test")},
mean AS (SELECT avg(lag) AS mean, count(*) AS train FROM lags WHERE NOT test), t AS (SELECT vec_id, label, lag, round(list_inner_product(e, w[1]), 9) AS p FROM lags, probe WHERE test)"""


def lagged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training pairs with their lags, and held-out ones with predicted lags ``p``."""
    lag = 1 + (F.col("pair") - 1) * 7 % 40
    p = pairs(spark, d).withColumn("lag", lag).where("lag <= 30").select((F.col("pair") - 1).alias("vec_id"), "a", "lag", "test")
    train = saved(p.where("NOT test"))
    weights = L.probe(train, "a", "lag", STRENGTH)
    score = F.round(V.dot(F.col("a"), F.array(*[F.lit(float(x)) for x in weights])), 9)
    return train, saved(p.where("test").select("vec_id", "lag", score.alias("p")))


@query(f"""WITH RECURSIVE {LAGS}, r AS (SELECT *, row_number() OVER (ORDER BY p, vec_id) AS rp, row_number() OVER (ORDER BY lag, vec_id) AS rl FROM t)
SELECT any_value(train) AS train, count(*) AS test, round(any_value(mean), 6) AS mean_lag, round(avg(abs(mean - lag)), 6) AS by_mean, round(avg(abs(p - lag)), 6) AS by_probe, round(corr(rp, rl), 6) AS spearman FROM r, mean""")
def m12_latency(spark: SparkSession, d: str) -> DataFrame:
    """Days from cause to effect, from the cause's vector: error beside that of the mean, and rank correlation."""
    train, t = lagged(spark, d)
    n, mean = train.agg(F.count("*"), F.avg("lag")).first()
    rho = P.spearman(t, "p", "lag", "vec_id")
    s = t.agg(F.count("*").alias("test"), F.round(F.avg(F.abs(F.lit(mean) - F.col("lag"))), 6).alias("by_mean"), F.round(F.avg(F.abs(F.col("p") - F.col("lag"))), 6).alias("by_probe"))
    return s.select(F.lit(n).cast("long").alias("train"), "test", F.round(F.lit(mean).cast("double"), 6).alias("mean_lag"), "by_mean", "by_probe", F.round(F.lit(rho).cast("double"), 6).alias("spearman"))


@query(f"""WITH RECURSIVE {LAGS}, mid AS (SELECT list_sort(list(p))[count(*) // 2 + 1] AS mid FROM t), g AS (SELECT CASE WHEN p <= mid THEN 'fast' ELSE 'slow' END AS pace, label, count(*) AS n FROM t, mid GROUP BY ALL)
SELECT pace, label, n, row_number() OVER (PARTITION BY pace ORDER BY n DESC, label)::INTEGER AS rank FROM g QUALIFY rank <= 8""")
def m12_latency_paces(spark: SparkSession, d: str) -> DataFrame:
    """The labels most frequent among causes of fast and of slow predicted effects, parted at the median."""
    _, t = lagged(spark, d)
    place = t.count() // 2 + 1
    mid = rank_all(t, ["p", "vec_id"], "place").where(F.col("place") == place).select(F.col("p").alias("mid"))
    rows = t.join(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id").join(F.broadcast(mid))
    g = rows.groupBy(F.when(F.col("p") <= F.col("mid"), "fast").otherwise("slow").alias("pace"), "label").agg(F.count("*").alias("n"))
    return first_per_key(g, ["pace"], [F.desc("n"), F.col("label")], rank="rank", most=8)


@query(f"""WITH RECURSIVE {UNIT}, y AS (SELECT user_id AS doc, regexp_extract(props, '[0-9]+')::BIGINT AS symbol, avg(value) / 100 AS y FROM events GROUP BY ALL), x AS (SELECT doc, symbol, y, e FROM y JOIN v ON vec_id = doc WHERE doc % 5 <> 0),
{solved("inv", "SELECT DISTINCT 0 AS g, doc AS pair, e AS a, e AS b FROM x", right="CASE WHEN x.i = y.i THEN 1.0 ELSE 0.0 END")},
r AS (SELECT symbol, list(s ORDER BY i) AS r FROM (SELECT symbol, i, sum(y * e[i]) AS s FROM x, range(1, (SELECT max(len(e)) + 1 FROM v)) t(i) GROUP BY ALL) GROUP BY symbol), ws AS (SELECT symbol, {carry("r", "w")} AS ws FROM r, inv)
SELECT vec_id AS doc, symbol, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(e, ws), 9) DESC, symbol)::INTEGER AS rank, round(list_inner_product(e, ws), 6) AS score FROM v, ws WHERE vec_id % 5 = 0 QUALIFY rank <= 3""")
def m10_symbol_scores(spark: SparkSession, d: str) -> DataFrame:
    """The three symbols that each held-out document moves most, by one ridge output for each symbol."""
    v = saved(unit_vectors(spark, d).select(F.col("vec_id").alias("doc"), "e"))
    symbol = F.regexp_extract("props", "[0-9]+", 0).cast("long")
    y = table(spark, d, "events").groupBy(F.col("user_id").alias("doc"), symbol.alias("symbol")).agg((F.avg("value") / 100).alias("y"))
    w = saved(P.sparse_targets(v.where("doc % 5 <> 0"), y, "doc", "e", "symbol", "y", STRENGTH))
    top = K.exact(v.where("doc % 5 = 0"), w, 3, query="doc", q="e", item="symbol", x="weights")
    return top.select(F.col("query").alias("doc"), F.col("item").alias("symbol"), "rank", F.round("score", 6).alias("score"))


#: Documents in twos are of one event where their languages agree; how many sources tell of it is its corroboration.
SOURCES = f"""{UNIT}, told AS (SELECT doc_id, source, count(DISTINCT source) OVER (PARTITION BY doc_id // 2, lang) AS corrob FROM documents), facts AS (SELECT vec_id, e, source, corrob, (label + 1) / 10 AS confidence, vec_id * 2654435761 % 100 < 30 AS test FROM v JOIN told ON doc_id = vec_id),
{solved("probe", "SELECT 0 AS g, vec_id AS pair, e AS a, list_prepend(corrob::DOUBLE, list_transform(e[2:], lambda x: 0.0)) AS b FROM facts WHERE NOT test")}"""


def corroborated(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, e, source, corrob, confidence, test``."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.expr("doc_id div 2").alias("event"))
    sources = docs.groupBy("event", "lang").agg(F.countDistinct("source").alias("corrob"))
    told = docs.join(sources, ["event", "lang"])
    v = unit_vectors(spark, d).join(told.select(F.col("doc_id").alias("vec_id"), "source", "corrob"), "vec_id")
    return saved(v.select("vec_id", "e", "source", "corrob", ((F.col("label") + 1) / 10).alias("confidence"), (F.col("vec_id") * F.lit(2654435761) % 100 < 30).alias("test")))


@query(f"""WITH RECURSIVE {SOURCES}, t AS (SELECT vec_id, corrob, (corrob >= 2)::INT AS y, confidence, round(list_inner_product(e, w[1]), 9) AS p FROM facts, probe WHERE test),
r AS (SELECT row_number() OVER (ORDER BY p, vec_id) AS rp, row_number() OVER (ORDER BY corrob, vec_id) AS rc FROM t),
auc AS (SELECT avg(CASE WHEN a.p > b.p THEN 1 WHEN a.p = b.p THEN 0.5 ELSE 0 END) AS p, avg(CASE WHEN a.confidence > b.confidence THEN 1 WHEN a.confidence = b.confidence THEN 0.5 ELSE 0 END) AS c FROM t a JOIN t b ON a.y = 1 AND b.y = 0)
SELECT (SELECT count(*) FROM facts WHERE NOT test) AS train, (SELECT count(*) FROM t) AS test, (SELECT round(corr(rp, rc), 6) FROM r) AS spearman, round(p, 6) AS probe_auc, round(c, 6) AS confidence_auc FROM auc""")
def m12_source_probe(spark: SparkSession, d: str) -> DataFrame:
    """Corroboration from the vector: rank correlation, and telling what two sources report from what one does, beside plain confidence."""
    facts = corroborated(spark, d)
    train = facts.where("NOT test")
    weights = L.probe(train, "e", "corrob", STRENGTH)
    score = F.round(V.dot(F.col("e"), F.array(*[F.lit(float(x)) for x in weights])), 9)
    t = saved(facts.where("test").select("vec_id", "corrob", (F.col("corrob") >= 2).cast("int").alias("y"), "confidence", score.alias("p")))
    rho = P.spearman(t, "p", "corrob", "vec_id")
    rows = N.auc(t, "y", "p").select(F.round("auc", 6).alias("probe_auc"), F.col("n").alias("test")).join(N.auc(t, "y", "confidence").select(F.round("auc", 6).alias("confidence_auc")))
    return rows.select(F.lit(train.count()).cast("long").alias("train"), "test", F.round(F.lit(rho).cast("double"), 6).alias("spearman"), "probe_auc", "confidence_auc")


@query(f"""WITH {UNIT}, told AS (SELECT doc_id, source, count(DISTINCT source) OVER (PARTITION BY doc_id // 2, lang) AS corrob FROM documents), s AS (SELECT source, count(*) AS n, round(avg((label + 1) / 10), 6) AS confidence, round(avg(corrob), 6) AS corrob, round(avg((corrob >= 2)::INT), 6) AS share FROM v JOIN told ON doc_id = vec_id GROUP BY 1)
SELECT source, n, confidence, corrob, share FROM s QUALIFY row_number() OVER (ORDER BY n DESC, source) <= 12""")
def m12_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The twelve sources with most facts: their mean confidence, mean corroboration and the share that others confirm."""
    s = corroborated(spark, d).groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg("corrob"), 6).alias("corrob"), F.round(F.avg((F.col("corrob") >= 2).cast("int")), 6).alias("share"))
    return s.orderBy(F.desc("n"), "source").limit(12)


#: Vectors belong to days by their ids modulo the month; a day needs three of them and a reading of the market.
RISK = f"""{UNIT}, {PANEL}, sectors AS (SELECT day, avg(ret) FILTER (sector = 0) AS a, avg(ret) FILTER (sector = 1) AS b, avg(ret) FILTER (sector = 2) AS c FROM panel GROUP BY 1),
risk AS (SELECT day, round((a - avg(a) OVER ()) / stddev_pop(a) OVER () - (b - avg(b) OVER ()) / stddev_pop(b) OVER () - 0.5 * (c - avg(c) OVER ()) / stddev_pop(c) OVER (), 5) AS risk FROM sectors), base AS (SELECT min(day) AS d0 FROM panel),
told AS (SELECT vec_id, d0 + (vec_id % 30)::INT AS day, e FROM v, base), sums AS (SELECT day, i, avg(e[i]) AS x FROM told, range(1, (SELECT max(len(e)) + 1 FROM v)) t(i) GROUP BY ALL),
raw AS (SELECT day, list(x ORDER BY i) AS m FROM sums WHERE day IN (SELECT day FROM told GROUP BY 1 HAVING count(*) >= 3) GROUP BY 1),
days AS (SELECT day, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-9)) AS e, risk, row_number() OVER (ORDER BY day) AS k, count(*) OVER () AS n FROM raw JOIN risk USING (day) WHERE risk IS NOT NULL),
{solved("probe", "SELECT 0 AS g, k AS pair, e AS a, list_prepend(risk, list_transform(e[2:], lambda x: 0.0)) AS b FROM days WHERE k <= round(0.7 * n)", strength=0.1)}"""


def regime(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Days with ``test``, ``risk`` and predicted ``p``, and every vector's place ``score`` on the axis that predicts risk."""
    v = saved(unit_vectors(spark, d).select("vec_id", "e"))
    risk = m14_risk_on(spark, d).where("risk_on IS NOT NULL")
    base = F.lit(table(spark, d, "events").agg(F.min(F.to_date("ts"))).first()[0]).cast("date")
    told = v.withColumn("day", F.date_add(base, (F.col("vec_id") % 30).cast("int")))
    cells = told.select("day", F.posexplode("e").alias("i", "x")).groupBy("day", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n")).where("n >= 3")
    days = cells.groupBy("day").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("day", V.unit(F.col("c.x")).alias("e")).join(risk.withColumnRenamed("risk_on", "risk"), "day")
    days = saved(rank_all(days, ["day"], "k"))
    first = round(0.7 * days.count())
    days = days.withColumn("test", F.col("k") > first)
    weights = L.probe(days.where("NOT test"), "e", "risk", 0.1)
    axis = F.array(*[F.lit(float(x)) for x in weights])
    return days.select("day", "test", "risk", F.round(V.dot(F.col("e"), axis), 9).alias("p")), v.select("vec_id", F.round(V.dot(F.col("e"), axis), 9).alias("score"))


@query(f"""WITH RECURSIVE {RISK}, t AS (SELECT day, risk, round(list_inner_product(e, w[1]), 9) AS p FROM days, probe WHERE k > round(0.7 * days.n)),
r AS (SELECT *, row_number() OVER (ORDER BY p, day) AS rp, row_number() OVER (ORDER BY risk, day) AS rr, p - median(p) OVER () AS dp, risk - median(risk) OVER () AS dr FROM t)
SELECT (SELECT count(*) FROM days) - count(*) AS train, count(*) AS test, round(corr(rp, rr), 6) AS spearman, count(*) FILTER (abs(dp) >= 1e-9 AND abs(dr) >= 1e-9) AS decisive, count(*) FILTER (abs(dp) >= 1e-9 AND abs(dr) >= 1e-9 AND sign(dp) = sign(dr)) AS agree FROM r""")
def m13_regime_axis(spark: SparkSession, d: str) -> DataFrame:
    """Market risk from the centroid of a day's vectors, on the latest three tenths of the days: rank correlation and direction."""
    days, _ = regime(spark, d)
    t = saved(days.where("test"))
    rho = P.spearman(t, "p", "risk", "day")
    mid = t.agg(F.percentile("p", 0.5).alias("mp"), F.percentile("risk", 0.5).alias("mr"))
    apart = t.join(F.broadcast(mid)).select((F.col("p") - F.col("mp")).alias("dp"), (F.col("risk") - F.col("mr")).alias("dr"))
    clear = (F.abs("dp") >= 1e-9) & (F.abs("dr") >= 1e-9)
    s = apart.agg(F.count("*").alias("test"), F.count_if(clear).alias("decisive"), F.count_if(clear & (F.signum("dp") == F.signum("dr"))).alias("agree"))
    return s.select(F.lit(days.where("NOT test").count()).cast("long").alias("train"), "test", F.round(F.lit(rho).cast("double"), 6).alias("spearman"), "decisive", "agree")


@query(f"""WITH RECURSIVE {RISK}, s AS (SELECT vec_id, round(list_inner_product(e, w[1]), 9) AS score FROM v, probe), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS up, row_number() OVER (ORDER BY score, vec_id) AS down FROM s)
SELECT 'on' AS pole, up AS rank, vec_id, round(score, 6) AS score FROM r WHERE up <= 8 UNION ALL SELECT 'off', down, vec_id, round(score, 6) FROM r WHERE down <= 8""")
def m13_regime_poles(spark: SparkSession, d: str) -> DataFrame:
    """The eight vectors furthest out on either side of the learned axis."""
    _, s = regime(spark, d)
    sides = []
    for pole, order in (("on", [F.desc("score"), F.col("vec_id")]), ("off", [F.col("score"), F.col("vec_id")])):
        top = s.orderBy(*order).limit(8)
        sides.append(first_per_key(top.withColumn("pole", F.lit(pole)), ["pole"], order, rank="rank", most=8))
    return sides[0].union(sides[1]).select("pole", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


#: Rank of the learned metric, a sixth of the vectors' length.
RANK, KS = 10, [5, 10, 30, 100]


@query()
def m09_metric_recall(spark: SparkSession, d: str) -> DataFrame:
    """Whether a cause's own effect is among the nearest later vectors: plain cosine and a learned metric of low rank."""
    v = saved(unit_vectors(spark, d))
    p = saved(pairs(spark, d))
    start, _ = L.principal(v, "e", RANK)
    low = M.metric(M.in_blocks(p.where("NOT test"), "pair", "a", "b"), start.T) if len(start) else np.zeros((1, 1))
    # Later ones only: by negative numbers they are the earlier ones.
    found = None
    for name, rows in (("cosine", v.withColumn("f", F.col("e"))), ("metric", M.carried(v, "e", low.T, "f"))):
        rows = saved(rows.select((-F.col("vec_id")).alias("id"), "f"))
        asked = rows.join(p.where("test").select((1 - F.col("pair")).alias("id")), "id", "left_semi")
        near = K.exact(asked, rows, max(KS), earlier=True, query="id", q="f", item="id", x="f").where(F.col("item") == F.col("query") - 1)
        found = near.select(F.lit(name).alias("by"), "rank") if found is None else found.union(near.select(F.lit(name), "rank"))
    found = saved(found)
    tests = p.where("test").count()
    ks = spark.createDataFrame([(k, by) for k in KS for by in ("cosine", "metric")], "k int, by string")
    hits = found.join(ks, "by").where(F.col("rank") <= F.col("k")).groupBy("k", "by").agg(F.count("*").alias("hits"))
    return ks.join(hits, ["k", "by"], "left").select("k", "by", F.lit(tests).cast("long").alias("tests"), F.round(F.coalesce("hits", F.lit(0)) / max(tests, 1), 6).alias("recall"))
