"""Queries of the fitted cause-to-effect maps: for all pairs, for each predicate, by margins, and in search.

A pair is a vector and the one that follows it; its predicate is the follower's label and its
desk that label modulo 4.  Pairs whose first id is divisible by 5 are held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import linear as L
from tidemark.operators import retrieval as R
from tidemark.operators import transport as M
from tidemark.operators.graph import saved
from tidemark.operators.temporal import first_per_key
from tidemark.registry import query, table

STRENGTH, LEAST = 1.0, 40

UNIT = "v AS (SELECT vec_id, label, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings))"
PAIRS = "p AS (SELECT b.vec_id AS pair, a.e AS a, b.e AS b, b.label AS predicate, b.label % 4 AS desk, a.vec_id % 5 = 0 AS test FROM v a JOIN v b ON b.vec_id = a.vec_id + 1)"


def solved(name: str, source: str, size: str = "(SELECT max(len(e)) FROM v)", right: str = "list_inner_product(x.a, y.b)", strength: float = STRENGTH) -> str:
    """CTEs that end in ``name``: g, n, columns of the ridge map of each group g of ``source`` (g, pair, a, b), by elimination.

    ``size`` is the vectors' length, ``right`` a cell of the right-hand side.
    """
    return f"""{name}_cols AS (SELECT g, i, count(*) AS n, list(a[i] ORDER BY pair) AS a, list(b[i] ORDER BY pair) AS b FROM ({source}), range(1, {size} + 1) t(i) GROUP BY g, i),
{name}_gram AS (SELECT x.g, x.i, max(x.n) AS n, list(list_inner_product(x.a, y.a) + CASE WHEN x.i = y.i THEN {strength} ELSE 0 END ORDER BY y.i) || list({right} ORDER BY y.i) AS r FROM {name}_cols x JOIN {name}_cols y ON x.g = y.g GROUP BY x.g, x.i),
{name}_steps AS (SELECT g, max(n) AS n, 0 AS k, list(r ORDER BY i) AS m FROM {name}_gram GROUP BY g UNION ALL
  SELECT g, n, k + 1, list_transform(m, lambda r, j: CASE WHEN j = k + 1 THEN pr ELSE list_transform(r, lambda x, c: x - r[k + 1] * pr[c]) END)
  FROM (SELECT g, n, k, m, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) AS pr FROM {name}_steps WHERE k < len(m))),
{name} AS (SELECT g, n, list_transform(range(len(m) + 1, 2 * len(m) + 1), lambda j: list_transform(m, lambda r: r[j])) AS w FROM {name}_steps WHERE k = len(m))"""


def carry(e: str, w: str) -> str:
    return f"list_transform({w}, lambda wc: list_inner_product({e}, wc))"


def cos(x: str, y: str) -> str:
    return f"list_inner_product({x}, {y}) / greatest(sqrt(list_inner_product({x}, {x})), 1e-9)"


ALL = solved("one", "SELECT 0 AS g, pair, a, b FROM p WHERE NOT test")
SCORED = f"""WITH RECURSIVE {UNIT}, {PAIRS}, {ALL}, {solved("own", "SELECT predicate AS g, pair, a, b FROM p WHERE NOT test")},
carried AS (SELECT p.*, {carry("a", "one.w")} AS a1, {carry("b", "one.w")} AS b1, own.n AS support, {carry("a", "coalesce(own.w, one.w)")} AS a2, {carry("b", "coalesce(own.w, one.w)")} AS b2
  FROM p CROSS JOIN one LEFT JOIN own ON own.g = p.predicate AND own.n >= {LEAST} WHERE test),
scored AS (SELECT pair, predicate, desk, support, ({cos("a1", "b")} > {cos("b1", "a")})::INT AS ahead, ({cos("a2", "b")} > {cos("b2", "a")})::INT AS own_ahead FROM carried)"""


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("e"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """``pair, a, b, predicate, desk, test``."""
    v = unit_vectors(spark, d)
    first = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("e").alias("a"), (F.col("vec_id") % 5 == 0).alias("test"))
    both = first.join(v.select("vec_id", "label", F.col("e").alias("b")), "vec_id")
    return both.select(F.col("vec_id").alias("pair"), "a", "b", F.col("label").alias("predicate"), (F.col("label") % 4).alias("desk"), "test")


def fitted(p: DataFrame) -> np.ndarray:
    """The ridge map of all given pairs."""
    return L.ridge(p.select("a", "b"), "a", "b", STRENGTH)


def routed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Held-out pairs with ``ahead`` and ``own_ahead``, and the predicates' maps."""
    p = saved(pairs(spark, d))
    train, test = p.where("NOT test"), p.where("test")
    maps = saved(M.group_maps(train, "predicate", "a", "b", STRENGTH, LEAST))
    return M.directions(test, "pair", "a", "b", "predicate", maps, fitted(train)), maps


@query(f"""{SCORED}, size AS (SELECT g, n, sqrt(list_sum(list_transform(w, lambda c: list_inner_product(c, c)))) AS norm FROM own WHERE n >= {LEAST})
SELECT g AS predicate, n, count(pair) AS tests, round(avg(own_ahead), 6) AS accuracy, round(norm, 6) AS norm FROM size LEFT JOIN scored ON predicate = g GROUP BY g, n, norm""")
def m06_predicate_maps(spark: SparkSession, d: str) -> DataFrame:
    """A map for each predicate with at least 40 pairs: its accuracy on held-out pairs of its own, and its size."""
    scored, maps = routed(spark, d)
    tests = scored.groupBy("predicate").agg(F.count("*").alias("tests"), F.avg("own_ahead").alias("accuracy"))
    norm = F.sqrt(F.aggregate("map", F.lit(0.0), lambda s, x: s + x * x))
    rows = maps.select("predicate", "n", F.round(norm, 6).alias("norm")).join(tests, "predicate", "left")
    return rows.select("predicate", "n", F.coalesce("tests", F.lit(0)).alias("tests"), F.round("accuracy", 6).alias("accuracy"), "norm")


@query(f"""{SCORED}, s AS (SELECT count(*) AS tests, avg(ahead) AS one, avg(own_ahead) AS own, count(*) FILTER (ahead = 1 AND own_ahead = 0) AS one_only, count(*) FILTER (ahead = 0 AND own_ahead = 1) AS own_only FROM scored)
SELECT tests, round(one, 6) AS single, round(own, 6) AS typed, one_only AS single_only, own_only AS typed_only,
  round(CASE WHEN one_only + own_only > 0 THEN greatest(abs(one_only - own_only) - 1, 0) ** 2 / (one_only + own_only) ELSE 0 END, 6) AS chi2 FROM s""")
def m06_routed_direction(spark: SparkSession, d: str) -> DataFrame:
    """Direction of held-out pairs by one map and by their predicates' maps, with the test of paired counts."""
    s = M.mcnemar(routed(spark, d)[0], "ahead", "own_ahead")
    return s.select(F.col("n").alias("tests"), F.round("mean_one", 6).alias("single"), F.round("mean_other", 6).alias("typed"), F.col("one_only").alias("single_only"), F.col("other_only").alias("typed_only"), F.round("chi2", 6).alias("chi2"))


@query(f"""WITH RECURSIVE {UNIT}, {PAIRS}, {solved("own", "SELECT desk AS g, pair, a, b FROM p WHERE NOT test")},
top AS (SELECT g, n, w FROM own WHERE n >= {LEAST} ORDER BY n DESC, g LIMIT 4),
c AS (SELECT g, desk, a, b, {carry("a", "w")} AS a1, {carry("b", "w")} AS b1 FROM top, p WHERE test AND desk IN (SELECT g FROM top))
SELECT g AS trained, desk AS tested, count(*) AS tests, round(avg(({cos("a1", "b")} > {cos("b1", "a")})::INT), 6) AS accuracy FROM c GROUP BY 1, 2""")
def m06_desk_transfer(spark: SparkSession, d: str) -> DataFrame:
    """Direction accuracy on each of the four largest desks of the maps fitted on each."""
    p = saved(pairs(spark, d))
    maps = saved(M.group_maps(p.where("NOT test"), "desk", "a", "b", STRENGTH, LEAST).orderBy(F.desc("n"), "desk").limit(4))
    test = p.where("test").join(F.broadcast(maps.select("desk")), "desk", "left_semi")
    # Four maps at most: each scores all held-out pairs in turn.
    found = None
    for r in maps.select("desk", "map").collect():
        w = np.array(r["map"]).reshape(round(len(r["map"]) ** 0.5), -1)
        rows = led(test, w).groupBy(F.col("desk").alias("tested")).agg(F.count("*").alias("tests"), F.avg((F.col("lead") > 0).cast("int")).alias("accuracy")).withColumn("trained", F.lit(r["desk"]))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = test.select(F.col("desk").alias("tested"), F.lit(0).cast("long").alias("tests"), F.lit(0.0).alias("accuracy"), F.col("desk").alias("trained")).limit(0)
    return found.select("trained", "tested", "tests", F.round("accuracy", 6).alias("accuracy"))


@query()
def m06_predicate_channels(spark: SparkSession, d: str) -> DataFrame:
    """The three largest singular values of each predicate's map."""
    maps = M.group_maps(pairs(spark, d).where("NOT test"), "predicate", "a", "b", STRENGTH, LEAST)

    def values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tops = [np.linalg.svd(np.array(m).reshape(round(len(m) ** 0.5), -1), compute_uv=False)[:3].tolist() for m in b["map"]]
            yield pd.DataFrame({"predicate": b["predicate"], "n": b["n"], "singular": tops})

    return maps.mapInPandas(values, f"predicate {dict(maps.dtypes)['predicate']}, n long, singular array<double>")


def led(p: DataFrame, w: np.ndarray) -> DataFrame:
    """Pairs with ``lead``: by how much the first vector, carried, is nearer to the second than the other way."""
    c = M.carried(M.carried(p, "a", w, "a_to"), "b", w, "b_to")
    return c.withColumn("lead", M.lead(F.col("a"), F.col("b"), F.col("a_to"), F.col("b_to"))).drop("a_to", "b_to")


@query()
def m02_margin_refit(spark: SparkSession, d: str) -> DataFrame:
    """Held-out direction of the ridge map and of its refit by 150 margin steps."""
    p = saved(pairs(spark, d))
    train = p.where("NOT test")
    ridge = fitted(train)
    if not len(ridge):
        return p.select(F.lit("ridge").alias("fit"), F.lit(0).cast("long").alias("tests"), F.lit(0.0).alias("accuracy"), F.lit(0.0).alias("gap")).limit(0)
    margin = M.refine(M.in_blocks(train, "pair", "a", "b"), ridge)
    rows = [led(p.where("test"), w).agg(F.count("*").alias("tests"), F.avg((F.col("lead") > 0).cast("int")).alias("accuracy"), F.avg("lead").alias("gap")).withColumn("fit", F.lit(name)) for name, w in (("ridge", ridge), ("margin", margin))]
    return rows[0].union(rows[1]).select("fit", "tests", "accuracy", "gap")


@query()
def m05_map_channels(spark: SparkSession, d: str) -> DataFrame:
    """The eight strongest channels of the map of all pairs: how much each carries and what goes in."""
    w = fitted(pairs(spark, d))
    values, inputs = L.channels(w, 8) if len(w) else (np.zeros(0), np.zeros((0, 0)))
    return spark.createDataFrame([(i, float(s), [float(x) for x in inputs[:, i]]) for i, s in enumerate(values)], "channel int, strength double, input array<double>")


EVERY = solved("one", "SELECT 0 AS g, pair, a, b FROM p")


@query(f"""WITH RECURSIVE {UNIT}, {PAIRS}, {EVERY}, c AS (SELECT pair, a, b, {carry("a", "w")} AS a1, {carry("b", "w")} AS b1 FROM p, one)
SELECT pair - 1 AS vec_id, round({cos("a1", "b")} - {cos("b1", "a")}, 6) + 0.0 AS lead FROM c""")
def v08_text_direction(spark: SparkSession, d: str) -> DataFrame:
    """How far one vector leads the next: its score under the fitted map less the score the other way."""
    p = saved(pairs(spark, d))
    return led(p, fitted(p)).select((F.col("pair") - 1).alias("vec_id"), (F.round("lead", 6) + 0.0).alias("lead"))


@query(f"""WITH RECURSIVE {UNIT}, {PAIRS}, {EVERY}, m AS (SELECT vec_id, e, {carry("e", "w")} AS m FROM v, one), q AS (SELECT vec_id AS query, e AS q FROM v WHERE vec_id % 100 = 0)
SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY round({cos("m", "q")}, 9) DESC, vec_id) AS rank, round({cos("m", "q")}, 6) AS score, round(list_inner_product(e, q), 6) AS cosine FROM m, q QUALIFY rank <= 10""")
def v07_mapped_search(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors once carried by the fitted map, with their plain cosine beside it."""
    v = saved(unit_vectors(spark, d))
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q"))
    mapped = M.carried(v.select("vec_id", "e"), "e", fitted(pairs(spark, d)), "embedding")
    top = R.top_k(q, mapped.select("vec_id", "embedding"), 10).join(v.select("vec_id", "e"), "vec_id").join(q, "query")
    return top.select("query", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), F.round(V.dot(F.col("e"), F.col("q")), 6).alias("cosine"))


BETAS, SHORT, FEW = [0.0, 0.25, 0.5, 1.0], 100, 10
#: Chunks belong to documents by threes; an entity is a label and an id modulo 5, and a query asks for its own.
CHUNKS = "c AS (SELECT vec_id, vec_id // 3 AS doc, e, label * 5 + vec_id % 5 AS entity FROM v)"
RERANK = f"""WITH RECURSIVE {UNIT}, {PAIRS}, {CHUNKS}, asked AS (SELECT vec_id AS query, e AS q, entity FROM c WHERE vec_id % 100 = 0), cut AS (SELECT quantile_disc(query, 0.3) AS edge FROM asked),
{solved("one", "SELECT 0 AS g, pair, a, b FROM p, cut WHERE pair < edge")},
test AS (SELECT query, q, entity FROM asked, cut WHERE query >= edge),
near AS (SELECT query, vec_id, doc, {cos("e", "q")} AS cosine, e, q FROM test JOIN c ON vec_id < query QUALIFY row_number() OVER (PARTITION BY query ORDER BY round({cos("e", "q")}, 9) DESC, vec_id) <= {SHORT}),
short AS (SELECT query, vec_id, doc, cosine, {carry("e", "w")} AS m, q FROM near, one WHERE query IN (SELECT query FROM near GROUP BY query HAVING count(*) >= {FEW})),
gold AS (SELECT DISTINCT query, doc FROM test JOIN c ON c.entity = test.entity AND vec_id < query), golds AS (SELECT query, count(*) AS gold FROM gold GROUP BY query),
docs AS (SELECT query, beta, doc, round(max(cosine + beta * ({cos("m", "q")})), 9) AS score FROM short, (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS beta) WHERE query IN (SELECT query FROM golds) GROUP BY ALL),
ranked AS (SELECT query, beta, doc, row_number() OVER (PARTITION BY query, beta ORDER BY score DESC, doc) AS rank FROM docs),
each AS (SELECT query, beta, gold, count(gold.doc) AS within, count(gold.doc) FILTER (rank <= 10) AS at10, count(gold.doc) FILTER (rank <= 30) AS at30, min(rank) FILTER (gold.doc IS NOT NULL AND rank <= 10) AS first
  FROM ranked JOIN golds USING (query) LEFT JOIN gold USING (query, doc) GROUP BY ALL),
against AS (SELECT e.*, b.at30 > 0 AS base FROM each e JOIN each b ON b.query = e.query AND b.beta = 0)"""


@query(f"""{RERANK} SELECT beta, count(*) AS queries, round(avg(at10 / gold), 6) AS recall10, round(avg(at30 / gold), 6) AS recall30, round(avg((at10 > 0)::INT), 6) AS hit10, round(avg((at30 > 0)::INT), 6) AS hit30,
  round(avg(coalesce(1 / first, 0)), 6) AS mrr, round(avg(within / gold), 6) AS ceiling, count(*) FILTER (at30 > 0 AND NOT base) AS gained, count(*) FILTER (at30 = 0 AND base) AS lost FROM against GROUP BY beta""")
def o13_transport_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Cosine shortlists of strictly earlier chunks, reranked by a map fitted on pairs before the cut; each weight against none."""
    v = saved(unit_vectors(spark, d))
    chunks = v.select("vec_id", F.expr("vec_id div 3").alias("doc"), F.col("e").alias("embedding"), (F.col("label") * 5 + F.col("vec_id") % 5).alias("entity"))
    asked = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), "entity")
    cut = asked.agg(F.expr("percentile_disc(0.3) WITHIN GROUP (ORDER BY query)")).first()[0]
    test = saved(asked.where(F.col("query") >= F.lit(cut)))
    w = fitted(pairs(spark, d).where(F.col("pair") < F.lit(cut)))
    near = R.top_k(test, chunks, SHORT, earlier=True).select("query", "vec_id", F.col("score").alias("cosine"))
    near = saved(near)
    enough = near.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= FEW)
    gold = saved(chunks.join(test.select("query", "entity"), "entity").where("vec_id < query").select("query", "doc").distinct())
    golds = gold.groupBy("query").agg(F.count("*").alias("gold"))
    short = near.join(enough.select("query"), "query", "left_semi").join(golds.select("query"), "query", "left_semi").join(chunks.select("vec_id", "doc", "embedding"), "vec_id").join(test.select("query", "q"), "query")
    short = M.carried(short, "embedding", w, "m").withColumn("ahead", V.dot(F.col("m"), F.col("q"))) if len(w) else short.withColumn("ahead", F.lit(0.0))
    weighed = short.select("query", "doc", "cosine", "ahead", F.explode(F.array(*[F.lit(b) for b in BETAS])).alias("beta"))
    docs = weighed.groupBy("query", "beta", "doc").agg(F.round(F.max(F.col("cosine") + F.col("beta") * F.col("ahead")), 9).alias("score"))
    ranked = first_per_key(docs, ["query", "beta"], [F.desc("score"), F.col("doc")], rank="rank", most=3 * SHORT)
    hit = ranked.join(gold.withColumn("hit", F.lit(1)), ["query", "doc"], "left").join(golds, "query")
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0))
    each = hit.groupBy("query", "beta", "gold").agg(F.count("hit").alias("within"), F.coalesce(upto(10), F.lit(0)).alias("at10"), F.coalesce(upto(30), F.lit(0)).alias("at30"), F.min(F.when(F.col("hit").isNotNull() & (F.col("rank") <= 10), F.col("rank"))).alias("first"))
    each = saved(each)
    base = each.where("beta = 0").select("query", (F.col("at30") > 0).alias("base"))
    share = lambda c: F.round(F.avg(c), 6)
    return each.join(base, "query").groupBy("beta").agg(
        F.count("*").alias("queries"), share(F.col("at10") / F.col("gold")).alias("recall10"), share(F.col("at30") / F.col("gold")).alias("recall30"), share((F.col("at10") > 0).cast("int")).alias("hit10"), share((F.col("at30") > 0).cast("int")).alias("hit30"),
        share(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), share(F.col("within") / F.col("gold")).alias("ceiling"),
        F.count_if((F.col("at30") > 0) & ~F.col("base")).alias("gained"), F.count_if((F.col("at30") == 0) & F.col("base")).alias("lost"),
    )
