"""Queries of the multi-hop cause finder and of the graph that it walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import finder as H
from tidemark.operators import neighbours as K
from tidemark.operators import transport as M
from tidemark.operators.graph import saved
from tidemark.plans.maps import EVERY, PAIRS, UNIT, carry, cos, fitted, pairs, unit_vectors
from tidemark.registry import query

NEAREST = 8


def both_forms(spark: SparkSession, d: str) -> DataFrame:
    """``vec_id, label, e, m``: unit vectors and what the map of all pairs carries them to."""
    return saved(M.carried(unit_vectors(spark, d), "e", fitted(pairs(spark, d)), "m"))


def cause_graph(v: DataFrame) -> DataFrame:
    """Each vector's likeliest strictly earlier causes, found exactly."""
    near = K.exact(v, v, NEAREST, earlier=True, query="vec_id", q="e", item="vec_id", x="m")
    return saved(H.weighed(saved(near), H.genericness(v, "vec_id", "e", "m"), "vec_id"))


GRAPH = f"""WITH RECURSIVE {UNIT}, {PAIRS}, {EVERY}, mapped AS (SELECT vec_id, e, {carry("e", "w")} AS t FROM v, one),
m AS (SELECT vec_id, e, list_transform(t, lambda x: x / sqrt(list_inner_product(t, t))) AS m FROM mapped),
mean AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(e[i]) AS x FROM v, range(1, (SELECT max(len(e)) + 1 FROM v)) r(i) GROUP BY i)),
gen AS (SELECT vec_id, list_inner_product(m, mean) AS g FROM m, mean), generic AS (SELECT vec_id, (g - avg(g) OVER ()) / greatest(stddev_pop(g) OVER (), 1e-6) AS z FROM gen),
best AS (SELECT b.vec_id AS effect, a.vec_id AS cause, list_inner_product(a.m, b.e) AS s FROM m a JOIN m b ON a.vec_id < b.vec_id QUALIFY row_number() OVER (PARTITION BY b.vec_id ORDER BY round(s, 9) DESC, a.vec_id) <= {NEAREST}),
soft AS (SELECT effect, cause, exp(4 * (s - max(s) OVER (PARTITION BY effect))) * least(greatest(exp(-z), 1e-3), 1e3) AS w FROM best JOIN generic ON vec_id = cause),
edges AS (SELECT effect, cause, w / sum(w) OVER (PARTITION BY effect) AS share FROM soft)"""


@query(f"{GRAPH} SELECT effect, cause, round(share, 6) AS share FROM edges")
def g12_cause_graph(spark: SparkSession, d: str) -> DataFrame:
    return cause_graph(both_forms(spark, d)).select("effect", "cause", F.round("share", 6).alias("share"))


@query()
def g12_cell_graph(spark: SparkSession, d: str) -> DataFrame:
    """The same graph by cells, with as many probes as a sample of queries needs for a recall of 0.9."""
    v = both_forms(spark, d)
    of = {"query": "vec_id", "q": "e", "item": "vec_id", "x": "m"}
    centre = K.centres(v, "vec_id", "m", H.cells_for(v.count()))
    near = K.by_cells(v, v, NEAREST, centre, K.probes_for(v, v, NEAREST, centre, 0.92, earlier=True, **of), earlier=True, **of)
    return H.weighed(saved(near), H.genericness(v, "vec_id", "e", "m"), "vec_id").select("effect", "cause", F.round("share", 6).alias("share"))


@query(f"""{GRAPH}, asked AS (SELECT vec_id AS query, e AS q FROM m WHERE vec_id % 100 = 0),
direct AS (SELECT query, vec_id AS node, s, row_number() OVER w AS rank FROM (SELECT query, vec_id, {cos("m", "q")} AS s FROM asked JOIN m ON vec_id < query) WINDOW w AS (PARTITION BY query ORDER BY round(s, 9) DESC, vec_id) QUALIFY rank <= 20 AND s > 0),
p0 AS (SELECT query, node, s / sum(s) OVER (PARTITION BY query) AS p FROM direct),
p1 AS (SELECT query, cause AS node, sum(p * share) AS p FROM p0 JOIN edges ON effect = node GROUP BY ALL), p2 AS (SELECT query, cause AS node, sum(p * share) AS p FROM p1 JOIN edges ON effect = node GROUP BY ALL),
p3 AS (SELECT query, cause AS node, sum(p * share) AS p FROM p2 JOIN edges ON effect = node GROUP BY ALL),
hyp AS (SELECT query, node, sum(p) AS mass FROM (SELECT query, node, 0.9 * p AS p FROM p0 UNION ALL SELECT query, node, 0.09 * p FROM p1 UNION ALL SELECT query, node, 0.009 * p FROM p2 UNION ALL SELECT query, node, 0.001 * p FROM p3) GROUP BY ALL),
chain AS (SELECT query, node, mass, row_number() OVER (PARTITION BY query ORDER BY round(mass, 12) DESC, node) AS rank FROM hyp QUALIFY rank <= 100),
topical AS (SELECT query, vec_id AS node, row_number() OVER (PARTITION BY query ORDER BY round({cos("e", "q")}, 9) DESC, vec_id) AS rank FROM asked JOIN m ON vec_id < query QUALIFY rank <= 100),
centre AS (SELECT query, list(x ORDER BY i) AS q FROM (SELECT query, i, sum(mass * e[i]) AS x FROM chain JOIN v ON vec_id = node, range(1, (SELECT max(len(e)) + 1 FROM v)) r(i) WHERE rank <= 15 GROUP BY query, i) GROUP BY query),
support AS (SELECT query, vec_id AS node, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(e, q), 9) DESC, vec_id) AS rank FROM centre JOIN m ON vec_id < query QUALIFY rank <= 100),
lists AS (SELECT 'onehop' AS route, query, node, rank FROM direct UNION ALL SELECT 'chain', query, node, rank FROM chain UNION ALL SELECT 'topical', query, node, rank FROM topical UNION ALL SELECT 'support', query, node, rank FROM support),
modes AS (SELECT * FROM (VALUES ('chain', 'chain'), ('onehop', 'onehop'), ('union', 'onehop'), ('union', 'chain'), ('abductive', 'onehop'), ('abductive', 'chain'), ('abductive', 'topical'), ('abductive', 'support')) AS t(mode, route)),
fused AS (SELECT query, mode, node, sum(1 / (59.0 + rank)::DOUBLE) AS score FROM lists JOIN modes USING (route) GROUP BY ALL),
top AS (SELECT query, mode, node, row_number() OVER (PARTITION BY query, mode ORDER BY round(score, 12) DESC, node)::INTEGER AS rank FROM fused QUALIFY rank <= 8)
SELECT top.query, mode, top.rank, top.node, CASE WHEN c.rank <= 30 AND coalesce(d.rank, 999) > 30 THEN 'chain' ELSE 'direct' END AS via
FROM top LEFT JOIN chain c ON c.query = top.query AND c.node = top.node LEFT JOIN direct d ON d.query = top.query AND d.node = top.node""")
def g12_multi_hop(spark: SparkSession, d: str) -> DataFrame:
    """Earlier causes of each query vector in four modes, over the graph of all vectors."""
    v = both_forms(spark, d)
    asked = saved(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q")))
    return H.multi_hop(asked, v, cause_graph(v))
