"""Queries of ranking, retrieval, set and graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import graph as G
from tidemark.operators import neighbours as K
from tidemark.operators import retrieval as R
from tidemark.operators.order import dealt
from tidemark.operators.temporal import first_per_key
from tidemark.registry import query, table

TOKENS = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9.%$/-]{1,}')"
INDEX = f"""terms AS (SELECT doc_id AS doc, unnest({TOKENS}) AS term FROM documents), tf AS (SELECT doc, term, count(*) AS tf FROM terms GROUP BY ALL), dl AS (SELECT doc_id AS doc, len({TOKENS}) AS dl FROM documents),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), whole AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM dl),
idx AS (SELECT doc, term, tf, dl, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf, avg_dl FROM tf JOIN df USING (term) JOIN dl USING (doc), whole)"""
BM25 = f"""{INDEX}, q AS (SELECT DISTINCT item_id AS query, unnest({TOKENS}) AS term FROM benchmark),
scored AS (SELECT query, doc, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))) AS score FROM q JOIN idx USING (term) GROUP BY ALL),
lexical AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM scored)"""


def lexical(spark: SparkSession, d: str, k: int) -> DataFrame:
    asked = table(spark, d, "benchmark")
    index = R.bm25_index(table(spark, d, "documents"), "doc_id", "text", R.query_terms(asked, "item_id", "text").select("term").distinct())
    return R.bm25(asked, index, "item_id", "text", k)


@query(f"WITH {INDEX} SELECT term, df, round(idf, 6) AS idf FROM idx GROUP BY ALL HAVING df >= 5")
def a23_bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    return R.bm25_index(table(spark, d, "documents"), "doc_id", "text").where("df >= 5").select("term", "df", F.round("idf", 6).alias("idf")).distinct()


@query(f"WITH {BM25} SELECT query, doc, rank, round(score, 5) AS score FROM lexical WHERE rank <= 10")
def v03_bm25_top_k(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d, 10).select("query", "doc", F.col("rank").cast("long"), F.round("score", 5).alias("score"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def query_set(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 100."""
    return vectors(spark, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))


NEAR = """near AS (SELECT q.vec_id AS query, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0),
dense AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near)"""


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def v01_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(b, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query(f"WITH {NEAR} SELECT query, vec_id, rank, round(score, 6) AS score FROM dense WHERE rank <= 10")
def o02_vector_top_k(spark: SparkSession, d: str) -> DataFrame:
    return R.top_k(query_set(spark, d), vectors(spark, d), 10).select("query", "vec_id", F.col("rank").cast("long"), F.round("score", 6).alias("score"))


@query(f"WITH {NEAR} SELECT q.query, d.vec_id, round(d.score, 6) AS score FROM (SELECT DISTINCT query FROM dense) q LEFT JOIN (SELECT * FROM dense WHERE rank <= 5 AND score >= 0.9) d USING (query)")
def p06_dense_floor(spark: SparkSession, d: str) -> DataFrame:
    """Hits over the floor; a query without one says so by nulls."""
    hits = R.top_k(query_set(spark, d), vectors(spark, d), 5, floor=0.9).select("query", "vec_id", F.round("score", 6).alias("score"))
    return query_set(spark, d).select("query").join(hits, "query", "left")


ROUTES = f"""{NEAR}, routes AS (SELECT 'dense' AS route, query, vec_id, rank FROM dense WHERE rank <= 20
 UNION ALL SELECT 'label', q.vec_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY e.vec_id) <= 20)"""


def routes(spark: SparkSession, d: str) -> DataFrame:
    dense = R.top_k(query_set(spark, d), vectors(spark, d), 20).select(F.lit("dense").alias("route"), "query", "vec_id", "rank")
    v = vectors(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    same = first_per_key(v.join(F.broadcast(q), "label").select("query", "vec_id"), ["query"], [F.col("vec_id")], rank="rank", most=20)
    return dense.unionByName(same.select(F.lit("label").alias("route"), "query", "vec_id", "rank"))


@query(f"WITH {ROUTES} SELECT query, vec_id, round(sum(1 / (59.0 + rank)), 8) AS score, count(*) AS routes FROM routes GROUP BY ALL")
def o08_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    f = R.fuse(routes(spark, d), "route", "rank", ["query", "vec_id"])
    return f.select("query", "vec_id", F.round("score", 8).alias("score"), "routes")


@query(f"WITH {ROUTES} SELECT query, vec_id, round(sum(CASE route WHEN 'dense' THEN 1.0 ELSE 0.4 END / (59.0 + rank)), 8) AS score FROM routes GROUP BY ALL")
def o09_weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    f = R.fuse(routes(spark, d), "route", "rank", ["query", "vec_id"], {"dense": 1.0, "label": 0.4})
    return f.select("query", "vec_id", F.round("score", 8).alias("score"))


@query(f"WITH {ROUTES} SELECT DISTINCT query, vec_id FROM routes")
def u07_route_union(spark: SparkSession, d: str) -> DataFrame:
    return routes(spark, d).select("query", "vec_id").distinct()


@query(f"WITH {ROUTES} SELECT query, vec_id, route FROM routes QUALIFY row_number() OVER (PARTITION BY query, vec_id ORDER BY route, rank) = 1")
def u06_pool_union(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of all stages; one found by several counts for the earliest."""
    return first_per_key(routes(spark, d), ["query", "vec_id"], [F.col("route"), F.col("rank")]).select("query", "vec_id", "route")


@query(f"""WITH {NEAR}, r AS (SELECT q.vec_id AS query, e.vec_id FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id % 100 = 0), t AS (SELECT query, count(*) AS total FROM r GROUP BY 1),
f AS (SELECT query, count(*) AS found, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM dense JOIN r USING (query, vec_id) WHERE rank <= 10 GROUP BY 1)
SELECT query, round(coalesce(found / total, 0), 6) AS recall, round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(total, 10) + 1) x(i)), 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr, (found IS NOT NULL)::INT AS hit FROM t LEFT JOIN f USING (query)""")
def o16_case_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    relevant = v.join(F.broadcast(q), "label").select("query", "vec_id")
    m = R.metrics(R.top_k(query_set(spark, d), v, 10), relevant, "query", "vec_id", "rank", 10)
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("recall", "ndcg", "mrr")], "hit")


@query(f"WITH {NEAR} SELECT query, vec_id % 50 AS doc, round(max(score), 6) AS score, arg_max(vec_id, (score, -vec_id)) AS chunk FROM near GROUP BY ALL")
def o07_max_pool(spark: SparkSession, d: str) -> DataFrame:
    """Best chunk of each document; chunks of a document share their id modulo 50."""
    v = vectors(spark, d)
    chunks = v.select("vec_id", "embedding", (F.col("vec_id") % 50).alias("doc"))
    return R.best_chunks(query_set(spark, d), chunks, "doc").select("query", "doc", F.round("score", 6).alias("score"), F.col("vec_id").alias("chunk"))


@query()
def o10_diversified(spark: SparkSession, d: str) -> DataFrame:
    """Eight of the best thirty vectors of each query by marginal relevance."""
    pool = R.top_k(query_set(spark, d), vectors(spark, d), 30).join(vectors(spark, d).select("vec_id", "embedding"), "vec_id")
    return R.diversify(pool, "query", "vec_id", "score", "embedding", 8)


@query(f"""WITH {NEAR}, p AS (SELECT d.query, d.vec_id, d.score, e.embedding::DOUBLE[] AS v FROM dense d JOIN embeddings e USING (vec_id) WHERE rank <= 40),
m AS (SELECT a.query, a.vec_id, max(list_cosine_similarity(a.v, b.v)) AS m FROM p a LEFT JOIN p b ON a.query = b.query AND b.vec_id < a.vec_id GROUP BY ALL),
s AS (SELECT query, vec_id, round(0.7 * score + 0.3 * (1 - coalesce(m, 0)), 6) AS blended FROM p JOIN m USING (query, vec_id))
SELECT query, vec_id, blended FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY blended DESC, vec_id) <= 10""")
def o11_novelty_blend(spark: SparkSession, d: str) -> DataFrame:
    """Score blended with novelty, one less the greatest cosine to an earlier hit of the same list of 40."""
    v = vectors(spark, d).select("vec_id", V.unit(F.col("embedding")).alias("u"))
    pool = R.top_k(query_set(spark, d), vectors(spark, d), 40).join(v, "vec_id")
    earlier = pool.select("query", F.col("vec_id").alias("other"), F.col("u").alias("w"))
    near = pool.join(earlier, "query").where("other < vec_id").groupBy("query", "vec_id").agg(F.max(V.dot(F.col("u"), F.col("w"))).alias("m"))
    pool = pool.join(near, ["query", "vec_id"], "left").withColumn("blended", F.round(0.7 * F.col("score") + 0.3 * (1 - F.coalesce("m", F.lit(0.0))), 6))
    return first_per_key(pool, ["query"], [F.col("blended").desc(), F.col("vec_id")], most=10).select("query", "vec_id", "blended")


@query(f"""WITH {NEAR}, x AS (SELECT unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), c AS (SELECT list(v ORDER BY i) AS c FROM (SELECT i, avg(v::DOUBLE) AS v FROM x GROUP BY 1)),
s AS (SELECT query, d.vec_id, d.score - 0.3 * list_cosine_similarity(e.embedding::DOUBLE[], c.c) AS s FROM dense d JOIN embeddings e USING (vec_id), c WHERE rank <= 50)
SELECT query, vec_id, round(s, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(s, 6) DESC, vec_id) <= 10""")
def o12_centroid_penalty(spark: SparkSession, d: str) -> DataFrame:
    """Score less a share of the likeness to the corpus centroid, over five times the list."""
    v = vectors(spark, d)
    dims = v.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = dims.agg(F.sort_array(F.collect_list(F.struct("i", "m")))["m"].alias("centre"))
    pool = R.top_k(query_set(spark, d), v, 50).join(v.select("vec_id", "embedding"), "vec_id").join(F.broadcast(centre))
    pool = pool.withColumn("score", F.round(F.col("score") - 0.3 * V.cosine(F.col("embedding"), F.col("centre")), 6))
    return first_per_key(pool, ["query"], [F.col("score").desc(), F.col("vec_id")], most=10).select("query", "vec_id", "score")


@query(f"WITH {NEAR} SELECT query, vec_id, label AS cluster FROM dense JOIN embeddings USING (vec_id) WHERE rank <= 30 QUALIFY row_number() OVER (PARTITION BY query, label ORDER BY rank) = 1")
def o14_cluster_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The best hit of each story cluster; the table's label names it."""
    v = vectors(spark, d)
    pool = R.top_k(query_set(spark, d), v, 30).join(v.select("vec_id", F.col("label").alias("cluster")), "vec_id")
    return first_per_key(pool, ["query", "cluster"], [F.col("rank")]).select("query", "vec_id", "cluster")


@query("""WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings), c AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v::DOUBLE) AS v FROM x GROUP BY ALL) GROUP BY 1),
s AS (SELECT vec_id, c.label AS l, round(list_cosine_similarity(embedding::DOUBLE[], c.c), 9) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, l) AS k, max(s) OVER (PARTITION BY vec_id) AS top FROM s)
SELECT vec_id, string_agg(l::VARCHAR, ',' ORDER BY k) AS labels FROM r WHERE k = 1 OR (k <= 3 AND s >= greatest(0.28, top - 0.08)) GROUP BY 1""")
def o22_desk_assignment(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    dims = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centres = dims.groupBy(F.col("label").alias("l")).agg(F.sort_array(F.collect_list(F.struct("i", "m")))["m"].alias("c"))
    return R.anchors_within(v, centres, "vec_id", "embedding", "l", "c").select("vec_id", F.array_join("labels", ",").alias("labels"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id LIMIT 100")
def o01_ordered_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", "n_chars").orderBy("source", "doc_id").limit(100)


@query("""WITH s AS (SELECT event_id, value, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value / 10 END AS z FROM events)
SELECT event_id FROM s ORDER BY abs(coalesce(nullif(z, 0), value, 0)) DESC, event_id LIMIT 20""")
def o04_mixed_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Orders by z where there is one, else by the return: the units mix, on purpose."""
    z = F.when(F.col("event_id") % 3 != 0, F.col("value") / 10)
    return table(spark, d, "events").orderBy(F.abs(F.coalesce(F.nullif(z, F.lit(0.0)), "value", F.lit(0.0))).desc(), "event_id").limit(20).select("event_id")


@query("SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, round(p_retailprice, 6) DESC, p_partkey) <= 3")
def o05_two_key_ranking(spark: SparkSession, d: str) -> DataFrame:
    return first_per_key(table(spark, d, "part"), ["p_brand"], [F.col("p_size").desc(), F.round("p_retailprice", 6).desc(), F.col("p_partkey")], most=3).select("p_brand", "p_partkey")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice, 6) DESC, o_orderkey) <= 3")
def o06_top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    return first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.round("o_totalprice", 6).desc(), F.col("o_orderkey")], most=3).select("o_custkey", "o_orderkey")


@query("SELECT event_id, round(value, 6) AS sigma FROM events WHERE ts::DATE = DATE '2024-01-15' ORDER BY round(value, 6) DESC, event_id LIMIT 50")
def o17_screen_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-15' AND ts < TIMESTAMP_NTZ '2024-01-16'").select("event_id", F.round("value", 6).alias("sigma")).orderBy(F.desc("sigma"), "event_id").limit(50)


@query("SELECT c_custkey, CASE WHEN b >= a AND b >= c THEN CASE WHEN greatest(a, c) / (a + b + c) > 0.34 THEN 'mixed' ELSE 'b' END WHEN a >= c THEN CASE WHEN greatest(b, c) / (a + b + c) > 0.34 THEN 'mixed' ELSE 'a' END ELSE CASE WHEN greatest(a, b) / (a + b + c) > 0.34 THEN 'mixed' ELSE 'c' END END AS channel FROM (SELECT c_custkey, c_custkey % 7 + 1 AS a, c_custkey % 11 + 2 AS b, c_custkey % 5 + 1 AS c FROM customer)")
def o21_dominant_channel(spark: SparkSession, d: str) -> DataFrame:
    """Largest of three shares, or mixed where the runner-up has over a third; b wins ties, then a."""
    parts = F.array(*[F.struct((F.col("c_custkey") % m + k).alias("v"), F.lit(p).alias("p"), F.lit(n).alias("n")) for m, k, p, n in ((7, 1, 1, "a"), (11, 2, 2, "b"), (5, 1, 0, "c"))])
    rows = table(spark, d, "customer").select("c_custkey", F.sort_array(parts, False).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["v"])
    return rows.select("c_custkey", F.when(F.col("s")[1]["v"] / total > 0.34, "mixed").otherwise(F.col("s")[0]["n"]).alias("channel"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 5")
def o25_recent_of_entity(spark: SparkSession, d: str) -> DataFrame:
    return first_per_key(table(spark, d, "documents"), ["source"], [F.col("doc_id").desc()], most=5).select("source", "doc_id")


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'part', p_partkey FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'event', event_id FROM events")
def u01_union_all(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(k).alias("kind"), F.col(c).alias("id")) for t, k, c in (("orders", "order", "o_orderkey"), ("customer", "customer", "c_custkey"), ("part", "part", "p_partkey"), ("supplier", "supplier", "s_suppkey"), ("events", "event", "event_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT * FROM (VALUES ('official', 1), ('exchange', 2), ('aggregator', 3)) t(tier, rank)")
def u02_values(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('official', 1), ('exchange', 2), ('aggregator', 3) AS t(tier, rank)")


@query("SELECT DISTINCT doc_id FROM labels")
def u03_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").distinct()


@query("SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY md5(text)")
def u05_content_dedup(spark: SparkSession, d: str) -> DataFrame:
    """First document of each content; grouped by a digest, so texts are not shuffled."""
    return table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def u08_set_difference(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.where("l_returnflag = 'A'").select("l_partkey").subtract(l.where("l_returnflag = 'N'").select("l_partkey"))


@query("SELECT ts::DATE AS day FROM events WHERE user_id = 1 INTERSECT SELECT ts::DATE FROM events WHERE user_id = 2")
def u09_date_intersection(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where("user_id = 1").select(F.to_date("ts").alias("day")).intersect(e.where("user_id = 2").select(F.to_date("ts")))


@query("SELECT event_type, min(event_id) AS event_id, round(value / 10) AS bucket FROM events GROUP BY event_type, round(value / 10)")
def u10_driver_dedup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type", F.round(F.col("value") / 10).alias("bucket")).agg(F.min("event_id").alias("event_id"))


LINKS = "links AS (SELECT DISTINCT l_suppkey AS a, l_suppkey + 1 + l_partkey % 3 AS b FROM lineitem)"


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def u11_components(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return G.connected(l.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")))


@query("SELECT n_nationkey FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey")
def u13_insert_missing(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_nationkey")


FACTS = "facts AS (SELECT DISTINCT o_orderkey AS fact, l_suppkey AS entity FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"
CO = f"{FACTS}, co AS (SELECT a.entity AS a, b.entity AS b, count(*) AS weight FROM facts a JOIN facts b ON a.fact = b.fact AND a.entity < b.entity GROUP BY ALL)"


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Orders as facts, their suppliers as entities; all later steps of a fact stay in its partition."""
    l = table(spark, d, "lineitem")
    l = dealt(l.select(F.col("l_orderkey").alias("fact"), F.col("l_suppkey").alias("entity")), l.count(), "fact").distinct()
    return l.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("fact")), "fact", "left_semi")


@query(f"WITH {CO} SELECT a, b, weight FROM co")
def j13_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    return G.cooccurrence(facts(spark, d), "fact", "entity")


@query(f"""WITH {CO}, n AS (SELECT entity, count(*) AS n FROM facts GROUP BY 1 QUALIFY row_number() OVER (ORDER BY n DESC, entity) <= 20)
SELECT a, b, weight FROM co WHERE weight >= 2 AND a IN (SELECT entity FROM n) AND b IN (SELECT entity FROM n)""")
def a34_pruned_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of some weight among the most frequent nodes."""
    f = facts(spark, d)
    top = f.groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity").limit(20).select("entity")
    e = G.cooccurrence(f, "fact", "entity").where("weight >= 2")
    return e.join(F.broadcast(top.withColumnRenamed("entity", "a")), "a", "left_semi").join(F.broadcast(top.withColumnRenamed("entity", "b")), "b", "left_semi")


@query(f"WITH {CO} SELECT b AS neighbour, weight FROM co WHERE a = 3 UNION ALL SELECT a, weight FROM co WHERE b = 3")
def g14_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.both_ways(G.cooccurrence(facts(spark, d), "fact", "entity")).where("a = 3").select(F.col("b").alias("neighbour"), "weight")


def _sql_rank(rounds: int) -> str:
    step = "r0 AS (SELECT node, p AS r FROM nodes)"
    for i in range(rounds):
        step += f", s{i} AS (SELECT b AS node, sum(r * weight / d) AS got FROM r{i} JOIN e ON e.a = node JOIN deg USING (a) GROUP BY 1), r{i + 1} AS (SELECT nodes.node, 0.15 * p + 0.85 * coalesce(got, 0) AS r FROM nodes LEFT JOIN s{i} ON s{i}.node = nodes.node)"
    return step


@query(f"""WITH {CO}, e AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co), deg AS (SELECT a, sum(weight) AS d FROM e GROUP BY 1), nodes AS (SELECT DISTINCT a AS node, CASE WHEN a IN (1, 2) THEN 0.5 ELSE 0 END AS p FROM e), {_sql_rank(8)}
SELECT node, round(r, 6) AS rank FROM r8""")
def g09_personalised_rank(spark: SparkSession, d: str) -> DataFrame:
    seeds = spark.sql("SELECT * FROM VALUES (1L, 1.0D), (2L, 1.0D) AS t(node, mass)")
    r = G.page_rank(G.shared(facts(spark, d), "fact", "entity"), seeds, 0.85, 8)
    return r.select("node", F.round("rank", 6).alias("rank"))


CHAIN = "ce AS (SELECT l_suppkey % 40 AS cause, l_partkey % 40 AS subject, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE min(l_returnflag) END AS direction, count(DISTINCT l_linenumber) AS sources FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40 GROUP BY ALL)"


@query(f"""WITH {CHAIN} SELECT cause AS n1, subject AS n2, NULL AS n3, direction AS way, sources AS support FROM ce
UNION ALL SELECT a.cause, a.subject, b.subject, a.direction || '/' || b.direction, a.sources + b.sources FROM ce a JOIN ce b ON b.cause = a.subject WHERE b.subject NOT IN (a.cause, a.subject)""")
def g03_causal_chains(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").where("l_suppkey % 40 <> l_partkey % 40")
    flags = F.collect_set("l_returnflag")
    e = l.groupBy((F.col("l_suppkey") % 40).alias("cause"), (F.col("l_partkey") % 40).alias("subject")).agg(F.when(F.size(flags) > 1, "mixed").otherwise(F.array_min(flags)).alias("direction"), F.countDistinct("l_linenumber").alias("sources"))
    return G.causal_chains(e)


@query(f"""WITH RECURSIVE {LINKS}, e AS (SELECT a, b FROM links UNION SELECT b, a FROM links), p(node, n) AS (SELECT 5::BIGINT, 0 UNION SELECT e.b, n + 1 FROM p JOIN e ON p.node = e.a WHERE n < 3)
SELECT min(n) + 1 AS nodes FROM p WHERE node = 9 HAVING min(n) IS NOT NULL""")
def g13_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    e = l.select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 3).alias("b")).distinct().withColumn("weight", F.lit(1))
    return G.shortest_path(e, 5, 9).select(F.size("path").alias("nodes"))


MINE = """docs AS (SELECT event_id AS doc, ts AS at FROM events), ents AS (SELECT event_id AS doc, user_id AS entity FROM events), causes AS (SELECT event_id AS doc, (user_id + 7) % 150 AS entity FROM events),
idf AS (SELECT entity, ln((SELECT count(*) FROM docs) / count(DISTINCT doc)) AS idf, count(DISTINCT doc) <= ceil(0.007 * (SELECT count(*) FROM docs)) AS rare FROM ents GROUP BY 1)"""


@query(f"""WITH {MINE} SELECT x.doc AS a, c.doc AS b, round(sum(idf), 6) AS weight FROM causes c JOIN ents x USING (entity) JOIN idf USING (entity) JOIN docs dx ON dx.doc = x.doc JOIN docs dc ON dc.doc = c.doc WHERE dx.at < dc.at GROUP BY ALL HAVING bool_or(rare)""")
def j14_pair_mining(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    docs = e.select(F.col("event_id").alias("doc"), F.col("ts").alias("at"))
    ents = e.select(F.col("event_id").alias("doc"), F.col("user_id").alias("entity"))
    causes = e.select(F.col("event_id").alias("doc"), ((F.col("user_id") + 7) % 150).alias("entity"))
    return G.pair_mining(docs, ents, causes, 0.007).select("a", "b", F.round("weight", 6).alias("weight"))


@query("""SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'error' AND b.ts > a.ts AND epoch(b.ts) - epoch(a.ts) <= 172800""")
def j15_continuations(spark: SparkSession, d: str) -> DataFrame:
    """Later stories of the same name within two days, met in two-day buckets."""
    from tidemark.operators.temporal import near_in_time

    e = table(spark, d, "events").where("event_type = 'error'")
    a = e.select("user_id", F.col("event_id").alias("a"), F.col("ts").alias("t"))
    b = e.select("user_id", F.col("event_id").alias("b"), F.col("ts").alias("u"))
    near = near_in_time(a, b, ["user_id"], "t", "u", 172_801)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return near.where((micros("u") > micros("t")) & (micros("u") - micros("t") <= 172_800_000_000)).select("a", "b")


@query("""SELECT a.event_id, count(DISTINCT b.event_id) AS others FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id <> b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 259200000000 WHERE a.event_type IN ('error', 'purchase') GROUP BY 1""")
def j16_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """Others of the same name and sign within three days, by one range frame and no join."""
    e = table(spark, d, "events").where("event_type IN ('error', 'purchase')").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id", "event_type").orderBy("us").rangeBetween(-259_200_000_000, 259_200_000_000)
    return e.select("event_id", (F.count("*").over(w) - 1).alias("others"))


@query("""WITH n AS (SELECT a.vec_id, a.label, max(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS m FROM embeddings a LEFT JOIN embeddings b ON a.label = b.label AND b.vec_id < a.vec_id GROUP BY ALL) SELECT vec_id, round(1 - m, 6) AS novelty FROM n""")
def w27_novelty(spark: SparkSession, d: str) -> DataFrame:
    """One less the greatest cosine to an earlier vector of the same label; null for the first."""
    v = G.saved(vectors(spark, d).select("vec_id", "label", V.unit(F.col("embedding")).alias("u")))
    best = K.within(v, v, 1, "label", earlier=True, query="vec_id", q="u", item="vec_id", x="u").select(F.col("query").alias("vec_id"), F.col("score").alias("m"))
    return v.select("vec_id").join(best, "vec_id", "left").select("vec_id", F.round(1 - F.col("m"), 6).alias("novelty"))
