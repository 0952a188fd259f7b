"""Queries that assemble evidence: fact graphs, walks, merges, gates, leave-out fits, funnels and event portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import graph as G
from tidemark.operators import retrieval as R
from tidemark.operators import series as S
from tidemark.operators import stats as N
from tidemark.operators.temporal import first_per_key, near_in_time
from tidemark.plans.composites import PRIORS, cells, moves, priors
from tidemark.plans.retrieval import CO, FACTS, NEAR, facts, query_set, vectors
from tidemark.plans.windows import BARS, KEY, ORDER, PANEL, Z, panel, returns
from tidemark.registry import query, table


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: len(list_filter(string_split_regex(trim(s), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) >= 8)) AS sentences FROM documents WHERE text IS NOT NULL""")
def p02_prose_sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.prose_sentences(F.col("text")).cast("long").alias("sentences"))


@query(f"WITH {BARS}, {Z} SELECT symbol, event_id, round(z, 6) AS z, round(ret, 6) AS ret FROM z WHERE abs(z) >= 2 OR (z IS NULL AND abs(ret) >= 0.0075)")
def p07_significant_moves(spark: SparkSession, d: str) -> DataFrame:
    """Moves of two deviations; where no deviation is known, of 0.75 percent."""
    m = returns(spark, d).withColumn("z", S.z_score(F.col("ret"), S.ordered(KEY, ORDER)))
    keep = F.when(F.col("z").isNotNull(), F.abs("z") >= 2).otherwise(F.abs("ret") >= 0.0075)
    return m.where(keep).select("symbol", "event_id", F.round("z", 6).alias("z"), F.round("ret", 6).alias("ret"))


@query("""SELECT a.event_id, b.event_id AS nearest, abs(epoch_us(b.ts) - epoch_us(a.ts)) AS gap FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'purchase' AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 129600000000
QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY gap, b.event_id) = 1""")
def w02_nearest_match(spark: SparkSession, d: str) -> DataFrame:
    """The purchase nearest in time to each error of a user, within 36 hours either way."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("nearest"), F.col("ts").alias("at"))
    gap = F.abs(F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")))
    met = near_in_time(a, b, ["user_id"], "ts", "at", 129_600).select("event_id", "nearest", gap.alias("gap"))
    return first_per_key(met, ["event_id"], [F.col("gap"), F.col("nearest")])


@query("SELECT user_id AS symbol, event_id, value AS close FROM events WHERE ts <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w03_latest_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Each symbol's last bar at or before a stated moment."""
    e = table(spark, d, "events").where(F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz"))
    return first_per_key(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select(F.col("user_id").alias("symbol"), "event_id", F.col("value").alias("close"))


@query("""SELECT q.vec_id AS question FROM embeddings q WHERE q.vec_id % 100 = 0 AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.label = q.label AND e.vec_id < q.vec_id AND e.vec_id >= q.vec_id - 200
  AND list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= 0.2)""")
def p24_leak_scan(spark: SparkSession, d: str) -> DataFrame:
    """Questions that no document of the same cause gives away: close in meaning and just before it."""
    v = vectors(spark, d)
    unit = lambda df: df.withColumn("x", F.expr("transform(embedding, e -> double(e))")).withColumn("x", F.expr("transform(x, e -> e / sqrt(aggregate(x, 0d, (s, y) -> s + y * y)))"))
    q = unit(v.where("vec_id % 100 = 0")).select(F.col("vec_id").alias("question"), "label", F.col("x").alias("q"))
    # Documents at most 200 ids earlier lie in the question's bucket of 200 or the one before.
    wanted = q.withColumn("bucket", F.explode(F.array(F.expr("question div 200"), F.expr("question div 200 - 1"))))
    near = unit(v).withColumn("bucket", F.expr("vec_id div 200")).join(wanted, ["label", "bucket"]).where("vec_id < question AND vec_id >= question - 200")
    leaks = near.where(F.expr("aggregate(zip_with(q, x, (a, b) -> a * b), 0d, (s, y) -> s + y) >= 0.2")).select("question")
    return q.select("question").join(leaks, "question", "left_anti")


@query("""WITH cand AS (SELECT o_custkey AS case_id, l_linenumber AS grp, l_suppkey AS doc, max(l_extendedprice) AS score FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY case_id, grp ORDER BY score DESC, doc) AS k FROM cand QUALIFY k <= 3), per AS (SELECT case_id, grp, count(*) AS n, list(doc ORDER BY k) AS docs FROM top GROUP BY ALL),
cases AS (SELECT case_id, list(docs ORDER BY n, grp) AS groups FROM per GROUP BY 1), picked AS (SELECT case_id, groups, list_reduce(groups, lambda taken, docs: CASE WHEN len(list_filter(docs, lambda x: NOT list_contains(taken, x))) > 0
  THEN list_append(taken, list_filter(docs, lambda x: NOT list_contains(taken, x))[1]) ELSE taken END, []::BIGINT[]) AS taken FROM cases)
SELECT case_id, len(groups) AS groups, len(taken) AS met, array_to_string(taken, ',') AS docs FROM picked""")
def o15_distinct_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence groups of a case matched to documents, each used once: the scarcest group first, its best free document."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("grp"), F.col("l_suppkey").alias("doc"), "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("case_id"))
    cand = o.join(l, "o_orderkey").groupBy("case_id", "grp", "doc").agg(F.max("l_extendedprice").alias("score"))
    top = first_per_key(cand, ["case_id", "grp"], [F.col("score").desc(), F.col("doc")], rank="k", most=3)
    per = top.groupBy("case_id", "grp").agg(F.count("*").alias("n"), F.expr("transform(array_sort(collect_list(struct(k, doc))), x -> x.doc)").alias("docs"))
    cases = per.groupBy("case_id").agg(F.expr("transform(array_sort(collect_list(struct(n, grp, docs))), x -> x.docs)").alias("groups"))
    taken = F.expr("aggregate(groups, cast(array() as array<bigint>), (taken, docs) -> concat(taken, slice(filter(docs, x -> not array_contains(taken, x)), 1, 1)))")
    return cases.select("case_id", F.size("groups").cast("long").alias("groups"), taken.alias("taken")).select("case_id", "groups", F.size("taken").cast("long").alias("met"), F.array_join("taken", ",").alias("docs"))


STORIES = """story AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id // 50 = b.vec_id // 50 AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2)"""


@query(f"""WITH RECURSIVE {STORIES}, e AS (SELECT a, b FROM story UNION SELECT b, a FROM story), r(node, seen) AS (SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def u12_story_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Claims alike in meaning that share an entity and a time bucket, connected."""
    v = vectors(spark, d).withColumn("bucket", F.expr("vec_id div 50")).withColumn("x", F.expr("transform(embedding, e -> double(e))"))
    v = v.select("vec_id", "label", "bucket", F.expr("transform(x, e -> e / sqrt(aggregate(x, 0d, (s, y) -> s + y * y)))").alias("x"))
    b = v.select("label", "bucket", F.col("vec_id").alias("b"), F.col("x").alias("y"))
    pairs = v.join(b, ["label", "bucket"]).where("vec_id < b").where(F.expr("aggregate(zip_with(x, y, (p, q) -> p * q), 0d, (s, z) -> s + z) >= 0.2"))
    return G.connected(pairs.select(F.col("vec_id").alias("a"), "b"))


NAMES = """named AS (SELECT lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type ELSE '' END || CASE WHEN p_partkey % 7 = 0 THEN ' ' || p_brand ELSE '' END) AS entity FROM part),
freq AS (SELECT entity, count(*) AS n, list_sort(list_distinct(string_split(entity, ' '))) AS words FROM named GROUP BY 1),
sets AS (SELECT words, sum(n)::BIGINT AS n, arg_max(entity, (n, entity)) AS entity FROM freq GROUP BY 1)"""


@query(f"""WITH RECURSIVE {NAMES}, up AS (SELECT s.entity, p.entity AS parent FROM sets s JOIN sets p ON len(p.words) < len(s.words) AND len(p.words) >= 2 AND list_has_all(s.words, p.words) QUALIFY row_number() OVER (PARTITION BY s.entity ORDER BY p.n DESC, p.entity) = 1),
climb(entity, root) AS (SELECT entity, entity FROM sets UNION ALL SELECT c.entity, up.parent FROM climb c JOIN up ON c.root = up.entity)
SELECT entity, root FROM climb c WHERE NOT EXISTS (SELECT 1 FROM up WHERE up.entity = c.root)""")
def u14_catalyst_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names with equal word sets become one; a set joins its most frequent proper subset of two words or more, up to the root.

    A subset is met by its rarest word only, so a common word makes no crowd of pairs.
    """
    p = table(spark, d, "part")
    name = F.lower(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(""), F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("")))
    freq = p.groupBy(name.alias("entity")).agg(F.count("*").alias("n")).withColumn("words", F.array_sort(F.array_distinct(F.split("entity", " "))))
    sets = G.saved(freq.groupBy("words").agg(F.sum("n").alias("n"), F.max_by("entity", F.struct("n", "entity")).alias("entity")))
    word = sets.select("entity", "words", "n", F.explode("words").alias("word"))
    df = word.groupBy("word").agg(F.count("*").alias("df"))
    rarest = first_per_key(word.where(F.size("words") >= 2).join(df, "word"), ["entity"], [F.col("df"), F.col("word")])
    small = rarest.select("word", F.col("entity").alias("parent"), F.col("words").alias("fewer"), F.col("n").alias("m"))
    held = word.join(small, "word").where((F.size("fewer") < F.size("words")) & (F.size(F.array_except("fewer", "words")) == 0))
    up = G.saved(first_per_key(held, ["entity"], [F.col("m").desc(), F.col("parent")]).select("entity", "parent"))
    longest = sets.agg(F.max(F.size("words"))).first()[0] or 0
    climbed = sets.select("entity", F.col("entity").alias("root"))
    # Each step leads to a smaller set of two words or more.
    for _ in range(max(longest - 2, 0)):
        climbed = climbed.join(up.select(F.col("entity").alias("root"), "parent"), "root", "left").select("entity", F.coalesce("parent", "root").alias("root"))
    return climbed


@query("""WITH names AS (SELECT n_nationkey AS node, lower(n_name) AS name FROM nation), subjects AS (SELECT DISTINCT lower(CASE WHEN c_custkey % 3 = 0 THEN n_name WHEN c_custkey % 3 = 1 THEN 'trade of ' || n_name || ' in ' || c_mktsegment ELSE c_mktsegment || ' goods' END) AS subject FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT subject, coalesce((SELECT min(name) FROM names WHERE name = subject), (SELECT arg_min(name, node) FROM names WHERE contains(subject, name) OR contains(name, subject)), CASE WHEN len(string_split(subject, ' ')) <= 5 THEN subject END) AS node FROM subjects""")
def g04_subject_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A subject's node: the entity of that name, else the first in list order that holds it or is held by it, else itself if short."""
    n = table(spark, d, "nation")
    # The entity list is one array of a stated table of names, not of the facts.
    known = n.agg(F.expr("transform(array_sort(collect_list(struct(n_nationkey, lower(n_name) as name))), x -> x.name)").alias("known"))
    c = table(spark, d, "customer").join(n.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    kind = F.col("c_custkey") % 3
    s = c.select(F.lower(F.when(kind == 0, F.col("n_name")).when(kind == 1, F.concat(F.lit("trade of "), "n_name", F.lit(" in "), "c_mktsegment")).otherwise(F.concat("c_mktsegment", F.lit(" goods")))).alias("subject")).distinct()
    exact = F.when(F.array_contains("known", F.col("subject")), F.col("subject"))
    part = F.get(F.filter("known", lambda e: F.contains(F.col("subject"), e) | F.contains(e, F.col("subject"))), 0)
    short = F.when(F.size(F.split("subject", " ")) <= 5, F.col("subject"))
    return s.join(F.broadcast(known)).select("subject", F.coalesce(exact, part, short).alias("node"))


@query("""WITH names AS (SELECT DISTINCT lower(p_name) AS name FROM part), docs AS (SELECT p_partkey AS doc, lower(p_name || ' and ' || p_type || ' red widget') AS txt FROM part),
hits AS (SELECT doc, name, strpos(' ' || txt || ' ', ' ' || name || ' ') AS at FROM docs JOIN names ON contains(' ' || txt || ' ', ' ' || name || ' '))
SELECT doc, name, rank FROM (SELECT doc, name, row_number() OVER (PARTITION BY doc ORDER BY len(name) DESC, name) AS rank FROM hits) WHERE rank <= 3""")
def g05_cause_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Entities named in a cause text at word boundaries, the longest first, three at most: the text's word spans met with the names."""
    p = table(spark, d, "part")
    names = p.select(F.lower("p_name").alias("name")).distinct()
    words = F.split(F.lower(F.concat("p_name", F.lit(" and "), "p_type", F.lit(" red widget"))), " ")
    spans = F.expr("flatten(transform(sequence(1, size(words)), i -> transform(sequence(1, least(3, size(words) - i + 1)), k -> array_join(slice(words, i, k), ' '))))")
    found = p.select(F.col("p_partkey").alias("doc"), words.alias("words")).select("doc", F.explode(F.array_distinct(spans)).alias("name")).join(names, "name")
    return first_per_key(found, ["doc"], [F.length("name").desc(), F.col("name")], rank="rank", most=3).select("doc", "name", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {FACTS}, f AS (SELECT entity, count(*) AS freq FROM facts GROUP BY 1) SELECT fact, entity, round((1 + fact % 5) / 5.0 / sqrt(freq), 9) AS weight FROM facts JOIN f USING (entity)")
def g06_fact_graph(spark: SparkSession, d: str) -> DataFrame:
    """Membership edges of facts and entities: the fact's confidence over the root of the entity's frequency."""
    f = facts(spark, d)
    freq = f.groupBy("entity").agg(F.count("*").alias("freq"))
    return f.join(freq, "entity").select("fact", "entity", F.round((1 + F.col("fact") % 5) / 5.0 / F.sqrt("freq"), 9).alias("weight"))


KNN = f"""{NEAR}, best AS (SELECT query AS effect, vec_id AS cause, score FROM near WHERE vec_id < query QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) <= 8),
degree AS (SELECT cause, count(*) AS hubs FROM best GROUP BY 1), raw AS (SELECT effect, cause, exp(4 * score) / (1 + ln(hubs)) AS w FROM best JOIN degree USING (cause)), knn AS (SELECT effect, cause, w / sum(w) OVER (PARTITION BY effect) AS share FROM raw)"""


def causal_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """``effect, cause, share``: each effect's eight nearest strictly earlier documents, weighed by a softmax that hubs are penalised in."""
    best = R.top_k(query_set(spark, d), vectors(spark, d), 8, earlier=True).select(F.col("query").alias("effect"), F.col("vec_id").alias("cause"), "score")
    best = G.saved(best)
    hubs = best.groupBy("cause").agg(F.count("*").alias("hubs"))
    raw = best.join(hubs, "cause").withColumn("w", F.exp(4 * F.col("score")) / (1 + F.log("hubs")))
    return raw.select("effect", "cause", (F.col("w") / F.sum("w").over(W.partitionBy("effect"))).alias("share"))


@query(f"WITH {KNN} SELECT effect, cause, round(share, 6) AS share FROM knn")
def g11_causal_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return causal_neighbours(spark, d).select("effect", "cause", F.round("share", 6).alias("share"))


@query(f"""WITH {KNN}, start AS (SELECT effect AS node, 1.0 / count(*) OVER () AS p FROM (SELECT DISTINCT effect FROM knn)), one AS (SELECT cause AS node, sum(share * p) AS p FROM knn JOIN start ON effect = node GROUP BY 1),
two AS (SELECT cause AS node, sum(share * p) AS p FROM knn JOIN one ON effect = node GROUP BY 1)
SELECT node, round(sum(p), 8) AS mass FROM (SELECT node, 0.1 * p AS p FROM start UNION ALL SELECT node, 0.09 * p FROM one UNION ALL SELECT node, 0.081 * p FROM two) GROUP BY 1""")
def g10_causal_mass(spark: SparkSession, d: str) -> DataFrame:
    """Mass that walks two steps from effects to their causes and stops at each with chance 0.1."""
    e = G.saved(causal_neighbours(spark, d))
    effects = e.select(F.col("effect").alias("node")).distinct()
    now = effects.join(F.broadcast(effects.agg(F.count("*").alias("n")))).select("node", (1.0 / F.col("n")).alias("p"))
    total = now.select("node", (0.1 * F.col("p")).alias("p"))
    for step in (1, 2):
        now = e.join(now, F.col("effect") == F.col("node")).groupBy(F.col("cause").alias("node")).agg(F.sum(F.col("share") * F.col("p")).alias("p"))
        total = total.union(now.select("node", (0.1 * 0.9**step * F.col("p")).alias("p")))
    return total.groupBy("node").agg(F.round(F.sum("p"), 8).alias("mass"))


@query(f"""WITH {CO}, e AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co), hop AS (SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS share, row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) AS k FROM e),
near AS (SELECT a, b, share FROM hop WHERE k <= 5), one AS (SELECT b AS node, 0.8 * share AS score, 1 AS depth FROM near WHERE a = 7), two AS (SELECT n.b AS node, 0.8 * n.share * one.score AS score, 2 AS depth FROM one JOIN near n ON n.a = one.node WHERE n.b <> 7)
SELECT node, min(depth)::INTEGER AS depth, round(sum(score), 8) AS score FROM (FROM one UNION ALL FROM two) GROUP BY 1""")
def g18_guided_walk(spark: SparkSession, d: str) -> DataFrame:
    """Two hops from a seed over the five heaviest links of a node, each hop decayed by 0.8."""
    e = G.both_ways(G.cooccurrence(facts(spark, d), "fact", "entity"))
    total = F.sum("weight").over(W.partitionBy("a"))
    near = first_per_key(e.withColumn("share", F.col("weight") / total), ["a"], [F.col("weight").desc(), F.col("b")], most=5).select("a", "b", "share")
    one = near.where("a = 7").select(F.col("b").alias("node"), (0.8 * F.col("share")).alias("score"), F.lit(1).alias("depth"))
    two = one.join(near, F.col("node") == F.col("a")).where("b <> 7").select(F.col("b").alias("node"), (0.8 * F.col("share") * F.col("score")).alias("score"), F.lit(2).alias("depth"))
    return one.union(two).groupBy("node").agg(F.min("depth").alias("depth"), F.round(F.sum("score"), 8).alias("score"))


@query("""WITH f AS (SELECT l_orderkey AS doc, l_linenumber AS line, l_suppkey AS entity, l_returnflag = 'R' AS open, l_extendedprice AS size FROM lineitem), best AS (SELECT entity, max(struct_pack(size := size, doc := -doc, line := -line)) AS top FROM f WHERE NOT open GROUP BY 1)
SELECT f.doc, f.line, CASE WHEN -best.top.doc <> f.doc THEN -best.top.doc END AS cross_doc, (SELECT min(g.line) FROM f g WHERE g.doc = f.doc AND NOT g.open) AS sibling FROM f LEFT JOIN best USING (entity) WHERE open""")
def g20_attached_evidence(spark: SparkSession, d: str) -> DataFrame:
    """A fact without a resolved cause gets the largest resolved fact of its entity from another document, and a sibling of its own."""
    l = table(spark, d, "lineitem")
    f = l.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("entity"), (F.col("l_returnflag") == "R").alias("open"), F.col("l_extendedprice").alias("size"))
    best = f.where("NOT open").groupBy("entity").agg(F.max(F.struct("size", (-F.col("doc")).alias("doc"), (-F.col("line")).alias("line"))).alias("top"))
    own = f.where("NOT open").groupBy("doc").agg(F.min("line").alias("sibling"))
    rows = f.where("open").join(best, "entity", "left").join(own, "doc", "left")
    return rows.select("doc", "line", F.when(-F.col("top.doc") != F.col("doc"), -F.col("top.doc")).alias("cross_doc"), "sibling")


@query(f"WITH {NEAR}, d AS (SELECT query, vec_id AS driver FROM dense WHERE rank <= 3), v AS (SELECT d.query, d.driver, e.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM d JOIN embeddings q ON q.vec_id = d.driver, embeddings e), m AS (SELECT query, vec_id, max(round(score, 9)) AS score FROM v GROUP BY ALL)\n"
       "SELECT query, vec_id, round(score, 6) AS score FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) <= 10")
def v05_cause_walk(spark: SparkSession, d: str) -> DataFrame:
    """Documents by their largest likeness to any of a query's three drivers, the ten best."""
    v = vectors(spark, d)
    drivers = G.saved(R.top_k(query_set(spark, d), v, 3).select("query", F.col("vec_id").alias("driver")))
    asked = drivers.select(F.col("driver").alias("vec_id")).distinct().join(v, "vec_id").select(F.col("vec_id").alias("driver"), F.col("embedding").alias("q"))
    # A document among a query's ten best is among the ten best of the driver it is nearest to.
    near = R.top_k(asked, v, 10, query_id="driver")
    best = drivers.join(near, "driver").groupBy("query", "vec_id").agg(F.max(F.round("score", 9)).alias("score"))
    top = first_per_key(best, ["query"], [F.col("score").desc(), F.col("vec_id")], most=10)
    return top.select("query", "vec_id", F.round("score", 6).alias("score"))


@query("""WITH h AS (SELECT l_orderkey AS hypothesis, count(DISTINCT l_suppkey) AS peers, bool_or(l_suppkey % 10 = 3) AS macro, count(*) FILTER (l_returnflag = 'R') AS down, count(*) FILTER (l_returnflag = 'A') AS up, sum(l_quantity) / 350 AS raw FROM lineitem GROUP BY 1)
SELECT hypothesis, peers, CASE WHEN down > 0 AND up > 0 THEN 'contradicted' WHEN macro THEN 'macro' WHEN peers < 2 THEN 'thin' ELSE 'grounded' END AS verdict,
  round(CASE WHEN down > 0 AND up > 0 THEN least(raw, 0.3) WHEN macro THEN least(raw, 0.5) WHEN peers < 2 THEN least(raw, 0.4) ELSE least(raw, 1) END, 6) AS confidence FROM h""")
def v10_grounding_gate(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of a hypothesis, capped where its evidence disagrees in sign, is macro, or has fewer than two peers."""
    flag = lambda k: F.count_if(F.col("l_returnflag") == k)
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hypothesis")).agg(F.countDistinct("l_suppkey").alias("peers"), F.bool_or(F.col("l_suppkey") % 10 == 3).alias("macro"), flag("R").alias("down"), flag("A").alias("up"), (F.sum("l_quantity") / 350).alias("raw"))
    split, thin = F.expr("down > 0 AND up > 0"), F.col("peers") < 2
    verdict = F.when(split, "contradicted").when(F.col("macro"), "macro").when(thin, "thin").otherwise("grounded")
    cap = F.when(split, 0.3).when(F.col("macro"), 0.5).when(thin, 0.4).otherwise(1.0)
    return h.select("hypothesis", "peers", verdict.alias("verdict"), F.round(F.least("raw", cap), 6).alias("confidence"))


ANISOTROPY = """x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), mean AS (SELECT i, avg(v) AS m FROM x GROUP BY 1), kinds AS (SELECT 'raw' AS kind, vec_id, i, v FROM x UNION ALL SELECT 'centred', vec_id, i, v - m FROM x JOIN mean USING (i)),
norms AS (SELECT kind, vec_id, sqrt(sum(v * v)) AS norm FROM kinds GROUP BY ALL), sums AS (SELECT kind, i, sum(v / norm) AS s FROM kinds JOIN norms USING (kind, vec_id) GROUP BY ALL)"""


@query(f"WITH {ANISOTROPY} SELECT kind, round((sum(s * s) - any_value(n)) / (any_value(n) * (any_value(n) - 1.0)), 6) AS anisotropy FROM sums, (SELECT count(*) AS n FROM embeddings) GROUP BY 1")
def v16_anisotropy(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine of all pairs, before and after the mean is taken off: from the sum of unit vectors, without pairs."""
    x = vectors(spark, d).select(F.expr("transform(embedding, e -> double(e))").alias("x"))
    mean = x.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).agg(F.expr("transform(array_sort(collect_list(struct(i, m))), e -> e.m)").alias("m"))
    both = x.join(F.broadcast(mean)).select(F.explode(F.create_map(F.lit("raw"), F.col("x"), F.lit("centred"), F.zip_with("x", "m", lambda a, b: a - b))).alias("kind", "x"))
    unit = both.select("kind", F.expr("transform(x, e -> e / sqrt(aggregate(x, 0d, (s, y) -> s + y * y)))").alias("x"))
    sums = unit.select("kind", F.posexplode("x").alias("i", "v")).groupBy("kind", "i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    return sums.groupBy("kind").agg(F.round((F.sum(F.col("s") * F.col("s")) - F.first("n")) / (F.first("n") * (F.first("n") - 1.0)), 6).alias("anisotropy"))


LEFT_OUT = """r AS (SELECT symbol, day, ret, avg(ret) OVER (PARTITION BY day) AS x, avg(ret) OVER (PARTITION BY day, sector) AS y, day_of_month // 7 AS fold FROM (SELECT *, day(day) AS day_of_month FROM panel)),
part AS (SELECT symbol, fold, count(*) AS n, sum(x) AS x, sum(y) AS y, sum(ret) AS r, sum(x*x) AS xx, sum(y*y) AS yy, sum(x*y) AS xy, sum(x*ret) AS xr, sum(y*ret) AS yr FROM r GROUP BY ALL),
rest AS (SELECT p.symbol, p.fold, sum(q.n) AS n, sum(q.x) AS x, sum(q.y) AS y, sum(q.r) AS r, sum(q.xx) AS xx, sum(q.yy) AS yy, sum(q.xy) AS xy, sum(q.xr) AS xr, sum(q.yr) AS yr FROM part p JOIN part q ON q.symbol = p.symbol AND q.fold <> p.fold GROUP BY ALL),
c AS (SELECT symbol, fold, n, xx - x*x/n AS a, yy - y*y/n AS b, xy - x*y/n AS m, xr - x*r/n AS u, yr - y*r/n AS v FROM rest)"""


@query(f"WITH {PANEL}, {LEFT_OUT} SELECT symbol, fold, n::BIGINT AS n, round((u * b - v * m) / (a * b - m * m), 4) AS market, round((v * a - u * m) / (a * b - m * m), 4) AS sector FROM c WHERE n >= 10 AND a * b - m * m > 0.05 * a * b")
def m24_leave_one_out_fit(spark: SparkSession, d: str) -> DataFrame:
    """Market and sector loadings of a firm without one week at a time: two-regressor least squares from sums, total less the week's own."""
    p = panel(spark, d)
    r = p.select("symbol", "ret", F.avg("ret").over(W.partitionBy("day")).alias("x"), F.avg("ret").over(W.partitionBy("day", "sector")).alias("y"), F.expr("day(day) div 7").alias("fold"))
    terms = {"n": "1", "x": "x", "y": "y", "r": "ret", "xx": "x * x", "yy": "y * y", "xy": "x * y", "xr": "x * ret", "yr": "y * ret"}
    part = r.groupBy("symbol", "fold").agg(*[F.sum(F.expr(e)).alias(k) for k, e in terms.items()])
    others = W.partitionBy("symbol")
    rest = part.select("symbol", "fold", *[(F.sum(k).over(others) - F.col(k)).alias(k) for k in terms]).where("n >= 10")
    c = rest.selectExpr("symbol", "fold", "n", "xx - x * x / n AS a", "yy - y * y / n AS b", "xy - x * y / n AS m", "xr - x * r / n AS u", "yr - y * r / n AS v").where("a * b - m * m > 0.05 * a * b")
    return c.selectExpr("symbol", "fold", "n", "round((u * b - v * m) / (a * b - m * m), 4) AS market", "round((v * a - u * m) / (a * b - m * m), 4) AS sector")


@query(f"""WITH {PRIORS}, top AS (SELECT symbol, day, max(prior) AS prior FROM cells JOIN priors USING (class, day) GROUP BY ALL)
SELECT symbol, day, round(abs(idio) - prior, 6) AS surprise FROM parts JOIN top USING (symbol, day) WHERE prior IS NOT NULL QUALIFY row_number() OVER (ORDER BY round(abs(idio) - prior, 6) DESC, symbol, day) <= 50""")
def x05_news_surprise(spark: SparkSession, d: str) -> DataFrame:
    """The fifty days whose own move most exceeds what any class of their news had meant so far."""
    top = cells(spark, d).join(priors(spark, d), ["class", "day"]).groupBy("symbol", "day").agg(F.max("prior").alias("prior")).where("prior IS NOT NULL")
    m = moves(spark, d).join(top, ["symbol", "day"]).select("symbol", "day", F.round(F.abs("idio") - F.col("prior"), 6).alias("surprise"))
    return m.orderBy(F.desc("surprise"), "symbol", "day").limit(50)


PERSIST = f"""{PANEL}, met AS (SELECT p.symbol AS a, q.symbol AS b, p.day, p.ret AS x, q.ret AS y FROM panel p JOIN panel q ON p.day = q.day AND q.symbol IN (p.symbol + 1, p.symbol + 5))"""


@query(f"""WITH {PERSIST}, c AS (SELECT a, b, round(corr(x, y) FILTER (day < DATE '2024-01-16'), 6) AS early_corr, round(corr(x, y) FILTER (day >= DATE '2024-01-16'), 6) AS late_corr, count(*) AS n FROM met GROUP BY ALL)
SELECT a, b, n, early_corr, late_corr, CASE WHEN early_corr >= 0.3 THEN 'high' WHEN early_corr >= 0 THEN 'low' ELSE 'against' END AS tier FROM c WHERE n >= 10""")
def x09_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of linked pairs before a day and after it, and the tier the first puts them in."""
    p = panel(spark, d).select("symbol", "day", "ret")
    a = p.select(F.col("symbol").alias("a"), "day", F.col("ret").alias("x"), F.explode(F.array(F.col("symbol") + 1, F.col("symbol") + 5)).alias("b"))
    both = a.join(p.select(F.col("symbol").alias("b"), "day", F.col("ret").alias("y")), ["b", "day"])
    early = F.col("day") < F.lit("2024-01-16").cast("date")
    corr = lambda when: F.round(S.corr(F.when(when, F.col("x")), F.when(when, F.col("y"))), 6)
    c = both.groupBy("a", "b").agg(F.count("*").alias("n"), corr(early).alias("early_corr"), corr(~early).alias("late_corr")).where("n >= 10")
    return c.select("a", "b", "n", "early_corr", "late_corr", F.when(F.col("early_corr") >= 0.3, "high").when(F.col("early_corr") >= 0, "low").otherwise("against").alias("tier"))


@query("""WITH f AS (SELECT *, doc_id IS NOT NULL AS read, coalesce(length(text) >= 200, false) AS chunked, coalesce(regexp_matches(text, '[0-9]'), false) AS mention FROM documents), s AS (SELECT f.*, l.doc_id IS NOT NULL AS resolved, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 0, false) AS clean FROM f LEFT JOIN labels l USING (doc_id)),
t AS (SELECT count(*) AS n0, count(*) FILTER (chunked) AS n1, count(*) FILTER (chunked AND mention) AS n2, count(*) FILTER (chunked AND mention AND resolved) AS n3, count(*) FILTER (chunked AND mention AND resolved AND good) AS n4, count(*) FILTER (chunked AND mention AND resolved AND good AND clean) AS n5 FROM s)
SELECT unnest(['read', 'chunk', 'mention', 'resolve', 'classify', 'emit']) AS stage, unnest([n0, n1, n2, n3, n4, n5]) AS n FROM t""")
def x12_stage_funnel(spark: SparkSession, d: str) -> DataFrame:
    """How many documents each stage of the extraction passes on, counted in one pass."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels").withColumn("resolved", F.lit(True))
    s = docs.select("doc_id", F.coalesce(F.length("text") >= 200, F.lit(False)).alias("chunk"), F.coalesce(F.col("text").rlike("[0-9]"), F.lit(False)).alias("mention")).join(labels, "doc_id", "left")
    stages = {"chunk": F.col("chunk"), "mention": F.col("mention"), "resolve": F.coalesce("resolved", F.lit(False)), "classify": F.coalesce(F.col("quality") == 1, F.lit(False)), "emit": F.coalesce(F.col("toxic") == 0, F.lit(False))}
    counts, passed = [F.count("*").alias("read")], F.lit(True)
    for name, test in stages.items():
        passed = passed & test
        counts.append(F.count_if(passed).alias(name))
    return s.agg(*counts).unpivot([], ["read", *stages], "stage", "n")


@query("""WITH e AS (SELECT user_id AS series, event_type AS event, event_id, ((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::DATE AS local FROM events)
SELECT series, event, event_id, lag(local) OVER w AS was, local AS now FROM e WINDOW w AS (PARTITION BY series, event ORDER BY event_id) QUALIFY lag(local) OVER w <> local""")
def x15_calendar_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Observations whose local date differs from the one before; a change of the hour alone is none."""
    local = F.to_date(F.from_utc_timestamp("ts", "America/New_York"))
    e = table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_type").alias("event"), "event_id", local.alias("now"))
    return e.withColumn("was", F.lag("now").over(W.partitionBy("series", "event").orderBy("event_id"))).where("was <> now").select("series", "event", "event_id", "was", "now")


MARKS = """marks AS (SELECT user_id AS market, ts::DATE AS day, least(value, 99) / 100 AS p, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS k FROM events), days AS (SELECT market, day, p FROM marks WHERE k = 1),
entry AS (SELECT market, min(day) + 5 AS day FROM days GROUP BY 1), opened AS (SELECT e.market, e.day, d.p FROM entry e ASOF JOIN days d ON e.market = d.market AND e.day >= d.day WHERE d.p > 0.02 AND d.p < 0.98),
held AS (SELECT o.market, o.day AS opened, o.p AS paid, g.day FROM opened o, LATERAL (SELECT unnest(generate_series(o.day, o.day + 10, INTERVAL 1 DAY))::DATE AS day) g), filled AS (SELECT h.market, h.opened, h.paid, h.day, d.p FROM held h ASOF JOIN days d ON h.market = d.market AND h.day >= d.day),
pnl AS (SELECT market, day, ((lag(p) OVER w - p) - CASE WHEN day = opened + 1 THEN 0.01 ELSE 0 END) / (1 - paid) AS ret FROM filled WINDOW w AS (PARTITION BY market ORDER BY day))"""


@query(f"WITH {MARKS} SELECT day, count(*) AS markets, round(avg(ret), 6) AS ret FROM pnl WHERE ret IS NOT NULL GROUP BY 1")
def x17_fade_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """Daily return of fading each market five days after it opens: marks carried forward, on collateral, cost paid once, equal weights."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    days = first_per_key(e, ["user_id", "day"], [F.col("ts").desc(), F.col("event_id").desc()]).select(F.col("user_id").alias("market"), "day", (F.least("value", F.lit(99.0)) / 100).alias("p"))
    entry = days.groupBy("market").agg(F.date_add(F.min("day"), 5).alias("opened"))
    grid = entry.select("market", "opened", F.explode(F.expr("sequence(opened, date_add(opened, 10))")).alias("day")).join(days, ["market", "day"], "full")
    w = W.partitionBy("market").orderBy("day")
    grid = grid.withColumn("p", F.last("p", ignorenulls=True).over(w)).where("opened IS NOT NULL")
    paid = F.first("p").over(w)
    filled = grid.withColumn("paid", paid).where("paid > 0.02 AND paid < 0.98")
    cost = F.when(F.col("day") == F.date_add("opened", 1), 0.01).otherwise(0.0)
    pnl = filled.select("day", ((F.lag("p").over(w) - F.col("p") - cost) / (1 - F.col("paid"))).alias("ret")).where("ret IS NOT NULL")
    return pnl.groupBy("day").agg(F.count("*").alias("markets"), F.round(F.avg("ret"), 6).alias("ret"))


@query("""WITH x AS (SELECT vec_id, label % 2 AS y, vec_id % 10 < 3 AS test, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), axis AS (SELECT i, avg(v) FILTER (y = 1) - avg(v) FILTER (y = 0) AS w FROM x WHERE NOT test GROUP BY 1),
s AS (SELECT vec_id, any_value(y) AS y, round(sum(v * w), 9) AS s FROM x JOIN axis USING (i) WHERE test GROUP BY 1)
SELECT round(avg(CASE WHEN p.s > n.s THEN 1 WHEN p.s = n.s THEN 0.5 ELSE 0 END), 8) AS auc, (SELECT count(*) FROM s) AS n FROM s p, s n WHERE p.y = 1 AND n.y = 0""")
def m07_mean_axis(spark: SparkSession, d: str) -> DataFrame:
    """How well the difference of two classes' means, from the training rows, ranks the held-out ones."""
    v = vectors(spark, d).select("vec_id", (F.col("label") % 2).alias("y"), (F.col("vec_id") % 10 < 3).alias("test"), F.expr("transform(embedding, e -> double(e))").alias("x"))
    mean = lambda k: F.avg(F.when(F.col("y") == k, F.col("v")))
    parts = v.where("NOT test").select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg((mean(1) - mean(0)).alias("w"))
    axis = parts.agg(F.expr("transform(array_sort(collect_list(struct(i, w))), e -> e.w)").alias("w"))
    s = v.where("test").join(F.broadcast(axis)).select("y", F.expr("round(aggregate(zip_with(x, w, (a, b) -> a * b), 0d, (t, z) -> t + z), 9)").alias("s"))
    return N.auc(s, "y", "s").select(F.round("auc", 8).alias("auc"), F.col("n"))


@query(f"""WITH {NEAR}, others AS (SELECT query, vec_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, vec_id) AS rank FROM near WHERE vec_id <> query), votes AS (SELECT query, label, count(*) AS n FROM others JOIN embeddings USING (vec_id) WHERE rank <= 15 GROUP BY ALL)
SELECT query, label, n, label = (SELECT label FROM embeddings WHERE vec_id = query) AS hit FROM votes QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1""")
def m08_neighbour_vote(spark: SparkSession, d: str) -> DataFrame:
    """The class that most of a query's fifteen nearest other vectors have, and whether it is the query's own."""
    v = vectors(spark, d)
    near = R.top_k(query_set(spark, d), v, 16).where("vec_id <> query")
    near = first_per_key(near, ["query"], [F.round("score", 9).desc(), F.col("vec_id")], most=15).select("query", "vec_id")
    votes = near.join(v.select("vec_id", "label"), "vec_id").groupBy("query", "label").agg(F.count("*").alias("n"))
    own = v.select(F.col("vec_id").alias("query"), F.col("label").alias("own"))
    return first_per_key(votes, ["query"], [F.col("n").desc(), F.col("label")]).join(own, "query").select("query", "label", "n", (F.col("label") == F.col("own")).alias("hit"))


@query("""SELECT symbol, event_id, close FROM (SELECT user_id AS symbol, event_id, ts, value AS close FROM events WHERE event_type IN ('view', 'click') AND ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-25') QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) <= 2""")
def s03_price_scan(spark: SparkSession, d: str) -> DataFrame:
    """The last two bars a symbol of listed kinds between two dates: list and bounds are pushed to the scan."""
    moment = lambda s: F.lit(s).cast("timestamp_ntz")
    e = table(spark, d, "events").where(F.col("event_type").isin("view", "click") & (F.col("ts") >= moment("2024-01-10")) & (F.col("ts") < moment("2024-01-25")))
    return first_per_key(e.select(F.col("user_id").alias("symbol"), "event_id", "ts", F.col("value").alias("close")), ["symbol"], [F.col("ts").desc(), F.col("event_id").desc()], most=2).select("symbol", "event_id", "close")


@query("""WITH o AS (SELECT user_id AS series, event_type AS event, value, ts AS observed, ts + INTERVAL 2 HOUR AS knowable, ts + to_hours((event_id % 72)::INTEGER) AS ingested, event_id FROM events)
SELECT series, event, value, event_id FROM o WHERE knowable <= TIMESTAMP '2024-01-20' AND ingested <= TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY series, event ORDER BY observed DESC, ingested DESC, event_id DESC) = 1""")
def r07_bitemporal_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The newest observation of a series that could be known, and was in the store, at a moment."""
    o = table(spark, d, "events").selectExpr("user_id AS series", "event_type AS event", "value", "ts AS observed", "ts + INTERVAL 2 HOURS AS knowable", "ts + make_dt_interval(0, cast(event_id % 72 AS int)) AS ingested", "event_id")
    seen = o.where("knowable <= TIMESTAMP_NTZ '2024-01-20' AND ingested <= TIMESTAMP_NTZ '2024-01-20'")
    return first_per_key(seen, ["series", "event"], [F.col(c).desc() for c in ("observed", "ingested", "event_id")]).select("series", "event", "value", "event_id")


@query("""WITH f AS (SELECT p_partkey AS fact, split_part(p_name, ' ', 2) AS subject, CASE WHEN p_size % 4 > 0 THEN lower(p_type || ' ' || p_name || ' ' || p_brand) END AS cause FROM part)
SELECT fact, CASE WHEN subject = 'widget' THEN 'driver' ELSE 'effect' END AS role FROM f WHERE (subject = 'widget' AND cause IS NOT NULL) OR (subject <> 'widget' AND contains(cause, 'brand#1'))""")
def g15_node_drivers(spark: SparkSession, d: str) -> DataFrame:
    """What drives a node (its own facts that have a cause) and what it drives (others' facts whose cause names it)."""
    cause = F.when(F.col("p_size") % 4 > 0, F.lower(F.concat_ws(" ", "p_type", "p_name", "p_brand")))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("fact"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("subject"), cause.alias("cause"))
    own = F.col("subject") == "widget"
    return f.where((own & F.col("cause").isNotNull()) | (~own & F.contains("cause", F.lit("brand#1")))).select("fact", F.when(own, "driver").otherwise("effect").alias("role"))


@query(f"""WITH {NEAR}, t AS (SELECT query, rank, score, label FROM dense JOIN embeddings USING (vec_id) WHERE rank BETWEEN 2 AND 6), s AS (SELECT query, round(max(score), 6) AS s, count(DISTINCT label) > 1 AS mixed FROM t GROUP BY 1)
SELECT query, s AS score, mixed, CASE WHEN s < 0.4 THEN 'abstain' WHEN s >= 0.55 AND NOT mixed THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def v11_attributed(spark: SparkSession, d: str) -> DataFrame:
    """A query's confidence from its best evidence: none when that is far, never high when its five nearest disagree in class."""
    near = R.top_k(query_set(spark, d), vectors(spark, d), 6).where("rank >= 2")
    s = near.join(vectors(spark, d).select("vec_id", "label"), "vec_id").groupBy("query").agg(F.round(F.max("score"), 6).alias("score"), (F.countDistinct("label") > 1).alias("mixed"))
    return s.select("query", "score", "mixed", F.expr("CASE WHEN score < 0.4 THEN 'abstain' WHEN score >= 0.55 AND NOT mixed THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END").alias("confidence"))


@query("""WITH p AS (SELECT a.p_partkey, lower(a.p_name) AS name, lower(b.p_type || ' ' || b.p_name) AS body FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, (length(name) >= 3 AND contains(body, name)) OR len(list_filter(string_split(name, ' '), lambda t: length(t) >= 4 AND contains(body, t))) > 0 AS seen FROM p""")
def p12_entity_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether each row's entity is in its source text: the full name, or a word of it of four letters or more."""
    p = table(spark, d, "part")
    body = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.lower(F.concat_ws(" ", "p_type", "p_name")).alias("body"))
    rows = p.select("p_partkey", F.lower("p_name").alias("name")).join(body, "p_partkey")
    word = F.exists(F.split("name", " "), lambda t: (F.length(t) >= 4) & F.contains(F.col("body"), t))
    return rows.select("p_partkey", (((F.length("name") >= 3) & F.contains("body", F.col("name"))) | word).alias("seen"))
