"""Queries of evidence gates, entity matching, links and lookups."""

from __future__ import annotations

from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vector as V
from tidemark.operators import blocks as B
from tidemark.operators import drivers as D
from tidemark.operators import graph as G
from tidemark.operators import neighbours as K
from tidemark.operators import retrieval as R
from tidemark.operators import series as S
from tidemark.operators.order import WIDE, dealt, rank_all
from tidemark.operators.temporal import first_per_key
from tidemark.plans.retrieval import CO, facts
from tidemark.plans.windows import BARS, PANEL, Z, panel, returns
from tidemark.registry import query, table


@query(f"""WITH {BARS}, {Z}, l AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) = 1)
SELECT symbol, (abs(z) >= 1.5 OR abs(ret) >= 0.015) AND date_diff('day', ts::DATE, DATE '2024-01-31') <= 4 AS mover FROM l WHERE ret IS NOT NULL""")
def p08_brief_mover(spark: SparkSession, d: str) -> DataFrame:
    """Significant by z or by size alone, and not stale."""
    rows = returns(spark, d).withColumn("z", S.z_score(F.col("ret"), S.ordered(["symbol"], ["ts", "event_id"])))
    last = first_per_key(rows, ["symbol"], [F.col("ts").desc(), F.col("event_id").desc()]).where("ret IS NOT NULL")
    fresh = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts")) <= 4
    return last.select("symbol", ((F.coalesce(F.abs("z") >= 1.5, F.lit(False)) | (F.abs("ret") >= 0.015)) & fresh).alias("mover"))


@query("""SELECT item_id, contains(lower(text), 'reer') OR len(list_filter(['thation', 'reer', 'of'], lambda t: length(t) >= 4 AND contains(lower(text), t))) > 0 AS seen FROM benchmark""")
def p12_entity_seen(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    name = F.array(*[F.lit(x) for x in ("thation", "reer", "of")])
    seen = F.contains(low, F.lit("reer")) | F.exists(name, lambda t: (F.length(t) >= 4) & F.contains(low, t))
    return table(spark, d, "benchmark").select("item_id", seen.alias("seen"))


@query("""WITH e AS (SELECT l_orderkey AS doc, l_suppkey % 20 AS a, l_partkey % 20 AS b FROM lineitem), m AS (SELECT l_orderkey AS doc, list(DISTINCT l_linenumber) AS named FROM lineitem GROUP BY 1)
SELECT a, b, bool_or(NOT list_has_any(named, [a::INT, b::INT])) AS clean FROM e JOIN m USING (doc) GROUP BY ALL""")
def p21_clean_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge is clean if some document of it names neither end."""
    l = table(spark, d, "lineitem")
    e = l.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 20).cast("int").alias("a"), (F.col("l_partkey") % 20).cast("int").alias("b")).distinct()
    m = l.groupBy(F.col("l_orderkey").alias("doc")).agg(F.collect_set("l_linenumber").alias("named"))
    clean = ~F.arrays_overlap("named", F.array("a", "b"))
    return e.join(m, "doc").groupBy("a", "b").agg(F.bool_or(clean).alias("clean")).select(F.col("a").cast("long"), F.col("b").cast("long"), "clean")


@query("WITH n AS (SELECT l_orderkey, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) SELECT l_orderkey FROM n WHERE k <= 3")
def p22_without_roundups(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    return l.groupBy("l_orderkey").agg(F.countDistinct("l_suppkey").alias("k")).where("k <= 3").select("l_orderkey")


@query(r"""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]{0,40})', 1) AS title FROM pages""")
def t10_page_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]{0,40})", 1).alias("title"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN o_orderdate::DATE - 1 WHEN 2 THEN DATE '2024-03-31' WHEN 3 THEN o_orderdate::DATE END AS day FROM orders""")
def t15_relative_time(spark: SparkSession, d: str) -> DataFrame:
    """Words for a time against the publishing date; a written date is parsed, others are null."""
    k, pub = F.col("o_orderkey") % 5, F.to_date("o_orderdate")
    said = F.when(k == 0, "Today").when(k == 1, "yesterday").when(k == 2, "31 Mar 2024").when(k == 3, "this quarter").otherwise("soon")
    low = F.lower(said)
    day = F.when(low.rlike("today|now"), pub).when(low.rlike("yesterday"), F.date_sub(pub, 1)).when(low.rlike("monday|tuesday|wednesday|thursday|friday|quarter|half"), pub).otherwise(T.day_month_year(said))
    return table(spark, d, "orders").select("o_orderkey", day.alias("day"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(lower(p_type), 'copper') THEN 'metal_price' WHEN regexp_matches(lower(p_type), 'tin') THEN 'tin_price' WHEN p_size > 40 THEN 'earnings_' || lower(p_brand) ELSE 'unmapped' END AS series FROM part""")
def t29_series_rules(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(low.rlike("copper"), "metal_price").when(low.rlike("tin"), "tin_price").when(F.col("p_size") > 40, F.concat(F.lit("earnings_"), F.lower("p_brand"))).otherwise("unmapped").alias("series"))


NAMES = ("thation", "reer", "the")
#: Nodes of a block of bridges.
BRIDGED = 3000


@query(r"""WITH n AS (SELECT unnest(['thation', 'reer', 'the']) AS name) SELECT name, count(*) AS docs, min(doc_id) AS first_doc FROM n JOIN documents ON regexp_matches(lower(text), '\b' || name || '\b') GROUP BY 1""")
def j17_dictionary_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Documents that name each entry; one pass with one alternation instead of a join by pattern."""
    found = F.array_distinct(F.regexp_extract_all(T.plain_lower(F.col("text")), F.lit(rf"(?<![0-9A-Za-z_])({'|'.join(NAMES)})(?![0-9A-Za-z_])"), F.lit(1)))
    rows = table(spark, d, "documents").select("doc_id", F.explode(found).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("""WITH m AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT m.vec_id AS market, e.vec_id AS news, m.label = e.label AS shared, list_cosine_similarity(m.embedding::DOUBLE[], e.embedding::DOUBLE[]) + CASE WHEN m.label = e.label THEN 0.25 ELSE 0 END AS score FROM m, embeddings e WHERE m.vec_id <> e.vec_id)
SELECT market, news, round(score, 6) AS score FROM s WHERE shared OR score >= 0.3 QUALIFY row_number() OVER (PARTITION BY market ORDER BY round(score, 9) DESC, news) <= 5""")
def j20_market_news_links(spark: SparkSession, d: str) -> DataFrame:
    """Likeness with a bonus for a shared symbol; the markets are the stated query set.

    News without the symbol that is among a market's five is among the five most alike of all news, as
    whatever is more alike stands before it with or without the bonus.
    """
    v = G.saved(table(spark, d, "embeddings").select("vec_id", "label", V.unit(F.col("embedding")).alias("u")))
    m = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("market"), F.col("u").alias("q"), F.col("label").alias("symbol"))
    alike = R.top_k(m, v, 6, query_id="market", vec="u").select("market", F.col("vec_id").alias("news"), "score")
    alike = alike.join(v.select(F.col("vec_id").alias("news"), "label"), "news").join(m.select("market", "symbol"), "market").where("label <> symbol").select("market", "news", "score")
    shared = K.within(m.withColumnRenamed("symbol", "label"), v, 6, "label", query="market", q="q", item="vec_id", x="u")
    shared = shared.select(F.col("query").alias("market"), F.col("item").alias("news"), (F.col("score") + 0.25).alias("score"))
    s = shared.union(alike.where("score >= 0.3")).where("market <> news")
    return first_per_key(s, ["market"], [F.round("score", 9).desc(), F.col("news")], most=5).select("market", "news", F.round("score", 6).alias("score"))


@query("SELECT event_type, event_id, round(value * (1 + (event_id % 10) / 10.0), 4) AS score FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY round(value * (1 + (event_id % 10) / 10.0), 4) DESC, event_id) <= 5")
def o20_attention_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "events").select("event_type", "event_id", F.round(F.col("value") * (1 + (F.col("event_id") % 10) / 10), 4).alias("score"))
    return first_per_key(s, ["event_type"], [F.col("score").desc(), F.col("event_id")], most=5)


@query("""WITH c AS (SELECT l_suppkey % 15 AS a, l_partkey % 15 AS b, count(DISTINCT l_orderkey) AS support, min(l_orderkey) AS first FROM lineitem GROUP BY ALL) SELECT a, b, support FROM c ORDER BY support DESC, a, b LIMIT 8""")
def o24_capped_chains(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 15).alias("a"), (F.col("l_partkey") % 15).alias("b")).agg(F.countDistinct("l_orderkey").alias("support"))
    return l.orderBy(F.desc("support"), "a", "b").limit(8)


@query("SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def u04_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query(f"WITH {CO} SELECT x.entity, count(DISTINCT f.fact) AS facts FROM facts f JOIN facts x ON f.fact = x.fact AND f.entity = 4 AND x.entity <> 4 GROUP BY 1")
def g01_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Entities that share facts with a seed."""
    f = facts(spark, d)
    seed = f.where("entity = 4").select("fact")
    return f.where("entity <> 4").join(seed, "fact", "left_semi").groupBy("entity").agg(F.count("*").alias("facts"))


@query(f"WITH {CO}, s AS (SELECT DISTINCT entity FROM facts WHERE fact IN (SELECT fact FROM facts WHERE entity = 4)), o AS (SELECT fact, count(*) AS shared FROM facts WHERE entity IN (SELECT entity FROM s) AND fact NOT IN (SELECT fact FROM facts WHERE entity = 4) GROUP BY 1) SELECT fact, shared FROM o WHERE shared >= 2")
def g02_expansion(spark: SparkSession, d: str) -> DataFrame:
    """Facts outside the seeds that share at least two of their entities."""
    f = facts(spark, d)
    seeds = f.where("entity = 4").select("fact")
    ents = f.join(seeds, "fact", "left_semi").select("entity").distinct()
    rest = f.join(ents, "entity", "left_semi").join(seeds, "fact", "left_anti")
    return rest.groupBy("fact").agg(F.count("*").alias("shared")).where("shared >= 2")


@query("SELECT item_id, contains(lower(text), 'the') AS driver FROM benchmark WHERE contains(lower(text), 'en') OR contains(lower(text), 'the')")
def g15_drivers_of_node(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "benchmark").where(F.contains(low, F.lit("en")) | F.contains(low, F.lit("the"))).select("item_id", F.contains(low, F.lit("the")).alias("driver"))


@query("""SELECT q, arg_min(p_name, (length(p_name), p_name)) AS entity FROM (SELECT unnest(['part 1', 'part 7', 'zzz']) AS q) JOIN part ON list_bool_and(list_transform(string_split(q, ' '), lambda t: contains(lower(p_name), t))) GROUP BY 1""")
def g16_entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Shortest name that holds all tokens of a query; the queries are a fixed few."""
    q = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("part 1", "part 7", "zzz")])).alias("q"))
    rows = table(spark, d, "part").select("p_name").join(F.broadcast(q), F.forall(F.split("q", " "), lambda t: F.contains(F.lower("p_name"), t)))
    return rows.groupBy("q").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("entity"))


@query(f"WITH {CO}, e AS (SELECT a, b FROM co UNION ALL SELECT b, a FROM co), g AS (SELECT a, count(*) AS n FROM e GROUP BY 1), k AS (SELECT a FROM g WHERE n <= (SELECT quantile_cont(n, 0.98) FROM g)) SELECT x.b AS a, y.b AS b, count(*) AS bridges FROM e x JOIN e y ON x.a = y.a AND x.b < y.b WHERE x.a IN (SELECT a FROM k) GROUP BY ALL")
def g21_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Common neighbours of two nodes; hubs, the upper 2 % by degree, are left out."""
    met = G.shared(facts(spark, d), "fact", "entity").select("a", F.col("b").alias("node"))
    all_nodes = G.saved(met.repartition("node").distinct().groupBy("node").agg(F.sort_array(F.collect_list("a")).alias("near")))
    n = F.size("near")
    most = all_nodes.agg(F.percentile(n, 0.98).alias("most"))
    hubs = all_nodes.join(F.broadcast(most), n > F.col("most")).agg(F.collect_list("node").alias("hubs"))
    # Nodes are dealt by ranges of their ids; two parts meet if some part has neighbours of both.
    parts = G.saved(rank_all(all_nodes.select("node"), ["node"], "k").select("node", F.floor((F.col("k") - 1) / BRIDGED).cast("int").alias("_part")))
    near = F.broadcast if parts.count() <= G.NODES else lambda df: df
    nodes = all_nodes.join(F.broadcast(hubs)).select("node", F.array_except("near", "hubs").alias("near")).where("size(near) > 0")
    nodes = G.saved(nodes.join(near(parts), "node"))
    over = nodes.select(F.col("_part").alias("_i"), F.explode("near").alias("node")).join(near(parts), "node").select("_i", "_part").distinct()
    blocks = over.join(over.select(F.col("_i").alias("_j"), "_part"), "_part").where("_i <= _j").select("_i", "_j").distinct()

    def common(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        _, shared = B.sparse(a, b, "near")
        return shared > 0, {"bridges": shared.astype(np.int64)}

    return B.pairs(nodes, "node", {"bridges": "long"}, common, met=G.saved(blocks))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, count(*) AS spread FROM c GROUP BY 1), t AS (SELECT count(DISTINCT user_id) AS names FROM c),
w AS (SELECT user_id, event_type, n * ln(1 + names / spread) AS w FROM c JOIN s USING (event_type), t), z AS (SELECT user_id, sqrt(sum(w * w)) AS z FROM w GROUP BY 1)
SELECT x.user_id AS a, y.user_id AS b, round(sum(x.w * y.w) / any_value(zx.z * zy.z), 6) AS cosine FROM w x JOIN w y ON x.event_type = y.event_type AND x.user_id < y.user_id JOIN z zx ON zx.user_id = x.user_id JOIN z zy ON zy.user_id = y.user_id GROUP BY ALL""")
def g22_profile_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Sparse cosine of names' cause profiles, over blocks of names."""
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = c.groupBy("event_type").agg(F.count("*").alias("spread"))
    w = c.join(F.broadcast(s), "event_type").join(F.broadcast(c.agg(F.countDistinct("user_id").alias("names"))))
    w = w.select("user_id", "event_type", (F.col("n") * F.log(1 + F.col("names") / F.col("spread"))).alias("w"))
    z = w.groupBy("user_id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("z"))
    u = w.join(z, "user_id").select("event_type", F.col("user_id").alias("a"), (F.col("w") / F.col("z")).alias("u"))
    profiles = G.saved(u.groupBy(F.col("a").alias("name")).agg(F.collect_list(F.struct("event_type", "u")).alias("u")))

    def cosines(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        product, shared = B.sparse(a, b, "u", "event_type", "u")
        return shared > 0, {"cosine": np.round(product, 6)}

    return B.pairs(profiles, "name", {"cosine": "double"}, cosines, 2000, 256, "cosine")


@query(f"""WITH {PANEL}, p AS (SELECT x.symbol AS a, y.symbol AS b, x.ret AS r, y.ret AS s, x.day >= DATE '2024-01-16' AS late FROM panel x JOIN panel y ON x.day = y.day AND x.symbol < y.symbol)
SELECT a, b, round(corr(r, s) FILTER (late), 6) AS recent, round(corr(r, s) FILTER (NOT late), 6) AS prior FROM p GROUP BY ALL""")
def g24_emerging_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of pairs before and after a day, over blocks of names."""
    p = G.saved(panel(spark, d).select("symbol", "day", "ret"))
    first, last = p.agg(F.min("day"), F.max("day")).first()
    whole = spark.createDataFrame([(0, first, (last - first).days + 1 if first else 1)], "window int, first date, days int")
    series = G.saved(D.windowed(p, "symbol", "day", "ret", whole))
    cut = max(0, (date(2024, 1, 16) - first).days) if first else 0

    def part(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        n, c = D.correlations(x, y)
        return n > 0, (np.round(c, 6), n == 0)

    def correlated(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, dict[str, tuple[np.ndarray, np.ndarray]]]:
        x, y = B.matrix(a["x"]), B.matrix(b["x"])
        (late, recent), (early, prior) = part(x[:, cut:], y[:, cut:]), part(x[:, :cut], y[:, :cut])
        return late | early, {"recent": recent, "prior": prior}

    return B.pairs(series, "symbol", {"recent": "double", "prior": "double"}, correlated, 2000, 128, "recent")


@query("SELECT conv_id, CASE WHEN s < 0.4 THEN 'abstain' WHEN s >= 0.55 AND NOT mixed THEN 'high' WHEN s >= 0.45 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT conv_id, round(avg(length(text)) % 100 / 100, 9) AS s, conv_id % 4 = 0 AS mixed FROM conversations GROUP BY conv_id)")
def v11_reasoner(spark: SparkSession, d: str) -> DataFrame:
    """Confidence from a score: abstains when low, never high where channels are mixed."""
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.round(F.avg(F.length("text")) % 100 / 100, 9).alias("s"))
    mixed = F.col("conv_id") % 4 == 0
    return c.select("conv_id", F.when(F.col("s") < 0.4, "abstain").when((F.col("s") >= 0.55) & ~mixed, "high").when(F.col("s") >= 0.45, "medium").otherwise("low").alias("confidence"))


@query("SELECT l_partkey % 200 AS subject, count(DISTINCT l_returnflag) FILTER (l_returnflag IN ('A', 'R')) = 2 AS dissent, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY 1")
def v12_dissent(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that sources call both up and down, with the number of sources."""
    l = table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 200).alias("subject"))
    return l.agg((F.countDistinct(F.when(F.col("l_returnflag").isin("A", "R"), F.col("l_returnflag"))) == 2).alias("dissent"), F.countDistinct("l_suppkey").alias("sources"))


@query("SELECT o_custkey, count(DISTINCT o_orderpriority) AS confirming FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def v13_corroboration(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("confirming"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS t FROM documents), tf AS (SELECT doc_id, t, count(*) AS n FROM w GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY 1), k AS (SELECT count(*) AS n FROM documents),
v AS (SELECT t, df FROM df, k WHERE df >= 3 AND df <= 0.5 * n QUALIFY row_number() OVER (ORDER BY df DESC, t) <= 4000), x AS (SELECT doc_id, t, tf.n * ln(k.n / df) AS w FROM tf JOIN v USING (t), k), z AS (SELECT doc_id, sqrt(sum(w * w)) AS z FROM x GROUP BY 1)
SELECT doc_id, t AS term, round(w / z, 6) AS weight FROM x JOIN z USING (doc_id)""")
def v17_tfidf_space(spark: SparkSession, d: str) -> DataFrame:
    """Unit tf-idf weights over the most common terms of middling frequency."""
    docs = table(spark, d, "documents")
    # Texts go to their document's partition once; its terms are counted, weighed and scaled there.
    own = dealt(docs.select("doc_id", "text"), WIDE * docs.count(), "doc_id")
    w = own.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("term"))
    tf = w.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n"))
    vocabulary = tf.groupBy("term").agg(F.count("*").alias("df")).join(F.broadcast(n)).where("df >= 3 AND df <= 0.5 * n").orderBy(F.desc("df"), "term").limit(4000)
    x = tf.join(F.broadcast(vocabulary), "term").select("doc_id", "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w"))
    z = F.sqrt(F.sum(F.col("w") ** 2).over(W.partitionBy("doc_id")))
    return x.select("doc_id", "term", F.round(F.col("w") / z, 6).alias("weight"))


@query("""WITH q AS (SELECT user_id AS event, event_id AS leg, least(greatest(value / 100, 0.01), 0.99) AS p FROM events), s AS (SELECT *, p / sum(p) OVER (PARTITION BY event) AS share FROM q)
SELECT event, leg, round(share, 6) AS share, row_number() OVER (PARTITION BY event ORDER BY round(share, 9) DESC, leg) AS place, round(sum(share * share) OVER (PARTITION BY event), 6) AS hhi FROM s""")
def x16_implied_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Legs' prices as shares of their event's total, with rank and concentration."""
    q = table(spark, d, "events").select(F.col("user_id").alias("event"), F.col("event_id").alias("leg"), F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(0.99)).alias("p"))
    w = W.partitionBy("event")
    s = q.withColumn("share", F.col("p") / F.sum("p").over(w))
    place = F.row_number().over(w.orderBy(F.round("share", 9).desc(), "leg")).cast("long")
    return s.select("event", "leg", F.round("share", 6).alias("share"), place.alias("place"), F.round(F.sum(F.col("share") ** 2).over(w), 6).alias("hhi"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS strike, l_discount AS iv FROM lineitem) SELECT l_orderkey, round(arg_min(iv, (abs(strike - 25), l_linenumber, iv)), 6) AS atm_iv, round(arg_min(iv, (abs(strike - 20), l_linenumber, iv)) - arg_min(iv, (abs(strike - 25), l_linenumber, iv)), 6) AS skew FROM x GROUP BY 1""")
def x08_option_surface(spark: SparkSession, d: str) -> DataFrame:
    """At-the-money volatility and skew of each day."""
    x = table(spark, d, "lineitem")
    at = lambda k: F.min_by("l_discount", F.struct(F.abs(F.col("l_quantity") - k), "l_linenumber", "l_discount"))
    return x.groupBy("l_orderkey").agg(F.round(at(25), 6).alias("atm_iv"), F.round(at(20) - at(25), 6).alias("skew"))
