"""Queries of hashed features, link and table sources, text sinks, upserts, co-movement and mapped retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import text as TX
from tidemark.operators import graph as G
from tidemark.operators import series as S
from tidemark.operators import spectral
from tidemark.operators.order import WIDE, dealt
from tidemark.operators.temporal import first_per_key
from tidemark.plans.composites import CELLS, cells
from tidemark.plans.landing import _work
from tidemark.plans.retrieval import CO, facts
from tidemark.plans.windows import PANEL, panel
from tidemark.registry import query, table

WORDS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
SCALED = "c AS (SELECT doc_id, ('0x' || substr(md5(f), 1, 8))::BIGINT % {0} AS slot, count(*) AS n FROM f GROUP BY ALL) SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS weight FROM c"


@query("""WITH h AS (SELECT page_id, hex(encode(url)) AS h FROM pages), b AS (SELECT page_id, list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::HUGEINT) AS b FROM h)
SELECT page_id, lpad(lower(to_hex(list_reduce(list_concat([14695981039346656037::HUGEINT], b), lambda s, x: (xor(s, x) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT)), 16, '0') AS key FROM b""")
def t05_stable_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", H.fnv1a(F.col("url")).alias("key"))


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS}) AS w FROM documents),
f AS (SELECT doc_id, w AS f FROM w UNION ALL SELECT doc_id, substr(' ' || w || ' ', i, 4) FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)), {SCALED.format(256)}""")
def t33_hashed_grams(spark: SparkSession, d: str) -> DataFrame:
    """Words and their character grams in 256 slots."""
    found = H.bag(table(spark, d, "documents"), "doc_id", H.words(F.col("text")), 256, H.grams_of)
    return found.withColumn("weight", F.round("weight", 6))


@query(f"""WITH t AS (SELECT doc_id, {WORDS} AS w FROM documents),
f AS (SELECT doc_id, unnest(w) AS f FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM t), {SCALED.format(1024)}""")
def t34_hashed_bag(spark: SparkSession, d: str) -> DataFrame:
    """Words and pairs of words in 1,024 slots."""
    # Words are a column of their own, else each place of a pair splits the text again.
    docs = table(spark, d, "documents").select("doc_id", "text")
    split = dealt(docs, WIDE * docs.count(), "doc_id").select("doc_id", H.words(F.col("text")).alias("words"))
    found = H.bag(split, "doc_id", H.word_pairs(F.col("words")), 1024)
    return found.withColumn("weight", F.round("weight", 6))


@query(r"""WITH t AS (SELECT doc_id, 'Item 1. Business 4 Item 1A. Risks 9 ITEM 1: BUSINESS ' || coalesce(text, '') || ' Item 1A Risks' AS filing FROM documents),
p AS (SELECT doc_id, unnest(list_transform(string_split_regex(filing, '(?i)item\s+1[.:]?\s+business')[2:], lambda x: trim(string_split_regex(x, '(?i)item\s+1a')[1], ' '))) AS part FROM t)
SELECT doc_id, max(len(part)) AS n_chars, md5(arg_max(part, len(part))) AS digest FROM p GROUP BY 1""")
def t40_business_section(spark: SparkSession, d: str) -> DataFrame:
    """The longest business section of a filing; the table of contents has one too."""
    filing = F.concat(F.lit("Item 1. Business 4 Item 1A. Risks 9 ITEM 1: BUSINESS "), F.coalesce("text", F.lit("")), F.lit(" Item 1A Risks"))
    part = TX.business_section(filing)
    return table(spark, d, "documents").select("doc_id", F.length(part).cast("long").alias("n_chars"), F.md5(part).alias("digest"))


@query("SELECT page_id, url FROM pages")
def s23_link_decode(spark: SparkSession, d: str) -> DataFrame:
    """Addresses that an aggregator's links carry in URL-safe base 64."""
    code = F.translate(F.regexp_replace(F.base64(F.encode("url", "UTF-8")), "[=\r\n]", ""), "+/", "-_")
    links = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://news.example.com/articles/"), code, F.lit("?oc=5")).alias("link"))
    return links.select("page_id", TX.decode_link(F.col("link")).alias("url"))


@query("SELECT o_custkey, o_orderkey, o_orderdate::DATE AS day, o_orderpriority FROM orders")
def s29_calendar_tables(spark: SparkSession, d: str) -> DataFrame:
    """Rows of HTML calendar tables; a page holds a customer's year."""
    row = F.concat(F.lit("<tr><td>"), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit("</td><td>"), F.col("o_orderkey").cast("string"), F.lit("</td><td>"), F.col("o_orderpriority"), F.lit("</td></tr>"))
    pages = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.concat(F.lit("<table>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table>")).alias("html"))
    found = pages.select("o_custkey", F.explode(F.regexp_extract_all("html", F.lit("<tr>(.*?)</tr>"), 1)).alias("row"))
    found = found.select("o_custkey", F.regexp_extract_all("row", F.lit("<td>(.*?)</td>"), 1).alias("cells"))
    return found.select("o_custkey", F.col("cells")[1].cast("long").alias("o_orderkey"), F.to_date(F.col("cells")[0], "dd MMM yyyy").alias("day"), F.col("cells")[2].alias("o_orderpriority"))


@query("SELECT c_custkey, c_name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer")
def s12_mixed_load(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines and Parquet of one table, loaded by name; columns that a file lacks are null."""
    work, c = _work(spark), table(spark, d, "customer")
    c.where("c_mktsegment = 'BUILDING'").select("c_name", "c_custkey").write.json(f"{work}/json")
    c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", "c_name", "c_mktsegment").write.parquet(f"{work}/parquet")
    lines = spark.read.schema("c_custkey long, c_name string").json(f"{work}/json")
    return spark.read.parquet(f"{work}/parquet").unionByName(lines, allowMissingColumns=True)


@query("""WITH f AS (SELECT event_type AS series, ts::DATE AS period, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY ALL)
SELECT series, period, round(value, 6) AS value, round(lag(value) OVER (PARTITION BY series ORDER BY period), 6) AS prior FROM f""")
def s27_first_releases(spark: SparkSession, d: str) -> DataFrame:
    """First release of each period from landed JSON, with the period before carried along."""
    path = f"{_work(spark)}/releases"
    vintage = F.unix_micros(F.col("ts").cast("timestamp"))
    table(spark, d, "events").select(F.col("event_type").alias("series"), F.to_date("ts").alias("period"), vintage.alias("vintage"), "event_id", "value").write.json(path)
    landed = spark.read.schema("series string, period date, vintage long, event_id long, value double").json(path)
    first = first_per_key(landed, ["series", "period"], [F.col("vintage"), F.col("event_id")])
    return first.select("series", "period", F.round("value", 6).alias("value"), F.round(F.lag("value").over(S.ordered(["series"], ["period"])), 6).alias("prior"))


@query("""SELECT event_type AS desk, day AS dt, '# ' || event_type || ' ' || day || chr(10) || string_agg('- ' || event_id, chr(10) ORDER BY k) AS text
FROM (SELECT event_type, event_id, ts::DATE AS day, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY round(value, 9) DESC, event_id) AS k FROM events) WHERE k <= 3 GROUP BY event_type, day""")
def s38_brief_files(spark: SparkSession, d: str) -> DataFrame:
    """A markdown brief for each desk and day with its three largest events, written as files and read back."""
    path = f"{_work(spark)}/briefs"
    e = table(spark, d, "events").select(F.col("event_type").alias("desk"), F.to_date("ts").alias("dt"), "event_id", "value")
    top = first_per_key(e, ["desk", "dt"], [F.round("value", 9).desc(), F.col("event_id")], rank="k", most=3)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("k", "event_id"))), lambda x: F.concat(F.lit("- "), x["event_id"].cast("string")))
    brief = F.concat(F.lit("# "), F.col("desk"), F.lit(" "), F.col("dt").cast("string"), F.lit("\n"), F.array_join("lines", "\n"))
    top.groupBy("desk", "dt").agg(lines.alias("lines")).select("desk", "dt", brief.alias("value")).write.partitionBy("dt", "desk").text(path)
    back = spark.read.schema("value string, dt date, desk string").text(path, wholetext=True)
    return back.select("desk", "dt", F.regexp_replace("value", "\n$", "").alias("text"))


@query("""WITH i AS (SELECT o_custkey, max(o_orderpriority) AS code FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, o_custkey) AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment ELSE coalesce(code, c_mktsegment) END AS code,
  coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS verified FROM customer FULL JOIN i ON c_custkey = o_custkey""")
def s43_reference_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Incoming codes replace known ones unless those are verified; new ids are added."""
    verified = F.coalesce(F.col("known").isin("BUILDING", "MACHINERY"), F.lit(False))
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("known"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderpriority").alias("code"))
    return known.join(new, "id", "full").select("id", F.when(verified, F.col("known")).otherwise(F.coalesce("code", "known")).alias("code"), verified.alias("verified"))


@query("SELECT doc_id, (CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END)::BIGINT AS quality, (CASE WHEN toxic = 1 THEN 2 ELSE 1 END)::BIGINT AS run FROM labels")
def s47_checkpoint_reload(spark: SparkSession, d: str) -> DataFrame:
    """Lines appended by two runs, some cut off; the last one that parses is the state of a document."""
    path = f"{_work(spark)}/checkpoint"
    l = table(spark, d, "labels")
    first = l.select(F.to_json(F.struct("doc_id", "quality", F.lit(1).alias("run"))).alias("value"))
    again = l.where("toxic = 1").select(F.to_json(F.struct("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(2).alias("run"))).alias("value"))
    cut = again.select(F.expr("substring(value, 1, length(value) - 3)").alias("value"))
    for lines in (first, again, cut):
        lines.write.mode("append").text(path)
    back = spark.read.schema("doc_id long, quality long, run long").option("mode", "DROPMALFORMED").json(path)
    return first_per_key(back, ["doc_id"], [F.col("run").desc()]).select("doc_id", "quality", "run")


@query()
def a40_absorption(spark: SparkSession, d: str) -> DataFrame:
    """The leading factor's share of the names' correlations in each week."""
    p = panel(spark, d).select("symbol", "ret", F.to_date(F.date_trunc("week", "day")).alias("week"), F.weekday("day").alias("at"))
    return spectral.absorption(p, "week", "symbol", "at", "ret", 7).select("week", "names", F.round("share", 6).alias("share"))


def _restarts(rounds: int) -> str:
    step = "r0 AS (SELECT node, p AS r FROM nodes)"
    for i in range(rounds):
        step += f", s{i} AS (SELECT b AS node, sum(r * weight / d) AS got FROM r{i} JOIN e ON e.a = node JOIN deg USING (a) GROUP BY 1), r{i + 1} AS (SELECT nodes.node, 0.4 * p + 0.6 * coalesce(got, 0) AS r FROM nodes LEFT JOIN s{i} ON s{i}.node = nodes.node)"
    return step


@query(f"""WITH {CO}, e AS (SELECT a, b, weight FROM co UNION ALL SELECT b, a, weight FROM co), deg AS (SELECT a, sum(weight) AS d FROM e GROUP BY 1), nodes AS (SELECT DISTINCT a AS node, CASE WHEN a = 3 THEN 1 ELSE 0 END AS p FROM e), {_restarts(10)}
SELECT node, round(r, 6) AS rank FROM r10""")
def g08_restart_rank(spark: SparkSession, d: str) -> DataFrame:
    """Rank around one entity with a restart of 0.4."""
    seed = spark.sql("SELECT * FROM VALUES (3L, 1.0D) AS t(node, mass)")
    ranks = G.page_rank(G.shared(facts(spark, d), "fact", "entity"), seed, 0.6, 10, every=2)
    return ranks.select("node", F.round("rank", 6).alias("rank"))


DRIVERS = """e AS (SELECT DISTINCT l_orderkey AS driver, l_suppkey AS name FROM lineitem), k AS (SELECT driver FROM e GROUP BY 1 HAVING count(*) BETWEEN 2 AND 14),
bound AS (SELECT driver, x.name AS a, y.name AS b FROM e x JOIN e y USING (driver) SEMI JOIN k USING (driver) WHERE x.name < y.name)"""
CORR = "corrs AS (SELECT a, b, count(*) AS n, corr(x.ret, y.ret) AS corr FROM (SELECT DISTINCT a, b FROM sets) q JOIN panel x ON x.symbol = a JOIN panel y ON y.symbol = b AND y.day = x.day GROUP BY 1, 2 HAVING count(*) >= 10)"


def bound(spark: SparkSession, d: str) -> DataFrame:
    """``driver, a, b``: the pairs of names that one driver binds; a driver of more than 14 names is a round-up."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("driver"), F.col("l_suppkey").alias("a")).distinct()
    few = e.groupBy("driver").agg(F.count("*").alias("n")).where("n BETWEEN 2 AND 14").select("driver")
    e = e.join(few, "driver")
    return e.join(e.withColumnRenamed("a", "b"), "driver").where("a < b")


@query(f"WITH {PANEL}, {DRIVERS}, sets AS (SELECT a, b FROM bound), {CORR} SELECT driver, count(*) AS pairs, round(avg(corr), 6) AS mean_corr, round(max(corr), 6) AS max_corr FROM bound JOIN corrs USING (a, b) GROUP BY 1")
def g23_bound_sets(spark: SparkSession, d: str) -> DataFrame:
    """How the names that a driver binds move together."""
    found = spectral.paired(bound(spark, d), panel(spark, d), "symbol", "day", "ret", 10)
    return found.groupBy("driver").agg(F.count("*").alias("pairs"), F.round(F.avg("corr"), 6).alias("mean_corr"), F.round(F.max("corr"), 6).alias("max_corr"))


@query(f"""WITH {PANEL}, {DRIVERS}, names AS (SELECT DISTINCT symbol FROM panel), labelled AS (SELECT 'linked' AS label, a, b FROM bound GROUP BY a, b HAVING count(*) >= 2
UNION ALL SELECT 'group', x.symbol, y.symbol FROM names x JOIN names y ON x.symbol // 10 = y.symbol // 10 AND x.symbol < y.symbol UNION ALL SELECT 'distant', symbol, symbol + 37 FROM names),
sets AS (SELECT a, b FROM labelled), {CORR} SELECT label, count(*) AS pairs, round(avg(corr), 6) AS mean_corr FROM labelled JOIN corrs USING (a, b) GROUP BY 1""")
def j29_pair_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets of pairs by where they come from (links, groups of ten, distant ones) against their correlations."""
    p = panel(spark, d)
    names = p.select("symbol").distinct()
    linked = bound(spark, d).groupBy("a", "b").agg(F.count("*").alias("n")).where("n >= 2").select(F.lit("linked").alias("label"), "a", "b")
    tens = names.select(F.floor(F.col("symbol") / 10).alias("ten"), F.col("symbol").alias("a"))
    group = tens.join(tens.withColumnRenamed("a", "b"), "ten").where("a < b").select(F.lit("group").alias("label"), "a", "b")
    distant = names.select(F.lit("distant").alias("label"), F.col("symbol").alias("a"), (F.col("symbol") + 37).alias("b"))
    labelled = linked.unionByName(group).unionByName(distant)
    corrs = spectral.pair_correlation(labelled, p, "symbol", "day", "ret", 10)
    return labelled.join(corrs, ["a", "b"]).groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.avg("corr"), 6).alias("mean_corr"))


@query(f"""WITH {PANEL}, {CELLS}, n AS (SELECT symbol, day, ret, lead(day, 3) OVER w AS resolves, lead(ret, 3) OVER w AS later FROM panel WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT n.symbol, n.day, resolves, CASE WHEN later IS NULL THEN 'open' WHEN later > ret THEN 'yes' ELSE 'no' END AS outcome FROM n JOIN cells c ON c.symbol = n.symbol AND c.day = n.day AND c.class = 'error'""")
def x11_daily_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions anchored on a day's error news: is the value higher three sessions on?"""
    w = S.ordered(["symbol"], ["day"])
    n = panel(spark, d).select("symbol", "day", "ret", F.lead("day", 3).over(w).alias("resolves"), F.lead("ret", 3).over(w).alias("later"))
    asked = n.join(cells(spark, d).where("class = 'error'"), ["symbol", "day"], "left_semi")
    return asked.select("symbol", "day", "resolves", F.when(F.col("later").isNull(), "open").when(F.col("later") > F.col("ret"), "yes").otherwise("no").alias("outcome"))


@query("""SELECT 'event' AS kind, event_id AS id, CASE WHEN event_type IN ('purchase', 'error') THEN 'material' ELSE 'routine' END AS class FROM events
UNION ALL SELECT 'entity', user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1)
UNION ALL SELECT 'edge', l_orderkey, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE min(l_returnflag) END FROM lineitem GROUP BY l_orderkey""")
def x14_class_tables(spark: SparkSession, d: str) -> DataFrame:
    """Classes of events, entities (their most frequent type) and edges (their direction), as one side table."""
    e, l = table(spark, d, "events"), table(spark, d, "lineitem")
    event = e.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("event_type").isin("purchase", "error"), "material").otherwise("routine").alias("class"))
    counts = e.groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("class")).agg(F.count("*").alias("n"))
    entity = first_per_key(counts, ["id"], [F.col("n").desc(), F.col("class")]).select(F.lit("entity").alias("kind"), "id", "class")
    least, most = F.min("l_returnflag"), F.max("l_returnflag")
    edge = l.groupBy(F.col("l_orderkey").alias("id")).agg(F.when(least != most, "mixed").otherwise(least).alias("class")).select(F.lit("edge").alias("kind"), "id", "class")
    return event.unionByName(entity).unionByName(edge)
