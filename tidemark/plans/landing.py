"""Queries of landed files and of scalars that repair, name and reconcile: written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.stream import _work
from tidemark.registry import query, table
from tidemark.sources import files


@query("SELECT event_id, user_id, value FROM events WHERE event_id % 10 NOT IN (3, 4)")
def s05_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines, some cut off and some blank, read back without those."""
    path = f"{_work(spark)}/lines"
    e = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    kind = F.col("event_id") % 10
    e.select(F.when(kind == 3, F.substring(line, 1, 9)).when(kind == 4, "").otherwise(line).alias("value")).write.text(path)
    return files.json_lines(spark, path, "event_id long, user_id long, value double")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS sector FROM customer")
def s08_csv_aliases(spark: SparkSession, d: str) -> DataFrame:
    """CSV whose headers differ from the canonical names, resolved by alias."""
    path = f"{_work(spark)}/csv"
    table(spark, d, "customer").select(F.col("c_custkey").alias("CustKey"), F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("Segment")).write.option("header", True).csv(path)
    found = files.aliased(files.csv(spark, path), {"id": ["custkey"], "name": ["full_name"], "sector": ["segment", "industry"]})
    return found.select(F.col("id").cast("long").alias("id"), "name", "sector")


@query("SELECT l_orderkey AS day, l_linenumber AS strike, round(l_discount, 4) AS iv, 'csv' AS lineage FROM lineitem WHERE l_discount > 0")
def s09_csv_to_parquet(spark: SparkSession, d: str) -> DataFrame:
    """CSV projected to columnar files: chosen columns, rows with a value, a lineage stamp."""
    work = _work(spark)
    table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax").write.option("header", True).csv(f"{work}/csv")
    rows = files.csv(spark, f"{work}/csv", "l_orderkey long, l_linenumber int, l_discount double, l_tax double").where("l_discount > 0")
    rows.select(F.col("l_orderkey").alias("day"), F.col("l_linenumber").alias("strike"), F.round("l_discount", 4).alias("iv"), F.lit("csv").alias("lineage")).write.option("compression", "zstd").parquet(f"{work}/parquet")
    return spark.read.parquet(f"{work}/parquet")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def s04_raw_part(spark: SparkSession, d: str) -> DataFrame:
    """One part of a partitioned table, read without the column that its folder names."""
    path = f"{_work(spark)}/orders"
    table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    return spark.read.parquet(f"{path}/o_orderstatus=F")


@query("SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1")
def s13_table_writer(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines, a folder for each table; empty ones make none."""
    path = f"{_work(spark)}/tables"
    table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("table")).write.partitionBy("table").json(path)
    return spark.read.schema("event_id long, user_id long, table string").json(path).groupBy(F.col("table").alias("event_type")).agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("""SELECT doc_id // 50 AS batch, count(*) AS docs, count(l.quality) AS done, count(l.quality) >= 0.8 * count(*) AS covered, count(l.quality) >= 0.8 * count(*) AND bool_and(l.quality IS NULL OR l.quality IN (0, 1)) AS valid FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1""")
def s40_batch_validator(spark: SparkSession, d: str) -> DataFrame:
    """A batch of outputs is valid if it covers four fifths of its inputs and every row parses."""
    l = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id", F.expr("doc_id div 50").alias("batch")).join(l, "doc_id", "left")
    covered = F.count("quality") >= 0.8 * F.count("*")
    good = F.bool_and(F.col("quality").isNull() | F.col("quality").isin(0, 1))
    return rows.groupBy("batch").agg(F.count("*").alias("docs"), F.count("quality").alias("done"), covered.alias("covered"), (covered & good).alias("valid"))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region UNION ALL SELECT s_suppkey + 1000, s_name FROM supplier")
def s44_by_extension(spark: SparkSession, d: str) -> DataFrame:
    """Files of three kinds, each read by its extension."""
    work = _work(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(f"{work}/a.csv")
    table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")).write.json(f"{work}/b.jsonl")
    table(spark, d, "supplier").select((F.col("s_suppkey") + 1000).alias("n_nationkey"), F.col("s_name").alias("n_name")).write.parquet(f"{work}/c.parquet")
    parts = [files.by_extension(spark, f"{work}/{n}").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name") for n in ("a.csv", "b.jsonl", "c.parquet")]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderdate + to_hours((o_orderkey % 24)::INT) END AS meta, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderdate::DATE + (o_orderkey % 2)::INT) END AS body, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS hint FROM orders)
SELECT o_orderkey, CASE WHEN meta IS NOT NULL AND NOT (body IS NOT NULL AND meta = date_trunc('day', meta) AND meta::DATE <> body) THEN meta WHEN body IS NOT NULL THEN body::TIMESTAMP WHEN hint IS NOT NULL THEN hint ELSE TIMESTAMP '2024-02-01' END AS published, meta IS NULL AND body IS NULL AND hint IS NULL AS estimated FROM p""")
def t11_reconciled_time(spark: SparkSession, d: str) -> DataFrame:
    """The page's own time, unless it is a bare midnight on another day than the body's; then the body's, a hint, or now as an estimate."""
    o = table(spark, d, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp_ntz"))
    k = F.col("o_orderkey")
    p = o.select(
        "o_orderkey",
        F.when(k % 4 < 3, F.expr("at + make_dt_interval(0, cast(o_orderkey % 24 as int))")).alias("meta"),
        F.when(k % 3 > 0, F.date_add(F.to_date("at"), (k % 2).cast("int"))).alias("body"),
        F.when(k % 5 > 0, F.col("at")).alias("hint"),
    )
    bare = F.col("body").isNotNull() & (F.col("meta") == F.to_date("meta").cast("timestamp_ntz")) & (F.to_date("meta") != F.col("body"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    published = F.when(F.col("meta").isNotNull() & ~bare, F.col("meta")).when(F.col("body").isNotNull(), F.col("body").cast("timestamp_ntz")).when(F.col("hint").isNotNull(), F.col("hint")).otherwise(now)
    return p.select("o_orderkey", published.alias("published"), (F.col("meta").isNull() & F.col("body").isNull() & F.col("hint").isNull()).alias("estimated"))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'brass') THEN 'metals' WHEN contains(lower(p_type), 'steel') THEN 'metals' WHEN contains(lower(p_type), 'promo') THEN 'retail' WHEN contains(lower(p_type), 'eco') THEN 'energy' ELSE 'other' END AS sector FROM part""")
def t27_text_mapper(spark: SparkSession, d: str) -> DataFrame:
    """The sector of the first listed word that a text holds."""
    low, out = F.lower("p_type"), F.lit("other")
    for word, sector in reversed([("brass", "metals"), ("steel", "metals"), ("promo", "retail"), ("eco", "energy")]):
        out = F.when(F.contains(low, F.lit(word)), sector).otherwise(out)
    return table(spark, d, "part").select("p_partkey", out.alias("sector"))


@query("""WITH b AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '[' || props || ',]' WHEN 1 THEN replace(props, '}', ', }') WHEN 2 THEN props[1:length(props) - 1] ELSE props END AS raw FROM events), r AS (SELECT event_id, regexp_replace(raw, ',\\s*([}\\]])', '\\1', 'g') AS t FROM b),
c AS (SELECT event_id, t || repeat('}', greatest(length(t) - length(replace(t, '{', '')) - (length(t) - length(replace(t, '}', ''))), 0)) AS t FROM r) SELECT event_id, coalesce(json_extract_string(t, '$[0].k'), json_extract_string(t, '$.k'))::BIGINT AS k FROM c""")
def t31_json_repair(spark: SparkSession, d: str) -> DataFrame:
    """Trailing commas go and missing braces are added before the text is parsed."""
    p, k = F.col("props"), F.col("event_id") % 4
    raw = F.when(k == 0, F.concat(F.lit("["), p, F.lit(",]"))).when(k == 1, F.replace(p, F.lit("}"), F.lit(", }"))).when(k == 2, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    t = F.regexp_replace(raw, r",\s*([}\]])", "$1")
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))
    rows = table(spark, d, "events").select("event_id", t.alias("t"))
    whole = F.concat("t", F.repeat(F.lit("}"), F.greatest(count(F.col("t"), "{") - count(F.col("t"), "}"), F.lit(0))))
    return rows.select("event_id", F.coalesce(F.get_json_object(whole, "$[0].k"), F.get_json_object(whole, "$.k")).cast("long").alias("k"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc/' || doc_id::VARCHAR)) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS id FROM h""")
def t07_name_uuid(spark: SparkSession, d: str) -> DataFrame:
    """Version 5 UUIDs: SHA-1 of a namespace and a name, with the version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).cast("binary")))
    rows = table(spark, d, "documents").select("doc_id", h.alias("h"))
    part = lambda a, n: F.substring("h", a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return rows.select("doc_id", F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12)).alias("id"))


@query("SELECT doc_id::VARCHAR AS doc_id, source, lang AS desk FROM documents WHERE doc_id % 28 BETWEEN 4 AND 13 AND n_chars > 0 AND text IS NOT NULL")
def s01_corpus_scan(spark: SparkSession, d: str) -> DataFrame:
    """A corpus partitioned by day, read between two days for full bodies: the bounds prune partitions."""
    path = f"{_work(spark)}/corpus"
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_name"), F.array("lang").alias("desks"), F.col("text").alias("body_text"), (F.col("n_chars") > 0).alias("extraction_ok"), day.cast("string").alias("published_date"), day.alias("dt"))
    a.repartition("dt").write.partitionBy("dt").parquet(path)
    found = files.corpus(spark, path, start="2024-01-05", end="2024-01-14", full_body=True)
    return found.select("doc_id", F.col("source_name").alias("source"), F.get("desks", 0).alias("desk"))


@query("SELECT l_suppkey AS entity, count(*) AS n, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND l_returnflag = 'N' GROUP BY 1")
def s02_facts_scan(spark: SparkSession, d: str) -> DataFrame:
    """Facts in partitions by year and flag, read by both: a scan of the folders asked for only."""
    path = f"{_work(spark)}/facts"
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("entity"), "l_quantity", F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("desk"))
    l.repartition("year", "desk").write.partitionBy("year", "desk").parquet(path)
    f = spark.read.parquet(path).where("year = 1996 AND desk = 'N'")
    return f.groupBy("entity").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("total"))


@query("SELECT p_partkey, p_brand, round(p_retailprice * 2, 2) AS price FROM part")
def s16_full_refresh(spark: SparkSession, d: str) -> DataFrame:
    """A table written whole with its schema and compression, then replaced whole by the next refresh."""
    path = f"{_work(spark)}/parts"
    p = table(spark, d, "part")
    for times in (1, 2):
        p.select("p_partkey", "p_brand", F.round(F.col("p_retailprice") * times, 2).alias("price")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


@query("SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 4 = 0")
def s17_resume(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are new or whose digest changed since the state that was kept; the state is read as two columns."""
    path = f"{_work(spark)}/state"
    docs = table(spark, d, "documents")
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    kept = F.when(F.col("doc_id") % 4 == 0, "changed").otherwise(digest)
    docs.where("doc_id % 3 = 0").select("doc_id", kept.alias("content_hash"), "text", "source").write.parquet(path)
    state = spark.read.parquet(path).select("doc_id", "content_hash")
    return docs.withColumn("content_hash", digest).join(state, ["doc_id", "content_hash"], "left_anti").select("doc_id", "source")


@query("SELECT url AS loc, '2024-01-' || lpad((1 + page_id % 28)::VARCHAR, 2, '0') AS lastmod FROM pages WHERE url IS NOT NULL")
def s20_sitemap(spark: SparkSession, d: str) -> DataFrame:
    """Landed sitemaps read as one row a location."""
    path = f"{_work(spark)}/sitemaps"
    day = F.format_string("2024-01-%02d", 1 + F.col("page_id") % 28)
    table(spark, d, "pages").where("url IS NOT NULL").select(F.col("url").alias("loc"), day.alias("lastmod")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return files.sitemap(spark, path)


@query("SELECT event_id::VARCHAR || '@cal' AS uid, 'Release ' || event_type || ', print ' || user_id AS summary, date_trunc('second', ts) AS starts FROM events")
def s28_calendar_files(spark: SparkSession, d: str) -> DataFrame:
    """Calendar files with folded lines read back as events."""
    path = f"{_work(spark)}/calendar"
    start = F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")
    body = F.concat(F.lit("BEGIN:VEVENT\r\nUID:"), F.col("event_id").cast("string"), F.lit("@cal\r\nSUMMARY:Release "), F.col("event_type"), F.lit(", pr\r\n int "), F.col("user_id").cast("string"), F.lit("\r\nDTSTART:"), start, F.lit("\r\nEND:VEVENT\r"))
    table(spark, d, "events").select(body.alias("value")).write.text(path)
    return files.calendar_events(spark, path).select("uid", "summary", F.col("starts").cast("timestamp_ntz").alias("starts"))


@query("""SELECT p_partkey::VARCHAR AS symbol, p_brand AS expiry, side, round(p_retailprice * m, 2) AS strike, round(p_size / 100.0, 4) AS iv FROM part, (VALUES ('call', 0.5::DOUBLE), ('call', 1::DOUBLE), ('put', 2::DOUBLE)) s(side, m)""")
def s32_option_chains(spark: SparkSession, d: str) -> DataFrame:
    """Nested option chains as one row a contract."""
    price = F.col("p_retailprice")
    leg = lambda m: F.struct(F.round(price * m, 2).alias("strike"), F.round(F.col("p_size") / 100.0, 4).alias("impliedVolatility"), F.lit(None).cast("double").alias("bid"), F.lit(None).cast("double").alias("ask"))
    chain = F.struct(F.col("p_partkey").cast("string").alias("symbol"), price.alias("spot"), F.col("p_brand").alias("expiry"), F.array(leg(0.5), leg(1.0)).alias("calls"), F.array(leg(2.0)).alias("puts"))
    path = f"{_work(spark)}/chains"
    table(spark, d, "part").select(F.to_json(chain).alias("value")).write.text(path)
    return files.option_rows(spark.read.text(path), "value").select("symbol", "expiry", "side", "strike", "iv")


@query("SELECT md5(c_custkey::VARCHAR) AS point, c_custkey % 2 = 0 AS renewed, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '!' ELSE c_mktsegment END AS payload FROM customer")
def s34_vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Points under ids made from their key, upserted: the later batch wins and the others stay."""
    path = f"{_work(spark)}/points"
    c = table(spark, d, "customer").select("c_custkey", F.md5(F.col("c_custkey").cast("string").cast("binary")).alias("point"), "c_mktsegment")
    shard = F.substring("point", 1, 1).alias("shard")
    files.merge_partitions(spark, path, c.select("point", F.lit(False).alias("renewed"), F.col("c_mktsegment").alias("payload"), shard), ["point"], partition="shard")
    later = c.where("c_custkey % 2 = 0").select("point", F.lit(True).alias("renewed"), F.concat("c_mktsegment", F.lit("!")).alias("payload"), shard)
    files.merge_partitions(spark, path, later, ["point"], partition="shard")
    return spark.read.parquet(path).drop("shard")


@query("SELECT l_orderkey AS doc, l_linenumber AS line, l_returnflag AS direction, CASE WHEN l_suppkey % 4 = 0 THEN 'other' ELSE l_linestatus END AS desk, NULL::VARCHAR AS headline, NULL::DOUBLE AS magnitude FROM lineitem")
def s37_fact_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Facts widened to the columns a reader of the interface expects; a missing desk is 'other'."""
    desk = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_linestatus"))
    none = {"headline": "string", "magnitude": "double"}
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("direction"), F.coalesce(desk, F.lit("other")).alias("desk"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()])


@query("""WITH e AS (SELECT n_regionkey AS a, s_nationkey AS b, count(*) AS weight FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
SELECT 'edge' AS kind, a::VARCHAR AS id, b::VARCHAR AS other, weight FROM e UNION ALL SELECT 'node', 'r' || a, NULL, sum(weight)::BIGINT FROM e GROUP BY a""")
def s41_graph_export(spark: SparkSession, d: str) -> DataFrame:
    """Nodes and edges of a graph exported as JSON lines and CSV, then read back as one list."""
    work = _work(spark)
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("a"))
    e = table(spark, d, "supplier").join(n, "s_nationkey").groupBy("a", F.col("s_nationkey").alias("b")).agg(F.count("*").alias("weight"))
    e.write.option("header", True).csv(f"{work}/edges")
    e.groupBy("a").agg(F.sum("weight").alias("weight")).select(F.concat(F.lit("r"), F.col("a").cast("string")).alias("id"), "weight").write.json(f"{work}/nodes")
    edges = files.csv(spark, f"{work}/edges", "a string, b string, weight long")
    nodes = files.json_lines(spark, f"{work}/nodes", "id string, weight long")
    return edges.select(F.lit("edge").alias("kind"), F.col("a").alias("id"), F.col("b").alias("other"), "weight").unionByName(nodes.withColumn("kind", F.lit("node")), allowMissingColumns=True)


@query("SELECT doc_id, source, text FROM documents WHERE doc_id % 3 = 0")
def s07_first_parts(spark: SparkSession, d: str) -> DataFrame:
    """A corpus in days of three part files each; the feed reads the first one of a day."""
    path = f"{_work(spark)}/feed"
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 28).cast("int"))
    a = table(spark, d, "documents").select("doc_id", "source", "text", day.alias("dt"))
    # Each part of a day is a task of its own, so a task takes an 84th of the corpus.
    part = F.pmod("doc_id", F.lit(28)) * 3 + F.pmod("doc_id", F.lit(3))
    a.repartitionById(84, part.cast("int")).write.partitionBy("dt").parquet(path)
    return files.first_parts(spark, path, "doc_id long, source string, text string", 3).select("doc_id", "source", "text")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), f AS (SELECT o_orderkey AS fact_id, o_orderkey // 4 AS doc_id, CASE WHEN o_orderkey % 7 > 0 THEN epoch(o_orderdate)::BIGINT ELSE 0 END AS published_epoch,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END::DOUBLE AS direction, CASE o_orderkey % 3 WHEN 0 THEN (o_custkey % 90 + 10) / 100 WHEN 1 THEN (o_custkey % 90 + 10) END::DOUBLE AS magnitude, CASE WHEN o_orderpriority LIKE '1%' THEN 'top|urgent' ELSE lower(o_orderpriority) || '|top' END AS entities FROM orders WHERE o_orderkey % 11 <> 0)
SELECT fact_id, doc_id, published_epoch, direction, magnitude, entities, CASE WHEN x IS NOT NULL THEN round(sqrt(list_inner_product(x, x)) / sqrt(list_inner_product(x, x)), 6) END AS length FROM f LEFT JOIN e ON vec_id = fact_id""")
def s42_fact_export(spark: SparkSession, d: str) -> DataFrame:
    """Orders as facts, normalised and written as JSON lines with their unit vectors, and both read back."""
    path = f"{_work(spark)}/export"
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    figure = (F.col("o_custkey") % 90 + 10).cast("string")
    urgent = F.col("o_orderpriority").startswith("1")
    f = o.select(
        k.alias("fact_id"), F.expr("o_orderkey div 4").alias("doc_id"), F.when(k % 7 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon").alias("published"), F.when(k % 11 == 0, " ").otherwise("a claim").alias("claim"),
        F.lit(None).cast("string").alias("predicate"), F.when(F.col("o_orderstatus") == "F", "up").when(F.col("o_orderstatus") == "O", "down").alias("direction"), F.lit(None).cast("double").alias("confidence"),
        F.when(k % 3 == 0, F.concat(figure, F.lit(" bps"))).when(k % 3 == 1, F.concat(F.lit("about "), figure)).alias("magnitude"), F.lit("src").alias("source_name"), F.lit(None).cast("string").alias("desk"),
        F.when(urgent, F.array(F.lit(" URGENT"), F.lit("Top "), F.lit("urgent"), F.lit(""))).otherwise(F.array(F.upper("o_orderpriority"), F.lit("peak"))).alias("entities"), F.lit(None).cast("array<string>").alias("cause_entities"),
    )
    files.export_facts(f, table(spark, d, "embeddings").select(F.col("vec_id").alias("fact_id"), "embedding"), path, {"peak": "top"})
    back = files.json_lines(spark, f"{path}/facts", "fact_id long, doc_id long, published_epoch long, direction double, magnitude double, entities array<string>")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    both = back.join(spark.read.parquet(f"{path}/vectors"), "fact_id", "left")
    return both.select("fact_id", "doc_id", "published_epoch", "direction", "magnitude", F.array_join("entities", "|").alias("entities"), F.round(length, 6).alias("length"))


@query("""WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (page_id % 28)::INT AS day, page_id % 3 = 0 AS news FROM pages WHERE url IS NOT NULL)
SELECT url AS loc, CASE WHEN news THEN day + 1 ELSE day END::TIMESTAMP AS changed FROM p WHERE (page_id // 20) % 7 <> 6 AND CASE WHEN news THEN day + 1 ELSE day END >= DATE '2024-01-10'""")
def s20_sitemap_index(spark: SparkSession, d: str) -> DataFrame:
    """Landed sitemaps of twenty pages, every other one gzipped, some with news dates, listed by indexes that a root index lists."""
    k, escaped = F.expr("page_id div 20"), F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 28 + n).cast("int")).cast("string")
    news = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<n:news><n:publication_date>"), day(1), F.lit("</n:publication_date></n:news>"))).otherwise("")
    one = F.concat(F.lit("<url><loc> "), escaped, F.lit("</loc><lastmod>"), day(0), F.lit("</lastmod>"), news, F.lit("</url>"))
    sets = table(spark, d, "pages").where("url IS NOT NULL").groupBy(k.alias("k")).agg(F.concat_ws("", F.collect_list(one)).alias("inner"))
    whole = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:n="http://www.google.com/schemas/sitemap-news/0.9">'), "inner", F.lit("</urlset>"))
    index = lambda c: F.concat(F.lit("<sitemapindex>"), F.concat_ws("", F.collect_list(F.concat(F.lit("<sitemap><loc>"), c, F.lit("</loc></sitemap>")))), F.lit("</sitemapindex>"))
    listed = sets.where("k % 7 <> 6").select(F.concat(F.lit("set-"), "k").alias("loc"), F.expr("k div 50").alias("up"))
    indexes = listed.groupBy("up").agg(index("loc").alias("body")).select(F.concat(F.lit("index-"), "up").alias("url"), "body")
    # The root lists itself, too, and something that was never landed.
    roots = indexes.select("url").union(spark.createDataFrame([("root",), ("gone",)], "url string")).agg(index("url").alias("body")).select(F.lit("root").alias("url"), "body")
    plain = sets.select(F.concat(F.lit("set-"), "k").alias("url"), whole.alias("body"), (F.col("k") % 2 == 1).alias("zipped"))
    every = plain.unionByName(indexes.unionByName(roots).withColumn("zipped", F.lit(False)))
    landed = f"{_work(spark)}/sitemaps"
    every.select("url", F.when(F.col("zipped"), files.gzipped(F.col("body"))).otherwise(F.col("body").cast("binary")).alias("body")).write.parquet(landed)
    found = files.discover(files.sitemap_entries(spark.read.parquet(landed)), spark.createDataFrame([("root",)], "sitemap string"), "2024-01-10")
    return found.select("loc", F.col("changed").cast("timestamp_ntz").alias("changed"))
