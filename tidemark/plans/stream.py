"""Queries of the sources, sinks and incremental passes, driven as batches of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.graph import shared_folder
from tidemark.registry import query, table
from tidemark.sources import files as S
from tidemark.streaming import micro as M


def _work(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one in local tests."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def r09_tumbling_windows(spark: SparkSession, d: str) -> DataFrame:
    w = M.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"], "value", "1 day", None, "1 hour")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def r09_session_windows(spark: SparkSession, d: str) -> DataFrame:
    s = M.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["user_id"], "6 hours")
    return s.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1")
def r01_incremental_pass(spark: SparkSession, d: str) -> DataFrame:
    """The events through a stream of available micro-batches into a table, then read."""
    work = _work(spark)
    source = table(spark, d, "events")
    landed = f"{work}/landed"
    source.write.parquet(landed)
    into = f"{work}/sink"

    def each(batch: DataFrame, number: int) -> None:
        # A folder of its own: a batch that is run again after a failure replaces what it wrote.
        batch.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).write.mode("overwrite").parquet(f"{into}/batch={number}")

    M.incremental(spark.readStream.schema(source.schema).parquet(landed), each, f"{work}/checkpoint").start().awaitTermination()
    return spark.read.parquet(into).groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 3).alias("total"))


@query("SELECT event_id FROM events WHERE event_id % 5 = 0 OR ts >= TIMESTAMP '2024-01-19'")
def r02_recency_window(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("estimated", F.col("event_id") % 5 == 0)
    return M.recent(e, "ts", "estimated", F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")


@query("""WITH k AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id < 100), b AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id >= 50)
SELECT min(doc_id) AS doc_id FROM b WHERE doc_id NOT IN (SELECT doc_id FROM k) AND h NOT IN (SELECT h FROM k) GROUP BY h""")
def r03_stateful_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return M.new_rows(docs.where("doc_id >= 50"), docs.where("doc_id < 100"), [["doc_id"], ["h"]]).select("doc_id")


@query("""WITH l AS (SELECT user_id AS id, ts, (event_id % 7)::INT AS attempts, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'resolved' END AS status FROM events),
s AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC NULLS LAST, attempts DESC) = 1)
SELECT id, status, CASE status WHEN 'failed' THEN date_trunc('second', ts) + to_seconds([60, 300, 1800, 7200, 43200][least(greatest(attempts, 1), 5)]) WHEN 'pending' THEN ts END AS due FROM s""")
def r04_retry_state(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "pending").otherwise("resolved")
    log = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 7).cast("int").alias("attempts"), status.alias("status"))
    return M.retry_state(log, "id", "ts", "attempts", "status").select("id", "status", F.col("due").cast("timestamp_ntz").alias("due"))


@query("SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 40")
def o23_budgeted_queue(spark: SparkSession, d: str) -> DataFrame:
    return M.budgeted(table(spark, d, "events").where("event_type = 'error'"), [F.col("ts"), F.col("event_id")], 40).select("event_id")


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1 AND (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 3 = 0)")
def r10_insert_only(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return M.insert_only(l.where("l_orderkey % 3 = 0"), l.where("l_orderkey % 2 = 1"), ["l_orderkey", "l_linenumber"])


@query("""SELECT doc_id, CASE WHEN doc_id < 200 THEN 'new' ELSE 'old' END AS side FROM documents WHERE doc_id < 200 OR doc_id BETWEEN 100 AND 400""")
def s14_merge_new_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return S.merge(docs.where("doc_id BETWEEN 100 AND 400").withColumn("side", F.lit("old")), docs.where("doc_id < 200").withColumn("side", F.lit("new")), ["doc_id"])


@query("""SELECT doc_id, CASE WHEN doc_id BETWEEN 100 AND 400 THEN 'old' ELSE 'new' END AS side FROM documents WHERE doc_id < 200 OR doc_id BETWEEN 100 AND 400""")
def s15_merge_old_wins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return S.merge(docs.where("doc_id BETWEEN 100 AND 400").withColumn("side", F.lit("old")), docs.where("doc_id < 200").withColumn("side", F.lit("new")), ["doc_id"], new_wins=False)


@query("SELECT count(*) AS n FROM documents")
def s18_corpus_size(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, text IS NOT NULL AND (lag(md5(text)) OVER (PARTITION BY source ORDER BY doc_id)) IS DISTINCT FROM md5(text) AS changed FROM documents")
def s33_snapshot_ledger(spark: SparkSession, d: str) -> DataFrame:
    return S.snapshots(table(spark, d, "documents"), "source", "text", "doc_id").select("source", "doc_id", "changed")


@query("SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) // 12)::BIGINT AS batch FROM documents")
def s39_batch_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.numbered_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 12)


@query("SELECT source, doc_id FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 5 = 0")
def s48_systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.sampled(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"], 5)


@query("SELECT p_partkey AS id, p_name AS title, NULL::VARCHAR AS published FROM part")
def s06_field_aliases(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("ID"), F.col("p_name").alias("headline"))
    return S.aliased(rows, {"id": ["doc_id"], "title": ["headline"], "published": ["date", "published_at"]}).withColumn("published", F.col("published").cast("string"))


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS segment FROM orders UNION ALL SELECT 'customer', c_custkey, NULL, c_mktsegment FROM customer")
def s11_append_by_name(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return S.append_by_name(o, c)


@query("SELECT user_id AS symbol, date_trunc('second', ts) AS ts, round(value, 6) AS close FROM events")
def s10_chart_prices(spark: SparkSession, d: str) -> DataFrame:
    """Chart JSON made from the events of each user, then read back to rows."""
    e = table(spark, d, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("value").alias("v"), "event_id")
    rows = F.sort_array(F.collect_list(F.struct("t", "event_id", "v")))
    chart = F.struct(F.array(F.struct(rows["t"].alias("timestamp"), F.struct(F.array(F.struct(rows["v"].alias("close"))).alias("quote")).alias("indicators"))).alias("result"))
    raw = e.groupBy(F.col("user_id").alias("symbol")).agg(F.to_json(F.struct(chart.alias("chart"))).alias("body"))
    return S.chart_prices(raw, "symbol", "body").select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), F.round("close", 6).alias("close"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def d01_table_function(spark: SparkSession, d: str) -> DataFrame:
    """A SQL table function with the moment as its parameter."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION newest_as_of(moment TIMESTAMP_NTZ, at TIMESTAMP_NTZ) RETURNS BOOLEAN RETURN at <= moment")
    table(spark, d, "orders").createOrReplaceTempView("claims")
    return spark.sql("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k
      FROM claims WHERE newest_as_of(TIMESTAMP_NTZ '1995-01-01', o_orderdate)) WHERE k = 1""")
