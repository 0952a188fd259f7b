"""Readers and writers of landed files: tolerant JSON lines, aliased CSV, nested price JSON, calendars, sitemaps and partition merges."""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import text as TX
from tidemark.functions import vector as V
from tidemark.operators.graph import saved
from tidemark.operators.order import rank_all

ARTICLE = "doc_id string, source_name string, source_scope string, source_tier int, source_access string, source_method string, source_domain string, desks array<string>, discovery string, title string, body_text string, author string, url string, canonical_url string, lang string, word_count int, extraction_ok boolean, published_utc string, published_date string, published_is_estimated boolean, fetched_utc string, content_hash string"


def corpus(spark: SparkSession, root: str, start: str | None = None, end: str | None = None, desk: str | None = None, source: str | None = None, full_body: bool = False) -> DataFrame:
    """Articles partitioned by ``dt``; date bounds prune partitions as well as rows."""
    df = spark.read.schema(f"{ARTICLE}, dt date").option("basePath", root).parquet(root)
    if start:
        df = df.where((F.col("dt") >= F.lit(start).cast("date")) & (F.col("published_date") >= start))
    if end:
        df = df.where((F.col("dt") <= F.lit(end).cast("date")) & (F.col("published_date") <= end))
    if desk:
        df = df.where(F.array_contains("desks", desk))
    if source:
        df = df.where(F.col("source_name") == source)
    if full_body:
        df = df.where("extraction_ok AND body_text IS NOT NULL")
    return df


def first_parts(spark: SparkSession, root: str, schema: str, parts: int | None = None) -> DataFrame:
    """A feed over a corpus partitioned by ``dt`` that reads only the first part file of each day.

    ``parts`` says that part files are numbered through, so many a day, as when each part of a day has been a
    task of its own; then a first one is that whose number they divide.  The driver sees names of files, no rows.
    """
    read = spark.read.schema(f"{schema}, dt date").option("basePath", root)
    if parts is None:
        return read.option("pathGlobFilter", "part-00000-*").parquet(root)
    first = [f for f in read.parquet(root).inputFiles() if (n := re.search(r"/part-(\d+)-[^/]*$", f)) and int(n[1]) % parts == 0]
    return read.parquet(*first) if first else read.parquet(root).limit(0)


def export_facts(facts: DataFrame, vectors: DataFrame, path: str, aliases: dict[str, str] | None = None) -> None:
    """Facts for the map fits: normalised records as JSON lines, and the unit vectors of the same facts beside them.

    ``facts`` has fact_id, doc_id, published, claim, predicate, direction, confidence, magnitude,
    source_name, desk, entities, cause_entities as text (the last two arrays); ``vectors``
    fact_id, embedding.  Facts without a claim are left out; names are lower-cased, mapped by
    ``aliases``, distinct and in order; unknown times are 0, unknown magnitudes null.
    """
    known = {k.lower(): v for k, v in (aliases or {}).items()}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else None
    low = lambda e: F.lower(F.trim(e))
    name = lambda e: F.coalesce(F.try_element_at(table, low(e)), low(e)) if table is not None else low(e)
    names = lambda c: F.array_sort(F.array_distinct(F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda e: F.trim(e) != ""), name)))
    rows = facts.where("trim(claim) <> ''").select(
        "fact_id", "doc_id", F.coalesce(TX.epoch(F.try_to_timestamp("published")), F.lit(0).cast("long")).alias("published_epoch"), F.substring("published", 1, 10).alias("date"),
        F.substring("claim", 1, 240).alias("claim"), F.coalesce("predicate", F.lit("other")).alias("predicate"), TX.direction_sign(F.col("direction")).cast("double").alias("direction"),
        F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), TX.number_in(F.col("magnitude")).alias("magnitude"), F.coalesce("source_name", F.lit("")).alias("source_name"),
        F.coalesce("desk", F.lit("other")).alias("desk"), names(F.col("entities")).alias("entities"), names(F.col("cause_entities")).alias("cause_entities"),
    )
    rows.write.option("ignoreNullFields", "false").json(f"{path}/facts")
    vectors.join(rows.select("fact_id"), "fact_id", "left_semi").select("fact_id", V.unit(F.col("embedding")).alias("vector")).write.parquet(f"{path}/vectors")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and malformed ones are skipped."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad IS NULL").drop("_bad")


def aliased(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Canonical columns from the first present, non-null alias; the case of names doesn't count."""
    have = {c.lower(): c for c in df.columns}
    out: list[Column] = []
    for name, options in aliases.items():
        found = [F.col(have[o.lower()]) for o in [name, *options] if o.lower() in have]
        out.append((F.coalesce(*found) if found else F.lit(None)).alias(name))
    return df.select(*out)


def csv(spark: SparkSession, path: str, schema: str | None = None, drop_bad: bool = True) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED" if drop_bad else "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A table by its file's extension."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return spark.read.json(path)
    raise ValueError(f"no reader for .{kind}")


CHART = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<close: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"


def chart_prices(raw: DataFrame, symbol: str, body: str) -> DataFrame:
    """``symbol, ts, close`` from chart JSON: arrays side by side, adjusted closes where there are any."""
    r = raw.select(symbol, F.from_json(body, CHART).alias("j")).select(symbol, F.explode("j.chart.result").alias("r"))
    closes = F.coalesce(F.col("r.indicators.adjclose")[0]["adjclose"], F.col("r.indicators.quote")[0]["close"])
    rows = r.select(symbol, F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), closes.alias("close"))).alias("x"))
    return rows.select(symbol, F.timestamp_seconds("x.t").alias("ts"), F.col("x.close").alias("close")).where("close IS NOT NULL")


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``loc, lastmod`` of a landed sitemap."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def gzipped(text: Column) -> Column:
    """A text's gzip form; the same text, the same bytes."""

    @F.pandas_udf("binary")
    def pack(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: gzip.compress(t.encode(), mtime=0), na_action="ignore")

    return pack(text)


def _sitemap_rows(body: bytes | None) -> list[tuple[bool, str, str | None]]:
    """Whether it is a child sitemap, location and last change, of an index or a set of URLs; names without their namespaces."""
    name = lambda e: e.tag.rpartition("}")[2]
    inside = lambda e, n: next(((c.text or "").strip() for c in e if name(c) == n), None)
    try:
        root = ElementTree.fromstring(gzip.decompress(body) if body[:2] == b"\x1f\x8b" else body)
    except (ElementTree.ParseError, OSError, EOFError, zlib.error, TypeError):
        return []
    out = []
    for e in root:
        loc = inside(e, "loc")
        if loc and name(root) == "sitemapindex":
            out.append((True, loc, None))
        elif loc and name(root) == "urlset":
            news = next((inside(c, "publication_date") for c in e if name(c) == "news"), None)
            out.append((False, loc, news or inside(e, "lastmod")))
    return out


def sitemap_entries(landed: DataFrame, url: str = "url", body: str = "body") -> DataFrame:
    """``sitemap, child, loc, changed`` from landed bodies, plain or gzipped; what is no sitemap gives no rows.

    ``changed`` is the news publication date where there is one, else the last change, null
    where neither is a time.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(u, *r) for u, v in zip(b[url], b[body], strict=True) for r in _sitemap_rows(v)]
            yield pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(("sitemap", "child", "loc", "told"), zip(*rows, strict=True) if rows else ((),) * 4, strict=True)})

    found = landed.select(F.col(url).cast("string").alias(url), F.col(body).cast("binary").alias(body)).mapInPandas(parse, "sitemap string, child boolean, loc string, told string")
    return found.select("sitemap", "child", "loc", F.try_to_timestamp("told").alias("changed"))


def discover(entries: DataFrame, seeds: DataFrame, since: str | None = None) -> DataFrame:
    """``loc, changed`` of all pages that the seed sitemaps lead to through indexes; old ones are left out.

    ``entries`` comes from :func:`sitemap_entries`, ``seeds`` has sitemap.  A round follows one level of
    indexes, each sitemap once, so circles end.
    """
    entries = saved(entries)
    links = entries.where("child").select("sitemap", F.col("loc").alias("to"))
    seen = front = saved(seeds.select("sitemap").distinct())
    while not front.isEmpty():
        front = saved(links.join(front, "sitemap").select(F.col("to").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti"))
        seen = saved(seen.union(front))
    pages = entries.where("NOT child").join(seen, "sitemap", "left_semi")
    if since:
        pages = pages.where(F.col("changed").isNull() | (F.col("changed") >= F.lit(since).cast("timestamp")))
    return pages.select("loc", "changed")


def calendar_events(spark: SparkSession, path: str) -> DataFrame:
    """``uid, summary, starts`` of landed iCalendar files: folded lines joined, one row an event."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r?\n[ \t]", "").alias("v"))
    events = text.select(F.explode(F.regexp_extract_all("v", F.lit(r"(?s)BEGIN:VEVENT(.*?)END:VEVENT"), F.lit(1))).alias("e"))
    field = lambda n: F.nullif(F.trim(F.regexp_extract("e", rf"(?m)^{n}(?:;[^:\r\n]*)?:([^\r\n]*)", 1)), F.lit(""))
    zone = F.nullif(F.regexp_extract("e", r"(?m)^DTSTART;[^:\r\n]*TZID=([^:;\r\n]*)", 1), F.lit(""))
    raw = field("DTSTART")
    at = F.coalesce(F.try_to_timestamp(F.regexp_replace(raw, "Z$", ""), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(raw, F.lit("yyyyMMdd")))
    return events.select(field("UID").alias("uid"), field("SUMMARY").alias("summary"), F.coalesce(F.to_utc_timestamp(at, zone), at).alias("starts"))


def option_rows(raw: DataFrame, body: str) -> DataFrame:
    """One row a contract from nested calls and puts."""
    leg = "array<struct<strike: double, impliedVolatility: double, bid: double, ask: double>>"
    r = raw.select(F.from_json(body, f"symbol string, spot double, expiry string, calls {leg}, puts {leg}").alias("j"))
    sides = [r.select("j.symbol", "j.spot", "j.expiry", F.lit(k[:-1]).alias("side"), F.explode(f"j.{k}").alias("x")) for k in ("calls", "puts")]
    return sides[0].unionByName(sides[1]).select("symbol", "spot", "expiry", "side", "x.strike", F.col("x.impliedVolatility").alias("iv"), "x.bid", "x.ask")


def snapshots(raw: DataFrame, source: str, body: str, fetched: str) -> DataFrame:
    """Content-addressed ledger: digest of each fetch and whether it differs from the last of its source."""
    digest = F.sha2(F.col(body).cast("binary"), 256)
    last = F.lag("sha256").over(W.partitionBy(source).orderBy(fetched, "sha256"))
    return raw.select(source, fetched, digest.alias("sha256")).withColumn("changed", ~F.col("sha256").eqNullSafe(last))


def merge(old: DataFrame, new: DataFrame, keys: list[str], new_wins: bool = True) -> DataFrame:
    """Union by key with one side's rows first: an anti join and a union."""
    first, second = (new, old) if new_wins else (old, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)


def merge_partitions(spark: SparkSession, root: str, new: DataFrame, keys: list[str], partition: str = "dt", new_wins: bool = True) -> None:
    """Upsert ``new`` into a table partitioned by ``partition``; other partitions stay as they are.

    An unreadable old table stops the merge before anything is written.  The merged
    rows go to a side folder first, as a table can't be overwritten while it is read.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    exists = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    merged = new
    if exists:
        old = spark.read.parquet(root)
        touched = new.select(F.col(partition).cast(old.schema[partition].dataType)).distinct()
        merged = merge(old.join(F.broadcast(touched), partition, "left_semi"), new.withColumn(partition, F.col(partition).cast(old.schema[partition].dataType)), keys, new_wins)
    side = f"{root.rstrip('/')}__merge"
    merged.write.mode("overwrite").partitionBy(partition).parquet(side)
    staged = spark.read.schema(merged.schema).parquet(side)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(root)
    old_path = jvm.org.apache.hadoop.fs.Path(side)
    old_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old_path, True)


def append_by_name(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows added by column name; columns that either side lacks become null."""
    return table.unionByName(rows, allowMissingColumns=True)


def numbered_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``batch``: rows in a total order, ``size`` a batch; no task sees all rows."""
    return rank_all(df, order, "_n").withColumn("batch", F.floor((F.col("_n") - 1) / size)).drop("_n")


def sampled(df: DataFrame, group: list[str], order: list[str], every: int) -> DataFrame:
    """Every ``every``-th row of each group in order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1).where(F.col("_n") % every == 0).drop("_n")


FACT = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("claim", "subject", "predicate", "object", "direction", "magnitude", "time", "cause")] + [T.StructField("entities", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType())])
)


def explode_facts(documents: DataFrame, doc_id: str, facts: str) -> DataFrame:
    """One row a fact with a positional id; blank claims go, unknown directions become ``na``."""
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.posexplode(facts).alias("i", "f")).where("f.claim IS NOT NULL AND trim(f.claim) <> ''")
    fid = F.substring(F.sha2(F.concat_ws("|", "doc_id", "i", "f.claim").cast("binary"), 256), 1, 20)
    return rows.select(fid.alias("fact_id"), "doc_id", "f.*").withColumn("direction", F.when(F.col("direction").isin("up", "down", "flat"), F.col("direction")).otherwise("na"))
