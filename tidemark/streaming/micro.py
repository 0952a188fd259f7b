"""Incremental passes as Structured Streaming: deduplication, late data, retry state and windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

#: Seconds to wait after each failed attempt.
BACKOFF = [60, 300, 1800, 7200, 43200]


def recent(df: DataFrame, published: str, estimated: str, since: Column) -> DataFrame:
    """Drops rows older than a day before ``since``, unless their date is an estimate."""
    return df.where(F.col(estimated) | (F.col(published) >= since - F.expr("INTERVAL 1 DAY")))


def new_rows(batch: DataFrame, known: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Rows of a batch that no key has seen before, in the state or earlier in the batch.

    The first row by the batch's columns counts as earlier.
    """
    out = batch
    for key in keys:
        out = out.join(known.select(*key).distinct(), key, "left_anti")
        out = out.withColumn("_k", F.row_number().over(W.partitionBy(*key).orderBy(*[c for c in batch.columns]))).where("_k = 1").drop("_k")
    return out


def incremental(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """One pass over what has arrived since the last: every available micro-batch, then stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def deduplicated(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drops repeats that come within ``delay`` of each other; state older than that is forgotten."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], value: str, size: str, slide: str | None, delay: str) -> DataFrame:
    """Count and sum a tumbling or sliding window; windows close once the watermark passes them."""
    win = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, delay).groupBy(win, *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select("window.start", *keys, "n", "total")


def sessions(df: DataFrame, at: str, keys: list[str], gap: str) -> DataFrame:
    return df.groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", *keys, "n")


def retry_state(log: DataFrame, key: str, at: str, attempts: str, status: str) -> DataFrame:
    """Last line of each key with the moment it may be tried again; resolved ones never are."""
    w = W.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(attempts).desc_nulls_last())
    last = log.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    wait = F.get(F.array(*[F.lit(s) for s in BACKOFF]), F.least(F.greatest(F.col(attempts), F.lit(1)), F.lit(len(BACKOFF))) - 1)
    due = F.when(F.col(status) == "failed", F.timestamp_seconds(F.unix_timestamp(at) + wait)).when(F.col(status) == "pending", F.col(at))
    return last.withColumn("due", due)


def due(state: DataFrame, now: Column, status: str) -> DataFrame:
    """Keys that may be tried at ``now``: pending ones and failed ones whose wait is over."""
    return state.where((F.col(status) == "pending") | ((F.col(status) == "failed") & (F.col("due") <= now)))


def budgeted(queue: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a run, in order."""
    return queue.orderBy(*order).limit(most)


def insert_only(log: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the log lacks, so a replay adds nothing."""
    return rows.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")
