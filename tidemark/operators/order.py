"""Running sums and ranks over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.graph import saved


def running_total(df: DataFrame, order: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to and with each one, in a total order.

    Rows are dealt out by ranges of the order and kept that way by a checkpoint; each
    range sums its own rows and adds the totals of the ranges before it, one row a range.
    """
    ranged = saved(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    totals = ranged.groupBy("_part").agg(F.sum("_v").alias("_t"))
    before = totals.select("_part", F.coalesce(F.sum("_t").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + F.sum("_v").over(w)).drop("_part", "_before", "_v")


def rank_all(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Row numbers from 1 in a total order."""
    return running_total(df, order, F.lit(1), out)


def tiles(rank: Column, rows: Column, parts: int) -> Column:
    """Which of ``parts`` near-equal parts a row number falls in; the first ones hold the extra rows."""
    each, extra = F.floor(rows / parts), rows % parts
    edge = extra * (each + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (each + 1)) + 1).otherwise(extra + F.floor((rank - 1 - edge) / F.greatest(each, F.lit(1))) + 1).cast("int")


#: Rows of one partition of :func:`dealt`, rows of a small table, and rows that a text counts for, as its terms are rows.
DEALT, SMALL, WIDE = 1 << 19, 1 << 21, 64


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in partitions of about ``DEALT`` of its ``rows`` rows, so that what one task sorts and groups does not grow with the table.

    A number of its own keeps partitions from being merged again; a small table is left to the session.
    """
    if rows <= SMALL:
        return df.repartition(*keys)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // DEALT)), *keys)
