"""Newest-wins views, as-of and interval joins, and bitemporal beliefs.

None of these joins by inequality alone: as-of joins are a union and a running last
value per key, interval joins meet on (key, time bucket).  Both stay linear in the rows
of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], rank: str | None = None, most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key in an order that must be total."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)
    return ranked if rank else ranked.drop(name)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], strict: bool = False, forward: bool = False) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before (``strict``: before) its time.

    ``forward`` takes the first row at or after instead.  Of right rows at one time the
    last by ``values`` counts.  Unmatched rows get nulls; rows of ``right`` with a null
    time never match.
    """
    payload = F.struct(F.col(right_time).alias("_at"), *[F.col(v) for v in values])
    own = [c for c in left.columns if c not in keys]
    side = 1 if strict else -1
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_value"))
    b = right.where(F.col(right_time).isNotNull()).select(*keys, F.col(right_time).alias("_t"), F.lit(side if not forward else -side).alias("_side"), F.lit(None).cast(left.select(F.struct(*own).alias("r")).schema["r"].dataType).alias("_row"), payload.alias("_value"))
    order = [F.col("_t").desc(), F.col("_side").desc(), F.col("_value")] if forward else [F.col("_t"), F.col("_side"), F.col("_value")]
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    return both.select(*keys, "_row.*", F.col("_value._at").alias(right_time), *[F.col(f"_value.{v}").alias(v) for v in values])


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """All pairs of equal keys whose times are within ``seconds``, with the gap as ``gap_seconds``.

    Each right row is filed under its time bucket and both neighbours, so the join has
    an equality on (key, bucket).
    """
    bucket = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = left.withColumn("_bucket", bucket(F.col(left_time)))
    b = right.withColumn("_bucket", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: bucket(F.col(right_time)) + i)))
    gap = F.abs(F.unix_timestamp(right_time) - F.unix_timestamp(left_time))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    within = F.abs(micros(right_time) - micros(left_time)) <= seconds * 1_000_000
    return a.join(b, [*keys, "_bucket"]).where(within).withColumn("gap_seconds", gap).drop("_bucket")


def hour_boundaries(a: Column, b: Column) -> Column:
    """Hour boundaries between two timestamps, as date differences count them."""
    hour = lambda c: F.unix_timestamp(F.date_trunc("hour", c))
    return ((hour(b) - hour(a)) / 3600).cast("long")


def current_belief(claims: DataFrame, keys: list[str], tier: str, knowable: str, ingested: str, tiebreak: list[str]) -> DataFrame:
    """One claim a key: best tier, then newest knowable, then newest ingested."""
    order = [F.col(tier).asc_nulls_last(), F.col(knowable).desc_nulls_last(), F.col(ingested).desc_nulls_last(), *map(F.col, tiebreak)]
    return first_per_key(claims, keys, order)


def belief_as_of(claims: DataFrame, keys: list[str], tier: str, knowable: str, moment: Column) -> DataFrame:
    """The claims that nothing knowable by ``moment`` beats; ties stay, unknowable claims go.

    Same as an anti join on dominance, by one ranking instead.
    """
    w = W.partitionBy(*keys).orderBy(F.col(tier).asc_nulls_last(), F.col(knowable).desc())
    known = claims.where(F.col(knowable) <= moment)
    return known.withColumn("_rank", F.rank().over(w)).where("_rank = 1").drop("_rank")


def revisions(claims: DataFrame, keys: list[str], observed: str, value: str, tiebreak: list[str]) -> DataFrame:
    """Claims whose value differs from the one before, with ``before`` and its date shift in days."""
    w = W.partitionBy(*keys).orderBy(F.col(observed).asc_nulls_first(), *map(F.col, tiebreak))
    out = claims.withColumn("before", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w))
    changed = ~F.col("before").eqNullSafe(F.col(value)) & (F.col("_n") > 1)
    return out.where(changed).withColumn("shift_days", F.datediff(value, "before")).drop("_n")


def resolve_alias(df: DataFrame, column: str, aliases: DataFrame, alias: str, target: str, newest: list[Column], out: str) -> DataFrame:
    """``out``: the newest mapping of ``column``, or the value itself where none is known."""
    latest = first_per_key(aliases, [alias], newest).select(F.col(alias).alias(column), F.col(target).alias("_to"))
    return df.join(latest, column, "left").withColumn(out, F.coalesce("_to", column)).drop("_to")
