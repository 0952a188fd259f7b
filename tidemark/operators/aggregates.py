"""Concentration, calibration, priors and profit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import market_fee


def herfindahl(df: DataFrame, group: list[str], member: str, distinct: str) -> DataFrame:
    """Sum of squared shares of each member's distinct items within a group."""
    counts = df.groupBy(*group, member).agg(F.countDistinct(distinct).alias("_n"))
    shares = counts.withColumn("_share", F.col("_n") / F.sum("_n").over(W.partitionBy(*group)))
    return shares.groupBy(*group).agg(F.sum(F.col("_share") ** 2).alias("hhi"), F.count("*").alias("members"))


def gini(counts: DataFrame, group: list[str], value: str, top: int = 10) -> DataFrame:
    """Gini coefficient and the share of the ``top`` largest, by rank-weighted sums."""
    up = W.partitionBy(*group).orderBy(F.col(value))
    down = W.partitionBy(*group).orderBy(F.col(value).desc())
    ranked = counts.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    n, total = F.count("*"), F.sum(value)
    g = (2 * F.sum(F.col("_up") * F.col(value)) / (n * total)) - (n + 1) / n
    return ranked.groupBy(*group).agg(g.alias("gini"), (F.sum(F.when(F.col("_down") <= top, F.col(value))) / total).alias("top_share"))


def calibration(df: DataFrame, price: str, outcome: str, bins: int = 10) -> DataFrame:
    """Mean price, realised share, standard error and edge per equal-width bin; empty bins stay."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(price) * bins)).cast("int")
    p = F.avg(outcome)
    found = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(price).alias("mean_price"), p.alias("realised"), F.sqrt(p * (1 - p) / F.count("*")).alias("se"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_price", "realised", "se", (F.col("realised") - F.col("mean_price")).alias("edge"))


def contiguous_rule(bins: DataFrame, order: str, qualifies: Column) -> DataFrame:
    """The bins before the first one that doesn't qualify."""
    ok = F.min(F.coalesce(qualifies, F.lit(False)).cast("int")).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return bins.withColumn("_ok", ok).where("_ok = 1").drop("_ok")


def selling_pnl(df: DataFrame, price: str, outcome: str, haircut: float) -> DataFrame:
    """Gross and net result of selling each contract: fee only, and fee with a haircut."""
    entry = 1 - F.col(price)
    gross = (1 - F.col(outcome)) - entry
    return df.withColumn("gross", gross).withColumn("net_fee", gross - market_fee(entry)).withColumn("net_all", gross - market_fee(entry) - haircut)


def mean_t(df: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """Mean, total, population standard error of the mean and t."""
    se = F.stddev_pop(value) / F.sqrt(F.count(value))
    return df.groupBy(*(group or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"), se.alias("se"), F.try_divide(F.avg(value), se).alias("t"))


def clustered_mean(df: DataFrame, value: str, cluster: list[str]) -> DataFrame:
    """Mean of cluster means with its sample standard error; clusters count once."""
    means = df.groupBy(*cluster).agg(F.avg(value).alias("_m"))
    se = F.stddev_samp("_m") / F.sqrt(F.count("_m"))
    return means.agg(F.count("_m").alias("clusters"), F.avg("_m").alias("mean"), se.alias("se"), F.try_divide(F.avg("_m"), se).alias("t"))


def class_prior(df: DataFrame, cls: str, value: str, least: int = 20) -> DataFrame:
    """Mean, population deviation and count per class; small classes take the global values."""
    by = df.groupBy(cls).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("n"))
    all_ = df.agg(F.avg(value).alias("_gm"), F.stddev_pop(value).alias("_gs"))
    small = F.col("n") < least
    return by.join(F.broadcast(all_)).select(cls, "n", F.when(small, F.col("_gm")).otherwise(F.col("_m")).alias("prior"), F.when(small, F.col("_gs")).otherwise(F.col("_s")).alias("prior_sd"))


def rolling_prior(df: DataFrame, cls: str, day: str, value: str, grid: DataFrame, window: int, least: int) -> DataFrame:
    """Class priors at grid days over the ``window`` days before each.

    Day sums are made first, so the join meets (class, day) rows and each is filed
    under the grid days that it can reach.
    """
    sums = df.groupBy(cls, day).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) ** 2).alias("_q"))
    reach = grid.select(F.col(day).alias("as_of"), F.explode(F.sequence(F.date_sub(day, window), F.date_sub(day, 1))).alias(day))
    found = sums.join(reach, day).groupBy(cls, "as_of").agg(F.sum("_n").alias("n"), (F.sum("_s") / F.sum("_n")).alias("prior"), F.sqrt(F.greatest(F.sum("_q") / F.sum("_n") - (F.sum("_s") / F.sum("_n")) ** 2, F.lit(0.0))).alias("prior_sd"))
    return found.where(F.col("n") >= least)


def wilson(successes: Column, n: Column, z: float = 1.64) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p = F.try_divide(successes, n)
    centre = p + z * z / (2 * n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (centre - half) / scale, (centre + half) / scale


def gate_verdict(observed: Column, prior: Column, prior_sd: Column, control: Column) -> dict[str, Column]:
    """Whether a move stands out from its class's prior and from days without events.

    Fails where there is no prior, the move is within control, the class is no larger than
    control, or the surprise is not positive; else graded by the surprise in deviations.
    """
    surprise = observed - prior
    z = F.when(prior_sd > 0, surprise / prior_sd).otherwise(0.0)
    failed = F.when(prior.isNull(), "class_not_measurable").when(observed < control, "below_control").when(prior <= control, "class_not_distinguishable").when(surprise <= 0, "no_surprise")
    tier = F.when(failed.isNotNull(), "INSUFFICIENT").when(z < 0.35, "WEAK").when(z < 0.9, "MODERATE").otherwise("STRONG")
    return {"gate_failed": failed, "confidence": tier, "surprise": surprise, "surprise_z": z, "do_not_narrate": failed.isNotNull()}
