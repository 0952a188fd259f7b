"""Inference on tables: rank correlation, intervals, bootstraps, AUC and cluster-robust errors.

Resampling aggregates to clusters first and draws Poisson(1) weights from a hash of
(cluster, draw), so a draw needs no row order, no collected data and no driver loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.order import rank_all, running_total, tiles
from tidemark.operators.series import corr


def ordinal_ranks(df: DataFrame, group: list[str], columns: list[str], tiebreak: list[str]) -> DataFrame:
    """Ranks with ties broken by ``tiebreak``, as ``<column>_rank``."""
    for c in columns:
        df = df.withColumn(f"{c}_rank", F.row_number().over(W.partitionBy(*group).orderBy(c, *tiebreak)))
    return df


def rank_ic(df: DataFrame, group: list[str], x: str, y: str, tiebreak: list[str], least: int = 5) -> DataFrame:
    """Rank correlation per group of at least ``least`` rows."""
    r = ordinal_ranks(df, group, [x, y], tiebreak)
    return r.groupBy(*group).agg(corr(F.col(f"{x}_rank"), F.col(f"{y}_rank")).alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def partial_corr(xy: Column, xz: Column, yz: Column) -> Column:
    """Correlation of x and y with z held, from the three plain ones."""
    return F.try_divide(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


def auc(df: DataFrame, label: str, score: str, group: list[str] | None = None) -> DataFrame:
    """Mann-Whitney area with averaged ties, from one row a distinct score.

    Scores are counted first, so the running sum walks distinct scores, of a group or
    in ranges of the whole table.
    """
    keys = group or []
    counts = df.groupBy(*keys, F.col(score).alias("_s")).agg(F.sum(F.col(label)).alias("_p"), F.count("*").alias("_n"))
    if keys:
        w = W.partitionBy(*keys).orderBy("_s").rowsBetween(W.unboundedPreceding, 0)
        parts = counts.withColumn("_up_to", F.sum(F.col("_n") - F.col("_p")).over(w))
    else:
        parts = running_total(counts, ["_s"], F.col("_n") - F.col("_p"), "_up_to")
    parts = parts.withColumn("_below", F.col("_up_to") - (F.col("_n") - F.col("_p")))
    wins = F.sum(F.col("_p") * (F.col("_below") + (F.col("_n") - F.col("_p")) / 2))
    pairs = F.sum("_p") * (F.sum("_n") - F.sum("_p"))
    return parts.groupBy(*keys).agg(F.try_divide(wins, pairs).alias("auc"), F.sum("_p").alias("positives"), F.sum("_n").alias("n"))


def poisson_weight(key: Column, draw: Column, seed: int) -> Column:
    """A Poisson(1) weight decided by a hash: the same whenever and wherever it is drawn."""
    u = F.pmod(F.xxhash64(key, draw, F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    cuts, total, p = [], 0.0, 0.36787944117144233
    for k in range(7):
        total += p
        cuts.append(total)
        p /= k + 1
    out = F.lit(len(cuts))
    for k in reversed(range(len(cuts))):
        out = F.when(u < cuts[k], k).otherwise(out)
    return out


def bootstrap_mean(df: DataFrame, cluster: list[str], value: str, draws: int = 400, low: float = 0.05, high: float = 0.95, seed: int = 7) -> DataFrame:
    """Mean and its interval, resampling whole clusters (rows, dates or series)."""
    sums = df.groupBy(*cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    reps = sums.withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_weight(F.struct(*cluster), F.col("_b"), seed))
    means = reps.groupBy("_b").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    band = means.agg(F.percentile("_m", F.array(F.lit(low), F.lit(high))).alias("_q"), F.stddev_samp("_m").alias("se"))
    whole = sums.agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.count("*").alias("clusters"))
    return whole.join(F.broadcast(band)).select("mean", "clusters", "se", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("high"))


def clustered_se(df: DataFrame, value: str, cluster: list[str]) -> DataFrame:
    """Mean with its one-way cluster-robust standard error and the small-sample factor."""
    m = df.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    scores = df.join(F.broadcast(m)).groupBy(*cluster).agg(F.sum(F.col(value) - F.col("mean")).alias("_g"), F.first("mean").alias("mean"), F.first("n").alias("n"))
    g = F.count("*")
    return scores.agg(F.first("mean").alias("mean"), F.first("n").alias("n"), g.alias("clusters"), (F.sqrt(F.sum(F.col("_g") ** 2) * g / (g - 1)) / F.first("n")).alias("se"))


def dyadic_se(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Mean over pairs with an error robust to shared members: node sums less pair sums."""
    m = df.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    u = df.join(F.broadcast(m)).withColumn("_u", F.col(value) - F.col("mean"))
    nodes = u.select(F.col(a).alias("_k"), "_u").union(u.select(b, "_u")).groupBy("_k").agg(F.sum("_u").alias("_s")).agg(F.sum(F.col("_s") ** 2).alias("node_part"))
    own = u.agg(F.sum(F.col("_u") ** 2).alias("pair_part"), F.first("mean").alias("mean"), F.first("n").alias("n"))
    return own.join(F.broadcast(nodes)).select("mean", "n", (F.sqrt(F.greatest(F.col("node_part") - F.col("pair_part"), F.lit(0.0))) / F.col("n")).alias("se"))


def mcnemar(df: DataFrame, a: str, b: str) -> DataFrame:
    """Discordant counts of two paired outcomes and the continuity-corrected statistic."""
    only_a, only_b = F.count_if((F.col(a) == 1) & (F.col(b) == 0)), F.count_if((F.col(a) == 0) & (F.col(b) == 1))
    return df.agg(only_a.alias("only_a"), only_b.alias("only_b"), F.try_divide(F.greatest(F.abs(only_a - only_b) - 1, F.lit(0)) ** 2, only_a + only_b).alias("chi2"))


def risk_coverage(df: DataFrame, confidence: str, correct: str, tiebreak: str, steps: int = 10) -> DataFrame:
    """Accuracy of the most confident 10 %, 20 % ... of rows.

    Row numbers come from ranges of the confidence; the cumulative sums walk the ``steps`` parts.
    """
    rows = df.select((-F.col(confidence)).alias("_conf"), tiebreak, F.col(correct).cast("int").alias("_c"))
    ranked = rank_all(rows, ["_conf", tiebreak], "_rank").join(F.broadcast(rows.agg(F.count("*").alias("_all"))))
    parts = ranked.groupBy(tiles(F.col("_rank"), F.col("_all"), steps).alias("step")).agg(F.sum("_c").alias("_c"), F.count("*").alias("_n"))
    w = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)
    return parts.select("step", F.sum("_n").over(w).alias("n"), (F.sum("_c").over(w) / F.sum("_n").over(w)).alias("accuracy"))
