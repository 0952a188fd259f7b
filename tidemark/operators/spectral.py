"""Spectra and correlations of panels (name, time, value)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators.drivers import correlation

#: Names of a part, pairs of a block, and pairs that are computed at once.
NAMES, PAIRS, CHUNK = 4000, 400_000, 50_000


def absorption(panel: DataFrame, group: str, name: str, index: str, value: str, size: int, least: int = 3) -> DataFrame:
    """``group, names, share``: the leading eigenvalue's share of the names' correlation matrix.

    Names by names and times by times have the same leading eigenvalue, so only the
    ``size`` x ``size`` sums over times ``index`` (0 to ``size`` - 1) are made, by one aggregation;
    the number of names bounds nothing.  A time that a name lacks counts as its mean;
    names with fewer than ``least`` times or without variance are left out.
    """
    w = W.partitionBy(group, name)
    known = panel.where(F.col(value).isNotNull()).withColumn("_n", F.count("*").over(w)).withColumn("_sd", F.stddev_samp(value).over(w))
    known = known.where((F.col("_n") >= least) & (F.col("_sd") > 1e-12))
    known = known.withColumn("_z", (F.col(value) - F.avg(value).over(w)) / F.col("_sd") / F.sqrt(F.col("_n") - 1))
    rows = known.groupBy(group, name).agg(*[F.coalesce(F.max(F.when(F.col(index) == i, F.col("_z"))), F.lit(0.0)).alias(f"_t{i}") for i in range(size)])
    cells = [(i, j) for i in range(size) for j in range(i, size)]
    sums = rows.groupBy(group).agg(F.count("*").alias("names"), *[F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")).alias(f"_g{i}_{j}") for i, j in cells])

    def leading(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            matrix = np.zeros((len(b), size, size))
            for i, j in cells:
                matrix[:, i, j] = matrix[:, j, i] = b[f"_g{i}_{j}"]
            yield pd.DataFrame({group: b[group], "names": b["names"], "share": np.linalg.eigvalsh(matrix)[:, -1] / b["names"] if len(b) else []})

    return sums.mapInPandas(leading, f"`{group}` {dict(panel.dtypes)[group]}, names long, share double")


def paired(pairs: DataFrame, panel: DataFrame, name: str, time: str, value: str, least: int) -> DataFrame:
    """Every row of ``pairs`` (with a, b) with ``n, corr`` over the times that both names have, ``least`` at least.

    A name has one row a time.  Names are dealt to parts, and a pair goes once to the block of its two
    parts, where the series of these names are; so pairs are never joined with times, nor met twice.
    """
    series = panel.where(F.col(time).isNotNull()).groupBy(F.col(name).alias("_name")).agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v"))).alias("_v"))
    parts = max(1, -(-panel.select(name).distinct().count() // NAMES))
    salts = max(1, -(-pairs.count() // (parts * parts * PAIRS)))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    left = pairs.withColumn("_i", part("a")).withColumn("_j", part("b")).withColumn("_s", F.pmod(F.xxhash64(*pairs.columns), F.lit(salts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(parts - 1))
    cells = F.array_union(F.transform(every, lambda j: F.struct(part("_name").alias("i"), j.alias("j"))), F.transform(every, lambda i: F.struct(i.alias("i"), part("_name").alias("j"))))
    right = series.select("_name", "_v", F.explode(cells).alias("_c")).select("_name", "_v", F.col("_c.i").alias("_i"), F.col("_c.j").alias("_j"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes) + ", n long, corr double"
    empty = pairs.sparkSession.createDataFrame([], schema).toArrow().schema

    def block(q: pa.Table, s: pa.Table) -> pa.Table:
        if not len(q) or not len(s):
            return empty.empty_table()
        row, flat = B.arrays(s["_v"])
        at = flat.field("t").dictionary_encode()
        x, there = np.full((len(s), len(at.dictionary)), np.nan), np.zeros((len(s), len(at.dictionary)), bool)
        place = at.indices.to_numpy(zero_copy_only=False)
        x[row, place] = pc.fill_null(flat.field("v"), float("nan")).to_numpy(zero_copy_only=False)
        there[row, place] = True
        known = s["_name"].combine_chunks()
        q = q.append_column("_a", pc.index_in(q["a"], value_set=known)).append_column("_b", pc.index_in(q["b"], value_set=known))
        q = q.filter(pc.and_(pc.is_valid(q["_a"]), pc.is_valid(q["_b"])))
        a, b = q["_a"].to_numpy(), q["_b"].to_numpy()
        n, c, empties = np.zeros(len(q), np.int64), np.zeros(len(q)), np.zeros(len(q), bool)
        for i in range(0, len(q), CHUNK):
            k = slice(i, i + CHUNK)
            p, r = x[a[k]], x[b[k]]
            n[k], c[k] = (there[a[k]] & there[b[k]]).sum(1), correlation(p, r, 1)
            empties[k] = ~(~np.isnan(p) & ~np.isnan(r)).any(1)
        found = q.append_column("n", pa.array(n)).append_column("corr", pa.array(c, mask=empties))
        return found.filter(pa.array(n >= least)).select(empty.names).cast(empty)

    keys = ["_i", "_j", "_s"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(block, schema)


def pair_correlation(pairs: DataFrame, panel: DataFrame, name: str, time: str, value: str, least: int) -> DataFrame:
    """``a, b, n, corr`` of stated pairs over the times that both have, ``least`` at least."""
    return paired(pairs.select("a", "b").distinct(), panel, name, time, value, least)
