"""Do correlations that stand stay: all pairs of names of a window, by blocks, apart by whether news links them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators.drivers import TILE, correlated, correlation, likely, shapes, steps
from tidemark.operators.exposure import matrix, together

#: Names of a block; parts of a window up to which a block holds no more, so that what is sent grows with the names; and names of a block at most.
ROWS, PARTS, MOST = 1500, 16, 32_768
SUMS = ["n", "kept", "before", "after"]


def standing(series: DataFrame, floor: float, least: tuple[int, int]) -> DataFrame:
    """``window, n, kept, before, after`` over all pairs of a window's names that correlate above ``floor`` before.

    ``series`` has window, name, x, y: the days before and after.  ``kept`` counts pairs at least as
    correlated afterwards; ``before`` and ``after`` are sums.  ``least`` are the common days that
    each needs.  Each pair is looked at in one block of names by names, and a block gives one row.
    """
    most = series.groupBy("window").count().agg(F.max("count")).first()[0] or 0
    parts = max(1, -(-most // ROWS))
    dealt = series.select("window", F.col("name").alias("name"), F.col("x").alias("x"), F.col("y").alias("y")).withColumn("_part", F.pmod(F.xxhash64("name"), F.lit(parts)).cast("int"))
    left = dealt.withColumn("_i", F.col("_part")).withColumn("_j", F.explode(F.sequence(F.col("_part"), F.lit(parts - 1))))
    right = dealt.select(*[F.col(c).alias(c) for c in dealt.columns]).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_part")))).withColumn("_j", F.col("_part"))
    kind = dict(series.dtypes)["window"]

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("window", *SUMS)})
        before, after = together(matrix(a["x"]), matrix(b["x"]), least[0]), together(matrix(a["y"]), matrix(b["y"]), least[1])
        ok = (before > floor) & (after == after)
        if a["_i"].iloc[0] == a["_j"].iloc[0]:
            ok &= a["name"].to_numpy()[:, None] < b["name"].to_numpy()[None, :]
        x, y = before[ok], after[ok]
        return pd.DataFrame({"window": [a["window"].iloc[0]], "n": [int(ok.sum())], "kept": [int((y >= x).sum())], "before": [x.sum()], "after": [y.sum()]})

    by = ["window", "_i", "_j"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(count, f"window {kind}, n long, kept long, before double, after double")
    return found.groupBy("window").agg(*[F.sum(c).alias(c) for c in SUMS])


def of_pairs(pairs: DataFrame, series: DataFrame, floor: float, least: tuple[int, int]) -> DataFrame:
    """The same sums over stated pairs ``window, a, b``."""
    side = lambda n, x, y: series.select("window", F.col("name").alias(n), F.col("x").alias(x), F.col("y").alias(y))
    both = pairs.distinct().join(side("a", "xa", "ya"), ["window", "a"]).join(side("b", "xb", "yb"), ["window", "b"])

    def corr(days: int):
        @F.pandas_udf("double")
        def one(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(correlation(matrix(x), matrix(y), days)) if len(x) else pd.Series([], dtype=float)

        return one

    both = both.withColumn("before", corr(least[0])("xa", "xb")).withColumn("after", corr(least[1])("ya", "yb"))
    both = both.where(F.col("before") > floor).where(~F.isnan("before") & F.col("after").isNotNull() & ~F.isnan("after"))
    return both.groupBy("window").agg(F.count("*").alias("n"), F.count_if(F.col("after") >= F.col("before")).alias("kept"), F.sum("before").alias("before"), F.sum("after").alias("after"))


def persistence(series: DataFrame, linked: DataFrame, floor: float = 0.3, least: tuple[int, int] = (15, 8)) -> DataFrame:
    """``linked, n, kept, before, after``: shares and means over pairs that news links and over all others."""
    news = of_pairs(linked, series, floor, least).select(F.lit(1).alias("linked"), *SUMS)
    rest = standing(series, floor, least).select(F.lit(0).alias("linked"), *SUMS).union(news.select(F.lit(0), *[-F.col(c) for c in SUMS]))
    sums = news.union(rest).groupBy("linked").agg(*[F.sum(c).alias(c) for c in SUMS]).where("n > 0")
    return sums.select("linked", "n", *[(F.col(c) / F.col("n")).alias(c) for c in SUMS[1:]])


def by_member(series: DataFrame, members: DataFrame, floor: float = 0.3, least: tuple[int, int] = (15, 8)) -> DataFrame:
    """The same as ``persistence``, where news links two names that a driver of a window has both.

    ``members`` has window, driver, name.  A name carries its drivers into the blocks, so links are
    never rows: a driver's pairs are its names squared.
    """
    # Drivers by place in their window; a window has as many rows here as drivers.
    of = members.select("window", "driver").distinct()
    of = of.withColumn("place", F.row_number().over(W.partitionBy("window").orderBy("driver")) - 1)
    own = members.join(of, ["window", "driver"]).groupBy("window", "name").agg(F.collect_set("place").alias("own"))
    # A name of fewer days than a pair needs is in none.
    days = lambda c: F.size(F.filter(c, lambda v: v.isNotNull()))
    rows = series.where((days("x") >= least[0]) & (days("y") >= least[1])).join(own, ["window", "name"], "left").withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    n = F.count("*")
    sizes = rows.groupBy("window").agg(F.greatest(F.least(F.ceil(n / ROWS), F.lit(PARTS)), F.ceil(n / MOST)).alias("parts"))
    rows = rows.join(F.broadcast(sizes), "window").select("window", "name", "x", "y", "own", "parts")

    def side(t: pa.Table) -> tuple[np.ndarray, ...]:
        (a, p, s), (b, q, _) = shapes(B.matrix(t["x"])), shapes(B.matrix(t["y"]))
        return t["name"].to_numpy(), a, p, b, q, *s

    def bits(t: pa.Table, known: np.ndarray) -> np.ndarray:
        """Which of the known drivers each row has, a bit each."""
        row, own = B.arrays(t["own"])
        own = own.to_numpy(zero_copy_only=False)
        at = np.searchsorted(known, own)
        has = np.append(known, -1)[at] == own
        held = np.zeros((len(t), len(known) // 8 + 1), np.uint8)
        np.bitwise_or.at(held, (row[has], at[has] >> 3), (1 << (at[has] & 7)).astype(np.uint8))
        return held

    def count(left: pa.Table, right: pa.Table, same: bool) -> pa.Table:
        one = side(left)
        two = one if same else side(right)
        known = np.intersect1d(*(B.arrays(t["own"])[1].to_numpy(zero_copy_only=False) for t in (left, right)))
        of_a = bits(left, known)
        of_b = of_a if same else bits(right, known)
        sums = np.zeros((2, 4))
        for i in range(0, len(left), TILE):
            for j in range(i if same else 0, len(right), TILE):
                (m, a, p, x, u, *s), (n, b, q, y, v, *t) = ([k[at : at + TILE] for k in o] for o, at in ((one, i), (two, j)))
                r, c = likely(s, t, floor, least[0])
                if same and i == j:
                    keep = m[r] < n[c]
                    r, c = r[keep], c[keep]
                for r, c in steps(r, c):  # noqa: PLW2901, B020
                    before = correlated(a[r], p[r], b[c], q[c], least[0], 1e-12)
                    keep = before > floor
                    r, c, before = r[keep], c[keep], before[keep]  # noqa: PLW2901
                    after = correlated(x[r], u[r], y[c], v[c], least[1], 1e-12)
                    keep = ~np.isnan(after)
                    r, c, before, after = r[keep], c[keep], before[keep], after[keep]  # noqa: PLW2901
                    linked = (of_a[i + r] & of_b[j + c]).any(1).astype(int)
                    for k, value in enumerate((np.ones(len(r)), after >= before, before, after)):
                        sums[:, k] += np.bincount(linked, value, 2)
        n, kept, before, after = sums.T
        return pa.table({"linked": [0, 1], "n": n.astype(int), "kept": kept.astype(int), "before": before, "after": after})

    found = B.meet(rows, "name", ["window"], F.col("parts"), "linked int, n long, kept long, before double, after double", count)
    sums = found.groupBy("linked").agg(*[F.sum(c).alias(c) for c in SUMS]).where("n > 0")
    return sums.select("linked", "n", *[(F.col(c) / F.col("n")).alias(c) for c in SUMS[1:]])
