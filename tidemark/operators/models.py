"""Small regressions per group and low-rank fits, from Gram sums.

One aggregation gives each group's sums of products; what follows is numpy on a
matrix of the columns' number, inside the tasks that hold the sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import linear
from tidemark.operators.graph import saved
from tidemark.operators.order import rank_all


def group_gram(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """``group, n, gram``: sums of products of 1 and the columns, row by row; rows with a null are left out."""
    d = df.dropna(subset=columns).withColumn("_one", F.lit(1.0))
    terms = ["_one", *columns]
    cells = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")) for a in terms for b in terms]
    return d.groupBy(group).agg(F.count("*").alias("n"), F.array(*cells).alias("gram"))


def _per_group(grams: DataFrame, group: str, schema: str, f: Callable[[int, np.ndarray], list]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in schema.split(",")]
        for b in batches:
            rows = [f(int(n), np.array(g, float).reshape(int(len(g) ** 0.5), -1)) for n, g in zip(b["n"], b["gram"], strict=True)]
            out = pd.DataFrame(rows, columns=names, index=b.index)
            out.insert(0, group, b[group])
            yield out

    return grams.mapInPandas(run, f"`{group}` {dict(grams.dtypes)[group]}, {schema}")


def residual(gram: np.ndarray, xs: list[int], y: int) -> float:
    """Residual sum of squares of column ``y`` on the columns ``xs`` (0 is the intercept)."""
    beta = np.linalg.lstsq(gram[np.ix_(xs, xs)], gram[xs, y], rcond=None)[0]
    return max(float(gram[y, y] - gram[xs, y] @ beta), 0.0)


def granger(df: DataFrame, group: str, y: str, own: list[str], other: list[str], least: int = 20) -> DataFrame:
    """Whether lags of another series help: log variance ratio and F, own lags held."""
    grams = group_gram(df, group, [*own, *other, y]).where(F.col("n") >= least)
    k, m = len(own), len(other)

    def test(n: int, g: np.ndarray) -> list:
        small, full = residual(g, list(range(k + 1)), k + m + 1), residual(g, list(range(k + m + 1)), k + m + 1)
        left = n - k - m - 1
        if full <= 0 or left <= 0:
            return [n, None, None]
        return [n, float(np.log(small / full)), float((small - full) / m / (full / left))]

    return _per_group(grams, group, "n long, log_ratio double, f double", test)


def sequential_parts(df: DataFrame, group: str, y: str, ordered: list[str], least: int = 10) -> DataFrame:
    """Share of variance that each column adds to those before it; with ``rest`` they sum to one."""
    grams = group_gram(df, group, [*ordered, y]).where(F.col("n") >= least)

    def parts(n: int, g: np.ndarray) -> list:
        last = len(ordered) + 1
        steps = [residual(g, list(range(i + 1)), last) for i in range(len(ordered) + 1)]
        total = steps[0] or 1.0
        return [n, [(a - b) / total for a, b in zip(steps, steps[1:], strict=False)], steps[-1] / total]

    return _per_group(grams, group, "n long, parts array<double>, rest double", parts)


def shapley_parts(df: DataFrame, group: str, y: str, blocks: dict[str, list[str]], least: int = 10) -> DataFrame:
    """Shapley share of R2 of each block of columns, over all orders; they sum to the full R2."""
    columns = [c for b in blocks.values() for c in b]
    grams = group_gram(df, group, [*columns, y]).where(F.col("n") >= least)
    at, where = 1, []
    for b in blocks.values():
        where.append(list(range(at, at + len(b))))
        at += len(b)

    def parts(n: int, g: np.ndarray) -> list:
        total = residual(g, [0], at) or 1.0
        k = len(where)
        value = {s: 1 - residual(g, [0, *[c for i in s for c in where[i]]], at) / total for r in range(k + 1) for s in combinations(range(k), r)}
        out = []
        for i in range(k):
            others = [j for j in range(k) if j != i]
            out.append(sum(factorial(len(s)) * factorial(k - len(s) - 1) / factorial(k) * (value[tuple(sorted((*s, i)))] - value[s]) for r in range(k) for s in combinations(others, r)))
        return [n, out, value[tuple(range(k))]]

    return _per_group(grams, group, "n long, parts array<double>, r2 double", parts)


def partial_least_squares(df: DataFrame, x: str, y: str, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (columns) and coefficients of PLS1, deflating the sums instead of the rows."""
    xx = linear.gram(df, x)
    xy = linear.gram(df.withColumn("_y", F.array(F.col(y).cast("double"))), x, "_y")[:, 0]
    full, ws, ps, qs = xx.copy(), [], [], []
    for _ in range(components):
        size = np.linalg.norm(xy)
        if size < 1e-12:
            break
        w = xy / size
        tt = w @ xx @ w
        p, q = xx @ w / tt, xy @ w / tt
        ws, ps, qs = [*ws, w], [*ps, p], [*qs, q]
        xx, xy = xx - tt * np.outer(p, p), xy - tt * q * p
    w, p = np.array(ws).T, np.array(ps).T
    return w, (w @ np.linalg.solve(p.T @ w, np.array(qs)) if len(qs) else np.zeros(len(full)))


def one_step_map(df: DataFrame, x: str, following: str, rank: int, strength: float = 1e-9) -> dict[str, float]:
    """Squared error of the best map of rank-reduced states to the next, and of persistence."""
    xx, xy, yy = linear.gram(df, x), linear.gram(df, x, following), linear.gram(df, following)
    _, v = np.linalg.eigh(xx)
    v = v[:, ::-1][:, :rank]
    k = v @ np.linalg.solve(v.T @ xx @ v + strength * np.eye(v.shape[1]), v.T @ xy)
    error = lambda m: float(np.trace(yy) - 2 * np.trace(m.T @ xy) + np.trace(m.T @ xx @ m))
    return {"map": error(k), "persistence": error(np.eye(len(xx))), "radius": float(np.abs(np.linalg.eigvals(k)).max())}


def factorise(df: DataFrame, row: str, column: str, value: str, rank: int, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Non-negative factors of a sparse table by alternating least squares; ids are integers."""
    from pyspark.ml.recommendation import ALS

    model = ALS(rank=rank, userCol=row, itemCol=column, ratingCol=value, nonnegative=True, implicitPrefs=False, seed=seed, coldStartStrategy="drop").fit(df)
    return model.userFactors, model.itemFactors


def clusters(df: DataFrame, vector: str, k: int, seed: int = 7) -> DataFrame:
    """``df`` with ``cluster`` by k-means on unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    d = Normalizer(inputCol="_v", outputCol="_u").transform(df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>"))))
    model = KMeans(k=k, featuresCol="_u", predictionCol="cluster", seed=seed).fit(d)
    return model.transform(d).drop("_v", "_u")


def compared_fits(df: DataFrame, features: list[str], target: str, test: str, key: str, steps: int = 40, seed: int = 7) -> DataFrame:
    """``model, n, r2``: what a line and boosted trees explain of held-out rows, beyond the training mean.

    ``control`` is the trees on features that belong to other rows: each row gets those of the row
    next to it in the order of a hash of ``key``, so what it gains is no signal.  Rows with a null
    feature or target are left out.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    known = df.select(F.col(key).alias("_key"), F.col(target).cast("double").alias("_y"), F.col(test).alias("_test"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]).dropna()
    # Training rows come first, so but for one row each gets features of its own side.
    known = rank_all(known.withColumn("_side", F.col("_test").cast("int")).withColumn("_h", F.xxhash64("_key", F.lit(seed))), ["_side", "_h", "_key"], "_place")
    names = [f"_x{i}" for i in range(len(features))]
    other = known.select((F.col("_place") - 1).alias("_place"), *[F.col(c).alias(f"{c}o") for c in names])
    both = saved(known.join(other, "_place", "left").select("_y", "_test", *names, *[F.coalesce(f"{c}o", c).alias(f"{c}o") for c in names]))
    train, held = both.where("NOT _test"), both.where("_test")
    n, mean = train.agg(F.count("*"), F.avg("_y")).first()
    if not n or held.isEmpty():
        return both.select(F.lit("line").alias("model"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("r2")).limit(0)
    one = F.array(F.lit(1.0), *names)
    weights = linear.probe(train.withColumn("_v", one), "_v", "_y", 1e-9)
    scored = held.withColumn("line", F.aggregate(F.zip_with(one, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    for name, columns in (("trees", names), ("control", [f"{c}o" for c in names])):
        put = VectorAssembler(inputCols=columns, outputCol="_f").transform
        fit = GBTRegressor(featuresCol="_f", labelCol="_y", predictionCol=name, maxIter=steps, stepSize=0.1, maxDepth=4, seed=seed).fit(put(train))
        scored = fit.transform(put(scored)).drop("_f")
    whole = F.sum((F.col("_y") - F.lit(mean)) ** 2)
    sums = scored.agg(F.count("*").alias("n"), *[(1 - F.try_divide(F.sum((F.col("_y") - F.col(m)) ** 2), whole)).alias(m) for m in ("line", "trees", "control")])
    return sums.select("n", F.expr("stack(3, 'line', line, 'trees', trees, 'control', control) AS (model, r2)")).select("model", "n", "r2")
