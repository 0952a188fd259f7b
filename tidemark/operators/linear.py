"""Linear algebra over vector columns: Gram sums on the cluster, small solves on the driver.

A Gram matrix has the size of the vectors' dimensions whatever the number of rows, so
only d x d sums reach the driver.  Each task adds up its own rows; the sums meet in a
group-by on the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, left: str, right: str | None = None) -> np.ndarray:
    """Sum of outer products of two vector columns (of one with itself)."""
    columns = [left] + ([right] if right else [])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for b in batches:
            if len(b):
                x = np.array(b[left].tolist(), float)
                y = np.array(b[right].tolist(), float) if right else x
                total = x.T @ y if total is None else total + x.T @ y
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})

    cells = df.select(*columns).mapInPandas(part, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    if cells.empty:
        return np.zeros((0, 0))
    out = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
    out[cells.i, cells.j] = cells.v
    return out


def ridge(df: DataFrame, x: str, y: str, strength: float) -> np.ndarray:
    """Linear map from ``x`` vectors to ``y`` vectors: (X'X + s I)^-1 X'Y."""
    a = gram(df, x)
    return np.linalg.solve(a + strength * np.eye(len(a)), gram(df, x, y))


def probe(df: DataFrame, x: str, y: str, strength: float) -> np.ndarray:
    """Ridge weights for a scalar target."""
    return ridge(df.withColumn("_y", F.array(F.col(y).cast("double"))), x, "_y", strength)[:, 0]


def principal(df: DataFrame, x: str, k: int, centre: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Leading directions (columns) and their share of the total."""
    one = df.withColumn("_one", F.array(F.lit(1.0)))
    a = gram(one, x)
    if centre:
        n = df.count()
        mean = gram(one, x, "_one")[:, 0] / n
        a = a - n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(a)
    order = np.argsort(values)[::-1][:k]
    vectors = vectors[:, order]
    vectors *= np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)
    return vectors, values[order] / max(values.sum(), 1e-300)


def without(df: DataFrame, x: str, directions: np.ndarray, out: str) -> DataFrame:
    """``x`` less its parts along the directions."""
    project = np.eye(len(directions)) - directions @ directions.T
    return mapped(df, x, project, out)


def mapped(df: DataFrame, x: str, matrix: np.ndarray, out: str) -> DataFrame:
    """``x`` times a matrix, by Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("array<double>")
    def apply(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.array(v.tolist(), float) @ shared.value)) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, apply(x))


def channels(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest singular values of a map and their input directions."""
    values, vectors = np.linalg.eigh(matrix @ matrix.T)
    order = np.argsort(values)[::-1][:k]
    return np.sqrt(np.maximum(values[order], 0)), vectors[:, order]


def per_group_ols(df: DataFrame, group: str, y: str, xs: list[str], least: int = 5) -> DataFrame:
    """Intercept and slopes per group from the group's Gram sums, made by one aggregation."""
    terms = ["_one", *xs]
    d = df.withColumn("_one", F.lit(1.0))
    sums = [F.sum(F.col(a).cast("double") * F.col(b).cast("double")).alias(f"g{i}_{j}") for i, a in enumerate(terms) for j, b in enumerate(terms) if i <= j]
    sums += [F.sum(F.col(a).cast("double") * F.col(y).cast("double")).alias(f"y{i}") for i, a in enumerate(terms)]
    rows = d.groupBy(group).agg(F.count("*").alias("n"), *sums).where(F.col("n") >= least)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(terms)
        for b in batches:
            a = np.array([[b[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float).reshape(k, k, -1).transpose(2, 0, 1)
            t = np.array([b[f"y{i}"] for i in range(k)], float).T
            yield pd.DataFrame({group: b[group], "n": b["n"], "coefficients": [np.linalg.lstsq(m, v, rcond=None)[0].tolist() for m, v in zip(a, t, strict=True)]})

    return rows.mapInPandas(solve, f"`{group}` {dict(df.dtypes)[group]}, n long, coefficients array<double>")
