"""Linear maps that carry causes to effects: one for all pairs, one for each group, refined by margins.

A map is d x d whatever the number of pairs.  Tasks add up d x 2d sums for their own rows;
what meets in a shuffle is one number a cell, group and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators.graph import saved

#: Groups whose sums a task holds before it hands them on, and pairs of a group that are scored in one piece.
HELD, PIECE = 64, 50_000
#: Pairs of a block, within which negatives are dealt.
BLOCK = 256


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), float).reshape(len(rows), -1)


def group_maps(pairs: DataFrame, group: str, a: str, b: str, strength: float, least: int) -> DataFrame:
    """``group, n, map``: for each group of at least ``least`` pairs the ridge map (X'X + s I)^-1 X'Y, row by row.

    All groups' Gram sums are made in one pass.  Cell -1 of a group counts its pairs; a
    solve reads the 2 d^2 cells of one group.
    """
    kind = dict(pairs.dtypes)[group]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[object, np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.concat([pd.DataFrame({group: [g] * len(v), "cell": np.arange(-1, len(v) - 1), "v": v}) for g, v in held.items()])

        for batch in batches:
            for g, rows in batch.groupby(group, sort=False, dropna=False):
                x, y = _matrix(rows[a]), _matrix(rows[b])
                found = np.r_[len(rows), np.hstack([x.T @ x, x.T @ y]).ravel()]
                held[g] = held[g] + found if g in held else found
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    cells = pairs.select(group, a, b).mapInPandas(sums, f"`{group}` {kind}, cell int, v double").groupBy(group, "cell").agg(F.sum("v").alias("v"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("cell")["v"].to_numpy()
        d = round(((len(v) - 1) / 2) ** 0.5)
        both = v[1:].reshape(d, 2 * d)
        w = np.linalg.solve(both[:, :d] + strength * np.eye(d), both[:, d:]) if v[0] >= least else np.zeros(0)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "n": [round(v[0])], "map": [w.ravel().tolist()]})

    return cells.groupBy(group).applyInPandas(solve, f"`{group}` {kind}, n long, map array<double>").where(F.col("n") >= least)


def directions(pairs: DataFrame, key: str, a: str, b: str, group: str, maps: DataFrame, everyone: np.ndarray) -> DataFrame:
    """``key, group, ahead, own_ahead``: whether a pair scores higher from ``a`` to ``b`` than back.

    ``ahead`` is by the map of all pairs, ``own_ahead`` by the map of the pair's group, which
    is that of all pairs where the group has none.  A group's pairs are dealt out in pieces
    of about ``PIECE``, each with a copy of the group's map.
    """
    kinds = dict(pairs.dtypes)
    shared = pairs.sparkSession.sparkContext.broadcast(everyone)
    pieces = pairs.groupBy(group).agg((F.floor(F.count("*") / PIECE) + 1).cast("int").alias("_pieces"))
    dealt = pairs.select(key, group, a, b).join(pieces, group).withColumn("_piece", F.pmod(F.xxhash64(key), "_pieces").cast("int"))
    copies = maps.select(group, "map").join(pieces, group).select(group, "map", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece"))

    def score(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in (key, group, "ahead", "own_ahead")})
        x, y = _unit(_matrix(rows[a])), _unit(_matrix(rows[b]))

        def ahead(w: np.ndarray) -> np.ndarray:
            return ((_unit(x @ w) * y).sum(1) > (_unit(y @ w) * x).sum(1)).astype(int)

        whole = ahead(shared.value)
        special = ahead(np.array(own["map"].iloc[0]).reshape(x.shape[1], -1)) if len(own) else whole
        return pd.DataFrame({key: rows[key], group: rows[group], "ahead": whole, "own_ahead": special})

    by = [group, "_piece"]
    return dealt.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(score, f"`{key}` {kinds[key]}, `{group}` {kinds[group]}, ahead int, own_ahead int")


def mcnemar(rows: DataFrame, one: str, other: str) -> DataFrame:
    """``n, mean_one, mean_other, one_only, other_only, chi2`` with the continuity correction."""
    sums = rows.agg(
        F.count("*").alias("n"), F.avg(one).alias("mean_one"), F.avg(other).alias("mean_other"),
        F.coalesce(F.sum(((F.col(one) == 1) & (F.col(other) == 0)).cast("long")), F.lit(0)).alias("one_only"),
        F.coalesce(F.sum(((F.col(one) == 0) & (F.col(other) == 1)).cast("long")), F.lit(0)).alias("other_only"),
    )
    apart = F.col("one_only") + F.col("other_only")
    gap = F.greatest(F.abs(F.col("one_only") - F.col("other_only")) - 1, F.lit(0))
    return sums.withColumn("chi2", F.when(apart > 0, gap * gap / apart).otherwise(0.0))


def in_blocks(pairs: DataFrame, key: str, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """Pairs packed in blocks of about ``block`` by the hash of their key, in order of the key within a block."""
    blocks = max(1, -(-pairs.count() // block))
    one = F.struct(F.col(key).alias("k"), F.col(a).cast("array<double>").alias("a"), F.col(b).cast("array<double>").alias("b"))
    packed = pairs.groupBy(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("p"))
    return saved(packed.select("block", F.flatten("p.a").alias("a"), F.flatten("p.b").alias("b"), F.size("p").alias("n")))


def partner(n: int, step: int) -> np.ndarray:
    """For each of ``n`` places another one, the same distance away for all; the distance grows by one each step."""
    shift = 1 + step % (n - 1) if n > 1 else 0
    return (np.arange(n) + shift) % n


def margin_gradient(a: np.ndarray, b: np.ndarray, w: np.ndarray, step: int, margin: float) -> np.ndarray:
    """Subgradient of the hinges of a block: a pair has to beat its reverse and another pair's effect."""
    aw = a @ w
    right, back = (aw * b).sum(1), ((b @ w) * a).sum(1)
    other = b[partner(len(a), step)]
    wrong = (margin - right + (aw * other).sum(1) > 0) & (len(a) > 1)
    turned = margin - right + back > 0
    x, xr, yr = a[wrong], a[turned], b[turned]
    return x.T @ (other[wrong] - b[wrong]) + yr.T @ xr - xr.T @ yr


def refine(blocks: DataFrame, start: np.ndarray, rounds: int = 150, rate: float = 0.5, margin: float = 0.1, decay: float = 0.01) -> np.ndarray:
    """A map refined by subgradient steps from ``start``; ``blocks`` come from :func:`in_blocks`.

    A step reads all pairs and gives back one d x d sum.  Negatives are the effects of
    other pairs of the same block, dealt anew each step by a rotation.
    """
    d, w = len(start), start.copy()
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for step in range(rounds if n else 0):
        g = _summed(blocks, d, w, lambda x, y, w, step=step: margin_gradient(x, y, w, step, margin))
        w = w - g * (rate / n) - w * (rate * decay)
    return w


def _summed(blocks: DataFrame, d: int, model: np.ndarray, of_block: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The d x d sum of ``of_block(a, b, model)`` over all blocks; tasks add up their own."""
    shared = blocks.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((d, d))
        for batch in batches:
            for x, y in zip(batch["a"], batch["b"], strict=True):
                total += of_block(np.asarray(x).reshape(-1, d), np.asarray(y).reshape(-1, d), shared.value)
        cell = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cell, "v": total.ravel()[cell]})

    found = blocks.select("a", "b").mapInPandas(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(d * d)
    out[found["cell"].to_numpy(int)] = found["v"].to_numpy()
    shared.unpersist()
    return out.reshape(d, d)


def metric_gradient(a: np.ndarray, b: np.ndarray, low: np.ndarray, step: int, margin: float) -> np.ndarray:
    """What the hinges of a block ask of L'L: a pair has to be nearer under L than with another pair's effect."""
    other = b[partner(len(a), step)]
    at, to, away = a @ low.T, b @ low.T, other @ low.T
    wrong = (margin - (at * to).sum(1) + (at * away).sum(1) > 0) & (len(a) > 1)
    m = a[wrong].T @ (other[wrong] - b[wrong])
    return m + m.T


def metric(blocks: DataFrame, start: np.ndarray, rounds: int = 250, rate: float = 0.5, margin: float = 0.15, decay: float = 0.01) -> np.ndarray:
    """A low-rank metric L (rank x d) refined from ``start``: inner products of Lx rank pairs before other effects."""
    low = start.copy()
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    for step in range(rounds if n else 0):
        m = _summed(blocks, low.shape[1], low, lambda x, y, low, step=step: metric_gradient(x, y, low, step, margin))
        low = low - (low @ m) * (rate / n) - low * (rate * decay)
    return low


def carried(df: DataFrame, x: str, matrix: np.ndarray, out: str) -> DataFrame:
    """``x`` times a map, at unit length, by Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    @F.pandas_udf("array<double>")
    def carry(v: pd.Series) -> pd.Series:
        return pd.Series(list(_unit(_matrix(v) @ shared.value))) if len(v) else pd.Series([], dtype=object)

    return df.withColumn(out, carry(x))


def lead(a: Column, b: Column, carried_a: Column, carried_b: Column) -> Column:
    """How much better ``a`` leads to ``b`` than back, from both vectors and their carried forms."""
    return V.dot(carried_a, b) - V.dot(carried_b, a)
