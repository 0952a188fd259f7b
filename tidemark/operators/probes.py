"""What vectors tell about outcomes: splits, rank correlations, lifts, sibling pairs and sparse targets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import linear as L
from tidemark.operators.graph import saved
from tidemark.operators.order import rank_all

#: Children of a parent that are dealt partners among themselves.
FAMILY = 1000


def split_by_time(df: DataFrame, late: Column, stray: Column, least: int = 30) -> tuple[DataFrame, str]:
    """``df`` with ``test``: the late rows, or, if they are fewer than ``least``, the stray ones; and which it was."""
    if df.where(late).count() >= least:
        return df.withColumn("test", late), "temporal"
    return df.withColumn("test", stray), "hash"


def spearman(df: DataFrame, a: str, b: str, key: str) -> Column | None:
    """``rho``: correlation of ordinal ranks over the whole table, ties by ``key``; ranks come from ranges, not one task."""
    first = rank_all(df.select(key, a, b), [a, key], "_a")
    both = rank_all(first, [b, key], "_b")
    return both.agg(F.corr("_a", "_b").alias("rho")).first()[0]


def top_lift(df: DataFrame, score: str, actual: str, key: str, share: float = 0.1) -> tuple[int, float | None, float | None]:
    """Number of the rows with the highest scores, mean of all, and how far the mean of the top lies over it."""
    n, base = df.agg(F.count("*"), F.avg(actual)).first()
    k = max(int(np.ceil(n * share)), 1)
    placed = rank_all(df.withColumn("_down", -F.col(score)).select("_down", key, actual), ["_down", key], "_place")
    top = placed.where(F.col("_place") <= k).agg(F.avg(actual)).first()[0]
    return k, base, top / base if base else None


def siblings(edges: DataFrame, hashed: Column) -> DataFrame:
    """``x, y``: ordered pairs of children of one parent that are no edge themselves.

    ``edges`` has a, b.  Children stand in a ring by ``hashed``, a number of the column b, and
    each meets its two neighbours, so pairs grow with the edges, not with the square of a
    parent's children; a parent with more than ``FAMILY`` children has several rings.
    """
    e = edges.select("a", "b").distinct()
    rings = e.groupBy("a").agg((F.floor(F.count("*") / FAMILY) + 1).cast("int").alias("rings"))
    placed = e.join(rings, "a").withColumn("ring", F.pmod(F.xxhash64("b"), "rings")).withColumn("h", hashed)
    ring = W.partitionBy("a", "ring").orderBy("h", "b")
    whole = ring.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    pairs = placed.select(F.col("b").alias("x"), F.coalesce(F.lead("b").over(ring), F.first("b").over(whole)).alias("y")).where("x <> y")
    both = pairs.union(pairs.select("y", "x")).toDF("x", "y").distinct()
    return both.join(e.toDF("x", "y"), ["x", "y"], "left_anti")


def balanced(positives: DataFrame, negatives: DataFrame, hashed: Column) -> DataFrame:
    """``x, y, h, label``: equally many of both, those of the least hash."""
    sides = [saved(df.select("x", "y").withColumn("h", hashed)) for df in (positives, negatives)]
    n = min(df.count() for df in sides)
    kept = [rank_all(df, ["h", "x", "y"], "_k").where(F.col("_k") <= n).drop("_k").withColumn("label", F.lit(label)) for df, label in zip(sides, (1, 0), strict=True)]
    return kept[0].unionByName(kept[1])


def pair_features(pairs: DataFrame, vectors: DataFrame, ident: str, e: str, m: str, entities: str) -> DataFrame:
    """``pairs`` with ``features``: score ahead and back under the map, cosine, and Jaccard of the entities."""
    side = lambda c: vectors.select(F.col(ident).alias(c), F.col(e).alias(f"e_{c}"), F.col(m).alias(f"m_{c}"), F.col(entities).alias(f"n_{c}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    jaccard = F.coalesce(F.try_divide(F.size(F.array_intersect("n_x", "n_y")), F.size(F.array_union("n_x", "n_y"))), F.lit(0.0))
    found = F.array(V.dot(F.col("m_x"), F.col("e_y")), V.dot(F.col("m_y"), F.col("e_x")), V.dot(F.col("e_x"), F.col("e_y")), jaccard)
    return both.select(*pairs.columns, found.alias("features"))


def sparse_targets(docs: DataFrame, targets: DataFrame, doc: str, x: str, target: str, value: str, strength: float) -> DataFrame:
    """``target, weights``: one ridge output for each target, from rows of what each document has of it.

    X'X is made once of the documents, X'Y by sums for each target of the rows that there are;
    the dense matrix of documents and targets never exists.
    """
    rows = targets.join(docs.select(doc, x), doc)
    cells = rows.select(target, value, F.posexplode(x).alias("_i", "_x")).groupBy(target, "_i").agg(F.sum(F.col("_x") * F.col(value)).alias("_s"))
    right = cells.groupBy(target).agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_c")).select(target, F.col("_c._s").alias("_r"))
    known = docs.join(targets.select(doc).distinct(), doc, "left_semi")
    g = L.gram(known, x)
    inverse = np.linalg.inv(g + strength * np.eye(len(g)))
    return L.mapped(right, "_r", inverse, "weights").select(target, "weights")
