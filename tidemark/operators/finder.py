"""Causes over several hops: a graph of likeliest earlier causes, walks back through it, and fused rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import vector as V
from tidemark.operators import linear as L
from tidemark.operators import retrieval as R
from tidemark.operators.graph import saved
from tidemark.operators.temporal import first_per_key

MODES = ["chain", "onehop", "abductive", "union"]


def genericness(vectors: DataFrame, ident: str, e: str, m: str) -> DataFrame:
    """``ident, z``: how near a carried vector is to the mean of all vectors, in standard deviations."""
    sums = L.gram(vectors.select(e).withColumn("_one", F.array(F.lit(1.0))), e, "_one")
    n = vectors.count()
    if not n:
        return vectors.select(ident, F.lit(0.0).alias("z"))
    mean = F.array(*[F.lit(float(x)) for x in sums[:, 0] / n])
    found = vectors.select(ident, V.dot(F.col(m), mean).alias("g"))
    stats = found.agg(F.avg("g").alias("mean"), F.greatest(F.stddev_pop("g"), F.lit(1e-6)).alias("sd"))
    return found.join(F.broadcast(stats)).select(ident, ((F.col("g") - F.col("mean")) / F.col("sd")).alias("z"))


def weighed(near: DataFrame, generic: DataFrame, ident: str, heat: float = 4.0, penalty: float = 1.0) -> DataFrame:
    """``effect, cause, share`` from ``query, item, score``: a softmax that generic causes are penalised in."""
    by = W.partitionBy("query")
    rows = near.join(generic.withColumnRenamed(ident, "item"), "item")
    factor = F.least(F.greatest(F.exp(-penalty * F.col("z")), F.lit(1e-3)), F.lit(1e3))
    rows = rows.withColumn("w", F.exp(heat * (F.col("score") - F.max("score").over(by))) * factor)
    return rows.select(F.col("query").alias("effect"), F.col("item").alias("cause"), (F.col("w") / F.sum("w").over(by)).alias("share"))


def walk(seeds: DataFrame, edges: DataFrame, restart: float = 0.9, rounds: int = 3) -> DataFrame:
    """``query, node, mass``: seeds' mass after ``rounds`` steps back through the graph with a restart.

    ``seeds`` has query, node, mass.  Each round moves only what moved in the round before,
    a share ``1 - restart`` of it, and a query's nodes are at most its seeds times the edges of a
    node to the power of ``rounds``.
    """
    now = saved(seeds.select("query", "node", F.col("mass").cast("double").alias("p")))
    total = now.select("query", "node", (restart * F.col("p")).alias("mass")) if rounds else now.withColumnRenamed("p", "mass")
    for step in range(1, rounds + 1):
        moved = now.join(edges, F.col("node") == F.col("effect")).groupBy("query", F.col("cause").alias("node"))
        now = saved(moved.agg(F.sum(F.col("p") * F.col("share")).alias("p")))
        share = (1 - restart) ** step * (restart if step < rounds else 1.0)
        total = total.union(now.select("query", "node", (share * F.col("p")).alias("mass")))
    return total.groupBy("query", "node").agg(F.sum("mass").alias("mass"))


def _best(df: DataFrame, score: Column, k: int) -> DataFrame:
    """``query, node, rank`` of the ``k`` greatest scores, ties to the smaller node."""
    return first_per_key(df.withColumn("_s", F.round(score, 12)), ["query"], [F.desc("_s"), F.col("node")], rank="rank", most=k).drop("_s")


def combined(ranked: DataFrame, vectors: DataFrame, ident: str, e: str, weight: str) -> DataFrame:
    """``query, q``: the weighted sum of the vectors of each query's nodes."""
    rows = ranked.join(vectors.select(F.col(ident).alias("node"), F.col(e).alias("_e")), "node")
    cells = rows.select("query", weight, F.posexplode("_e").alias("i", "x")).groupBy("query", "i").agg(F.sum(F.col("x") * F.col(weight)).alias("x"))
    return cells.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("c")).select("query", F.col("c.x").alias("q"))


def multi_hop(queries: DataFrame, vectors: DataFrame, edges: DataFrame, ident: str = "vec_id", e: str = "e", m: str = "m", seeds: int = 20, restart: float = 0.9, rounds: int = 3, take: int = 100, support: int = 15, reach: int = 30, k: int = 8) -> DataFrame:
    """``query, mode, rank, node, via``: the best ``k`` earlier causes of each query in four modes.

    ``queries`` has query and q; ``vectors`` the plain and the carried form.  The seeds are the
    ``seeds`` nodes whose carried form is nearest to the query, with positive scores as
    mass.  Modes: the seeds themselves (onehop), the walk from them (chain), both
    fused by reciprocal ranks (union), and both with the plain cosine and the nearest to the
    centroid of the walk's ``support`` best (abductive).  ``via`` says whether a node is among
    the first ``reach`` of the walk but not of the seeds.
    """
    carried = vectors.select(ident, F.col(m).alias("embedding"))
    plain = vectors.select(ident, F.col(e).alias("embedding"))
    direct = R.top_k(queries, carried, seeds, vec_id=ident, earlier=True).where("score > 0").select("query", F.col(ident).alias("node"), "score", "rank")
    direct = saved(direct)
    mass = F.col("score") / F.sum("score").over(W.partitionBy("query"))
    hyp = saved(_best(walk(direct.select("query", "node", mass.alias("mass")), edges, restart, rounds), F.col("mass"), take))
    topical = R.top_k(queries, plain, take, vec_id=ident, earlier=True).select("query", F.col(ident).alias("node"), "rank")
    centre = combined(hyp.where(F.col("rank") <= support), vectors, ident, e, "mass")
    near = R.top_k(saved(centre), plain, take, vec_id=ident, earlier=True).select("query", F.col(ident).alias("node"), "rank")
    lists = {"onehop": direct.select("query", "node", "rank"), "chain": hyp.select("query", "node", "rank"), "topical": topical, "support": near}
    every = None
    for name, rows in lists.items():
        rows = rows.where(F.col("rank") <= take).withColumn("route", F.lit(name))
        every = rows if every is None else every.unionByName(rows)
    every = saved(every)
    members = {"chain": ["chain"], "onehop": ["onehop"], "abductive": list(lists), "union": ["onehop", "chain"]}
    place = F.array(*[F.struct(F.lit(mode).alias("mode"), F.lit(r).alias("in")) for mode, routes in members.items() for r in routes])
    by_mode = every.withColumn("_m", F.explode(place)).where("_m.in = route").select("query", "node", "rank", "route", F.col("_m.mode").alias("mode"))
    fused = R.fuse(by_mode, "route", "rank", ["query", "mode", "node"])
    top = first_per_key(fused.withColumn("_s", F.round("score", 12)), ["query", "mode"], [F.desc("_s"), F.col("node")], rank="rank", most=k)
    at = every.groupBy("query", "node").agg(F.min(F.when(F.col("route") == "chain", F.col("rank"))).alias("c"), F.min(F.when(F.col("route") == "onehop", F.col("rank"))).alias("o"))
    beyond = (F.col("c") <= reach) & (F.col("o").isNull() | (F.col("o") > reach))
    return top.join(at, ["query", "node"]).select("query", "mode", "rank", "node", F.when(beyond, "chain").otherwise("direct").alias("via"))


def cells_for(n: int, rows: int = 1024) -> int:
    """A number of cells that gives each about ``rows`` vectors."""
    return int(np.clip(n // rows, 1, 4096))
