"""Session helpers of the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch between the JVM and Python; whole texts can be long.
BATCH_ROWS = 256
#: Size of a bitmap: at most so many bits, and so many for each token below that.
MAX_BITS, BITS_A_TOKEN = 1 << 25, 256


def prepare(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch; documents are far wider than usual rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster.

    Where ``spark.checkpoint.dir`` is unset a temporary folder is made in local mode, as in
    tests; on a cluster that is an error, as executors would not see each other's files.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tidemark.local.checkpoint", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("tidemark.local.checkpoint", found)
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has: the given ones, lengthened where they are taken."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge list of long ids.

    Returns ``node, component`` for every node that has an edge to another one;
    ``component`` is the smallest id reachable.  Alternates the large-star and the
    small-star step until nothing changes, so hubs are never gathered in one place:
    each step is a minimum per node (combined before the shuffle) and a join.
    Empty input gives an empty result; loops and repeated edges don't matter.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state


def slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return tokens & np.uint64(bits - 1)


class Bitmap:
    """Which of ``bits`` slots hold one of the ``count`` tokens of a column ``token``.

    Gathered as at most ``MAX_BITS / 64`` words, so it may be broadcast whatever the
    number of tokens; tasks use it to skip most rows before an exact join.
    """

    def __init__(self, tokens: DataFrame, count: int):
        self.bits = 1 << max(12, min(MAX_BITS, BITS_A_TOKEN * max(count, 1)).bit_length() - 1)
        slot = F.col("token").bitwiseAND(F.lit(self.bits - 1))
        word = F.shiftright(slot, 6).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
        found = tokens.select(word.alias("w"), bit.alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        words = np.zeros(self.bits // 64, np.int64)
        words[found["w"].to_numpy()] = found["b"].to_numpy()
        self.packed = words.view(np.uint8)

    def mask(self) -> np.ndarray:
        return np.unpackbits(self.packed, bitorder="little").astype(bool)
