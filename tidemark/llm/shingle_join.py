"""Near-duplicate texts: Jaccard similarity of their sets of five-word shingles.

Words are as in the fingerprints of ``simhash_dedup``; a text of fewer words is one shingle,
one without words has an empty set.  Texts with equal sets form one class.  Two classes
link if their sets' Jaccard similarity is ``SIMILARITY`` or more.

Candidates miss no such pair.  Similar sets share at least ``SIMILARITY`` of either, so the
least shingle (by hash) that both have is among the ``1 - SIMILARITY`` least of each, and one
more.  Only these are join keys; sizes are compared in the bucket, then parity bits of the
sets, of which a shingle that only one side has flips one, and whole sets only of what is left.
Large buckets are met as in ``line_dedup``: heads first, then pairs of different groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import line_dedup as lines
from tidemark.llm import textkit as tk
from tidemark.llm.shared import Bitmap, components, slots, written

SHINGLE, SEED, SIMILARITY = 5, 42, 0.8
#: Parity bits a shingle that candidates are compared by.
SKETCH = 2
U = np.uint64


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + SHINGLE]), SEED) for i in range(max(1, len(words) - SHINGLE + 1))}
    return np.sort(np.fromiter(found, U, len(found)))


def _named(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Each text's set and the class that it names."""
    sets = [shingles(t) for t in texts.to_pylist()]
    return sets, np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], U)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both >= SIMILARITY * (a.size + b.size - both) - 1e-9


@F.pandas_udf(T.BooleanType())
def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, U), np.frombuffer(y, U)) for x, y in zip(a, b, strict=True)], dtype=bool)


@F.pandas_udf(T.BooleanType())
def _possible(size_a: pd.Series, size_b: pd.Series, sketch_a: pd.Series, sketch_b: pd.Series) -> pd.Series:
    """Whether sizes and flipped parity bits allow two sets to be similar.

    With ``x`` shingles of its own, the larger set of ``n`` shares ``n - x``, so ``x`` is at most a
    fifth of ``n``; the other has the difference of their sizes fewer.
    """
    flips = [int(lines._flips(np.frombuffer(x, U), np.frombuffer(y, U)[None])[0]) for x, y in zip(sketch_a, sketch_b, strict=True)]
    return pd.Series(lines._possible(size_a.to_numpy(np.int64), size_b.to_numpy(np.int64), np.array(flips, np.int64)), dtype=bool)


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``class, size, sketch`` of each text, the last column, after the other columns."""
    for rows, _, _ in tk.text_chunks(batches):
        sets, names = _named(rows.column(rows.num_columns - 1))
        size = pa.array(np.array([s.size for s in sets], np.int64))
        sketch = pa.array([lines._sketch(s, SKETCH) for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(tk.signed(names)), size, sketch], names=[*rows.schema.names[:-1], "class", "size", "sketch"])


def _keys(parts: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in tk.text_chunks(batches):
            sets, names = _named(rows.column(0))
            size = np.array([s.size for s in sets], np.int64)
            first = [s[: s.size - (4 * s.size + 4) // 5 + 1] for s in sets]
            owner = np.repeat(np.arange(size.size), [s.size for s in first])
            keys = np.concatenate([np.zeros(0, U), *first])
            part = ((keys >> U(32)) % U(parts)).astype(np.int64)
            by = np.argsort(part, kind="stable")
            packed = np.zeros(by.size, lines.PACKED)
            packed["key"], packed["line"], packed["words"] = keys[by].astype(np.uint32), tk.signed(names)[owner[by]], np.minimum(size[owner[by]], 65535)
            found, cuts = np.unique(part[by], return_index=True)
            cuts = np.r_[cuts, by.size]
            blobs = [packed[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(blobs, pa.binary())], names=["part", "packed"])

    return found


def _sets(wanted):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = wanted.value.mask()
        for rows, _, _ in tk.text_chunks(batches):
            sets, names = _named(rows.column(0))
            mine = np.flatnonzero(here[slots(names, here.size)])
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(names[mine])), pa.array([sets[i].tobytes() for i in mine.tolist()], pa.binary())], names=["class", "set"])

    return found


def _similar_pairs(pairs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    mine, other = (found.select(F.col("class").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in ("a", "b"))
    near = pairs.distinct().join(mine, "a").join(other, "b").where(_possible("size_a", "size_b", "sketch_a", "sketch_b"))
    pairs = written(near.select("a", "b"), "near")
    wanted = written(pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct(), "wanted")
    bitmap = texts.sparkSession.sparkContext.broadcast(Bitmap(wanted.select(F.col("class").alias("token")), wanted.count()))
    sets = texts.select("text").mapInArrow(_sets(bitmap), "class long, set binary").join(wanted, "class", "left_semi")
    sets = written(sets.groupBy("class").agg(F.min("set").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    return written(both.where(_similar("set_a", "set_b")).select("a", "b"), "similar")


def links(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges ``a, b`` that connect all similar classes; ``found`` has their ``class, size, sketch``."""
    parts = 4 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = texts.select("text").mapInArrow(_keys(parts), "part long, packed binary")
    met = written(keys.repartition("part").mapInArrow(lines._meet(lines.PAIRED, lines.HEADS), "crowded boolean, a long, b long"), "met")
    edges = _similar_pairs(met.where(~F.col("crowded")).select("a", "b"), found, texts)
    crowded = met.where("crowded").select(F.col("a").alias("key"), F.col("b").alias("class"))
    if crowded.isEmpty():
        return edges
    sizes = found.select(F.col("class").alias("line"), F.col("size").alias("words"), "sketch")
    return edges.union(_similar_pairs(lines.crowded_pairs(crowded.withColumnRenamed("class", "line"), components(edges), sizes), found, texts))
