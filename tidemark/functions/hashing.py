"""Hashes of texts that are the same everywhere: stable keys and bags of features in hashed slots."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of 64-bit FNV-1a: the basis in two halves, and the prime without its bit 40.
BASIS_HIGH, BASIS_LOW, PRIME_LOW = 0xCBF29CE4, 0x84222325, 0x1B3
HALF = 0xFFFFFFFF
#: Features of one piece of a text, so that a batch is bounded; cells of one table of counts; features that a task remembers.
PIECE, CELLS, KNOWN = 1024, 1 << 20, 1 << 18


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of a text's UTF-8 bytes as 16 hexadecimal digits; null stays null.

    The state is kept in halves of 32 bits, so no product overflows a long.
    """
    pairs = F.filter(F.split(F.hex(F.encode(c, "UTF-8")), r"(?<=\G..)"), lambda x: x != "")
    codes = F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("long"))
    start = F.struct(F.lit(BASIS_HIGH).cast("long").alias("high"), F.lit(BASIS_LOW).cast("long").alias("low"))

    def step(state: Column, code: Column) -> Column:
        low = state["low"].bitwiseXOR(code)
        product = low * F.lit(PRIME_LOW)
        high = state["high"] * F.lit(PRIME_LOW) + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(F.lit(HALF)).alias("high"), product.bitwiseAND(F.lit(HALF)).alias("low"))

    def digits(half: Column) -> Column:
        return F.lpad(F.lower(F.hex(half)), 8, "0")

    return F.aggregate(codes, start, step, lambda s: F.concat(digits(s["high"]), digits(s["low"])))


def words(c: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")


def character_grams(found: Column, size: int = 4) -> Column:
    """The words and the character grams of each word with a blank at either end."""

    def grams(word: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(word) + 3 - size), lambda i: F.concat(F.lit(" "), word, F.lit(" ")).substr(i, F.lit(size)))

    return F.concat(found, F.flatten(F.transform(F.filter(found, lambda x: F.length(x) >= size - 2), grams)))


def word_pairs(found: Column) -> Column:
    """The words and the pairs of neighbouring ones."""
    pairs = F.zip_with(found, F.slice(found, F.lit(2), F.size(found)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(found, F.filter(pairs, lambda x: x.isNotNull()))


def grams_of(word: str, size: int = 4) -> list[str]:
    """A word and its character grams, as :func:`character_grams` has them."""
    wide = f" {word} "
    return [word, *(wide[i : i + size] for i in range(len(wide) - size + 1))]


def bag(df: DataFrame, key: str, features: Column, slots: int, counted: Callable[[str], list[str]] | None = None) -> DataFrame:
    """``key, slot, weight``: counts of an array's features in hashed slots, scaled to length one.

    ``counted`` names what is counted for each feature instead of itself; a task then hashes that once for a
    feature, however often it comes.  Counts are combined before the shuffle; a key has ``slots`` rows at most.
    """
    kind = dict(df.dtypes)[key]
    length = F.sqrt(F.sum(F.col("_n") * F.col("_n")).over(W.partitionBy(key)))
    if counted is None:
        slot = F.conv(F.substring(F.md5("_feature"), 1, 8), 16, 10).cast("long") % slots
        whole = df.select(key, F.explode(features).alias("_feature")).groupBy(key, slot.alias("slot")).agg(F.count("*").alias("_n"))
        return whole.select(key, "slot", (F.col("_n") / length).alias("weight"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def slots_of(feature: str) -> np.ndarray:
            found = known.get(feature)
            if found is None:
                if len(known) >= KNOWN:
                    known.clear()
                texts = counted(feature)
                found = known[feature] = np.array([int.from_bytes(md5(t.encode()).digest()[:4], "big") % slots for t in texts], np.int64)
            return found

        step = max(1, CELLS // slots)
        for batch in batches:
            for first in range(0, batch.num_rows, step):
                rows = batch.slice(first, step)
                row = pc.list_parent_indices(rows.column(1)).to_numpy(zero_copy_only=False)
                coded = pc.list_flatten(rows.column(1)).dictionary_encode()
                each = [slots_of(f) for f in coded.dictionary.to_pylist()]
                size = np.array([len(e) for e in each], np.int64)
                start = np.cumsum(size) - size
                flat = np.concatenate(each) if each else np.zeros(0, np.int64)
                total = np.zeros(rows.num_rows * slots, np.int64)
                code = coded.indices.to_numpy(zero_copy_only=False)
                most = max(1, CELLS // 4)
                for at in range(0, len(code), most):
                    c = code[at : at + most]
                    n = size[c]
                    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    total += np.bincount(np.repeat(row[at : at + most] * slots, n) + flat[np.repeat(start[c], n) + inner], minlength=len(total))
                cell = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(cell // slots)), pa.array(cell % slots), pa.array(total[cell])], names=[key, "slot", "_n"])

    # A long text comes in pieces, so that a batch is bounded.
    cut = df.select(key, features.alias("_all")).select(key, "_all", F.explode_outer(F.sequence(F.lit(1), F.greatest(F.size("_all"), F.lit(1)), F.lit(PIECE))).alias("_at"))
    found = cut.select(key, F.slice("_all", F.col("_at"), F.lit(PIECE)).alias("_features")).mapInArrow(counts, f"`{key}` {kind}, slot long, _n long")
    whole = found.groupBy(key, "slot").agg(F.sum("_n").alias("_n"))
    return whole.select(key, "slot", (F.col("_n") / length).alias("weight"))
