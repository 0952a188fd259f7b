"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

A window is ``WINDOW`` consecutive words of a benchmark item (an item of fewer words is
one window).  Its tokens are its shingles of ``SHINGLE`` words (of all its words if it has
fewer).  Tokens are ordered by rarity: how often they occur in the whole corpus, then by
hash.  A document that contains a window holds all its tokens, so a prefix of one
token, the rarest, is necessary; its offset in the window is kept.

A document's tokens that may be prefix tokens (a bitmap of fixed size says so) are joined
with the prefix table.  Positional and length bounds follow from the offset: the window
must begin at ``position - offset`` and end within the document.  What is left is verified
word by word over the item-sized window.

The bitmap has a bounded number of bits whatever the benchmark's size; a full one only
lets more tokens through to the join.  The prefix table is broadcast up to
``BROADCAST_ROWS`` windows and shuffled beyond.

Defined cases: null text has no words and, as an item, no windows; a null item_id counts
as the empty string; items that share an id count as one.  Documents that repeat doc_id and
text give repeated results.  An empty benchmark hits nothing.  Words are equal if their
64-bit hashes are, which all words of a window must be.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.shared import Bitmap, fresh, prepare, slots, written

WINDOW, SHINGLE = 13, 3
BROADCAST_ROWS = 200_000

#: ASCII but digits and letters stands between words; upper-case letters are lowered first.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a chunk and, for each row, the index of its first one."""
    low = _LOWER[data]
    starts, ends, first = tk.split_words(low, offsets, _BREAKS)
    return tk.hash_words(low, starts, ends), first


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tk.text_chunks(batches):
        hashes, first = _words(data, offsets)
        ids, windows, tokens = [], [], []
        for i in range(rows.num_rows):
            own = hashes[first[i] : first[i + 1]]
            size = min(WINDOW, own.size)
            if not size:
                continue
            shingles = tk.signed(tk.Sequence(own).runs(min(SHINGLE, size)))
            for s in range(own.size - size + 1):
                ids.append(i)
                windows.append(tk.signed(own[s : s + size]))
                tokens.append(shingles[s : s + size - min(SHINGLE, size) + 1])
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(ids, pa.int64())), pa.array(windows, longs), pa.array(tokens, longs)], names=["item_id", "words", "tokens"])


def _streams(hashes: np.ndarray, first: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per shingle size: positions that lie within one row, and their tokens."""
    seq = tk.Sequence(hashes)
    stop = np.repeat(first[1:], np.diff(first))
    for size in sizes:
        tokens = seq.runs(size)
        inside = np.arange(tokens.size) + size <= stop[: tokens.size]
        yield inside, tokens


def _count_tokens(bitmap, sizes: list[int]):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = bitmap.value.mask()
        for _, data, offsets in tk.text_chunks(batches):
            hashes, first = _words(data, offsets)
            for inside, tokens in _streams(hashes, first, sizes):
                found = tokens[inside & here[slots(tokens, here.size)]]
                kinds, counts = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(tk.signed(kinds)), pa.array(counts)], names=["token", "n"])

    return counted


def _candidates(bitmap, sizes: list[int]):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = bitmap.value.mask()
        longs = pa.list_(pa.int64())
        for rows, data, offsets in tk.text_chunks(batches):
            hashes, first = _words(data, offsets)
            tag = tk.Sequence(hashes).of(first[:-1], first[1:])
            count = np.diff(first)

            def batch(row, token, position, left, words):
                return pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row, pa.int64())), pa.array(tk.signed(tag[row])), pa.array(count[row], pa.int64()), token, position, left, words],  # noqa: B023
                    names=["doc_id", "tag", "n_words", "token", "position", "left", "words"],
                )

            every, none = np.arange(rows.num_rows), rows.num_rows
            yield batch(every, pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.nulls(none, longs))
            for inside, tokens in _streams(hashes, first, sizes):
                at = np.flatnonzero(inside & here[slots(tokens, here.size)])
                if not at.size:
                    continue
                row = np.searchsorted(first, at, "right") - 1
                lo, hi = np.maximum(at - WINDOW + 1, first[row]), np.minimum(at + WINDOW, first[row + 1])
                around = [tk.signed(hashes[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield batch(row, pa.array(tk.signed(tokens[at])), pa.array(at - first[row]), pa.array(at - lo), pa.array(around, longs))

    return found


def _covered(spans: Column) -> Column:
    """Words covered by sorted spans (first word, end)."""
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def step(s: Column, x: Column) -> Column:
        fresh = F.greatest(x["end"] - F.greatest(x["first"], s["end"]), F.lit(0).cast("long"))
        return F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + fresh).alias("n"))

    return F.aggregate(spans, start, step)["n"]


def find_items(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, tag, n_words, n_hit, items, spans, copies``.

    ``items`` are the ids (as strings, sorted) with a window in the document, ``spans`` the
    hit runs of words as (first, end).  Rows equal in doc_id and text are one row with
    their number in ``copies``; ``tag`` is a digest of the words.
    """
    spark = documents.sparkSession
    prepare(spark)
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    windows = items.mapInArrow(_item_windows, "item_id string, words array<long>, tokens array<long>")
    windows = written(windows.groupBy("words").agg(F.first("tokens").alias("tokens"), F.collect_set("item_id").alias("items")), "windows")
    tokens = windows.select(F.explode("tokens").alias("token")).distinct()
    sizes = [r[0] for r in windows.select(F.least(F.size("words"), F.lit(SHINGLE))).distinct().orderBy(F.lit(1)).collect()]
    bitmap = spark.sparkContext.broadcast(Bitmap(tokens, tokens.count()))
    counts = docs.mapInArrow(_count_tokens(bitmap, sizes), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    placed = windows.select("words", "items", F.posexplode("tokens").alias("offset", "token"))
    placed = placed.join(counts, "token", "left").select("words", "items", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset").alias("at"))
    prefix = placed.groupBy("words").agg(F.min("at").alias("at"), F.first("items").alias("items"))
    prefix = written(prefix.select("at.token", "at.offset", F.col("words").alias("wanted"), "items"), "prefix")
    size = prefix.count()
    bitmap = spark.sparkContext.broadcast(Bitmap(prefix.select("token"), size))
    rows = docs.mapInArrow(_candidates(bitmap, sizes), "doc_id long, tag long, n_words long, token long, position long, left long, words array<long>")
    joined = rows.join(F.broadcast(prefix) if size <= BROADCAST_ROWS else prefix, "token", "left")
    begin = F.col("left") - F.col("offset") + 1
    same = (begin >= 1) & (F.slice("words", F.greatest(begin, F.lit(1)).cast("int"), F.size("wanted")) == F.col("wanted"))
    first = F.col("position") - F.col("offset")
    span = F.when(same, F.struct(first.alias("first"), (first + F.size("wanted")).alias("end")))
    hits = joined.select("doc_id", "tag", "n_words", F.col("token").isNull().cast("int").alias("own"), span.alias("span"), F.when(same, F.col("items")).alias("items"))
    docs = hits.groupBy("doc_id", "tag", "n_words").agg(
        F.sort_array(F.collect_set("span")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("own").alias("copies")
    )
    return docs.select("doc_id", "tag", "n_words", _covered(F.col("spans")).alias("n_hit"), "items", "spans", "copies")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from :func:`find_items`."""
    rows = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the contaminated ones; all columns stay."""
    own, of, known = fresh(documents, "tag", "of", "known")
    found = find_items(documents, benchmark).where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias(of), F.col("tag").alias(known))
    others = [c for c in documents.columns if c != "text"]
    rows = documents.select("text", *others)

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in tk.text_chunks(batches):
            hashes, first = _words(data, offsets)
            tag = tk.signed(tk.Sequence(hashes).of(first[:-1], first[1:]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(tag)], names=[*part.schema.names, own])

    rows = rows.mapInArrow(tagged, T.StructType([*rows.schema.fields, T.StructField(own, T.LongType())]))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(known))
    return rows.join(written(found, "contaminated"), same, "left_anti").select(*documents.columns)


def brute_force(documents: list[tuple[int, str | None]], benchmark: list[tuple[object, str | None]]) -> list[tuple]:
    """The contract, window by window; for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: pattern.findall((t or "").translate(lower))
    windows: dict[tuple[str, ...], set[str]] = {}
    for item, text in benchmark:
        words = split(text)
        size = min(WINDOW, len(words))
        for s in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[s : s + size]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in documents:
        words = split(text)
        hit, items = set(), set()
        for size in sizes:
            for s in range(len(words) - size + 1):
                if (w := tuple(words[s : s + size])) in windows:
                    hit.update(range(s, s + size))
                    items |= windows[w]
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc_id, len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(13, len(words)) AS size FROM items WHERE len(words) > 0),
cut AS (SELECT item_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM sized),
windows AS (SELECT DISTINCT item_id, size, array_to_string(words[s:s + size - 1], ' ') AS win FROM cut),
places AS (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS s FROM docs, (SELECT DISTINCT size FROM sized) WHERE len(words) >= size),
hits AS (SELECT doc_id, s, places.size, item_id FROM places JOIN windows ON places.size = windows.size AND array_to_string(words[s:s + places.size - 1], ' ') = win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS p FROM (SELECT DISTINCT doc_id, s, size FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
