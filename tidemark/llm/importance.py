"""Target-distribution importance resampling over hashed word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Features are all
runs of one to ``LONGEST`` consecutive words, joined by one space; a feature's bucket is
its CRC-32 modulo ``BUCKETS``.  No n-gram string is made: each word's CRC is computed
once, and the CRC of a longer text follows from those of its parts.  Appending ``n`` bytes
to a text multiplies its CRC by a fixed 32 x 32 matrix over GF(2); XOR with the CRC of what
is appended gives the whole.  The matrices for 0 to 31 bytes, and for each power of
two, are tables of four times 256 entries, built by squaring the matrix of one zero byte.

A bucket's gain compares its smoothed share of the target with that of the documents.  A
document's weight is the sum of the gains of its features; with Gumbel noise from the
hash of its doc_id added, the highest scores are a sample without replacement in
proportion to exp(weight / 1000).

Counts cover all documents and all target texts; a task gives at most one row a bucket, and
what the driver holds is one gain a bucket.  Ranks never gather the corpus: a histogram of
scores finds a level that the drawn share lies above, only rows above it are dealt out by
ranges of the order and counted, and the rest is not sorted.

Defined cases: null and empty texts have no features and weight 0.  A null doc_id counts as
the empty string in the noise and ranks after all others.  Repeated rows are documents of
their own with equal scores.  Empty tables give zero counts, hence gains by smoothing alone.
Other columns stay; columns of the names added are replaced.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.shared import prepare, written
from tidemark.operators.order import rank_all

BUCKETS, LONGEST = 10_000, 3
#: Documents that may be drawn have so many words; of those so many in a hundred are.
LEAST_WORDS, PERCENT = 20, 5
SEED = 42
#: Steps of the histogram of scores that bounds what is ranked.
LEVELS = 4096
#: Longer words get their CRC from zlib, one by one.
LONG_WORD = 64
ADDED = ["n_words", "n_features", "weight"]

U32 = np.uint32


def _byte_table() -> np.ndarray:
    """CRC-32 (reflected polynomial EDB88320) of each byte value."""
    out = np.arange(256, dtype=U32)
    for _ in range(8):
        out = np.where(out & U32(1), (out >> U32(1)) ^ U32(0xEDB88320), out >> U32(1))
    return out


_BYTE = _byte_table()


class Shifts:
    """What appending bytes does to a CRC: linear maps over GF(2), as byte tables."""

    def __init__(self, powers: int = 40):
        one = np.left_shift(U32(1), np.arange(32, dtype=U32))
        columns = _BYTE[one & U32(255)] ^ (one >> U32(8))
        self.powers = [self._table(columns)]
        for _ in range(powers - 1):
            columns = self._apply(self.powers[-1], columns)
            self.powers.append(self._table(columns))
        steps, columns = [], one
        for _ in range(32):
            steps.append(self._table(columns))
            columns = self._apply(self.powers[0], columns)
        self.few = np.concatenate([t.ravel() for t in steps])

    @staticmethod
    def _table(columns: np.ndarray) -> np.ndarray:
        """The images of all values of each of the four bytes, from those of single bits."""
        out = np.zeros((4, 256), U32)
        for i in range(32):
            out[i // 8] ^= np.where(np.arange(256) >> (i % 8) & 1, columns[i], U32(0)).astype(U32)
        return out

    @staticmethod
    def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return table[0][crc & U32(255)] ^ table[1][crc >> U32(8) & U32(255)] ^ table[2][crc >> U32(16) & U32(255)] ^ table[3][crc >> U32(24)]

    def one(self, crc: np.ndarray) -> np.ndarray:
        return self._apply(self.powers[0], crc)

    def by(self, crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each CRC moved on by its own number of bytes."""
        base = (lengths & 31) * 1024
        few = self.few
        out = few[base + (crc & U32(255))] ^ few[base + 256 + (crc >> U32(8) & U32(255))]
        out ^= few[base + 512 + (crc >> U32(16) & U32(255))] ^ few[base + 768 + (crc >> U32(24))]
        rest, power = lengths >> 5, 5
        while rest.any():
            at = np.flatnonzero(rest & 1)
            out[at] = self._apply(self.powers[power], out[at])
            rest, power = rest >> 1, power + 1
        return out


SHIFTS = Shifts()
_SPACE = U32(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: byte by byte for all words at once, the longest ones first."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    sizes, at = lengths[order], starts[order]
    long = int(np.searchsorted(-sizes, -LONG_WORD, "left"))
    register = np.full(order.size, 0xFFFFFFFF, U32)
    for k in range(int(sizes[long]) if long < sizes.size else 0):
        active = slice(long, int(np.searchsorted(-sizes, -k, "left")))
        r = register[active]
        register[active] = _BYTE[(r ^ data[at[active] + k]) & U32(255)] ^ (r >> U32(8))
    out = np.empty(order.size, U32)
    out[order] = ~register
    for i in order[:long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, longest: int) -> Iterator[np.ndarray]:
    """CRCs of all runs of 1, 2, ... ``longest`` words joined by a space; item i starts at word i."""
    runs = crcs
    yield runs
    for n in range(1, longest):
        runs = SHIFTS.by(SHIFTS.one(runs[: max(runs.size - 1, 0)]) ^ _SPACE, lengths[n:]) ^ crcs[n:]
        yield runs


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """First word of each row, and for each run length: which runs lie in one row, and their buckets."""
    low = tk.LOWER[data]
    starts, ends, first = tk.split_words(low, offsets, tk.ASCII_MARKS)
    stop = np.repeat(first[1:], np.diff(first))

    def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for n, runs in enumerate(run_crcs(word_crcs(low, starts, ends), ends - starts, LONGEST), 1):
            yield np.arange(runs.size) + n <= stop[: runs.size], (runs % U32(BUCKETS)).astype(np.int64)

    return first, each()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for _, data, offsets in tk.text_chunks(batches):
        for inside, found in buckets(data, offsets)[1]:
            counts += np.bincount(found[inside], minlength=BUCKETS)
    here = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(counts[here])], names=["bucket", "n"])


def bucket_counts(texts: DataFrame) -> DataFrame:
    """``bucket, n`` over all rows of a column ``text``; buckets without features are left out."""
    prepare(texts.sparkSession)
    return texts.select("text").mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket: floor(1000 ln) of its smoothed share in the target over that in the documents."""
    both = bucket_counts(documents).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        bucket_counts(target).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    )
    found = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).toArrow()
    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    at = found["bucket"].to_numpy()
    s[at], t[at] = found["s"].to_numpy(), found["t"].to_numpy()
    up = (t + 1).astype(float) * float(s.sum() + BUCKETS)
    down = (s + 1).astype(float) * float(t.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(r)) for r in up / down], np.int64)


def weigh(documents: DataFrame, gain: np.ndarray) -> DataFrame:
    """``documents`` with ``n_words, n_features, weight``."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(gain)
    docs = documents.drop(*ADDED)
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for rows, data, offsets in tk.text_chunks(batches):
            first, each = buckets(data, offsets)
            n_features, weight = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
            for inside, found in each:
                lo, hi = np.minimum(first[:-1], found.size), np.minimum(first[1:], found.size)
                for out, values in ((n_features, inside.astype(np.int64)), (weight, np.where(inside, of[found], 0))):
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(values)])
                    out += sums[hi] - sums[lo]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(first)), pa.array(n_features), pa.array(weight)], names=[*rows.schema.names, *ADDED])

    return docs.mapInArrow(weighed, T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in ADDED]]))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` with ``rank``: 1, 2, 3 for the drawn, else null."""
    scored = written(scored, "scored")
    may = F.col("n_words") >= least_words
    n, low, high = scored.where(may).agg(F.count("*"), F.min("score"), F.max("score")).first()
    draws = percent * n // 100
    if not draws:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    width = (high - low) // LEVELS + 1
    level = F.floor((F.col("score") - low) / width).cast("int")
    edge, room = low, draws
    for row in scored.where(may).groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():
        room -= row.n
        if room <= 0:
            edge = low + row.level * width
            break
    above = F.coalesce(may & (F.col("score") >= edge), F.lit(False))
    order = {"_down": -F.col("score"), "_none": F.col("doc_id").isNull().cast("int"), "_id": F.col("doc_id"), "_size": F.col("n_features")}
    top = rank_all(scored.where(above).withColumns(order), list(order), "rank").drop(*order)
    top = top.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank").cast("long")))
    return top.unionByName(scored.where(~above).withColumn("rank", F.lit(None).cast("long")))


def importance(documents: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` for every document; null ranks are not drawn."""
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    scored = weigh(rows, gains(rows, target)).drop("text")
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return ranked(scored, least_words, percent)


def draw(documents: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """The drawn rows of ``documents``, whole.

    The last drawn row's place in the order bounds the sample; rows equal to it in
    doc_id, score and number of features come along.
    """
    rows = documents.select(F.col("doc_id").cast("long"), "text")
    gain = gains(rows, target)
    scored = weigh(rows, gain).drop("text").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    order = [-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("n_features")]
    place = F.struct(*[c.alias(f"p{i}") for i, c in enumerate(order)])
    last = ranked(scored, least_words, percent).where("rank IS NOT NULL").agg(F.max(place).alias("p")).first()["p"]
    if last is None:
        return documents.limit(0)
    whole = documents.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = weigh(whole, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    bound = F.struct(*[F.lit(v).cast("long").alias(f"p{i}") for i, v in enumerate(last)])
    return rows.where((F.col("n_words") >= least_words) & (place <= bound)).select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the contract, from :func:`importance`."""
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def brute_force(documents: list[tuple[int, str | None]], target: list[str | None]) -> list[tuple]:
    """The contract with n-gram strings; for tests."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text: str | None) -> tuple[int, list[int]]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % BUCKETS for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in documents]
    s = Counter(b for _, _, own in found for b in own)
    t = Counter(b for text in target for b in features(text)[1])
    all_s, all_t = s.total() + BUCKETS, t.total() + BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t)))
    rows = []
    for i, n, own in found:
        weight = sum(map(gain, own))
        h = int(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    may = sorted((r for r in rows if r[4] >= LEAST_WORDS), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    places: dict[tuple, list[int]] = {}
    for place, r in enumerate(may[: PERCENT * len(may) // 100], 1):
        places.setdefault(r, []).append(place)
    return [(*r[:4], places[r].pop(0) if places.get(r) else None) for r in rows]


#: CRC-32 bit by bit over the hexadecimal form of each distinct feature.
ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
runs AS (
  SELECT doc_id, array_to_string(words[i:i + n - 1], ' ') AS f FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM docs, (VALUES (1), (2), (3)) AS g(n) WHERE len(words) >= n)),
item_runs AS (
  SELECT array_to_string(words[i:i + n - 1], ' ') AS f FROM (SELECT words, n, unnest(range(1, len(words) - n + 2)) AS i FROM items, (VALUES (1), (2), (3)) AS g(n) WHERE len(words) >= n)),
bits AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM runs UNION SELECT f FROM item_runs)),
crcs AS (
  SELECT f, (xor(list_reduce(list_prepend(4294967295::BIGINT, [(strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1 FOR i IN range(1, len(h) // 2 + 1)]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10000) AS bucket FROM bits),
of_docs AS (SELECT bucket, count(*) AS s FROM runs JOIN crcs USING (f) GROUP BY bucket),
of_items AS (SELECT bucket, count(*) AS t FROM item_runs JOIN crcs USING (f) GROUP BY bucket),
sums AS (SELECT coalesce((SELECT sum(s) FROM of_docs), 0)::DOUBLE AS s_all, coalesce((SELECT sum(t) FROM of_items), 0)::DOUBLE AS t_all),
gains AS (SELECT b.range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN of_docs d ON d.bucket = b.range LEFT JOIN of_items i ON i.bucket = b.range, sums),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM runs JOIN crcs USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, len(words) AS n_words,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || d.doc_id)[1:8])::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM docs d LEFT JOIN weights USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN places USING (doc_id)
"""
