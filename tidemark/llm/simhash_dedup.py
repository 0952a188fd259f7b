"""SimHash near-dedup over covering locality-sensitive hashing, and the pipeline's near-dedup.

Fingerprint: 64 bits over the 3-word shingles of the lower-cased text (A-Z only),
repeats included; a bit is set if it is set in over half of the shingles' XXH64
values (seed 42).  Two fingerprints link at ``RADIUS`` or fewer differing bits.

Candidates: bit ``i`` has a vector of ``RADIUS + 1`` bits.  Each of the
``2 ** (RADIUS + 1) - 1`` non-zero vectors ``v`` gives a table whose mask keeps the bits
with an odd product with ``v``.  The vectors of at most ``RADIUS`` differing bits do not
span the space, so some ``v`` is orthogonal to all of them: that table masks out every
differing bit, and the pair collides there.  No pair within the radius is missed.

Tables hold distinct fingerprints, one row per class of equal ones, so copies add
nothing.  A bucket of up to ``PAIRED`` fingerprints is verified pair by pair.  In a larger
one each fingerprint gives itself and all its one-bit neighbours within the bucket;
two fingerprints that differ in at most two bits share one of these, and a shared value
links each of its (at most 65) owners to the least of them.  That is exact as well and grows in
proportion to the bucket.

Defined cases: null, empty or blank text has fingerprint zero, which links like any
other.  Null doc_id never names a component unless all its members are null.  Repeated
rows give repeated results.  ``keep_one`` keeps one row of each component, that of the
smallest doc_id (null last), then of the smallest digest of its text; rows that share
doc_id but not the text, or have none, are told apart by that digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingle_join
from tidemark.llm import textkit as tk
from tidemark.llm.shared import components, fresh, prepare, written

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Largest bucket that is verified pair by pair.
PAIRED = 128


def masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The covering masks; bit ``i`` has vector ``1 + i mod (2 ** (radius + 1) - 1)``."""
    count = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((1 + i % count) & v).bit_count() % 2) for v in range(1, count + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    line, hash_of = b" ".join(words), xxhash.xxh64_intdigest
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    stops = np.cumsum(sizes)
    ends = (stops - 1)[SHINGLE - 1 :].tolist()
    starts = (stops - sizes)[: len(ends)].tolist()
    return [hash_of(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in tk.text_chunks(batches):
        found = [shingle_hashes(t) for t in rows.column(1).to_pylist()]
        counts = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((h for x in found for h in x), np.uint64, int(counts.sum()))
        bits = tk.majority_bits(flat, np.cumsum(counts) - counts, counts)
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(tk.signed(bits))], names=["doc_id", "bits"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, bits``: the fingerprint of each document as a signed 64-bit integer."""
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprints, "doc_id long, bits long")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``a, b`` that join all distinct ``bits`` linked at the radius (which is 2 here)."""
    if radius != RADIUS:
        raise ValueError("the one-bit neighbours of large buckets cover a radius of 2")
    tables = [F.struct(F.lit(t).alias("t"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks())]
    rows = prints.select("bits", F.explode(F.array(*tables)).alias("at")).select("bits", "at.t", "at.key")
    sizes = rows.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    rows = written(rows.join(sizes, ["t", "key"]), "buckets")
    small = rows.where(F.col("size") <= PAIRED)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS
    pairs = small.select("t", "key", F.col("bits").alias("a")).join(small.select("t", "key", F.col("bits").alias("b")), ["t", "key"])
    pairs = pairs.where("a < b").where(near).select("a", "b").distinct()
    free = F.array(*[F.array(*[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks()])
    flips: Column = F.concat(F.array(F.lit(0).cast("long")), F.get(free, F.col("t")))
    large = rows.where(F.col("size") > PAIRED).select("t", "bits", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("bits")))).alias("near"))
    owners = large.groupBy("near").agg(F.collect_set("bits").alias("owners"))
    shared = owners.select(F.array_min("owners").alias("a"), F.explode("owners").alias("b")).where("a <> b")
    return pairs.union(shared).distinct()


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per row of ``documents``."""
    prints = written(fingerprints(documents), "prints")
    classes = prints.groupBy("bits").agg(F.min("doc_id").alias("least"))
    joined = components(links(classes))
    label = classes.join(joined, F.col("bits") == F.col("node"), "left").select("bits", "least", F.coalesce("component", "bits").alias("root"))
    roots = label.groupBy("root").agg(F.min("least").alias("component_id"))
    label = label.join(roots, "root").select("bits", "component_id")
    return prints.join(label, "bits").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each component of texts that their fingerprints link, or an exact comparison of shingles.

    Fingerprints and links are those of ``near_duplicates``.  Similar texts whose fingerprints lie further
    apart are found by ``shingle_join``.
    """
    prepare(documents.sparkSession)
    digest = F.xxhash64("text")
    tagged = documents.select(F.col("doc_id").cast("long"), digest.alias("digest"), "text")
    named = written(tagged.mapInArrow(shingle_join.classes, "doc_id long, digest long, class long, size long, sketch binary"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "digest")).alias("first")
    classes = written(named.groupBy("class").agg(F.max("size").alias("size"), F.max("sketch").alias("sketch"), first), "classes")
    # A fingerprint stands for the least class that has it; equal digests are equal texts.
    prints = fingerprints(tagged.select(F.col("digest").alias("doc_id"), "text")).distinct()
    of_print = written(prints.join(named.select(F.col("digest").alias("doc_id"), "class").distinct(), "doc_id").select("bits", "class").distinct(), "prints")
    stands = of_print.groupBy("bits").agg(F.min("class").alias("node"))
    same = of_print.join(stands, "bits").select(F.col("node").alias("a"), F.col("class").alias("b")).where("a <> b")
    end = lambda side, node: stands.select(F.col("bits").alias(side), F.col("node").alias(node))
    near = links(of_print.select("bits").distinct()).join(end("a", "p"), "a").join(end("b", "q"), "b").select(F.col("p").alias("a"), F.col("q").alias("b"))
    joined = components(same.union(near).union(shingle_join.links(classes, tagged).select("a", "b")))
    rooted = classes.join(joined, F.col("class") == F.col("node"), "left").select("first", F.coalesce("component", "class").alias("root"))
    own, of, stays = fresh(documents, "digest", "kept", "kept_digest")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(of), F.col("first.digest").alias(stays))
    rows = documents.withColumn(own, digest)
    rows = rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(of)) & (F.col(own) == F.col(stays)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).select(*documents.columns)


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, str, int]]:
    """The contract over all pairs; for tests."""
    prints = []
    for _, text in rows:
        hashes = shingle_hashes(text)
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= RADIUS:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        least[r] = min(least.get(r, doc_id), doc_id)
    return sorted((doc_id, f"{prints[i]:016x}", least[find(i)]) for i, (doc_id, _) in enumerate(rows))
