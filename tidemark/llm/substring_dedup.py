"""Substring dedup: seed and extend over winnowed anchors.

A window is ``WINDOW`` consecutive words of one document.  A word is removed if a
window that covers it has the same word sequence as a window that starts earlier
(smaller doc_id, or the same document and an earlier start).

Seed: every window picks one anchor, its gram of ``GRAM`` words with the least hash
(leftmost on ties), so equal windows pick equal anchors at equal offsets.  About two
in ``WINDOW - GRAM + 2`` words start an anchor.  Only anchors that occur again go on.

Extend: all windows that picked one anchor occurrence form a span.  Where the span as
a whole, the anchor extended both ways as far as its windows reach, was seen before,
all its windows repeat.  First spans of an anchor that occurs in differing contexts
are extended window by window.  Overlapping repeats join into maximal ones.

Groups are never gathered: the first occurrence of each span and of each window is a
minimum, combined before the shuffle.  A document learns of its repeats as the spans
and windows that it has less those where it is the first, so no pairs are made.

Defined cases: null or blank text has no words; fewer than ``WINDOW`` words, nothing is
removed.  Null doc_id counts as smallest.  Rows that repeat doc_id and text get equal
results, as one document; rows that share only doc_id are told apart by a digest of
their words.  Equality of sequences is equality of 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import prepare, written

WINDOW, GRAM = 20, 5
PICK = WINDOW - GRAM + 1
U = np.uint64
#: A place in a document: start of the first window, digest of the document's words,
#: and how many windows follow the first one.
START, TAG_BITS = 33, 25
TAG = ((1 << TAG_BITS) - 1) << 8


def _layout(data: np.ndarray, offsets: np.ndarray):
    starts, ends, first = tk.split_words(data, offsets)
    hashes = tk.hash_words(data, starts, ends)
    seq = tk.Sequence(hashes)
    tag = seq.of(first[:-1], first[1:]) >> U(64 - TAG_BITS)
    return starts, ends, first, hashes, seq, tag


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tk.text_chunks(batches):
        _, _, first, _, seq, tag = _layout(data, offsets)
        picks = tk.sliding_argmin(grams, PICK) if (grams := seq.runs(GRAM)).size >= PICK else np.zeros(0, np.int64)
        stop = np.repeat(first[1:], np.diff(first))[: picks.size]
        window = np.flatnonzero(np.arange(picks.size) + WINDOW <= stop)
        if not window.size:
            continue
        anchor = picks[window]
        heads = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        lo, hi, at = window[heads], window[np.r_[heads[1:], window.size] - 1], anchor[heads]
        row = np.searchsorted(first, lo, "right") - 1
        span = tk.mix(seq.of(lo, hi + WINDOW) ^ (U(32) * (at - lo).astype(U) + (hi - lo).astype(U)))
        place = ((lo - first[row]).astype(U) << U(START)) | (tag[row] << U(8)) | (hi - lo).astype(U)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tk.signed(grams[at])), pa.array(tk.signed(span)), rows.column(0).take(pa.array(row)), pa.array(tk.signed(place))],
            names=["gram", "span", "doc_id", "place"],
        )


def _windows_of(places: np.ndarray) -> np.ndarray:
    """Starts of all windows of the spans."""
    count = (places & 255) + 1
    heads = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(places >> START, count) + np.arange(heads.size) - heads


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the windows of the spans that need to be extended one by one."""
    for rows, data, offsets in tk.text_chunks(batches):
        _, _, first, hashes, seq, tag = _layout(data, offsets)
        second = tk.Sequence(hashes, tk.SECOND)
        kinds, places = rows.column(2), rows.column(3)
        for i in range(rows.num_rows):
            kind, place = (np.asarray(x[i].values) for x in (kinds, places))
            mine = ((place & TAG) >> 8 == int(tag[i])) & (kind == 2)
            if not mine.any():
                continue
            start = np.unique(_windows_of(place[mine]))
            at = start + first[i]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(tk.signed(seq.of(at, at + WINDOW))),
                    pa.array(tk.signed(second.of(at, at + WINDOW))),
                    rows.column(0).take(pa.array(np.full(start.size, i))),
                    pa.array((start << START) | (int(tag[i]) << 8)),
                ],
                names=["gram", "span", "doc_id", "place"],
            )


def _result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tk.text_chunks(batches):
        starts, ends, first, _, _, tag = _layout(data, offsets)
        raw = data.tobytes()
        out = {"n_words": [], "n_removed": [], "kept_text": [], "repeats": []}
        for i in range(rows.num_rows):
            n = int(first[i + 1] - first[i])
            edge = np.zeros(n + 1, np.int64)
            get = lambda c: np.asarray(x.values) if (x := rows.column(c)[i]).is_valid else np.zeros(0, np.int64)  # noqa: B023, E731
            kind, place, known = get(2), get(3), get(4)
            if kind.size:
                own = (place & TAG) >> 8 == int(tag[i])
                kind, place = kind[own], place[own]
                known = known[(known & TAG) >> 8 == int(tag[i])]
                again = np.setdiff1d(place[kind == 0], place[kind > 0])
                np.add.at(edge, again >> START, 1)
                np.add.at(edge, (again >> START) + (again & 255) + WINDOW, -1)
                again = np.setdiff1d(_windows_of(place[kind == 2]), known >> START)
                np.add.at(edge, again, 1)
                np.add.at(edge, again + WINDOW, -1)
            gone = np.cumsum(edge[:n]) > 0
            side = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
            a, b = starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]]
            out["n_words"].append(n)
            out["n_removed"].append(int(gone.sum()))
            keep = np.flatnonzero(~gone)
            out["kept_text"].append(b" ".join([raw[x:y] for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]))
            out["repeats"].append([{"first_word": x, "end_word": y} for x, y in zip(side[::2].tolist(), side[1::2].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                rows.column(0),
                pa.array(out["n_words"], pa.int64()),
                pa.array(out["n_removed"], pa.int64()),
                pa.array(out["kept_text"], pa.binary()).cast(pa.string()),
                pa.array(out["repeats"], pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64())]))),
            ],
            names=["doc_id", "n_words", "n_removed", "kept_text", "repeats"],
        )


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_removed, kept_text, repeats``.

    ``repeats`` lists the maximal removed runs of words as [first_word, end_word).
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long"), "text")
    place = "gram long, span long, doc_id long, place long"
    anchors = docs.mapInArrow(_anchors, place)
    # Written, so both sides of the join are plain shuffles and a very frequent anchor's rows can be split over tasks.
    again = written(docs.mapInArrow(_anchors, place).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "again")
    seeds = written(anchors.join(again, "gram", "left_semi"), "seeds")
    firsts = seeds.groupBy("gram", "span").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    firsts = written(firsts.select("gram", "at.doc_id", "at.place"), "firsts")
    varied = firsts.groupBy("gram").agg(F.count("*").alias("spans"))
    firsts = firsts.join(varied, "gram").select("doc_id", "place", F.when(F.col("spans") > 1, 2).otherwise(1).alias("kind"))
    spans = (
        seeds.select("doc_id", "place", F.lit(0).alias("kind"))
        .union(firsts)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("kind", "place")).alias("found"))
        .select(F.col("doc_id").alias("of"), F.col("found.kind").alias("kind"), F.col("found.place").alias("place"))
    )
    open_ = docs.join(spans.where(F.array_contains("kind", 2)).hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")))
    windows = open_.select("doc_id", "text", "kind", "place").mapInArrow(_open_windows, place)
    known = windows.groupBy("gram", "span").agg(F.min(F.struct("doc_id", "place")).alias("at"))
    known = known.groupBy(F.col("at.doc_id").alias("by")).agg(F.collect_list("at.place").alias("known"))
    told = docs.join(spans.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    told = told.join(known.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("by")), "left")
    return told.select("doc_id", "text", "kind", "place", "known").mapInArrow(
        _result, "doc_id long, n_words long, n_removed long, kept_text string, repeats array<struct<first_word: long, end_word: long>>"
    )


def digest(removed: DataFrame) -> DataFrame:
    """The columns of the contract, from :func:`remove_repeats`."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The contract, word by word; for tests."""
    seen: set[tuple[bytes, ...]] = set()
    out = []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((doc_id, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


ORACLE = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM docs WHERE len(words) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY array_to_string(words[s:s + 19], ' ') ORDER BY doc_id, s) AS k FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE k > 1),
told AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM docs),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM told ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
