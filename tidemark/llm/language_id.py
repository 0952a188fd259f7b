"""Language identification by unigram pieces, summed over all segmentations.

A text is lower-cased and falls apart into units: maximal runs of letters a-z and of bytes
beyond ASCII, each with a leading space (runs of over ``LONGEST_UNIT`` bytes are several units,
cut between characters).  Pieces come from a fixed public vocabulary whose path is a
parameter: all that can occur in a unit, and one piece for every single byte, so every
unit has a segmentation.  Each language has a probability for each piece.  The likelihood
of a unit is the sum, over all its segmentations into pieces, of the product of their
probabilities; the forward algorithm adds it up from left to right, for all units of a batch
and all languages at once.  A text's likelihood is the product over its units; with the
languages' shares as prior this gives the posterior that is the score.

Learning: units are counted by language over all labelled documents with crc32(doc_id as
text) mod 3 other than 1 and written once.  From equal probabilities on, each of ``ROUNDS`` passes
over that table sums expected piece counts by the forward-backward algorithm; a round gives
back one number a piece and language, and probabilities are shares smoothed towards those of
all languages together.  Counts grow with the corpus; the model does not, as long as the number of
languages stays.  Over ``MOST_LANGUAGES`` of them are an error, never cut.

Scores depend on the text alone.  Defined cases: null texts, and those without a letter, are
``und`` with score 0; so is everything if nothing can be learned.  Ties go to the
first language in order of names.  A null doc_id is not held out.  Repeated rows repeat (and
count as often in learning).  Other columns stay; those of the names added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.shared import prepare, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
ROUNDS, SMOOTHING = 3, 100.0
LONGEST_UNIT, MOST_LANGUAGES = 96, 512
#: Bytes of text, and of distinct units, that one numpy step takes.
TEXT_STEP, LATTICE_STEP = 1 << 22, 1 << 19
_FILTER_BITS = 21

U64 = np.uint64
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(97, 123), *range(128, 256)]] = False


@dataclass
class Vocabulary:
    """Pieces by their hash; ids below 256 are the single bytes."""

    hashes: np.ndarray
    ids: np.ndarray
    lengths: list[int]
    size: int
    maybe: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i).replace("▁", " ") for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        return cls.of(texts)

    @classmethod
    def of(cls, texts: list[str]) -> Vocabulary:
        """From the pieces' texts, of which those that no unit can hold are left out."""
        raw = sorted({t.encode() for t in texts if t})
        raw = [p for p in raw if not _BREAKS[list(p.removeprefix(b" "))].any()]
        ends = np.cumsum([len(p) for p in raw], dtype=np.int64)
        hashes = tk.hash_words(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, ends[:-1]].astype(np.int64)[: ends.size], ends)
        order = np.argsort(hashes)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[hashes & U64((1 << _FILTER_BITS) - 1)] = True
        return cls(hashes[order], order + 256, sorted({len(p) for p in raw}), len(raw) + 256, maybe)


class Lattice:
    """Every piece that matches somewhere in a block of units, as edges between byte positions.

    ``data`` holds the units one after the other, ``offsets`` their bounds.  A unit of n
    bytes has n + 1 nodes.
    """

    def __init__(self, vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray):
        self.units = offsets.size - 1
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(self.units), sizes)
        left = offsets[of + 1] - np.arange(data.size)
        up, down = tk.BYTES.get(data.size + 1)
        sums = np.zeros(data.size + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * up[: data.size], out=sums[1:])
        starts, lengths, pieces = [np.arange(data.size)], [np.ones(data.size, np.int64)], [data.astype(np.int64)]
        at = np.arange(data.size)
        for n in vocabulary.lengths:
            at = at[left[at] >= n]
            found = tk.mix((sums[at + n] - sums[at]) * down[at])
            some = np.flatnonzero(vocabulary.maybe[found & U64(vocabulary.maybe.size - 1)])
            place = np.minimum(np.searchsorted(vocabulary.hashes, found[some]), max(vocabulary.hashes.size - 1, 0))
            hit = vocabulary.hashes[place] == found[some]
            starts.append(at[some[hit]])
            lengths.append(np.full(int(hit.sum()), n))
            pieces.append(vocabulary.ids[place[hit]])
        start, length, self.piece = np.concatenate(starts), np.concatenate(lengths), np.concatenate(pieces)
        self.unit = of[start]
        self.start, self.end = start + self.unit, start + self.unit + length
        self.first = offsets[:-1] + np.arange(self.units)
        self.last = offsets[1:] + np.arange(self.units)
        self.nodes = int(offsets[-1]) + self.units

    def _sweep(self, into: np.ndarray, outof: np.ndarray, steps: np.ndarray, origin: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Log sums of paths from ``origin`` to each node; ``edges`` are the log probabilities."""
        total = np.full((self.nodes, *edges.shape[1:]), -np.inf)
        total[origin] = 0
        order = np.lexsort((into, steps))
        into, outof, steps, edges = into[order], outof[order], steps[order], edges[order]
        cuts = np.flatnonzero(np.r_[True, steps[1:] != steps[:-1], True]) if steps.size else np.zeros(1, int)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            target = into[lo:hi]
            heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
            total[target[heads]] = np.logaddexp.reduceat(total[outof[lo:hi]] + edges[lo:hi], heads, axis=0)
        return total

    def forward(self, edges: np.ndarray) -> np.ndarray:
        return self._sweep(self.end, self.start, self.end - self.first[self.unit], self.first, edges)

    def backward(self, edges: np.ndarray) -> np.ndarray:
        return self._sweep(self.start, self.end, self.last[self.unit] - self.start, self.last, edges)

    def likelihoods(self, logs: np.ndarray) -> np.ndarray:
        """Log likelihood of each unit in each language, from log probabilities by piece and language."""
        return self.forward(logs[self.piece])[self.last]

    def expected(self, logs: np.ndarray, language: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language; ``language`` and ``times`` are those of the units."""
        own = language[self.unit]
        edges = logs[self.piece, own]
        ahead, back = self.forward(edges), self.backward(edges)
        share = np.exp(ahead[self.start] + edges + back[self.end] - ahead[self.last][self.unit])
        return np.bincount(self.piece * logs.shape[1] + own, share * times[self.unit], logs.size).reshape(logs.shape)


def lattices(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Lattice]]:
    for lo, hi in tk.row_groups(offsets, LATTICE_STEP):
        yield lo, hi, Lattice(vocabulary, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def gathered(batches: Iterator[pa.RecordBatch], column: str, step: int = TEXT_STEP) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``step`` bytes of one column."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(column)).nbytes
        if size >= step:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def cut_units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes, starts and ends of their units, and the row of each unit."""
    data, offsets = tk.text_buffer(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, ends, first = tk.split_words(data, offsets, _BREAKS)
    row = np.repeat(np.arange(offsets.size - 1), np.diff(first))
    parts = (ends - starts + LONGEST_UNIT - 1) // LONGEST_UNIT
    if (parts > 1).any():
        of = np.repeat(np.arange(starts.size), parts)
        inside = np.arange(of.size) - np.repeat(np.cumsum(parts) - parts, parts)
        cut = starts[of] + LONGEST_UNIT * inside
        for _ in range(3):
            cut = np.where((inside > 0) & (data[cut] & 0xC0 == 0x80), cut - 1, cut)
        stop = np.r_[cut[1:], 0]
        stop = np.where(inside + 1 == parts[of], ends[of], stop)
        starts, ends, row = cut, stop, row[of]
    return data, starts, ends, row


def marked(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units one after the other, each with a leading space, and their offsets."""
    sizes = ends - starts
    offsets = np.r_[0, np.cumsum(sizes + 1)]
    out = np.full(offsets[-1], 32, np.uint8)
    inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(offsets[:-1] + 1, sizes) + inside] = data[np.repeat(starts, sizes) + inside]
    return out, offsets


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text"):
        lang = batch.column(0).dictionary_encode()
        data, starts, ends, row = cut_units(batch.column(1))
        code = lang.indices.to_numpy()[row]
        hashes = tk.hash_words(data, starts, ends)
        order = np.lexsort((hashes, code))
        h, c = hashes[order], code[order]
        heads = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]) if h.size else np.zeros(0, int)
        own = order[heads]
        raw, offsets = marked(data, starts[own], ends[own])
        units = pa.Array.from_buffers(pa.large_binary(), own.size, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(c[heads])), units, pa.array(np.diff(np.r_[heads, h.size]))], names=["lang", "unit", "n"])


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    logs: np.ndarray
    vocabulary: Vocabulary


def _shares(counts: np.ndarray) -> np.ndarray:
    """Log probabilities by piece and language, smoothed towards all languages together."""
    pooled = (counts.sum(1) + 1) / (counts.sum() + len(counts))
    return np.log((counts + SMOOTHING * pooled[:, None]) / (counts.sum(0) + SMOOTHING))


def learn(documents: DataFrame, vocabulary: Vocabulary | None = None, rounds: int = ROUNDS) -> Model:
    """A model from all rows with a ``lang`` that are not held out."""
    spark = documents.sparkSession
    prepare(spark)
    vocabulary = vocabulary or Vocabulary.load()
    known = documents.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("lang").cast("string").alias("lang"), "text")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: their probabilities would not fit a task")
    languages = [r.lang for r in sizes]
    number = np.array([r.n for r in sizes], float)
    prior = np.log((number + 1) / (number.sum() + max(len(sizes), 1)))
    logs = np.full((vocabulary.size, len(languages)), -math.log(vocabulary.size))
    if not languages:
        return Model(languages, prior, logs, vocabulary)
    words = known.mapInArrow(_count_units, "lang string, unit binary, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    words = written(words, "units")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((vocabulary, logs, {c: i for i, c in enumerate(languages)}))

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces, now, place = shared.value
            counts = np.zeros(now.shape)
            for batch in gathered(batches, "unit", LATTICE_STEP):
                language = np.array([place[c] for c in batch.column(0).to_pylist()], np.int64)
                data, offsets = tk.text_buffer(batch.column(1))
                times = batch.column(2).to_numpy().astype(float)
                for lo, hi, lattice in lattices(pieces, data, offsets):
                    counts += lattice.expected(now, language[lo:hi], times[lo:hi])
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts.ravel()[some])], names=["at", "n"])

        found = words.mapInArrow(expected, "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(logs.size)
        counts[found["at"].to_numpy()] = found["n"].to_numpy()
        logs = _shares(counts.reshape(logs.shape))
    return Model(languages, prior, logs, vocabulary)


def posteriors(model: Model, texts: pa.Array) -> np.ndarray:
    """Probability of each language for each text."""
    data, starts, ends, row = cut_units(texts)
    _, own, back = np.unique(tk.hash_words(data, starts, ends), return_index=True, return_inverse=True)
    units, offsets = marked(data, starts[own], ends[own])
    logs = np.zeros((own.size, len(model.languages)))
    for lo, hi, lattice in lattices(model.vocabulary, units, offsets):
        logs[lo:hi] = lattice.likelihoods(model.logs)
    total = np.column_stack([np.bincount(row, logs[back, k], len(texts)) for k in range(len(model.languages))]) + model.prior
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


def identify(documents: DataFrame, model: Model, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """``documents`` with the likeliest language as ``lang`` and its probability as ``score``."""
    spark = documents.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = documents.drop(lang, score)
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")

    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        names = pa.array([*known.languages, UNDETERMINED])
        for rows in gathered(batches, "text"):
            texts = rows.column(rows.num_columns - 1)
            some = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, share = np.full(rows.num_rows, len(known.languages)), np.zeros(rows.num_rows)
            if known.languages and some.any():
                p = posteriors(known, texts)
                best, share = np.where(some, p.argmax(1), best), np.where(some, p.max(1), share)
            yield pa.RecordBatch.from_arrays([*rows.columns, names.take(pa.array(best)), pa.array(share)], names=[*rows.schema.names, lang, score])

    return docs.mapInArrow(identified, T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def digest(documents: DataFrame) -> DataFrame:
    """The columns of the contract for every document."""
    found = identify(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), learn(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def segmentations(unit: bytes, pieces: dict[bytes, list[int]]) -> Iterator[list[int]]:
    """Every segmentation of a unit into pieces, as ids; for tests."""
    if not unit:
        yield []
    for n in range(1, len(unit) + 1):
        for piece in pieces.get(unit[:n], []) + ([unit[0]] if n == 1 else []):
            for rest in segmentations(unit[n:], pieces):
                yield [piece, *rest]
