"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, computed for an Arrow batch at once.  Trees are
grown level by level on quantile bins with logistic loss and flattened into arrays
(feature, threshold, children, value); scoring walks all rows and trees together, one
numpy step a level.

Fitting uses at most ``MAX_TRAIN`` labelled documents, those with the least hash of their
doc_id, of the rows with crc32(doc_id as text) mod 5 other than 0.  The bound is a
parameter and the only thing that stays fixed as the corpus grows; every document is
scored.  doc_id, source, lang and labels are never inputs of a score.

Defined cases: null text counts as empty and has zero statistics; a null label is no
label; repeated labels of a document count as the highest.  Without labels the score is
0.5, with labels of one kind their smoothed share.  A null doc_id is not held out.
Repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.shared import prepare

MAX_TRAIN = 20_000
THRESHOLD = 0.3
TREES, DEPTH, BINS, RATE, RIDGE, LEAST_ROWS = 80, 4, 64, 0.15, 1.0, 10

_CLASSES = ["upper", "lower", "digit", "space", "newline", "stop", "comma", "bar", "bang", "symbol", "high", "control"]
_CLASS = np.full(256, _CLASSES.index("symbol"))
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "control": range(32),
    "space": b" \t\r", "newline": b"\n", "stop": b".?:;", "comma": b",'\"()-", "bar": b"|", "bang": b"!",
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)

STATISTICS = [
    *(f"share_{c}" for c in _CLASSES), "log_words", "word_bytes", "word_bytes_sd", "distinct_words", "top_word", "echoed_words", "longest_echo",
    "distinct_pairs", "capital_words", "shout_words", "log_lines", "words_a_line", "distinct_lines", "closed_lines",
]


def _per_row(rows: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=size).astype(float)


def _distinct(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, and how often its most frequent one occurs."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if keys.size else np.zeros(0, int)
    owner = (keys[heads] >> np.uint64(44)).astype(int)
    most = np.zeros(size)
    np.maximum.at(most, owner, np.diff(np.r_[heads, keys.size]))
    return _per_row(owner, size), most


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a chunk."""
    n = offsets.size - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n), sizes)
    kind = _CLASS[data]
    counts = np.bincount(row * len(_CLASSES) + kind, minlength=n * len(_CLASSES)).reshape(n, -1).astype(float)
    starts, ends, first = tk.split_words(data, offsets)
    hashes = tk.hash_words(data, starts, ends)
    words = np.diff(first).astype(float)
    of = np.repeat(np.arange(n), np.diff(first))
    some = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = _per_row(of, n, length) / some
    sd = np.sqrt(np.maximum(0, _per_row(of, n, length**2) / some - mean**2))
    kinds, top = _distinct(of, hashes, n)
    same = np.zeros(starts.size, bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    since = np.arange(starts.size) - np.maximum.accumulate(np.where(same, 0, np.arange(starts.size)))
    longest = np.zeros(n)
    np.maximum.at(longest, of, since)
    pair = np.flatnonzero(of[1:] == of[:-1]) if starts.size > 1 else np.zeros(0, int)
    pairs, _ = _distinct(of[pair], tk.mix(hashes[pair] * np.uint64(3) + hashes[pair + 1]), n)
    lead, second = kind[starts], kind[np.minimum(starts + 1, max(data.size - 1, 0))] if data.size else kind
    capital = (lead == 0).astype(float)
    shout = ((lead == 0) & (second == 0) & (length > 1)).astype(float)
    is_break = np.zeros(256, bool)
    is_break[10] = True
    at, to, line_first = tk.split_words(data, offsets, is_break)
    lines = np.diff(line_first).astype(float)
    line_of = np.repeat(np.arange(n), np.diff(line_first))
    line_kinds, _ = _distinct(line_of, tk.hash_words(data, at, to), n)
    closed = np.isin(data[to - 1], np.frombuffer(b".?!", np.uint8)).astype(float)
    some_lines = np.maximum(lines, 1)
    shares = counts / np.maximum(sizes, 1)[:, None]
    rest = [
        np.log1p(words), mean, sd, kinds / some, top / some, _per_row(of, n, same.astype(float)) / some, longest,
        pairs / np.maximum(words - 1, 1), _per_row(of, n, capital) / some, _per_row(of, n, shout) / some,
        np.log1p(lines), words / some_lines, line_kinds / some_lines, _per_row(line_of, n, closed) / some_lines,
    ]
    return np.column_stack([shares, *rest])


@dataclass
class Trees:
    """All trees in flat arrays; node 0 of a tree is at ``roots``.  Leaves point to themselves."""

    prior: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        if self.roots.size and len(x):
            node = np.broadcast_to(self.roots, (len(x), self.roots.size))
            rows = np.arange(len(x))[:, None]
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            margin = margin + self.value[node].sum(1)
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees from statistics and 0/1 labels; the same for the same rows in the same order."""
    share = (y.sum() + 1) / (y.size + 2)
    prior = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if 0 < y.sum() < y.size:
        features = x.shape[1]
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
        bins = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        flat = bins + np.arange(features) * BINS
        margin = np.full(y.size, prior)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, p * (1 - p)
            base = len(feature)
            roots.append(base)
            for column, start in ((feature, 0), (threshold, np.inf), (value, 0.0)):
                column.append(start)
            left.append(base)
            right.append(base)
            node = np.full(y.size, base)
            level = [base]
            for _depth in range(DEPTH):
                slot = np.full(len(feature), -1)
                slot[level] = np.arange(len(level))
                active = np.flatnonzero(slot[node] >= 0)
                where = (slot[node[active]][:, None] * (features * BINS) + flat[active]).ravel()
                shape, size = (len(level), features, BINS), len(level) * features * BINS
                g, h, c = (np.bincount(where, np.repeat(w[active], features), size).reshape(shape).cumsum(2) for w in (grad, hess, np.ones(y.size)))
                g_all, h_all, c_all = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
                gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(c < LEAST_ROWS) | (c_all - c < LEAST_ROWS)] = -1
                best = gain.reshape(len(level), -1).argmax(1)
                following = []
                for k, parent in enumerate(level):
                    f, b = divmod(int(best[k]), BINS)
                    if gain[k, f, b] <= 1e-9 or b >= len(edges[f]):
                        continue
                    feature[parent], threshold[parent] = f, float(edges[f][b])
                    left[parent], right[parent] = len(feature), len(feature) + 1
                    for child in (len(feature), len(feature) + 1):
                        feature.append(0)
                        threshold.append(np.inf)
                        value.append(0.0)
                        left.append(child)
                        right.append(child)
                        following.append(child)
                    mine = np.flatnonzero(node == parent)
                    node[mine] = np.where(bins[mine, f] <= b, left[parent], right[parent])
                level = following
                if not level:
                    break
            g = np.bincount(node, grad, len(feature))
            h = np.bincount(node, hess, len(feature))
            for leaf in np.unique(node):
                value[leaf] = float(-RATE * g[leaf] / (h[leaf] + RIDGE))
            margin = margin + np.array(value)[node]
    ints = lambda v: np.array(v, np.int64)
    return Trees(prior, ints(roots), ints(feature), np.array(threshold, float), ints(left), ints(right), np.array(value, float))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tk.text_chunks(batches):
        found = statistics(data, offsets)
        yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(list(found), pa.list_(pa.float64()))], names=["doc_id", "label", "statistics"])


def fit(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees from at most ``max_train`` labelled documents that are not held out."""
    prepare(documents.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg((F.max("quality") > 0).cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").select("doc_id", "label", "text")
    rows = texts.mapInArrow(_measured, "doc_id long, label int, statistics array<double>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "statistics")).alias("r")).select("doc_id", "r.label", "r.statistics")
    found = rows.orderBy("doc_id").toArrow()
    if not found.num_rows:
        return grow(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = np.array(found["statistics"].to_pylist(), float)
    return grow(x, found["label"].to_numpy().astype(float))


def score(documents: DataFrame, trees: Trees, out: str = "score") -> DataFrame:
    """``documents`` with their score as ``out``; a column of that name in the input is replaced."""
    prepare(documents.sparkSession)
    docs = documents.drop(out)
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in tk.text_chunks(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(trees.score(statistics(data, offsets)))], names=[*rows.schema.names, out])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def predicted(score_column: Column, threshold: float = THRESHOLD) -> Column:
    return (score_column >= threshold).cast("int")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of the contract for every document."""
    scored = score(documents.select(F.col("doc_id").cast("long"), "text"), fit(documents, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
