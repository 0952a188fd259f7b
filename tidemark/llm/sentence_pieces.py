"""SentencePiece encoding and decoding: a relational lattice and a Viterbi fold.

The piece table comes from a model file (its path is a parameter).  A text is a leading
space and its characters; spaces stand for the model's word mark.  It falls apart
at places that no piece spans into units, mostly words, so the best segmentation of a
text is that of its units.

Dictionary: units are counted over the whole corpus.  For the ``DICTIONARY`` most
frequent ones every substring of up to the longest piece's length is exploded and
equi-joined to the piece table; the edges are grouped by unit and folded by
``aggregate``: position by position, the best score so far plus the edge's score.  The
result, of bounded size, is broadcast to the encoding tasks.

Rest: a unit outside the dictionary gets the same fold over the same edges inside the
encoding task, so the corpus's rare words, which grow without bound, need neither a broadcast nor a
shuffle of their occurrences.

The score of a segmentation is the sum of its pieces' scores; the greatest wins, and on
a tie the one whose last piece is shortest (then the one before, and so on).  A
character without a piece is its UTF-8 bytes' pieces at a penalty below every score.
For a model of the BPE kind this differs from merging in order of rank.

Decoding concatenates the pieces' bytes and drops the leading space, so every text comes
back unchanged, the word mark's own character included (it becomes bytes).

Defined cases: null text has null ids, empty text has none.  Repeated rows repeat.
Control pieces decode to nothing; ids outside the table are an error.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textkit as tk
from tidemark.llm.shared import prepare, written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY = 1 << 18
#: Longest unit that the dictionary takes; longer ones are folded in the tasks.
LONGEST = 40
#: Distinct words whose ids a task remembers before it starts anew.
REMEMBERED = 300_000
PENALTY = 10.0
MARK = "▁"
#: Places where a text may fall apart; those that some piece spans are not used.
CUTS = [r"(?<=\n)", r"(?=\n)", r"(?<=\p{L})(?=[.,;:|!?])"]


@dataclass
class Pieces:
    """The pieces that text can match (with spaces for marks), and the bytes of every id."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    decoded: list[bytes]
    longest: int
    worst: float
    cut: str

    @classmethod
    def load(cls, path: str = MODEL) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids, scores, byte_ids, decoded = {}, {}, [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                decoded.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                decoded.append(b"")
            else:
                text = piece.replace(MARK, " ")
                ids[text], scores[text] = i, model.get_score(i)
                decoded.append(text.encode())
        if any(" " in p.lstrip(" ") for p in ids):
            raise ValueError("a piece spans two words")
        cuts = [c for c in CUTS if not any(0 < m.start() < len(p) for p in ids if len(p) > 1 for m in regex.finditer(c, p))]
        return cls(ids, scores, byte_ids, decoded, max(map(len, ids)), min(scores.values()), "|".join(cuts))

    def table(self, spark: SparkSession) -> DataFrame:
        rows = pa.table({"piece": list(self.ids), "id": pa.array(self.ids.values(), pa.int32()), "score": pa.array(self.scores.values(), pa.float64())})
        return spark.createDataFrame(rows)

    def __post_init__(self) -> None:
        """``steps``: score and id of each piece, and None for what only begins a piece."""
        self.steps: dict[str, tuple[float, int] | None] = {p[:n]: None for p in self.ids for n in range(1, len(p))}
        self.steps |= {p: (self.scores[p], i) for p, i in self.ids.items()}

    def fold(self, unit: str) -> list[int]:
        """Ids of the best segmentation of one unit, position by position."""
        size, steps, none = len(unit), self.steps, float("-inf")
        best, back, ids = [none] * (size + 1), [0] * (size + 1), [-1] * (size + 1)
        best[0] = 0.0
        for start in range(size):
            score = best[start]
            if steps.get(unit[start]) is None and score + self.worst - PENALTY >= best[start + 1]:
                best[start + 1], back[start + 1], ids[start + 1] = score + self.worst - PENALTY, start, -1
            for end in range(start + 1, size + 1):
                piece = unit[start:end]
                if piece not in steps:
                    break
                step = steps[piece]
                if step is not None and score + step[0] >= best[end]:
                    best[end], back[end], ids[end] = score + step[0], start, step[1]
        parts, at = [], size
        while at:
            if ids[at] < 0:
                parts += [self.byte_ids[b] for b in reversed(unit[at - 1].encode())]
            else:
                parts.append(ids[at])
            at = back[at]
        return parts[::-1]


def units(documents: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, n``: how often each unit that starts a word or follows a cut occurs in the corpus."""
    words = documents.where(F.col("text").isNotNull()).select(F.explode(F.split("text", " ", -1)).alias("word")).where("word <> ''")
    words = words.groupBy("word").agg(F.count("*").alias("n"))
    parts = F.split(F.concat(F.lit(" "), "word"), pieces.cut, -1) if pieces.cut else F.array(F.concat(F.lit(" "), "word"))
    return words.select(F.explode(parts).alias("unit"), "n").where("unit <> ''").groupBy("unit").agg(F.sum("n").alias("n"))


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``unit, edges``: all pieces that match inside each unit, by end and start."""
    size = F.length("unit")
    starts = words.select("unit", F.explode(F.sequence(F.lit(1), size)).alias("start"))
    subs = starts.select("unit", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), size - F.col("start") + 1))).alias("len"))
    subs = subs.select("unit", "start", "len", F.substring("unit", F.col("start"), F.col("len")).alias("piece"))
    found = subs.join(F.broadcast(pieces.table(words.sparkSession)), "piece", "left").where(F.col("id").isNotNull() | (F.col("len") == 1))
    hexes = F.hex(F.encode("piece", "UTF-8"))
    byte_ids = F.array(*[F.lit(i) for i in pieces.byte_ids])
    as_bytes = F.transform(
        F.sequence(F.lit(1), F.length(hexes) - 1, F.lit(2)), lambda i: F.element_at(byte_ids, F.conv(F.substring(hexes, i, F.lit(2)), 16, 10).cast("int") + 1)
    )
    edge = F.struct(
        (F.col("start") + F.col("len") - 1).alias("end"),
        F.col("start"),
        F.coalesce("score", F.lit(pieces.worst - PENALTY)).alias("score"),
        F.when(F.col("id").isNotNull(), F.array("id")).otherwise(as_bytes).alias("ids"),
    )
    return found.groupBy("unit").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def fold(edges: DataFrame) -> DataFrame:
    """``unit, ids``: Viterbi over the sorted edges.

    The state has for every end reached so far the best score and its ids; edges come in order of
    end and start, so an edge either opens a new end or competes for the last one.
    """
    origin = F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids")))

    def step(best: Column, e: Column) -> Column:
        before = F.element_at(best, e["start"])
        here = F.struct((before["score"] + e["score"]).alias("score"), F.concat(before["ids"], e["ids"]).alias("ids"))
        new = F.size(best) == e["end"]
        better = here["score"] >= F.element_at(best, -1)["score"]
        return F.when(new, F.concat(best, F.array(here))).when(better, F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(here))).otherwise(best)

    return edges.select("unit", F.aggregate("edges", origin, step, lambda s: F.element_at(s, -1)["ids"]).alias("ids"))


def dictionary(documents: DataFrame, pieces: Pieces, size: int = DICTIONARY) -> DataFrame:
    """``unit, ids`` of the most frequent units, at most ``size``.

    How frequent is read off a histogram of the counts, whose size does not depend on the
    corpus; so no task ranks the units of others.
    """
    found = written(units(documents, pieces).where(F.length("unit") <= LONGEST), "units")
    level = F.floor(F.log2("n") * 16).cast("int")
    least, room = None, size
    for row in found.groupBy(level.alias("level")).agg(F.count("*").alias("units")).orderBy(F.desc("level")).collect():
        room -= row.units
        if room < 0:
            break
        least = row.level
    frequent = found.where(level >= least) if least is not None else found.where("false")
    return fold(lattice(frequent.select("unit").repartition("unit"), pieces))


def _encoder(shared):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = shared.value
        cut = regex.compile(pieces.cut) if pieces.cut else None
        memory: dict[str, bytes] = {}

        def of_unit(unit: str) -> bytes:
            found = known.get(unit)
            return found if found is not None else array("i", pieces.fold(unit)).tobytes()

        def of_word(word: str) -> bytes:
            # Letters alone hold no place to cut, nor does a word before its one last mark.
            if not cut or word[1:].isalpha():
                ids = of_unit(word)
            elif word[1:-1].isalpha() and cut.search(word, len(word) - 1):
                ids = of_unit(word[:-1]) + of_unit(word[-1:])
            else:
                ids = b"".join(map(of_unit, filter(None, cut.split(word))))
            if len(memory) >= REMEMBERED:
                memory.clear()
            memory[word] = ids
            return ids

        for rows, _, _ in tk.text_chunks(batches):
            out = []
            for text in rows.column(rows.num_columns - 1).to_pylist():
                if text is None:
                    out.append(None)
                    continue
                if "  " in text or text[-1:] == " " or text[:1] == " ":
                    words = regex.findall(r" +[^ ]*", " " + text)
                else:
                    words = [" " + w for w in text.split(" ")] if text else []
                out.append(b"".join([memory.get(w) or of_word(w) for w in words]))
            sizes = np.array([len(x or b"") // 4 for x in out], np.int64)
            offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32), mask=np.r_[[x is None for x in out], False])
            flat = pa.array(np.frombuffer(b"".join(x for x in out if x), np.int32))
            ids = pa.ListArray.from_arrays(offsets, flat)
            yield pa.RecordBatch.from_arrays([*rows.columns, ids], names=[*rows.schema.names, "ids"])

    return encode


def encode(documents: DataFrame, pieces: Pieces | None = None, size: int = DICTIONARY) -> DataFrame:
    """``documents`` with ``ids array<int>``; a column of that name in the input is replaced."""
    spark = documents.sparkSession
    prepare(spark)
    pieces = pieces or Pieces.load()
    found = dictionary(documents.select("text"), pieces, size).toArrow()
    known = {u: np.array(i, np.int32).tobytes() for u, i in zip(found["unit"].to_pylist(), found["ids"].to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast((pieces, known))
    docs = documents.drop("ids")
    docs = docs.select(*[c for c in docs.columns if c != "text"], "text")
    return docs.mapInArrow(_encoder(shared), T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """``encoded`` with ``decoded string`` from ``ids``; a column of that name in the input is replaced."""
    spark = encoded.sparkSession
    pieces = pieces or Pieces.load()
    shared = spark.sparkContext.broadcast(pieces.decoded)
    rows = encoded.drop("decoded")
    rows = rows.select(*[c for c in rows.columns if c != "ids"], "ids")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = pa.array(shared.value, pa.binary())
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, parts.take(ids.values)), b"")
            text = pc.binary_replace_slice(joined, 0, 1, b"").cast(pa.string())
            text = pc.if_else(ids.is_valid(), text, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(decoded, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))


def digest(documents: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """Per document: ``doc_id, n_pieces, ids_sha256, decoded_sha256, lossless``."""
    pieces = pieces or Pieces.load()
    rows = decode(encode(documents.select("doc_id", "text"), pieces), pieces)
    ids = F.array_join("ids", " ")
    return rows.select(
        "doc_id",
        F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("lossless"),
    )


def brute_force(text: str | None, pieces: Pieces) -> tuple[float, list[int]] | None:
    """Best score and ids over every segmentation of a short text; for tests."""
    if not text:
        return None if text is None else (0.0, [])

    def every(rest: str) -> Iterator[tuple[float, list[int]]]:
        if not rest:
            yield 0.0, []
        for n in range(1, len(rest) + 1):
            head = rest[:n]
            if head in pieces.ids:
                options = (pieces.scores[head], [pieces.ids[head]])
            elif n == 1:
                options = (pieces.worst - PENALTY, [pieces.byte_ids[b] for b in head.encode()])
            else:
                continue
            for score, ids in every(rest[n:]):
                yield options[0] + score, options[1] + ids

    return max(every(" " + text), key=lambda x: x[0])


def digest_bytes(ids: list[int] | None) -> str | None:
    """The ``ids_sha256`` of a list of ids; for tests."""
    return None if ids is None else hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
