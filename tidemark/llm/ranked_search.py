"""Ranked lexical search: postings bucketed by term, integer scores, the best documents of each item.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased.  With N documents that hold a term, L terms in all, df documents that hold a
term and tf occurrences in a document of n terms:

* w = floor(1000 ln((2 N + 2) / (2 df + 1))), m = 25 + ((75 n N) div L)
* score = sum over an item's terms, repeats included, of w * ((1000000000 tf) div (1000 tf + 8 m))

One pass over the texts gives the postings of the items' terms (a bitmap of fixed size
skips most others, the join with the items the rest).  They are stored as a table
bucketed by ``term, part``: a term of more than ``HOT_ROWS`` rows, and of more than its share of
four tasks' worth of rows, is split into parts by document, so no bucket grows with one
frequent term.  Joins of item terms with this table need no shuffle of the postings.

An item of common words would score most of the corpus.  Exact bounds avoid that:

1. the rarest terms of an item, as far as ``LEAD_ROWS`` postings, name ``SEEDS`` documents; their
   full scores give a floor, which the k-th best document reaches at least;
2. an item's terms whose greatest possible scores together stay below ``IDLE_SHARE`` of the floor
   cannot lift a document over it alone; documents are sought by the other terms only;
3. of these, documents that could still reach the floor get the rest of their score.

With fewer than k documents at hand the floor is 0 and every term seeks.  So
nothing is cut: results equal those of scoring all pairs.

Defined cases: null and empty texts hold no terms; a null doc_id ranks after others of
equal score; repeated rows are documents of their own.  Items that share an item_id (null
included) are one item with all their terms.  Items without a hit give no rows.  Empty
tables give an empty result.  Terms are equal if their 64-bit hashes are.  Other columns
of either table are not read.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.shared import Bitmap, prepare, shared_dir, slots, written

TOP = 10
#: Postings of an item's rarest terms that name its first documents, and how many of these.
LEAD_ROWS, SEEDS = 2000, 40
#: Share of the floor that the terms which do not seek may reach together.
IDLE_SHARE = 0.6
#: A term with fewer rows is never split into parts.
HOT_ROWS = 10_000


def _hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tk.LOWER[data]
    starts, ends, first = tk.split_words(low, offsets, tk.ASCII_MARKS)
    return tk.hash_words(low, starts, ends), first


def _counted(row: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, term) and how often each occurs; ``row`` ascends."""
    order = np.lexsort((terms, row))
    row, terms = row[order], terms[order]
    new = np.ones(row.size, bool)
    new[1:] = (row[1:] != row[:-1]) | (terms[1:] != terms[:-1])
    heads = np.flatnonzero(new)
    return row[heads], terms[heads], np.diff(np.r_[heads, row.size])


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in tk.text_chunks(batches):
        hashes, first = _hashed(data, offsets)
        row, terms, n = _counted(np.repeat(np.arange(rows.num_rows), np.diff(first)), hashes)
        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), pa.array(tk.signed(terms)), pa.array(n)], names=["item_id", "term", "times"])


def _postings(bitmap):
    names = ["term", "row", "doc_id", "tf", "n"]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = bitmap.value.mask()
        docs = words = 0
        for rows, data, offsets in tk.text_chunks(batches):
            hashes, first = _hashed(data, offsets)
            size = np.diff(first)
            docs, words = docs + int((size > 0).sum()), words + hashes.size
            at = np.flatnonzero(here[slots(hashes, here.size)])
            row, terms, tf = _counted(np.searchsorted(first, at, "right") - 1, hashes[at])
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(tk.signed(terms)), rows.column(0).take(of), rows.column(1).take(of), pa.array(tf), pa.array(size[row])], names=names)
        # What the task saw in all: a row without a term.
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.array([docs], pa.int64()), pa.array([words], pa.int64())], names=names)

    return found


def bucketed(postings: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """``postings`` as a table in the shared folder, bucketed by term and part, and its name."""
    spark = postings.sparkSession
    name = f"tidemark_postings_{uuid.uuid4().hex}"
    rows = postings.repartition(buckets, "term", "part").sortWithinPartitions("term", "part")
    rows.write.bucketBy(buckets, "term", "part").sortBy("term", "part").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name), name


def search(documents: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item."""
    spark = documents.sparkSession
    prepare(spark)
    wanted = items.select("item_id", "text").mapInArrow(_item_terms, f"item_id {items.schema['item_id'].dataType.simpleString()}, term long, times long")
    # A null id is an item as well; joins below go by numbers of items.
    key = F.coalesce(F.concat(F.lit("i"), F.col("item_id").cast("string")), F.lit("none"))
    wanted = written(wanted.groupBy(key.alias("key"), "term").agg(F.sum("times").alias("times"), F.first("item_id").alias("id")), "terms")
    names = written(wanted.groupBy("key").agg(F.first("id").alias("id")).withColumn("item", F.monotonically_increasing_id()), "items")
    wanted = wanted.drop("id").join(names.select("key", "item"), "key").select("item", "term", "times")
    tokens = wanted.select(F.col("term").alias("token")).distinct()
    bitmap = spark.sparkContext.broadcast(Bitmap(tokens, tokens.count()))
    texts = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    raw = written(texts.mapInArrow(_postings(bitmap), "term long, row long, doc_id long, tf long, n long"), "postings")
    n_docs, n_terms, n_rows = raw.agg(F.sum(F.when(F.col("term").isNull(), F.col("tf"))), F.sum(F.when(F.col("term").isNull(), F.col("n"))), F.count("term")).first()

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    m = F.expr(f"25 + ((75L * n * {n_docs or 0}L) div {n_terms or 1}L)")
    gain = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    raw = raw.where("term IS NOT NULL").withColumn("m", m).withColumn("gain", gain)
    share = max(HOT_ROWS, n_rows // (4 * buckets))
    stats = raw.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    weight = F.floor(1000 * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1))) if n_docs else F.lit(0).cast("long")
    terms = wanted.join(stats, "term").withColumn("w", weight * F.col("times")).where("w > 0")
    terms = written(terms.select("item", "term", "w", "df", (F.col("w") * F.col("most")).alias("bound"), (F.floor(F.col("df") / share) + 1).cast("int").alias("parts")), "weights")
    # At most four times as many terms as buckets are split, so they may be broadcast.
    split = terms.where("parts > 1").select("term", "parts").distinct()
    placed = raw.join(F.broadcast(split), "term", "left").select("term", F.coalesce(F.pmod("row", "parts"), F.lit(0)).cast("int").alias("part"), "row", "doc_id", "gain")
    postings, table = bucketed(placed, buckets)

    def matches(chosen: DataFrame) -> DataFrame:
        """Scores of all documents by some of the items' terms: ``item, row, doc_id, score``."""
        spread = chosen.select("item", "term", "w", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        found = spread.join(postings, ["term", "part"]).groupBy("item", "row")
        return found.agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("w") * F.col("gain")).alias("score"))

    def of_pairs(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
        """Scores of given documents by some of the items' terms: ``item, row, score``; no row without a match."""
        near = pairs.select("item", "row").join(chosen.select("item", "term", "w", "parts"), "item")
        near = near.select("item", "row", "term", "w", F.pmod("row", "parts").cast("int").alias("part"))
        few = postings.select("term", "part", "row", "gain").join(pairs.select("row").distinct(), "row", "left_semi")
        return near.join(few, ["term", "part", "row"]).groupBy("item", "row").agg(F.sum(F.col("w") * F.col("gain")).alias("score"))

    def top(df: DataFrame, n: int) -> DataFrame:
        w = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

    by_rarity = W.partitionBy("item").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    lead = terms.withColumn("before", F.coalesce(F.sum("df").over(by_rarity), F.lit(0))).where(F.col("before") < LEAD_ROWS)
    seeds = written(top(matches(lead), max(SEEDS, k)).select("item", "row", "doc_id"), "seeds")
    known = of_pairs(seeds, terms).withColumn("doc_id", F.lit(0))
    floors = top(known, k).groupBy("item").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0).alias("floor"))
    by_bound = W.partitionBy("item").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranged = terms.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    ranged = ranged.withColumn("up_to", F.sum("bound").over(by_bound)).withColumn("idle", F.col("up_to") < IDLE_SHARE * F.col("floor"))
    ranged = written(ranged, "bounds")
    reach = ranged.groupBy("item").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("idle"), F.col("up_to"))), F.lit(0)).alias("rest"))
    sought = matches(ranged.where("NOT idle")).join(reach, "item").where(F.col("score") + F.col("rest") >= F.col("floor"))
    sought = written(sought.select("item", "row", "doc_id", "score"), "candidates")
    rest = of_pairs(sought, ranged.where("idle")).select("item", "row", F.col("score").alias("more"))
    scored = sought.join(rest, ["item", "row"], "left").withColumn("score", F.col("score") + F.coalesce("more", F.lit(0)))
    result = top(scored.where("score > 0"), k).join(names.select("item", "id"), "item")
    result = written(result.select(F.col("id").alias("item_id"), "rank", "doc_id", "score"), "ranking")
    spark.sql(f"DROP TABLE {table}")
    return result


def brute_force(documents: list[tuple[int, str | None]], items: list[tuple[object, str | None]], k: int = TOP) -> list[tuple]:
    """The contract over all pairs; for tests."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: Counter(w.translate(lower) for w in pattern.findall(t or ""))
    docs = [(i, c) for i, c in ((i, split(t)) for i, t in documents) if c]
    n_docs, n_terms = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    wanted: dict[object, Counter] = defaultdict(Counter)
    for i, t in items:
        wanted[i] += split(t)
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in docs:
            m = 25 + 75 * c.total() * n_docs // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, q in terms.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM benchmark),
wanted AS (SELECT item_id, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS times FROM i GROUP BY ALL),
sums AS (SELECT count(*) AS n_docs, sum(len(words))::BIGINT AS n_terms FROM d WHERE len(words) > 0),
postings AS (
  SELECT r, doc_id, n, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term, count(*) AS tf
  FROM (SELECT r, doc_id, len(words) AS n, unnest(words) AS word FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM postings, sums GROUP BY term, n_docs),
scores AS (
  SELECT item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM wanted JOIN postings USING (term) JOIN weights USING (term), sums GROUP BY item_id, r, doc_id),
placed AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""
