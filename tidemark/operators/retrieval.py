"""Lexical and vector retrieval, rank fusion, diversification and their metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions import vector as V
from tidemark.operators.graph import saved
from tidemark.operators.neighbours import kept
from tidemark.operators.temporal import first_per_key

K1, B = 1.2, 0.75


#: Queries whose matrix is broadcast at once; a larger set takes a pass for each so many.
BLOCK = 4096
#: Queries and vectors of a block that are scored at once, whatever the block and the batch hold.
STEP, WIDE = 512, 2048


def bm25_index(docs: DataFrame, doc_id: str, text: str, only: DataFrame | None = None) -> DataFrame:
    """``doc, term, tf, dl, df, idf, avg_dl``: one row per document and term.

    ``only`` names the terms that are asked for; others leave right after the texts are
    split, before anything is shuffled.
    """
    whole = docs.agg(F.count("*").alias("n"), F.avg(F.size(T.tokens(F.col(text)))).alias("avg_dl"))
    # The outer form keeps Spark from splitting texts once more to see which of them have terms.
    terms = docs.select(F.col(doc_id).alias("doc"), T.tokens(F.col(text)).alias("all"))
    terms = terms.select("doc", F.size("all").alias("dl"), F.explode_outer("all").alias("term")).where("term IS NOT NULL")
    if only is not None:
        terms = terms.join(only.select("term"), "term", "left_semi")
    tf = terms.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return tf.join(df, "term").join(F.broadcast(whole)).select("doc", "term", "tf", "dl", "df", idf.alias("idf"), "avg_dl")


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    return queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(T.tokens(F.col(text)))).alias("term"))


def bm25(queries: DataFrame, index: DataFrame, query_id: str, text: str, k: int) -> DataFrame:
    """Best ``k`` documents a query; query terms count once."""
    gain = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    return best_sums(query_terms(queries, query_id, text), index.select("term", "doc", gain.alias("gain")), k)


#: Postings of a query's rarest terms that name its first documents, how many of these, and the
#: share of the floor that the terms which do not seek may reach together.
LEAD, SEEDS, IDLE = 2000, 40, 0.6


def best_sums(terms: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``query, doc, score, rank``: the ``k`` documents with the greatest sum of positive gains over a query's terms.

    ``terms`` has query, term; ``postings`` term, doc, gain.  Exact, but common terms do not score the
    whole corpus: documents that hold a query's rarest terms set a floor that the k-th best
    reaches; terms whose greatest gains together stay under a share of it do not seek
    documents, and only documents that may still reach the floor get those terms' gains.
    """
    held = saved(postings)
    stats = held.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    t = saved(terms.distinct().join(stats, "term"))

    def top(df: DataFrame, n: int) -> DataFrame:
        return first_per_key(df.withColumn("_s", F.round("score", 9)), ["query"], [F.desc("_s"), F.col("doc")], rank="rank", most=n).drop("_s")

    def sums(chosen: DataFrame) -> DataFrame:
        return chosen.select("query", "term").join(held, "term").groupBy("query", "doc").agg(F.sum("gain").alias("score"))

    def of_pairs(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
        few = held.join(pairs.select("doc").distinct(), "doc", "left_semi")
        near = pairs.select("query", "doc").join(chosen.select("query", "term"), "query")
        return near.join(few, ["term", "doc"]).groupBy("query", "doc").agg(F.sum("gain").alias("score"))

    before = F.coalesce(F.sum("df").over(W.partitionBy("query").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    lead = t.withColumn("_before", before).where(F.col("_before") < LEAD)
    seeds = saved(top(sums(lead), max(SEEDS, k)).select("query", "doc"))
    floors = top(of_pairs(seeds, t), k).groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("floor"))
    up_to = F.sum("most").over(W.partitionBy("query").orderBy("most", "term").rowsBetween(W.unboundedPreceding, W.currentRow))
    t = t.join(floors, "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn("up_to", up_to)
    t = saved(t.withColumn("idle", F.col("up_to") < IDLE * F.col("floor")))
    reach = t.groupBy("query").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("idle"), F.col("up_to"))), F.lit(0.0)).alias("rest"))
    # The slack keeps what only rounding puts under the floor.
    sought = sums(t.where("NOT idle")).join(reach, "query").where(F.col("score") + F.col("rest") >= F.col("floor") - 1e-6).select("query", "doc", "score")
    sought = saved(sought)
    rest = of_pairs(sought, t.where("idle")).select("query", "doc", F.col("score").alias("more"))
    return top(sought.join(rest, ["query", "doc"], "left").select("query", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score")), k)


def _blocks(queries: DataFrame, query_id: str, query: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of about ``BLOCK`` queries at a time."""
    passes = max(1, -(-queries.count() // BLOCK))
    for b in range(passes):
        found = queries.where(F.pmod(F.xxhash64(query_id), F.lit(passes)) == b).select(query_id, query).toPandas()
        mat = np.array(found[query].tolist(), float).reshape(len(found), -1)
        yield found[query_id].to_numpy(), mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-300)


def _units(rows: pd.Series) -> np.ndarray:
    x = np.array(rows.tolist(), float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def nearest(batches: Iterator[tuple[np.ndarray, pd.Series]], qs: np.ndarray, m: np.ndarray, k: int, earlier: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``m``, ids and cosines of the best ``k`` of all batches of ids and vectors, ties to the smaller id.

    Only ``STEP`` queries by ``WIDE`` vectors are scored at once, and ``k`` hits a query are held between them.
    """
    held = [(np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)) for _ in range(0, len(qs), STEP)]
    floor = np.full(len(qs), -np.inf)
    for ids, vectors in batches:
        for first in range(0, len(ids), WIDE):
            here, x = ids[first : first + WIDE], _units(vectors.iloc[first : first + WIDE])
            for i, at in enumerate(range(0, len(qs), STEP)):
                part = slice(at, at + STEP)
                s = m[part] @ x.T
                s[np.isnan(s) | (here[None, :] >= qs[part, None]) if earlier else np.isnan(s)] = -np.inf
                top = min(k, len(here))
                # Scores that round alike stay in until the ids decide.
                edge = np.maximum(np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top], floor[part])
                r, c = np.nonzero((s >= edge[:, None] - 1e-9) & np.isfinite(s))
                if r.size:
                    held[i] = row, _, score = kept(*(np.concatenate(p) for p in zip(held[i], (r, here[c], s[r, c]), strict=True)), k)
                    full = np.bincount(row, minlength=len(floor[part])) >= k
                    low = np.full(len(full), np.inf)
                    np.minimum.at(low, row, score)
                    floor[part] = np.where(full, low, -np.inf)
    if not held:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate([h[0] + i * STEP for i, h in enumerate(held)]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])


def top_k(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query", query: str = "q", vec_id: str = "vec_id", vec: str = "embedding", floor: float | None = None, earlier: bool = False) -> DataFrame:
    """Exact cosine top-k: each block of queries is multiplied with the vectors, piece by piece.

    At most about ``BLOCK`` queries are broadcast at once, in as many passes as the set needs;
    each task keeps the best ``k`` of what it reads, and only those are shuffled for the final ranking.
    ``earlier`` takes only vectors whose id is smaller than the query's.
    """
    kinds = dict(queries.dtypes)[query_id], dict(vectors.dtypes)[vec_id]
    scored: DataFrame | None = None
    for block in _blocks(queries, query_id, query):
        shared = vectors.sparkSession.sparkContext.broadcast(block)

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qs, m = shared.value
            row, ids, score = nearest(((b[vec_id].to_numpy(), b[vec]) for b in batches), qs, m, k, earlier)
            yield pd.DataFrame({query_id: qs[row], vec_id: ids, "score": score})

        found = vectors.select(vec_id, vec).mapInPandas(best, f"`{query_id}` {kinds[0]}, `{vec_id}` {kinds[1]}, score double")
        scored = found if scored is None else scored.union(found)
    if floor is not None:
        scored = scored.where(F.col("score") >= floor)
    return first_per_key(scored, [query_id], [F.round("score", 9).desc(), F.col(vec_id)], rank="rank", most=k)


def best_chunks(queries: DataFrame, chunks: DataFrame, doc: str, query_id: str = "query", query: str = "q", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """For each query and document the cosine of its best chunk, and that chunk (on a tie the least id).

    Each task puts out one row a query, document and batch, not every score.
    """
    kinds = dict(queries.dtypes)[query_id], dict(chunks.dtypes)[doc], dict(chunks.dtypes)[vec_id]
    scored: DataFrame | None = None
    for block in _blocks(queries, query_id, query):
        shared = chunks.sparkSession.sparkContext.broadcast(block)

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            qs, m = shared.value
            for b in batches:
                if not len(b) or not len(qs):
                    continue
                b = b.sort_values([doc, vec_id]).reset_index(drop=True)
                ids, docs, x = b[vec_id].to_numpy(), b.groupby(doc, sort=False).indices, _units(b[vec])
                for first in range(0, len(qs), STEP):
                    asked = qs[first : first + STEP]
                    s = np.round(m[first : first + STEP] @ x.T, 12)
                    for name, at in docs.items():
                        top = s[:, at].argmax(1)
                        yield pd.DataFrame({query_id: asked, doc: name, vec_id: ids[at][top], "score": s[:, at][np.arange(len(asked)), top]})

        found = chunks.select(vec_id, doc, vec).mapInPandas(best, f"`{query_id}` {kinds[0]}, `{doc}` {kinds[1]}, `{vec_id}` {kinds[2]}, score double")
        scored = found if scored is None else scored.union(found)
    return max_pool(scored, query_id, doc, "score", vec_id)


def fuse(ranked: DataFrame, route: str, rank: str, keys: list[str], weights: dict[str, float] | None = None, c: float = 60.0) -> DataFrame:
    """Reciprocal-rank fusion; ranks start at 1, so the first adds ``1 / c``."""
    w: Column = F.lit(1.0)
    if weights:
        w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col(route)), F.lit(0.0))
    return ranked.groupBy(*keys).agg(F.sum(w / (c + F.col(rank) - 1)).alias("score"), F.count("*").alias("routes"))


def max_pool(chunks: DataFrame, query: str, doc: str, score: str, chunk: str) -> DataFrame:
    """Best chunk of each document."""
    return chunks.groupBy(query, doc).agg(F.max(score).alias(score), F.max_by(chunk, F.struct(F.col(score), -F.col(chunk))).alias(chunk))


def diversify(pool: DataFrame, query: str, item: str, score: str, vec: str, k: int, trade: float = 0.7) -> DataFrame:
    """Maximal marginal relevance over a query's bounded pool (its top-k list): greedy, one group a query."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, item], ascending=[False, True]).reset_index(drop=True)
        x = np.array(pdf[vec].tolist(), float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        sims, rel = x @ x.T, pdf[score].to_numpy()
        chosen: list[int] = []
        while len(chosen) < min(k, len(pdf)):
            near = sims[:, chosen].max(1) if chosen else np.zeros(len(pdf))
            value = np.round(trade * rel - (1 - trade) * near, 12)
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({query: pdf[query].iloc[chosen], item: pdf[item].iloc[chosen], "place": range(1, len(chosen) + 1)})

    kinds = dict(pool.dtypes)
    return pool.groupBy(query).applyInPandas(pick, f"`{query}` {kinds[query]}, `{item}` {kinds[item]}, place int")


def metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Recall, nDCG, reciprocal rank and hit at ``k`` per query that has relevant items."""
    total = relevant.groupBy(query).agg(F.count("*").alias("total"))
    hits = ranked.where(F.col(rank) <= k).join(relevant.select(query, item), [query, item]).groupBy(query)
    found = hits.agg(F.count("*").alias("found"), F.sum(1 / F.log2(F.col(rank) + 1)).alias("dcg"), F.min(rank).alias("first"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = total.join(found, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(query, zero(F.col("found") / F.col("total")).alias("recall"), zero(F.col("dcg") / ideal).alias("ndcg"), zero(1 / F.col("first")).alias("mrr"), F.col("found").isNotNull().cast("int").alias("hit"))


def anchors_within(vectors: DataFrame, anchors: DataFrame, vec_id: str, vec: str, label: str, centre: str, floor: float = 0.28, margin: float = 0.08, most: int = 3) -> DataFrame:
    """Labels of the nearest anchors: up to ``most``, within ``margin`` of the best and over ``floor``; at least the best.

    Anchors are a fixed handful, so they ride along as one array.
    """
    table = anchors.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col(centre).alias("c")))).alias("anchors"))
    scored = F.transform("anchors", lambda a: F.struct((-F.round(V.cosine(F.col(vec), a["c"]), 9)).alias("s"), a["l"].alias("l")))
    rows = vectors.join(F.broadcast(table)).select(vec_id, F.array_sort(scored).alias("near"))
    ok = F.filter(F.slice("near", 1, most), lambda x: -x["s"] >= F.greatest(F.lit(floor), -F.col("near")[0]["s"] - margin))
    return rows.select(vec_id, F.when(F.size(ok) > 0, ok["l"]).otherwise(F.array(F.col("near")[0]["l"])).alias("labels"))
