"""Nearest neighbours of all vectors of a table: exact by blocks, or by cells round coarse centres.

Both ways bring blocks of items to blocks of queries, each packed in one row of at most about
``ROWS`` vectors.  A query block meets its item blocks one after the other and keeps
the best ``k`` of each query as it goes, so what is put out is ``k`` rows a query.  The exact way brings every
item block to every query block.  The cell way puts items and queries in the cell of
their nearest centre and brings a query block the items of the ``probes`` cells nearest to its own; a
cell of more than ``ROWS`` rows is several blocks, so no task holds a hot cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import saved
from tidemark.operators.temporal import first_per_key

#: Vectors of a block, queries scored at once within one, and vectors at most that centres are fitted on.
ROWS, STEP, SAMPLE = 8192, 512, 20_000
#: Item blocks that a query block meets in one group, as a group's packs may come to Python in one batch.
SLAB = 8
#: Centres at most, so that they may be broadcast, and districts of them at least (a district has one cell or more).
MOST_CELLS, DISTRICTS = 4096, 48


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.array(rows.tolist(), float).reshape(len(rows), -1)


def _packed(df: DataFrame, keys: list[str], ident: str, vec: str, name: str) -> DataFrame:
    """One row for each value of ``keys``: ids and vectors as bytes."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        one = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame(one | {f"{name}_ids": [pdf["id"].to_numpy(np.int64).tobytes()], f"{name}_vectors": [_matrix(pdf["v"]).tobytes()]})

    rows = df.select(*keys, F.col(ident).cast("long").alias("id"), F.col(vec).alias("v"))
    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(pack, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {name}_ids binary, {name}_vectors binary")


def kept(row: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best ``k`` of each row by rounded score, ties to the smaller item."""
    place = np.unique(item, return_inverse=True)[1] if item.dtype == object else item
    order = np.lexsort((place, -np.round(score, 9), row))
    row, item, score = row[order], item[order], score[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if row.size else np.zeros(0, int)
    place = np.arange(row.size) - np.repeat(first, np.diff(np.r_[first, row.size]))
    return row[place < k], item[place < k], score[place < k]


def _best(k: int, earlier: bool):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One query block with the item blocks that it meets, one after the other."""
        qs, held = np.zeros(0, np.int64), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for q_ids, q_vectors, i_ids, i_vectors in zip(batch["q_ids"], batch["q_vectors"], batch["i_ids"], batch["i_vectors"], strict=True):
                qs, items = np.frombuffer(q_ids, np.int64), np.frombuffer(i_ids, np.int64)
                q, x = np.frombuffer(q_vectors).reshape(qs.size, -1), np.frombuffer(i_vectors).reshape(items.size, -1)
                found = [held]
                for at in range(0, qs.size, STEP):
                    s = q[at : at + STEP] @ x.T
                    if earlier:
                        s[items[None, :] >= qs[at : at + STEP, None]] = -np.inf
                    top = min(k, items.size)
                    edge = np.partition(s, items.size - top, axis=1)[:, items.size - top]
                    # Ties at the edge stay in until the ids decide.
                    r, c = np.nonzero((s >= edge[:, None] - 1e-9) & np.isfinite(s))
                    found.append((at + r, items[c], s[r, c]))
                held = kept(*(np.concatenate(p) for p in zip(*found, strict=True)), k)
        yield pd.DataFrame({"query": qs[held[0]], "item": held[1], "score": held[2]})

    return best


def _parts(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def _ranked(met: DataFrame, keys: list[str], k: int, earlier: bool) -> DataFrame:
    """``met`` has a query block's pack, named by ``keys``, beside each item pack that it meets; the group is read in small batches."""
    found = met.select(*keys, "q_ids", "q_vectors", "i_ids", "i_vectors").groupBy(*keys).applyInPandas(_best(k, earlier), "query long, item long, score double")
    return first_per_key(found, ["query"], [F.round("score", 9).desc(), F.col("item")], rank="rank", most=k)


def exact(queries: DataFrame, items: DataFrame, k: int, earlier: bool = False, query: str = "query", q: str = "q", item: str = "item", x: str = "x") -> DataFrame:
    """``query, item, score, rank``: the ``k`` items of greatest inner product with each query.

    ``earlier`` takes only items of a smaller id.  Ties go to the smaller id.  The work is
    the product of both sizes; see :func:`by_cells`.
    """
    parts, q_parts = _parts(items.count()), _parts(queries.count())
    own = _packed(items.withColumn("part", F.pmod(F.xxhash64(item), F.lit(parts)).cast("int")), ["part"], item, x, "i").withColumn("slab", F.floor(F.col("part") / SLAB))
    asked = _packed(queries.withColumn("q_block", F.pmod(F.xxhash64(query), F.lit(q_parts)).cast("int")), ["q_block"], query, q, "q")
    return _ranked(own.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1)))).join(asked, "q_block"), ["q_block", "slab"], k, earlier)


def within(queries: DataFrame, items: DataFrame, k: int, group: str, earlier: bool = False, query: str = "query", q: str = "q", item: str = "item", x: str = "x") -> DataFrame:
    """As :func:`exact`, but a query meets only the items of its own ``group``; a null group has none.

    A group of more than ``ROWS`` rows is several blocks on either side.
    """

    def placed(df: DataFrame, ident: str, vec: str, part: str) -> DataFrame:
        sizes = df.groupBy(group).agg((F.floor((F.count("*") - 1) / ROWS) + 1).cast("int").alias("_n"))
        return df.select(group, ident, vec).join(sizes, group).withColumn(part, F.pmod(F.xxhash64(ident), "_n").cast("int"))

    own = _packed(placed(items, item, x, "part"), [group, "part"], item, x, "i")
    asked = _packed(placed(queries, query, q, "q_part"), [group, "q_part"], query, q, "q")
    return _ranked(asked.join(own, group), [group, "q_part"], k, earlier)


def centres(items: DataFrame, item: str, x: str, cells: int, rounds: int = 8, sample: int = SAMPLE) -> np.ndarray:
    """Unit centres by spherical k-means over at most ``sample`` items, those of the least hash."""
    cells = min(cells, MOST_CELLS)
    found = items.select(item, x).orderBy(F.xxhash64(item), item).limit(sample).toPandas()
    v = _matrix(found[x]) if len(found) else np.zeros((0, 1))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    c = v[: max(1, min(cells, len(v)))].copy()
    for _ in range(rounds):
        home = (v @ c.T).argmax(1) if len(v) else np.zeros(0, int)
        sums = np.zeros_like(c)
        np.add.at(sums, home, v)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), c)
    return c


def _order(centre: np.ndarray) -> np.ndarray:
    """For each cell all cells, the nearest first; each comes first for itself."""
    near = centre @ centre.T
    np.fill_diagonal(near, np.inf)
    return np.argsort(-near, axis=1, kind="stable")


def by_cells(queries: DataFrame, items: DataFrame, k: int, centre: np.ndarray, probes: int, earlier: bool = False, query: str = "query", q: str = "q", item: str = "item", x: str = "x") -> DataFrame:
    """As :func:`exact`, but a query meets only the items of the ``probes`` cells nearest to its own."""
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(centre)

    @F.pandas_udf("int")
    def home(v: pd.Series) -> pd.Series:
        return pd.Series((_matrix(v) @ shared.value.T).argmax(1).astype(np.int32)) if len(v) else pd.Series([], dtype=np.int32)

    def placed(df: DataFrame, ident: str, vec: str) -> DataFrame:
        """Rows with their cell and a part of it; there are at most ``MOST_CELLS`` sizes to broadcast."""
        rows = saved(df.select(ident, vec).withColumn("cell", home(vec)))
        sizes = rows.groupBy("cell").agg((F.floor((F.count("*") - 1) / ROWS) + 1).cast("int").alias("parts"))
        return rows.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64(ident), "parts").cast("int"))

    order = _order(centre)
    near = order[:, : max(1, probes)]
    # Home cells near each other form a district, to which an item pack goes once, however many of its cells probe it.
    districts = min(len(centre), max(DISTRICTS, _parts(queries.count())))
    district = np.empty(len(centre), np.int64)
    district[order[:1].ravel()] = np.arange(len(centre)) * districts // max(1, len(centre))
    route = pd.DataFrame({"home": np.repeat(np.arange(len(centre)), near.shape[1]), "cell": near.ravel()}).assign(district=lambda r: district[r["home"]])
    route = saved(spark.createDataFrame(route, "home int, cell int, district int"))
    own = _packed(placed(items, item, x), ["cell", "part"], item, x, "i").join(route.select("district", "cell").distinct(), "cell").select("district", "cell", "i_ids", "i_vectors")
    homes = route.select("home", "district", "cell").groupBy("home", "district").agg(F.collect_list("cell").alias("probed"))
    asked = _packed(placed(queries, query, q), ["cell", "part"], query, q, "q").withColumnRenamed("cell", "home").join(homes, "home")
    met = asked.join(own, "district").where(F.array_contains("probed", F.col("cell")))
    return _ranked(met, ["district", "home", "part"], k, earlier)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """Share of the wanted (query, item) rows that are found."""
    hits, n = wanted.join(found.select("query", "item", F.lit(1).alias("hit")), ["query", "item"], "left").agg(F.sum("hit"), F.count("*")).first()
    return (hits or 0) / n if n else 1.0


def probes_for(queries: DataFrame, items: DataFrame, k: int, centre: np.ndarray, target: float = 0.9, sample: int = 256, earlier: bool = False, query: str = "query", q: str = "q", item: str = "item", x: str = "x") -> int:
    """The least number of probed cells that reaches the recall ``target`` on a sample of queries.

    At most ``sample`` queries, those of the least hash, are answered exactly; for each true
    neighbour the place of its cell among those near the query's cell is the number of probes
    it needs.
    """
    asked = queries.orderBy(F.xxhash64(query), query).limit(sample).select(F.col(query).alias("query"), F.col(q).alias("q"))
    truth = exact(asked, items, k, earlier, "query", "q", item, x).select("query", "item")
    both = truth.join(asked, "query").join(items.select(F.col(item).alias("item"), F.col(x).alias("x")), "item").select("q", "x").toPandas()
    if not len(both):
        return 1
    order = _order(centre)[(_matrix(both["q"]) @ centre.T).argmax(1)]
    home = (_matrix(both["x"]) @ centre.T).argmax(1)
    need = np.sort((order == home[:, None]).argmax(1) + 1)
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))) - 1)])
