"""How exposed every firm is to every event by description, beside how it moved with the event's named firms.

All pairs of events and firms count, but none is put out as a row: blocks of both meet, and a block gives
its best rows for an event, or sums.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import first_per_key

#: Events or firms of a block, and common days that a correlation needs.
ROWS, LEAST_DAYS = 2000, 15
SUMS = ["n", "x", "y", "xx", "yy", "xy"]


def matrix(rows: pd.Series) -> np.ndarray:
    return np.array([[np.nan if v is None else v for v in r] for r in rows], float).reshape(len(rows), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.where(size > 1e-12, m / np.maximum(size, 1e-12), 0)


def together(a: np.ndarray, b: np.ndarray, least: int = LEAST_DAYS) -> np.ndarray:
    """Correlation of each row of ``a`` with each of ``b`` over the days that both have; NaN under ``least`` of them."""
    here, there = ~np.isnan(a), ~np.isnan(b)
    # About the rows' own means, so that large levels do not drown the differences.
    a, b = (np.where(k, m - np.nansum(m, 1, keepdims=True) / np.maximum(k.sum(1, keepdims=True), 1), 0) for m, k in ((a, here), (b, there)))
    p, q = here.astype(float), there.astype(float)
    n = p @ q.T
    some = np.maximum(n, 1)
    sa, sb = a @ q.T, p @ b.T
    va, vb = (a * a) @ q.T - sa * sa / some, p @ (b * b).T - sb * sb / some
    ok = (n >= least) & (va > 1e-12) & (vb > 1e-12)
    return np.where(ok, (a @ b.T - sa * sb / some) / np.sqrt(np.where(ok, va * vb, 1)), np.nan)


def _blocks(events: DataFrame, firms: DataFrame, schema: str, of_block: Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Deals blocks of events to blocks of firms; ``of_block`` gets both, exposures, correlations and who is named."""
    e_parts, f_parts = (max(1, -(-df.count() // ROWS)) for df in (events, firms))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Both may come from one table; columns of their own keep the two sides apart.
    events, firms = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (events, firms))
    e = events.withColumn("_e", F.pmod(F.xxhash64("event"), F.lit(e_parts)).cast("int")).withColumn("_f", every(f_parts))
    f = firms.withColumn("_f", F.pmod(F.xxhash64("firm"), F.lit(f_parts)).cast("int")).withColumn("_e", every(e_parts))
    empty = pd.DataFrame({c.split(" ")[0]: pd.Series([], dtype=object) for c in schema.split(", ")})

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return empty
        exposure = _unit(matrix(a["vector"])) @ _unit(matrix(b["vector"])).T
        named = np.array([np.isin(b["firm"].to_numpy(), np.asarray(names)) for names in a["names"]])
        return of_block(a, b, exposure, together(matrix(a["basket"]), matrix(b["series"])), named)

    by = ["_e", "_f"]
    return e.groupBy(*by).cogroup(f.groupBy(*by)).applyInPandas(meet, schema)


def landscape(events: DataFrame, firms: DataFrame, k: int = 34) -> DataFrame:
    """``event, firm, exposure, realised, named, rank``: the ``k`` most exposed firms of each event.

    ``events`` has event, vector, basket, names: the mean of its named firms a day, null off its
    window; ``firms`` has firm, vector, series.
    """
    kinds = dict(events.dtypes)["event"], dict(firms.dtypes)["firm"]

    def best(a: pd.DataFrame, b: pd.DataFrame, exposure: np.ndarray, real: np.ndarray, named: np.ndarray) -> pd.DataFrame:
        top = min(k, len(b))
        edge = np.partition(exposure, len(b) - top, axis=1)[:, len(b) - top]
        r, c = np.nonzero(exposure >= edge[:, None] - 1e-9)
        real = np.where(np.isnan(real), None, real)
        return pd.DataFrame({"event": a["event"].to_numpy()[r], "firm": b["firm"].to_numpy()[c], "exposure": exposure[r, c], "realised": real[r, c], "named": named[r, c].astype(int)})

    found = _blocks(events, firms, f"event {kinds[0]}, firm {kinds[1]}, exposure double, realised double, named int", best)
    return first_per_key(found, ["event"], [F.round("exposure", 9).desc(), F.col("firm")], rank="rank", most=k)


def validation(events: DataFrame, firms: DataFrame) -> DataFrame:
    """``n, r, t``: correlation of exposure and co-movement over all pairs whose firm the event does not name."""

    def sums(a: pd.DataFrame, b: pd.DataFrame, exposure: np.ndarray, real: np.ndarray, named: np.ndarray) -> pd.DataFrame:
        ok = ~named & ~np.isnan(real)
        x, y = exposure[ok], real[ok]
        return pd.DataFrame([[float(ok.sum()), x.sum(), y.sum(), (x * x).sum(), (y * y).sum(), (x * y).sum()]], columns=SUMS)

    s = _blocks(events, firms, ", ".join(f"{c} double" for c in SUMS), sums).agg(*[F.sum(c).alias(c) for c in SUMS])
    cross = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    r = F.try_divide(cross, F.sqrt((F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))))
    found = s.select(F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.when(F.col("n") > 2, r).alias("r"))
    return found.withColumn("t", F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
