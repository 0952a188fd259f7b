"""Rolling statistics of keyed time series; every frame says whether it holds the current row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

TINY = 1e-12


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return W.partitionBy(*keys).orderBy(*order)


def simple_return(value: Column, w: WindowSpec) -> Column:
    """Change over the previous row; null at the start and after a zero."""
    return F.try_divide(value, F.lag(value).over(w)) - 1


def z_score(value: Column, w: WindowSpec, rows: int = 20, least: int = 10) -> Column:
    """z of the current row in the frame of ``rows`` rows that ends with it; sample deviation.

    Nulls leave the frame after it is cut, so ``least`` counts values, not rows.
    """
    f = w.rowsBetween(1 - rows, 0)
    ok = (F.count(value).over(f) >= least) & (F.stddev_samp(value).over(f) > TINY)
    return F.when(ok, (value - F.avg(value).over(f)) / F.stddev_samp(value).over(f))


def surprise_z(value: Column, w: WindowSpec, rows: int = 60) -> Column:
    """z of the current row against the ``rows`` rows before it; population deviation, full frame only."""
    f = w.rowsBetween(-rows, -1)
    ok = (F.count(value).over(f) >= rows) & (F.stddev_pop(value).over(f) > TINY)
    return F.when(ok, (value - F.avg(value).over(f)) / F.stddev_pop(value).over(f))


def scaled(value: Column, w: WindowSpec, rows: int = 60) -> Column:
    """Value over the population deviation of the rows before it; the mean stays."""
    f = w.rowsBetween(-rows, -1)
    ok = (F.count(value).over(f) >= rows) & (F.stddev_pop(value).over(f) > TINY)
    return F.when(ok, value / F.stddev_pop(value).over(f))


def beta(y: Column, x: Column, w: WindowSpec, rows: int = 250, least: int = 150) -> Column:
    """Slope of y on x over the rows before the current one."""
    f = w.rowsBetween(-rows, -1)
    both = y.isNotNull() & x.isNotNull()
    return F.when(F.count(F.when(both, 1)).over(f) >= least, F.regr_slope(y, x).over(f))


def corr(a: Column, b: Column, over: WindowSpec | None = None) -> Column:
    """Correlation of the rows that have both, of a group or of a window frame: NaN where either does not vary, null without rows.

    ``F.corr`` divides by zero there, an error in ANSI mode.
    """
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    parts = [F.covar_pop(x, y), F.var_pop(x), F.var_pop(y)]
    c, p, q = (v.over(over) for v in parts) if over is not None else parts
    return F.when(c.isNotNull(), F.coalesce(F.try_divide(c, F.sqrt(p) * F.sqrt(q)), F.lit(float("nan"))))


def rolling_corr(a: Column, b: Column, w: WindowSpec, rows: int = 120, least: int = 80) -> Column:
    """Correlation over the frame that ends with the current row, of rows that have both."""
    f = w.rowsBetween(1 - rows, 0)
    both = F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).over(f)
    return F.when(both >= least, corr(a, b, f))


def runs(df: DataFrame, keys: list[str], order: list[str], flag: str) -> DataFrame:
    """Runs of equal flags: ``keys, run, flag, first_n, last_n, length`` with row numbers from 0."""
    w = ordered(keys, order)
    new = (~F.col(flag).eqNullSafe(F.lag(flag).over(w))).cast("int")
    rows = df.select(*keys, flag, (F.row_number().over(w) - 1).alias("_n"), new.alias("_new"))
    rows = rows.withColumn("run", F.sum("_new").over(W.partitionBy(*keys).orderBy("_n")))
    return rows.groupBy(*keys, "run").agg(F.first(flag).alias(flag), F.min("_n").alias("first_n"), F.max("_n").alias("last_n"), F.count("*").alias("length"))


def run_states(df: DataFrame, keys: list[str], order: list[str], active: str, least_run: int = 3, confirm: int = 6) -> DataFrame:
    """One state a key from its series of flags: what the last two long runs say.

    A change counts where it is inside the series and agrees with the last flag, and is
    confirmed once it has held for ``confirm`` rows; before that it is UNCONFIRMED.
    Null flags are unknown and take no part.
    """
    r = runs(df.where(F.col(active).isNotNull()), keys, order, active)
    long = F.sort_array(F.collect_list(F.when(F.col("length") >= least_run, F.struct("first_n", F.col(active).alias("on")))))
    found = r.groupBy(*keys).agg(
        F.sum("length").alias("n"), F.sum(F.when(F.col(active), F.col("length")).otherwise(0)).alias("on_n"), F.count("*").alias("n_runs"),
        F.max_by(active, "run").alias("now"), long.alias("long"),
    )
    last, before = F.try_element_at("long", F.lit(-1)), F.try_element_at("long", F.lit(-2))
    inside = (F.size("long") >= 2) & (before["first_n"] > 0)
    held = (F.col("n") - last["first_n"]) >= confirm
    state = (
        F.when(F.col("n") < 2 * least_run, "INSUFFICIENT")
        .when(F.col("on_n") == 0, "NEVER")
        .when(inside & held & before["on"] & ~last["on"] & ~F.col("now"), "ENDED")
        .when(inside & held & ~before["on"] & last["on"] & F.col("now"), "EMERGING")
        .when(inside & ~held, "UNCONFIRMED")
        .when(F.col("on_n") / F.col("n") >= 0.7, "PERSISTENT")
        .when(F.col("n_runs") >= 5, "EPISODIC")
        .when(F.col("now"), "PERSISTENT")
        .otherwise("NEVER")
    )
    return found.select(*keys, "n", "n_runs", state.alias("state"))


def event_profile(series: DataFrame, anchors: DataFrame, key: str, index: str, value: str, width: int) -> DataFrame:
    """Mean and count of the value at offsets -width..width around anchors (key, index)."""
    spread = anchors.select(key, F.col(index).alias("_anchor"), F.explode(F.sequence(F.lit(-width), F.lit(width))).alias("offset"))
    spread = spread.withColumn(index, F.col("_anchor") + F.col("offset"))
    return spread.join(series.select(key, index, value), [key, index]).groupBy("offset").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def decompose(panel: DataFrame, key: str, day: str, sector: str, ret: str, rows: int, least: int, trail: int) -> DataFrame:
    """Total, market, sector and idiosyncratic part of each return, and the residual's sigma.

    Market: equal-weight mean of a day.  Beta: over the rows before.  Sector: mean of the
    market-adjusted residuals of a sector's day.  Sigma: absolute idiosyncratic part over
    its population deviation in the ``trail`` rows before.  The parts add up to the total.
    """
    market = panel.groupBy(day).agg(F.avg(ret).alias("market_ret"))
    p = panel.join(market, day)
    w = ordered([key], [day])
    p = p.withColumn("beta", beta(F.col(ret), F.col("market_ret"), w, rows, least)).where(F.col("beta").isNotNull())
    p = p.withColumn("market", F.col("beta") * F.col("market_ret")).withColumn("_residual", F.col(ret) - F.col("market"))
    p = p.withColumn("sector_part", F.avg("_residual").over(W.partitionBy(sector, day)))
    p = p.withColumn("idio", F.col("_residual") - F.col("sector_part"))
    return p.withColumn("sigma", F.abs(scaled(F.col("idio"), w, trail))).drop("_residual")
