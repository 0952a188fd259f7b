"""Queries of the per-group models, low-rank fits and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import models as M
from tidemark.operators import series as S
from tidemark.plans.stats import n21_design_matrix
from tidemark.plans.windows import PANEL, panel
from tidemark.registry import query, table


def lagged(spark: SparkSession, d: str) -> DataFrame:
    """Daily panel with the market and one lag of each."""
    p = panel(spark, d)
    p = p.join(p.groupBy("day").agg(F.avg("ret").alias("mk")), "day")
    w = S.ordered(["symbol"], ["day"])
    return p.withColumn("own1", F.lag("ret").over(w)).withColumn("mk1", F.lag("mk").over(w))


LAGGED = f"{PANEL}, m AS (SELECT day, avg(ret) AS mk FROM panel GROUP BY 1), lg AS (SELECT symbol, day, ret, mk, lag(ret) OVER w AS own1, lag(mk) OVER w AS mk1 FROM panel JOIN m USING (day) WINDOW w AS (PARTITION BY symbol ORDER BY day))"


@query(f"WITH {LAGGED} SELECT symbol, count(*) AS n, round(regr_r2(ret, mk), 6) AS part, round(1 - regr_r2(ret, mk), 6) AS rest FROM lg WHERE own1 IS NOT NULL GROUP BY 1 HAVING count(*) >= 10")
def m23_sequential_parts(spark: SparkSession, d: str) -> DataFrame:
    s = M.sequential_parts(lagged(spark, d).where("own1 IS NOT NULL"), "symbol", "ret", ["mk"])
    return s.select("symbol", "n", F.round(F.col("parts")[0], 6).alias("part"), F.round("rest", 6).alias("rest"))


@query()
def m21_granger(spark: SparkSession, d: str) -> DataFrame:
    g = M.granger(lagged(spark, d), "symbol", "ret", ["own1"], ["mk1"], 15)
    return g.select("symbol", "n", F.round("log_ratio", 8).alias("log_ratio"), F.round("f", 6).alias("f"))


@query()
def m22_shapley_parts(spark: SparkSession, d: str) -> DataFrame:
    s = M.shapley_parts(lagged(spark, d), "symbol", "ret", {"market": ["mk"], "own": ["own1"], "lagged": ["mk1"]})
    return s.select("symbol", "n", F.transform("parts", lambda x: F.round(x, 8)).alias("parts"), F.round("r2", 8).alias("r2"))


@query()
def m16_partial_least_squares(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").withColumn("y", F.col("label").cast("double") - 4.5)
    _, b = M.partial_least_squares(v, "embedding", "y", 3)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(b)], "i int, coefficient double")


@query()
def m20_one_step_map(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("following"))
    found = M.one_step_map(v.join(b, "vec_id"), "embedding", "following", 8)
    return spark.createDataFrame(sorted(found.items()), "name string, value double")


@query()
def m15_nonnegative_factors(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("r"), (F.col("l_partkey") % 50).cast("int").alias("c")).agg(F.count("*").cast("float").alias("v"))
    return M.factorise(c, "r", "c", "v", 4)[0]


@query()
def v15_theme_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = M.clusters(table(spark, d, "embeddings"), "embedding", 24)
    return c.groupBy("cluster").agg(F.count("*").alias("n"), F.countDistinct("label").alias("breadth"), (F.count("*") * (1 + F.countDistinct("label"))).alias("weight"))


@query()
def m17_boosted_fits(spark: SparkSession, d: str) -> DataFrame:
    """Next day's log move of each series from its own three last ones and Mondays: a line, boosted trees, and trees on other rows' features."""
    x = n21_design_matrix(spark, d).withColumn("key", F.concat_ws(":", "symbol", "day"))
    cut = x.agg(F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY unix_date(day))").alias("cut"))
    rows = x.join(F.broadcast(cut)).withColumn("late", F.unix_date("day") > F.col("cut"))
    return M.compared_fits(rows, ["lv", "l1", "l2", "monday"], "target", "late", "key", steps=20)
