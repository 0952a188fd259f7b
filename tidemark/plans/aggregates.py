"""Queries of the aggregation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import aggregates as A
from tidemark.plans.windows import PANEL, PARTS, panel, prices
from tidemark.operators import series as S
from tidemark.registry import query, table


def quotes(spark: SparkSession, d: str) -> DataFrame:
    """Events as settled contracts: price from the value, outcome from the id, series by user."""
    e = table(spark, d, "events")
    price = F.least(F.greatest(F.col("value") / 120, F.lit(0.01)), F.lit(0.99))
    return e.select("event_id", F.col("user_id").alias("series"), "event_type", price.alias("price"), (F.col("event_id") % 3 == 0).cast("int").alias("y"))


QUOTES = "quotes AS (SELECT event_id, user_id AS series, event_type, least(greatest(value / 120, 0.01), 0.99)::DOUBLE AS price, (event_id % 3 = 0)::INT AS y FROM events)"
PNL = f"""{QUOTES}, pnl AS (SELECT *, (1 - y) - (1 - price) AS gross, (1 - y) - (1 - price) - ceil(round(0.07 * (1 - price) * (1 - (1 - price)) * 100, 9)) / 100 AS net_fee,
  (1 - y) - (1 - price) - ceil(round(0.07 * (1 - price) * (1 - (1 - price)) * 100, 9)) / 100 - 0.01 AS net_all FROM quotes)"""


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(*) AS lines FROM lineitem GROUP BY 1")
def a01_hub_degree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.count("*").alias("lines"))


@query("""WITH c AS (SELECT date_trunc('month', l_shipdate)::DATE AS month, l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY ALL),
s AS (SELECT month, n / sum(n) OVER (PARTITION BY month) AS share FROM c) SELECT month, round(sum(share * share), 8) AS hhi, count(*) AS members FROM s GROUP BY month""")
def a02_herfindahl(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("month", F.trunc("l_shipdate", "month"))
    return A.herfindahl(l, ["month"], "l_suppkey", "l_orderkey").select("month", F.round("hhi", 8).alias("hhi"), "members")


@query("""WITH c AS (SELECT year(l_shipdate)::INT AS yr, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY yr ORDER BY n) AS u, row_number() OVER (PARTITION BY yr ORDER BY n DESC) AS v FROM c)
SELECT yr, round(2 * sum(u * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 8) AS gini, round(sum(n) FILTER (v <= 10) / sum(n), 8) AS top_share FROM r GROUP BY yr""")
def a03_gini(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("yr"), "l_suppkey").agg(F.count("*").alias("n"))
    return A.gini(c, ["yr"], "n").select("yr", F.round("gini", 8).alias("gini"), F.round("top_share", 8).alias("top_share"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS open_lines, round(avg(l_quantity) FILTER (l_discount > 0.05), 6) AS big_discount_qty FROM lineitem GROUP BY 1""")
def a04_filtered_aggregates(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    return l.groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("open_lines"), F.round(F.avg(F.when(F.col("l_discount") > 0.05, F.col("l_quantity"))), 6).alias("big_discount_qty"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0")
def a05_both_legs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("r")).where("a > 0 AND r > 0").select("l_orderkey")


@query("SELECT n_regionkey, min(r_name) AS r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def a06_any_value(spark: SparkSession, d: str) -> DataFrame:
    """All values of a group are equal, so any one does."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("n_regionkey").agg(F.any_value("r_name").alias("r_name"), F.count("*").alias("n"))


@query("""SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS kinds, bool_or(o_totalprice > 200000) AS macro, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_priority, count(*) AS n FROM orders GROUP BY 1""")
def a07_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("kinds"), F.bool_or(F.col("o_totalprice") > 200000).alias("macro"),
        F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"), F.count("*").alias("n"),
    )


@query("""WITH c AS (SELECT user_id, ts::DATE AS day, event_type, event_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, day, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS classes, string_agg(event_id::VARCHAR, ',' ORDER BY k) FILTER (k <= 6) AS docs FROM c GROUP BY ALL""")
def a08_cells(spark: SparkSession, d: str) -> DataFrame:
    """Classes and the first six documents of each (name, day)."""
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    e = e.withColumn("k", F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id")))
    docs = F.sort_array(F.collect_list(F.when(F.col("k") <= 6, F.struct("k", "event_id"))))
    return e.groupBy("user_id", "day").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("classes"), F.array_join(docs["event_id"].cast("array<string>"), ",").alias("docs"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS counts FROM c GROUP BY 1")
def a09_class_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counts = F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n"))))
    return c.groupBy("user_id").agg(F.array_join(F.transform(F.map_entries(counts), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("counts"))


@query("""WITH g AS (SELECT avg(value) AS gm, stddev_pop(value) AS gs FROM events), b AS (SELECT user_id, count(value) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY 1)
SELECT user_id, n, round(CASE WHEN n < 60 THEN gm ELSE m END, 6) AS prior, round(CASE WHEN n < 60 THEN gs ELSE s END, 6) AS prior_sd FROM b, g""")
def a10_class_prior(spark: SparkSession, d: str) -> DataFrame:
    p = A.class_prior(table(spark, d, "events"), "user_id", "value", 60)
    return p.select("user_id", "n", F.round("prior", 6).alias("prior"), F.round("prior_sd", 6).alias("prior_sd"))


@query("""WITH g AS (SELECT unnest([DATE '2024-01-10', DATE '2024-01-17', DATE '2024-01-24']) AS as_of)
SELECT event_type, as_of, count(*) AS n, round(avg(value), 6) AS prior, round(stddev_pop(value), 5) AS prior_sd FROM g JOIN events ON ts::DATE >= as_of - 7 AND ts::DATE < as_of GROUP BY ALL HAVING count(*) >= 18""")
def a11_rolling_prior(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    grid = spark.range(3).select(F.expr("date_add(DATE '2024-01-10', CAST(7 * id AS INT))").alias("day"))
    return A.rolling_prior(e, "event_type", "day", "value", grid, 7, 18).select("event_type", "as_of", "n", F.round("prior", 6).alias("prior"), F.round("prior_sd", 5).alias("prior_sd"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS prior FROM events GROUP BY 1 HAVING count(*) >= 30")
def a12_pooled_prior(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("prior")).where("n >= 30")


@query(f"""WITH {PANEL}, news AS (SELECT DISTINCT user_id AS symbol, ts::DATE AS day FROM events WHERE event_type = 'purchase')
SELECT count(*) AS n, round(avg(ret), 6) AS control FROM panel ANTI JOIN news USING (symbol, day)""")
def a13_control_mean(spark: SparkSession, d: str) -> DataFrame:
    """Exact mean over all cells without news, in place of random draws from them."""
    news = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day")).distinct()
    return panel(spark, d).join(news, ["symbol", "day"], "left_anti").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("control"))


CALIBRATION = f"""{QUOTES}, b AS (SELECT least(9, floor(price * 10))::INT AS bin, count(*) AS n, avg(price) AS mean_price, avg(y) AS realised, sqrt(avg(y) * (1 - avg(y)) / count(*)) AS se FROM quotes GROUP BY 1),
cal AS (SELECT r.bin::INT AS bin, coalesce(n, 0) AS n, mean_price, realised, se, realised - mean_price AS edge FROM range(10) r(bin) LEFT JOIN b ON b.bin = r.bin)"""


@query(f"WITH {CALIBRATION} SELECT bin, n, round(mean_price, 6) AS mean_price, round(realised, 6) AS realised, round(se, 6) AS se, round(edge, 6) AS edge FROM cal")
def a14_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = A.calibration(quotes(spark, d), "price", "y")
    return c.select("bin", "n", *[F.round(x, 6).alias(x) for x in ("mean_price", "realised", "se", "edge")])


@query(f"WITH {CALIBRATION} SELECT arg_max(bin, edge / se) AS best, arg_min(bin, edge) AS worst FROM cal WHERE n >= 30 AND se > 0")
def a15_best_bin(spark: SparkSession, d: str) -> DataFrame:
    c = A.calibration(quotes(spark, d), "price", "y").where("n >= 30 AND se > 0")
    return c.agg(F.max_by("bin", F.col("edge") / F.col("se")).alias("best"), F.min_by("bin", "edge").alias("worst"))


@query(f"WITH {CALIBRATION} SELECT bin, n FROM cal WHERE bin >= 4 QUALIFY min((n >= 30 AND edge < 0)::INT) OVER (ORDER BY bin) = 1")
def a16_contiguous_rule(spark: SparkSession, d: str) -> DataFrame:
    c = A.calibration(quotes(spark, d), "price", "y").where("bin >= 4")
    return A.contiguous_rule(c, "bin", (F.col("n") >= 30) & (F.col("edge") < 0)).select("bin", "n")


@query(f"""WITH {PNL} SELECT event_type, count(*) AS n, round(avg(gross), 6) AS gross, round(avg(net_fee), 6) AS net_fee, round(avg(net_all), 6) AS net_all, round(sum(net_all), 4) AS total,
round(avg(net_all) / (stddev_pop(net_all) / sqrt(count(*))), 4) AS t FROM pnl GROUP BY 1""")
def a17_pnl(spark: SparkSession, d: str) -> DataFrame:
    p = A.selling_pnl(quotes(spark, d), "price", "y", 0.01)
    m = A.mean_t(p, "net_all", ["event_type"])
    g = p.groupBy("event_type").agg(F.round(F.avg("gross"), 6).alias("gross"), F.round(F.avg("net_fee"), 6).alias("net_fee"))
    return m.join(g, "event_type").select("event_type", "n", "gross", "net_fee", F.round("mean", 6).alias("net_all"), F.round("total", 4).alias("total"), F.round("t", 4).alias("t"))


@query(f"WITH {PNL}, c AS (SELECT avg(net_all) AS m FROM pnl GROUP BY series) SELECT count(*) AS clusters, round(avg(m), 6) AS mean, round(stddev_samp(m) / sqrt(count(*)), 6) AS se, round(avg(m) / (stddev_samp(m) / sqrt(count(*))), 4) AS t FROM c")
def a18_clustered_mean(spark: SparkSession, d: str) -> DataFrame:
    c = A.clustered_mean(A.selling_pnl(quotes(spark, d), "price", "y", 0.01), "net_all", ["series"])
    return c.select("clusters", F.round("mean", 6).alias("mean"), F.round("se", 6).alias("se"), F.round("t", 4).alias("t"))


@query(f"WITH {PNL} SELECT series % 10 AS sub, round(avg(net_all), 6) AS net, sign(avg(net_all))::INT AS direction FROM pnl GROUP BY 1")
def a19_breakdown(spark: SparkSession, d: str) -> DataFrame:
    p = A.selling_pnl(quotes(spark, d), "price", "y", 0.01).groupBy((F.col("series") % 10).alias("sub"))
    return p.agg(F.round(F.avg("net_all"), 6).alias("net"), F.signum(F.avg("net_all")).cast("int").alias("direction"))


@query("SELECT event_type, count(*) AS n, round(avg((value > 50)::INT), 6) AS confirmed, round(avg(abs(value - 50)), 6) AS mean_abs, round(avg((value > 50)::INT) FILTER (user_id % 2 = 0), 6) AS confirmed_high FROM events GROUP BY 1")
def a20_confirmation(spark: SparkSession, d: str) -> DataFrame:
    yes = (F.col("value") > 50).cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg(yes), 6).alias("confirmed"), F.round(F.avg(F.abs(F.col("value") - 50)), 6).alias("mean_abs"), F.round(F.avg(F.when(F.col("user_id") % 2 == 0, yes)), 6).alias("confirmed_high"))


@query("SELECT quality, toxic, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY quality), 6) AS share FROM labels GROUP BY quality, toxic")
def a21_tallies(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("quality")), 6))


@query("SELECT role, count(*) FILTER (length(text) >= 100) AS pass, count(*) FILTER (length(text) < 100) AS fail FROM conversations GROUP BY 1")
def a22_pass_fail_pivot(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("text IS NOT NULL").withColumn("verdict", F.when(F.length("text") >= 100, "pass").otherwise("fail"))
    p = c.groupBy("role").pivot("verdict", ["pass", "fail"]).count()
    return p.select("role", F.coalesce("pass", F.lit(0)).alias("pass"), F.coalesce("fail", F.lit(0)).alias("fail"))


@query("""WITH n AS (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem), f AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS df FROM lineitem GROUP BY 1)
SELECT l_partkey, df, round(ln(n / df), 6) AS idf, df <= ceil(0.001 * n) AS rare FROM f, n""")
def a24_entity_idf(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    f = l.groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("df"))
    return f.join(F.broadcast(l.agg(F.countDistinct("l_orderkey").alias("n")))).select("l_partkey", "df", F.round(F.log(F.col("n") / F.col("df")), 6).alias("idf"), (F.col("df") <= F.ceil(0.001 * F.col("n"))).alias("rare"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), s AS (SELECT event_type, count(*) AS spread FROM c GROUP BY 1), t AS (SELECT count(DISTINCT user_id) AS names FROM events)
SELECT user_id, event_type, round(n * ln(1 + names / spread), 6) AS weight FROM c JOIN s USING (event_type), t WHERE n >= 3""")
def a25_name_cause_tfidf(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    s = c.groupBy("event_type").agg(F.count("*").alias("spread"))
    names = c.agg(F.countDistinct("user_id").alias("names"))
    rows = c.where("n >= 3").join(F.broadcast(s), "event_type").join(F.broadcast(names))
    return rows.select("user_id", "event_type", F.round(F.col("n") * F.log(1 + F.col("names") / F.col("spread")), 6).alias("weight"))


@query("""WITH c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_partkey, l_returnflag AS type FROM c QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag = 'N', n DESC, l_returnflag) = 1""")
def a26_majority_type(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent type, the catch-all only where nothing else was seen; ties by name."""
    c = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("n"))
    w = W.partitionBy("l_partkey").orderBy(F.col("l_returnflag") == "N", F.col("n").desc(), "l_returnflag")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("l_partkey", F.col("l_returnflag").alias("type"))


@query("""WITH c AS (SELECT p_size, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_size, p_type AS surface FROM c QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, length(p_type), p_type) = 1""")
def a27_surface_form(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").groupBy("p_size", "p_type").agg(F.count("*").alias("n"))
    w = W.partitionBy("p_size").orderBy(F.col("n").desc(), F.length("p_type"), "p_type")
    return c.withColumn("k", F.row_number().over(w)).where("k = 1").select("p_size", F.col("p_type").alias("surface"))


@query("""WITH x AS (SELECT label, unnest(range(64)) AS dim, unnest(embedding) AS v FROM embeddings)
SELECT label, dim::INT AS dim, round(avg(v::DOUBLE), 5) AS mean FROM x GROUP BY ALL HAVING count(*) >= 5""")
def a28_centroid(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("mean"), F.count("*").alias("n")).where("n >= 5").drop("n")


@query("SELECT source, count(*) AS fetched, count(*) FILTER (n_chars > 500) AS ok, max(doc_id) AS latest FROM documents GROUP BY 1")
def a30_feed_health(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(F.col("n_chars") > 500).alias("ok"), F.max("doc_id").alias("latest"))


@query("SELECT o_orderstatus, sum((o_totalprice > 100000)::INT)::BIGINT AS large, bool_and(o_totalprice > 1000) AS all_real FROM orders GROUP BY 1")
def a32_brief_rollup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum((F.col("o_totalprice") > 100000).cast("int")).alias("large"), F.every(F.col("o_totalprice") > 1000).alias("all_real"))


@query("""SELECT l_suppkey AS cause, l_partkey % 50 AS subject, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed' ELSE min(l_returnflag) END AS direction, count(DISTINCT l_orderkey) AS sources FROM lineitem GROUP BY ALL""")
def a33_edge_rollup(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    flags = F.collect_set("l_returnflag")
    e = l.groupBy(F.col("l_suppkey").alias("cause"), (F.col("l_partkey") % 50).alias("subject")).agg(flags.alias("f"), F.countDistinct("l_orderkey").alias("sources"))
    return e.select("cause", "subject", F.when(F.size("f") > 1, "mixed").otherwise(F.array_min("f")).alias("direction"), "sources")


@query("""WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS both_, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS any_,
 round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)), 8) AS jaccard""")
def a35_pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    """One pass: a pair is in either set, or in both."""
    l = table(spark, d, "lineitem").where("l_returnflag IN ('A', 'R')")
    p = l.groupBy("l_partkey", "l_suppkey").agg(F.countDistinct("l_returnflag").alias("k"))
    return p.agg(F.count_if(F.col("k") == 2).alias("both_"), F.count("*").alias("any_"), F.round(F.count_if(F.col("k") == 2) / F.count("*"), 8).alias("jaccard"))


@query("SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(quantile_disc(value, 0.5), 6) AS p50, round(quantile_disc(value, 0.75), 6) AS p75, round(quantile_disc(value, 0.95), 6) AS p95, round(max(value), 6) AS high FROM events GROUP BY 1")
def a36_duration_stats(spark: SparkSession, d: str) -> DataFrame:
    p = lambda q: F.expr(f"round(percentile_disc({q}) WITHIN GROUP (ORDER BY value), 6)")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), p(0.5).alias("p50"), p(0.75).alias("p75"), p(0.95).alias("p95"), F.round(F.max("value"), 6).alias("high"))


@query(f"""WITH {PARTS}, news AS (SELECT DISTINCT user_id AS symbol, ts::DATE AS day FROM events WHERE event_type = 'purchase')
SELECT symbol, date_trunc('month', day)::DATE AS month, round(sum(ret), 2) AS total, round(sum(idio), 2) AS idio, count(n.day) AS news_days FROM parts LEFT JOIN news n USING (symbol, day) GROUP BY ALL""")
def a37_monthly_decomposition(spark: SparkSession, d: str) -> DataFrame:
    p = S.decompose(panel(spark, d), "symbol", "day", "sector", "ret", 20, 5, 5)
    news = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("symbol"), F.to_date("ts").alias("day"), F.lit(1).alias("news")).distinct()
    p = p.join(news, ["symbol", "day"], "left").groupBy("symbol", F.trunc("day", "month").alias("month"))
    return p.agg(F.round(F.sum("ret"), 2).alias("total"), F.round(F.sum("idio"), 2).alias("idio"), F.count("news").alias("news_days"))


@query("""WITH n AS (SELECT label, round(avg(list_sum(list_transform(embedding, lambda x: x::DOUBLE))), 6) AS m, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, n, CASE WHEN m > 0.08 THEN 'driver' WHEN m > 0.03 THEN 'weak' ELSE 'context' END AS role FROM n WHERE n >= 40""")
def a38_role_by_mean(spark: SparkSession, d: str) -> DataFrame:
    s = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    n = table(spark, d, "embeddings").groupBy("label").agg(F.round(F.avg(s), 6).alias("m"), F.count("*").alias("n")).where("n >= 40")
    return n.select("label", "n", F.when(F.col("m") > 0.08, "driver").when(F.col("m") > 0.03, "weak").otherwise("context").alias("role"))


@query("""SELECT source, count(*) AS n, round(avg((n_chars > 1000)::INT), 6) AS kept_share, round(median(n_chars), 4) AS median_chars, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY 1""")
def a41_link_precision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 6).alias("kept_share"), F.round(F.median("n_chars"), 4).alias("median_chars"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("SELECT ts::DATE AS day, round(quantile_cont(value, 0.1), 5) AS p10, round(quantile_cont(value, 0.5), 5) AS p50, round(quantile_cont(value, 0.9), 5) AS p90, round(avg((value < 5)::INT), 6) AS echo FROM events GROUP BY 1")
def a42_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    p = F.percentile("value", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(p.alias("p"), F.round(F.avg((F.col("value") < 5).cast("int")), 6).alias("echo"))
    return e.select("day", *[F.round(F.col("p")[i], 5).alias(n) for i, n in enumerate(("p10", "p50", "p90"))], "echo")


@query("SELECT p_brand, p_size, count(*) AS n, round(sum(p_retailprice), 2) AS price, grouping(p_brand) + 0 AS no_brand, grouping(p_size) + 0 AS no_size FROM part GROUP BY CUBE (p_brand, p_size)")
def a43_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").cube("p_brand", "p_size").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"), F.grouping("p_brand").cast("long").alias("no_brand"), F.grouping("p_size").cast("long").alias("no_size"))


@query("SELECT event_type, count(*) AS n, round(avg(n), 6) AS a FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1")
def a29_theme_breadth(spark: SparkSession, d: str) -> DataFrame:
    """Distinct names a theme reaches and its mean volume in them."""
    return prices(spark, d).groupBy("event_type", "symbol").agg(F.count("*").alias("v")).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("a"))
