"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import temporal as X
from tidemark.operators.order import dealt
from tidemark.plans.windows import BARS, prices, returns
from tidemark.registry import query, table


@query("SELECT o_orderkey, c_name, round(o_totalprice, 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_equi_join(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", F.round("o_totalprice", 2).alias("total"))


@query("SELECT c_custkey, coalesce(o_orderstatus, '?') AS status, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j02_left_provenance(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    rows = c.join(o, c.c_custkey == o.o_custkey, "left")
    return rows.groupBy("c_custkey", F.coalesce("o_orderstatus", F.lit("?")).alias("status")).agg(F.count("o_orderkey").alias("n"))


@query("""WITH a AS (SELECT n_regionkey AS k, avg(c_acctbal) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey),
b AS (SELECT n_regionkey AS k, avg(s_acctbal) AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_regionkey)
SELECT a.k, round(p, 4) AS narrative, round(q, 4) AS implied, round(p - q, 4) AS divergence FROM a LEFT JOIN b ON a.k = b.k""")
def j03_fan_out_divergence(spark: SparkSession, d: str) -> DataFrame:
    """Joined on the proposition alone: every pair of readings of one key, on purpose."""
    n = table(spark, d, "nation")
    side = lambda t, key, value, out: t.join(n, F.col(key) == n.n_nationkey).groupBy("n_nationkey", F.col("n_regionkey").alias("k")).agg(F.avg(value).alias(out)).drop("n_nationkey")
    a, b = side(table(spark, d, "customer"), "c_nationkey", "c_acctbal", "p"), side(table(spark, d, "supplier"), "s_nationkey", "s_acctbal", "q")
    return a.join(b, "k", "left").select("k", F.round("p", 4).alias("narrative"), F.round("q", 4).alias("implied"), F.round(F.col("p") - F.col("q"), 4).alias("divergence"))


@query("""WITH p AS (SELECT a.event_id AS id, b.event_id AS other, abs(date_diff('hour', a.ts, b.ts)) AS hours, abs(epoch_us(a.ts) - epoch_us(b.ts)) AS gap
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'purchase' AND b.event_type = 'signup' AND abs(date_diff('hour', a.ts, b.ts)) <= 36)
SELECT id, other, hours FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY gap, other) = 1""")
def j04_nearest_within_36h(spark: SparkSession, d: str) -> DataFrame:
    """Nearest release of the same series within 36 hour boundaries of each event."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    a = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("t"))
    b = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("u"))
    near = X.near_in_time(a, b, ["user_id"], "t", "u", 37 * 3600)
    near = near.withColumn("hours", F.abs(X.hour_boundaries(F.col("t"), F.col("u")))).where("hours <= 36")
    gap = F.abs(F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("u").cast("timestamp")))
    return X.first_per_key(near, ["id"], [gap, F.col("other")]).select("id", "other", "hours")


@query("""WITH m AS (SELECT p_brand, p_type AS target FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1)
SELECT s_suppkey, coalesce(target, 'Brand#' || (10 + s_suppkey % 50)) AS series FROM supplier LEFT JOIN m ON m.p_brand = 'Brand#' || (10 + s_suppkey % 50)""")
def j05_alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    slugs = table(spark, d, "supplier").withColumn("slug", F.concat(F.lit("Brand#"), 10 + F.col("s_suppkey") % 50))
    order = [F.col("p_retailprice").desc(), F.col("p_partkey")]
    return X.resolve_alias(slugs, "slug", table(spark, d, "part"), "p_brand", "p_type", order, "series").select("s_suppkey", "series")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT a.event_id, arg_max(round(b.value, 6), (b.ts, b.event_id)) AS value FROM a JOIN b ON a.user_id = b.user_id AND b.ts < a.ts AND b.ts >= a.ts - INTERVAL 5 DAY GROUP BY 1""")
def j06_as_of_within_5_days(spark: SparkSession, d: str) -> DataFrame:
    """Latest strictly earlier surface, no older than five days."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("user_id", "event_id", "ts")
    b = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("bid"), F.round("value", 6).alias("v"))
    out = X.as_of(a, b, ["user_id"], "ts", "at", ["bid", "v"], strict=True)
    return out.where(F.col("at") >= F.col("ts") - F.expr("INTERVAL 5 DAYS")).select("event_id", F.col("v").alias("value"))


@query("""WITH c AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, o_orderkey, o_orderstatus FROM customer JOIN c ON c_custkey = o_custkey""")
def j07_newest_contract(spark: SparkSession, d: str) -> DataFrame:
    newest = X.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return table(spark, d, "customer").join(newest, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderstatus")


@query("""WITH k AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1996-01-01')
SELECT o_custkey, o_orderkey FROM k a WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.o_custkey = a.o_custkey AND (b.o_orderpriority < a.o_orderpriority OR (b.o_orderpriority = a.o_orderpriority AND b.o_orderdate > a.o_orderdate)))""")
def j08_belief_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Claims that nothing better was known by the moment; dominance as a rank, ties stay."""
    return X.belief_as_of(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderdate", F.lit("1996-01-01").cast("timestamp")).select("o_custkey", "o_orderkey")


TIERS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("SELECT o_orderkey, coalesce(r, 9) AS tier FROM orders LEFT JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3)) t(p, r) ON p = o_orderpriority")
def j09_tier_lookup(spark: SparkSession, d: str) -> DataFrame:
    tiers = spark.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])).alias("o_orderpriority", "r"))
    return table(spark, d, "orders").join(F.broadcast(tiers), "o_orderpriority", "left").select("o_orderkey", F.coalesce("r", F.lit(9)).alias("tier"))


@query("""WITH x AS (SELECT l_orderkey, l_shipdate, round(avg(l_extendedprice), 4) AS p FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS k FROM x)
SELECT f.l_orderkey, f.p AS front, n.p AS next FROM r f LEFT JOIN r n ON n.l_orderkey = f.l_orderkey AND n.k = 2 WHERE f.k = 1""")
def j10_front_and_next(spark: SparkSession, d: str) -> DataFrame:
    """First and second expiry of a day by one window, where a self join would read twice."""
    x = table(spark, d, "lineitem").groupBy("l_orderkey", "l_shipdate").agg(F.round(F.avg("l_extendedprice"), 4).alias("p"))
    w = W.partitionBy("l_orderkey").orderBy("l_shipdate")
    x = x.withColumn("k", F.row_number().over(w)).withColumn("next", F.lead("p").over(w))
    return x.where("k = 1").select("l_orderkey", F.col("p").alias("front"), "next")


@query("""WITH k AS (SELECT * FROM (VALUES (1, 'th'), (2, 'en'), (3, 'er')) t(rank, word)), h AS (SELECT item_id, word, rank FROM benchmark JOIN k ON contains(lower(text), word) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY rank) = 1)
SELECT item_id, word FROM h""")
def j11_keyword_instrument(spark: SparkSession, d: str) -> DataFrame:
    """First listed keyword that a text holds; the list is fixed, so it is an expression, not a theta join."""
    low = F.lower("text")
    first = F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in ("th", "en", "er")])
    return table(spark, d, "benchmark").select("item_id", first.alias("word")).where("word IS NOT NULL")


@query("""WITH a AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'error')
SELECT a.event_id, coalesce(max(CASE WHEN b.ts IS NULL THEN 0 WHEN (b.value > 50) = (a.value > 50) THEN 2 ELSE 1 END), 0)::INT AS state
FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 1 DAY AND a.ts + INTERVAL 1 DAY GROUP BY 1""")
def j12_event_study_state(spark: SparkSession, d: str) -> DataFrame:
    """2: an event within a day in the same direction, 1: one in another, 0: none."""
    e = table(spark, d, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    b = e.where("event_type = 'error'").select("user_id", F.col("ts").alias("u"), F.col("value").alias("v"))
    near = X.near_in_time(a, b, ["user_id"], "ts", "u", 86_401).where(F.abs(F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("u").cast("timestamp"))) <= 86_400_000_000)
    state = near.groupBy("event_id").agg(F.max(F.when((F.col("v") > 50) == (F.col("value") > 50), 2).otherwise(1)).alias("state"))
    return a.select("event_id").join(state, "event_id", "left").select("event_id", F.coalesce("state", F.lit(0)).alias("state"))


@query("SELECT doc_id, l.quality FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id) JOIN labels l USING (doc_id)")
def j18_metadata_hydrate(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels")
    docs = table(spark, d, "documents").select("doc_id").join(labels.where("toxic = 1"), "doc_id", "left_semi")
    return docs.join(labels, "doc_id").select("doc_id", "quality")


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j19_resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("""WITH s AS (SELECT DISTINCT o_orderdate::DATE AS day FROM orders), f AS (SELECT event_id, DATE '1995-01-01' + (event_id % 700)::INT + (hour(ts) >= 16)::INT AS day FROM events)
SELECT event_id, (SELECT min(s.day) FROM s WHERE s.day >= f.day) AS session FROM f""")
def j21_session_alignment(spark: SparkSession, d: str) -> DataFrame:
    """First session at or after the filing's date, one day later from 16:00 on."""
    s = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("session")).distinct().withColumn("all", F.lit(1))
    day = F.expr("date_add(DATE '1995-01-01', CAST(event_id % 700 AS INT) + CASE WHEN hour(ts) >= 16 THEN 1 ELSE 0 END)")
    f = table(spark, d, "events").select("event_id", day.alias("day"), F.lit(1).alias("all"))
    months = lambda c: F.trunc(c, "month")
    f = f.withColumn("month", F.explode(F.array(months(F.col("day")), F.add_months(months(F.col("day")), 1))))
    s = s.groupBy(months(F.col("session")).alias("month")).agg(F.sort_array(F.collect_list("session")).alias("sessions"))
    hit = f.join(s, "month").select("event_id", F.try_element_at(F.filter("sessions", lambda x: x >= F.col("day")), F.lit(1)).alias("session"))
    return f.select("event_id").distinct().join(hit.groupBy("event_id").agg(F.min("session").alias("session")), "event_id", "left")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT a.event_id, min(b.ts) AS next_ts FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts >= a.ts GROUP BY 1""")
def j22_forward_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    b = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("next_ts"), F.col("event_id").alias("other"))
    return X.as_of(a, b, ["user_id"], "ts", "next_ts", ["other"], forward=True).select("event_id", "next_ts")


@query("""WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'view')
SELECT a.event_id, arg_max(round(b.value, 6), (b.ts, b.event_id)) AS price FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1""")
def j23_backward_as_of(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    a = e.where("event_type = 'error'").select("user_id", "event_id", "ts")
    b = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("bid"), F.round("value", 6).alias("price"))
    return X.as_of(a, b, ["user_id"], "ts", "at", ["bid", "price"]).select("event_id", "price")


@query("""WITH e AS (SELECT DISTINCT l_orderkey AS driver, l_suppkey AS name FROM lineitem)
SELECT a.name AS a, b.name AS b, count(*) AS links FROM e a JOIN e b ON a.driver = b.driver AND a.name < b.name GROUP BY ALL""")
def j24_shared_driver_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of the names that one driver reaches, with the number of drivers."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("driver"), F.col("l_suppkey").alias("name")).distinct()
    b = e.select("driver", F.col("name").alias("b"))
    return e.withColumnRenamed("name", "a").join(b, "driver").where("a < b").groupBy("a", "b").agg(F.count("*").alias("links"))


@query("""WITH m AS (SELECT conv_id AS doc, role AS name FROM conversations UNION SELECT conv_id, 'turn' || least(turn, 3) FROM conversations)
SELECT a.name AS a, b.name AS b, count(DISTINCT a.doc) AS docs FROM m a JOIN m b ON a.doc = b.doc AND a.name < b.name GROUP BY ALL""")
def j25_doc_mention_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    m = c.select(F.col("conv_id").alias("doc"), F.col("role").alias("a")).union(c.select("conv_id", F.concat(F.lit("turn"), F.least("turn", F.lit(3))))).distinct()
    return m.join(m.select("doc", F.col("a").alias("b")), "doc").where("a < b").groupBy("a", "b").agg(F.countDistinct("doc").alias("docs"))


@query("""WITH q AS (SELECT l_suppkey AS k, year(l_shipdate) * 4 + quarter(l_shipdate) - 1 AS q, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.k, a.q::INT AS q, round(a.v - b.v, 4) AS surprise FROM q a JOIN q b ON a.k = b.k AND b.q = a.q - 4""")
def j26_year_ago_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Joined on the quarter number, so gaps don't shift it as a lag would."""
    l = table(spark, d, "lineitem")
    q = l.groupBy(F.col("l_suppkey").alias("k"), T.quarter_index(F.col("l_shipdate")).alias("q")).agg(F.sum("l_quantity").alias("v"))
    before = q.select("k", (F.col("q") + 4).alias("q"), F.col("v").alias("v0"))
    return q.join(before, ["k", "q"]).select("k", "q", F.round(F.col("v") - F.col("v0"), 4).alias("surprise"))


@query("""WITH a AS (SELECT c_custkey, lower(c_mktsegment) AS k, c_nationkey FROM customer), r AS (SELECT lower(r_name) AS k, r_regionkey FROM region),
n AS (SELECT lower(n_name) AS k, n_nationkey, n_regionkey FROM nation), u AS (SELECT n_regionkey AS rk, count(*) AS c FROM nation GROUP BY 1)
SELECT c_custkey, coalesce(r_regionkey, n_regionkey) AS found, r_regionkey IS NULL AS fallback FROM a LEFT JOIN r USING (k) LEFT JOIN n ON n.n_nationkey = a.c_nationkey""")
def j27_fallback_join(spark: SparkSession, d: str) -> DataFrame:
    """First by the normalised name, then by the key that is unique on both sides."""
    a = table(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("k"), F.col("c_nationkey").alias("n_nationkey"))
    r = table(spark, d, "region").select(F.lower("r_name").alias("k"), "r_regionkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    rows = a.join(r, "k", "left").join(n, "n_nationkey", "left")
    return rows.select("c_custkey", F.coalesce("r_regionkey", "n_regionkey").alias("found"), F.col("r_regionkey").isNull().alias("fallback"))


@query(f"""WITH {BARS}, dly AS (SELECT symbol, ts::DATE AS day, round(avg(close), 6) AS c FROM bars WHERE symbol < 4 GROUP BY ALL)
SELECT day, max(c) FILTER (symbol = 0) AS s0, max(c) FILTER (symbol = 1) AS s1, max(c) FILTER (symbol = 2) AS s2, max(c) FILTER (symbol = 3) AS s3 FROM dly GROUP BY day HAVING count(*) = 4""")
def j28_factor_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Days that all factors share, one column a factor; the factors are a fixed four, symbols 0 to 3."""
    p = prices(spark, d).where("symbol < 4").groupBy("symbol", F.to_date("ts").alias("day")).agg(F.round(F.avg("close"), 6).alias("c"))
    wide = p.groupBy("day").pivot("symbol", [0, 1, 2, 3]).agg(F.max("c"))
    return wide.select("day", *[F.col(str(i)).alias(f"s{i}") for i in range(4)]).dropna()


@query(f"""WITH {BARS}, m AS (SELECT symbol % 5 AS sector, symbol, month(ts) AS month, week(ts)::INT AS week, count(*) AS hits FROM rets WHERE abs(ret) > 5 GROUP BY ALL),
o AS (SELECT sector, week, count(DISTINCT symbol) AS firms, sum(hits)::BIGINT AS hits FROM m GROUP BY ALL HAVING count(DISTINCT symbol) >= 2)
SELECT sector, week, firms, hits FROM o QUALIFY row_number() OVER (PARTITION BY sector ORDER BY hits DESC, week) <= 4""")
def j30_sector_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Weeks whose catalysts hit at least two firms of a sector; the four largest a sector."""
    r = returns(spark, d).where("abs(ret) > 5")
    o = r.groupBy((F.col("symbol") % 5).alias("sector"), F.weekofyear("ts").alias("week")).agg(F.countDistinct("symbol").alias("firms"), F.count("*").alias("hits"))
    return X.first_per_key(o.where("firms >= 2"), ["sector"], [F.col("hits").desc(), F.col("week")], most=4)


@query("""SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS total FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1""")
def w05_current_belief(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").withColumn("back", -F.col("o_orderkey"))
    return X.current_belief(o, ["o_custkey"], "o_orderpriority", "o_orderdate", "o_orderkey", ["back"]).select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("total"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, lag(l_shipdate::DATE) OVER w AS before, row_number() OVER w AS k FROM lineitem WINDOW w AS (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber))
SELECT l_orderkey, l_linenumber, before, date_diff('day', before, day) AS shift_days FROM r WHERE k > 1 AND before IS DISTINCT FROM day""")
def w06_revisions(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    r = X.revisions(l, ["l_partkey"], "l_shipdate", "day", ["l_orderkey", "l_linenumber"])
    return r.select("l_orderkey", "l_linenumber", "before", F.col("shift_days").cast("long"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) = 1")
def w01_newest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return X.first_per_key(table(spark, d, "orders"), ["o_custkey"], [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS dist, abs(l_discount - 0.05) AS off, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate) AS expiry FROM lineitem)
SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY dist, l_linenumber) AS atm, rank() OVER (PARTITION BY l_orderkey ORDER BY round(off, 6), l_linenumber) AS wing, expiry FROM a""")
def w04_three_rankings(spark: SparkSession, d: str) -> DataFrame:
    l, k = table(spark, d, "lineitem"), W.partitionBy("l_orderkey")
    l = dealt(l.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_shipdate"), l.count(), "l_orderkey")
    rank = lambda *o: F.rank().over(k.orderBy(*o)).cast("long")
    return l.select(
        "l_orderkey", "l_linenumber", rank(F.abs(F.col("l_quantity") - 25), "l_linenumber").alias("atm"),
        rank(F.round(F.abs(F.col("l_discount") - 0.05), 6), "l_linenumber").alias("wing"), F.dense_rank().over(k.orderBy("l_shipdate")).cast("long").alias("expiry"),
    )


@query("""SELECT o_custkey, count(*) AS claims, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1""")
def a31_coverage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("claims"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@query("""SELECT a.event_id, b.o_orderkey FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error') a JOIN (SELECT o_custkey, o_orderkey, o_orderdate FROM orders) b
ON a.user_id = b.o_custkey AND b.o_orderdate <= TIMESTAMP '1994-06-01'""")
def j01_filtered_join(spark: SparkSession, d: str) -> DataFrame:
    """A condition on one side goes to its scan."""
    e = table(spark, d, "events").where("event_type = 'error'")
    o = table(spark, d, "orders").where("o_orderdate <= TIMESTAMP '1994-06-01'")
    return e.join(o, e.user_id == o.o_custkey).select("event_id", "o_orderkey")
