"""Small hand-written cases of what SQL on the given tables doesn't show."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import aggregates as A
from tidemark.operators import graph as G
from tidemark.operators import linear as L
from tidemark.operators import retrieval
from tidemark.operators import series as S
from tidemark.operators import stats as N
from tidemark.operators import temporal as X
from tidemark.operators.gates import direction_audit, real_article
from tidemark.sources import files
from tidemark.streaming import micro


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("r")).first().r


def test_canonical_url(spark):
    url = "https://WWW.Example.com/a/b/?utm_source=x&id=7&blank=#frag"
    assert one(spark, T.canonical_url(F.col("v")), url) == "https://www.example.com/a/b?id=7"
    assert one(spark, T.canonical_url(F.col("v")), "http://h.org") == "http://h.org/"


def test_day_ordinal(spark):
    assert one(spark, T.ordinal(F.col("v").cast("date")), "2026-06-30") == 739797


def test_dates_numbers_and_fees(spark):
    assert str(one(spark, T.day_month_year(F.col("v")), "31-Jul-2025")) == "2025-07-31"
    assert one(spark, T.day_month_year(F.col("v")), "soon") is None
    assert one(spark, T.number_in(F.col("v")), "up 1,250.5 points") == 1250.5
    assert one(spark, T.number_in(F.col("v")), "cut by 25 bps") == 0.25
    assert one(spark, T.number_in(F.col("v")), "nothing") is None
    assert one(spark, T.market_fee(F.lit(0.5))) == 0.02


def test_article_gate(spark):
    body = " ".join(["This sentence has surely more than eight words in it."] * 15)
    title = F.lit("Oil rises after a quiet week in the Gulf region")
    assert one(spark, real_article(title, F.col("v"), F.lit("https://x.org/a")), body) is True
    assert one(spark, real_article(F.lit("Markets"), F.col("v"), F.lit("")), body) is False
    assert one(spark, real_article(F.lit("Natural Gas Data"), F.col("v"), F.lit("")), body) is False
    assert one(spark, real_article(title, F.col("v"), F.lit("")), "short") is False
    assert one(spark, real_article(title, F.col("v"), F.lit("https://h.com/list"), {"h.com": r"\.html$"}), body) is False


def test_direction_audit(spark):
    assert one(spark, direction_audit(F.lit("down"), F.col("v")), "shares jumped") == "conflict"
    assert one(spark, direction_audit(F.lit("up"), F.col("v")), "shares jumped") == "ok"
    assert one(spark, direction_audit(F.lit("up"), F.col("v")), "shares moved") == "unchecked"


CLAIMS = [
    ("a", 1, "2024-01-01", "2024-02-01", 1), ("a", 1, "2024-01-05", "2024-02-03", 2), ("a", 2, "2024-01-09", "2024-02-09", 3),
    ("b", 2, None, "2024-03-01", 4), ("b", 2, "2024-01-02", "2024-03-02", 5), ("b", 2, "2024-01-02", "2024-03-05", 6),
]


@pytest.fixture(scope="module")
def claims(spark):
    rows = [(k, t, datetime.fromisoformat(n) if n else None, datetime.fromisoformat(v), i) for k, t, n, v, i in CLAIMS]
    return spark.createDataFrame(rows, "occ string, tier int, knowable timestamp, value timestamp, id int")


def test_current_belief(claims):
    got = {r.occ: r.id for r in X.current_belief(claims, ["occ"], "tier", "knowable", "id", ["id"]).collect()}
    assert got == {"a": 2, "b": 6}


def test_belief_as_of_keeps_ties_and_never_looks_ahead(claims):
    at = lambda day: sorted(r.id for r in X.belief_as_of(claims, ["occ"], "tier", "knowable", F.lit(day).cast("timestamp")).collect())
    assert at("2024-01-03") == [1, 5, 6]
    assert at("2024-01-06") == [2, 5, 6]
    assert at("2023-12-31") == []


def test_revisions(claims):
    got = {(r.id, r.shift_days) for r in X.revisions(claims, ["occ"], "knowable", "value", ["id"]).collect()}
    assert got == {(2, 2), (3, 6), (5, 1), (6, 3)}


def test_as_of_both_ways(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 1, "y"), (2, 5, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 2, 20), (1, 5, 50), (1, 9, 90), (2, None, 1)], "k int, u int, v int")
    get = lambda **o: {r.name: r.v for r in X.as_of(left, right, ["k"], "t", "u", ["v"], **o).collect()}
    assert get() == {"x": 50, "y": None, "z": None}
    assert get(strict=True) == {"x": 20, "y": None, "z": None}
    assert get(forward=True) == {"x": 50, "y": 20, "z": None}


def test_interval_join_at_its_edges(spark):
    ts = lambda s: datetime.fromisoformat(s)
    a = spark.createDataFrame([(1, ts("2024-01-02T12:00:00"))], "k int, t timestamp")
    b = spark.createDataFrame([(1, ts("2024-01-04T00:00:00"), 1), (1, ts("2024-01-04T00:00:01"), 2), (1, ts("2024-01-01T00:00:00"), 3)], "k int, u timestamp, id int")
    assert sorted(r.id for r in X.near_in_time(a, b, ["k"], "t", "u", 36 * 3600).collect()) == [1, 3]


@pytest.mark.parametrize(
    ("flags", "state"),
    [("0000111111", "PERSISTENT"), ("00001110001111111", "EMERGING"), ("00001111110000000", "ENDED"), ("0001111000111", "UNCONFIRMED"), ("1111111111", "PERSISTENT"), ("0000000000", "NEVER"), ("010", "INSUFFICIENT"), ("0101010101", "EPISODIC")],
)
def test_run_states(spark, flags, state):
    df = spark.createDataFrame([("p", i, c == "1") for i, c in enumerate(flags)], "k string, i int, on boolean")
    got = S.run_states(df, ["k"], ["i"], "on").first().state
    assert got == state


def test_zero_close_gives_no_return(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 0.0), ("a", 3, 4.0)], "k string, i int, c double")
    got = [r.r for r in df.withColumn("r", S.simple_return(F.col("c"), S.ordered(["k"], ["i"]))).orderBy("i").collect()]
    assert got == [None, -1.0, None]


def test_decomposition_adds_up(spark):
    rng = np.random.default_rng(1)
    rows = [(k, i, k % 2, float(x)) for k in range(6) for i, x in enumerate(rng.standard_normal(60))]
    p = S.decompose(spark.createDataFrame(rows, "k int, day int, sector int, ret double"), "k", "day", "sector", "ret", 20, 10, 10)
    assert p.agg(F.max(F.abs(F.col("market") + F.col("sector_part") + F.col("idio") - F.col("ret"))).alias("m")).first().m < 1e-9


def test_calibration_keeps_empty_bins(spark):
    df = spark.createDataFrame([(0.05, 0), (0.95, 1), (1.0, 1)], "p double, y int")
    got = {r.bin: r.n for r in A.calibration(df, "p", "y").collect()}
    assert got == {0: 1, 9: 2} | {i: 0 for i in range(1, 9)}


def test_cooccurrence_counts(spark):
    facts = [("f1", "oil"), ("f1", "hormuz"), ("f2", "oil"), ("f2", "hormuz"), ("f2", "lng"), ("f3", "oil")]
    got = {(r.a, r.b): r.weight for r in G.cooccurrence(spark.createDataFrame(facts, "f string, e string"), "f", "e").collect()}
    assert got == {("hormuz", "oil"): 2, ("lng", "oil"): 1, ("hormuz", "lng"): 1}


def test_page_rank_keeps_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("b", "a", 1)], "a string, b string, weight int")
    seeds = spark.createDataFrame([("a", 1.0), ("z", 1.0)], "node string, mass double")
    got = {r.node: r["rank"] for r in G.page_rank(edges, seeds, rounds=10).collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and set(got) == {"a", "b", "c", "z"}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in G.connected(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1), ("a", "x", 9)], "a string, b string, weight int")
    assert G.shortest_path(edges, "a", "d").first().path == ["a", "b", "c", "d"]
    assert G.shortest_path(edges, "a", "q").collect() == []


def test_chains(spark):
    edges = spark.createDataFrame([("war", "oil", "up", 2), ("oil", "fx", "down", 1), ("fx", "oil", "up", 1)], "cause string, subject string, direction string, sources long")
    got = {(r.n1, r.n2, r.n3): (r.way, r.support) for r in G.causal_chains(edges).collect()}
    assert got[("war", "oil", "fx")] == ("up/down", 3)
    assert ("oil", "fx", "oil") not in got


def test_ridge_recovers_a_map(spark):
    rng = np.random.default_rng(2)
    w, x = rng.standard_normal((4, 3)), rng.standard_normal((200, 4))
    df = spark.createDataFrame([(a.tolist(), (a @ w).tolist()) for a in x], "x array<double>, y array<double>")
    assert np.allclose(L.ridge(df, "x", "y", 1e-9), w, atol=1e-6)


def test_group_ols(spark):
    df = spark.createDataFrame([(g, float(i), 2.0 * i + g) for g in (1, 2) for i in range(8)], "g int, x double, y double")
    got = {r.g: r.coefficients for r in L.per_group_ols(df, "g", "y", ["x"]).collect()}
    assert np.allclose(got[1], [1, 2]) and np.allclose(got[2], [2, 2])


def test_auc_of_ties(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "y int, s double")
    assert N.auc(df, "y", "s").first().auc == 0.875


def test_bootstrap_is_repeatable(spark):
    df = spark.range(200).select((F.col("id") % 20).alias("c"), F.col("id").cast("double").alias("v"))
    a, b = (N.bootstrap_mean(df.repartition(n), ["c"], "v", 50).first() for n in (1, 3))
    assert abs(a.low - b.low) < 1e-9 and a.low < a.mean < a.high


def test_bad_json_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    assert sorted(r.id for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "id int").collect()) == [1, 2]


def test_partition_merge(spark, tmp_path):
    root = str(tmp_path / "t")
    old = spark.createDataFrame([(1, "old", "2024-01-01"), (2, "old", "2024-01-01"), (3, "old", "2024-01-02")], "id int, v string, dt string")
    files.merge_partitions(spark, root, old, ["id"])
    files.merge_partitions(spark, root, spark.createDataFrame([(2, "new", "2024-01-01"), (9, "new", "2024-01-03")], "id int, v string, dt string"), ["id"])
    got = sorted((r.id, r.v) for r in spark.read.parquet(root).collect())
    assert got == [(1, "old"), (2, "new"), (3, "old"), (9, "new")]


def test_calendar_file(spark, tmp_path):
    (tmp_path / "c.ics").write_text("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Rate\r\n  decision\r\nDTSTART;TZID=America/New_York:20240131T140000\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n")
    row = files.calendar_events(spark, str(tmp_path / "c.ics")).first()
    assert (row.uid, row.summary, row.starts) == ("1", "Rate decision", datetime(2024, 1, 31, 19))


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://x.org/a</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x.org/b</loc></url></urlset>")
    assert sorted(r["loc"] for r in files.sitemap(spark, str(tmp_path / "s.xml")).collect()) == ["https://x.org/a", "https://x.org/b"]


def test_option_rows(spark):
    body = json.dumps({"symbol": "S", "spot": 10.0, "expiry": "2024-06-01", "calls": [{"strike": 10.0, "impliedVolatility": 0.2}], "puts": []})
    assert [(r.side, r.strike) for r in files.option_rows(spark.createDataFrame([(body,)], "b string"), "b").collect()] == [("call", 10.0)]


def test_facts_are_exploded(spark):
    rows = spark.createDataFrame([("d", [("rose", "oil", None, None, "sideways", None, None, None, ["oil"], 0.5), (" ", None, None, None, "up", None, None, None, None, None)])], f"doc string, facts {files.FACT.simpleString()}")
    got = files.explode_facts(rows, "doc", "facts").collect()
    assert len(got) == 1 and got[0].direction == "na" and len(got[0].fact_id) == 20


def test_backoff(spark):
    ts = lambda s: datetime.fromisoformat(f"2024-01-01T00:00:{s:02d}")
    log = spark.createDataFrame([("u", "failed", ts(0), 1), ("r", "failed", ts(0), 1), ("r", "resolved", ts(5), 2)], "id string, status string, at timestamp, attempts int")
    state = micro.retry_state(log, "id", "at", "attempts", "status")
    at = lambda s: [r.id for r in micro.due(state, F.lit(datetime(2024, 1, 1, 0, s // 60, s % 60)), "status").collect()]
    assert at(30) == [] and at(61) == ["u"]


def test_stream_drops_repeats(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, datetime(2024, 1, 1, 0, 1)), (2, datetime(2024, 1, 1))], "id int, ts timestamp").write.parquet(src)
    stream = micro.deduplicated(spark.readStream.schema("id int, ts timestamp").parquet(src), ["id"], "ts", "10 minutes")
    stream.writeStream.format("memory").queryName("dedup_out").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("dedup_out").collect()) == [1, 2]


def test_entry_is_importable(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_shapley_parts_add_up(spark):
    from tidemark.operators import models

    rng = np.random.default_rng(3)
    x = rng.standard_normal((80, 3))
    y = x @ [1.0, 0.5, 0.0] + 0.1 * rng.standard_normal(80)
    df = spark.createDataFrame([(1, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)], "g int, a double, b double, c double, y double")
    row = models.shapley_parts(df, "g", "y", {"a": ["a"], "bc": ["b", "c"]}).first()
    assert abs(sum(row.parts) - row.r2) < 1e-9 and row.r2 > 0.9
    parts = models.sequential_parts(df, "g", "y", ["a", "b", "c"]).first()
    assert abs(sum(parts.parts) + parts.rest - 1) < 1e-9


def test_granger_finds_the_leader(spark):
    from tidemark.operators import models

    rng = np.random.default_rng(5)
    lead = rng.standard_normal(200)
    rows = [("yes", float(rng.standard_normal()), float(lead[i - 1]), float(lead[i - 1] + 0.1 * rng.standard_normal())) for i in range(1, 200)]
    rows += [("no", float(rng.standard_normal()), float(lead[i - 1]), float(rng.standard_normal())) for i in range(1, 200)]
    got = {r.g: r.f for r in models.granger(spark.createDataFrame(rows, "g string, own double, other double, y double"), "g", "y", ["own"], ["other"]).collect()}
    assert got["yes"] > 100 > got["no"]


def test_partial_least_squares_with_all_components_is_least_squares(spark):
    from tidemark.operators import models

    rng = np.random.default_rng(6)
    x = rng.standard_normal((100, 3))
    y = x @ [1.0, -2.0, 0.5]
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double")
    assert np.allclose(models.partial_least_squares(df, "x", "y", 3)[1], [1, -2, 0.5], atol=1e-8)


def test_page_metadata_reads_the_whole_page(spark, tmp_path):
    from tidemark import registry

    registry.load()
    page = "<!--" + "x" * 300_000 + '--><html lang="en"><title>Late</title>'
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in registry.QUERIES["t10_page_metadata"](spark, str(tmp_path)).collect()] == [(1, "en", "Late")]


def test_reference_sizes(spark):
    """400 bootstrap draws and 24 theme clusters."""
    from tidemark import registry

    registry.load()
    d = "/root/testdata/sf0.001"
    want = N.bootstrap_mean(spark.read.parquet(f"{d}/events.parquet"), ["event_id"], "value", 400).first()
    got = registry.QUERIES["n04_bootstrap_rows"](spark, d).first()
    assert [got[c] for c in ("low", "high", "se")] == pytest.approx([want[c] for c in ("low", "high", "se")])
    assert registry.QUERIES["v15_theme_clusters"](spark, d).count() == 24


def test_top_k_earlier_only(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 4))
    x[5] = x[2]
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(12) for j in sorted(range(i), key=lambda j: (-round(float(unit[i] @ unit[j]), 9), j))[:3]}
    assert {(r.query, r.vec_id) for r in retrieval.top_k(q, v, 3, earlier=True).collect()} == want


def test_correlation_without_variation(spark):
    """NaN, as in SQL, and no division by zero, also in frames that are left out."""
    df = spark.createDataFrame([("k", i, x, y) for i, (x, y) in enumerate([(1.5, 2.0), (1.5, 4.0), (2.5, 3.0), (None, 9.0)])] + [("n", 0, None, 1.0)], "g string, i int, x double, y double")
    w = S.ordered(["g"], ["i"])
    got = {(r.g, r.i): r.c for r in df.select("g", "i", S.rolling_corr(F.col("x"), F.col("y"), w, 4, 2).alias("c")).collect()}
    assert got[("k", 0)] is None and np.isnan(got[("k", 1)]) and got[("k", 2)] == pytest.approx(0.0, abs=1e-12) and got[("n", 0)] is None
    both = {r.g: r.c for r in df.groupBy("g").agg(S.corr(F.col("x"), F.col("y")).alias("c")).collect()}
    assert both["k"] == pytest.approx(0.0, abs=1e-12) and both["n"] is None


def test_sum_correlation_query_without_variation(spark, tmp_path):
    """Two equal values in a row are a frame without variation in w16 and w25."""
    from tidemark import registry

    registry.load()
    rows = [(10 * u + k, datetime(2024, 1, 1 + k), u, 5.0 if u and k < 3 else float(k * k + u)) for u in (0, 1) for k in range(8)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    for name, count in (("w16_rolling_pair_corr", 8), ("w25_corr_from_sums", 3)):
        assert len(registry.QUERIES[name](spark, str(tmp_path)).collect()) == count


def test_words_between_other_letters(spark):
    texts = ["\u00e9les\u00e9", "les", "the_", "\u0130the", "th\u00c9 the9", "\u0434\u0435\u0440 DER", "x the", "xthe"]
    assert [one(spark, T.ascii_words(T.plain_lower(F.col("v")), ["the", "les", "der"]), t) for t in texts] == [True, True, False, False, False, True, True, False]


def test_interval_join_counts_fractions_of_seconds(spark):
    ts = lambda s: datetime.fromisoformat(s)
    a = spark.createDataFrame([(1, ts("2024-01-02T12:00:00.2"))], "k int, t timestamp")
    b = spark.createDataFrame([(1, ts("2024-01-04T00:00:00.2"), 1), (1, ts("2024-01-04T00:00:00.9"), 2), (1, ts("2024-01-01T00:00:00.1"), 3), (1, ts("2024-01-01T00:00:00.2"), 4)], "k int, u timestamp, id int")
    assert sorted(r.id for r in X.near_in_time(a, b, ["k"], "t", "u", 36 * 3600).collect()) == [1, 4]


def test_page_rank_moves_edges_once(spark, monkeypatch):
    """Edges are saved once, by their end, and rounds join them by broadcast; beyond the bound the same ranks come from joins."""
    facts = spark.createDataFrame([(f, (f * f + 3 * i) % 11) for f in range(40) for i in range(1 + f % 4)], "fact long, entity long")
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0), (99, 1.0)], "node long, mass double")
    plain = {(r.a, r.b): r.weight for r in G.both_ways(G.cooccurrence(facts, "fact", "entity")).collect()}
    edges = G.shared(facts, "fact", "entity")
    assert {(r.a, r.b): r.w for r in edges.groupBy("a", "b").agg(F.sum("weight").alias("w")).collect()} == plain
    plans, saved = [], G.saved
    monkeypatch.setattr(G, "saved", lambda df: (plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())), saved(df))[1])
    want = {1: 0.2, 2: 0.6, 99: 0.2}
    p, rank = want, want
    nodes = {n for e in plain for n in e} | set(p)
    degree = {n: sum(w for (a, _), w in plain.items() if a == n) for n in nodes}
    for _ in range(6):
        idle = sum(r for n, r in rank.items() if not degree[n])
        rank = {n: 0.15 * p.get(n, 0) + 0.85 * (sum(rank.get(a, 0) * w / degree[a] for (a, b), w in plain.items() if b == n) + idle * p.get(n, 0)) for n in nodes}
    got = {r.node: r["rank"] for r in G.page_rank(edges, seeds, rounds=6).collect()}
    assert got == pytest.approx(rank) and abs(sum(got.values()) - 1) < 1e-9
    assert [c for c, _ in plans if "weight" in c] == [["b", "a", "weight"]] and "RepartitionByExpression [b" in plans[0][1]
    rounds = [q for c, q in plans if "r" in c]
    assert len(rounds) == 6 and all(q.count("strategy=broadcast") == 3 for q in rounds)
    monkeypatch.setattr(G, "NODES", 0)
    assert {r.node: r["rank"] for r in G.page_rank(edges, seeds, rounds=6).collect()} == pytest.approx(rank)
