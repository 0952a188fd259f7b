"""Quotes in texts, neighbours within groups, persistence of correlations, exposure by blocks and the fact export."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import blocks as B
from tidemark.operators import exposure as X
from tidemark.operators import gates
from tidemark.operators import graph as G
from tidemark.operators import neighbours as K
from tidemark.operators import persistence as P
from tidemark.operators import spectral
from tidemark.sources import files


def test_every_quote_is_found(spark):
    """Quotes with and without inner words, of all lengths, against all texts."""
    rng = random.Random(4)
    words = ["a", "ab", "abc", "bc", "cab", "x.", "é"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))).replace(" x. ", "\n")) for i in range(80)] + [(90, None), (91, "")]
    cut = []
    for i in range(60):
        t = texts[rng.randrange(80)][1]
        a = rng.randrange(len(t) + 1)
        cut.append((i, t[a : a + rng.randint(0, 14)]))
    quotes = cut + [(70, "ab  bc"), (71, "zz zz zz"), (72, None), (73, ""), (74, "b"), (75, "ab c")]
    df = lambda rows, names: spark.createDataFrame(rows, names)
    got = gates.contains_quote(df(texts, "t int, low string"), df(quotes, "q int, said string"), "t", "low", "q", "said").collect()
    want = {(i, j) for i, t in texts for j, s in quotes if t is not None and s is not None and s in t}
    assert {(r.t, r.q) for r in got} == want and len(got) == len(want)
    none = gates.contains_quote(df(texts, "t int, low string"), df([(1, "ab abc bc")], "q int, said string").limit(0), "t", "low", "q", "said")
    assert none.collect() == []


@pytest.mark.parametrize("rows", [8192, 7])
@pytest.mark.parametrize("earlier", [False, True])
def test_neighbours_within_groups(spark, monkeypatch, rows, earlier):
    monkeypatch.setattr(K, "ROWS", rows)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((90, 5)).round(1)
    group = [None if i % 13 == 0 else f"g{i % 4 if i % 3 else 0}" for i in range(90)]
    df = spark.createDataFrame([(i, g, v.tolist()) for i, (g, v) in enumerate(zip(group, x, strict=True))], "id long, grp string, v array<double>")
    got = K.within(df, df, 3, "grp", earlier, "id", "v", "id", "v").collect()
    want = set()
    for i in range(90):
        near = [j for j in range(90) if group[i] is not None and group[j] == group[i] and (j < i or not earlier)]
        near.sort(key=lambda j: (-round(float(x[i] @ x[j]), 9), j))
        want |= {(i, j, r) for r, j in enumerate(near[:3], 1)}
    assert {(r.query, r.item, r["rank"]) for r in got} == want


def series(rng, n, days):
    x = rng.standard_normal((n, days)) + 1.5 * rng.standard_normal((1, days))
    x[rng.random(x.shape) < 0.1] = np.nan
    return [[None if np.isnan(v) else float(v) for v in row] for row in x]


def corr(a, b, least):
    both = [(p, q) for p, q in zip(a, b, strict=True) if p is not None and q is not None]
    return float(np.corrcoef(np.array(both).T)[0, 1]) if len(both) >= least else None


@pytest.mark.parametrize("rows", [1500, 4])
def test_persistence_over_all_pairs(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "ROWS", rows)
    rng = np.random.default_rng(9)
    made = [(w, n, x, y) for w in (1, 2) for n, (x, y) in enumerate(zip(series(rng, 11, 20), series(rng, 11, 12), strict=True))]
    made.append((1, 50, [1.0] * 20, [1.0] * 12))
    links = {(w, a, b) for w in (1, 2) for a in range(11) for b in range(a + 1, 11) if rng.random() < 0.2} | {(1, 0, 50), (2, 3, 99)}
    df = spark.createDataFrame(made, "window int, name long, x array<double>, y array<double>")
    linked = spark.createDataFrame(sorted(links) * 2, "window int, a long, b long")
    got = {r.linked: r for r in P.persistence(df, linked, 0.3, (15, 8)).collect()}
    want = {0: [], 1: []}
    for w, a, xa, ya in made:
        for v, b, xb, yb in made:
            if w == v and a < b and 50 not in (a, b):
                p, q = corr(xa, xb, 15), corr(ya, yb, 8)
                if p is not None and q is not None and p > 0.3:
                    want[int((w, a, b) in links)].append((p, q))
    for k, pairs in want.items():
        assert got[k].n == len(pairs) > 3 and got[k].kept == pytest.approx(np.mean([q >= p for p, q in pairs]))
        assert (got[k].before, got[k].after) == (pytest.approx(np.mean([p for p, _ in pairs])), pytest.approx(np.mean([q for _, q in pairs])))
    assert P.persistence(df.limit(0), linked).collect() == []


@pytest.mark.parametrize("rows", [2000, 5])
def test_exposure_by_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(X, "ROWS", rows)
    rng = np.random.default_rng(10)
    firms = [(i, rng.standard_normal(4).tolist(), s) for i, s in enumerate(series(rng, 17, 18))]
    events = [(f"e{i}", rng.standard_normal(4).tolist(), s, sorted(rng.choice(17, 3, False).tolist())) for i, s in enumerate(series(rng, 8, 18))]
    f = spark.createDataFrame(firms, "firm long, vector array<double>, series array<double>")
    e = spark.createDataFrame(events, "event string, vector array<double>, basket array<double>, names array<long>")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    want, pooled = set(), []
    for name, v, basket, named in events:
        rows_ = [(float(unit(v) @ unit(w)), firm, corr(basket, s, 15)) for firm, w, s in firms]
        for place, (x, firm, r) in enumerate(sorted(rows_, key=lambda t: (-round(t[0], 9), t[1]))[:6], 1):
            want.add((name, firm, place, round(x, 6), None if r is None else round(r, 6), int(firm in named)))
        pooled += [(x, r) for x, firm, r in rows_ if firm not in named and r is not None]
    got = X.landscape(e, f, 6).collect()
    assert {(r.event, r.firm, r["rank"], round(r.exposure, 6), None if r.realised is None else round(r.realised, 6), r.named) for r in got} == want
    s = X.validation(e, f).first()
    r = float(np.corrcoef(np.array(pooled).T)[0, 1])
    assert s.n == len(pooled) and s.r == pytest.approx(r) and s.t == pytest.approx(r * ((s.n - 2) / (1 - r * r)) ** 0.5)
    assert X.landscape(e.limit(0), f).collect() == [] and X.validation(e, f.limit(0)).first().n == 0


def test_fact_export_of_odd_rows(spark, tmp_path):
    kinds = "fact_id long, doc_id long, published string, claim string, predicate string, direction string, confidence double, magnitude string, source_name string, desk string, entities array<string>, cause_entities array<string>"
    rows = [
        (1, 7, "2024-03-01T10:00:00Z", "x" * 300, None, "UP", 0.5, "about 1,250.5", None, None, [" Brent ", "OIL", "oil", "", None], None),
        (2, 7, "2024-03-02", "c", "cuts", "down", None, "25 bps", "s", "fx", [], ["Fed"]),
        (3, 8, None, "c", "p", None, 1.0, None, "s", "d", None, []),
        (4, 8, "soon", "  ", "p", "up", 1.0, "1", "s", "d", None, None),
        (5, 8, "soon", None, "p", "up", 1.0, "1", "s", "d", None, None),
    ]
    path = str(tmp_path / "export")
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "fact_id long, embedding array<double>")
    files.export_facts(spark.createDataFrame(rows, kinds), vectors, path, {"Brent": "oil"})
    schema = "fact_id long, published_epoch long, date string, claim string, predicate string, direction double, confidence double, magnitude double, source_name string, desk string, entities array<string>, cause_entities array<string>"
    got = {r.fact_id: r for r in files.json_lines(spark, f"{path}/facts", schema).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1].published_epoch, len(got[1].claim), got[1].predicate, got[1].direction, got[1].magnitude, got[1].entities, got[1].desk) == (1709287200, 240, "other", 1.0, 1250.5, ["oil"], "other")
    assert (got[2].published_epoch, got[2].magnitude, got[2].cause_entities, got[2].confidence) == (1709337600, 0.25, ["fed"], 0.0)
    assert (got[3].published_epoch, got[3].magnitude, got[3].entities, got[3].direction) == (0, None, [], 0.0)
    assert {r.fact_id: r.vector for r in spark.read.parquet(f"{path}/vectors").collect()} == {1: [0.6, 0.8], 3: [0.0, 0.0]}


def test_feed_reads_first_parts_only(spark, tmp_path):
    path = str(tmp_path / "feed")
    df = spark.range(40).select("id", (F.col("id") % 2).cast("int").alias("part"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 5).cast("int")).alias("dt"))
    df.repartitionById(2, F.col("part")).select("id", "dt").write.partitionBy("dt").parquet(path)
    got = files.first_parts(spark, path, "id long").collect()
    assert sorted(r.id for r in got) == list(range(0, 40, 2)) and len({r.dt for r in got}) == 5


def test_feed_parts_of_a_day_are_tasks_of_their_own(spark, tmp_path, monkeypatch):
    """No task takes a third of the corpus, and a day without a first part gives nothing."""
    from tidemark.plans import landing

    df = spark.range(2000).where("id % 28 <> 5 OR id % 3 <> 0").select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("t").alias("text"))
    monkeypatch.setattr(landing, "table", lambda *_: df)
    monkeypatch.setattr(landing, "_work", lambda _: str(tmp_path))
    got = landing.s07_first_parts(spark, "").collect()
    assert sorted(r.doc_id for r in got) == [i for i in range(0, 2000, 3) if i % 28 != 5]
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "feed")).groupBy(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1)).count().collect()]
    assert max(sizes) <= 2000 // 84 + 1
    bare = files.first_parts(spark, str(tmp_path / "feed"), "doc_id long", 1000)
    assert {r.doc_id % 28 for r in bare.collect()} == {0}


def test_pairs_are_weighed_where_their_documents_meet(spark, monkeypatch):
    """Documents of several names, in slices, against plain Python; pairs are not shuffled."""
    monkeypatch.setattr(G, "MET", 2)
    rng = random.Random(8)
    at = {i: rng.randrange(12) for i in range(40)}
    ents = {i: set(rng.sample("abcdefgh", rng.randint(0, 4))) for i in at}
    causes = {i: set(rng.sample("abcdefghz", rng.randint(0, 4))) for i in at}
    rows = lambda of: spark.createDataFrame([(i, e) for i in of for e in sorted(of[i])], "doc long, entity string")
    got = G.pair_mining(spark.createDataFrame(list(at.items()), "doc long, at int"), rows(ents), rows(causes), 0.25)
    plan = got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    df = {e: sum(e in s for s in ents.values()) for e in "abcdefgh"}
    rare = {e for e in df if df[e] <= math.ceil(0.25 * 40)}
    want = {(a, b): sum(math.log(40 / df[e]) for e in ents[a] & causes[b]) for a in at for b in at if at[a] < at[b] and ents[a] & causes[b] & rare}
    assert rare and len(rare) < 8 and len(found) == len(want) and all(abs(r.weight - want[r.a, r.b]) < 1e-9 for r in found)
    assert "hashpartitioning(a#" not in plan.replace(" ", "")


def test_sitemaps_through_indexes(spark):
    import gzip

    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    index = lambda *locs: f"<sitemapindex {ns}>{''.join(f'<sitemap><loc> {u} </loc></sitemap>' for u in locs)}</sitemapindex>".encode()
    news = f'<urlset {ns} xmlns:n="urn:news"><url><loc>p1&amp;x</loc><lastmod>2024-01-01</lastmod><n:news><n:publication_date>2024-02-01T05:00:00Z</n:publication_date></n:news></url><url><lastmod>2024-01-01</lastmod></url></urlset>'
    plain = f"<urlset {ns}><url><loc>p2</loc><lastmod>2023-01-01</lastmod></url><url><loc>p3</loc><lastmod>soon</lastmod></url><url><loc>p4</loc></url></urlset>"
    rows = [("root", index("a", "b", "root")), ("a", gzip.compress(index("c", "b", "lost"))), ("b", gzip.compress(news.encode())), ("c", plain.encode()), ("alone", f"<urlset {ns}><url><loc>p9</loc></url></urlset>".encode()), ("bad", b"<urlset"), ("cut", gzip.compress(plain.encode())[:30]), ("none", None), ("html", b"<html><url><loc>x</loc></url></html>")]
    landed = spark.createDataFrame(rows, "url string, body binary")
    entries = files.sitemap_entries(landed)
    seeds = spark.createDataFrame([("root",), ("bad",), ("cut",), ("none",), ("html",), ("nowhere",)], "sitemap string")
    got = {r.loc: r.changed and r.changed.isoformat() for r in files.discover(entries, seeds).collect()}
    assert got == {"p1&x": "2024-02-01T05:00:00", "p2": "2023-01-01T00:00:00", "p3": None, "p4": None}
    assert {r.loc for r in files.discover(entries, seeds, "2024-01-15").collect()} == {"p1&x", "p3", "p4"}
    assert files.discover(entries, seeds.limit(0)).collect() == [] and files.discover(files.sitemap_entries(landed.limit(0)), seeds).collect() == []


@pytest.mark.parametrize("rows", [1500, 4])
def test_persistence_by_member(spark, monkeypatch, rows):
    """Links by shared drivers give what the linked pairs themselves give."""
    monkeypatch.setattr(P, "ROWS", rows)
    rng = np.random.default_rng(12)
    made = [(w, n, x, y) for w in (1, 2) for n, (x, y) in enumerate(zip(series(rng, 13, 20), series(rng, 13, 12), strict=True))]
    told = [(w, f"d{d}", int(n)) for w in (1, 2) for d in range(4) for n in rng.choice(15, 5, False)]
    df = spark.createDataFrame(made, "window int, name long, x array<double>, y array<double>")
    members = spark.createDataFrame(told * 2, "window int, driver string, name long")
    pairs = [(w, a, b) for w, d, a in told for v, e, b in told if (w, d) == (v, e) and a < b]
    want = {r.linked: r for r in P.persistence(df, spark.createDataFrame(pairs, "window int, a long, b long")).collect()}
    found = P.by_member(df, members)
    got = {r.linked: r for r in found.collect()}
    assert set(got) == set(want) == {0, 1} and all(got[k].n == want[k].n > 3 for k in want)
    assert all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("kept", "before", "after"))


def test_pairs_by_blocks(spark):
    """Sparse rows in blocks of three, keys in slices of two: products and shared keys of every pair."""
    rng = np.random.default_rng(5)
    vectors = [{str(k): float(rng.integers(1, 9)) for k in rng.choice(7, 1 + i % 3, False)} for i in range(11)]
    df = spark.createDataFrame([(i, list(v.items())) for i, v in enumerate(vectors)], "id long, u array<struct<k:string,w:double>>")

    def of_block(a, b):
        product, shared = B.sparse(a, b, "u", "k", "w", width=2)
        return shared > 0, {"p": product, "s": (shared, shared == 1)}

    got = {(r.a, r.b): (r.p, r.s) for r in B.pairs(df, "id", {"p": "double", "s": "float"}, of_block, 3).collect()}
    want = {}
    for a in range(11):
        for b in range(a + 1, 11):
            both = vectors[a].keys() & vectors[b].keys()
            if both:
                want[a, b] = (sum(vectors[a][k] * vectors[b][k] for k in both), None if len(both) == 1 else len(both))
    assert got == want


@pytest.mark.parametrize("name", ["g21_bridges", "g22_profile_cosine", "g23_bound_sets", "g24_emerging_pairs", "n19_persistence"])
def test_pair_queries_meet_in_blocks(spark, name):
    from tidemark import registry

    registry.load()
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_pair_correlation_without_variation(spark, monkeypatch):
    """A pair that does not vary is NaN, one that lacks times is left out; parts, salts and repeated pairs change nothing."""
    for k in ("NAMES", "PAIRS", "CHUNK"):
        monkeypatch.setattr(spectral, k, 2)
    x = {i: [(t, float((t * (i + 3)) % 11)) for t in range(12) if (t + i) % 6] for i in range(6)} | {7: [(t, 1.0) for t in range(12)], 8: [(0, 1.0)]}
    panel = spark.createDataFrame([(i, t, v) for i, rows in x.items() for t, v in rows], "name long, at int, v double")
    pairs = [(k, a, b) for k in "pq" for a in x for b in (*x, 99) if a < b]
    found = spectral.paired(spark.createDataFrame(pairs, "d string, a long, b long"), panel, "name", "at", "v", 8).collect()
    got = {(r.d, r.a, r.b): (r.n, r["corr"]) for r in found}
    assert len(got) == len(found) == 2 * 21
    for (_, a, b), (n, c) in got.items():
        both = [(dict(x[a])[t], dict(x[b])[t]) for t in dict(x[a]) if t in dict(x[b])]
        assert n == len(both) and (np.isnan(c) if b == 7 else c == pytest.approx(np.corrcoef(np.array(both).T)[0, 1]))


@pytest.mark.parametrize("name", ["w04_three_rankings", "j13_cooccurrence"])
def test_partitions_follow_the_rows_of_the_table(spark, monkeypatch, name):
    """A larger table comes in more partitions, not in larger ones, and the rows are the same."""
    from tidemark import registry
    from tidemark.operators import order

    registry.load()
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/lineitem.parquet").count()
    whole = sorted(map(tuple, registry.QUERIES[name](spark, d).collect()))
    monkeypatch.setattr(order, "SMALL", 100)
    monkeypatch.setattr(order, "DEALT", 500)
    found = registry.QUERIES[name](spark, d)
    assert sorted(map(tuple, found.collect())) == whole
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning({'l_orderkey' if name[0] == 'w' else 'fact'}" in plan and f", {-(-rows // 500)}), REPARTITION_BY_NUM" in plan


def test_pairs_in_tiles_with_equal_values_together(spark):
    """Squares of two rows give what whole blocks give; a block puts equal values beside each other, in batches."""
    df = spark.createDataFrame([(i, [float(i % 4)]) for i in range(23)], "id long, x array<double>")

    def of_block(a, b):
        x, y = B.matrix(a["x"])[:, 0], B.matrix(b["x"])[:, 0]
        s = x[:, None] + y[None, :]
        return s != 1, {"s": s, "n": (s, s == 2)}

    values = {"s": "double", "n": "double"}
    want = sorted((a, b, float(a % 4 + b % 4), None if a % 4 + b % 4 == 2 else float(a % 4 + b % 4)) for a in range(23) for b in range(a + 1, 23) if a % 4 + b % 4 != 1)
    for rows in (5, 50):
        found = [tuple(r) for r in B.pairs(df, "id", values, of_block, rows, 2, "s").coalesce(1).collect()]
        assert sorted(found, key=repr) == sorted(want, key=repr)
    runs = 1 + sum(x[2] != y[2] for x, y in zip(found, found[1:], strict=False))
    assert runs == len({r[2] for r in want})
    v = np.array([0.25, -1.5, 0.25, 7.0, -1.5, 0.25, np.nan])
    place = B.together(v)
    assert sorted(place) == list(range(7)) and 1 + sum(x != y for x, y in zip(v[place], v[place][1:], strict=False) if x == x and y == y) == 3


def test_persistence_sends_a_name_a_bounded_number_of_times(spark, monkeypatch):
    """Parts stay at three as names grow, tiles change nothing, names without enough days are not sent, and names of the same days are kept."""
    for k, v in {"ROWS": 2, "PARTS": 3, "TILE": 2}.items():
        monkeypatch.setattr(P, k, v)
    rng = np.random.default_rng(14)
    made = [(1, n, x, y) for n, (x, y) in enumerate(zip(series(rng, 17, 20), series(rng, 17, 12), strict=True))]
    made += [(1, 100 + n, x, y) for _, n, x, y in made] + [(2, n, x, [None] * 12) for _, n, x, _ in made] + [(1, 60, [1.0] * 20, [2.0] * 12)]
    df = spark.createDataFrame(made, "window int, name long, x array<double>, y array<double>")
    told = [(1, d, n) for n in range(17) for d in (f"d{n % 3}",)] + [(1, "twin", n) for n in (0, 100, 60)]
    sent = []
    meet = B.meet
    monkeypatch.setattr(P.B, "meet", lambda rows, *rest: (sent.append(rows), meet(rows, *rest))[1])
    got = {r.linked: r for r in P.by_member(df, spark.createDataFrame(told, "window int, driver string, name long")).collect()}
    assert {(r.window, r.parts) for r in sent[0].collect()} == {(1, 3)} and all(r.name != 60 or r.window == 1 for r in sent[0].collect())
    own = {n: {d for _, d, k in told if k == n} for n in range(200)}
    want = {0: [], 1: []}
    for v, a, xa, ya in made:
        for w, b, xb, yb in made:
            if v == w == 1 and a < b and 60 not in (a, b):
                p, q = corr(xa, xb, 15), corr(ya, yb, 8)
                if p is not None and q is not None and p > 0.3:
                    # Equal days correlate by one before and after, whatever is left of digits.
                    want[int(bool(own[a] & own[b]))].append((p, q, b == a + 100 or q >= p))
    for k, pairs in want.items():
        assert got[k].n == len(pairs) > 3 and got[k].kept == pytest.approx(np.mean([h for *_, h in pairs]))
        assert (got[k].before, got[k].after) == (pytest.approx(np.mean([p for p, *_ in pairs])), pytest.approx(np.mean([q for _, q, _ in pairs])))


def test_bridges_of_parts_without_common_neighbours_do_not_meet(spark, tmp_path, monkeypatch):
    """Three groups of suppliers that share no order: only parts with a common neighbour meet, and the bridges are those of plain sets."""
    from tidemark.plans import evidence

    rng = np.random.default_rng(15)
    rows = [(o, 100 * (o % 3) + int(s)) for o in range(90) for s in rng.choice(10, 1 + o % 4, False)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(o,) for o in range(80)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    near = {}
    for o, s in rows:
        for p, t in rows:
            if o == p < 80 and s != t:
                near.setdefault(s, set()).add(t)
    most = np.percentile([len(v) for v in near.values()], 98)
    kept = {n: {m for m in v if len(near[m]) <= most} for n, v in near.items()}
    want = {(a, b, len(kept[a] & kept[b])) for a in near for b in near if a < b and kept[a] & kept[b]}
    met, saved = [], evidence.G.saved
    monkeypatch.setattr(evidence.G, "saved", lambda df: (lambda s: (met.append(s) if df.columns == ["_i", "_j"] else None, s)[1])(saved(df)))
    for size in (5, 3000):
        monkeypatch.setattr(evidence, "BRIDGED", size)
        assert {tuple(r) for r in evidence.g21_bridges(spark, str(tmp_path)).collect()} == want and len(want) > 50
    assert {tuple(r) for r in met[0].collect()} == {(i, j) for i in range(6) for j in range(i, 6) if i // 2 == j // 2}
    assert [tuple(r) for r in met[1].collect()] == [(0, 0)]
