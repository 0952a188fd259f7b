"""Fitted maps, margin refits, neighbours and walks against numpy."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import finder as H
from tidemark.operators import linear as L
from tidemark.operators import neighbours as K
from tidemark.operators import retrieval as R
from tidemark.operators import transport as M
from tidemark.plans import finder

registry.load()
SF = "/root/testdata/sf0.01"


def unit(m):
    return m / np.linalg.norm(m, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def made(spark):
    """Pairs of three groups with maps of their own, one group too small for a fit."""
    rng = np.random.default_rng(5)
    group = np.r_[np.zeros(60, int), np.ones(80, int), np.full(7, 2)]
    turn = [np.roll(np.eye(6), s, axis=1) for s in (1, 2, 3)]
    a = unit(rng.standard_normal((group.size, 6)))
    b = unit(np.array([x @ turn[g] for x, g in zip(a, group, strict=True)]) + 0.05 * rng.standard_normal(a.shape))
    df = spark.createDataFrame([(i, int(g), x.tolist(), y.tolist()) for i, (g, x, y) in enumerate(zip(group, a, b, strict=True))], "pair long, g int, a array<double>, b array<double>")
    return df.repartition(3), group, a, b


def ridge(a, b):
    return np.linalg.solve(a.T @ a + np.eye(a.shape[1]), a.T @ b)


def test_group_maps_equal_numpy(made, monkeypatch):
    monkeypatch.setattr(M, "HELD", 2)
    df, group, a, b = made
    got = {r.g: r for r in M.group_maps(df, "g", "a", "b", 1.0, 40).collect()}
    assert set(got) == {0, 1}
    for g, r in got.items():
        at = group == g
        assert r.n == at.sum() and np.allclose(np.array(r["map"]).reshape(6, 6), ridge(a[at], b[at]))


def test_directions_take_the_group_map_or_the_one_of_all(made, monkeypatch):
    monkeypatch.setattr(M, "PIECE", 10)
    df, group, a, b = made
    whole = L.ridge(df, "a", "b", 1.0)
    maps = M.group_maps(df, "g", "a", "b", 1.0, 40)
    got = sorted(M.directions(df, "pair", "a", "b", "g", maps, whole).collect())
    ahead = lambda w, x, y: int(unit(x[None] @ w)[0] @ y > unit(y[None] @ w)[0] @ x)
    own = {g: ridge(a[group == g], b[group == g]) for g in (0, 1)} | {2: whole}
    assert [tuple(r) for r in got] == [(i, int(g), ahead(whole, a[i], b[i]), ahead(own[g], a[i], b[i])) for i, g in enumerate(group)]
    s = M.mcnemar(M.directions(df, "pair", "a", "b", "g", maps, whole), "ahead", "own_ahead").first()
    one, other = np.array([r.ahead for r in got]), np.array([r.own_ahead for r in got])
    assert (s.n, s.one_only, s.other_only) == (len(got), ((one == 1) & (other == 0)).sum(), ((one == 0) & (other == 1)).sum())
    assert s.mean_other > 0.9 and s.chi2 == pytest.approx(max(abs(s.one_only - s.other_only) - 1, 0) ** 2 / max(s.one_only + s.other_only, 1))


def test_margin_refit_equals_numpy(made):
    """150 steps on the cluster and the same steps over whole matrices, block by block."""
    df, _, a, b = made
    start = L.ridge(df, "a", "b", 1.0)
    blocks = M.in_blocks(df, "pair", "a", "b", 40)
    parts = [(np.array(r.a).reshape(-1, 6), np.array(r.b).reshape(-1, 6)) for r in blocks.collect()]
    assert sum(len(x) for x, _ in parts) == len(a) and len(parts) > 2
    w = start.copy()
    for step in range(150):
        g = np.zeros_like(w)
        for x, y in parts:
            n = len(x)
            other = y[M.partner(n, step)]
            s = lambda u, v: ((u @ w) * v).sum(1)  # noqa: B023, E731
            wrong, turned = (0.1 - s(x, y) + s(x, other) > 0) * (n > 1), 0.1 - s(x, y) + s(y, x) > 0
            for i in range(n):
                g += wrong[i] * np.outer(x[i], other[i] - y[i]) + turned[i] * (np.outer(y[i], x[i]) - np.outer(x[i], y[i]))
        w = w - 0.5 / len(a) * g - 0.5 * 0.01 * w
    got = M.refine(blocks, start)
    assert np.allclose(got, w, atol=1e-9) and not np.allclose(got, start, atol=1e-2)


def test_partners_are_other_pairs_of_the_block():
    for n in (2, 3, 17):
        for step in range(30):
            p = M.partner(n, step)
            assert sorted(p) == list(range(n)) and (p != np.arange(n)).all()
    assert M.partner(1, 4).tolist() == [0]


def test_refit_of_no_pairs_and_of_one(spark):
    none = spark.createDataFrame([], "pair long, a array<double>, b array<double>")
    assert np.array_equal(M.refine(M.in_blocks(none, "pair", "a", "b"), np.eye(2), 3), np.eye(2))
    one = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "pair long, a array<double>, b array<double>")
    got = M.refine(M.in_blocks(one, "pair", "a", "b"), np.zeros((2, 2)), 1)
    assert np.allclose(got, [[0, 0.5], [-0.5, 0]])


@pytest.fixture(scope="module")
def vectors(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    rows = sorted(v.collect())
    return v, np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)


def nearest(x, ids, k, earlier):
    s = x @ x.T
    if earlier:
        s[ids[None, :] >= ids[:, None]] = -np.inf
    return {(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in np.lexsort((ids, -np.round(s[i], 9)))[:k] if np.isfinite(s[i, j])}


@pytest.mark.parametrize("rows", [8192, 60])
@pytest.mark.parametrize("earlier", [False, True])
def test_exact_neighbours(vectors, monkeypatch, rows, earlier):
    monkeypatch.setattr(K, "ROWS", rows)
    monkeypatch.setattr(K, "STEP", 50)
    v, ids, x = vectors
    got = K.exact(v, v, 5, earlier, "vec_id", "embedding", "vec_id", "embedding").collect()
    assert {(r.query, r.item) for r in got} == nearest(x, ids, 5, earlier)
    assert {r["rank"] for r in got} == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("rows", [8192, 25])
def test_cells_reach_the_recall(vectors, monkeypatch, rows):
    """All vectors, centres from the sample: at least nine in ten true neighbours; with all cells probed, all."""
    monkeypatch.setattr(K, "ROWS", rows)
    v, _, _ = vectors
    of = {"query": "vec_id", "q": "embedding", "item": "vec_id", "x": "embedding"}
    truth = K.exact(v, v, 5, True, **of)
    centre = K.centres(v, "vec_id", "embedding", 12)
    probes = K.probes_for(v, v, 5, centre, 0.92, earlier=True, **of)
    assert 1 <= probes <= 12
    found = K.by_cells(v, v, 5, centre, probes, True, **of)
    assert K.recall(found, truth) >= 0.9
    assert found.count() == found.select("query", "item").distinct().count()
    assert K.recall(K.by_cells(v, v, 5, centre, 99, True, **of), truth) == 1


def test_item_packs_go_once_to_a_district(vectors, monkeypatch):
    """Cells that share a district share their packs; who meets whom stays the same."""
    v, _, _ = vectors
    of = {"query": "vec_id", "q": "embedding", "item": "vec_id", "x": "embedding"}
    centre = K.centres(v, "vec_id", "embedding", 12)
    ranked, keys, found = K._ranked, [], []
    monkeypatch.setattr(K, "_ranked", lambda met, by, *rest: keys.append(by) or ranked(met, by, *rest))
    for n in (1, 3, 99):
        monkeypatch.setattr(K, "DISTRICTS", n)
        found.append({(r.query, r.item) for r in K.by_cells(v, v, 5, centre, 4, True, **of).collect()})
    assert keys[0][0] == "district" and found[0] == found[1] == found[2] != set()


def test_neighbours_of_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    of = {"query": "vec_id", "q": "embedding", "item": "vec_id", "x": "embedding"}
    assert K.exact(none, none, 5, **of).collect() == []
    centre = K.centres(none, "vec_id", "embedding", 4)
    assert K.by_cells(none, none, 5, centre, K.probes_for(none, none, 5, centre, **of), **of).collect() == []


def test_walk_equals_power_iteration(spark):
    rng = np.random.default_rng(2)
    n = 30
    p = np.zeros((n, n))
    for j in range(1, n):
        causes = rng.choice(j, min(j, 3), False)
        p[causes, j] = rng.dirichlet(np.ones(len(causes)))
    edges = spark.createDataFrame([(j, i, float(p[i, j])) for i in range(n) for j in range(n) if p[i, j]], "effect long, cause long, share double")
    seed = np.zeros((2, n))
    seed[0, [29, 20]], seed[1, [11]] = [0.75, 0.25], [1.0]
    seeds = spark.createDataFrame([(q, i, float(seed[q, i])) for q in range(2) for i in range(n) if seed[q, i]], "query long, node long, mass double")
    for rounds in (0, 1, 4):
        got = np.zeros((2, n))
        for r in H.walk(seeds, edges, 0.9, rounds).collect():
            got[r.query, r.node] = r.mass
        for q in range(2):
            s = seed[q]
            for _ in range(rounds):
                s = 0.9 * seed[q] + 0.1 * p @ s
            assert np.allclose(got[q], s)


@pytest.mark.parametrize("lead, seeds, idle", [(2000, 40, 0.6), (5, 3, 0.6), (5, 3, 1.0), (1, 1, 0.1)])
def test_best_sums_lose_no_document(spark, monkeypatch, lead, seeds, idle):
    """Common and rare terms, with ties: the same as scoring every document."""
    for name, value in (("LEAD", lead), ("SEEDS", seeds), ("IDLE", idle)):
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(11)
    share = np.r_[np.full(6, 0.8), np.full(10, 0.2), np.full(30, 0.02)]
    gain = {(t, d): float(np.round(rng.random() * (0.3 if t < 6 else 2.0), 2)) + 0.01 for t in range(46) for d in range(300) if rng.random() < share[t]}
    wanted = {q: set(rng.choice(46, 12, False).tolist()) for q in range(8)} | {8: {0, 1}, 9: {45}, 10: {99}}
    postings = spark.createDataFrame([(t, d, g) for (t, d), g in gain.items()], "term int, doc int, gain double")
    terms = spark.createDataFrame([(q, t) for q, ts in wanted.items() for t in ts] * 2, "query int, term int")
    for k in (1, 10):
        want = []
        for q, ts in wanted.items():
            score = {}
            for (t, d), g in gain.items():
                if t in ts:
                    score[d] = score.get(d, 0) + g
            want += [(q, d, round(s, 6), r) for r, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k], 1)]
        got = [(r["query"], r.doc, round(r.score, 6), r["rank"]) for r in R.best_sums(terms, postings, k).collect()]
        assert sorted(got) == sorted(want)


def test_cell_graph_is_close_to_the_exact_one(spark):
    exact = {(r.effect, r.cause) for r in registry.QUERIES["g12_cause_graph"](spark, SF).collect()}
    cells = {(r.effect, r.cause) for r in registry.QUERIES["g12_cell_graph"](spark, SF).collect()}
    assert len(exact & cells) >= 0.9 * len(exact)


def test_finder_modes(spark):
    """With three seeds the walk has to bring in what is no seed itself."""
    v = finder.both_forms(spark, SF)
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("e").alias("q"))
    rows = H.multi_hop(asked, v, finder.cause_graph(v), seeds=3).collect()
    assert {r.mode for r in rows} == set(H.MODES) and all(r.node < r.query for r in rows)
    of = lambda mode, query: {r.node: r for r in rows if r.mode == mode and r.query == query}
    for q in (100, 200, 300, 400):
        seeds, chain = of("onehop", q), of("chain", q)
        assert len(seeds) == 3 and len(chain) == 8 and all(r.via == "direct" for r in seeds.values())
        assert all((r.via == "chain") == (n not in seeds) for n, r in chain.items())
        assert [n for n, r in sorted(of("union", q).items(), key=lambda x: x[1]["rank"])][0] in seeds


def test_margin_refit_lowers_the_hinges_it_trains_on(spark):
    rows = {r.fit: r for r in registry.QUERIES["m02_margin_refit"](spark, SF).collect()}
    assert set(rows) == {"ridge", "margin"} and rows["ridge"].tests == rows["margin"].tests > 0


def test_channels_equal_numpy(spark):
    p = sorted(registry.QUERIES["m06_predicate_channels"](spark, SF).collect())
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    e, label = unit(np.array([r.embedding for r in rows], float)), np.array([r.label for r in rows])
    train = np.array([i for i in range(len(rows) - 1) if i % 5])
    assert p
    for r in p:
        at = train[label[train + 1] == r.predicate]
        assert len(at) == r.n and np.allclose(np.linalg.svd(ridge(e[at], e[at + 1]), compute_uv=False)[:3], r.singular)
    strongest = registry.QUERIES["m05_map_channels"](spark, SF).collect()
    every = np.linalg.svd(ridge(e[:-1], e[1:]))
    assert np.allclose([r.strength for r in strongest], every[1][:8])
    assert all(abs(np.dot(r.input, every[0][:, r.channel])) > 0.999 for r in strongest)

def test_nearest_of_many_queries_in_bounded_pieces():
    """Thousands of queries against a whole batch, in the memory of one piece; copies are decided by id."""
    rng = np.random.default_rng(3)
    m = rng.standard_normal((3000, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    x = rng.standard_normal((6000, 8))
    x[rng.random(6000) < 0.3] = x[0]
    qs, ids = np.arange(3000) * 2, rng.permutation(6000)
    batches = [(ids[i : i + 4000], pd.Series(list(x[i : i + 4000]))) for i in (0, 4000)]
    tracemalloc.start()
    row, got, score = R.nearest(iter(batches), qs, m, 5, earlier=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6  # One matrix of all scores takes 96 MB.
    s = m @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    for q in range(0, 3000, 97):
        near = sorted((-round(float(s[q, j]), 9), int(ids[j])) for j in range(6000) if ids[j] < qs[q])[:5]
        assert [(-round(float(v), 9), int(j)) for v, j in zip(score[row == q], got[row == q], strict=True)] == near
    assert all(len(p) == 0 for p in R.nearest(iter(batches), qs[:0], m[:0], 5))


def test_a_group_of_the_exact_search_holds_few_item_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "ROWS", 10)
    monkeypatch.setattr(K, "SLAB", 2)
    met, ranked = [], K._ranked
    monkeypatch.setattr(K, "_ranked", lambda rows, keys, *more: met.append(rows.groupBy(*keys).count().agg(F.max("count")).first()[0]) or ranked(rows, keys, *more))
    x = np.random.default_rng(4).standard_normal((90, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r.query, r.item, r["rank"]) for r in K.exact(df, df, 3, query="id", q="v", item="id", x="v").collect()}
    assert got == {(i, int(j), n) for i in range(90) for n, j in enumerate(np.argsort(-(x @ x[i]))[:3], 1)} and met == [2]
