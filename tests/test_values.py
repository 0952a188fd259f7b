"""Values of the queries that have no SQL, against numpy on whole tables."""

import numpy as np
import pytest

from tidemark import registry

registry.load()
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()


@pytest.fixture(scope="module")
def x(rows):
    return np.array([r.embedding for r in rows], float)


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: registry.QUERIES[name](spark, SF).collect()


def test_probe_weights(run, rows, x):
    y = np.array([2.0 * (r.label > 4) - 1 for r in rows])
    want = np.linalg.solve(x.T @ x + np.eye(x.shape[1]), x.T @ y)
    assert np.allclose([r.weight for r in sorted(run("m03_ridge_probe"))], want)


def test_lengths_without_the_gist(run, x):
    _, v = np.linalg.eigh(x.T @ x)
    top = v[:, ::-1][:, :3]
    want = np.linalg.norm(x - x @ top @ top.T, axis=1)
    assert np.allclose([r.length for r in sorted(run("m04_gist_removal"))], want)


def test_shares_of_components(run, x):
    c = x - x.mean(0)
    values = np.linalg.eigvalsh(c.T @ c)[::-1]
    assert np.allclose([r.share for r in sorted(run("m18_pca_share"))], values[:8] / values.sum())


def test_one_step_map(run, x):
    a, b = x[:-1], x[1:]
    _, v = np.linalg.eigh(a.T @ a)
    v = v[:, ::-1][:, :8]
    k = v @ np.linalg.lstsq(a @ v, b, rcond=None)[0]
    got = {r.name: r.value for r in run("m20_one_step_map")}
    assert got["map"] == pytest.approx(((b - a @ k) ** 2).sum()) and got["persistence"] == pytest.approx(((b - a) ** 2).sum())
    assert got["radius"] == pytest.approx(np.abs(np.linalg.eigvals(k)).max(), abs=1e-6) and got["map"] < got["persistence"]


def test_bootstraps(run, spark):
    """The mean is exact; the spread is that of resampled rows, days and users."""
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "ts", "value").toPandas()
    e["day"] = e["ts"].dt.date
    for name, cluster in (("n04_bootstrap_rows", "event_id"), ("n05_bootstrap_dates", "day"), ("n06_bootstrap_clusters", "user_id")):
        (r,) = run(name)
        g = e.groupby(cluster)["value"].agg(["sum", "count"])
        mean = g["sum"].sum() / g["count"].sum()
        error = np.sqrt(((g["sum"] - mean * g["count"]) ** 2).sum()) / g["count"].sum()
        assert r.mean == pytest.approx(mean) and r.clusters == len(g)
        assert 0.8 * error < r.se < 1.2 * error and r.low < mean < r.high
        assert (r.high - r.low) / (2 * 1.645 * error) == pytest.approx(1, abs=0.25)


def test_market_null(run, spark):
    from tidemark.plans.aggregates import quotes

    price = quotes(spark, SF).groupBy("event_type").avg("price").collect()
    want = {r[0]: r[1] for r in price}
    got = {r.event_type: r for r in run("n11_market_null")}
    assert set(got) == set(want)
    for k, r in got.items():
        assert r.low < r.mean < r.high and r.mean == pytest.approx(want[k], abs=0.01)


def test_marginal_relevance(run, x):
    """Greedy choice from each query's thirty nearest, by plain loops."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, len(x), 100):
        s = u @ u[q]
        pool = sorted(range(len(x)), key=lambda i: (-round(float(s[i]), 9), i))[:30]
        chosen = []
        while len(chosen) < 8:
            value = {i: round(0.7 * s[i] - 0.3 * max((u[i] @ u[j] for j in chosen), default=0.0), 12) for i in pool if i not in chosen}
            chosen.append(min(value, key=lambda i: (-value[i], -s[i], i)))
        want |= {(q, i, p) for p, i in enumerate(chosen, 1)}
    assert {(r["query"], r.vec_id, r.place) for r in run("o10_diversified")} == want


def test_theme_clusters_are_a_partition(run, rows):
    got = run("v15_theme_clusters")
    assert sum(r.n for r in got) == len(rows) and len(got) == 24
    assert all(r.weight == r.n * (1 + r.breadth) and 1 <= r.breadth <= 10 for r in got)


def test_factors_rebuild_the_table(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import models as M

    rng = np.random.default_rng(3)
    left, right = rng.random((30, 2)), rng.random((20, 2))
    table = 30 * left @ right.T
    df = spark.createDataFrame([(i, j, float(table[i, j])) for i in range(30) for j in range(20)], "r int, c int, v float")
    a, b = M.factorise(df, "r", "c", "v", 2)
    a = {r.id: np.array(r.features) for r in a.collect()}
    b = {r.id: np.array(r.features) for r in b.collect()}
    found = np.array([[a[i] @ b[j] for j in range(20)] for i in range(30)])
    assert all((v >= 0).all() for v in a.values()) and np.abs(found - table).mean() < 0.1 * table.mean()
    assert df.agg(F.count("*")).first()[0] == 600


def test_trees_see_what_a_line_does_not(spark):
    """A bend that no line explains; on other rows' features nothing is gained."""
    from tidemark.operators import models as M

    rng = np.random.default_rng(12)
    a, b = rng.uniform(-1, 1, (2, 600))
    y = np.abs(a) + 0.05 * rng.standard_normal(600)
    df = spark.createDataFrame([(i, float(p), float(q), float(t), i >= 400) for i, (p, q, t) in enumerate(zip(a, b, y, strict=True))] + [(900, None, 0.0, 1.0, True)], "k long, a double, b double, y double, late boolean")
    got = {r.model: r for r in M.compared_fits(df, ["a", "b"], "y", "late", "k").collect()}
    assert {r.n for r in got.values()} == {200} and got["trees"].r2 > 0.8 and got["control"].r2 < 0.1
    x = np.column_stack([np.ones(600), a, b])
    w = np.linalg.lstsq(x[:400], y[:400], rcond=None)[0]
    want = 1 - ((y[400:] - x[400:] @ w) ** 2).sum() / ((y[400:] - y[:400].mean()) ** 2).sum()
    assert got["line"].r2 == pytest.approx(want, abs=1e-6)
    assert M.compared_fits(df.where("NOT late"), ["a", "b"], "y", "late", "k").collect() == []
