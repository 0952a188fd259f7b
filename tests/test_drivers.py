"""Driver removal and entity resolution against plain Python."""

import datetime as dt
import difflib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drivers as D
from tidemark.operators import resolve as N

DAYS = 28


@pytest.fixture(scope="module")
def market():
    """Names moved by a common factor, by one of two drivers, or by nothing, with gaps."""
    rng = np.random.default_rng(8)
    common, one, two = rng.standard_normal((3, DAYS))
    series = {}
    for i in range(14):
        x = 0.4 * rng.standard_normal(DAYS) + (one if i < 6 else two if i < 11 else common)
        x[rng.random(DAYS) < 0.08] = np.nan
        series[i] = x
    series[13][5:] = np.nan
    members = {"one": [0, 1, 2, 3, 4, 5], "two": [6, 7, 8, 9, 10], "mixed": [0, 6, 11, 12, 13], "small": [0, 1, 2], "tiny": [1]}
    return series, members


@pytest.fixture(scope="module")
def frames(spark, market):
    series, members = market
    first = dt.date(2024, 3, 1)
    rows = [(i, first + dt.timedelta(days=k), float(v)) for i, x in series.items() for k, v in enumerate(x) if not np.isnan(v)]
    panel = spark.createDataFrame(rows + [(0, first - dt.timedelta(days=1), 9.0), (1, first + dt.timedelta(days=DAYS), 9.0), (2, first, None)], "name long, day date, v double")
    periods = spark.createDataFrame([(5, first, DAYS)], "window int, first date, days int")
    m = spark.createDataFrame([(5, d, n) for d, names in members.items() for n in names] + [(5, "one", 0), (5, "two", 99)], "window int, driver string, name long")
    return m, D.windowed(panel.where("NOT (name = 2 AND v IS NULL)"), "name", "day", "v", periods)


def plain_corr(x, y):
    both = [i for i in range(DAYS) if not np.isnan(x[i]) and not np.isnan(y[i])]
    return float(np.corrcoef(x[both], y[both])[0, 1]) if len(both) >= 20 else None


def plain_residual(x, f):
    both = [i for i in range(DAYS) if not np.isnan(x[i]) and not np.isnan(f[i])]
    if len(both) < 20:
        return None
    a = np.column_stack([np.ones(len(both)), f[both]])
    out = np.full(DAYS, np.nan)
    out[both] = x[both] - a @ np.linalg.lstsq(a, x[both], rcond=None)[0]
    return out


def freed(series, names, a, b):
    others = [n for n in names if n not in (a, b)]
    if len(others) < 2:
        return None
    f = np.full(DAYS, np.nan)
    for k in range(DAYS):
        v = [series[n][k] for n in others if not np.isnan(series[n][k])]
        if len(v) >= 2:
            f[k] = np.mean(v)
    p, q = plain_residual(series[a], f), plain_residual(series[b], f)
    return None if p is None or q is None else plain_corr(p, q)


def test_windows_hold_a_slot_a_day(frames, market):
    _, series = frames
    got = {r["name"]: r.x for r in series.collect()}
    for i, x in market[0].items():
        assert [None if np.isnan(v) else v for v in x] == got[i]


def test_removal_equals_plain_python(frames, market):
    members, series = frames
    data, own = market
    drivers = sorted(d for d, names in own.items() if len(names) >= 3)
    stranger = F.pmod(F.col("place") + F.col("a") + F.col("b"), F.col("drivers"))
    got = {(r.driver, r.a, r.b): r for r in D.removals(members, series, "name", 0.3, stranger).collect()}
    want = {}
    for d, names in own.items():
        for a in names:
            for b in names:
                c = plain_corr(data[a], data[b]) if a < b and len(names) >= 4 else None
                if c is not None and c >= 0.3:
                    other = drivers[(drivers.index(d) + a + b) % len(drivers)]
                    other = other if other != d else None
                    want[(d, a, b)] = (c, freed(data, names, a, b), other, freed(data, own[other], a, b) if other else None)
    assert set(got) == set(want) and len(want) > 12
    for k, (before, after, other, other_after) in want.items():
        r = got[k]
        assert r.before == pytest.approx(before) and r.other == other
        assert (r.after is None) == (after is None) and (after is None or r.after == pytest.approx(after, abs=1e-9))
        assert (r.other_after is None) == (other_after is None) and (other_after is None or r.other_after == pytest.approx(other_after, abs=1e-9))
    drops = [(w[0] - w[1]) for w in want.values() if w[1] is not None]
    placebo = [(w[0] - w[3]) for w in want.values() if w[3] is not None]
    s = D.attribution(D.removals(members, series, "name", 0.3, stranger)).first()
    error = (np.var(drops, ddof=1) / len(drops) + np.var(placebo, ddof=1) / len(placebo)) ** 0.5
    assert (s.named, s.random) == (len(drops), len(placebo)) and s.t == pytest.approx((np.mean(drops) - np.mean(placebo)) / error)
    assert s.excess > 0.2


def test_removal_of_nothing(spark, frames):
    members, series = frames
    assert D.removals(members.limit(0), series, "name").collect() == []
    s = D.attribution(D.removals(members, series.limit(0), "name")).first()
    assert (s.named, s.random, s.t) == (0, 0, None)


LISTED = [("Acme Widgets Inc", "ACM"), ("Acme Widgets", "ACB"), ("Golden Harbour Mining PLC", "GHM"), ("Northern Lights Energy", "NLE"), ("Ace", "ACE"), (None, "NIL"), ("The Company", "TC")]
MACRO = [("crude oil", "USO"), ("Japan", "EWJ"), ("gold", "GLD"), ("u k equities", "EWU")]
RULES = [(1, "high yield", "HYG"), (2, "rate", "TNX"), (3, "treasur", "TLT"), (4, "oil", "XOP"), (5, "gas", "UNG")]
ENTITIES = [
    (1, "ACME WIDGETS, INC.", "company"), (2, "Acme Widgetts", "company"), (3, "Golden Harbor Mining", "company"), (4, "Crude oil futures", "commodity"), (5, "the Japan", "country"),
    (6, "Gold prices", "company"), (7, "US high yields", "asset_class"), (8, "Infratel", "other"), (9, "Corporate rates", "other"), (10, "treasury", "rate_or_bond"), (11, "Oily gas", "other"),
    (12, "oil & gas", "other"), (13, "Acme Widgets", "person"), (14, None, "company"), (15, "", "other"), (16, "Inc.", "company"), (17, "Northern Light Energy", "bank"), (18, "Northern Lights", "bank"),
    (19, "Acme Widgets", None), (20, "Acee", "company"), (21, "Golden Harbour Mining", "country"), (22, "gas", "company"),
]


def test_resolution_in_order_of_trust(spark):
    made = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    names = "name string, symbol string"
    got = {r.entity: (r.symbol, r.source) for r in N.resolve(made(ENTITIES, "entity int, name string, kind string"), made(LISTED, names), made(MACRO, names), made(RULES, "place int, keyword string, symbol string")).collect()}
    none = (None, "unresolved")
    assert got == {
        1: ("ACB", "listed_exact"), 2: ("ACB", "listed_near"), 3: ("GHM", "listed_near"), 4: ("USO", "macro"), 5: ("EWJ", "macro"), 6: ("GLD", "macro"), 7: ("HYG", "factor"), 8: none, 9: ("TNX", "factor"),
        10: ("TLT", "factor"), 11: ("UNG", "factor"), 12: ("XOP", "factor"), 13: none, 14: none, 15: none, 16: none, 17: ("NLE", "listed_near"), 18: none, 19: none, 20: none, 21: none, 22: none,
    }


def test_resolution_with_empty_tables(spark):
    names = spark.createDataFrame([], "name string, symbol string")
    rules = spark.createDataFrame([], "place int, keyword string, symbol string")
    e = spark.createDataFrame(ENTITIES, "entity int, name string, kind string")
    assert {r.source for r in N.resolve(e, names, names, rules).collect()} == {"unresolved"}
    assert N.resolve(e.limit(0), names, names, rules).collect() == []


def test_near_names_miss_none(spark):
    """Every pair within a tenth of the letters that shares a long word, by comparing all pairs."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdef"), rng.integers(2, 8))) for _ in range(40)]
    listed = sorted({" ".join(rng.choice(words, rng.integers(1, 6))) for _ in range(150)})
    names = set()
    for nm in listed:
        t = list(nm)
        for _ in range(rng.integers(1, 4)):
            at = int(rng.integers(0, len(t)))
            t[at : at + 1] = [[], ["x"], [t[at], "y"], [" "]][rng.integers(0, 4)]
        names.add(re.sub(" +", " ", "".join(t)).strip())
    names -= {""}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    long_words = lambda s: {w for w in s.split() if len(w) >= 4}
    want = {(a, b) for a in names for b in listed if long_words(a) & long_words(b) and abs(len(a) - len(b)) < 9 and edits(a, b) <= 0.1 * max(len(a), len(b)) and edits(a, b) > 0}
    df = lambda rows: spark.createDataFrame([(r,) for r in sorted(rows)], "nm string")
    got = {(r.nm, r.listed) for r in N.near_names(df(names), df(listed)).collect() if r.apart}
    assert got == want and len(want) > 30
    # Most of what the ratio of matching blocks calls alike is alike by edits, too; letters that move count twice here.
    alike = {(a, b) for a in names for b in listed if long_words(a) & long_words(b) and difflib.SequenceMatcher(None, a, b).ratio() >= 0.92 and a != b}
    assert len(alike - want) <= 0.2 * len(alike)


@pytest.mark.parametrize(("rows", "most"), [(500, 20_000), (2, 0)])
def test_removal_by_blocks(spark, frames, monkeypatch, rows, most):
    """Blocks of two names and baskets that are joined give the same rows as one block; no join makes pairs."""
    members, series = frames
    stranger = F.pmod(F.col("place") + F.col("a") + F.col("b"), F.col("drivers"))
    want = sorted(map(tuple, D.removals(members, series, "name", 0.3, stranger).collect()), key=repr)
    monkeypatch.setattr(D, "ROWS", rows)
    monkeypatch.setattr(D, "BROADCAST", most)
    found = D.removals(members, series, "name", 0.3, stranger)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert len(got) == len(want) > 10
    assert [r[:4] for r in got] == [r[:4] for r in want] and [r[6] for r in got] == [r[6] for r in want]
    assert all(x == pytest.approx(y) for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True) if isinstance(y, float))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_correlations_of_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((30, 9)), 1) + 100
    x[rng.random(x.shape) < 0.4] = np.nan
    x[0], x[1, 3:] = 7.0, 100.1
    n, c = D.correlations(x[:20], x)
    for i in range(20):
        for j in range(30):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            assert n[i, j] == both.sum()
            assert c[i, j] == pytest.approx(D.correlation(x[i : i + 1], x[j : j + 1], 1)[0], abs=1e-9, nan_ok=True)


@pytest.mark.parametrize("block", [2048, 2])
def test_removal_within_blocks(spark, frames, monkeypatch, block):
    """A function as the stranger gives the rows of the column form, pairs leave a block without their series, and sums of blocks give the same test."""
    members, series = frames
    shift = lambda place, a, b, drivers: (place + a + b) % drivers
    monkeypatch.setattr(D, "TILE", 3)
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "WHOLE", block)
    rows = D.removals(members, series, "name", 0.3, F.pmod(F.col("place") + F.col("a") + F.col("b"), F.col("drivers")))
    want = sorted(map(tuple, rows.collect()), key=repr)
    found = D.removals(members, series, "name", 0.3, shift)
    got = sorted(map(tuple, found.collect()), key=repr)
    assert found.columns == rows.columns and [r[:4] for r in got] == [r[:4] for r in want] and [r[6] for r in got] == [r[6] for r in want] and len(want) > 12
    for g, w in zip(got, want, strict=True):
        assert all(x == y if x is None or isinstance(x, (int, str)) else x == pytest.approx(y, abs=1e-9) for x, y in zip(g, w, strict=True))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "binary" not in plan[: plan.index("FlatMapCoGroupsInArrow")] and "FlatMapCoGroupsInArrow" in plan and "ArrowEvalPython" not in plan
    s, t = D.attribution(rows).first(), D.removed(members, series, "name", shift).first()
    assert (s.named, s.random) == (t.named, t.random) and all(t[c] == pytest.approx(s[c]) for c in ("named_drop", "random_drop", "excess", "t"))
    s = D.removed(members, series.limit(0), "name", shift).first()
    assert (s.named, s.random, s.t) == (0, 0, None) and D.removals(members.limit(0), series, "name", 0.3, shift).collect() == []
    monkeypatch.setattr(D, "BROADCAST", 0)
    assert D.removed(members, series, "name", shift).first().t == pytest.approx(t.t)


def test_likely_pairs_miss_none():
    """Single precision only sorts out: all pairs at the floor stay in, also of rows that hardly vary, have one value or an outlier off the common days."""
    rng = np.random.default_rng(6)
    common = rng.standard_normal(28)
    x = rng.standard_normal((60, 28)) + common * rng.random((60, 1)) * 2
    x[rng.random(x.shape) < 0.1] = np.nan
    x[0], x[1], x[2, 3], x[3] = 5.0, 1e6 + 0.01 * common, 1e7, np.nan
    x[2, 10:14], x[4, 3] = common[10:14], np.nan
    a, p, s = D.shapes(x)
    got = set(zip(*map(list, D.likely(s, s, 0.3, 20)), strict=True))
    n, c = D.correlations(x, x)
    assert {(i, j) for i in range(60) for j in range(60) if n[i, j] >= 20 and c[i, j] >= 0.3} <= got and len(got) < 3600
    r, k = map(np.array, zip(*((i, j) for i in range(60) for j in range(60)), strict=True))
    assert D.correlated(a[r], p[r], a[k], p[k]) == pytest.approx(D.correlation(x[r], x[k]), abs=1e-9, nan_ok=True)
