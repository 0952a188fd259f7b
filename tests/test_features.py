"""Hashed features, panel spectra and text readers against plain Python and numpy."""

from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import hashing as H
from tidemark.functions import text as TX
from tidemark.operators import spectral


def plain_fnv(data: bytes) -> str:
    state = 0xCBF29CE484222325
    for b in data:
        state = (state ^ b) * 0x100000001B3 % 2**64
    return f"{state:016x}"


def test_fnv(spark):
    texts = ["", "a", "foobar", "naïve – ☃", "x" * 500]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", H.fnv1a(F.col("t")).alias("h")).collect()
    assert {r.t: r.h for r in rows} == {t: plain_fnv(t.encode()) for t in texts} | {None: None}


def test_features(spark):
    row = spark.createDataFrame([("Ab a-bcd",)], "t string").select(H.character_grams(H.words(F.col("t"))).alias("g"), H.word_pairs(H.words(F.col("t"))).alias("p")).first()
    assert sorted(row.g) == sorted(["ab", "a", "bcd", " ab ", " bcd", "bcd "])
    assert sorted(row.p) == sorted(["ab", "a", "bcd", "ab a", "a bcd"])


def test_bag_has_length_one_and_skips_empty_texts(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k long, t string")
    rows = H.bag(df, "k", H.words(F.col("t")), 1 << 20).collect()
    assert {r.k for r in rows} == {1}
    assert sorted(round(r.weight, 6) for r in rows) == [round(1 / 5**0.5, 6), round(2 / 5**0.5, 6)]


def test_bag_counts_whole_long_texts_and_what_each_word_stands_for(spark, monkeypatch):
    """Pieces of a text, rows of one key and small tables of counts add up to what plain counting gives."""
    monkeypatch.setattr(H, "PIECE", 7)
    monkeypatch.setattr(H, "CELLS", 64)
    monkeypatch.setattr(H, "KNOWN", 5)
    rng = np.random.default_rng(2)
    rows = [(i % 9, " ".join("abcde"[: n + 1] * (n % 3 + 1) for n in rng.integers(0, 5, 3 * i))) for i in range(12)] + [(20, None), (21, "")]
    got = {(r.k, r.slot): r.weight for r in H.bag(spark.createDataFrame(rows, "k long, t string"), "k", H.words(F.col("t")), 32, H.grams_of).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        words = [w for j, t in rows if j == k and t for w in t.split()]
        found = Counter(int(md5(g.encode()).hexdigest()[:8], 16) % 32 for w in words for g in [w, *(f" {w} "[i : i + 4] for i in range(len(w) - 1))])
        want |= {(k, s): n / sum(m * m for m in found.values()) ** 0.5 for s, n in found.items()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_link_and_section(spark):
    df = spark.createDataFrame([("https://n.example/articles/aHR0cDovL2EuYi9jP2Q?x=1",), ("https://n.example/other",), (None,)], "u string")
    assert [r[0] for r in df.select(TX.decode_link(F.col("u"))).collect()] == ["http://a.b/c?d", None, None]
    filing = "Item 1. Business 3 Item 1A. Risk 9 ITEM 1 Business We make pipes. Item 1A Risks"
    df = spark.createDataFrame([(filing,), ("no heading",), (None,)], "t string")
    assert [r[0] for r in df.select(TX.business_section(F.col("t"))).collect()] == ["We make pipes.", None, None]


def test_absorption(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6, 5)) + 2 * rng.normal(size=5)
    rows = [("g", n, t, float(x[n, t])) for n in range(6) for t in range(5)] + [("g", 9, t, 1.0) for t in range(5)]
    got = spectral.absorption(spark.createDataFrame(rows, "w string, name long, at int, v double"), "w", "name", "at", "v", 5).first()
    assert got.names == 6
    assert got.share == pytest.approx(np.linalg.eigvalsh(np.corrcoef(x))[-1] / 6)


def test_pair_correlation(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, 12))
    panel = spark.createDataFrame([(n, t, float(x[n, t])) for n in range(3) for t in range(12 if n < 2 else 4)], "name long, at int, v double")
    pairs = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (5, 6)], "a long, b long")
    (got,) = spectral.pair_correlation(pairs, panel, "name", "at", "v", 10).collect()
    assert (got.a, got.b, got.n) == (0, 1, 12)
    assert got["corr"] == pytest.approx(np.corrcoef(x[0], x[1])[0, 1])


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_word_pairs_split_a_text_once(spark):
    from tidemark import registry

    registry.load()
    assert _plan(registry.QUERIES["t34_hashed_bag"](spark, "/root/testdata/sf0.001")).count("split(") == 1


def test_lexical_index_splits_texts_once_for_terms_and_once_for_lengths(spark):
    from tidemark.operators import retrieval as R

    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, ""), (3, None), (4, "beta")], "d long, t string")
    index = R.bm25_index(docs, "d", "t")
    # Terms, their document frequencies (the same shuffle) and the mean length.
    assert _plan(index).count("regexp_extract_all") == 3
    assert sorted((r.doc, r.term, r.tf, r.dl, r.df) for r in index.collect()) == [(1, "alpha", 2, 3, 1), (1, "beta", 1, 3, 2), (4, "beta", 1, 1, 2)]


def test_term_weights_shuffle_texts_and_no_terms_of_documents(spark):
    from tidemark import registry

    registry.load()
    plan = registry.QUERIES["v17_tfidf_space"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id" in plan and ", term" not in "".join(p.split(")")[0] for p in plan.split("hashpartitioning(doc_id")[1:])
