"""Importance resampling, language identification and ranked search against plain Python."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, language_id, ranked_search, textkit

ITEMS = "item_id long, text string"
ODD = [(None, "null id with a few words, and some more words to make it long enough " * 3), (103, "one"), (103, "one"), (7, "one and the same id, another text"), (None, None)]


def key(row):
    return [(v is None, v if v is not None else 0) for v in row]


@pytest.fixture(scope="module")
def rows(corpus):
    return corpus + ODD


@pytest.fixture(scope="module")
def targets(rows):
    rng = random.Random(3)
    words = [w for _, t in rows[:40] for w in t.split()]
    made = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(20)]
    return made + [(20, "x x x"), (21, None), (22, ""), (23, rows[0][1]), (23, rows[4][1]), (24, "!?"), (25, "ONE One one"), (None, "one same")]


# --- importance resampling -----------------------------------------------------------


def test_crcs_of_words_and_runs():
    rng = random.Random(1)
    words = [bytes(rng.randrange(97, 123) for _ in range(rng.choice([1, 2, 5, 9, 31, 32, 33, 63, 64, 65, 500, 70_000]))) for _ in range(200)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    starts, ends, _ = textkit.split_words(data, np.array([0, data.size]))
    crcs = importance.word_crcs(data, starts, ends)
    for n, got in enumerate(importance.run_crcs(crcs, ends - starts, 4), 1):
        assert got.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in range(len(words) - n + 1)]
    none = np.zeros(0, np.int64)
    assert [r.size for r in importance.run_crcs(importance.word_crcs(data, none, none), none, 3)] == [0, 0, 0]


def test_importance_matches_brute_force(spark, docs, rows, targets):
    got = importance.digest(importance.importance(docs(rows, ["weight", "rank", "_down", "row"]), spark.createDataFrame(targets, ITEMS)))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = importance.brute_force(rows, [t for _, t in targets])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert sum(r[4] is not None for r in want) == 2


def test_importance_ties_and_copies(spark, docs, targets):
    """Equal rows share a score and still get ranks of their own; a level may hold many rows."""
    rows = [(5, "a b c d e f g h i j " * 3)] * 60 + [(i, "k l m n " * 6) for i in range(40)]
    got = importance.digest(importance.importance(docs(rows), spark.createDataFrame(targets, ITEMS))).collect()
    want = importance.brute_force(rows, [t for _, t in targets])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3, 4, 5]


def test_importance_of_empty_tables(spark, docs, rows, targets):
    none = spark.createDataFrame([], ITEMS)
    assert importance.importance(docs([]), none).collect() == []
    got = importance.digest(importance.importance(docs(rows), none)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(importance.brute_force(rows, []), key=key)
    assert importance.draw(docs(rows[:10]), none).count() == 0


def test_draw_keeps_whole_rows(spark, docs, rows, targets):
    df = docs(rows, ["weight", "n_words", "score", "row"])
    items = spark.createDataFrame(targets, ITEMS)
    got = importance.draw(df, items)
    ranked = importance.importance(df, items).where("rank IS NOT NULL").collect()
    assert got.columns == df.columns and {r.weight for r in got.collect()} == {"mine"}
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in ranked)


# --- ranked search -------------------------------------------------------------------


@pytest.mark.parametrize("lead, hot", [(2000, 10_000), (3, 4), (1, 1)])
def test_search_matches_brute_force(spark, docs, rows, targets, monkeypatch, lead, hot):
    monkeypatch.setattr(ranked_search, "LEAD_ROWS", lead)
    monkeypatch.setattr(ranked_search, "SEEDS", 1)
    monkeypatch.setattr(ranked_search, "HOT_ROWS", hot)
    for k in (10, 2):
        got = ranked_search.search(docs(rows, ["score", "term", "item", "part"]), spark.createDataFrame(targets, ITEMS).withColumn("score", F.lit(1)), k)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        want = ranked_search.brute_force(rows, targets, k)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_search_of_empty_tables(spark, docs, rows, targets):
    none = spark.createDataFrame([], ITEMS)
    assert ranked_search.search(docs([]), spark.createDataFrame(targets, ITEMS)).collect() == []
    assert ranked_search.search(docs(rows), none).collect() == []
    assert ranked_search.search(docs([(1, None), (2, "")]), spark.createDataFrame(targets, ITEMS)).collect() == []


def test_search_leaves_no_table(spark, docs, rows, targets):
    ranked_search.search(docs(rows), spark.createDataFrame(targets, ITEMS))
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark_postings")]


def test_text_items_and_long_documents(spark, docs):
    rows = [(1, "alpha " * 40_000 + "beta"), (2, "beta gamma"), (3, "gamma " + "z" * 300_000)]
    items = [("q1", "beta"), ("q2", "Gamma alpha"), ("q3", "z" * 300_000)]
    got = ranked_search.search(docs(rows), spark.createDataFrame(items, "item_id string, text string"))
    assert sorted(map(tuple, got.collect())) == sorted(ranked_search.brute_force(rows, items))


# --- language identification ---------------------------------------------------------

PIECES = [" a", " ab", "b", "ab", "ba", "é", "bé", " ", "c.", "A", "abab", ""]


def lattice(units, vocabulary):
    data = np.frombuffer(b"".join(units), np.uint8)
    return language_id.Lattice(vocabulary, data, np.r_[0, np.cumsum([len(u) for u in units])])


def test_forward_sums_every_segmentation():
    vocabulary = language_id.Vocabulary.of(PIECES)
    known = [p for p in sorted({p.encode() for p in PIECES if p}) if p not in (b"c.", b"A")]
    by_text = {p: [256 + i] for i, p in enumerate(known)}
    assert vocabulary.size == 256 + len(known)
    units = [" abab".encode(), " ".encode(), " babé".encode(), " a".encode(), " céab".encode(), " é".encode()]
    p = np.random.default_rng(0).dirichlet(np.ones(vocabulary.size), 3).T
    language, times = np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 2, 3, 4, 5, 6])
    likely, counts = np.zeros((len(units), 3)), np.zeros(p.shape)
    for u, unit in enumerate(units):
        paths = list(language_id.segmentations(unit, by_text))
        weight = np.array([p[path].prod(0) for path in paths])
        likely[u] = weight.sum(0)
        for path, w in zip(paths, weight[:, language[u]] / likely[u, language[u]], strict=True):
            np.add.at(counts, (path, language[u]), times[u] * w)
    got = lattice(units, vocabulary)
    assert np.allclose(np.exp(got.likelihoods(np.log(p))), likely)
    assert np.allclose(got.expected(np.log(p), language, times), counts)


def test_units_keep_all_letters():
    texts = ["Two WORDS, 3 times", None, "", "é" * 500 + "x" + "日本" * 200, "a1b", "!!"]
    data, starts, ends, row = language_id.cut_units(pa.array(texts))
    raw = data.tobytes()
    got = ["".join(raw[a:b].decode() + "|" for a, b, r in zip(starts, ends, row, strict=True) if r == i) for i in range(len(texts))]
    assert got[0] == "two|words|times|" and got[1] == got[2] == got[5] == "" and got[4] == "a|b|"
    assert got[3].replace("|", "") == texts[3] and max(ends - starts) <= language_id.LONGEST_UNIT + 3


def test_learning_does_not_fall():
    """Each round of expectation and maximisation raises the likelihood, but for the smoothing."""
    vocabulary = language_id.Vocabulary.of(PIECES)
    units = [" abab".encode()] * 3 + [" babé".encode(), " cab".encode()]
    n = np.full(len(units), 1e6)
    logs, language, last = np.full((vocabulary.size, 1), -math.log(vocabulary.size)), np.zeros(len(units), int), -np.inf
    for _ in range(6):
        found = lattice(units, vocabulary)
        now = float((found.likelihoods(logs)[:, 0] * n).sum())
        assert now > last - 1
        last, logs = now, language_id._shares(found.expected(logs, language, n))
    assert np.isclose(np.exp(logs).sum(), 1)


def test_languages_of_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.digest(df).join(df.select("doc_id", "lang", F.size(F.split("text", r"\s+")).alias("n")), "doc_id").where("held_out").collect()
    right = [(r.n, r.lang_pred == r.lang) for r in found]
    assert len(right) > 250 and np.mean([x for _, x in right]) > 0.98
    assert np.mean([x for n, x in right if n >= 10]) > 0.99
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts_and_labels(spark, docs, rows):
    both = docs(rows + [(200, "12 !? 34"), (201, "🙂 — …"), (202, "ab" * 50_000)], ["lang_pred", "score", "unit"])
    got = {(r.doc_id, r.text): r for r in language_id.identify(both, language_id.learn(both)).collect()}
    assert {got[(i, t)].lang_pred for i, t in [(100, None), (101, ""), (102, " \t\n "), (200, "12 !? 34"), (201, "🙂 — …")]} == {"und"}
    assert got[(202, "ab" * 50_000)].lang_pred == "en" and got[(103, "one")].score == 1 and got[(200, "12 !? 34")].score == 0
    assert next(iter(got.values())).unit == "mine"
    unknown = both.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.digest(unknown).collect()} == {("und", 0.0)}
    assert language_id.digest(docs([])).collect() == []


def test_labels_and_ids_are_no_inputs(spark, docs):
    """A held-out row's lang, source and id change nothing; ties go to the first name."""
    train = [(i, "the and of with", "en") for i in range(40)] + [(i, "der und von mit", "de") for i in range(40, 80)]
    rows = [r for r in train if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(df)
    probe = spark.createDataFrame([(1, "with the", "de"), (2, "with the", None), (3, "mit der", "en")], df.schema)
    got = [r.lang_pred for r in language_id.identify(probe, model).orderBy("doc_id").collect()]
    assert got == ["en", "en", "de"]
    same = language_id.Model(["aa", "bb"], np.log([0.5, 0.5]), np.repeat(model.logs[:, :1], 2, 1), model.vocabulary)
    assert {r.lang_pred for r in language_id.identify(probe, same).collect()} == {"aa"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 1)
    df = spark.createDataFrame([(i, "word", "en" if i % 2 else "de") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        language_id.learn(df)
