"""Substring, line and SimHash dedup and decontamination against brute force."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontaminate, line_dedup, shared, shingle_join, simhash_dedup, substring_dedup


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_substring_dedup(docs, corpus):
    got = rows_of(substring_dedup.digest(substring_dedup.remove_repeats(docs(corpus, ["gram", "place"]))), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == sorted(substring_dedup.brute_force(corpus), key=repr)


def test_substring_repeats_are_maximal(docs):
    text = " ".join(f"w{i}" for i in range(50))
    got = {r.doc_id: [tuple(x) for x in r.repeats] for r in substring_dedup.remove_repeats(docs([(1, text), (2, "new " + text + " end"), (3, text[: text.index(" w19")])])).collect()}
    assert got == {1: [], 2: [(1, 51)], 3: []}


def test_substring_repeated_rows_and_null_ids(docs):
    text = " ".join(f"w{i}" for i in range(30))
    got = rows_of(substring_dedup.remove_repeats(docs([(5, text), (5, text), (None, text), (5, "other words"), (9, text)])), "doc_id", "n_words", "n_removed")
    assert got == sorted([(5, 30, 30), (5, 30, 30), (None, 30, 0), (5, 2, 0), (9, 30, 30)], key=repr)


def test_simhash(docs, corpus):
    got = rows_of(simhash_dedup.near_duplicates(docs(corpus, ["bits", "component"])), "doc_id", "fingerprint", "component_id")
    assert got == sorted(simhash_dedup.brute_force(corpus), key=repr)


def test_covering_masks_miss_no_pair():
    masks = simhash_dedup.masks()
    for i in range(64):
        for j in range(64):
            differ = (1 << i) | (1 << j)
            assert any(not m & differ for m in masks)


def test_large_buckets_link_exactly(spark, monkeypatch):
    """The one-bit neighbours give the same components as all pairs."""
    rng = random.Random(3)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(60)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "bits long")
    rows_pairs = sorted(tuple(r) for r in shared.components(simhash_dedup.links(df)).collect())
    monkeypatch.setattr(simhash_dedup, "PAIRED", 1)
    neighbours = sorted(tuple(r) for r in shared.components(simhash_dedup.links(df)).where(f"node IN ({', '.join(map(str, signed))})").collect())
    want: dict[int, int] = {}
    left = set(signed)
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2}
            left -= near
            todo += near
        if len(group) > 1:
            want |= {x: min(group) for x in group}
    assert rows_pairs == neighbours == sorted(want.items())


def test_keep_one(docs):
    df = docs([(3, "a b c d"), (1, "a b c d"), (7, "quite different words here"), (1, "a b c d"), (9, None), (8, "")])
    assert rows_of(simhash_dedup.keep_one(df), "doc_id") == [(1,), (7,), (8,)]
    assert simhash_dedup.keep_one(df).columns == df.columns


def test_keep_one_tells_shared_and_null_ids_apart(docs):
    a, b, c = "red green blue black", "some other text of words", "third text with its own words"
    rows = [(1, a), (1, b), (1, b), (None, c), (None, "fourth null text here again"), (2, a), (3, c), (None, None)]
    kept = rows_of(simhash_dedup.keep_one(docs(rows)), "doc_id", "text")
    assert kept == sorted([(1, a), (1, b), (3, c), (None, "fourth null text here again"), (None, None)], key=repr)


def test_keep_one_links_by_fingerprint(docs):
    """Texts of one fingerprint, or of near ones, are one group though few of their shingles are the same; also by way of a third text."""
    rng = random.Random(3)
    tail = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(20))
    base = "red green blue " * 50
    rows = [(4, base + tail()), (2, base + tail()), (5, tail()), (6, base + tail())]
    bits = {i: b for i, b, _ in simhash_dedup.brute_force(rows)}
    assert bits[4] == bits[2] == bits[6] != bits[5]
    sets = [set(shingle_join.shingles(t).tolist()) for _, t in rows]
    assert len(sets[0] & sets[1]) < 0.3 * len(sets[0] | sets[1])
    assert rows_of(simhash_dedup.keep_one(docs(rows)), "doc_id") == [(2,), (5,)]


def test_keep_one_finds_all_pairs_at_the_similarity(docs, monkeypatch):
    """Copies with a few edits go, as a brute force on the shingles' Jaccard similarity says; also by way of crowded buckets."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = []
    for i in range(40):
        text = [word() for _ in range(rng.choice([5, 30, 100, 300]))]
        copy = list(text)
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            copy[rng.randrange(len(copy))] = word()
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(copy))]
    base = [word() for _ in range(150)]
    for i in range(12):
        rows.append((100 + i, " ".join(base[: rng.randrange(90, 150)])))
    sets = [set(shingle_join.shingles(t).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    want = sorted((rows[i][0],) for i in range(len(rows)) if root[i] == i)
    assert 20 <= len(rows) - len(want)
    assert sorted(rows_of(simhash_dedup.keep_one(docs(rows)), "doc_id")) == want
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    monkeypatch.setattr(line_dedup, "HEADS", 1)
    assert sorted(rows_of(simhash_dedup.keep_one(docs(rows)), "doc_id")) == want


def test_lines(docs, corpus):
    got = rows_of(line_dedup.remove_lines(docs(corpus, ["line", "kept", "of", "n_lines"])), "doc_id", "n_lines", "n_removed", "text")
    assert got == sorted(line_dedup.brute_force(corpus), key=repr)


def test_fuzzy_lines_go(docs):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today again and again we say"
    df = docs([(1, a + "\nfirst own line of this text"), (2, "second own line of that text\n" + a.upper() + "!"), (3, a.replace("today", "tonight") + "\nthird own line of it all")])
    got = {r.doc_id: r.text for r in line_dedup.remove_lines(df).collect()}
    assert got[1].startswith(a) and got[2] == "second own line of that text"


def test_all_similar_lines_go(docs):
    """One word of a short line, a fifth of the words of long ones, words put in and left out."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(60):
        n = rng.choice([5, 9, 10, 14, 19, 20, 40, 100])
        line = [word() for _ in range(n)]
        copy = list(line)
        for _ in range(n // 5):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[word()], [word()], [], [copy[at], word()]])
        rows += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(copy) + "\n" + f"own words{i} of{i} this{i} text{i} {word()}")]
    want = line_dedup.brute_force(rows)
    assert sum(r[2] for r in want) >= 50
    assert rows_of(line_dedup.remove_lines(docs(rows)), "doc_id", "n_lines", "n_removed", "text") == sorted(want, key=repr)


def test_one_changed_word_goes(docs):
    a = "the quick brown fox jumps over the lazy dog near the old river bank today again and again we say"
    df = docs([(1, a), (2, a.replace("today", "tonight") + "\nsecond own line of it all")])
    assert rows_of(line_dedup.remove_lines(df), "doc_id", "text") == [(1, a), (2, "second own line of it all")]


def test_crowded_buckets_link_exactly(docs, monkeypatch):
    rng = random.Random(12)
    base = "of the and to in that is was he for it with as his on be at by".split()
    rows = []
    for i in range(60):
        line = list(base)
        for _ in range(rng.randint(1, 5)):
            line[rng.randrange(len(line))] = f"w{rng.randrange(200)}"
        rows.append((i, " ".join(line)))
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    monkeypatch.setattr(line_dedup, "HEADS", 1)
    assert rows_of(line_dedup.remove_lines(docs(rows)), "doc_id", "n_lines", "n_removed", "text") == sorted(line_dedup.brute_force(rows), key=repr)


def test_crowded_buckets_of_long_lines(docs, monkeypatch):
    """Lines that share over half of their words, some beyond the 128 parity bits, in buckets with several groups."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(220)]
    rows = []
    for i in range(50):
        line = base[: rng.choice([30, 60, 200, 220])]
        for _ in range(rng.choice([1, len(line) // 12, len(line) // 6, len(line) // 4, len(line) // 3])):
            line[rng.randrange(len(line))] = f"w{rng.randrange(2000)}"
        rows.append((i, " ".join(line)))
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    monkeypatch.setattr(line_dedup, "HEADS", 1)
    want = line_dedup.brute_force(rows)
    assert 10 < sum(r[2] for r in want) < 48
    assert rows_of(line_dedup.remove_lines(docs(rows)), "doc_id", "n_lines", "n_removed", "text") == sorted(want, key=repr)


def _repeating(seed, n):
    """Lines that say a few words over and over, some with edits."""
    rng = random.Random(seed)
    lines = []
    for i in range(n):
        line = [f"k{i % 5}x{j}" for j in range(rng.choice([2, 3, 8]))] * rng.choice([4, 10, 24])
        for _ in range(rng.randint(0, len(line) // 4)):
            at = rng.randrange(len(line))
            line[at : at + 1] = rng.choice([["new"], [], [line[at], "new"], [line[0]]])
        lines.append(line)
    return lines


def test_repeated_words_leave_parity_bits():
    """Lines of other words differ in their bits, though each word stands there an even number of times; an edit flips two at most."""
    texts = [" ".join(x * 40) for x in (["one", "two"], ["three", "four"])]
    (rows,) = line_dedup._lines(iter([pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": texts})]))
    sides = [[np.uint64(x & (1 << 64) - 1) for x in rows.column(c).to_pylist()] for c in range(rows.num_columns) if rows.schema.names[c] in ("high", "low", *line_dedup._LONG)]
    assert len(sides) == 10 and sum(int(np.bitwise_count(x ^ y)) for x, y in sides[:2]) > 32 and sum(int(np.bitwise_count(x ^ y)) for x, y in sides[2:]) > 60
    lines = _repeating(31, 150)
    rows = pa.Table.from_batches(line_dedup._lines(iter([pa.RecordBatch.from_pydict({"doc_id": range(150), "text": [" ".join(x) for x in lines]})]))).to_pylist()
    sketches = line_dedup._sketches(iter([pa.RecordBatch.from_pydict({"line": range(150), "words": [np.array([hash(w) & (1 << 64) - 1 for w in x], np.uint64).tobytes() for x in lines]})]))
    sketches = [np.frombuffer(x, np.uint64) for b in sketches for x in b.column(1).to_pylist()]
    met = 0
    for i, j in itertools.combinations(range(150), 2):
        most = max(len(lines[i]), len(lines[j])) // 5
        if line_dedup.edit_distance(lines[i], lines[j], most) <= most:
            met += 1
            allowed = 2 * most - abs(len(lines[i]) - len(lines[j]))
            flips = [sum(((rows[i][c] ^ rows[j][c]) & (1 << 64) - 1).bit_count() for c in names if None not in (rows[i][c], rows[j][c])) for names in (("high", "low"), line_dedup._LONG)]
            assert max(*flips, int(line_dedup._flips(sketches[i], sketches[j][None])[0])) <= allowed
    assert met > 100


def test_repeated_pairs_count_among_the_keys():
    words = np.tile(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 60)
    _, keys = line_dedup._prefixes(words, np.array([0, words.size]), np.zeros(1 << line_dedup.SLOTS_LOG, np.uint8))
    assert keys.size == np.unique(keys).size == 4  # 193 of 479 pairs, 60 of a kind


def test_lines_of_repeated_words(docs, monkeypatch):
    rows = [(i, " ".join(x) + "\n...\n") for i, x in enumerate(_repeating(32, 60))]
    want = sorted(line_dedup.brute_force(rows), key=repr)
    assert 20 < sum(r[2] for r in want) < 60
    assert rows_of(line_dedup.remove_lines(docs(rows)), "doc_id", "n_lines", "n_removed", "text") == want
    monkeypatch.setattr(line_dedup, "PAIRED", 2)
    monkeypatch.setattr(line_dedup, "HEADS", 1)
    assert rows_of(line_dedup.remove_lines(docs(rows)), "doc_id", "n_lines", "n_removed", "text") == want


def test_crowded_lines_of_other_words_make_no_pairs():
    """A bucket of lines that repeat a few words, in groups of their own: only pairs that may be similar come out."""
    words = [np.tile(np.array([7, 9, 11 * i + 100, 13 * i + 5000], np.uint64) * np.uint64(0x9E3779B97F4A7C15), 30) for i in range(40)]
    (sketches,) = line_dedup._sketches(iter([pa.RecordBatch.from_pydict({"line": range(40), "words": [x.tobytes() for x in words]})]))
    rows = {"key": [1] * 40, "line": range(40), "grp": range(40), "words": [120] * 40, "sketch": sketches.column(1).to_pylist(), "keys": [[1]] * 40}
    assert sum(b.num_rows for b in line_dedup._across(iter([pa.RecordBatch.from_pydict(rows, line_dedup._CROWDED)]))) == 0


def test_similar_sequences():
    """The bands and the filter of bags against the plain distance, for edits of every kind and many sizes."""
    rng = random.Random(14)
    one = lambda v: (rng.randrange(v) + 3) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    a, b = [], []
    for _ in range(1500):
        kinds = rng.choice([3, 1000])
        x = [one(kinds) for _ in range(rng.choice([0, 1, 5, 6, 9, 14, 20, 53, 100]))]
        y = list(x)
        for _ in range(rng.randint(0, max(1, len(x) // 3)) if x else 0):
            at = rng.randrange(len(y)) if y else 0
            y[at : at + 1] = rng.choice([[one(kinds)], [], [one(kinds), *y[at : at + 1]]])
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    want = [line_dedup.edit_distance(x.tolist(), y.tolist(), max(x.size, y.size) // 5) <= max(x.size, y.size) // 5 for x, y in zip(a, b, strict=True)]
    assert line_dedup.similar_sequences(a, b).tolist() == want and 300 < sum(want) < 1400


@pytest.mark.parametrize(("a", "b", "d"), [("", "", 0), ("abc", "abc", 0), ("abc", "abd", 1), ("kitten", "sitting", 3), ("abcdef", "bcdefg", 2), ("", "abc", 3), ("xabc", "abc", 1)])
def test_edit_distance(a, b, d):
    assert line_dedup.edit_distance(list(a), list(b), 10) == d
    assert line_dedup.edit_distance(list(b), list(a), 10) == d
    if d:
        assert line_dedup.edit_distance(list(a), list(b), d - 1) == d


def test_edit_distance_of_random_words():
    rng = random.Random(8)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return row[-1]

    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert line_dedup.edit_distance(a, b, 30) == plain(a, b)


ITEMS = [("i1", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"), ("i2", "short item"), ("i3", None), (None, "w" * 5000), ("i1", "Alpha, BETA! gamma"), ("i4", "the")]


def test_decontamination(docs, spark, corpus):
    rows = corpus + [(200, "zzz " + ITEMS[0][1].upper() + " yyy"), (201, "a Short-item b the the"), (202, " ".join(ITEMS[0][1].split()[1:13])), (203, "alpha beta gamma " * 30)]
    found = decontaminate.find_items(docs(rows, ["token", "words"]), spark.createDataFrame(ITEMS, "item_id string, text string"))
    got = rows_of(decontaminate.digest(found), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(decontaminate.brute_force(rows, ITEMS), key=repr)


def test_decontamination_drops_documents(docs, spark):
    df = docs([(1, ITEMS[0][1]), (2, "clean words only"), (3, None), (2, "clean words only")])
    kept = decontaminate.remove_contaminated(df, spark.createDataFrame(ITEMS[:1], "item_id string, text string"))
    assert rows_of(kept, "doc_id") == [(2,), (2,), (3,)] and kept.columns == df.columns


def test_decontamination_beyond_the_broadcast(docs, spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    rows = [(1, "x " + ITEMS[0][1]), (2, "short item")]
    got = rows_of(decontaminate.digest(decontaminate.find_items(docs(rows), spark.createDataFrame(ITEMS, "item_id string, text string"))), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == sorted(decontaminate.brute_force(rows, ITEMS), key=repr)


def test_empty_tables(docs, spark):
    empty, items = docs([]), spark.createDataFrame([], "item_id string, text string")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert simhash_dedup.near_duplicates(empty).count() == 0
    assert line_dedup.remove_lines(empty).count() == 0
    assert decontaminate.find_items(empty, items).count() == 0
    assert rows_of(decontaminate.digest(decontaminate.find_items(docs([(1, "a b")]), items)), "doc_id", "n_hit", "contaminated") == [(1, 0, False)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(-5, -9), (7, 7)]
    got = dict(tuple(r) for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {-5: -9, -9: -9}
