"""Classifier, extraction, URLs, chat, pieces and media."""

import random
import struct

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, html_extract, media_matroska, quality_classifier, sentence_pieces, textkit, url_filter


def test_word_kernels_match_plain_python(corpus):
    texts = [t for _, t in corpus]
    data, offsets = textkit.text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = textkit.split_words(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first, first[1:], strict=False)]
    assert got == [(t or "").encode().split() for t in texts]
    hashes = textkit.hash_words(data, starts, ends)
    kinds = {}
    for h, a, b in zip(hashes.tolist(), starts, ends, strict=True):
        assert kinds.setdefault(raw[a:b], h) == h
    assert len(set(kinds.values())) == len(kinds)


def test_majority_bits_of_long_groups():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 1500, np.uint64)
    counts = np.array([0, 1, 2, 600, 0, 897])
    got = textkit.majority_bits(hashes, np.cumsum(counts) - counts, counts)
    at = 0
    for g, n in zip(got.tolist(), counts, strict=True):
        part = hashes[at : at + n].tolist()
        at += n
        assert g == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in part) > n)


@pytest.fixture(scope="module")
def sf(spark):
    return lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")


def test_classifier_on_held_out_rows(sf):
    labels = sf("labels")
    scored = quality_classifier.digest(sf("documents"), labels).join(labels.groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in scored) / len(scored)
    kept = [r.predicted for r in scored if r.quality == 1]
    caught = [1 - r.predicted for r in scored if r.quality == 0]
    assert right > 0.95 and np.mean(kept) > 0.98 and np.mean(caught) > 0.8


def test_classifier_odd_inputs(docs, spark, corpus):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_classifier.digest(docs(corpus, ["score"]), none).collect()
    assert len(got) == len(corpus) and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(3, None, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert all(0.5 < r.score <= 1 for r in quality_classifier.digest(docs(corpus), one).collect())
    assert quality_classifier.digest(docs([]), none).count() == 0


def plain_statistics(text):
    """The classifier's statistics of one text, word by word."""
    raw = text.encode()
    kinds = [quality_classifier._CLASS[b] for b in raw]
    n = max(len(raw), 1)
    shares = [kinds.count(k) / n for k in range(len(quality_classifier._CLASSES))]
    words = raw.split()
    some = max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / some
    spread = max(0.0, sum(v * v for v in lengths) / some - mean * mean) ** 0.5
    counts = {w: words.count(w) for w in set(words)}
    same = [a == b for a, b in zip(words, words[1:], strict=False)]
    longest = run = 0
    for again in same:
        run = run + 1 if again else 0
        longest = max(longest, run)
    pairs = set(zip(words, words[1:], strict=False))
    lead = lambda w: 65 <= w[0] <= 90
    shout = [lead(w) and len(w) > 1 and 65 <= w[1] <= 90 for w in words]
    lines = [v for v in raw.split(b"\n") if v]
    closed = sum(v[-1:] in (b".", b"?", b"!") for v in lines)
    return [
        *shares, np.log1p(len(words)), mean, spread, len(counts) / some, max(counts.values(), default=0) / some, sum(same) / some, longest,
        len(pairs) / max(len(words) - 1, 1), sum(map(lead, words)) / some, sum(shout) / some,
        np.log1p(len(lines)), len(words) / max(len(lines), 1), len(set(lines)) / max(len(lines), 1), closed / max(len(lines), 1),
    ]


def test_statistics_equal_plain_python(corpus):
    texts = [t for _, t in corpus if t is not None] + ["a a a b b", "STOP! Now.\n\nYES? no\n", "x" * 3000, "\n", "A B", "word " * 20_000]
    data, offsets = textkit.text_buffer(pa.array(texts))
    got = quality_classifier.statistics(data, offsets)
    assert got.shape == (len(texts), len(quality_classifier.STATISTICS))
    assert np.allclose(got, np.array([plain_statistics(t) for t in texts]))


def test_trees_fit_and_are_repeatable():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    a, b = quality_classifier.grow(x, y), quality_classifier.grow(x, y)
    assert np.array_equal(a.score(x), b.score(x)) and ((a.score(x) > 0.5) == y).mean() > 0.95


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy this now.</div>
<article><h1>A title of this text</h1><p>First &amp; <b>bold</b>\n words go here, and more of them follow.<p>Second paragraph<br>has a break &lt;here&gt;.</p></article>
<footer>&copy; Someone</footer></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, "w", ""), (4, "x", PAGE[: PAGE.index("Second") + 6])], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert got[1].text == "A title of this text\nFirst & bold words go here, and more of them follow.\nSecond paragraph has a break <here>."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == ""
    assert got[4].text.endswith("Second")


def test_labeller_on_pages_it_never_saw():
    rng = np.random.default_rng(1234)
    pages = [p for p in (html_extract.blocks(html_extract.template_page(rng)) for _ in range(150)) if p]
    kept = html_extract.train().label(pages)
    right = sum(int((k == np.array([b.label == "1" for b in p])).sum()) for k, p in zip(kept, pages, strict=True))
    assert right / sum(map(len, pages)) > 0.97


def test_extraction_of_the_given_pages(sf):
    got = html_extract.extract(sf("pages").where("page_id % 10 = 0")).collect()
    html = {r.page_id: r.html for r in sf("pages").where("page_id % 10 = 0").collect()}
    assert sum(r.text == html_extract.by_article(html[r.page_id]) for r in got) >= 0.99 * len(got)


def test_gradients_match_differences():
    rng = np.random.default_rng(2)
    model = html_extract.Labeller.start(1)
    model.weights = [w.astype(float) for w in model.weights]
    x, mask = rng.standard_normal((2, 3, html_extract.INPUTS)), np.array([[1.0, 1, 1], [1, 1, 0]])
    y = np.array([[1.0, 0, 1], [0, 1, 0]])
    loss = lambda: float((np.log1p(np.exp(-(2 * y - 1) * model.margins(x, mask))) * mask).sum() / mask.sum())
    grads = model.gradients(x, mask, y)
    for w, g in zip(model.weights, grads, strict=True):
        at = tuple(rng.integers(0, n) for n in w.shape)
        before = w[at]
        w[at] = before + 1e-3
        up = loss()
        w[at] = before - 1e-3
        down = loss()
        w[at] = before
        assert abs((up - down) / 2e-3 - g[at]) < 1e-3


URLS = [
    (1, "https://a.net/x"), (2, "https://WWW.example.NET/en/1?q"), (3, "http://x.example.com/de/1#f"), (4, "http://notexample.com/de/"), (5, "https://b.org/fr/"), (6, "https://b.org/fr"),
    (7, None), (8, "no scheme/net/"), (9, "https://net"), (10, "https://net/"), (11, "ftp://q.net?x=/"), (12, "https://"), (2, "https://WWW.example.NET/en/1?q"), (None, "https://c.net/a"), (13, "https://x.org:80/fr/\nz"),
]


def test_urls_against_sql(spark):
    pages = spark.createDataFrame([(i, u, "z", "mine") for i, u in URLS], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in url_filter.judge(pages, url_filter.rule_table(spark)).collect()), key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [list(r) for r in URLS])
    assert got == sorted(con.execute(url_filter.ORACLE).fetchall(), key=repr)


def test_bloom_filter_only_saves_work(spark, monkeypatch):
    rng = random.Random(6)
    rules = [(f"h{i}.org", rng.choice(["/", "/a/", "/bb/"]), rng.choice(["block", "allow"])) for i in range(300)]
    pages = spark.createDataFrame([(i, f"https://s.h{rng.randrange(600)}.org{rng.choice(['/', '/a/x', '/bb/y', ''])}") for i in range(400)], "page_id long, url string")
    wide = sorted(map(tuple, url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()))
    monkeypatch.setattr(url_filter, "MAX_WORDS", 1)
    full = sorted(map(tuple, url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()))
    listed = {(h, p) for h, p, _ in rules}
    assert wide == full
    for _, host, path, rule, _ in wide:
        fits = [h + p for h, p in listed if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert rule == (max(fits, key=len) if fits else None)


def test_urls_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, url_filter.rule_table(spark)).count() == 0
    pages = spark.createDataFrame([(1, "https://a.net/")], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.rule_table(spark).where("1 = 0")).first().verdict == "allow"


HARD = ["", "plain", "<|im_end|>", "<|im_start|>user\nx<|im_end|>\n", "\\", "\\\\", "<\\|", "<\\\\|", "\\<|", "<", "<<||", "a\n\nb", "n\\n", "<|im_end|>\n<|im_start|>assistant\nok", None]


def test_chat_round_trip(spark):
    rows = [(c, k, r, HARD[(c * 3 + k) % len(HARD)]) for c in range(20) for k, r in enumerate(["user", "assistant", "user", "assistant"][: c % 4 + 1])]
    rows += [(50, 1, "sys\ntem\\n<|", "odd role"), (50, None, None, None), (50, 1, "user", "tie"), (50, 1, "user", "tie"), (None, 0, "user", "null conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [(x.role, x.text) for x in r.turns] for r in chat_format.read_back(chat_format.format_conversations(df)).collect()}
    want: dict = {}
    key = lambda v: (v is not None, v)
    for c, t, r, x in sorted(rows, key=lambda v: (key(v[0]), key(v[1]), v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert got == want


def test_chat_against_sql(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", HARD[3]), (1, 2, "assistant", HARD[13]), (2, 0, "assistant", "early"), (3, 0, "user", None), (4, 0, "user", "a"), (4, 1, "user", "b"), (5, 0, "tool", "\\<|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(r) for r in rows])
    found = con.execute(chat_format.ORACLE)
    names = [d[0] for d in found.description]
    got = chat_format.digest(chat_format.format_conversations(chat_format.with_extra(df))).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(found.fetchall())
    valid = {r.conv_id: r.valid for r in got.collect()}
    assert valid == {-1: True, 1: True, 2: False, 3: False, 4: False, 5: False}


@pytest.fixture(scope="module")
def pieces():
    return sentence_pieces.Pieces.load()


def test_pieces_round_trip(docs, corpus, pieces):
    rows = corpus + [(300, "  two  spaces "), (301, " "), (302, "\n\n a\tb\r\n"), (303, "\x00 <0x0A> <s> ▁▁x"), (304, "日本語 and Ελλάδα, done.")]
    got = {r.doc_id: r for r in sentence_pieces.decode(sentence_pieces.encode(docs(rows, ["ids"]), pieces, 50), pieces).collect()}
    assert {i: got[i].decoded for i, _ in rows} == dict(rows)
    assert got[100].ids is None and got[101].ids == []


def test_dictionary_and_fold_agree(docs, corpus, pieces):
    df = docs(corpus)
    for r in sentence_pieces.dictionary(df, pieces, 400).collect():
        assert r.ids == pieces.fold(r.unit)
    small, large = ({r.doc_id: r.ids for r in sentence_pieces.encode(df, pieces, n).collect()} for n in (1, 1000))
    assert small == large


@pytest.mark.parametrize("text", ["the cat", "thation,", "x.y", "été", "a\nb", "▁", "12.5", "ab cd"])
def test_best_of_all_segmentations(pieces, text):
    units = [u for w in __import__("regex").findall(r" *[^ ]+| +", " " + text) for u in __import__("regex").split(pieces.cut, w) if u]
    ids = [i for u in units for i in pieces.fold(u)]
    score = lambda ids: sum(pieces.scores.get(pieces.decoded[i].decode(errors="ignore"), 0) if i not in pieces.byte_ids else 0 for i in ids)
    best, best_ids = sentence_pieces.brute_force(text, pieces)
    missing = sum(1 for i in best_ids if i in pieces.byte_ids)
    assert sum(1 for i in ids if i in pieces.byte_ids) == missing
    assert score(ids) == score(best_ids)
    assert best <= 0


def test_media(docs, corpus):
    got = {r.doc_id: r for r in media_matroska.digest(media_matroska.store(docs(corpus, ["media", "packets"]))).collect()}
    import hashlib
    import zlib

    for i, t in corpus:
        payload = media_matroska.pad((t or "").encode())
        assert got[i].payload_sha256 == hashlib.sha256(payload).hexdigest() and got[i].tail_crc32 == zlib.crc32(payload[-64:])
        assert got[i].payload_bytes == len(payload) and len(payload) % 64 == 0 and got[i].n_bytes == len((t or "").encode())
    assert got[104].media_sha256 == got[105].media_sha256


def unsized(ident, body):
    return ident.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body


def test_clusters_of_unknown_size():
    """A live stream: clusters without sizes, cues after them, and a second segment."""
    e, u, m = media_matroska._element, media_matroska._uint, media_matroska
    cluster = lambda time, data: unsized(m.CLUSTER, u(m.TIMESTAMP, time) + e(m.SIMPLE_BLOCK, b"\x81\0\0\x80" + data))
    cues = e(m.CUES, e(m.CUE_POINT, u(m.CUE_TIME, 7) + e(m.CUE_POSITIONS, u(m.CUE_TRACK, 1) + u(m.CUE_CLUSTER, 3))))
    tags = e(0x1254C367, b"")
    body = m._TRACKS + cluster(0, b"one") + cluster(5, b"two") + tags + cluster(9, b"three") + cues
    media = m._HEADER + unsized(m.SEGMENT, body) + m._HEADER + unsized(m.SEGMENT, cluster(1, b"four"))
    packets, found, error = m.packet_rows(media)
    assert error is None and [(p[1], media[p[3] : p[3] + p[4]]) for p in packets] == [(0, b"one"), (5, b"two"), (9, b"three"), (1, b"four")]
    assert found == [(7, 1, len(m._HEADER) + 12 + 3)]
    # Known and unknown sizes mixed, and a file that ends in the middle of a block.
    sized = e(m.CLUSTER, u(m.TIMESTAMP, 2) + e(m.SIMPLE_BLOCK, b"\x81\0\0\x80six"))
    packets, _, error = m.packet_rows(m._HEADER + unsized(m.SEGMENT, cluster(0, b"five") + sized + cluster(3, b"seven"))[:-2])
    assert len(packets) == 2 and error and "past its parent" in error


def test_packets_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None), (2, bytearray(b"")), (3, bytearray(b"junk"))], "packets long, media binary")
    got = media_matroska.packets(df).collect()
    assert [r.error is None for r in got] == [False] * 3 and all(r.packets == [] and r.cues == [] for r in got)
    assert media_matroska.packets(df.limit(0)).count() == 0
    assert media_matroska.digest(media_matroska.store(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


@pytest.mark.parametrize("size", [64, 512, 576, 4096, 4160, 65536, 70016])
def test_packet_table_covers_the_payload(size):
    payload = random.Random(size).randbytes(size)
    media = media_matroska.mux(payload)
    packets, cues, error = media_matroska.packet_rows(media)
    assert error is None and b"".join(media[o : o + n] for *_, o, n in packets) == payload
    assert len(cues) == -(-size // 65536) and all(media[o : o + 4] == bytes.fromhex("1f43b675") for *_, o in cues)
    assert [t for _, t, *_ in packets] == sorted(t for _, t, *_ in packets)


def test_every_lacing_and_unknown_sizes():
    e, u = media_matroska._element, media_matroska._uint
    frames = [b"a" * 300, b"b" * 20, b"c" * 700, b"d" * 5]
    xiph = bytes([3]) + b"\xff\x2d" + b"\x14" + b"\xff\xff\xbe" + b"".join(frames)
    flags, ebml = media_matroska._lace(frames)
    block = lambda f, body: e(0xA3, b"\x81" + struct.pack(">hB", -2, 0x80 | f) + body)
    group = e(0xA0, e(0xA1, b"\x82" + struct.pack(">hB", 7, 0) + b"solo"))
    cluster = bytes.fromhex("1f43b675") + b"\x01" + b"\xff" * 7 + u(0xE7, 1000) + block(0x02, xiph) + block(flags, ebml) + group
    media = media_matroska._HEADER + bytes.fromhex("18538067") + b"\x01" + b"\xff" * 7 + cluster
    packets, _, error = media_matroska.packet_rows(media)
    assert error is None and [media[o : o + n] for *_, o, n in packets] == frames + frames + [b"solo"]
    assert [p[:2] for p in packets] == [(1, 998)] * 8 + [(2, 1007)]


def test_broken_media():
    media = media_matroska.mux(bytes(4096))
    for cut in range(0, len(media), 97):
        packets, _, error = media_matroska.packet_rows(media[:cut])
        assert error or not packets
    assert media_matroska.packet_rows(None)[2] == "no data"


def test_long_pages_stay_within_memory():
    """A page of very many blocks among small ones: bounded memory, and the same labels as alone."""
    import tracemalloc

    long = html_extract.blocks("<html><body><article>" + "".join(f"<p>word{i % 97} of it, and more.</p>" for i in range(20_000)) + "</article></body></html>")
    small = [html_extract.blocks(PAGE) for _ in range(63)]
    model = html_extract.Labeller.start(3)
    assert len(long) == 20_000
    tracemalloc.start()
    found = model.label([long, *small])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    assert found[0].size == 20_000 and all((x == found[1]).all() for x in found[2:])
    assert (model.label(small[:1])[0] == found[1]).all()


def test_windows_of_steps_give_the_same_margins(monkeypatch):
    rng = np.random.default_rng(4)
    model = html_extract.Labeller.start(2)
    x, mask = rng.standard_normal((3, 11, html_extract.INPUTS)).astype(np.float32), np.ones((3, 11), np.float32)
    whole = model.margins(x, mask)
    monkeypatch.setattr(html_extract, "STEPS", 4)
    assert np.allclose(model.margins(x, mask), whole, atol=1e-5)


def test_html_empty_table_and_extra_columns(spark):
    columns = "page_id long, url string, html string, text string, n_chars string"
    assert html_extract.extract(spark.createDataFrame([], columns)).count() == 0
    got = html_extract.extract(spark.createDataFrame([(1, "u", PAGE, "mine", "x"), (1, "u", PAGE, "mine", "x")], columns)).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].text != "mine"


def test_pieces_empty_table_and_repeated_rows(docs):
    assert sentence_pieces.digest(docs([])).count() == 0
    got = sentence_pieces.digest(docs([(1, "some words"), (1, "some words"), (None, None)])).collect()
    assert len(got) == 3 and sum(r.lossless for r in got) == 3 and len({r.ids_sha256 for r in got if r.doc_id}) == 1


def test_pieces_of_a_partial_dictionary(docs):
    """Whatever the dictionary's size, the ids are the same."""
    rows = [(i, f"common words here and a rare{i}word, once.") for i in range(12)]
    want = None
    for size in (0, 5, 1 << 18):
        got = sorted((r.doc_id, r.ids) for r in sentence_pieces.encode(docs(rows), size=size).collect())
        want = want or got
        assert got == want
