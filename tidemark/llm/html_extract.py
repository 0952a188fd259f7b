"""HTML extraction: a recurrent labeller of text blocks.

A page is cut into leaf blocks, the texts between block-level tags, in page order.
Each block is a vector: hashed names, classes, ids and roles of its tag path, hashed words
of its text, and a few numbers (length, links, punctuation, place in the page).  A
bidirectional LSTM in numpy reads the whole sequence and labels every block as main text
or not, so a block is judged by the document around it.  The texts of the blocks that
it keeps, in page order and joined by newlines, are the result.

The weights are trained once on the driver on pages made from templates: a fixed number
of them, from a seed, so training costs the same for any corpus and never reads one.
They reach the tasks as a broadcast of fixed size.

What is never text, whatever the labels: head, scripts, styles, comments, templates.
White space inside a block becomes one space.  ``<br>`` is white space.

Defined cases: null and empty html give an empty text.  Markup cut off anywhere counts
as far as it goes.  Pages are handled alone, so repeated rows repeat; a page without
blocks has an empty text.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import prepare

PATH_DIMS, WORD_DIMS, NUMBERS = 128, 32, 8
INPUTS = PATH_DIMS + WORD_DIMS + NUMBERS
HIDDEN, PAGES, EPOCHS, SEED, LEARN = 16, 600, 10, 7, 0.01
TOGETHER = 64
#: Inputs of a batch of pages, padding included, unless one page alone has more; steps whose gates are computed at once.
CELLS, STEPS = 1 << 22, 2048

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = set("script style noscript template iframe svg math object canvas textarea title head select".split())
#: A block-level start tag ends an open paragraph.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int
    label: str | None = None


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], str | None]] = []
    parts: list[str] = []
    linked = links = 0
    page = page or ""
    at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                names = tuple(n for _, own, _ in stack for n in own)
                label = next((x for _, _, x in reversed(stack) if x), None)
                out.append(Block(names, text, linked, label))
            parts.clear()
        linked = 0

    def leave(index: int) -> None:
        nonlocal links
        links -= sum(tag == "a" for tag, _, _ in stack[index:])
        del stack[index:]

    while at < len(page):
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            piece = page[at:stop]
            parts.append(piece)
            linked += len(piece) if links else 0
        if not found:
            break
        at = found.end()
        closing, tag, rest = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag not in INLINE:
                flush()
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if index is not None and (tag not in INLINE or all(t in INLINE for t, _, _ in stack[index:])):
                leave(index)
            continue
        if tag in RAW and not rest.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|$)", re.I).search(page, at)
            if end or tag != "head":
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in INLINE:
            flush()
            ended = CLOSES.get(tag, set()) | {"p"}
            index = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] in ended), None)
            if index is not None and all(t in INLINE or t in ended for t, _, _ in stack[index:]):
                leave(index)
        if tag in VOID or rest.endswith("/"):
            continue
        own, label = [tag], None
        for name, *values in _ATTRIBUTE.findall(rest):
            value = next(filter(None, values), "")
            if name.lower() == "data-label":
                label = value
            else:
                own += [f"{tag}.{n}" for n in _NAME.findall(value.lower())] + [f".{n}" for n in _NAME.findall(value.lower())]
        links += tag == "a"
        stack.append((tag, tuple(own), label))
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIMS, np.float32)
    for name in path:
        v[zlib.crc32(name.encode()) % PATH_DIMS] = 1
    return v


def vectors(found: list[Block]) -> np.ndarray:
    """One input row for each block of a page."""
    out = np.zeros((len(found), INPUTS), np.float32)
    for i, b in enumerate(found):
        raw = b.text.encode()
        words = raw.lower().split()
        out[i, :PATH_DIMS] = _path_vector(b.path)
        slots = np.bincount([zlib.crc32(w) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = slots / max(1, len(words))
        stops = sum(map(raw.count, (b".", b"!", b"?")))
        out[i, PATH_DIMS + WORD_DIMS :] = (
            np.log1p(len(words)) / 5, min(1, b.linked / max(1, len(b.text))), min(1, 5 * stops / max(1, len(words))), min(1, 5 * raw.count(b",") / max(1, len(words))),
            i / len(found), np.log1p(len(found)) / 5, raw[-1:] in b".!?", b"\xc2\xa9" in raw,
        )
    return out


@dataclass
class Labeller:
    """Weights of the two directions (inputs, recurrent, bias) and of the output."""

    weights: list[np.ndarray]

    @classmethod
    def start(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        one = lambda: [draw(INPUTS, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), np.repeat(np.float32([0, 1, 0, 0]), HIDDEN)]
        return cls([*one(), *one(), draw(2 * HIDDEN, 1), np.zeros(1, np.float32)])

    def _run(self, x: np.ndarray, mask: np.ndarray, side: int, keep: bool = True) -> tuple[np.ndarray, list]:
        """Hidden states of one direction for (pages, steps, inputs), and, if asked, what the backward pass needs.

        Steps go in windows of ``STEPS`` that hand on their state, so memory beyond the
        states themselves does not grow with a page.
        """
        w, u, b = self.weights[3 * side : 3 * side + 3]
        pages, steps, _ = x.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        states, kept = np.zeros((pages, steps, HIDDEN), np.float32), []
        lo, into = -1, x[:, :0] @ w
        for t in range(steps) if not side else range(steps - 1, -1, -1):
            if t // STEPS != lo:
                lo = t // STEPS
                into = x[:, lo * STEPS : (lo + 1) * STEPS] @ w + b
            z = into[:, t - lo * STEPS] + h @ u
            i, f, o = (1 / (1 + np.exp(-z[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN :])
            on = mask[:, t, None]
            c_new = on * (f * c + i * g)
            squashed = np.tanh(c_new)
            if keep:
                kept.append((t, h, c, i, f, o, g, squashed, on))
            h, c = on * o * squashed, c_new
            states[:, t] = h
        return states, kept

    def margins(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, side, keep=False)[0] for side in (0, 1)], 2)
        return (both @ self.weights[6] + self.weights[7])[..., 0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        runs = [self._run(x, mask, side) for side in (0, 1)]
        both = np.concatenate([r[0] for r in runs], 2)
        margin = (both @ self.weights[6] + self.weights[7])[..., 0]
        d = ((1 / (1 + np.exp(-margin)) - y) * mask / mask.sum())[..., None].astype(np.float32)
        out = [np.einsum("pth,pto->ho", both, d), d.sum((0, 1))]
        back = d @ self.weights[6].T
        grads = []
        for side, (_, kept) in enumerate(runs):
            u = self.weights[3 * side + 1]
            gw, gu, gb = (np.zeros_like(v) for v in self.weights[3 * side : 3 * side + 3])
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            for t, h0, c0, i, f, o, g, squashed, on in reversed(kept):
                dh = (dh + back[:, t, side * HIDDEN : (side + 1) * HIDDEN]) * on
                dc = (dc + dh * o * (1 - squashed**2)) * on
                dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1)
                gw += x[:, t].T @ dz
                gu += h0.T @ dz
                gb += dz.sum(0)
                dh, dc = dz @ u.T, dc * f
            grads += [gw, gu, gb]
        return grads + out

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            # Sorted by length, so the last page of a batch is what the others are padded to.
            n = max([1, *(k for k in range(1, min(TOGETHER, len(order)) + 1) if k * len(pages[order[k - 1]]) * INPUTS <= CELLS)])
            part, order = order[:n], order[n:]
            x, mask = _padded([vectors(pages[i]) for i in part])
            for i, m in zip(part, self.margins(x, mask), strict=True):
                out[i] = m[: len(pages[i])] > 0
        return out


def _padded(inputs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, inputs))
    x, mask = np.zeros((len(inputs), steps, INPUTS), np.float32), np.zeros((len(inputs), steps), np.float32)
    for i, v in enumerate(inputs):
        x[i, : len(v)], mask[i, : len(v)] = v, 1
    return x, mask


#: Words of the template pages: classes of what is not main text, and of what is.
OTHER = {
    "nav": "nav menu navbar navigation breadcrumb topnav links", "header": "header masthead banner top branding logo", "footer": "footer bottom copyright legal colophon",
    "aside": "sidebar aside related recommended widget trending popular", "div.ad": "ad ads advert advertisement promo sponsor sponsored banner adbox", "div.notice": "notice cookie consent alert gdpr popup modal message",
    "form": "form newsletter subscribe login search signup contact", "section.comments": "comments comment reply replies discussion responses disqus", "div.share": "share social tags pagination pager tools",
}
MAIN = "content article post entry story main body text page-content".split()
_LABELS = "Home About Contact Login Search Subscribe Share Tweet Next Previous Menu News Sports Privacy Terms Cookies Accept Reply More Archive Tags".split()


def template_page(rng: np.random.Generator) -> str:
    """A made page whose elements say by ``data-label`` whether they are main text."""
    syllables = [a + v + c for a in "bdfglmnprstv" for v in "aeiou" for c in ("", "n", "r", "s")]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    some = lambda p: rng.random() < p

    def prose(lo: int, hi: int) -> str:
        """Made sentences; some are odd: one word over and over, marks after words, capitals."""
        words = [word() for _ in range(rng.integers(lo, hi))]
        if some(0.1):
            words = [words[i // 6 * 6] for i in range(len(words))]
        marks = ["%%%", "###", "***", "$$$", "&amp;&amp;&amp;", " |", "!!"] if some(0.15) else ["", "", "", "", ",", "."]
        text = " ".join(w + rng.choice(marks) for w in words)
        return (text.upper() if some(0.05) else text.capitalize()) + rng.choice([".", ".", "", "?"])


    def other(kind: str) -> str:
        tag, _, _ = kind.partition(".")
        names = OTHER[kind].split()
        if tag in ("nav", "header", "footer", "aside", "form") and some(0.3):
            tag = "div"
            named = f' {rng.choice(["class", "id"])}="{rng.choice(names)}"'
        else:
            named = f' class="{rng.choice(names)}"' if tag in ("div", "section") or some(0.4) else ""
        style = rng.integers(4)
        if style == 0:
            inner = "<ul>" + "".join(f'<li><a href="/{word()}">{rng.choice(_LABELS) if some(0.5) else word()}</a></li>' for _ in range(rng.integers(2, 9))) + "</ul>"
        elif style == 1:
            inner = "".join(f"<p>{prose(3, 30)}</p>" for _ in range(rng.integers(1, 4)))
        elif style == 2:
            inner = prose(2, 14)
        else:
            inner = f"<h3>{prose(1, 4)}</h3><div>{prose(3, 20)}</div>"
        if kind == "footer":
            inner = rng.choice(["&copy; ", ""]) + inner
        return f'<{tag}{named} data-label="0">{inner}</{tag}>'

    def body() -> str:
        out = [f"<h1>{prose(2, 9)}</h1>"] if some(0.9) else []
        for _ in range(rng.integers(1, 25)):
            kind = rng.integers(12)
            if kind < 7:
                out.append(f"<p>{prose(1, 4) if some(0.35) else prose(4, 90)}</p>")
            elif kind < 8:
                out.append(f"<p><b>{prose(2, 9)}<br>")
            elif kind < 9:
                out.append(f"<h2>{prose(1, 6)}</h2>")
            elif kind < 10:
                out.append("<ul>" + "".join(f"<li>{prose(2, 14)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>")
            elif kind < 11:
                out.append(f"<blockquote><p>{prose(5, 40)}</p></blockquote>")
            else:
                out.append(other(rng.choice(["div.ad", "aside", "form", "div.share", "div.notice"])))
        return "".join(out)

    shell = rng.integers(4)
    name = rng.choice(MAIN)
    main = {0: ("<article>", "</article>"), 1: (f'<div class="{name}">', "</div>"), 2: ("<main><article>", "</article></main>"), 3: (f'<main><div id="{name}">', "</div></main>")}[int(shell)]
    inner = body() + (other("section.comments") if some(0.25) else "")
    lead = [other(k) for k in ("header", "nav", "div.ad", "div.notice", "aside", "form") if some(0.5)]
    tail = [other(k) for k in ("section.comments", "aside", "div.share", "div.ad", "form", "footer") if some(0.5)]
    rng.shuffle(lead)
    head = main[0][:-1] + ' data-label="1">'
    return f"<html><head><title>{prose(2, 6)}</title></head><body>{''.join(lead)}{head}{inner}{main[1]}{''.join(tail)}</body></html>"


@lru_cache(maxsize=1)
def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Weights after ``epochs`` over ``pages`` template pages, by Adam."""
    rng = np.random.default_rng(seed)
    made = [blocks(template_page(rng)) for _ in range(pages)]
    made = [p for p in made if p]
    inputs, labels = [vectors(p) for p in made], [np.float32([b.label == "1" for b in p]) for p in made]
    model = Labeller.start(seed)
    first, second, step = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], 0
    for epoch in range(epochs):
        rate = LEARN * (1 - epoch / epochs)
        order = np.array(sorted(range(len(made)), key=lambda i: len(made[i]) + 6 * rng.random()))
        parts = [order[i : i + 16] for i in range(0, order.size, 16)]
        for k in rng.permutation(len(parts)):
            x, mask = _padded([inputs[i] for i in parts[k]])
            y = np.zeros_like(mask)
            for row, i in enumerate(parts[k]):
                y[row, : len(labels[i])] = labels[i]
            step += 1
            for w, g, m, v in zip(model.weights, model.gradients(x, mask, y), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def extract(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` for each row of ``pages``."""
    spark: SparkSession = pages.sparkSession
    prepare(spark)
    shared = spark.sparkContext.broadcast(model or train())

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lo in range(0, rows.num_rows, TOGETHER):
                part = rows.slice(lo, TOGETHER)
                found = [blocks(x) for x in part.column(2).to_pylist()]
                kept = shared.value.label(found)
                texts = ["\n".join(b.text for b, k in zip(f, ks.tolist(), strict=True) if k) for f, ks in zip(found, kept, strict=True)]
                counts = [pa.array(x, pa.int64()) for x in (map(len, texts), map(len, found), (int(k.sum()) for k in kept))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), *counts], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    return pages.select("page_id", "url", "html").mapInArrow(extracted, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_blocks long, n_kept long")


def by_article(page: str | None) -> str:
    """Main text by the article element alone; for tests on pages that have one."""
    return "\n".join(b.text for b in blocks(page) if "article" in b.path and not {"nav", "aside", "form", "header", "footer"} & set(b.path))
