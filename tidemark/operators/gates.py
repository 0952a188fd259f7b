"""Filters, validation gates and rule tables as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

#: Titles of section pages, and tail words of landing pages' titles.
SECTIONS = [
    "economy", "finance", "markets", "market", "business", "news", "data", "analysis", "opinion", "world", "home", "sport", "sports", "technology", "tech", "politics", "money", "investing", "companies",
    "video", "podcasts",
]
TAILS = [
    "report", "data", "outlook", "projections", "overview", "statistics", "monthly", "finance", "markets", "market", "analysis", "index", "prices", "news", "home", "economy", "summary", "dashboard",
    "calendar", "sales", "sources", "profile", "charts", "tools", "guide",
]
LEAST_WORDS, LEAST_SENTENCES = 120, 3


def real_article(title: Column, body: Column, url: Column, path_rules: dict[str, str] | None = None) -> Column:
    """Whether a page is an article and no section, listing or landing page.

    ``path_rules`` maps a host to a pattern that its article URLs match.
    """
    name, text, link = F.coalesce(F.trim(title), F.lit("")), F.coalesce(body, F.lit("")), F.lower(F.coalesce(url, F.lit("")))
    low = F.trim(F.lower(name), F.lit(" |-—·"))
    core = F.split(F.element_at(F.split(name, r"\s+[|\-–—]\s+"), 1), r"\s+")
    tail = F.trim(F.lower(F.element_at(core, -1)), F.lit(":"))
    bad = [
        T.word_count(text) < LEAST_WORDS,
        T.prose_sentences(text) < LEAST_SENTENCES,
        name.rlike(r"(?i)\bpage\s+\d+\b|\|\s*page\s*\d+"),
        name.rlike(r"(?i)blockchain news|independent statistics|breaking news|latest news|news\s*-\s*page|home\s*page|all the latest"),
        low.isin(SECTIONS),
        (T.word_count(name) <= 2) & (name != "") & (F.upper(name) == name) & (F.lower(name) != name),
        (name != "") & (F.size(core) <= 5) & tail.isin(TAILS),
        *[F.contains(link, F.lit(host)) & ~link.rlike(pattern) for host, pattern in (path_rules or {}).items()],
    ]
    return ~reduce(lambda a, b: a | b, bad)


def between(column: str, low: object, high: object) -> Column:
    return F.col(column).between(low, high)


def match_any(column: str, values: list) -> Column:
    return F.col(column).isin(values)


def overlap(column: str, values: list) -> Column:
    return F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values]))


def filters(must: list[Column], should: list[Column] | None = None) -> Column:
    """All of ``must`` and, where given, any of ``should``."""
    every = reduce(lambda a, b: a & b, must, F.lit(True))
    return every & reduce(lambda a, b: a | b, should) if should else every


def first_rule(rules: list[tuple[str, str, str]], otherwise: str) -> Column:
    """Class of the first (column, pattern, class) whose pattern occurs, case aside."""
    return F.coalesce(*[F.when(F.lower(c).rlike(pattern), F.lit(cls)) for c, pattern, cls in rules], F.lit(otherwise))


def abstain(queries: DataFrame, hits: DataFrame, key: str, value: str, marker: object) -> DataFrame:
    """Hits of every query; one without gets the marker."""
    rows = queries.join(hits, key, "left")
    return rows.select(key, F.coalesce(value, F.lit(marker)).alias(value), F.col(value).isNull().alias("abstained"))


def contains_quote(texts: DataFrame, quotes: DataFrame, text_id: str, text: str, quote_id: str, quote: str) -> DataFrame:
    """Pairs of texts and the quotes they hold.

    A quote's longest inner word is a whole word of any text that holds it, so the words of the texts
    meet the quotes first, without the texts; these join back for the pairs that are left, and only
    then is containment tested.  Quotes without an inner word (two words at most) meet texts on the
    three-letter pieces at their start; those shorter than that are tested against every text,
    and are few, as there are few such strings.
    """
    inner = lambda c: F.slice(F.split(c, " ", -1), F.lit(2), F.greatest(F.size(F.split(c, " ", -1)) - 2, F.lit(0)))
    longest = F.array_max(F.transform(F.filter(inner(F.col(quote)), lambda w: (w != "") & ~F.contains(w, F.lit("\n"))), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    keyed = quotes.select(quote_id, quote, longest.alias("_word")).where(F.col(quote).isNotNull())
    told = texts.where(F.col(text).isNotNull())

    def tested(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(told.select(text_id, text), text_id).join(quotes.select(quote_id, quote), quote_id)
        return both.where(F.contains(text, F.col(quote))).select(text_id, quote_id).distinct()

    words = told.select(text_id, F.explode(F.array_distinct(F.split(text, r"[ \n]", -1))).alias("_word"))
    met = words.join(keyed.where("_word IS NOT NULL").select(quote_id, "_word"), "_word").select(text_id, quote_id)
    rest = keyed.where("_word IS NULL").select(quote_id, quote)
    if rest.isEmpty():
        return tested(met)
    starts = rest.where(F.length(quote) >= 3).select(quote_id, F.substring(quote, 1, 3).alias("_start"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(F.col(text), i, F.lit(3)))
    begun = told.where(F.length(text) >= 3).select(text_id, F.explode(F.array_distinct(pieces)).alias("_start"))
    begun = begun.join(starts.select("_start").distinct(), "_start", "left_semi").join(starts, "_start").select(text_id, quote_id)
    short = rest.where(F.length(quote) < 3)
    tiny = told.join(F.broadcast(short), F.contains(F.col(text), F.col(quote))).select(text_id, quote_id)
    return tested(met).union(tested(begun)).union(tiny)


#: Word stems that say which way something moved, in order of precedence.
DIRECTIONS = {
    "up": "jump|surg|soar|rall|rose|rise|gain|climb|advanc|up |higher|spike|boost",
    "down": "fell|fall|slid|slip|tumbl|plung|drop|sank|sink|decline|lower|down |loss|lost|retreat",
    "widen": "widen|blowout|blew out",
    "tighten": "tighten|narrow",
}


def direction_audit(tag: Column, phrase: Column) -> Column:
    """Whether a phrase agrees with the direction tagged for it."""
    said = F.coalesce(*[F.when(F.lower(phrase).rlike(p), F.lit(way)) for way, p in DIRECTIONS.items()])
    return F.when(tag.isNull() | said.isNull(), "unchecked").when(said == tag, "ok").otherwise("conflict")


def coverage_tier(docs: Column, floors: tuple[int, int, int, int] = (100, 20, 5, 1)) -> Column:
    out = F.when(docs >= floors[0], "deep")
    for floor, name in zip(floors[1:], ("partial", "thin", "token"), strict=True):
        out = out.when(docs >= floor, name)
    return out.otherwise("none")


def hit_matches(url: Column, any_url: list[str], title_pattern: str | None = None) -> Column:
    """Any listed part in the URL, or the pattern."""
    parts = [F.contains(url, F.lit(p)) for p in any_url] + ([url.rlike(title_pattern)] if title_pattern else [])
    return reduce(lambda a, b: a | b, parts, F.lit(False))
