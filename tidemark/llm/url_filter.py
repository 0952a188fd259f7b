"""URL filters: a blocked Bloom filter before an exact hash join, in DataFrame functions only.

A rule lists a canonical (host, path) and says block or allow.  It fits its host and
all subdomains where the URL's path starts with the rule's path; of the rules that fit,
the one with most characters wins (on a tie the longer host, then block).

Each URL gives its canonical candidates: every suffix of its host by labels, with every prefix of
its path that is as long as some listed path.  The filter is split into blocks of one
64-bit word: a key sets and tests ``PROBES`` bits of one word, so a test reads one word.  Only
possible hits reach the join with the rules, which removes the false positives.  The
filter has at most ``MAX_WORDS`` words whatever the list's size; beyond about eight keys a
word it lets more candidates through to the join, and the result stays the same.

Defined cases: null URLs, and those without ``://``, have empty host and path and fit no
rule.  Without a fitting rule the verdict is ``default``: a list of blocked URLs allows
what it doesn't name.  Repeated rows give repeated results; rules with null host, path
or verdict are ignored; repeated rules count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rules of the registered query: host, path, verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
PROBES = 6
MAX_WORDS = 1 << 16
KEYS_PER_WORD = 6


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    scheme_end = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(scheme_end > 0, F.substring(url, scheme_end + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("word")), F.lit(words)).cast("int")


def _bits(key: Column) -> Column:
    """The bits of a key in its word, each from six bits of a second hash."""
    h = F.xxhash64(key, F.lit("bits"))
    out = F.lit(0).cast("long")
    for i in range(PROBES):
        at = F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))
    return out


def bloom_filter(keys: DataFrame, words: int) -> DataFrame:
    """One row ``filter array<bigint>`` of ``words`` words, from a column ``key``."""
    marked = keys.groupBy(_word(F.col("key"), words).alias("w")).agg(F.bit_or(_bits(F.col("key"))).alias("bits"))
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(marked, "w", "left")
    every = every.agg(F.sort_array(F.collect_list(F.struct("w", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")))).alias("all"))
    return every.select(F.col("all.bits").alias("filter"))


def candidates(host: Column, path: Column, lengths: Column) -> Column:
    """Every (suffix of the host by labels, prefix of the path of a listed length)."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(lengths, lambda n: n <= F.length(path))
    pair = lambda h, n: F.struct(h.alias("h"), F.substring(path, F.lit(1), n).alias("p"))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(fits, lambda n: pair(h, n))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``; ``rules`` has host, path, verdict."""
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("v"))
    rules = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), "v", F.concat("host", "path").alias("key"))
    listed = rules.agg(F.count("*").alias("n"), F.collect_set(F.length("p")).alias("lengths")).first()
    words = min(MAX_WORDS, listed["n"] // KEYS_PER_WORD + 1)
    lengths = F.array(*[F.lit(n) for n in sorted(listed["lengths"])]).cast("array<int>")
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("filter", bloom_filter(rules, words).scalar())

    def possible(k: Column) -> Column:
        key = F.concat(k["h"], k["p"])
        return F.get(F.col("filter"), _word(key, words)).bitwiseAND(_bits(key)) == _bits(key)

    urls = urls.select("page_id", "host", "path", F.filter(candidates(F.col("host"), F.col("path"), lengths), possible).alias("hits"))
    hits = urls.select("page_id", "host", "path", F.greatest(F.size("hits"), F.lit(1)).alias("per_row"), F.explode_outer("hits").alias("hit"))
    found = hits.join(rules, (F.col("hit.h") == F.col("h")) & (F.col("hit.p") == F.col("p")), "left")
    longest = F.struct(F.length("key").alias("n"), F.length("h").alias("host_n"), F.col("v"), F.col("key"))
    best = found.groupBy("page_id", "host", "path").agg(
        F.max(F.when(F.col("key").isNotNull(), longest)).alias("best"), (F.count("*") / F.max("per_row")).cast("int").alias("copies")
    )
    best = best.select("page_id", "host", "path", "best", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    listed = RULES if rules is None else rules
    rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(rule, ("host", "path", "verdict"), strict=True)]) for rule in listed]
    return spark.range(1).select(F.inline(F.array(*rows).cast("array<struct<host: string, path: string, verdict: string>>")))


ORACLE = """
WITH rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fits AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN fits USING (rid)
"""
