"""Names of entities to traded symbols, by kinds of match in a fixed order of trust.

1. macro: the plain name, without market words, or without a leading country word, is a macro name;
2. listed_exact: the plain name is that of a listed security (companies and the like only);
3. listed_near: it shares a word of four letters or more with a listed name and differs from it in
   at most a tenth of the letters;
4. factor: an abstract kind whose name holds a keyword, in the order of the rules.

Macro names, listings and rules are tables.  Distinct plain names are matched, not entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.temporal import first_per_key

# Words that are no part of a name, market words, leading words, kinds by the matches they may have.
SUFFIXES = "inc corp corporation co ltd plc llc llp sa ag nv group holding holdings the company ord adr spon"
MARKET_WORDS = "futures prices price markets market index"
LEADING = ["u s", "us", "the"]
LISTED_KINDS = ["company", "bank", "exchange", "regulator", "other"]
FACTOR_KINDS = ["other", "economic_indicator", "sector", "rate_or_bond", "asset_class", "market", "commodity", "currency"]
TRADEABLE_KINDS = ["company", "bank", "equity_index", "commodity", "currency", "exchange", "central_bank", "sovereign", "rate_or_bond", "economic_indicator", "asset_class"]

#: Share of letters that may differ, letters of an indexed word, and rules at most, as they travel with each row.
APART, WORD, MOST_RULES = 0.1, 4, 1000


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def plain(name: Column) -> Column:
    """Lower case, letters and digits only, without company words."""
    low = F.regexp_replace(F.replace(F.lower(F.coalesce(name, F.lit(""))), F.lit("&"), F.lit(" and ")), "[^a-z0-9 ]", " ")
    return squeezed(F.regexp_replace(low, rf"\b({SUFFIXES.replace(' ', '|')})\b", " "))


def variants(nm: Column) -> Column:
    """The forms of a plain name that a macro name may have, in order."""
    words = squeezed(F.regexp_replace(nm, rf"\b({MARKET_WORDS.replace(' ', '|')})\b", " "))
    return F.array(nm, words, squeezed(F.regexp_replace(nm, f"^({'|'.join(LEADING)}) ", "")))


def _first_symbols(names: DataFrame) -> DataFrame:
    """``nm, symbol``: the least symbol of each plain name."""
    return names.select(plain(F.col("name")).alias("nm"), "symbol").where("nm <> ''").groupBy("nm").agg(F.min("symbol").alias("symbol"))


def near_names(names: DataFrame, listed: DataFrame) -> DataFrame:
    """``nm, listed, apart``: pairs of ``nm`` and a listed name within ``APART`` of the longer one's letters that share a word.

    Pairs meet on the shared word and the length that the listed name may have.  Each edit breaks two
    words at most, so of a name's words only as many of the rarest are tried as the edits allow
    may break, and one more.
    """
    long_words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda t: F.length(t) >= WORD))
    theirs = listed.select(F.col("nm").alias("listed"), F.explode(long_words(F.col("nm"))).alias("word")).withColumn("size", F.length("listed"))
    rare = theirs.groupBy("word").agg(F.count("*").alias("df"))
    n = F.length("nm")
    edits = F.floor(n * APART / (1 - APART))
    ours = names.select("nm", F.explode(long_words(F.col("nm"))).alias("word")).join(rare, "word").withColumn("edits", edits)
    kept = F.expr("slice(array_sort(collect_list(struct(df, word))), 1, max(2 * int(edits) + 1)).word")
    ours = ours.groupBy("nm").agg(kept.alias("words"), F.max("edits").cast("int").alias("edits")).where("edits > 0")
    ours = ours.select("nm", "edits", F.explode("words").alias("word")).select("nm", "word", F.explode(F.sequence(F.length("nm") - F.col("edits"), F.length("nm") + F.col("edits"))).alias("size"))
    both = ours.join(theirs, ["word", "size"]).select("nm", "listed").distinct()
    apart = F.levenshtein("nm", "listed")
    return both.withColumn("apart", apart).where(F.col("apart") <= APART * F.greatest(F.length("nm"), F.length("listed")))


def factor(nm: Column, rules: list[tuple[str, str]]) -> Column:
    """Symbol of the first rule whose keyword the name holds: several words anywhere, one word as a word or, from four letters on, as its beginning."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"over {MOST_RULES} rules")
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in rules]) if rules else F.array().cast("array<struct<k:string,s:string>>")
    words = F.split(nm, " ")
    one = lambda r: F.exists(words, lambda t: (t == r["k"]) | ((F.length(r["k"]) >= WORD) & F.startswith(t, r["k"])))
    hits = F.filter(table, lambda r: F.when(F.contains(r["k"], F.lit(" ")), F.contains(nm, r["k"])).otherwise(one(r)))
    return F.try_element_at(hits, F.lit(1))["s"]


def resolve(entities: DataFrame, listed: DataFrame, macro: DataFrame, rules: DataFrame) -> DataFrame:
    """``entity, name, kind, symbol, source`` for every entity; ``source`` is ``unresolved`` and the symbol null where nothing fits.

    ``entities`` has entity, name, kind; ``listed`` and ``macro`` name, symbol; ``rules`` place,
    keyword, symbol.
    """
    ordered = [(r["keyword"], r["symbol"]) for r in rules.select("place", "keyword", "symbol").orderBy("place", "keyword").limit(MOST_RULES + 1).collect()]
    e = entities.select("entity", "name", "kind", plain(F.col("name")).alias("nm"))
    names = e.select("nm").distinct()
    macros, securities = _first_symbols(macro), _first_symbols(listed)
    tried = names.select("nm", F.posexplode(variants(F.col("nm"))).alias("place", "form"))
    by_macro = first_per_key(tried.join(macros.withColumnRenamed("nm", "form"), "form"), ["nm"], [F.col("place")]).select("nm", F.col("symbol").alias("macro"))
    exact = names.join(securities, "nm").select("nm", F.col("symbol").alias("exact"))
    open_names = names.join(exact, "nm", "left_anti").join(by_macro, "nm", "left_anti").where("nm <> ''")
    near = first_per_key(near_names(open_names, securities), ["nm"], [F.col("apart") / F.greatest(F.length("nm"), F.length("listed")), F.col("listed")])
    near = near.join(securities.withColumnRenamed("nm", "listed"), "listed").select("nm", F.col("symbol").alias("near"))
    known = names.join(by_macro, "nm", "left").join(exact, "nm", "left").join(near, "nm", "left").withColumn("factor", factor(F.col("nm"), ordered))
    rows = e.join(known, "nm")
    secure, loose = F.col("kind").isin(LISTED_KINDS), F.col("kind").isin(FACTOR_KINDS)
    steps = [("macro", F.col("macro").isNotNull()), ("listed_exact", secure & F.col("exact").isNotNull()), ("listed_near", secure & F.col("near").isNotNull()), ("factor", loose & F.col("factor").isNotNull())]
    source, symbol = F.lit("unresolved"), F.lit(None).cast("string")
    for (name, fits), column in reversed(list(zip(steps, ["macro", "exact", "near", "factor"], strict=True))):
        source, symbol = F.when(fits, name).otherwise(source), F.when(fits, F.col(column)).otherwise(symbol)
    return rows.select("entity", "name", "kind", symbol.alias("symbol"), source.alias("source"))


def weighted_frequency(edges: DataFrame) -> DataFrame:
    """``entity, freq`` from ``effect, cause``: an effect counts two, a cause one."""
    both = edges.select(F.col("effect").alias("entity"), F.lit(2).alias("w")).union(edges.select("cause", F.lit(1)))
    return both.where("entity IS NOT NULL").groupBy("entity").agg(F.sum("w").alias("freq"))
