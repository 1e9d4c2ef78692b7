"""Readability, density, repetition and diversity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def syllables(word: Column) -> Column:
    """Vowel groups of a lower-case word; a final e is silent, a final le isn't."""
    n = F.regexp_count(word, F.lit("[aeiouy]+"))
    n = n - F.when(word.endswith("e") & (n > 1), 1).otherwise(0)
    n = n + F.when(word.rlike("[^aeiouy]le$"), 1).otherwise(0)
    return F.greatest(n, F.lit(1))


def readability(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Words, sentences, syllables and complex words, and three grades."""
    rows = docs.select(*keys, T.prose(F.col("text")).alias("p"))
    rows = rows.select(*keys, F.transform(T.tokens(F.col("p"), "[A-Za-z]+"), F.lower).alias("w"), F.size(T.sentences(T.without_parentheses(F.col("p")), 3)).alias("ns"))
    rows = rows.withColumn("syl", F.transform("w", syllables))
    rows = rows.select(
        *keys, F.size("w").cast("long").alias("words"), F.col("ns").cast("long").alias("sentences"),
        F.aggregate("syl", F.lit(0).cast("long"), lambda a, x: a + x).alias("syllables"), F.size(F.filter("syl", lambda x: x >= 3)).cast("long").alias("complex_words"),
    )
    nw, ns = F.greatest("words", F.lit(1)), F.greatest("sentences", F.lit(1))
    wps, spw, complex_share = nw / ns, F.col("syllables") / nw, F.lit(100.0) * F.col("complex_words") / nw
    grades = {
        "flesch_ease": 206.835 - 1.015 * wps - 84.6 * spw, "fk_grade": 0.39 * wps + 11.8 * spw - 15.59,
        "gunning_fog": 0.4 * (wps + complex_share), "words_per_sentence": wps, "pct_complex": complex_share,
    }
    return rows.select("*", *[F.round(c, 6).alias(n) for n, c in grades.items()])


def densities(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Content-word and nominalisation counts behind the density measures."""
    low = F.lower(T.prose(F.col("text")))
    rows = docs.select(*keys, T.tokens(low, "[a-z']+").alias("t"), F.filter(T.tokens(low), lambda w: F.length(w) > 4).alias("w"))
    content = F.size(F.filter("t", lambda w: ~w.isin(L.FUNCTION_WORDS)))
    nominal = F.size(F.filter("w", lambda w: w.rlike(L.NOMINAL_SUFFIX) & ~w.isin(L.NOMINAL_STOP)))
    rows = rows.select(*keys, F.size("t").alias("tokens"), content.alias("content"), F.size("w").alias("long_tokens"), nominal.alias("nominal"))
    return rows.select(
        *keys, *[F.col(c).cast("long").alias(c) for c in ("tokens", "content", "long_tokens", "nominal")],
        F.round(F.lit(100.0) * F.col("content") / F.greatest("tokens", F.lit(1)), 4).alias("lexical_density"),
        F.round(F.lit(1000.0) * F.col("nominal") / F.greatest("long_tokens", F.lit(1)), 4).alias("nominal_density"),
    )


STEMMED = r"[a-z][a-z'\-]{2,}"
MEMO_WORDS = 200_000


def plain(text: Column) -> Column:
    """Lower-cased text without comments and marks."""
    return F.lower(F.regexp_replace(F.regexp_replace(T.clean(text), T.COMMENT, ""), r"[*`#>\[\]()]|\\[a-z]+", " "))


class _Stems(dict):
    def __missing__(self, word: str) -> str | None:
        if len(self) > MEMO_WORDS:
            self.clear()
        suffix = next((s for s in L.STEM_SUFFIXES if word.endswith(s) and len(word) >= len(s) + 3), "")
        value = self[word] = None if word in L.STEM_STOP else word[: len(word) - len(suffix)]
        return value


_stems = _Stems()


def stemmed(text: str) -> list[str]:
    """The ``stems`` of a text that ``plain`` has made, a word at a time."""
    return [s for s in map(_stems.__getitem__, re.findall(STEMMED, text)) if s is not None]


def stems(text: Column) -> Column:
    """Content stems: stop words out, the first matching suffix off."""
    words = F.filter(T.tokens(plain(text), STEMMED), lambda w: ~w.isin(L.STEM_STOP))

    def stem(w: Column) -> Column:
        out = None
        for suffix in L.STEM_SUFFIXES:
            hit = w.endswith(suffix) & (F.length(w) >= len(suffix) + 3)
            cut = F.substring(w, F.lit(1), F.length(w) - len(suffix))
            out = F.when(hit, cut) if out is None else out.when(hit, cut)
        return out.otherwise(w)

    return F.transform(words, stem)


def _grams(docs: DataFrame, keys: list[str]) -> DataFrame:
    rows = docs.select(*keys, stems(T.prose(F.col("text"))).alias("s"))
    grams = F.when(F.size("s") >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.size("s") - 2, F.lit(1))), lambda i: F.array_join(F.slice("s", i, F.lit(3)), " ")))
    return rows.select(*keys, F.sort_array(F.coalesce(grams, F.array().cast("array<string>"))).alias("g"))


def trigram_repetition(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Trigrams of stems, and those that occur more than once.

    They are counted row by row; only those of rows that share their keys with
    others are dealt out."""
    def same(a: Column, b: Column) -> Column:
        return F.when(a.eqNullSafe(b), 1).otherwise(0)

    shared = docs.groupBy(*keys).agg(F.count("*").alias("_rows")).where("_rows > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    alike = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    single, many = (docs.join(shared, alike, how) for how in ("left_anti", "left_semi"))
    none = F.array(F.lit(None).cast("string"))
    own = _grams(single, keys)
    before = F.zip_with("g", F.slice(F.concat(none, F.col("g")), F.lit(1), F.size("g")), same)
    # one that equals the one before it, or the one after it
    after = F.zip_with("g", F.concat(F.slice(F.col("g"), F.lit(2), F.size("g")), none), same)
    repeated = F.size(F.filter(F.zip_with(before, after, lambda x, y: x + y), lambda x: x > 0))
    out = own.select(*keys, F.size("g").cast("long").alias("trigrams"), repeated.cast("long").alias("repeated"))
    counted = _grams(many, keys).select(*keys, F.explode_outer("g").alias("g")).groupBy(*keys, "g").agg(F.count("g").alias("n"))
    out = out.unionByName(counted.groupBy(*keys).agg(F.sum("n").alias("trigrams"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated")))
    return out.select("*", F.round(F.lit(100.0) * F.col("repeated") / F.greatest("trigrams", F.lit(1)), 4).alias("trigram_rep"))


def clause_profile(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Clauses per sentence, subordination, clause length and function words."""
    rows = docs.select(*keys, T.without_parentheses(T.prose(F.col("text"))).alias("pc"))
    low = F.lower("pc")
    rows = rows.select(
        *keys, F.size(T.tokens(low)).cast("long").alias("tokens"), F.greatest(F.size(T.sentences(F.col("pc"), 4)), F.lit(1)).cast("long").alias("sentences"),
        T.count(low, L.SUBORDINATORS).cast("long").alias("subordinators"), T.count(low, ",").cast("long").alias("commas"),
        F.size(F.filter(T.tokens(low), lambda w: w.isin(L.FUNCTION_WORDS))).cast("long").alias("function_words"),
    )
    w, clauses = F.greatest("tokens", F.lit(1)), F.col("commas") + F.col("subordinators") + F.col("sentences")
    return rows.select(
        "*", F.round(clauses / F.col("sentences"), 4).alias("clauses_per_s"), F.round(F.lit(1000.0) * F.col("subordinators") / w, 4).alias("subord_ratio"),
        F.round(w / F.greatest(clauses, F.lit(1)), 4).alias("mean_clause"), F.round(F.lit(1000.0) * F.col("function_words") / w, 4).alias("fw_rate"),
    )


def lexical_diversity(tokens: list[str], least: int = 50, threshold: float = 0.72) -> float:
    """Mean length of runs that keep the type-token ratio above the threshold,
    averaged over both reading directions; 0 for fewer than ``least`` tokens."""
    if len(tokens) < least:
        return 0.0

    def runs(words: list[str]) -> float:
        factors, types, n = 0.0, set(), 0
        for word in words:
            n += 1
            types.add(word)
            if len(types) <= threshold * n:
                factors, types, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(types) / n) / (1 - threshold)
        return len(words) / factors if factors else float(len(words))

    return round((runs(tokens) + runs(tokens[::-1])) / 2, 1)


def _let(x: Column, f) -> Column:
    """f(x), with x computed once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _links(tokens: Column) -> Column:
    """Of each token in order: its place (i) and those of its word's occurrence
    before (p) and after (q), -1 for none.  Words are sorted once."""
    none = F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("i"))

    def linked(s: Column) -> Column:
        before = F.zip_with(s, F.concat(F.array(none), s), lambda z, y: F.struct(z["i"].alias("i"), z["w"].alias("w"), F.when(z["w"] == y["w"], y["i"]).otherwise(-1).alias("p")))
        after = F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(none))
        both = F.zip_with(before, after, lambda z, y: F.struct(z["i"].alias("i"), z["p"].alias("p"), F.when(z["w"] == y["w"], y["i"]).otherwise(-1).alias("q")))
        return F.filter(F.sort_array(both), lambda z: z["i"].isNotNull())

    return _let(F.sort_array(F.transform(tokens, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), linked)


def _backward(links: Column) -> Column:
    """The links of the other reading direction."""
    last = F.size(links) - 1
    return F.transform(F.reverse(links), lambda z: F.struct((last - z["i"]).alias("i"), F.when(z["q"] >= 0, last - z["q"]).otherwise(-1).alias("p"), F.lit(-1).alias("q")))


def _mean_run(links: Column, threshold: float) -> Column:
    """Mean length of the runs of one reading direction.

    A token is a new type of the run that began at s if its previous occurrence
    lies before s, so the fold needs the run's start and number of types alone."""
    size = F.size(links).cast("double")
    begun = F.struct(F.lit(0).alias("start"), F.lit(0).alias("types"), F.lit(0).alias("runs"))

    def add(a: Column, x: Column) -> Column:
        types = a["types"] + F.when(x["p"] < a["start"], 1).otherwise(0)
        ends = types <= F.lit(threshold) * (x["i"] - a["start"] + 1)
        after = F.struct((x["i"] + 1).alias("start"), F.lit(0).alias("types"), (a["runs"] + 1).alias("runs"))
        return F.when(ends, after).otherwise(F.struct(a["start"].alias("start"), types.alias("types"), a["runs"].alias("runs")))

    def mean(a: Column) -> Column:
        rest = size - a["start"]
        part = F.when(rest > 0, (1 - a["types"] / F.greatest(rest, F.lit(1.0))) / (1 - threshold)).otherwise(0.0)
        return F.when(a["runs"] + part > 0, size / F.when(a["runs"] + part > 0, a["runs"] + part).otherwise(1.0)).otherwise(size)

    return F.aggregate(links, begun, add, mean)


def mtld(tokens: Column, least: int = 50, threshold: float = 0.72) -> Column:
    """``lexical_diversity`` of an array of tokens, in time that grows as n log n; 0
    for null."""

    def rounded(links: Column) -> Column:
        both = (_mean_run(links, threshold) + _let(_backward(links), lambda x: _mean_run(x, threshold))) / 2
        return F.floor(both * 10 + 0.5) / 10

    return F.when(F.size(tokens) >= least, _let(_links(tokens), rounded)).otherwise(0.0)
