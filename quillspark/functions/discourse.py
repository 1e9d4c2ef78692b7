"""Discourse measures: caveats, cohesion, concreteness, engagement and others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T
from .lexical import mtld

#: Direction of each banded measure: which side of the exemplars fails.
DIRECTIONS = {
    "caveat_before_payoff": "high_bad", "connective_density": "high_bad", "apparatus_load": "high_bad", "concreteness": "low_bad",
    "nominalization": "high_bad", "formality": "high_bad", "engagement_markers": "low_bad", "referential_cohesion": "low_bad",
}


def views(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and what the measures read: the raw text, its prose, words, sentences and
    their lengths, paragraphs and tokens.  What a measure doesn't use is pruned."""
    rows = docs.select(*keys, T.clean(F.col("text")).alias("raw"), T.prose(F.col("text")).alias("p"), F.split(T.prose_paragraphs(F.col("text")), r"\n\s*\n").alias("paras"))
    rows = rows.withColumns({"w": F.regexp_count("p", F.lit(T.WORD)), "s": T.sentences(T.without_parentheses(F.col("p")), 3), "t": T.tokens(F.lower("p"))})
    return rows.withColumn("lens", F.transform("s", lambda x: T.spaced_words(x).cast("double")))


def _counts() -> dict[str, Column]:
    proper = F.aggregate("s", F.lit(0), lambda a, s: a + F.size(F.filter(F.slice(T.tokens(s, r"[\p{L}\p{N}_][\p{L}\p{N}_'\-]*"), F.lit(2), F.lit(1 << 30)), lambda w: w.rlike("^[A-Z][a-z]"))))
    opening = F.transform(F.split("p", r"(?<=[.!?])\s+"), lambda s: F.lower(F.regexp_extract(s, r"^\s*([A-Za-z]+)", 1)))
    imperatives = F.size(F.filter(opening, lambda w: w.isin(L.IMPERATIVES)))
    p, raw = F.col("p"), F.col("raw")
    out = {
        "words": F.col("w"), "sentences": F.size("s"), "self_scores": T.count(raw, L.SELF_SCORE), "connectives": T.count(p, L.CONNECTIVE),
        "table_rows": T.count(raw, r"(?m)^\s*\|"), "figure_refs": T.count(raw, r"(?i)\b(?:figure|fig\.|table|tbl\.)\s*\d"),
        "appendix_headings": T.count(raw, r"(?m)^##\s+(?:[A-Z]\b|Appendix\b)"), "proper_nouns": proper, "numerals": T.count(p, r"\b\d+(?:[.,]\d+)?\b"),
        "examples": T.count(p, L.EXAMPLE), "hedges": T.count(p, L.HEDGE), "be_verbs": T.count(p, *L.BE_VERB), "nominalisations": T.count(p, L.NOMINALISATION),
        "prepositions": T.count(p, L.PREPOSITION), "ad_words": T.count(p, L.ADVERB, L.AD_ADJECTIVE), "waste": T.count(p, L.WASTE),
        "stance": T.count(p, *L.STANCE), "engagement": T.count(p, L.ENGAGEMENT, r"\?") + imperatives,
    }
    return {n: c.cast("long") for n, c in out.items()}


def counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """What the discourse rates count, with the words they are taken over."""
    return views(docs, keys).select(*keys, *[c.alias(n) for n, c in _counts().items()])


def _caveats(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_first", F.array_position(F.transform("s", lambda x: x.rlike(L.PAYOFF)), F.lit(True)))
    before = F.when(F.col("_first") > 0, F.slice("s", F.lit(1), F.col("_first").cast("int") - 1)).otherwise(F.col("s"))
    return rows.withColumn("caveats", F.size(F.filter(before, lambda x: x.rlike(L.CAVEAT))).cast("long"))


def caveat_order(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Caveat sentences before the first payoff sentence (all, without one)."""
    return _caveats(views(docs, keys)).select(*keys, F.size("s").cast("long").alias("sentences"), "caveats")


def _cohesion(rows: DataFrame) -> DataFrame:
    sets = F.transform("s", lambda x: F.array_distinct(F.filter(T.tokens(F.lower(x), r"[a-z][a-z'\-]+"), lambda w: (F.length(w) > 3) & ~w.isin(L.COHESION_STOP))))
    rows = rows.withColumn("_c", sets)
    pairs = F.arrays_zip(F.col("_c").alias("a"), F.slice("_c", F.lit(2), F.lit(1 << 30)).alias("b"))
    usable = F.filter(pairs, lambda z: F.least(F.size(z["a"]), F.coalesce(F.size(z["b"]), F.lit(0))) > 0)
    shares = F.transform(usable, lambda z: F.size(F.array_intersect(z["a"], z["b"])) / F.least(F.size(z["a"]), F.size(z["b"])))
    rows = rows.withColumn("_shares", shares)
    mean = F.aggregate("_shares", F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size("_shares"), F.lit(1))
    return rows.withColumns({"pairs": F.size("_shares").cast("long"), "referential_cohesion": F.round(mean, 6)})


def cohesion(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean content-word overlap of adjacent sentences over the smaller one."""
    return _cohesion(views(docs, keys)).select(*keys, "pairs", "referential_cohesion")


def _hedges(rows: DataFrame) -> DataFrame:
    counted = F.transform("paras", lambda x: F.struct(T.count(x, L.HEDGE).alias("h"), F.size(T.sentences(T.without_parentheses(x), 3)).alias("s")))
    rows = rows.withColumns({"_r": F.transform(F.filter(counted, lambda z: z["s"] > 0), lambda z: z["h"] / z["s"]), "_h": T.count(F.col("p"), L.HEDGE)})
    deviation, mean = T.spread(F.col("_r"))
    even = F.when((F.size("_r") >= 2) & (mean > 0), deviation / F.when(mean > 0, mean).otherwise(1.0)).otherwise(0.0)
    any_ = F.size("s") > 0
    level = F.when(any_, F.col("_h") / F.greatest(F.size("s"), F.lit(1))).otherwise(0.0)
    return rows.withColumns({"hedge_mean": F.round(level, 6), "hedge_spread": F.round(F.when(any_, even).otherwise(0.0), 6)})


def hedge_rhythm(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Hedges per sentence, and their spread over paragraphs."""
    return _hedges(views(docs, keys)).select(*keys, "hedge_mean", "hedge_spread")


def _voice(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("mtld", mtld(F.col("t")))
    deviation, mean = T.spread(F.col("lens"))
    burst = deviation / F.greatest(mean, F.lit(1.0))
    value = F.least(burst / 1.2, F.lit(1.0)) * 50 + F.least(F.col("mtld") / 120, F.lit(1.0)) * 50
    return rows.withColumn("voice", F.when((F.size("lens") < 2) | (F.size("t") < 50), 0.0).otherwise(F.round(value, 2)))


def voice(docs: DataFrame, keys: list[str]) -> DataFrame:
    """Sentence-length variation and lexical diversity on one scale, and MTLD."""
    return _voice(views(docs, keys)).select(*keys, "mtld", "voice")


#: Measures that a document's row also has but that no verdict uses.
INFORMATIONAL = [
    "section_cv", "defensive_metadiscourse", "voice", "hedge_mean", "hedge_spread", "self_scores", "diet_be_verbs", "diet_prepositions", "diet_ad_words", "diet_waste",
]


def measures(docs: DataFrame, keys: list[str]) -> DataFrame:
    """All measures of a document in one row, from one projection of its text: those
    with a direction, then ``INFORMATIONAL``."""
    rows = _hedges(_voice(_cohesion(_caveats(views(docs, keys))))).withColumns(_counts())
    rows = rows.withColumn("_sections", F.transform(T.section_bodies(F.col("raw")), lambda x: T.word_count(T.prose(x)).cast("double")))
    w = F.greatest("words", F.lit(1))
    deviation, mean = T.spread(F.col("lens"))
    apart, middle = T.spread(F.col("_sections"))
    nominal = F.lit(100.0) * F.col("nominalisations") / w
    concrete = F.lit(1000.0) * (F.col("proper_nouns") + F.col("numerals") + F.col("examples")) / w
    parts = (
        (1 - F.least(deviation / F.greatest(mean, F.lit(1.0)), F.lit(1.0))) * 50 + F.least(mean, F.lit(40.0)) / 40 * 50
        + F.least(F.round(nominal, 2) * 5, F.lit(50.0)) + F.greatest(F.lit(0.0), 50 - F.least(F.round(concrete, 2), F.lit(50.0)))
    )
    enough = (F.size("lens") >= 2) & (F.col("words") > 1)
    diet = {"diet_be_verbs": "be_verbs", "diet_prepositions": "prepositions", "diet_ad_words": "ad_words", "diet_waste": "waste"}
    return rows.select(
        *keys, F.col("caveats").cast("double").alias("caveat_before_payoff"), F.round(F.lit(1000.0) * F.col("connectives") / w, 4).alias("connective_density"),
        F.round(F.lit(1000.0) * (F.col("table_rows") + F.col("figure_refs") + F.col("appendix_headings")) / w, 4).alias("apparatus_load"),
        F.round(concrete, 4).alias("concreteness"), F.round(nominal, 4).alias("nominalization"), F.round(F.when(enough, parts / 4).otherwise(0.0), 2).alias("formality"),
        F.when(F.col("words") > 1, F.round(F.lit(1000.0) * F.col("engagement") / w, 4)).otherwise(0.0).alias("engagement_markers"),
        F.round("referential_cohesion", 3).alias("referential_cohesion"),
        F.when(F.size("_sections") >= 2, F.round(apart / F.greatest(middle, F.lit(1.0)), 6)).otherwise(0.0).alias("section_cv"),
        F.when(F.col("words") > 1, F.round(F.lit(1000.0) * F.col("stance") / w, 2)).otherwise(0.0).alias("defensive_metadiscourse"),
        "voice", "hedge_mean", "hedge_spread", F.col("self_scores").cast("double").alias("self_scores"),
        *[F.round(F.lit(100.0) * F.col(c) / w, 2).alias(n) for n, c in diet.items()],
    )


def exemplar_band(rows: DataFrame, group: str) -> DataFrame:
    """Minimum, median and maximum of each measure over a group's exemplars."""
    long = rows.unpivot([group], list(DIRECTIONS), "measure", "value")
    return long.groupBy(group, "measure").agg(F.min("value").alias("low"), F.median("value").alias("mid"), F.max("value").alias("high"))


def against_band(rows: DataFrame, keys: list[str], band: DataFrame, group: str) -> DataFrame:
    """PASS or FAIL of each document and measure against its group's band."""
    long = rows.unpivot([*keys], list(DIRECTIONS), "measure", "value").join(band, [group, "measure"])
    low_bad = [m for m, d in DIRECTIONS.items() if d == "low_bad"]
    passed = F.when(F.col("measure").isin(low_bad), F.col("value") >= F.col("low")).otherwise(F.col("value") <= F.col("high"))
    return long.select(*keys, "measure", "value", F.when(passed, "PASS").otherwise("FAIL").alias("verdict"))
