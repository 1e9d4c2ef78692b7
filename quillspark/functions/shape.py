"""The 36 surface features as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T


def views(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The text views that features are counted on, each computed once."""
    rows = docs.select(*keys, T.clean(F.col("text")).alias("raw"), T.prose(F.col("text")).alias("p"))
    rows = rows.withColumn("pc", F.replace(T.without_parentheses(F.col("p")), F.lit("et al."), F.lit("et al")))
    rows = rows.withColumn("low", F.lower("pc")).withColumn("words", T.word_count(F.col("pc")))
    return rows.withColumn("sents", T.sentences(F.col("pc"), 4))


def bold_runs(raw: Column) -> Column:
    lines = F.split(raw, "\n")
    return F.size(F.filter(lines, lambda x: ~x.rlike(L.LIST_LINE) & x.rlike(L.BOLD_IN_LINE)))


def counts() -> dict[str, Column]:
    """How often each counted feature occurs, from the views."""
    out = {}
    for name, (basis, patterns) in L.SHAPE.items():
        used = [L.TRIADIC_ANCHORED] if name == "triadic" else patterns
        out[name] = T.count(F.col(basis), *used)
    out["para_open_The"] = F.size(F.filter("sents", lambda s: s.startswith("The ")))
    out["transition_open"] = F.size(F.filter("sents", lambda s: s.rlike(L.TRANSITION_OPEN)))
    out["bold_run"] = bold_runs(F.col("raw"))
    return out


def shape_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, words and a count per feature."""
    return views(docs, keys).select(*keys, "words", *[c.cast("long").alias(n) for n, c in counts().items()])


def features(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the 36 features; rates are per 1000 words."""
    rows = views(docs, keys).withColumn("n_sents", F.size("sents")).withColumn("lens", F.when(F.size("sents") > 0, F.transform("sents", lambda s: T.spaced_words(s).cast("double"))).otherwise(F.array(F.lit(1.0))))
    deviation, mean = T.spread(F.col("lens"))
    short = F.size(F.filter("lens", lambda x: x < 8))
    rates = {n: T.per_thousand(c, F.col("words")) for n, c in counts().items()}
    return rows.select(
        *keys,
        (F.floor(mean * 10 + 0.5) / 10).alias("mean_sent"),
        (F.floor(deviation / F.greatest(mean, F.lit(1.0)) * 100 + 0.5) / 100).alias("burstiness_CV"),
        F.floor(F.lit(100.0) * short / F.greatest("n_sents", F.lit(1)) + 0.5).cast("double").alias("pct_short"),
        *[rates[n].alias(n) for n in L.COUNTED],
    )


def long(features: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """A row per document and feature."""
    names = names or [c for c in features.columns if c not in keys]
    return features.unpivot(keys, names, "feature", "value")
