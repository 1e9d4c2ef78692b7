"""Two groups of documents: what separates them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.staged import staged
from .bands import rank_round


def side_counts(long: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """by, _v, n0, n1 and the rows below, b0 and b1, and in all, t0 and t1, of each
    side, a row per distinct value; ``side`` holds 1 and 0, null values take no
    part.  Rows are counted map-side first, so a window holds distinct values."""
    n1, n0 = F.when(F.col(side) == 1, 1).otherwise(0), F.when(F.col(side) == 1, 0).otherwise(1)
    counts = long.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.sum(n1).alias("n1"), F.sum(n0).alias("n0"))
    w = Window.partitionBy(*by)
    upto = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumns({f"b{k}": F.sum(f"n{k}").over(upto) - F.col(f"n{k}") for k in (0, 1)} | {f"t{k}": F.sum(f"n{k}").over(w) for k in (0, 1)})


def _auc() -> Column:
    """P[value of side 1 > value of side 0] + half the ties; 0.5 where a side is
    empty.  An aggregate over ``side_counts``."""
    above = F.sum(F.col("n1") * (F.col("b0") + F.col("n0") / 2))
    pairs = F.max("t1").cast("double") * F.max("t0")
    return F.when(pairs > 0, above / F.greatest(pairs, F.lit(1.0))).otherwise(0.5)


def at_rank(k: Column, below: str, n: str, value: str = "_v") -> Column:
    """The value at zero-based rank ``k``: an aggregate over distinct values that
    have ``n`` rows and ``below`` rows before them."""
    return F.max(F.when((F.col(below) <= k) & (k < F.col(below) + F.col(n)), F.col(value)))


def _median(k: int) -> Column:
    half = (F.col(f"t{k}") - 1) / 2
    return (at_rank(F.floor(half), f"b{k}", f"n{k}") + at_rank(F.ceil(half), f"b{k}", f"n{k}")) / 2


def auc(long: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """by, n1, n0 and the AUC of side 1 over side 0."""
    return side_counts(long, by, side, value).groupBy(*by).agg(F.max("t1").alias("n1"), F.max("t0").alias("n0"), _auc().alias("auc"))


#: What the names of syntax features begin with where they stand beside others.
SYNTAX = "synt_"


def feature_categories(spark) -> DataFrame:
    """feature -> category; the last category that names a feature has it."""
    owner = {f: c for c, _, _, det in L.TAXONOMY for f in det.split()}
    return spark.createDataFrame(list(owner.items()), "feature string, category string")


def feature_ranking(features: DataFrame, side: str, key: str, names: list[str] = L.FEATURES) -> DataFrame:
    """AUC, medians, category and mark of every feature; those of the syntax have
    the category of their name without ``SYNTAX``."""
    counts = side_counts(features.unpivot([key, side], names, "feature", "value"), ["feature"], side, "value")
    rows = counts.groupBy("feature").agg(_auc().alias("auc"), _median(0).alias("mid0"), _median(1).alias("mid1"))
    categories = feature_categories(features.sparkSession).withColumnRenamed("feature", "_plain")
    rows = rows.withColumn("_plain", F.regexp_replace("feature", f"^{SYNTAX}", "")).join(F.broadcast(categories), "_plain", "left")
    gap = F.abs(F.col("auc") - 0.5)
    mark = F.when(gap >= 0.25, "strong").when(F.col("auc") < 0.42, "invert").otherwise("")
    return rows.select("feature", F.round("auc", 6).alias("auc"), F.round("mid0", 4).alias("mid0"), F.round("mid1", 4).alias("mid1"), "category", mark.alias("mark"))


def category_support(ranking: DataFrame) -> DataFrame:
    """Mean separation and number of features of each category."""
    return ranking.where("category is not null").groupBy("category").agg(F.round(F.avg(F.abs(F.col("auc") - 0.5)), 6).alias("support"), F.count("*").alias("n"))


def term_counts(docs: DataFrame, group: str, words) -> DataFrame:
    """group, word and how often the group's documents use it."""
    return docs.select(group, F.explode(words).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))


def excess_words(docs: DataFrame, side: str, most: int = 24) -> DataFrame:
    """Words that side 1 uses at twice side 0's rate or more."""
    counts = term_counts(docs, side, T.tokens(F.lower(T.prose(F.col("text"))), r"[a-z][a-z'\-]+"))
    totals = counts.groupBy().agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).alias(f"t{s}") for s in (0, 1)])
    n1 = docs.where(F.col(side) == 1).agg(F.count("*").alias("docs1"))
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).alias(f"c{s}") for s in (0, 1)])
    # totals and n1 are one row each
    rows = wide.withColumns({"t0": totals.select("t0").scalar(), "t1": totals.select("t1").scalar(), "docs1": n1.scalar()})
    rows = rows.where((F.col("c1") >= F.greatest(F.lit(6.0), 0.4 * F.col("docs1"))) & (F.length("word") > 3))
    rate1, rate0 = F.lit(1000.0) * F.col("c1") / F.col("t1"), F.lit(1000.0) * F.col("c0") / F.greatest("t0", F.lit(1))
    rows = rows.select("word", "c1", "c0", F.round(rate1 / F.greatest(rate0, F.lit(0.05)), 6).alias("ratio")).where("ratio >= 2")
    return rows.orderBy(F.desc("ratio"), "word").limit(most)


def log_odds(counts: DataFrame, side: str, prior: float = 1000.0) -> DataFrame:
    """Weighted log-odds z of side 1 against side 0 with a prior in proportion to
    the pooled counts.  counts: side, word, n."""
    wide = counts.groupBy("word").agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).cast("double").alias(f"c{s}") for s in (0, 1)])
    totals = counts.agg(*[F.sum(F.when(F.col(side) == s, F.col("n")).otherwise(0)).cast("double").alias(f"t{s}") for s in (0, 1)])
    rows = wide.withColumns({"t0": totals.select("t0").scalar(), "t1": totals.select("t1").scalar()})
    a = F.lit(prior) * (F.col("c0") + F.col("c1")) / (F.col("t0") + F.col("t1"))
    rows = rows.withColumn("a", a).where("a > 0")

    def odds(s: int):
        return F.ln(F.col(f"c{s}") + F.col("a")) - F.ln(F.col(f"t{s}") + prior - F.col(f"c{s}") - F.col("a"))

    z = (odds(1) - odds(0)) / F.sqrt(1 / (F.col("c1") + F.col("a")) + 1 / (F.col("c0") + F.col("a")))
    return rows.select("word", F.col("c1").cast("long").alias("c1"), F.col("c0").cast("long").alias("c0"), z.alias("z"))


def overuse_channels(counts: DataFrame, zipf: DataFrame | None = None, least: int = 3) -> DataFrame:
    """A draft's over-used words.  counts: role (draft, human, on_topic,
    matched), word, n.  A word over-used against humans that matched references
    over-use as well is slop; else one over-used against on-topic references is
    repetition.  Words without a frequency count as 3.5 on the Zipf scale."""

    def against(one: str, zero: str) -> DataFrame:
        sides = counts.where(F.col("role").isin(one, zero)).withColumn("side", F.when(F.col("role") == one, 1).otherwise(0))
        return log_odds(sides, "side").select("word", F.col("z").alias(f"z_{one}_{zero}"))

    draft = counts.where("role = 'draft'").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = draft
    for one, zero in (("draft", "human"), ("matched", "human"), ("draft", "on_topic")):
        rows = rows.join(against(one, zero), "word", "left").withColumn(f"z_{one}_{zero}", F.coalesce(f"z_{one}_{zero}", F.lit(0.0)))
    scale = rows.join(zipf, "word", "left") if zipf is not None else rows.withColumn("zipf", F.lit(None).cast("double"))
    has = counts.groupBy().agg(F.max(F.col("role") == "matched").alias("m"), F.max(F.col("role") == "on_topic").alias("o"))
    scale = scale.withColumns({"m": has.select("m").scalar(), "o": has.select("o").scalar()})
    slop = F.col("m") & (F.col("z_draft_human") > 1.96) & (F.col("z_matched_human") > 1.5) & (F.coalesce("zipf", F.lit(3.5)) >= 3.0)
    repeated = F.col("o") & (F.col("z_draft_on_topic") > 1.96) & (F.col("n") >= 5)
    rows = scale.withColumn("channel", F.when(slop, "generic_slop").when(repeated, "over_repetition")).where("channel is not null")
    score = F.when(F.col("channel") == "generic_slop", F.col("z_draft_human")).otherwise(F.col("z_draft_on_topic"))
    return rows.select("channel", "word", "n", F.round(score, 4).alias("z"))


def loo_composite(features: DataFrame, side: str, key: str, names: list[str] = L.FEATURES) -> DataFrame:
    """One row: AUC and strict true-positive rate of flag counts.

    A feature of |AUC - 0.5| >= 0.1 flags a document past side 0's 80th (or
    20th) percentile; a side-0 document is read against the other side-0
    documents.  Removing one value from a sorted list moves a rank by at most
    one, so its band is one of two neighbouring values and no document is
    paired with another.  Bands come from counts of distinct values, the row from
    a histogram of flag counts, which has a bin per number of features at most.
    Features are staged, as bands and flags read them.
    """
    long = staged(features.select(key, side, *names), "features").unpivot([key, side], names, "feature", "value")
    bands = {}
    for name, q in (("up", 0.8), ("down", 0.2)):
        full, loo = rank_round(q, F.col("t0")), rank_round(q, F.col("t0") - 1)
        bands |= {f"{name}_cut": full, f"{name}_lo": loo, f"{name}_hi": loo + 1}
    cuts = side_counts(long, ["feature"], side, "value").groupBy("feature").agg(_auc().alias("auc"), *[at_rank(k, "b0", "n0").alias(name) for name, k in bands.items()])
    up = F.col("auc") > 0.5
    cuts = cuts.where(F.abs(F.col("auc") - 0.5) >= 0.1).select("feature", up.alias("up"), *[F.when(up, F.col(f"up_{c}")).otherwise(F.col(f"down_{c}")).alias(c) for c in ("cut", "lo", "hi")])
    # without one document's value, rank r holds what was at r or, from that value on, at r + 1
    cut = F.when(F.col(side) == 1, F.col("cut")).when(F.col("value") <= F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    # a row per feature at most
    rows = long.join(F.broadcast(cuts), "feature").withColumn("cut", cut)
    over = F.when(F.col("up"), F.col("value") > F.col("cut")).otherwise(F.col("value") < F.col("cut"))
    flagged = rows.groupBy(key, side).agg(F.sum(F.when(over, 1).otherwise(0)).alias("flags"))
    bins = flagged.groupBy("flags").agg(*[F.sum(F.when(F.col(side) == s, 1).otherwise(0)).cast("double").alias(f"n{s}") for s in (0, 1)])
    whole = bins.agg(F.collect_list(F.struct("flags", "n0", "n1")).alias("h"), F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.max(F.when(F.col("n0") > 0, F.col("flags"))).alias("most"))

    def total(weight) -> Column:
        return F.aggregate("h", F.lit(0.0), lambda s, x: s + weight(x))

    def beaten(x: Column) -> Column:
        return F.aggregate("h", F.lit(0.0), lambda s, y: s + y["n0"] * F.when(x["flags"] > y["flags"], 1.0).when(x["flags"] == y["flags"], 0.5).otherwise(0.0))

    pairs = F.col("t0") * F.col("t1")
    separation = F.when(pairs > 0, total(lambda x: x["n1"] * beaten(x)) / F.greatest(pairs, F.lit(1.0))).otherwise(0.5)
    strict = total(lambda x: F.when(x["flags"] > F.col("most"), x["n1"]).otherwise(0.0)) / F.when(F.col("t1") > 0, F.col("t1"))
    return whole.where(F.size("h") > 0).select(F.round(separation, 6).alias("auc"), F.round(strict, 6).alias("strict_tpr"))


def diction(docs: DataFrame, group: str, most: int = 140, shown: int = 25) -> DataFrame:
    """Each group's most used longer words; ties by word."""
    counts = term_counts(docs, group, T.tokens(F.lower(T.prose(F.col("text"))), r"[a-z][a-z\-]{4,}"))
    top = Window.partitionBy(group).orderBy(F.desc("n"), "word")
    rows = counts.withColumn("k", F.row_number().over(top)).where(F.col("k") <= most).where(~F.col("word").isin(L.DICTION_STOP))
    return rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= shown).select(group, "rank", "word", "n")


def near_zero(features: DataFrame, group: str) -> DataFrame:
    """Texture features whose group median is at most 1."""
    long = features.unpivot([group], L.TEXTURE, "feature", "value")
    return long.groupBy(group, "feature").agg(F.round(F.median("value"), 4).alias("mid")).where("mid <= 1")


def sentence_samples(docs: DataFrame, group: str, key: str, of_docs: int = 6, per: int = 2, least: int = 12, most: int = 38) -> DataFrame:
    """The first sentences of ordinary length of each group's first documents."""
    w = Window.partitionBy(group).orderBy(key)
    first = docs.select(group, key, F.row_number().over(w).alias("k"), "text").where(F.col("k") <= of_docs)
    fitting = F.filter(F.split(T.prose(F.col("text")), r"(?<=[.!?])\s+"), lambda s: T.spaced_words(s).between(least, most))
    return first.select(group, key, F.posexplode(F.slice(fitting, 1, per)).alias("pos", "sentence"))
