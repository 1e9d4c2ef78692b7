"""Order statistics of groups, leave-one-out, and flags.

Three percentile rules are in use and differ: nearest rank with half-even
rounding, nearest rank rounded down, and the averaged median.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicons as L
from ..sources.staged import staged
from .selection import medians, select_ranks


def rank_round(q: float, n: Column) -> Column:
    """Zero-based rank by half-even rounding of q (n - 1)."""
    return F.bround(F.lit(q) * (n - 1)).cast("int")


def rank_floor(q: float, n: Column) -> Column:
    return F.floor(F.lit(q) * (n - 1)).cast("int")


def order_statistics(long: DataFrame, group: list[str], value: str, ranks: dict[str, tuple[float, str]]) -> DataFrame:
    """Values at given ranks of each group, from counts of its distinct values:
    rows are counted map-side first, so a large group is no one task's work.
    For values that repeat; continuous ones: ``selection.select_ranks``.
    ranks: name -> (q, "round", "floor" or "ceil"); null values take no part."""
    counts = long.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    upto = w.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("_n", F.sum("_c").over(w))
    rules = {"round": rank_round, "floor": rank_floor, "ceil": lambda q, n: F.ceil(F.lit(q) * (n - 1))}
    at = {name: rules[rule](q, F.col("_n")) for name, (q, rule) in ranks.items()}
    return rows.groupBy(*group).agg(
        F.max("_n").alias("n"), *[F.max(F.when((F.col("_to") - F.col("_c") <= k) & (k < F.col("_to")), F.col("_v"))).alias(name) for name, k in at.items()]
    )


def five_numbers(long: DataFrame, group: list[str], value: str) -> DataFrame:
    """Minimum, quartiles and maximum by nearest rank, of continuous values."""
    places = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p75": 0.75, "high": 1.0}
    return select_ranks(long, group, value, {name: lambda n, q=q: rank_round(q, n) for name, q in places.items()})


def robust_high(rows: DataFrame, group: list[str], value: str, k: float = 3.0) -> DataFrame:
    """median + k x 1.4826 x median absolute deviation of each group; null groups
    are left out."""
    mid = medians(rows, group, value).drop("n")
    away = rows.join(mid, group).select(*group, "mid", F.abs(F.col(value) - F.col("mid")).alias("away"))
    spread = medians(away, group, "away").withColumnRenamed("mid", "mad").join(mid, group)
    scaled = F.lit(1.4826) * F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad"))
    return spread.select(*group, "n", "mid", "mad", (F.col("mid") + k * scaled).alias("cutoff"))


def threshold_flags(features: DataFrame, group: str, keys: list[str], least: int = 8) -> DataFrame:
    """Each feature of each document against its group: OUT of a fixed band, or
    HIGH over the group's 80th percentile (groups of ``least`` or more) or the
    default threshold.  Features are computed once and staged, as they are read for
    the percentile and for the flag."""
    features = staged(features, "features")
    long = features.unpivot([group, *keys], L.FEATURES, "feature", "value")
    p80 = order_statistics(long, [group, "feature"], "value", {"p80": (0.8, "round")})
    spark = features.sparkSession
    fixed = [(f, float(L.DEFAULTS.get(f, L.MISSING_DEFAULT)), *map(float, L.BANDS.get(f, (None, None)) if f in L.BANDS else (float("-inf"), float("inf"))), f in L.BANDS) for f in L.FEATURES]
    table = spark.createDataFrame(fixed, "feature string, base double, band_low double, band_high double, banded boolean")
    rows = long.join(F.broadcast(table), "feature").join(p80, [group, "feature"])
    limit = F.greatest(F.when(F.col("n") >= least, F.col("p80")).otherwise(F.col("base")), F.lit(0.1))
    flag = F.when(F.col("banded"), F.when((F.col("value") < F.col("band_low")) | (F.col("value") > F.col("band_high")), "OUT").otherwise("ok"))
    flag = flag.when(F.col("value") > limit, "HIGH").otherwise("ok")
    return rows.select(group, *keys, "feature", "value", limit.alias("threshold"), flag.alias("flag"))


def alignment(features: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Glossed features that tell a document from its group's median; staged, as
    they are read twice."""
    long = staged(features.select(group, *keys, *L.GLOSSED), "features").unpivot([group, *keys], L.GLOSSED, "feature", "value")
    w = [group, "feature"]
    band = order_statistics(long, w, "value", {"p25": (0.25, "round"), "p75": (0.75, "round"), "below": (0.5, "floor"), "above": (0.5, "ceil")})
    rows = long.join(band.withColumn("mid", F.col("below") * 0.5 + F.col("above") * 0.5), w)
    tells = F.when(F.col("feature").isin(L.LOWER_IS_TELL), F.col("value") < 0.7 * F.col("mid")).otherwise(F.col("value") > 1.6 * F.col("mid") + 0.2)
    ratio = F.when(F.col("mid") > 0, F.round(F.col("value") / F.when(F.col("mid") > 0, F.col("mid")).otherwise(1.0), 1))
    return rows.select(group, *keys, "feature", "value", "mid", "p25", "p75", ratio.alias("ratio"), tells.alias("tells"))


CARD_SHAPE = ["that_density", "first_person", "meta_narration", "hedge_modal", "vague_eval_adj", "intensifier", "not_but", "abstract_subj", "burstiness_CV", "mean_sent"]
CARD_SYNTAX = ["nominal_rate", "noun_rate", "pron_rate", "metanarr_synt"]
CARD_HEADINGS = ["title_case", "colon", "mean_words", "compound"]


def register_card(features: DataFrame, syntax: DataFrame, headings: DataFrame, group: str) -> DataFrame:
    """Each group's composite dimensions and labels, from the medians of its
    documents' surface features, syntax rates and heading features.  A group
    without rows of the latter two has zeros there."""

    def middle(rows: DataFrame, names: list[str], *more: Column) -> DataFrame:
        return rows.groupBy(group).agg(*more, *[F.round(F.median(c), 2).alias(c) for c in names])

    rows = middle(features, CARD_SHAPE, F.count("*").alias("n")).join(middle(syntax, CARD_SYNTAX), group, "left").join(middle(headings, CARD_HEADINGS), group, "left")
    rows = rows.fillna(0.0, CARD_SYNTAX + CARD_HEADINGS)
    dimensions = {
        "info_density": "nominal_rate + noun_rate / 5 + that_density", "involvement": "first_person + pron_rate / 10",
        "metadiscourse": "meta_narration + metanarr_synt + hedge_modal / 5", "stance": "vague_eval_adj + intensifier + not_but",
        "abstraction": "abstract_subj + nominal_rate / 10",
    }
    case = F.when(F.col("title_case") < 0.3, "sentence-case").when(F.col("title_case") > 0.6, "Title Case").otherwise("mixed-case")
    return rows.select(
        group, "n", F.col("title_case").alias("h_case"), F.col("colon").alias("h_colon"), F.col("mean_words").alias("h_words"), F.col("compound").alias("h_compound"),
        *[F.round(F.expr(e), 1).alias(k) for k, e in dimensions.items()], F.col("burstiness_CV").alias("rhythm_cv"), "mean_sent", case.alias("heading_case"),
        F.when(F.col("compound") > 0.3, "content-announcing").otherwise("topic-naming").alias("heading_style"), F.when(F.col("burstiness_CV") > 0.4, "varied").otherwise("uniform").alias("rhythm"),
    )


def register_differential(cards: DataFrame, group: str, first: str, second: str) -> DataFrame:
    """The dimensions of two groups and the first's lead over the second."""
    names = ["h_case", "info_density", "involvement", "metadiscourse", "stance", "abstraction"]
    long = cards.where(F.col(group).isin(first, second)).unpivot([group], names, "dimension", "value")
    side = [F.max(F.when(F.col(group) == g, F.col("value"))).alias(c) for g, c in ((first, "a"), (second, "b"))]
    return long.groupBy("dimension").agg(*side).select("dimension", "a", "b", F.round(F.col("a") - F.col("b"), 2).alias("lead"))
