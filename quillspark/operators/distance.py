"""Distances of documents from their groups, leave-one-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..sources.staged import staged
from .bands import robust_high

#: The function words in the order of vectors.
WORDS = sorted(set(L.FUNCTION_WORDS))


def lexicon(spark, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")


def function_word_vectors(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, w (the document's token count) and n: how often each function word
    occurs, in the order of ``WORDS``.

    Row by row: a document's function words are sorted together with the list, so
    each word's run begins and is as long as its count and one more."""
    rows = docs.select(*keys, T.tokens(F.lower(T.without_parentheses(T.prose(F.col("text"))))).alias("t"))
    listed = F.array(*[F.lit(w) for w in WORDS])
    own = F.coalesce(F.filter("t", lambda x: x.isin(WORDS)), F.array().cast("array<string>"))
    rows = rows.select(*keys, F.greatest(F.size("t"), F.lit(1)).cast("long").alias("w"), F.sort_array(F.concat(own, listed)).alias("_s"))
    places = F.sequence(F.lit(0), F.size("_s") - 1)
    rows = rows.select(*keys, "w", F.size("_s").alias("_end"), F.filter(places, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1))).alias("_at"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(WORDS) - 1)), lambda j: (F.coalesce(F.get("_at", j + 1), F.col("_end")) - F.get("_at", j) - 1).cast("long"))
    return rows.select(*keys, "w", counts.alias("n"))


def function_word_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, word, n and the document's token count w; every function word has a
    row."""
    listed = F.array(*[F.lit(w) for w in WORDS])
    rows = function_word_vectors(docs, keys).select(*keys, "w", F.explode(F.arrays_zip(listed.alias("word"), F.col("n"))).alias("z"))
    return rows.select(*keys, "w", F.col("z.word").alias("word"), F.col("z.n").alias("n"))


def group_moments(rates: DataFrame, group: str) -> DataFrame:
    """Mean and population deviation of each word's rate in each group."""
    return rates.groupBy(group, "word").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sd"), F.count("*").alias("n"))


def _hashes(x: Column) -> list[Column]:
    """Two hashes of a rate, small enough that 2^36 of them add up in a long."""
    return [F.pmod(F.xxhash64(x, F.lit(seed)), F.lit(1 << 27)) for seed in (1, 2)]


def _totals(x: Column) -> list[Column]:
    """What a group's rates add up to: all of it combines map-side."""
    h1, h2 = _hashes(x)
    return [F.count("*").alias("k"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(h1).alias("h1"), F.sum(h2).alias("h2")]


def _others(x: Column, t: Column, k: Column) -> tuple[Column, Column, Column]:
    """Mean, deviation and z of a rate against the rest of its group's totals.

    Where the others are all equal the deviation is zero, as subtraction alone
    could leave a trace.  They are then all the least or all the greatest rate, and
    their hashes add up to so many times its hash."""
    n = k - 1
    h = _hashes(x)
    alike = []
    for end in ("lo", "hi"):
        # hashes are made only where the sum allows it: equal rates add up to far closer
        same = F.abs(t["s1"] - x - n * t[end]) <= 1e-3 * F.abs(t["s1"])
        for i, own in enumerate(h):
            same = same & (t[f"h{i + 1}"] - own == n * _hashes(t[end])[i])
        alike.append(same)
    mean = (t["s1"] - x) / F.greatest(n, F.lit(1))
    square = (t["s2"] - x * x) / F.greatest(n, F.lit(1))
    sd = F.when((n < 1) | alike[0] | alike[1], 0.0).otherwise(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))))
    return mean, sd, F.when(sd > 1e-9, (x - mean) / F.when(sd > 1e-9, sd).otherwise(1.0))


def leave_one_out(rates: DataFrame, group: str, key: str, term: str = "word") -> DataFrame:
    """z of each document's rate against the other documents of its group: totals of
    the group, made in one map-side pass, less the document itself."""
    totals = rates.groupBy(group, term).agg(*_totals(F.col("rate")))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (group, term)]
    rows = rates.alias("r").join(totals.select(group, term, F.struct("k", "s1", "s2", "lo", "hi", "h1", "h2").alias("_t")).alias("t"), same[0] & same[1]).select("r.*", "t._t")
    mean, sd, z = _others(F.col("rate"), F.col("_t"), F.col("_t.k"))
    return rows.where(F.col("_t.k") > 1).select(group, key, term, "rate", mean.alias("mean"), sd.alias("sd"), z.alias("z"))


def leave_one_out_vectors(rows: DataFrame, group: str, key: str, vector: str) -> DataFrame:
    """group, key and z, the vector of z's of each document's rates (null without
    spread) from the other documents of its group; groups of two or more.

    Totals are a row a group, as wide as the vector, so documents are dealt out
    once, whole, and only where the totals of all groups are too large to send."""
    long = rows.select(group, F.posexplode(vector).alias("_j", "_x"))
    by_place = long.groupBy(group, "_j").agg(*_totals(F.col("_x")))
    totals = by_place.groupBy(group).agg(F.max("k").alias("_k"), F.sort_array(F.collect_list(F.struct("_j", "s1", "s2", "lo", "hi", "h1", "h2"))).alias("_t")).where("_k > 1")
    joined = rows.alias("r").join(totals.alias("t"), F.col(f"r.{group}").eqNullSafe(F.col(f"t.{group}"))).select("r.*", "t._k", "t._t")

    def parts(x: Column, t: Column) -> Column:
        mean, sd, _ = _others(x, t, F.col("_k"))
        return F.struct((x - mean).alias("off"), sd.alias("sd"))

    # two steps, as what a lambda repeats is computed again
    z = F.transform(F.zip_with(vector, "_t", parts), lambda p: F.when(p["sd"] > 1e-9, p["off"] / F.when(p["sd"] > 1e-9, p["sd"]).otherwise(1.0)))
    return joined.select(group, key, z.alias("z"))


def _scored(docs: DataFrame, group: str, key: str) -> DataFrame:
    """z of every function word, as vectors; texts are read once."""
    rates = function_word_vectors(docs, [group, key]).select(group, key, F.transform("n", lambda n: F.lit(1000.0) * n / F.col("w")).alias("rates"))
    return leave_one_out_vectors(staged(rates, "rates"), group, key, "rates")


def function_word_delta(docs: DataFrame, group: str, key: str) -> DataFrame:
    """Each document's mean absolute z over all function words (those without
    spread count zero) from the other documents of its group."""
    total = F.aggregate("z", F.lit(0.0), lambda a, z: a + F.abs(F.coalesce(z, F.lit(0.0))))
    return _scored(docs, group, key).select(group, key, (total / len(L.FUNCTION_WORDS)).alias("delta"))


def verdicts(delta: DataFrame, group: str, key: str, least: int = 3) -> DataFrame:
    """MIRRORS or OUTLIER against the group's robust cutoff; groups of at least
    ``least`` documents.  Deltas are read for the median, the deviations and the
    verdicts, so they are computed once and staged."""
    delta = staged(delta.select(group, key, "delta"), "delta")
    cut = robust_high(delta, [group], "delta").where(F.col("n") >= least)
    rows = delta.join(cut.select(group, "n", "cutoff"), group)
    return rows.select(group, key, "n", "delta", "cutoff", F.when(F.col("delta") <= F.col("cutoff"), "MIRRORS").otherwise("OUTLIER").alias("verdict"))


def overused(docs: DataFrame, group: str, key: str, most: int = 8, over: float = 3.0) -> DataFrame:
    """A document's function words of z over 3, the top ones first."""
    listed = F.array(*[F.lit(w) for w in WORDS])
    named = F.zip_with("z", listed, lambda z, w: F.struct((-F.round(z, 6)).alias("less"), w.alias("word")))
    top = F.slice(F.sort_array(F.filter(named, lambda x: x["less"] < -over)), 1, most)
    rows = _scored(docs, group, key).select(group, key, F.posexplode(top).alias("at", "x"))
    return rows.select(group, key, (F.col("at") + 1).alias("rank"), "x.word", (-F.col("x.less")).alias("z"))


def bigram_delta(bigrams: DataFrame, group: str, key: str) -> DataFrame:
    """Mean absolute z of tag-bigram shares from the other documents of the
    group, over the bigrams with spread.  bigrams: group, key, pos1, pos2, n."""
    total = bigrams.groupBy(group, key).agg(F.sum("n").alias("total"))
    terms = bigrams.select(group, F.concat_ws(" ", "pos1", "pos2").alias("term")).distinct()
    full = total.join(terms, group).join(bigrams.select(group, key, F.concat_ws(" ", "pos1", "pos2").alias("term"), "n"), [group, key, "term"], "left")
    rates = full.select(group, key, "term", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("rate"))
    scored = leave_one_out(rates, group, key, "term")
    return scored.groupBy(group, key).agg(F.coalesce(F.avg(F.abs("z")), F.lit(0.0)).alias("delta"), F.count("z").alias("bigrams"))


def cosine(counts: DataFrame, left: str, right: str, pairs: DataFrame, item: str, term: str = "term", n: str = "n") -> DataFrame:
    """Cosine of term counts for given pairs of items; 0 where one is empty."""
    norms = counts.groupBy(item).agg(F.sqrt(F.sum(F.col(n) * F.col(n))).alias("norm"))
    a = counts.select(F.col(item).alias(left), F.col(term).alias("_t"), F.col(n).alias("_x"))
    b = counts.select(F.col(item).alias(right), F.col(term).alias("_t"), F.col(n).alias("_y"))
    dots = pairs.join(a, left).join(b, [right, "_t"]).groupBy(left, right).agg(F.sum(F.col("_x") * F.col("_y")).alias("dot"))
    rows = pairs.join(dots, [left, right], "left")
    for side, name in ((left, "_na"), (right, "_nb")):
        rows = rows.join(norms.select(F.col(item).alias(side), F.col("norm").alias(name)), side, "left")
    both = F.coalesce(F.col("_na") * F.col("_nb"), F.lit(0.0))
    return rows.select(left, right, F.round(F.when(both > 0, F.coalesce("dot", F.lit(0)) / F.when(both > 0, both).otherwise(1.0)).otherwise(0.0), 2).alias("cosine"))
