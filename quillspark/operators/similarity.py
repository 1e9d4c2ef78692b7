"""The most similar pairs of a document's parts, without listing its pairs.

A part is a vector of term counts.  A few pairs, in proportion to the parts, are
measured first; the last of the best of them is a bound that every wanted pair must
reach.  Under one order of terms, rarest first, a part posts its terms only as long
as the weight that remains could still reach that bound: a pair whose first common
term isn't posted by both can't.  Pairs that meet in a posting are measured exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staged import staged

#: Half a step of the rounded cosine, and more than floating point can be off.
HALF, SLACK = 0.005, 1e-9
#: Parts up to which a document's pairs are all measured in its own row, and terms
#: of its count table that are multiplied at a time.
WITHIN = 256
COLUMNS = 4096


def cents(x: Column) -> Column:
    """To two decimals, half up by the number as it is: ``round`` goes by its shortest
    decimals, and would make 0.15 of the 0.145 that is a little less."""
    return F.round(x * 100) / 100


def _measured(pairs: DataFrame, counts: DataFrame, norms: DataFrame, key: str) -> DataFrame:
    """The pairs (key, a, b) with their cosine to two decimals; 0 for empty parts."""
    x, y = (counts.select(key, F.col("part").alias(side), "term", F.col("n").alias(f"_n{side}")) for side in "ab")
    dots = pairs.join(x, [key, "a"]).join(y, [key, "b", "term"]).groupBy(key, "a", "b").agg(F.sum(F.col("_na") * F.col("_nb")).alias("_dot"))
    rows = pairs.join(dots, [key, "a", "b"], "left")
    for side in "ab":
        rows = rows.join(norms.select(key, F.col("part").alias(side), F.col("norm").alias(f"_l{side}")), [key, side], "left")
    return rows.select(key, "a", "b", cents(F.coalesce(F.col("_dot") / (F.col("_la") * F.col("_lb")), F.lit(0.0))).alias("cosine"))


def _seeds(parts: DataFrame, counts: DataFrame, key: str, most: int) -> DataFrame:
    """Pairs in proportion to the parts: those of the first few, which hold the first
    pairs by place, and neighbours in the order of their most frequent term."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("part"))
    head = parts.withColumn("_i", place).where(F.col("_i") <= 2 * most + 1)
    first = head.select(key, F.col("part").alias("a")).join(head.select(key, F.col("part").alias("b")), key).where("a < b")
    heavy = counts.groupBy(key, "part").agg(F.max(F.struct("n", "term")).alias("_h"))
    order = Window.partitionBy(key).orderBy("_h.term", "part")
    near = heavy.select(key, F.col("part").alias("x"), F.lag("part").over(order).alias("y")).where("y is not null")
    return first.unionByName(near.select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def candidate_pairs(counts: DataFrame, norms: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """The pairs (key, a, b) that may reach their document's bound."""
    common = counts.groupBy(key, "term").agg(F.count("*").alias("_df")).where("_df > 1")
    rows = counts.join(common, [key, "term"], "left").join(norms, [key, "part"]).join(bounds, key)
    rows = rows.withColumn("_w", F.col("n") * F.col("n") / (F.col("norm") * F.col("norm")))
    # a term of one part alone meets nothing: it is posted last and never read
    behind = Window.partitionBy(key, "part").orderBy(F.col("_df").desc_nulls_first(), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shared = rows.where("_df is not null").withColumn("_left", F.sqrt(F.sum("_w").over(behind)))
    posted = shared.where(F.col("_left") >= F.col("bound") - SLACK).select(key, "term", "part")
    met = posted.select(key, "term", F.col("part").alias("a")).join(posted.select(key, "term", F.col("part").alias("b")), [key, "term"]).where("a < b")
    return met.select(key, "a", "b").distinct()


def most_similar(parts: DataFrame, counts: DataFrame, key: str, most: int = 6) -> DataFrame:
    """key, rank, a, b and cosine (two decimals) of the ``most`` most similar pairs
    of parts of each document; ties by a and b.

    parts: key and part, one row each; counts: key, part, term and n of parts' terms.
    Rows of a null key are left out."""
    parts = parts.where(F.col(key).isNotNull())
    counts = staged(counts.where(F.col(key).isNotNull()).select(key, "part", "term", "n"), "terms")
    norms = staged(counts.groupBy(key, "part").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")), "norms")
    top = Window.partitionBy(key).orderBy(F.desc("cosine"), "a", "b")
    seeds = staged(_measured(_seeds(parts, counts, key, most), counts, norms, key), "seeds")
    last = seeds.withColumn("_r", F.row_number().over(top)).where(F.col("_r") <= most).groupBy(key).agg(F.min("cosine").alias("_last"))
    # pairs that round to the last one's cosine may come before it
    bounds = last.select(key, (F.greatest("_last", F.lit(2 * HALF)) - HALF).alias("bound"))
    rest = candidate_pairs(counts, norms, bounds, key).join(seeds, [key, "a", "b"], "left_anti")
    every = _measured(rest, counts, norms, key).unionByName(seeds)
    return every.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most).select(key, "rank", "a", "b", "cosine")


def row_cosines(terms: list[list[str]]) -> np.ndarray:
    """The cosines of all parts of one document, to two decimals as ``cents`` does;
    0 for empty parts."""
    parts, codes = len(terms), {}
    at = np.fromiter((codes.setdefault(t, len(codes)) for own in terms for t in own), np.int64)
    of = np.repeat(np.arange(parts), [len(own) for own in terms])
    words = len(codes)
    cells, n = np.unique(at * parts + of, return_counts=True)
    dots = np.zeros((parts, parts))
    for low in range(0, words, COLUMNS):
        a, b = np.searchsorted(cells, (low * parts, (low + COLUMNS) * parts))
        table = np.zeros((min(COLUMNS, words - low), parts))
        table[cells[a:b] // parts - low, cells[a:b] % parts] = n[a:b]
        dots += table.T @ table  # whole numbers
    norms = np.sqrt(np.diag(dots))
    lengths = np.outer(norms, norms)
    hundredths = np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0) * 100
    whole = np.floor(hundredths)
    return (whole + (hundredths - whole >= 0.5)) / 100


def most_similar_in_rows(rows: DataFrame, key: str, terms: Callable[[str], list[str]], most: int = 6) -> DataFrame:
    """As ``most_similar`` for rows of a document each: key, and texts, an array of
    its parts, from which ``terms`` makes their terms.  A document's pairs are
    measured where its row is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = batch.column(0), []
            for k, texts in enumerate(batch.column(1)):
                cosines = row_cosines([terms(t) for t in texts.as_py()])
                a, b = np.triu_indices(len(cosines), 1)
                best = np.argsort(-cosines[a, b], kind="stable")[:most]
                out.append((np.full(len(best), k), np.arange(1, len(best) + 1), a[best], b[best], cosines[a[best], b[best]]))
            columns = [np.concatenate(c) for c in zip(*out)]
            if len(columns):
                ints = [pa.array(c.astype(np.int32)) for c in columns[1:4]]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(columns[0])), *ints, pa.array(columns[4])], names=[key, "rank", "a", "b", "cosine"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.where(F.size("texts") > 1).select(key, "texts").mapInArrow(run, f"`{key}` {kind}, rank int, a int, b int, cosine double")
