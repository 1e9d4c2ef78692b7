"""Style vectors of two groups: prototypes, margins, axes, probes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.staged import staged
from .selection import medians


def chunks(docs: DataFrame, keys: list[str], words: int = 120, most: int | None = 48) -> DataFrame:
    """The word chunks a document's style vector is averaged over; all if most is None."""
    return word_blocks(docs, keys, words, most).select(*keys, F.posexplode("blocks").alias("chunk", "text"))


def word_blocks(docs: DataFrame, keys: list[str], words: int, most: int | None) -> DataFrame:
    """keys and the array of a document's chunks (blocks).  Its words are an array of
    its own: within the expression of a chunk they would be made anew for each."""
    split = F.split(F.trim(F.regexp_replace(T.without_parentheses(T.prose(F.col("text"))), r"\s+", " ")), " ")
    rows = docs.select(*keys, F.explode(F.array(split)).alias("_w"))
    n = F.ceil(F.size("_w") / words).cast("int")
    n = n if most is None else F.least(n, F.lit(most))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.array_join(F.slice("_w", i * words + 1, F.lit(words)), " "))
    return rows.select(*keys, F.filter(parts, lambda x: x != "").alias("blocks"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def mean_vectors(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean vector of each group, one aggregate per component."""
    long = rows.select(*by, F.posexplode(vector).alias("i", "x"))
    mean = long.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("mean"))


def _length(v: str) -> Column:
    return F.greatest(F.sqrt(dot(F.col(v), F.col(v))), F.lit(1e-12))


def _normalised(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """The rows with the vector at length one; its length is a column of its own, or
    it would be taken again for every component."""
    rows = rows.withColumn("_length", _length(vector))
    return rows.withColumn(name, F.transform(vector, lambda x: x.cast("double") / F.col("_length"))).drop("_length")


def document_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """A document's normalised mean over its chunks' vectors."""
    return _normalised(mean_vectors(rows, [key], vector), "mean", "v").select(key, "v")


def prototype_margins(rows: DataFrame, key: str, side: str, vector: str) -> DataFrame:
    """Nearness to side 1's prototype less that to side 0's.

    A vector's own side leaves it out: sums less itself, so nothing is paired.
    rows: key, side (1 or 0), vector."""
    unit = _normalised(rows.select(key, side, vector), vector, "v").select(key, side, "v")
    long = unit.select(side, F.posexplode("v").alias("i", "x"))
    sums = long.groupBy(side, "i").agg(F.sum("x").alias("x")).groupBy(side).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda z: z["x"]).alias("s"))
    # two rows, each of a vector's length
    both = sums.agg(*[F.first(F.when(F.col(side) == s, F.col("s")), ignorenulls=True).alias(f"s{s}") for s in (0, 1)])
    rows = unit.withColumns({"s0": both.select("s0").scalar(), "s1": both.select("s1").scalar()})

    rest = {f"r{s}": F.when(F.col(side) == s, F.zip_with(f"s{s}", "v", lambda a, b: a - b)).otherwise(F.col(f"s{s}")) for s in (0, 1)}
    rows = rows.withColumns(rest)
    near = [dot(F.col("v"), F.col(f"r{s}")) / _length(f"r{s}") for s in (0, 1)]
    return rows.select(key, side, (near[1] - near[0]).alias("margin"))


def margin_threshold(margins: DataFrame, side: str) -> DataFrame:
    """One row: the mean of the two sides' median margins."""
    by_side = medians(margins, [side], "margin")
    mids = by_side.agg(*[F.max(F.when(F.col(side) == s, F.col("mid"))).alias(f"m{s}") for s in (0, 1)])
    return mids.select(((F.col("m0") + F.col("m1")) / 2).alias("threshold"))


def margin_verdicts(margins: DataFrame, side: str, key: str) -> DataFrame:
    margins = staged(margins, "margins")  # read for the medians and for the verdicts
    rows = margins.withColumn("threshold", margin_threshold(margins, side).scalar())
    return rows.select(key, side, F.round("margin", 6).alias("margin"), (F.round("margin", 6) > F.round("threshold", 6)).alias("side_1"))


def axis_correlations(rows: DataFrame, key: str, side: str, vector: str, features: DataFrame, names: list[str]) -> DataFrame:
    """Pearson r of each feature with the projection on the normalised mean
    difference of the sides."""
    means = mean_vectors(rows.select(side, vector), [side], vector)
    both = means.agg(*[F.first(F.when(F.col(side) == s, F.col("mean")), ignorenulls=True).alias(f"m{s}") for s in (0, 1)])
    axis = _normalised(both.select(F.zip_with("m1", "m0", lambda a, b: a - b).alias("between")), "between", "axis").select("axis")
    projected = rows.withColumn("axis", axis.scalar()).select(key, dot(F.col(vector), F.col("axis")).alias("t")).join(features, key)
    long = projected.unpivot([key, "t"], names, "feature", "value")
    return long.groupBy("feature").agg(F.round(F.coalesce(F.corr("t", "value"), F.lit(0.0)), 6).alias("r"))


def _gram_cells(data: DataFrame, width: int, folds: int) -> DataFrame:
    """fold, i, j and value: the sums of products of every two columns of the rows
    [1, vector, targets], fold by fold; a task adds its rows up before it hands on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((folds, width, width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            fold = batch.column("fold").to_numpy()
            for k in range(folds):
                own = x[fold == k]
                grams[k] += own.T @ own
        k, i, j = np.nonzero(grams)
        columns = [pa.array(c, pa.int32()) for c in (k, i, j)] + [pa.array(grams[k, i, j])]
        yield pa.RecordBatch.from_arrays(columns, ["fold", "i", "j", "value"])

    cells = data.mapInArrow(run, "fold int, i int, j int, value double")
    return cells.groupBy("fold", "i", "j").agg(F.sum("value").alias("value"))


def held_out_r2(grams: np.ndarray, dims: int, alpha: float) -> list[float]:
    """Mean held-out R2 of each target, from the folds' sums of products alone.

    Columns are a constant, ``dims`` components and the targets.  Training sums are
    all folds' less the held-out one's; components and targets are centred by them,
    and the held-out errors follow from the held-out sums."""
    total, scores = grams.sum(0), []
    at, of = slice(1, dims + 1), slice(dims + 1, None)
    for held in grams:
        train, n, m = total - held, (total - held)[0, 0], held[0, 0]
        if n < 1 or m < 2:
            continue
        mean_x, mean_y = train[0, at] / n, train[0, of] / n
        left = train[at, at] - n * np.outer(mean_x, mean_x) + alpha * np.eye(dims)
        weights = np.linalg.solve(left, train[at, of] - n * np.outer(mean_x, mean_y))
        bias = mean_y - mean_x @ weights
        model = np.vstack([bias, weights])  # over the constant and the components
        inner = slice(0, dims + 1)
        errors = np.diag(held[of, of]) - 2 * (model * held[inner, of]).sum(0) + (model * (held[inner, inner] @ model)).sum(0)
        spread = np.diag(held[of, of]) - held[0, of] ** 2 / m
        scores.append(np.where(spread > 1e-12 * np.maximum(np.diag(held[of, of]), 1e-300), 1 - errors / np.where(spread > 0, spread, 1.0), 0.0))
    return np.maximum(np.mean(scores, axis=0), 0.0).tolist() if scores else [0.0] * (grams.shape[1] - dims - 1)


def probes(rows: DataFrame, vector: str, targets: list[str], alpha: float = 1.0, folds: int = 5, seed: int = 0) -> DataFrame:
    """feature and r2: the cross-validated R2, 0 at least, of a ridge probe from
    vectors to each target, all targets and folds in one pass over the rows.

    ``alpha`` penalises the sum of squared weights.  Folds go by a hash of the
    vector.  What leaves a task are sums of products, as wide as a vector and the
    targets together; vectors of another length than most, and rows with a null or
    non-finite number in the vector or any target, take no part."""
    numbers = F.concat(F.array(F.lit(1.0)), F.col(vector).cast("array<double>"), F.array(*[F.col(t).cast("double") for t in targets]))
    data = rows.select(F.pmod(F.xxhash64(vector, F.lit(seed)), F.lit(folds)).cast("int").alias("fold"), numbers.alias("x"))
    # read for the width and for the sums: computed once
    data = data.where(F.coalesce(F.forall("x", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False)))
    data = staged(data, "numbers")
    sizes = data.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("k")).agg(F.max_by("w", F.struct("k", -F.col("w"))).alias("w")).first()
    width = sizes.w or len(targets) + 1
    names, dims = list(targets), width - len(targets) - 1

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        grams = np.zeros((folds, width, width))
        grams[cells["fold"], cells["i"], cells["j"]] = cells["value"]
        return pd.DataFrame({"feature": names, "r2": held_out_r2(grams, dims, alpha)})

    cells = _gram_cells(data.where(F.size("x") == width), width, folds)
    # folds x width x width numbers, whatever the rows
    return cells.groupBy().applyInPandas(solve, "feature string, r2 double")
