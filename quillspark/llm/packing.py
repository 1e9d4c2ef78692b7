"""Best-two-fit packing of token pieces into fixed-length sequences.

The plan depends only on how many pieces have each length, at most ``capacity``
numbers, so it is made on the driver from a histogram and its cost does not grow
with the corpus.  A bin is filled greedily (largest piece, then each time the
largest that fits); then its smallest piece is replaced by the two unpacked
pieces that fit the expanded gap more tightly, if there are such.  A bin shape
is repeated as often as the counts allow, which uses up at least one length, so
a plan has a few thousand shapes at most.

Pieces then take their places without meeting in one task: a piece's number
among those of its length is a prefix count over (length, salt) groups plus its
row number in its own group.  One length may hold any share of the rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_bpe import byte_bpe
from .runtime import stage

END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, copy long"


def _pair(open_lengths: np.ndarray, counts: np.ndarray, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths with the largest sum that fits ``gap``."""
    usable = open_lengths[open_lengths <= gap]
    if not len(usable):
        return None
    # the largest partner of each length, by position in the sorted lengths
    at = np.searchsorted(usable, gap - usable, side="right") - 1
    same = (at >= 0) & (usable[np.maximum(at, 0)] == usable) & (counts[usable] < 2)
    at = np.where(same, at - 1, at)
    sums = np.where(at >= 0, usable + usable[np.maximum(at, 0)], -1)
    best = int(np.argmax(sums))
    return (int(usable[best]), int(usable[at[best]])) if sums[best] > 0 else None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Bin shapes and how often each is used: (lengths largest first, times)."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    shapes = []
    while counts.any():
        left = counts.copy()
        lengths = np.flatnonzero(left)
        shape, gap = [], capacity
        while len(fit := lengths[: np.searchsorted(lengths, gap, side="right")]):
            largest = int(fit[-1])
            take = min(int(left[largest]), gap // largest)
            shape += [largest] * take
            left[largest] -= take
            gap -= largest * take
            if not left[largest]:
                lengths = np.flatnonzero(left)
            elif not gap:
                break
        if gap and len(shape) > 1:
            smallest = shape[-1]
            pair = _pair(lengths, left, gap + smallest)
            if pair and sum(pair) > smallest:
                shape = sorted(shape[:-1] + list(pair), reverse=True)
        used = {length: shape.count(length) for length in shape}
        times = min(int(counts[length]) // n for length, n in used.items())
        for length, n in used.items():
            counts[length] -= n * times
        shapes.append((shape, times))
    return shapes


class Places:
    """Where the k-th piece of each length goes, from a plan."""

    def __init__(self, shapes: list[tuple[list[int], int]]):
        ranges: dict[int, list[tuple[int, int, int]]] = {}
        taken: dict[int, int] = {}
        bins = 0
        for shape, times in shapes:
            offset = 0
            for length in shape:
                ranges.setdefault(length, []).append((taken.get(length, 0), bins, offset))
                taken[length] = taken.get(length, 0) + times
                offset += length
            bins += times
        self.bins = bins
        self.ranges = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in ranges.items()}

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length):
            at = np.flatnonzero(length == value)
            first, base, places = self.ranges[int(value)]
            which = np.searchsorted(first, number[at], side="right") - 1
            sequence[at] = base[which] + number[at] - first[which]
            offset[at] = places[which]
        return sequence, offset


def cut(docs: DataFrame, tokenizer: str, capacity: int) -> DataFrame:
    """Pieces of every document; only one of over ``capacity`` ids is cut, into
    whole sequences behind a first piece that may be shorter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end, copy = byte_bpe(tokenizer).encode, np.array([END_ID], "<u4").tobytes(), 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                ids = memoryview(encode(text or "") + end)
                n, begin, piece, copy = len(ids) // 4, 0, 0, copy + 1
                stop = n % capacity or min(n, capacity)
                while begin < n:
                    rows.append((doc_id, piece, begin, stop - begin, zlib.crc32(ids[4 * begin: 4 * stop]), copy))
                    begin, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "copy"])
            yield out.astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """A row per piece with its sequence and offset.

    A null text is empty and still has its end id; repeated rows and equal ids
    are packed as separate pieces; an empty table gives no rows.
    """
    spark = docs.sparkSession
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "copy"), F.lit(salts)).cast("int")
    pieces = stage(cut(docs, tokenizer, capacity).withColumn("salt", salt), "pieces")
    groups = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most capacity rows reach the driver
    histogram = {r.length: r.n for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    # a row per length and salt: capacity x salts at most
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("length", "salt", F.coalesce(F.sum("n").over(by_length), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "copy")
    numbered = pieces.withColumn("number", F.row_number().over(own) - 1).join(before, ["length", "salt"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = places.value(batch["length"].to_numpy(), batch["number"].to_numpy() + batch["before"].to_numpy())
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "piece": batch["piece"], "start": batch["start"], "length": batch["length"], "ids_crc32": batch["ids_crc32"], "sequence_id": sequence, "offset": offset})

    return numbered.mapInPandas(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
