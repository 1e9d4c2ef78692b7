"""Tables of bounded size that every task gets: arrays by cell, bitmaps of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stage, unstage

PART = 4096
#: Least and most 64-bit words of a bitmap: it follows the number of keys up to
#: this bound on what tasks receive; a fuller one lets more keys through.
FILTER_WORDS = (1 << 10, 1 << 19)


def power_of_two(least: int, value: int, most: int) -> int:
    return min(most, max(least, 1 << max(0, int(value) - 1).bit_length()))


def array_table(values: DataFrame, size: int, kind: str) -> DataFrame:
    """One row: an array of ``size`` values; ``values`` has cell and value."""
    spark = values.sparkSession
    full = spark.range(size).join(values, F.col("id") == F.col("cell"), "left").select("id", F.coalesce("value", F.lit(0)).cast(kind).alias("value"))
    parts = full.groupBy(F.floor(F.col("id") / PART).alias("part")).agg(F.sort_array(F.collect_list(F.struct("id", "value"))).alias("cells"))
    parts = parts.select("part", F.col("cells.value").alias("cells"))
    rows = parts.agg(F.sort_array(F.collect_list(F.struct("part", "cells"))).alias("parts"))
    return stage(rows.select(F.flatten("parts.cells").alias("cells")), "cells")


class KeyFilter:
    """A bitmap of 64-bit keys, read by native expressions; it may let others
    through as well."""

    def __init__(self, keys: DataFrame, count: int):
        """``keys`` has a column key; ``count`` says about how many they are."""
        self.words = power_of_two(FILTER_WORDS[0], count // 4, FILTER_WORDS[1])
        cell = F.pmod("key", F.lit(self.words * 64))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
        bits = keys.select(F.floor(cell / 64).alias("cell"), bit.alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("value"))
        self.table = array_table(bits, self.words, "bigint")

    def holds(self, key: Column) -> Column:
        cell = F.pmod(key, F.lit(self.words * 64))
        word = F.get(self.table.scalar(), F.floor(cell / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, (cell % 64).cast("int")).bitwiseAND(F.lit(1)) == 1

    def drop(self) -> None:
        unstage(self.table)
