"""Exact order statistics of continuous values, by radix descent.

A double's 64 bits, read as a signed number in the order of the values, are looked
at 16 at a time.  Each level counts, map-side, how many values of a group have each
digit; the cumulated counts say in which digit a wanted rank lies, and the next
level counts only the values under that prefix.  After four levels the prefix is
the value.  A level's counts are at most 65536 rows for a group and prefix, whatever
the group's size, and no task sorts, buffers or even sees a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.staged import staged

LEVELS = 4
DIGIT = 64 // LEVELS
#: Rows of (group, wanted rank) up to which prefixes are sent to every task.
FEW_PREFIXES = 100_000
LEAST_NORMAL = 2.0 ** -1022


def order_key(value: Column) -> Column:
    """The bits of a double as a signed long, in the order of the values: NaN after
    infinity, both zeros equal."""
    a = F.abs(value)
    guess = F.floor(F.log2(a))
    scaled = a / F.pow(F.lit(2.0), guess)
    # the logarithm may be off by one next to a power of two
    exponent = guess + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    mantissa = ((a / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0 ** 52)).cast("long")
    normal = (exponent + 1023) * F.lit(1 << 52) + mantissa
    small = (a * F.lit(2.0 ** 537) * F.lit(2.0 ** 537)).cast("long")
    bits = F.when(F.isnan(value), F.lit((2047 << 52) + 1)).when(a == float("inf"), F.lit(2047 << 52)).when(a < LEAST_NORMAL, small).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def select_ranks(rows: DataFrame, group: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """group, n (values of the group) and, by name, the value at each zero-based
    rank, a function of n.  Null values take no part; null groups are groups; with
    no group columns there is one row, and none for an empty table."""
    of = F.struct(*group) if group else F.struct(F.lit(0).alias("all"))
    v = F.col(value).cast("double")
    keyed = staged(rows.where(F.col(value).isNotNull()).select(of.alias("_g"), v.alias("_v"), order_key(v).alias("_k")), "keyed")

    def prefix(level: int) -> Column:
        return F.shiftright("_k", 64 - DIGIT * (level + 1))

    sizes = staged(keyed.groupBy("_g").agg(F.count("*").alias("_n")), "sizes")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), at(F.col("_n")).cast("long").alias("rank")) for name, at in ranks.items()])
    live = sizes.select("_g", F.lit(0).cast("long").alias("_p"), "_n", wanted.alias("_w"))
    few = sizes.count() * len(ranks) <= FEW_PREFIXES
    for level in range(LEVELS):
        above = prefix(level - 1) if level else F.lit(0).cast("long")
        under = keyed.withColumn("_p", above).join(F.broadcast(live) if few else live, ["_g", "_p"])
        counts = under.groupBy("_g", "_p", "_n", "_w", prefix(level).alias("_d")).agg(F.count("*").alias("_c"), F.min("_v").alias("_x"))
        upto = Window.partitionBy("_g", "_p").orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = F.col("_to") - F.col("_c")
        held = F.filter("_w", lambda w: (w["rank"] >= before) & (w["rank"] < F.col("_to")))
        inside = F.transform(held, lambda w: F.struct(w["name"].alias("name"), (w["rank"] - before).alias("rank")))
        found = counts.withColumn("_to", F.sum("_c").over(upto)).withColumn("_w", inside).where(F.size("_w") > 0)
        live = found.select("_g", F.col("_d").alias("_p"), "_n", "_w", "_x")
        if level < LEVELS - 1:
            live = live.drop("_x")
    each = live.select("_g", "_n", "_x", F.explode("_w.name").alias("_name"))
    out = each.groupBy("_g").agg(F.max("_n").alias("n"), *[F.max(F.when(F.col("_name") == name, F.col("_x"))).alias(name) for name in ranks])
    return out.select(*[F.col("_g")[c].alias(c) for c in group], "n", *ranks)


def medians(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, n and mid, the mean of the two middle values."""
    found = select_ranks(rows, group, value, {"_low": lambda n: F.floor((n - 1) / 2), "_high": lambda n: F.ceil((n - 1) / 2)})
    return found.select(*group, "n", (F.col("_low") * 0.5 + F.col("_high") * 0.5).alias("mid"))
