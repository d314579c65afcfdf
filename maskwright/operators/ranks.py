"""Dense positions without a single-partition window, and the j-th free number of a range."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import materialize


def dense_index(df: DataFrame, *order: Column | str, name: str = "k") -> DataFrame:
    """df with the position of each row in an order, from 0: a range-partitioned sort, then offsets by partition.

    The sorted rows are written before they are counted, so that a lost task can't renumber them.
    """
    spot = F.monotonically_increasing_id()
    fixed = materialize(df.orderBy(*order).withColumn("_spot", spot), "ranked")
    part = F.shiftright("_spot", 33)
    counts = sorted((r["p"], r["n"]) for r in fixed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts = dict(zip((p for p, _ in counts), accumulate([0, *(n for _, n in counts)]), strict=False))
    if not starts:
        return fixed.withColumn(name, F.lit(0).cast("bigint")).drop("_spot")
    offsets = F.create_map(*(x for p, s in starts.items() for x in (F.lit(p).cast("bigint"), F.lit(s).cast("bigint"))))
    return fixed.withColumn(name, F.element_at(offsets, part) + F.col("_spot").bitwiseAND(F.lit((1 << 33) - 1))).drop("_spot")


def free_before(blocked: DataFrame, low: int) -> DataFrame:
    """Distinct blocked values from low on -> value, rank and the number of free values before it."""
    ranked = dense_index(blocked.select("value").distinct(), "value", name="rank")
    return ranked.withColumn("free", F.col("value") - low - F.col("rank"))


def jth_free(wanted: DataFrame, blocked: DataFrame, low: int) -> DataFrame:
    """wanted (j) -> j, value: the j-th number from low on that isn't blocked, j from 0.

    The answer is low + j + the number of blocked values with at most j free values before them. Both sides are
    stacked, ordered together, and the blocked ones counted along the order.
    """
    steps = free_before(blocked, low).groupBy("free").agg(F.count("*").alias("n"))
    both = steps.select(F.col("free").alias("j"), F.lit(0).alias("kind"), "n").unionByName(wanted.select("j", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n")))
    return running_total(both, ["j", "kind"], "n").filter("kind = 1").select("j", (F.lit(low) + F.col("j") + F.col("total")).alias("value"))


def running_total(df: DataFrame, order: list[str], amount: str) -> DataFrame:
    """df with the sum of amount over rows up to this one: sums within sorted partitions, then offsets by partition."""
    fixed = materialize(df.orderBy(*order).withColumn("_spot", F.monotonically_increasing_id()), "running")
    part = F.shiftright("_spot", 33)
    sums = sorted((r["p"], r["s"]) for r in fixed.groupBy(part.alias("p")).agg(F.sum(amount).alias("s")).collect())
    starts = dict(zip((p for p, _ in sums), accumulate([0, *(s for _, s in sums)]), strict=False))
    if not starts:
        return fixed.withColumn("total", F.lit(0).cast("bigint")).drop("_spot")
    offsets = F.create_map(*(x for p, s in starts.items() for x in (F.lit(p).cast("bigint"), F.lit(s).cast("bigint"))))
    within = Window.partitionBy(part).orderBy("_spot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return fixed.withColumn("total", F.element_at(offsets, part) + F.sum(amount).over(within)).drop("_spot")
