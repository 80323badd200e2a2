"""Neighbouring rows within cases and within lives of objects, however long one of them is.

A window deals each key to one task. Here a key of many rows is cut into ranges of its order first; neighbours
are found within each range, and the ends of ranges are stitched to the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a key from which it is cut into ranges.
LONG = 1_000_000
#: Ranges that all long keys are cut into together, on average; each is drawn from so many sampled rows.
RANGES, DRAWN = 256, 16


def neighbours(rows: DataFrame, keys: list[str], order: list[str], new: dict[str, str], step: int = 1, sizes: DataFrame | None = None, long: int = LONG) -> DataFrame:
    """rows with, for each (name: column) of new, the column's value in the next row (step 1) or the one before
    (step -1) of the same keys, in the order given; null where there is none.

    Null keys are a key. Rows that are equal in the order stand in any order. sizes (keys, n) may hold upper bounds
    of the rows per key, to save counting; its keys may be fewer. Empty tables stay empty. Results do not depend on
    long.
    """
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    names = [c for c in sizes.columns if c != "n"]
    hot = sizes.filter(F.col("n") > long)
    total = hot.agg(F.sum("n")).first()[0]
    if not total:
        return _within(rows, keys, order, new, step)
    hot, same = hot.select(*[F.col(c).alias(f"_hot_{c}") for c in names]), _same(names, "_hot_")
    return _within(rows.join(hot, same, "left_anti"), keys, order, new, step).unionByName(_ranges(rows.join(hot, same, "left_semi"), keys, order, new, step, total))


def _within(rows: DataFrame, keys: list[str], order: list[str], new: dict[str, str], step: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.select("*", *[F.lead(c, step).over(w).alias(n) for n, c in new.items()])


def ranged(rows: DataFrame, keys: list[str], order: list[str], total: int) -> DataFrame:
    """rows with _range, which cuts each key's order into ranges of about total / RANGES rows; total is the number of
    rows or more. Cuts are drawn by hash, so that they are the same whenever they are worked out again."""
    at = F.struct(*order)
    drawn = rows.filter(F.pmod(F.xxhash64(*keys, *order), F.lit(max(1, total // (RANGES * DRAWN)))) == 0).select(*keys, at.alias("_at")).distinct()
    every = drawn.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy("_at"))).filter(F.col("_i") % DRAWN == 0)  # a sample of RANGES * DRAWN rows
    cuts = every.groupBy(*[F.col(k).alias(f"_cut_{k}") for k in keys]).agg(F.collect_list("_at").alias("_cuts"))
    cut = rows.join(F.broadcast(cuts), _same(keys, "_cut_"), "left")
    return cut.select(*rows.columns, F.when(F.col("_cuts").isNull(), 0).otherwise(F.size(F.filter("_cuts", lambda c: c <= at))).alias("_range"))


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys])


def _ranges(rows: DataFrame, keys: list[str], order: list[str], new: dict[str, str], step: int, total: int) -> DataFrame:
    cut = ranged(rows, keys, order, total)
    w = W.partitionBy(*keys, "_range").orderBy(*order)
    found = cut.select("*", *[F.lead(c, step).over(w).alias(n) for n, c in new.items()], F.lead(F.lit(1), step).over(w).isNull().alias("_end"))
    pick = F.min_by if step > 0 else F.max_by
    ends = cut.groupBy(*keys, "_range").agg(pick(F.struct(*[F.col(c).alias(n) for n, c in new.items()]), F.struct(*order)).alias("_near"))
    beside = ends.select(*[F.col(k).alias(f"_cut_{k}") for k in keys], F.col("_range").alias("_of"), F.lead("_near", step).over(W.partitionBy(*keys).orderBy("_range")).alias("_near"))
    both = found.join(beside, _same(keys, "_cut_") & (F.col("_range") == F.col("_of")), "left")  # a row per range
    return both.select(*rows.columns, *[F.when(F.col("_end"), F.col("_near").getField(n)).otherwise(F.col(n)).alias(n) for n in new])
