"""Latest, previous and capped rows of keys, and writes that keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.operators.shared import numbered


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order that must end in a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], column: str, name: str) -> DataFrame:
    """Adds the value that ``column`` had in the row before of the same key."""
    return df.withColumn(name, F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], most: Column | int, name: str = "position") -> DataFrame:
    """The first ``most`` rows of each key, numbered from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks; of a key met again in ``new``, the first row."""
    return old.unionByName(latest_by(new, keys, order).join(old.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the last of ``new``, else that of ``old``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest_by(both, keys, [F.desc("_new"), *order]).drop("_new")


def soft_drop(df: DataFrame, reasons: Sequence[tuple[str, Column]], kept: str = "kept") -> DataFrame:
    """Adds status and dropped_reason: the name of the first condition that holds. No row goes."""
    reason = F.coalesce(*(F.when(test, F.lit(name)) for name, test in reasons))
    return df.withColumn("dropped_reason", reason).withColumn("status", F.when(reason.isNull(), kept).otherwise("dropped"))


def interleaved_batches(df: DataFrame, group: str, order: Sequence[str], size: int) -> DataFrame:
    """Adds batch and place: one row of each group a round, in rounds of the groups' order, cut into batches of ``size``.

    Rows are numbered in the order of rounds and groups by ranges (see ``numbered``), so that no task sees all groups of a round.
    """
    ranked = df.withColumn("_round", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered(ranked, ["_round", group], "place").withColumn("batch", F.floor(F.col("place") / size).cast("long")).drop("_round")


def places(df: DataFrame, ranges: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """Adds place, from 1, in the order of ``ranges`` (ascending, nulls first) and then of ``order``.

    No window spans all rows: ranges are counted and summed up, and a row's place is its
    range's start and its rank in it. ``ranges`` must cut finely enough for one of them to fit a task.
    """
    keyed = df.withColumn("_range", F.struct(*(c.alias(f"k{i}") for i, c in enumerate(ranges))))
    starts = keyed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    ranked = keyed.withColumn("_in", F.row_number().over(Window.partitionBy("_range").orderBy(*order))).join(starts, "_range")
    return ranked.withColumn("place", F.col("_start") + F.col("_in")).drop("_range", "_in", "_start")


def repoint(df: DataFrame, column: str, merged: DataFrame) -> DataFrame:
    """``column`` with ids of merged entities replaced; ``merged`` has (loser, kept)."""
    m = merged.select(F.col("loser").alias("_loser"), F.col("kept").alias("_kept"))
    return df.join(m, F.col(column) == F.col("_loser"), "left").withColumn(column, F.coalesce("_kept", column)).drop("_loser", "_kept")
