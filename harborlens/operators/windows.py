"""Sliding windows over daily panes: each row is counted once, in its day's pane, and the panes are combined."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.operators.shared import parts_for

#: How many rows of panes a task takes.
ROWS = 250_000
#: How the panes of a measure become a window's: sums and counts add up, extremes are extremes of extremes.
COMBINE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def made(measures: Mapping[str, tuple[str, str]]) -> list[Column]:
    """The aggregates that make a pane."""
    make = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    return [make[kind](F.expr(c)).alias(name) for name, (kind, c) in measures.items()]


def daily_panes(rows: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """(keys, day, measures): a pane for each key and day with rows; ``measures`` are name -> (sum, count, min or max; expression). Rows without a time have no day.

    Nearly each row has a pane of its own, so summing up before the shuffle would hold nearly all rows of a task: rows are dealt by pane, into parts by their number.
    """
    told = rows.select(*keys, F.col(ts).alias("_ts"), *(F.expr(c).alias(name) for name, (_, c) in measures.items()))
    days = told.where(F.col("_ts").isNotNull()).withColumn("day", F.to_date("_ts")).drop("_ts").repartition(parts_for(rows, ROWS), *keys, "day")
    measures = {name: (kind, f"`{name}`") for name, (kind, _) in measures.items()}
    return days.groupBy(*keys, "day").agg(*made(measures))


def slides(panes: DataFrame, keys: Sequence[str], measures: Mapping[str, str], days: int = 30, parts: int | None = None) -> DataFrame:
    """(keys, day, measures, panes): the window of ``days`` days that ends with ``day``, for each day on which it changes, because a pane comes or the oldest one leaves.

    Over panes (keys, day, measures: name -> how it combines). A pane is put down twice, once with its values and once empty on the day on which it leaves: two rows
    a pane instead of one for each of the windows that hold it. Days between two changes have the window of the earlier one; empty windows have null measures (counts: 0).
    Panes are dealt by key once, into ``parts`` (None: as many as Spark takes), and put down twice where they are.
    """
    names = list(measures)
    coming = F.struct("day", *names, F.lit(1).alias("_n"))
    leaving = F.struct(F.date_add("day", days).alias("day"), *(F.lit(None).cast(panes.schema[n].dataType).alias(n) for n in names), F.lit(0).alias("_n"))
    both = panes.repartition(*([] if parts is None else [parts]), *keys).select(*keys, F.explode(F.array(coming, leaving)).alias("_p")).select(*keys, "_p.*")
    # A day on which one pane comes and another leaves is one row again.
    points = both.groupBy(*keys, "day").agg(*(F.max(n).alias(n) for n in names), F.max("_n").alias("_n")).withColumn("_at", F.unix_date("day"))
    over = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-(days - 1), 0)
    told = {n: F.coalesce(COMBINE[k](n).over(over), F.lit(0)) if k == "count" else COMBINE[k](n).over(over) for n, k in measures.items()}
    return points.select(*keys, "day", *(c.alias(n) for n, c in told.items()), F.sum("_n").over(over).alias("panes"))


def window_as_of(panes: DataFrame, keys: Sequence[str], measures: Mapping[str, str], asof: Column, days: int = 30) -> DataFrame:
    """(keys, measures): the one window that ends with the day ``asof``, for the keys with rows in it."""
    near = panes.where((F.col("day") > F.date_sub(asof, days)) & (F.col("day") <= asof))
    return near.groupBy(*keys).agg(*(COMBINE[k](n).alias(n) for n, k in measures.items()))
