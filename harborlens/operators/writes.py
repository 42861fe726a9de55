"""Writes as derived tables: state from a log of actions, merges, guarded patches, problems of rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_of_log(log: DataFrame, key: str, action: Column, order: Sequence[str]) -> DataFrame:
    """(key, action, since fields): the last action of each key that is not null; ``order`` must end in a unique column."""
    last = F.max(F.when(action.isNotNull(), F.struct(*order, action.alias("_action"))))
    found = log.groupBy(key).agg(last.alias("_l")).where("_l is not null")
    return found.select(key, F.col("_l._action").alias("action"), *(F.col(f"_l.{c}").alias(c) for c in order))


def digest_states(log: DataFrame, key: str, action: Column, order: Sequence[str]) -> DataFrame:
    """(key, state) after a log of approve, unapprove and send: draft, approved, or sent, which is final.

    A send counts only while the digest is approved; other actions are ignored.
    """
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = log.select(key, *order, action.alias("_a"))
    told = told.withColumn("_was", F.coalesce(F.last(F.when(F.col("_a").isin("approve", "unapprove"), F.col("_a")), ignorenulls=True).over(w), F.lit("unapprove")))
    sent = F.bool_or((F.col("_a") == "send") & (F.col("_was") == "approve"))
    last = F.max(F.struct(*order, "_was"))["_was"]
    g = told.groupBy(key).agg(F.coalesce(sent, F.lit(False)).alias("_sent"), last.alias("_last"))
    return g.select(key, F.when(F.col("_sent"), "sent").when(F.col("_last") == "approve", "approved").otherwise("draft").alias("state"))


def merge_fill(rows: DataFrame, group: str, id_col: str, fill: Sequence[str], name: str) -> DataFrame:
    """One row per group: keep_id (smallest), merged (rows that went), filled columns (of the smallest id that has one), aliases.

    Aliases are the other rows' distinct names but the kept one's, in order.
    """
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(id_col, c)))[c].alias(c)
    g = rows.groupBy(group).agg(
        F.min(id_col).alias("keep_id"), (F.count(F.lit(1)) - 1).alias("merged"), *(first(c) for c in fill),
        F.min(F.struct(id_col, name))[name].alias("_own"), F.array_sort(F.collect_set(name)).alias("_names"),
    )
    return g.select(group, "keep_id", "merged", *fill, F.array_remove("_names", F.col("_own")).alias("aliases"))


def guarded_patch(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str], valid: Column) -> DataFrame:
    """``old`` with the columns of valid ``new`` rows (one per key): blank or null never overwrites, and no row is added."""
    patch = new.where(valid).select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    met = old.join(patch, F.col(key) == F.col("_key"), "left")
    told = lambda c: F.coalesce(F.when(F.trim(F.col(f"_{c}").cast("string")) != "", F.col(f"_{c}")), F.col(c)).alias(c)
    return met.select(*(told(c) if c in columns else F.col(c) for c in old.columns), F.col("_key").isNotNull().alias("patched"))


def problems(rows: DataFrame, key: str, tests: Mapping[str, Column]) -> DataFrame:
    """(key, problem): a row for each test that holds; nothing is loaded or dropped."""
    named = F.array(*(F.when(test, F.lit(name)) for name, test in tests.items()))
    return rows.select(key, F.explode(F.array_compact(named)).alias("problem"))
