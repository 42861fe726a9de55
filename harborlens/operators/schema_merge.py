"""Merges of entities through a whole schema: which row survives, where its children go, and which of them clash."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.operators.cluster import label_components
from harborlens.operators.shared import shuffled


def survivors(merges: DataFrame) -> DataFrame:
    """(id, keep_id) of each id that goes, after merges (drop_id, keep_id) of which one may lead to another: a to b and b to c send a to c.

    An id that is dropped more than once goes where the smallest of its keep_ids leads. Merges that lead in a circle keep the
    smallest of all ids that they join. Merges of an id with itself or with null are none.
    """
    m = merges.where("drop_id <> keep_id").groupBy("drop_id").agg(F.min("keep_id").alias("keep_id"))
    ids = m.select(F.col("drop_id").alias("id")).unionByName(m.select(F.col("keep_id").alias("id"))).distinct()
    parts = label_components(ids, m.select(F.col("drop_id").alias("left_id"), F.col("keep_id").alias("right_id")), "id")
    # Each id goes one way at most, so a component has one id that goes nowhere, or else a circle.
    parts = parts.join(shuffled(m.select(F.col("drop_id").alias("_goes"))), F.col("id") == F.col("_goes"), "left")
    ends = parts.groupBy("cluster_id").agg(F.coalesce(F.min(F.when(F.col("_goes").isNull(), F.col("id"))), F.col("cluster_id")).alias("keep_id"))
    return parts.join(shuffled(ends), "cluster_id").where("id <> keep_id").select("id", "keep_id")


def repointed(child: DataFrame, column: str, gone: DataFrame, unique: Sequence[str] = ()) -> DataFrame:
    """``child`` with the ids in ``column`` replaced by those that survive (``gone``: id, keep_id).

    With a unique key, of rows that come to have the same key one stays: one that needn't move, else the one whose old id and then whose
    values are smallest. As in a unique index, keys with a null never clash.
    """
    moved = child.join(shuffled(gone.select(F.col("id").alias("_gone"), F.col("keep_id").alias("_keep"))), F.col(column) == F.col("_gone"), "left")
    moved = moved.withColumn(column, F.coalesce("_keep", column))
    if not unique:
        return moved.select(child.columns)
    whole = F.lit(True)
    for c in unique:
        whole = whole & F.col(c).isNotNull()
    rest = [c for c in child.columns if c not in unique]
    first = F.min(F.struct(F.col("_keep").isNotNull().alias("_moved"), "_gone", *rest)).alias("_row")
    kept = moved.where(whole).groupBy(*unique).agg(first).select(*unique, *(F.col("_row").getField(c).alias(c) for c in rest))
    return kept.select(child.columns).unionByName(moved.where(~whole).select(child.columns))


def merged_entities(rows: DataFrame, id_col: str, gone: DataFrame, fill: Sequence[str], name: str, aliases: str) -> DataFrame:
    """The rows that survive, their empty ``fill`` columns filled from those that go (the smallest id that has one), and their ``aliases`` (an array) joined by the names
    and aliases of these, in order, without their own name. A merge into an id that has no row is none."""
    own = rows.select(F.col(id_col).alias("_own"))
    gone = gone.join(shuffled(own), F.col("keep_id") == F.col("_own"), "left_semi")
    all_of = rows.join(shuffled(gone.select(F.col("id").alias("_gone"), F.col("keep_id").alias("_keep"))), F.col(id_col) == F.col("_gone"), "left")
    goes, root = F.col("_keep").isNotNull(), F.coalesce("_keep", id_col)
    given = lambda c: F.when(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""), F.struct(goes.alias("g"), F.col(id_col).alias("i"), F.col(c).alias("v")))
    names = F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>")))
    kept = [c for c in rows.columns if c not in (*fill, aliases, id_col)]
    found = all_of.groupBy(root.alias("_root")).agg(
        F.min_by(F.struct(*kept, id_col), F.struct(goes, F.col(id_col))).alias("_k"), *(F.min(given(c))["v"].alias(c) for c in fill), F.array_sort(F.array_distinct(F.flatten(F.collect_set(names)))).alias("_names"),
    )
    told = F.filter("_names", lambda a: a.isNotNull() & (a != "") & ~a.eqNullSafe(F.col(f"_k.{name}")))
    out = {c: F.col(f"_k.{c}") for c in (*kept, id_col)} | {c: F.col(c) for c in fill} | {aliases: told}
    return found.select(*(out[c].alias(c) for c in rows.columns))


def merge_schema(tables: Mapping[str, DataFrame], references: Sequence[tuple[str, str, Sequence[str]]], merges: DataFrame) -> dict[str, DataFrame]:
    """All ``tables`` after ``merges``: ``references`` lists what points at the merged entities, as (table, column, unique key or none).

    A table may be listed for several columns. A table that isn't listed stays as it is.
    """
    gone, out = survivors(merges), dict(tables)
    for table, column, unique in references:
        out[table] = repointed(out[table], column, gone, unique)
    return out
