"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import bit_is_set, bit_slot, bit_table, checkpointed, dealt, own_hashes, without


def _may_repeat(rows: DataFrame, keys: Sequence[str], bits: int) -> DataFrame:
    """Adds ``_may``: false where the keys are certainly met once in ``rows``.

    The repeated keys become a bit set of fixed size, which alone is broadcast.
    A clash of bits only lets a row through to the next, sharper level.
    """
    h = F.xxhash64(*keys)
    repeated = rows.groupBy(*keys).count().where("count > 1")
    return (
        rows.withColumn("_slot", bit_slot(h, bits))
        .join(F.broadcast(bit_table(repeated, h, bits)), "_slot", "left")
        .withColumn("_may", bit_is_set(h, bits))
        .drop("_slot", "_word")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "max",
    carry: Sequence[str] = (),
    prefix_chars: int = 64,
    filter_bits: int = 1 << 21,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, and the ``carry`` columns.

    Texts are grouped by byte length; of lengths met again, a hash of the first
    ``prefix_chars`` characters is taken; of prefixes met again, the SHA-256 of the
    whole text. Only slim rows (id, length, hash) are shuffled, never texts. Counts
    are combined before each shuffle, and a large group's rows are dealt into parts for
    the last join (see ``dealt``). ``filter_bits`` bounds what is broadcast (a bit each).

    Null texts count as empty ones. ``keep`` (max or min) says which id of a group
    stays; null ids never stay before others, and a group of null ids only keeps all.
    Rows equal in both id and text are reported alike. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).alias("_len"),
        *(F.col(c).alias(o) for c, o in zip(carry, own, strict=True)),
    )
    by_length = _may_repeat(rows, ["_len"], filter_bits).withColumn(
        "_prefix", F.when(F.col("_may"), F.xxhash64(F.substring("_text", 1, prefix_chars)))
    )
    # Rows of lengths met once have no prefix hash; their id stands in, so that they fall apart by themselves.
    by_prefix = _may_repeat(
        by_length.withColumn("_prefix", F.coalesce("_prefix", F.xxhash64(F.lit("id"), F.col("_id")))), ["_len", "_prefix"], filter_bits
    )
    hashed = checkpointed(
        by_prefix.select("_id", "_len", F.when(F.col("_may"), F.unhex(F.sha2("_text", 256))).alias("_hash"), *own)
    )
    groups = (
        hashed.where("_hash is not null").groupBy("_len", "_hash")
        .agg(F.count(F.lit(1)).alias("_n"), (F.max if keep == "max" else F.min)("_id").alias("_keep"))
        .where("_n > 1").withColumnRenamed("_hash", "_key")
    )
    # Rows without a hash have no copy; their ids spread them over the partitions.
    key = F.coalesce("_hash", F.unhex(F.sha2(F.col("_id").cast("string"), 224)))
    numbered = hashed.withColumns({"_key": key, "_row": F.monotonically_increasing_id()})  # rows of a hot text are dealt by number: their ids may all be null
    parts, groups = dealt(numbered, groups, ["_len", "_key"], "_n", hashed.count(), ["_row"])
    found = parts.join(groups, ["_len", "_key", "_part"], "left")
    keep_id = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return found.select(
        F.col("_id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"), *(F.col(o).alias(c) for c, o in zip(carry, own, strict=True)),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another row with a larger id has.

    Rows are told apart by id and text (null texts are empty ones): a row that shares its id with a dropped one but has
    another text stays; rows alike in both stay or go together. A row of null id goes where its
    text has a row with an id. Columns keep their names; an empty table stays empty.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *own_hashes(F.col(text_col)))
    return without(docs, exact_dedup(slim, "_id", "_text", carry=["_own1", "_own2"]).where("not kept"), id_col, text_col)
