"""Small helpers that the corpus operators share."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.operators.shared import ship_package  # noqa: F401

#: Stands for a null id where ids are compared; it sorts after every real id.
NULL_ID = (1 << 63) - 1
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; ``lower`` alone is exact for ASCII texts only."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def ascii_folded(c: Column) -> Column:
    """Like ``ascii_lower`` for all that compares ASCII words: other letters may change case too.

    The two letters outside ASCII whose lower case is ASCII are replaced first.
    """
    return F.lower(F.replace(F.replace(c, F.lit("\u212a"), F.lit("é")), F.lit("\u0130"), F.lit("é")))


def use_checkpoint_dir(spark: SparkSession) -> None:
    """The folder in spark.checkpoint.dir; one of this machine's own only where Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(folder)


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder once, so that later jobs neither recompute it nor lose it."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    use_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def bit_table(keys: DataFrame, h: Column, bits: int) -> DataFrame:
    """A bit set over ``pmod(h, bits)``: rows (slot, word) of 64 bits, at most bits / 64 of them whatever the input."""
    at = F.pmod(h, F.lit(bits))
    return keys.select(at.alias("at")).groupBy((F.col("at") / 64).cast("long").alias("_slot")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("_word")
    )


def bit_is_set(h: Column, bits: int) -> Column:
    """Whether the bit of ``h`` is set in the joined ``_word``."""
    at = F.pmod(h, F.lit(bits))
    return F.coalesce(F.call_function("getbit", F.col("_word"), (at % 64).cast("int")) == 1, F.lit(False))


def bit_slot(h: Column, bits: int) -> Column:
    return (F.pmod(h, F.lit(bits)) / 64).cast("long")


def dealt(rows: DataFrame, counts: DataFrame, keys: list[str], n: str, total: int, by: list[str], least: int = 1_000, lists: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``keys``, ready to be joined on ``keys`` and ``_part``: no part of a hot key has many more than ``most`` rows.

    ``counts`` has a row for each key and says in ``n`` how many of the ``total`` rows have it. Keys of more than
    ``most`` rows (``least``, or a ``lists``-th of all if that is more) are dealt into parts
    by a hash of the columns ``by``, and their row in ``counts`` is repeated for each part.
    The list of these keys, which alone is broadcast, has fewer than ``lists`` rows whatever the input.
    """
    most = max(least, total // lists)
    parts = (F.floor(F.col(n) / most) + 1).cast("int")
    hot = counts.where(F.col(n) > most).select(*keys, parts.alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", part).drop("_parts")
    return rows, counts.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))


def own_hashes(text: Column) -> list[Column]:
    """128 bits that stand for a text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("_own1"), F.xxhash64(F.lit(1), text).alias("_own2")]


def without(docs: DataFrame, lost: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose id (null like others) and text hashes are in ``lost`` (_id, _own1, _own2)."""
    h1, h2 = own_hashes(docs[text_col])
    lost = lost.select("_id", "_own1", "_own2").distinct()
    return docs.join(lost, docs[id_col].eqNullSafe(lost["_id"]) & (h1 == lost["_own1"]) & (h2 == lost["_own2"]), "left_anti")


def order_key(docs: DataFrame, id_col: str) -> tuple[Column, Column]:
    """A column by which ids are compared, never null, and what stands for null, after all others: whole numbers as such, other ids as strings."""
    whole = docs.schema[id_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    last = F.lit(NULL_ID) if whole else F.lit("\U0010ffff")
    return F.coalesce(F.col(id_col).cast("long" if whole else "string"), last), last


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet to a new folder below the checkpoint folder and reads it back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
