"""Writes that can be run again: rows routed to several outputs in one pass, batches appended once, keys seen once for all time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def routed_write(rows: DataFrame, route: Column, path: str, fmt: str = "parquet") -> None:
    """Writes ``rows`` below ``path``, a folder ``_route=<name>`` for each route, in one pass. Rows without a route go to ``_route=none``.

    Run again it replaces the folders of the routes that it meets and leaves others alone, so the same input leaves the same files' rows.
    """
    named = rows.withColumn("_route", F.coalesce(route, F.lit("none")))
    named.write.format(fmt).option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_route").save(path)


def read_route(spark: SparkSession, path: str, route: str, fmt: str = "parquet") -> DataFrame:
    """The rows of one route; the other routes' files aren't opened."""
    return spark.read.format(fmt).load(path).where(F.col("_route") == route).drop("_route")


def _done(spark: SparkSession, folder: str) -> bool:
    """Whether a folder has the mark that Spark leaves when a write is complete."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append_batch(rows: DataFrame, path: str, batch: int, header: bool = True) -> bool:
    """Appends a batch as CSV in a folder of its own below ``path``, unless that batch is there already; says whether it wrote.

    A batch that broke off has no mark of success and is written anew, so an interrupted run keeps the batches that it finished, and no row comes twice.
    Column names head each file, once; to be used with ``foreachBatch`` as it is.
    """
    folder = f"{path}/batch={batch}"
    if _done(rows.sparkSession, folder):
        return False
    rows.write.mode("overwrite").option("header", header).option("escape", '"').option("emptyValue", "").csv(folder)
    return True


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches, with their number in ``batch``."""
    return spark.read.schema(f"{schema}, batch int").option("header", True).option("escape", '"').option("multiLine", True).csv(path)


_SEEN = "_bucket int, _key1 long, _key2 long, _batch long"


def append_unseen(rows: DataFrame, keys: Sequence[str], order: Sequence[str], path: str, batch: int, buckets: int = 64, bits: int = 1 << 23) -> DataFrame:
    """The rows of a batch whose keys no earlier batch had, for all time, and of equal keys the first by ``order``; their keys are added to the table at ``path``.

    The table holds 128-bit hashes of the keys, partitioned by batch and by bucket of the hash. What a batch adds replaces what the
    same batch added before, and earlier batches alone are asked; so a batch that is run again after a failure, or sent a second
    time under its number, gives the same rows and changes nothing. Batch numbers must rise.

    The batch is first put into a bit set of ``bits`` (at most ``bits`` / 64 rows, which are broadcast), by which the table is thinned where it is read:
    only keys that may be in the batch are shuffled for the exact join. Null keys are keys like others.
    """
    spark = rows.sparkSession
    first = rows.groupBy(*(F.col(k) for k in keys)).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row")
    named = F.struct(*(F.col(f"_row.{k}") for k in keys))
    h1, h2 = F.xxhash64(named, F.to_json(named)), F.xxhash64(F.lit(1), F.to_json(named))
    hashed = first.select("_row", h1.alias("_key1"), h2.alias("_key2")).withColumn("_bucket", F.pmod("_key1", F.lit(buckets)).cast("int"))
    found = hashed
    if _exists(spark, path):
        at = F.pmod(F.col("_key1"), F.lit(bits))
        words = hashed.select(at.alias("_at")).groupBy(F.shiftright("_at", 6).alias("_slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at % 64 as int))")).alias("_word"))
        seen = spark.read.schema(_SEEN).parquet(path).where(F.col("_batch") < batch).select("_key1", "_key2").withColumn("_at", at)
        maybe = seen.join(F.broadcast(words), F.shiftright("_at", 6) == F.col("_slot")).where(F.call_function("getbit", "_word", (F.col("_at") % 64).cast("int")) == 1)
        found = hashed.join(maybe.select("_key1", "_key2"), ["_key1", "_key2"], "left_anti")
    added = found.select("_key1", "_key2", F.lit(batch).cast("long").alias("_batch"), "_bucket")
    added.repartition("_bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_batch", "_bucket").parquet(path)
    new = spark.read.schema(_SEEN).parquet(path).where(F.col("_batch") == batch).select("_key1", "_key2")
    return hashed.join(new, ["_key1", "_key2"], "left_semi").select("_row.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
