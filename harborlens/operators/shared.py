"""What several operators need: checkpoints in the shared folder, and numbers in an order without one window over all rows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _checkpoint_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine's own only where Spark runs in one process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, which all executors share."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """One side of a join whose both sides grow with the input: never sent through the driver, whatever its size is taken for.

    Spark takes rows for as many bytes as were shuffled before they were exploded, and so broadcasts sides of any size.
    """
    return df.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python workers import the operators' functions from it."""
    sc = spark.sparkContext
    if not getattr(sc, "_harborlens_shipped", False):
        root = Path(__file__).resolve().parents[1]
        if root.is_dir():  # not where the package itself was imported from such a file
            target = Path(tempfile.mkdtemp(prefix="package-")) / "harborlens.zip"
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(str(target))
        sc._harborlens_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the checkpoint folder."""
    return f"{_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parts_for(df: DataFrame, most: int) -> int:
    """Into how many partitions the rows of ``df`` go at about ``most`` each: one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))


def spread(df: DataFrame, keys: list[str], most: int = 50_000) -> DataFrame:
    """``df`` dealt by ``keys`` into partitions of about ``most`` rows, one for each core at least: a small file is read by one task, however much is then made of its rows."""
    return df.repartition(parts_for(df, most), *keys)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the checkpoint folder and read anew, for rounds: a checkpoint hands on what is known of its columns, of which planning has more with each round."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``name``: each row's number from 0 in an order. Rows are sorted in ranges, a task each; only the ranges' sizes are summed up in one place."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_start"))
    return ranged.join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start")


def dealt(left: DataFrame, rights: list[DataFrame], keys: list[str], by: list[str], most: int = 1_000, lists: int = 10_000) -> list[DataFrame]:
    """The sides of joins on ``keys``, ready to be joined on ``keys`` and ``_part``: the left rows of a key of more than ``most`` are dealt
    into parts of about so many by a hash of ``by``, and its rows in each of ``rights`` are repeated for each part.

    The hot keys alone are broadcast, the ``lists`` hottest of them if there are more; a key beyond these has less than a ``lists``-th of the rows.
    """
    n = F.count(F.lit(1))
    hot = left.groupBy(*keys).agg((F.floor(n / most) + 1).cast("int").alias("_parts")).where("_parts > 1").orderBy(F.desc("_parts"), *keys).limit(lists)
    part = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return [side.join(F.broadcast(hot), keys, "left").withColumn("_part", part if i == 0 else each).drop("_parts") for i, side in enumerate((left, *rights))]


def pairs_of(rows: DataFrame, hub: str, by: str, different: str, facts: DataFrame, most: int = 1_000) -> DataFrame:
    """Each two ``rows`` of a hub that differ in ``different``: the columns of the one, the hub's ``facts`` (one row per hub), and those of the other with ``_there``.

    A hub of many rows is dealt into parts (see ``dealt``). Facts are joined to the single rows on the parts by which the pairs are then
    made, so nothing of a hub meets in one task, and pairs, which grow with its square, aren't shuffled. All sides are dealt into the session's
    number of partitions: by the bytes of rows, Spark would put too many pairs into a task.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right, facts = (side.repartition(parts, hub, "_part") for side in dealt(rows, [rows, facts], [hub], [by], most))
    there = right.select(hub, "_part", *(F.col(c).alias(f"{c}_there") for c in rows.columns if c != hub))
    return left.join(shuffled(facts), [hub, "_part"]).join(shuffled(there), [hub, "_part"]).where(F.col(different) != F.col(f"{different}_there")).drop("_part")


def with_before(df: DataFrame, keys: list[str], order: list[str], carry: list[str]) -> DataFrame:
    """Adds ``_before``: ``carry`` of the row before, in an order, among the rows of the same ``keys``; null for the first.

    Rows are sorted in ranges, so that those of one key may lie in many; the last row of each range is handed on to the next.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("_range", F.shiftright("_at", 33)))
    last = ranged.groupBy("_range").agg(F.max_by(F.struct(F.struct(*keys).alias("k"), F.struct(*carry).alias("c")), "_at").alias("_last"))
    last = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))  # a row for each range
    own = F.lag(F.struct(*carry)).over(Window.partitionBy("_range", *keys).orderBy("_at"))
    told = ranged.withColumn("_own", own).join(F.broadcast(last), "_range")
    handed = F.when(F.col("_last.k") == F.struct(*keys), F.col("_last.c"))
    return told.withColumn("_before", F.coalesce("_own", handed)).drop("_own", "_last", "_range", "_at")
