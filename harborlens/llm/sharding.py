"""Shards of near equal size: best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import checkpointed, ship_package


class CapacityTree:
    """Bins ordered by (remaining capacity, number) in a treap, a search tree that random priorities keep balanced."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.draw = random.Random(7).random

    def _split(self, node: list | None, key: tuple) -> tuple[list | None, list | None]:
        """Nodes below the key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            a, b = self._split(node[3], key)
            node[3] = a
            return node, b
        a, b = self._split(node[2], key)
        node[2] = b
        return a, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, remaining: int, number: int) -> None:
        a, b = self._split(self.root, (remaining, number))
        self.root = self._merge(self._merge(a, [(remaining, number), self.draw(), None, None]), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the bin with the least remaining capacity of at least ``size``."""
        a, b = self._split(self.root, (size, -1))
        if b is None:
            self.root = a
            return None
        path, node = None, b
        while node[2] is not None:
            path, node = node, node[2]
        if path is None:
            b = node[3]
        else:
            path[2] = node[3]
        self.root = self._merge(a, b)
        return node[0]


class Packer:
    """Best fit: each size goes to the tightest bin that holds it, else to a new bin; one above the capacity has its own."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.tree, self.bins = capacity, CapacityTree(), 0

    def put(self, size: int) -> int:
        found = self.tree.take(size)
        if found is None:
            found = (max(self.capacity, size), self.bins)
            self.bins += 1
        remaining, number = found
        self.tree.add(remaining - size, number)
        return number


def pack(sizes: Sequence[int], capacity: int) -> list[int]:
    """The bin of each size, best fit decreasing."""
    packer, out = Packer(capacity), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        out[i] = packer.put(sizes[i])
    return out


def pack_into(sizes: Sequence[int], bins: int) -> list[int]:
    """Best fit decreasing at the least capacity found, by bisection, that needs no more than ``bins`` bins."""
    if not sizes:
        return []
    low, high = max(-(-sum(sizes) // bins), max(sizes)), max(sizes) + 2 * -(-sum(sizes) // bins)
    best = pack(sizes, high)  # a bin opens only when all others are fuller than the mean
    while low < high:
        middle = (low + high) // 2
        tried = pack(sizes, middle)
        if max(tried) < bins:
            best, high = tried, middle
        else:
            low = middle + 1
        if high - low <= sum(sizes) // bins // 10_000:
            break
    return best


def shard(
    docs: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    overhead: int = 8, pieces: int = 64, carry: Sequence[str] = (),
) -> DataFrame:
    """One row per input row: id, size, shard, slot (gapless from 0 in each shard), and the ``carry`` columns.

    Rows of equal texts are one group and stay together. A row's size is its UTF-8 bytes
    (null: none) plus ``overhead``. Either the number of ``shards`` is given, and the least
    capacity is sought that best-fit-decreasing packing needs for so many, or a fixed
    ``capacity``, of which the packing then opens as few as it can; a group above the capacity is a shard alone.

    With a number of shards, packing has two levels so that no task sees all groups. Groups below a piece's size
    (mean shard / ``pieces``) are dealt to tasks by hash and packed there, largest first,
    into pieces; what those tasks hold is their open pieces. Pieces and larger groups are at most some
    ``2 * shards * pieces`` plus one for each task, whatever the rows; they alone come to the driver and are packed
    into shards. Slots number the rows of each piece, one piece after the other; a large
    group's rows are cut by a hash of their ids, so that none is numbered as one partition.

    With a capacity the shards grow in number with the input. Groups are then dealt to tasks of some ``pieces`` shards' worth each and packed there
    into shards at once: a task leaves one shard less than half full at most, and nothing but the tasks' numbers of shards meets in one place.

    Repeated rows and null ids are placed like others. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"c{i}" for i in range(len(carry))]
    rows = checkpointed(
        docs.select(
            F.col(id_col).alias("id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
            F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), F.monotonically_increasing_id().alias("row"),
            *(F.col(c).alias(o) for c, o in zip(carry, own, strict=True)),
        )
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    total, n_rows = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    bound = shards or max(1, -(-total // capacity))
    if shards:
        piece = max(1, total // (bound * pieces))
        tasks = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), bound * pieces))
    else:
        piece, tasks = capacity, -(-bound // pieces)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        packer, at = Packer(piece), TaskContext.get().partitionId()
        for b in batches:
            yield b[["h1", "h2", "bytes", "n"]].assign(piece=[at * 2**32 + packer.put(int(x)) for x in b["bytes"]])

    small = groups.where(F.col("bytes") < piece) if shards else groups
    dealt = small.repartition(tasks, "h1").sortWithinPartitions(F.desc("bytes"), "h1", "h2")
    bundled = dealt.mapInPandas(bundle, "h1 long, h2 long, bytes long, n long, piece long")
    most = max(1, 2 * n_rows // (bound * pieces))  # rows numbered together, more or less
    if shards:
        # A large group is a piece of its own: of negative number, by its hash.
        large = groups.where(F.col("bytes") >= piece).select("h1", "h2", "bytes", "n", (-1 - F.pmod("h1", F.lit(2**62))).alias("piece"))
        placed = checkpointed(bundled.unionByName(large))
        parts = placed.groupBy("piece").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy(F.desc("bytes"), "piece").collect()
        chosen = pack_into([p["bytes"] for p in parts], shards)
        plan = F.broadcast(spark.createDataFrame([(p["piece"], s, max(1, -(-p["n"] // most))) for p, s in zip(parts, chosen, strict=True)], "piece long, shard int, cuts long"))
    else:
        placed = checkpointed(bundled)
        sums = placed.groupBy("piece").agg(F.sum("n").alias("n")).withColumn("task", F.shiftright("piece", 32))
        each = sums.groupBy("task").agg(F.count(F.lit(1)).alias("m"))  # a row for each task
        firsts = each.select("task", (F.sum("m").over(_window().orderBy("task")) - F.col("m")).alias("first"))
        number = F.col("first") + F.col("piece").bitwiseAND(F.lit(2**32 - 1))
        plan = sums.join(F.broadcast(firsts), "task").select("piece", number.cast("int").alias("shard"), F.greatest(F.lit(1), F.ceil(F.col("n") / most)).alias("cuts"))
    at = (
        rows.join(placed.select("h1", "h2", "piece"), ["h1", "h2"])
        .join(plan, "piece")
        .withColumn("cut", F.pmod(F.xxhash64("id", "row"), F.col("cuts")))
        .select("id", "size", "row", "shard", "piece", "cut", *own)
    )
    at = checkpointed(at)
    runs = at.groupBy("shard", "piece", "cut").count()  # a row for each piece or part of a large one
    before = F.sum("count").over(_window("shard").orderBy("piece", "cut").rowsBetween(-(2**63), -1))
    starts = runs.select("piece", "cut", F.coalesce(before, F.lit(0)).alias("start"))
    number = F.row_number().over(_window("piece", "cut").orderBy(F.col("id").asc_nulls_last(), "row")) - 1
    starts = F.broadcast(starts) if shards else starts  # some 3 * shards * pieces rows, whatever the input
    return at.withColumn("number", number).join(starts, ["piece", "cut"]).select(
        F.col("id").alias(id_col), "size", "shard", (F.col("start") + F.col("number")).alias("slot"),
        *(F.col(o).alias(c) for c, o in zip(carry, own, strict=True)),
    )


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
