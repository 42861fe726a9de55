"""Benchmark passages in training texts, by a suffix automaton over the words of all benchmark items."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlens.llm.common import checkpointed, own_hashes, shared_folder, ship_package, without

#: Bytes of a word: 0-9, a-z and all outside ASCII; A-Z become a-z, the rest white space.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences: a state for each set of equal end places in the items.

    After the build, ``full[s]`` lists the items met when ``window`` words or more match in
    state ``s``, and ``short[s]`` the (length, item) of short items that end in ``s``.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = [-1], [0]
        ends: list[set] = [set()]
        whole: list[list] = [[]]
        for item, sequence in items:
            last = 0
            for w in sequence:
                last = self._extend(last, w, ends, whole)
                ends[last].add(item)
            if 0 < len(sequence) < window:
                whole[last].append((len(sequence), item))
        order = sorted(range(1, len(self.len)), key=self.len.__getitem__)
        for s in reversed(order):  # items of a state are those of all states that end with it
            if self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.full: list[tuple] = [()] * len(self.len)
        self.short: list[tuple] = [()] * len(self.len)
        for s in order:
            up = self.link[s]
            self.short[s] = (*whole[s], *self.short[up])
            if self.len[s] >= window:  # the state of its last `window` words
                self.full[s] = tuple(ends[s]) if self.len[up] < window else self.full[up]

    def _extend(self, last: int, w: bytes, ends: list[set], whole: list[list]) -> int:
        nxt, link, length = self.next, self.link, self.len

        def new(n: int, up: int, out: dict) -> int:
            nxt.append(out), link.append(up), length.append(n), ends.append(set()), whole.append([])
            return len(length) - 1

        def split(p: int, q: int) -> int:
            clone = new(length[p] + 1, link[q], dict(nxt[q]))
            link[q] = clone
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = clone
                p = link[p]
            return clone

        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else split(last, q)
        cur, p = new(length[last] + 1, 0, {}), last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else split(p, q)
        return cur

    def spans(self, sequence: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans [start, end) of words inside matched windows, in order and apart, and the items met."""
        nxt, link, length, window = self.next, self.link, self.len, self.window
        full, short, root = self.full, self.short, self.next[0]
        found: list[list[int]] = []
        items: set = set()
        s = n = 0
        for i, w in enumerate(sequence):
            if not s and w not in root:
                continue
            while s and w not in nxt[s]:
                s = link[s]
                n = length[s]
            if (q := nxt[s].get(w)) is None:
                continue
            s, n = q, n + 1
            most = n if n >= window else 0
            if most:
                items.update(full[s])
            for size, item in short[s]:
                if size <= n:
                    items.add(item)
                    most = max(most, size)
            if most:
                a = i + 1 - most
                while found and found[-1][1] >= a:
                    a = min(a, found.pop()[0])
                found.append([a, i + 1])
        return [(a, b) for a, b in found], items


#: The automaton that a Python worker has built last, by the id of its broadcast.
_BUILT: dict[int, SuffixAutomaton] = {}


def _automaton(shared: Broadcast, number: int, window: int) -> SuffixAutomaton:
    """The automaton of a broadcast block, built once for each worker rather than for each task."""
    if number not in _BUILT:
        _BUILT.clear()
        _BUILT[number] = SuffixAutomaton([(item, words(t)) for item, t in shared.value], window)
    return _BUILT[number]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[Broadcast]:
    """The distinct items, as (item, text), in broadcast blocks of ``block_bytes`` of text at most (and one item's length).

    Items are sorted in ranges and cut by the running size of their texts; they are written by block, so that each block is read once. The driver
    holds one block at a time, and hands it on before the next is read; its disk keeps what it has handed on.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    sized = items.withColumns({"size": F.octet_length("text").cast("long"), "hash": F.xxhash64("item", "text")})
    ranged = sized.repartitionByRange("hash").sortWithinPartitions("hash", "item", "text").withColumn("at", F.monotonically_increasing_id())
    ranged = checkpointed(ranged.withColumn("range", F.shiftright("at", 33)))
    own = F.sum("size").over(Window.partitionBy("range").orderBy("at")) - F.col("size")
    sums = ranged.groupBy("range").agg(F.sum("size").alias("n"))
    starts = sums.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("start"))  # a row for each range
    cut = ranged.withColumn("own", own).join(F.broadcast(starts), "range").select("item", "text", F.floor((F.col("start") + F.col("own")) / block_bytes).alias("block"))
    path = shared_folder(spark, "benchmark")
    cut.write.partitionBy("block").parquet(path)
    there = spark.read.schema("item string, text string, block long").parquet(path)
    many = (ranged.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // block_bytes) + 1
    return [spark.sparkContext.broadcast([tuple(r) for r in there.where(F.col("block") == k).select("item", "text").toLocalIterator()]) for k in range(many)]


def _held(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have ``size`` bytes, as often as each block's automaton must be built."""
    some, bytes_ = [], 0
    for b in batches:
        some.append(b)
        bytes_ += b.nbytes
        if bytes_ >= size:
            yield from pa.Table.from_batches(some).combine_chunks().to_batches()
            some, bytes_ = [], 0
    if some:
        yield from pa.Table.from_batches(some).combine_chunks().to_batches()


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order and apart; those that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 13, block_bytes: int = 2 << 20, held_bytes: int = 32 << 20, carry: Sequence[Column] = (),
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, starts, ends (word spans [start, end)), items (sorted as strings), the ``carry`` columns.

    Words are A-Z in lower case, digits, a-z and all that is not ASCII. A window is
    ``window`` consecutive words of an item; a shorter item, unless it has no words, is
    one window. Training words stream through the automaton, which gives the longest
    item passage that ends at each word; words in any window's occurrence are hit.

    The items are broadcast, and each worker builds their automaton once. A benchmark of more than ``block_bytes`` of text is
    cut into blocks of about that size with an automaton each, and the documents still pass once: a task takes ``held_bytes`` of them at a time
    through one block after another. So what a worker holds at once has a bound, and so has what the driver holds.

    Null texts have no words; null item ids are no items; an empty benchmark hits nothing.
    Repeated rows are treated alike; other columns are ignored.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), *carry)
    kept = rows.columns[1:]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), "n_words long, starts array<int>, ends array<int>, items array<string>"])
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    numbers = [b._jbroadcast.id() for b in blocks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = list(range(len(blocks)))
        for b in batches if len(blocks) == 1 else _held(batches, held_bytes):
            n, spans, items = [0] * b.num_rows, [[] for _ in range(b.num_rows)], [set() for _ in range(b.num_rows)]
            for k in order:
                automaton = _automaton(blocks[k], numbers[k], window)
                for i, t in enumerate(b.column(0)):
                    ws = words(t.as_py())
                    found, met = automaton.spans(ws)
                    n[i] = len(ws)
                    spans[i] += found
                    items[i] |= met
            order.reverse()  # the next batch begins with the automaton that is there
            if len(blocks) > 1:
                spans = [_union(s) for s in spans]
            ints = pa.list_(pa.int32())
            made = [pa.array(n, pa.int64()), pa.array([[x for x, _ in s] for s in spans], ints), pa.array([[x for _, x in s] for s in spans], ints), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *made], names=[*kept, "n_words", "starts", "ends", "items"])

    met = rows.mapInArrow(run, schema)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return met.select(
        F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), "starts", "ends",
        F.array_sort("items").alias("items"), *kept[1:],
    )


def contaminated(n_hit, n_words, share: float = 0.05):
    """Whether hit words make up ``share`` of a document's words or more."""
    return (n_hit > 0) & (n_hit * F.lit(round(1 / share)) >= n_words)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents of whose words a twentieth or more stands in benchmark windows.

    Rows are told apart by id (null like others) and text, and rows alike in both go together; texts that are null or have no words stay.
    Columns keep their names; an empty table stays empty, and an empty benchmark takes nothing.
    """
    met = benchmark_spans(docs.select(id_col, text_col), benchmark, id_col, text_col, carry=own_hashes(F.col(text_col)))
    return without(docs, met.where(contaminated(F.col("n_hit"), F.col("n_words"))).withColumnRenamed(id_col, "_id"), id_col, text_col)
