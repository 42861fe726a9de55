"""Near duplicates by SimHash: fingerprints within a few bits of each other are linked."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import checkpointed, dealt, own_hashes, ship_package, without
from harborlens.llm.components import connected_components

BITS = 64


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash of the XXH64 of word shingles, repeats included, as an unsigned integer.

    Bytes are lower-cased (A-Z only) and split at ASCII white space (space, \\x09-\\x0D);
    a text of fewer words is one shingle, a text without words has fingerprint zero.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -shingle])).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(BITS, np.int64), len(starts)
    for i in range(0, n, 65536):  # bits of so many shingles at once
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 65536], ends[i : i + 65536], strict=True)], np.uint64)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, carry: Sequence[Column] = ()) -> DataFrame:
    """(id, fp, and the ``carry`` columns): a row per input row, the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carry)
    names = ["id", "fp", *rows.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=names)

    ship_package(docs.sparkSession)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema]
    return rows.mapInArrow(run, ", ".join([kinds[0], "fp long", *kinds[2:]]))


def _near(a: np.ndarray, b: np.ndarray | np.int64, most: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= most  # of signed numbers, numpy counts the bits of the absolute value


def spanning_edges(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of distinct fingerprints that are linked within ``most`` bits: fewer than there are nodes."""
    edges, rest = [], fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            hit = _near(rest, x, most)
            if hit.any():
                found, rest = rest[hit], rest[~hit]
                edges += [(int(x), int(y)) for y in found]
                front += list(found)
    return edges


_EDGE = "u long, v long, key long, block int"


def _bucket_edges(most: int, block: int):
    """Edges within each key of batches sorted by (key, fp). A key of more than ``block`` rows leaves its rows with block numbers, too."""

    def out(edges: np.ndarray) -> pa.RecordBatch:
        edges = np.unique(edges.reshape(-1, 2), axis=0)
        nothing = pa.nulls(len(edges), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(edges[:, 0]), pa.array(edges[:, 1]), nothing, nothing.cast(pa.int32())], names=["u", "v", "key", "block"]
        )

    def large(key: int, number: int, fps: np.ndarray) -> pa.RecordBatch:
        n = len(fps)
        return pa.RecordBatch.from_arrays(
            [pa.array(fps), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, number, np.int32))], names=["u", "v", "key", "block"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
        left = 0  # blocks that the first key has left already
        for b in _with_end(batches):
            if b is not None:
                keys = np.concatenate((keys, b.column(0).to_numpy()))
                fps = np.concatenate((fps, b.column(1).to_numpy()))
            # Before the end, the last key may go on.
            whole = len(keys) if b is None or not len(keys) else int(np.searchsorted(keys, keys[-1]))
            found = [np.empty((0, 2), np.int64)]
            if whole:
                starts = np.flatnonzero(np.concatenate(([True], keys[1:whole] != keys[: whole - 1])))
                lengths = np.diff(np.concatenate((starts, [whole])))
                pairs = starts[lengths == 2]
                near = pairs[_near(fps[pairs], fps[pairs + 1], most)]
                found.append(np.stack((fps[near], fps[near + 1]), axis=1))
                longer = (lengths > 2) | ((starts == 0) & (left > 0))
                for s, n in zip(starts[longer].tolist(), lengths[longer].tolist(), strict=True):
                    number = left if s == 0 else 0
                    split = number > 0 or n > block
                    for i in range(s, s + n, block):
                        part = fps[i : min(i + block, s + n)]
                        found.append(np.array(spanning_edges(part, most), np.int64).reshape(-1, 2))
                        if split:
                            yield large(int(keys[s]), number, part)
                            number += 1
                keys, fps, left = keys[whole:], fps[whole:], 0
            while len(keys) >= 2 * block:  # one key that goes on: its first block
                found.append(np.array(spanning_edges(fps[:block], most), np.int64).reshape(-1, 2))
                yield large(int(keys[0]), left, fps[:block])
                keys, fps, left = keys[block:], fps[block:], left + 1
            if sum(map(len, found)):
                yield out(np.concatenate(found))

    return run


def _with_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_links(fps: DataFrame, most: int = 4, block: int = 8192) -> DataFrame:
    """(u, v): enough pairs of distinct fingerprints (column fp) within ``most`` bits to connect all that such pairs connect.

    The 64 bits are cut into ``most // 2 + 1`` segments, so that of two linked fingerprints
    one segment differs by at most one bit. Each fingerprint is indexed under its 64
    one-wildcard variants: a segment without one of its bits. Equal variants meet in one
    partition, and each pair is verified there over all bits. A variant of many
    fingerprints yields a spanning forest, not its pairs. Rows of a variant stream through
    in blocks of ``block``; where there are several blocks, each two of them are
    then compared in a task of their own, so no task ever holds more than two blocks.
    """
    cuts = np.linspace(0, BITS, most // 2 + 2).round().astype(int)
    masks = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        whole = ((1 << int(b - a)) - 1) << int(a)
        masks += [(int(a), (whole & ~(1 << i)) - (1 << 64) * ((whole & ~(1 << i)) >> 63)) for i in range(int(a), int(b))]
    width = int(np.diff(cuts).max())
    variants = F.array(*(F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(m)), a) + F.lit(i << width) for i, (a, m) in enumerate(masks)))
    indexed = fps.select("fp").distinct().select(F.explode(variants).alias("key"), "fp")
    parts = fps.sparkSession.conf.get("spark.sql.shuffle.partitions")
    met = checkpointed(
        indexed.repartition(int(parts), "key").sortWithinPartitions("key", "fp").mapInArrow(_bucket_edges(most, block), _EDGE)
    )
    links = met.where("v is not null").select("u", "v")
    large = met.where("v is null").select("key", "block", F.col("u").alias("fp"))
    if not large.isEmpty():
        blocks = large.groupBy("key").agg((F.max("block") + 1).alias("n"))
        pairs = large.join(blocks, "key").select(
            "key", "fp", "block", F.explode(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: j != F.col("block"))).alias("other")
        )

        def compare(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(spanning_edges(pdf["fp"].to_numpy(), most), columns=["u", "v"], dtype="int64")

        links = links.unionByName(
            pairs.groupBy("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")).applyInPandas(compare, "u long, v long")
        )
    return links


def _components(fps: DataFrame, most: int) -> DataFrame:
    """``fps`` (id, fp and more) with the smallest id that each row's fingerprint reaches, as component."""
    total = fps.count()
    nodes = fps.groupBy("fp").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    roots = connected_components(near_links(nodes, most))
    labelled = checkpointed(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("first").alias("component"), F.count(F.lit(1)).alias("m"))
    members, smallest = dealt(labelled, smallest, ["root"], "m", total, ["fp"])
    by_fp = members.join(smallest, ["root", "_part"]).select("fp", "n", "component")
    # Rows of a hot fingerprint are dealt by number, as their ids may all be null.
    parts, by_fp = dealt(fps.withColumn("_row", F.monotonically_increasing_id()), by_fp, ["fp"], "n", total, ["_row"])
    return parts.join(by_fp, ["fp", "_part"]).drop("_part", "n", "_row")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links, its own included).

    Fingerprints link at ``most`` or fewer differing bits (see ``near_links``); equal ones
    are one node, so exact copies cost nothing. Rows of one fingerprint, and fingerprints of one
    component, are dealt into parts where there are many (see ``dealt``). Null texts and texts without words have
    fingerprint zero and link like others. Null ids are never the smallest unless alone.
    Other columns are ignored; an empty table gives no rows.
    """
    return _components(checkpointed(simhash(docs, id_col, text_col, shingle)), most).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """``docs`` without the rows that a row of a smaller id in their component stands for.

    Rows are told apart by id and text (null texts are empty ones, and are near copies of each other): a row that shares
    its id with a dropped one but has another text stays unless it is itself dropped; rows alike in both, and rows that share the smallest id, stay
    or go together; a component of null ids only stays whole. Columns keep their names; an empty table stays empty.
    """
    fps = checkpointed(simhash(docs, id_col, text_col, shingle, own_hashes(F.col(text_col))))
    return without(docs, _components(fps, most).where("not (id <=> component)").withColumnRenamed("id", "_id"), id_col, text_col)
