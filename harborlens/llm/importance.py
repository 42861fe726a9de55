"""Target-distribution importance resampling: documents are drawn by how much more often their runs of words occur in a target corpus."""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from harborlens.llm.common import ship_package, stored
from harborlens.operators.shared import numbered

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def run_hashes(text: bytes, n: int) -> tuple[int, array]:
    """The number of words, and the CRC-32 of each run of 1 to ``n`` words that are joined by one space.

    One scan of the words: a ring holds the running states of the last ``n`` starts. A word extends each by a
    space and itself, which ends one more run of each start, and opens a start of its own; the oldest then leaves the ring.
    """
    out, ring, words = array("I"), [], 0
    for m in WORD.finditer(text.lower()):  # bytes: A-Z only
        word = m[0]
        if len(ring) == n:
            del ring[0]
        spaced = b" " + word
        ring = [crc32(spaced, state) for state in ring]
        ring.append(crc32(word))
        out.extend(ring)
        words += 1
    return words, out


def _hashed(docs: DataFrame, text_col: str, n: int, buckets: int, carry: Sequence[str]) -> DataFrame:
    """(carry, n_words, buckets) of each row: the bucket of each feature in its order, as two or four bytes each."""
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                words, found = [], []
                for t in b.column(1):
                    k, hashes = run_hashes((t.as_py() or "").encode(), n)
                    words.append(k)
                    found.append((np.frombuffer(hashes, np.uint32) % buckets).astype(kind).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(found, pa.binary())], names=["_row", "n_words", "_buckets"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.struct(*carry).alias("_row"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, StructType([rows.schema["_row"], StructField("n_words", LongType()), StructField("_buckets", BinaryType())]))


def _totals(hashed: DataFrame, buckets: int) -> np.ndarray:
    """How many features fall into each bucket; a task sends a sum for each bucket, and the driver gets ``buckets`` of them."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), kind), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    found = hashed.select("_buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, a thousand times the log ratio of its smoothed shares in target and source, floored."""
    n = len(source)
    s_all, t_all = float(source.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def importance_weights(
    docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text", carry: Sequence[str] = ("doc_id",), n: int = 2, buckets: int = 10_000
) -> DataFrame:
    """(``carry`` columns, n_words, n_features, weight) of each row of ``docs``: weight is the floored mean gain of its features' buckets.

    Features are all runs of 1 to ``n`` words, repeats counted; a feature's bucket is its CRC-32 modulo ``buckets``. Each
    text is read once: its buckets are written to the shared folder, where both their sums over all
    rows and, after that, each row's mean are taken from. Only the ``buckets`` sums come to the driver.

    Null and empty texts have no features and weight 0. Null or repeated ids and repeated rows are rows like others; an empty
    target or table counts nothing. Columns that aren't carried are ignored, whatever their names.
    """
    hashed = stored(_hashed(docs, text_col, n, buckets, carry), "features")
    wanted = _hashed(target.select(F.col(target_col).alias("text"), F.lit(0).alias("nothing")), "text", n, buckets, ["nothing"])
    gain = gains(_totals(hashed, buckets), _totals(wanted, buckets))
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, weights = [], []
            for x in b.column(2):
                own = np.frombuffer(x.as_py(), kind)
                sizes.append(len(own))
                weights.append(int(gain[own].sum()) // len(own) if len(own) else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(weights, pa.int64())], names=["_row", "n_words", "n_features", "weight"])

    kinds = StructType([hashed.schema["_row"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    found = hashed.select("_row", "n_words", "_buckets").mapInArrow(run, kinds)
    return found.select(*(F.col("_row").getField(c).alias(c) for c in carry), "n_words", "n_features", "weight")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", carry: Sequence[str] = (),
    n: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """(id, ``carry`` columns, n_words, n_features, weight, score, rank) of each row: of the N rows with ``least_words`` or more, those with the
    ``percent`` * N // 100 highest scores are drawn and have a rank from 1; the others' rank is null.

    Score is the weight plus Gumbel noise in thousandths that hangs on ``seed`` and id alone, so that the highest scores are a draw without
    replacement by weight. Ties go to smaller ids (null last). Rows with all equal are numbered in any order. Ranks come from a sort in ranges, of which only the sizes meet in one place.

    Texts, tables and columns as in ``importance_weights``.
    """
    found = importance_weights(docs, target, text_col, target_col, [id_col, *(c for c in carry if c != id_col)], n, buckets)
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = stored(found.withColumn("score", F.col("weight") + noise), "scores")
    fit = F.col("n_words") >= least_words
    n_drawn = percent * scored.where(fit).count() // 100
    ranked = numbered(scored.where(fit).withColumns({"_down": -F.col("score"), "_none": F.col(id_col).isNull(), "_tie": F.monotonically_increasing_id()}), ["_down", "_none", id_col, "_tie"], "_place")
    ranked = ranked.drop("_down", "_none", "_tie").withColumn("rank", F.when(F.col("_place") < n_drawn, F.col("_place") + 1)).drop("_place")
    return ranked.unionByName(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
