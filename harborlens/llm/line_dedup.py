"""Lines that many documents share are kept in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import WHITE, ascii_lower, checkpointed, dealt, order_key


def _lines(c: Column) -> Column:
    return F.split(c, "\n", -1)


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, positions: int = 500_000
) -> DataFrame:
    """One row per input row: id, n_lines, n_dropped, text (the lines that stay, in their order).

    A line's key is the line without white space at its ends, A-Z in lower case. A key
    of ``min_chars`` code points or more that ``min_docs`` documents hold is dropped
    from all but the one with the smallest id; repeats within that one stay.

    Lines are exploded with their positions and hashed to 128 bits; only hashes, ids and
    positions travel by key. Holders are counted with a map-side combine, so a line that
    a third of all documents hold is a few rows to its reducer; for the join back, the lines
    of such a key are dealt into parts (see ``dealt``). Texts move once, to meet their dropped positions, of which a
    partition has about ``positions`` at most, however many there are in all.

    Null or empty texts are one empty line. Rows that share an id are one document. A
    null id counts as one document that comes after all others; ids other than whole numbers
    are compared as strings. An empty table gives no
    rows; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    rows = rows.withColumns({"_doc": order_key(rows, "_id")[0], "_own": F.xxhash64("_text")})
    # Trimmed lines of too few bytes can't have enough code points: they are left out before the dearer steps.
    lines = (
        rows.select("_doc", "_own", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
        .where(F.octet_length("_line") >= min_chars)
        .select("_doc", "_own", "_pos", F.btrim(F.col("_line"), F.lit(WHITE)).alias("_line"))
        .where(F.length("_line") >= min_chars)
        .select("_doc", "_own", "_pos", ascii_lower(F.col("_line")).alias("_key"))
        .select("_doc", "_own", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(1), F.col("_key")).alias("_h2"))
    )
    times = F.count(F.lit(1)).alias("_n")
    if min_docs == 2:  # two documents: the smallest and the largest id differ
        held = lines.groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.max("_doc").alias("_last"), times).where("_first < _last").drop("_last")
    else:
        held = (
            lines.groupBy("_h1", "_h2", "_doc").agg(times)
            .groupBy("_h1", "_h2").agg(F.min("_doc").alias("_first"), F.count(F.lit(1)).alias("_docs"), F.sum("_n").alias("_n"))
            .where(F.col("_docs") >= min_docs).drop("_docs")
        )
    held = checkpointed(held)
    repeats = held.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    parts, held = dealt(lines, held, ["_h1", "_h2"], "_n", repeats, ["_doc", "_pos", "_own"])
    # The slim side is held, so that texts needn't be sorted: partitions are as many as its positions ask for.
    many = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-repeats // positions))
    gone = parts.join(held, ["_h1", "_h2", "_part"]).where("_doc <> _first").select("_doc", "_own", "_pos")
    dropped = gone.repartition(many, "_doc", "_own").groupBy("_doc", "_own").agg(F.collect_set("_pos").alias("_drop"))
    met = rows.repartition(many, "_doc", "_own").join(dropped.hint("shuffle_hash"), ["_doc", "_own"], "left")
    split = _lines(F.col("_text"))
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("_drop")), lambda i: F.get(split, i))
    return met.select(
        F.col("_id").alias(id_col),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(stay, "\n")).alias("text"),
    )
