"""State over runs: rows seen for the first time ever, daily panes for sliding windows, and batches appended once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.operators.outputs import append_batch, append_unseen
from harborlens.operators.windows import made


def _run(stream: DataFrame, checkpoint: str, each) -> None:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def first_ever(stream: DataFrame, keys: Sequence[str], order: Sequence[str], seen: str, out: str, checkpoint: str) -> None:
    """Takes what has come since the last run and writes to ``out`` the rows whose keys were never seen before, however long ago.

    The keys are kept in the table ``seen`` (see ``append_unseen``) and not in the stream's own state, so no watermark forgets them and no state
    grows with all time in the executors. A batch that is run again after a failure replaces what it wrote, in both tables.
    """

    def each(rows: DataFrame, batch: int) -> None:
        new = append_unseen(rows, keys, order, seen, batch)
        new.withColumn("_batch", F.lit(batch).cast("long")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("_batch").parquet(out)

    _run(stream, checkpoint, each)


def append_batches(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends what has come since the last run as CSV, a folder for each batch, each written once."""

    def each(rows: DataFrame, batch: int) -> None:
        append_batch(rows, path, batch)

    _run(stream, checkpoint, each)


def daily_pane_stream(events: DataFrame, keys: Sequence[str], ts: str, late: str, measures: Mapping[str, tuple[str, str]]) -> DataFrame:
    """The panes of ``daily_panes`` over a stream: a day's pane is told once, when no more of its rows are waited for. ``slides`` over the panes told so far gives the windows."""
    told = events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("_w"), *keys).agg(*made(measures))
    return told.select(*keys, F.to_date("_w.start").alias("day"), *measures)
