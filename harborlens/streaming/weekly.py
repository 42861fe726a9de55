"""The batch rules on streams: weekly windows with late rows, and first-seen rows across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlens.operators.shared import checkpointed


def weekly_counts(events: DataFrame, ts: str, late: str = "5 days", *keys: str) -> DataFrame:
    """Rows per Saturday week and key; rows later than ``late`` are left out of weeks that are closed.

    Windows count from a Thursday, so a start two days on makes them Saturday weeks.
    """
    w = F.window(ts, "7 days", "7 days", "2 days")
    return events.withWatermark(ts, late).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("week_of"), *keys, "n")


def first_seen(events: DataFrame, key: str, ts: str, within: str = "30 days") -> DataFrame:
    """Each key once, as long as its repeats come within the watermark."""
    return events.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what has come since the last run, writes it as Parquet and stops: the incremental stage."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path)
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def replaced_weeks(stream: DataFrame, ts: str, path: str, checkpoint: str, *keys: str) -> None:
    """Rows per Saturday week and key, brought up to date with what has come since the last run: a week that got rows is told anew, others stay as they are.

    The counts so far are the stream's state; each batch hands on the weeks that it changed, and their folders are replaced, so a batch that is run again changes nothing.
    """
    w = F.window(ts, "7 days", "7 days", "2 days")
    counts = stream.groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("week_of"), *keys, "n")

    def each(rows: DataFrame, batch: int) -> None:
        weeks = rows.groupBy("week_of").count().select("week_of")
        session = rows.sparkSession
        if session._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(session._jsc.hadoopConfiguration()).exists(session._jvm.org.apache.hadoop.fs.Path(path)):
            old = session.read.schema(rows.schema).parquet(path).join(weeks, "week_of", "left_semi").join(rows.select("week_of", *keys), ["week_of", *keys], "left_anti")
            rows = checkpointed(rows.unionByName(old.select(rows.columns)))  # read before its folders are replaced
        rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("week_of").parquet(path)

    query = counts.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
