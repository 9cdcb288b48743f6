"""Streams of page versions and of log events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from folioscope.operators import recent as R


def daily_counts(events: DataFrame, late_days: int = R.SHOWN) -> DataFrame:
    """Streaming counts (day, page_id, op, n) of events (ts, page_id, op).

    Buckets are three days counted back from the report date, so they move every day
    and no fixed window can hold them: days are the state, and ``bucketed`` folds
    them when a report is made. Events later than the shown window are dropped.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", f"{late_days} days")
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "page_id", "op").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), "page_id", "op", "n")


def bucketed(daily: DataFrame, anchor) -> DataFrame:
    """(bucket, page_id, w, d) from daily counts at a report date."""
    age = R.age_days(F.col("day"), F.lit(anchor))
    rows = daily.withColumn("bucket", R.bucket_of(age)).where("bucket is not null and bucket != 'floating'").withColumn("depth", R.depth_of(age))
    return rows.groupBy("bucket", "page_id").agg(F.sum("n").alias("w"), F.max("depth").alias("d"))


def index_stream(pages: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Feeds each batch's newest version of a page to ``merge(batch, epoch)``.

    ``merge`` publishes a version of the store named after the epoch, so a batch that
    is repeated after a failure publishes the same content again, which changes nothing.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("page_id").agg(F.max_by("body", "mtime").alias("body"), F.max("mtime").alias("mtime"))
        merge(newest, epoch)

    return pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def first_visits(pages: DataFrame) -> DataFrame:
    """Each page id of a stream once: the visited set as keyed state."""
    return pages.select("page_id").dropDuplicates(["page_id"])
