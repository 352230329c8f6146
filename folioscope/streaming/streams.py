"""Structured Streaming forms of the continuous parts: post ingest, ingest counts, news windows, engagement.

Every sink is a folder with one sub-folder per micro-batch. A batch that is run again after a failure overwrites its
own sub-folder, so results are exactly-once; readers take the newest row of each key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery



def batch_folder(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def keep_batches(path: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return write


def read_batches(spark, path: str, schema) -> DataFrame:
    """All kept batches with their number in ``batch``."""
    full = T.StructType([f for f in schema.fields if f.name != "batch"] + [T.StructField("batch", T.LongType())])
    return spark.read.schema(full).parquet(path)


def latest_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """Newest batch's row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "batch")


def start(df: DataFrame, mode: str, sink, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")
    return writer.start()


# ---------------------------------------------------------------- posts


def post_stream(landed: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Continuous post ingest: a URL is taken once, for good.

    Event time is the landing time (``landed``): days arrive newest first, so a watermark on the day would drop the
    whole back-fill. Repeats within three days are dropped inside the stream; older ones by an anti join with the
    posts kept by earlier batches.
    """
    rows = landed.withWatermark("landed", "3 days").dropDuplicatesWithinWatermark(["url"])
    schema = rows.schema

    def sink(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        earlier = None
        if batch_id > 0:
            earlier = read_batches(spark, path, schema).filter(F.col("batch") < batch_id).select("url")
        new = df.dropDuplicates(["url"])
        if earlier is not None:
            new = new.join(earlier, "url", "left_anti").select(*df.columns)
        new.write.mode("overwrite").parquet(batch_folder(path, batch_id))

    return start(rows, "append", sink, checkpoint, once=once)


def post_counts_stream(landed: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Posts per day so far, rewritten for the days a batch touches (days arrive in any order)."""
    counts = landed.groupBy("day").agg(F.count("*").alias("posts"))
    return start(counts, "update", keep_batches(path), checkpoint, once=once)


# ---------------------------------------------------------------- news


def rolling_news_windows(items: DataFrame, *, days: int = 7, slide: int = 1, late: str = "2 days") -> DataFrame:
    """Items per edition and sliding window over the publication time; works on a stream and on a table alike.

    Windows include their start and exclude their end; the batch operator ``briefing.window_items`` keeps the
    reference's closed bounds.
    """
    if items.isStreaming:
        items = items.withWatermark("published", late)
    w = F.window("published", f"{days} days", f"{slide} day")
    return items.groupBy("edition", w.alias("w")).agg(F.count("*").alias("n")).select(
        "edition", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def news_stream(items: DataFrame, path: str, checkpoint: str, *, once: bool = True, **options) -> StreamingQuery:
    return start(rolling_news_windows(items, **options), "update", keep_batches(path), checkpoint, once=once)


# ---------------------------------------------------------------- taste


def engagement_stream(events: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Keeps each (reader, article)'s strongest signals up to date: saved, then read, then noted replaces the weight.

    State is one small row per reader and article, spread over both, so a busy reader is no hot key. Weights decay
    with time, so they are computed when the profile is read (``taste.weighted``), not stored.
    """
    from ..operators.taste import engagement_rows

    return start(engagement_rows(events), "update", keep_batches(path), checkpoint, once=once)


def engagement_now(spark, path: str, schema) -> DataFrame:
    return latest_by(read_batches(spark, path, schema), ["reader", "doc_id"])


