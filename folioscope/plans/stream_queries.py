"""Streaming queries: the given tables are read as streams to their end, and the kept result is returned."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import taste
from ..session import checkpoint_dir
from ..streaming import streams
from . import bindings as b
from . import sqlparts as q
from .registry import query
from .taste_queries import ENG


def places(spark, name):
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"{root}/rows", f"{root}/progress"


def stream(spark, d, table):
    schema = b.table(spark, d, table).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{table}*.parquet")


def landed_posts(spark, d):
    p = stream(spark, d, "pages")
    return p.select(
        "url", "page_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 30).cast("int")).alias("day"),
        F.col("_metadata.file_modification_time").alias("landed"))


@query("post_stream", """SELECT url, min(page_id) AS page_id FROM pages GROUP BY url""")
def _(spark, d):
    rows, progress = places(spark, "posts")
    landed = landed_posts(spark, d)
    streams.post_stream(landed, rows, progress).awaitTermination()
    return streams.read_batches(spark, rows, landed.schema).select("url", "page_id")


@query("post_counts_stream", q.with_(q.PAGE_POSTS) + "SELECT day, count(*) AS posts FROM posts GROUP BY day")
def _(spark, d):
    rows, progress = places(spark, "counts")
    streams.post_counts_stream(landed_posts(spark, d), rows, progress).awaitTermination()
    return streams.latest_by(streams.read_batches(spark, rows, spark.createDataFrame([], "day date, posts bigint").schema), ["day"])


@query("news_window_stream", q.with_(q.NEWS) + """
SELECT edition, s AS start, s + INTERVAL 7 DAY AS "end", count(*) AS n FROM (
  SELECT edition, published, CAST(CAST(published AS DATE) - CAST(unnest(range(0, 7)) AS INTEGER) AS TIMESTAMP) AS s FROM news) GROUP BY ALL""")
def _(spark, d):
    rows, progress = places(spark, "news")
    docs = stream(spark, d, "documents")
    items = docs.select(
        F.col("lang").alias("edition"),
        (F.lit(b.AS_OF).cast("timestamp") - F.make_dt_interval(hours=(F.col("doc_id") % 200).cast("int"))).alias("published"))
    streams.news_stream(items, rows, progress).awaitTermination()
    schema = spark.createDataFrame([], "edition string, start timestamp, end timestamp, n bigint").schema
    return streams.latest_by(streams.read_batches(spark, rows, schema), ["edition", "start", "end"])


@query("taste_stream", ENG + "SELECT reader, doc_id, CAST(base AS DOUBLE) AS base, round(weight, 4) AS weight FROM wt")
def _(spark, d):
    rows, progress = places(spark, "engagement")
    e = stream(spark, d, "events").select(
        F.col("user_id").alias("reader"), F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("bigint").alias("doc_id"),
        F.col("event_type").alias("kind"), "ts").filter(F.col("doc_id").isNotNull())
    streams.engagement_stream(e, rows, progress).awaitTermination()
    schema = taste.engagement_rows(b.engagement(spark, d)).schema
    now = streams.engagement_now(spark, rows, schema)
    return taste.weighted(now, b.articles(spark, d), b.AS_OF).select("reader", "doc_id", "base", F.round("weight", 4).alias("weight"))
