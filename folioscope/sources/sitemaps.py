"""Landed sitemap files: which days are due, and their posts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..operators.library import first_per_key

MIN_TITLE_WORDS, RECHECK_DAYS = 2, 3


def read_landed(spark, path: str) -> DataFrame:
    """Whole files as (file, text)."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def sitemap_listing(raw: DataFrame, text: str = "text") -> DataFrame:
    """(day, url, lastmod) of every day file named in a sitemap index."""
    entry = r"(?s)(<loc>\s*[^<]*/posts-\d{4}-\d{2}-\d{2}\.xml\s*</loc>\s*<lastmod>[^<]*</lastmod>)"
    e = raw.select(F.explode(F.regexp_extract_all(text, F.lit(entry), F.lit(1))).alias("e"))
    return e.select(
        F.regexp_extract("e", r"posts-(\d{4}-\d{2}-\d{2})\.xml", 1).try_cast("date").alias("day"),
        F.trim(F.regexp_extract("e", r"<loc>([^<]*)</loc>", 1)).alias("url"),
        F.regexp_extract("e", r"<lastmod>([^<]*)</lastmod>", 1).alias("lastmod"),
    )


def sitemap_pending(listing: DataFrame, ledger: DataFrame, today, *, days: int = 365) -> DataFrame:
    """Listed days inside the window that were never ingested, or are recent and changed since; newest first."""
    now = F.lit(today).cast("date")
    done = ledger.select("day", F.col("lastmod").alias("_seen"), F.lit(True).alias("_done"))
    due = F.col("_done").isNull() | (
        (F.col("day") >= F.date_sub(now, RECHECK_DAYS)) & ~F.col("_seen").eqNullSafe(F.col("lastmod")))
    inside = (F.col("day") >= F.date_sub(now, days)) & (F.col("day") <= now)
    return listing.filter(inside).join(done, "day", "left").filter(due).select("day", "url", "lastmod").orderBy(F.desc("day"))


def parse_sitemap(raw: DataFrame, text: str = "text") -> DataFrame:
    """(day, url, title, author, prio) per <url> block; one-word titles are dropped, a bad priority counts 0.2."""
    blocks = raw.select("day", F.explode(F.regexp_extract_all(text, F.lit(r"(?s)<url>(.*?)</url>"), F.lit(1))).alias("b"))
    rows = blocks.select(
        "day", F.trim(F.regexp_extract("b", r"<loc>([^<]+)</loc>", 1)).alias("url"),
        F.coalesce(F.regexp_extract("b", r"<priority>([\d.]+)</priority>", 1).try_cast("double"), F.lit(fixed.DEFAULT_PRIO)).alias("prio"),
    ).filter(F.col("url") != "")
    titled = rows.select("day", "url", urls.slug_title("url").alias("title"), urls.author_of("url").alias("author"), "prio")
    return titled.filter(F.size(F.filter(F.split("title", r"\s+"), lambda w: w != "")) >= MIN_TITLE_WORDS)


def sitemap_ingest(raw: DataFrame, posts: DataFrame, text: str = "text") -> DataFrame:
    """New posts of landed day files: known URLs are ignored, and of several days with one URL the newest counts."""
    rows = first_per_key(parse_sitemap(raw, text), ["url"], [F.desc("day"), F.asc("prio")])
    return rows.join(posts.select("url").distinct(), "url", "left_anti")


def ledger_rows(raw: DataFrame, text: str = "text") -> DataFrame:
    """Ledger of an ingest: posts kept per day, before known URLs are ignored."""
    kept = parse_sitemap(raw, text).groupBy("day").agg(F.count("*").alias("posts"))
    days = raw.groupBy("day").agg(F.max("lastmod").alias("lastmod"))
    return days.join(kept, "day", "left").select("day", "lastmod", F.coalesce("posts", F.lit(0)).alias("posts"))


def append_posts(new_posts: DataFrame, path: str) -> None:
    """Append to the posts table, partitioned by day so that date filters skip files."""
    new_posts.repartition("day").write.mode("append").partitionBy("day").parquet(path)
