"""Library files: loading rows and notes, upserts, exports."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARTICLE_SCHEMA = (
    "id string, url string, title string, author string, snippet string, image string, published string, claps bigint, "
    "topic string, subtopic string, added string, pdf string, doc string, fetched string, source string, locked boolean, "
    "locked_checked string, notes_count bigint, read_at string, via string, _corrupt_record string"
)
NOTES_SCHEMA = (
    "notes string, summary string, highlights array<struct<id:string,start:bigint,end:bigint,quote:string,prefix:string,"
    "suffix:string,color:string,note:string>>"
)


def load_library(spark, path: str) -> DataFrame:
    """Article rows from JSON lines. Lines that are no article rows are dropped, not fatal."""
    rows = spark.read.schema(ARTICLE_SCHEMA).option("mode", "PERMISSIVE").json(path)
    return clean_library(rows.drop("_corrupt_record"))


def clean_library(rows: DataFrame) -> DataFrame:
    """Rows with id and url; rows with claps from before sources were recorded count as added automatically."""
    ok = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("url", F.lit("")) != "")
    source = F.when(F.col("source").isNull() & F.col("claps").isNotNull(), "auto").otherwise(F.col("source"))
    return rows.filter(ok).withColumn("source", source).drop("fetching")


def load_notes(spark, folder: str) -> DataFrame:
    """Notes files (one JSON object each, named by article) with defaults and the time of the last edit."""
    raw = spark.read.schema(NOTES_SCHEMA).option("multiLine", "true").json(folder).select(
        "*", F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("edited"))
    none = F.array().cast(raw.schema["highlights"].dataType)
    return raw.select(
        F.regexp_replace("name", r"\.json$", "").alias("article_id"), F.coalesce("notes", F.lit("")).alias("notes"),
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("highlights", none).alias("highlights"), "edited")


def latest_rows(current: DataFrame, incoming: DataFrame, key: str, seq: str) -> DataFrame:
    """Insert or replace by key; of several incoming rows with a key the one with the largest ``seq`` counts.

    Write the result to a new folder, or with a table format's own merge: a folder must not be read and replaced at once.
    """
    w = Window.partitionBy(key).orderBy(F.desc(seq))
    new = incoming.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    if seq not in current.columns:
        new = new.drop(seq)
    return current.join(new.select(key), key, "left_anti").unionByName(new)


def export_json(columns: list[str]) -> Column:
    """A library row as JSON; bulk rows leave out what is null or empty."""
    slim = F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) if c in _TEXT else F.col(c) for c in columns]))
    full = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.when(F.col("source") == "bulk", slim).otherwise(full)


_TEXT = {"id", "url", "title", "author", "snippet", "image", "topic", "subtopic", "pdf", "doc", "fetched", "source", "via"}


def library_export(articles: DataFrame, path: str, columns: list[str]) -> None:
    """One JSON line per article, written in parallel."""
    articles.select(export_json(columns).alias("value")).write.mode("overwrite").text(path)
