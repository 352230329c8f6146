"""Binds the driver's tables to the content model (posts, articles, engagement, queries, news items).

Each function reads whole tables. The SQL twin of every binding is in ``sqlparts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text, urls

AS_OF = "2024-01-31 00:00:00"


def as_of_day():
    return F.lit(AS_OF).cast("date")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def title_of(c):
    """The first line that is not blank, whole."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"^\s*([^\n]*)", 1), r"\s+", " "))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows out of documents and labels. ``locked`` is unknown (null) for unlabelled documents."""
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    i = F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), i.cast("string"))
    rows = (
        d.join(lab, "doc_id", "left")
        .withColumn("url", url)
        .withColumn("title", title_of(F.col("text")))
        .withColumn("id", urls.article_id("url"))
    )
    return rows.select(
        "doc_id", "id", "url", "title",
        F.col("source").alias("author"),
        F.col("text").alias("snippet"),
        F.col("lang").alias("topic"),
        F.col("source").alias("subtopic"),
        F.col("n_chars").alias("claps"),
        (F.col("quality") == 1).alias("locked"),
        F.date_sub(as_of_day(), (i % 200).cast("int")).alias("published"),
        F.date_sub(as_of_day(), ((i * 7) % 90).cast("int")).alias("added"),
        F.when(i % 3 == 0, "auto").when(i % 3 == 1, "bulk").alias("source"),
        F.when(i % 4 == 0, F.concat(F.lit("pdf/"), F.col("id"), F.lit(".pdf"))).alias("pdf"),
        (i % 5 == 0).alias("fetched"),
        F.coalesce(F.col("toxic"), F.lit(0)).cast("bigint").alias("notes_count"),
        F.col("lang"),
        (i % 17 == 0).alias("response"),
        F.filter(F.array_distinct(text.words("title")), lambda w: F.length(w) >= 4).alias("tags"),
        (F.lit(0.1) + (i % 10) / 10).alias("prio"),
        F.when(i % 6 != 0, F.date_sub(as_of_day(), (i % 15).cast("int"))).alias("locked_checked"),
    )


def page_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed posts out of pages: title from the page head, author from the host."""
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    return p.select(
        i.alias("post_id"), "url",
        text.clean(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.regexp_extract("url", r"^https?://([^./]*)", 1).alias("author"),
        F.date_add(F.lit("2024-01-01").cast("date"), (i % 30).cast("int")).alias("day"),
        (F.lit(0.1) + (i % 10) / 10).alias("prio"),
    )


def document_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search corpus: every document with its whole text as the searchable field."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("post_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), i.cast("string")).alias("url"),
        F.col("text").alias("title"),
        F.col("source").alias("author"),
        F.date_sub(as_of_day(), (i % 200).cast("int")).alias("day"),
        (F.lit(0.1) + (i % 10) / 10).alias("prio"),
    )


def engagement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader events on documents: view=read, purchase=noted, click=downloaded, signup=saved, error=dismissed."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("reader"),
        F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("bigint").alias("doc_id"),
        F.col("event_type").alias("kind"),
        "ts",
    ).filter(F.col("doc_id").isNotNull())


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured queries out of the benchmark passages: all words of each; every fifth passage is a phrase, too."""
    b = table(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    no_list = F.array().cast("array<array<string>>")
    b = b.withColumn("w", text.words("text"))
    return b.select(
        i.alias("query_id"),
        F.filter(F.array_distinct("w"), lambda x: ~x.isin(fixed.STOPWORDS)).alias("terms"),
        F.filter(F.array_distinct("w"), lambda x: x.isin(fixed.STOPWORDS)).alias("soft"),
        F.when((i % 5 == 0) & (F.size("w") > 1), F.array("w")).otherwise(no_list).alias("phrases"),
        F.when(i % 7 == 0, F.slice("w", -1, 1)).otherwise(F.array().cast("array<string>")).alias("exclude"),
        F.when(i % 11 == 0, F.concat(F.lit("src"), (i % 20).cast("string"))).alias("author"),
        F.when(i % 6 == 0, F.date_sub(as_of_day(), 150)).alias("since"),
        F.when(i % 6 == 1, F.date_sub(as_of_day(), 10)).alias("before"),
    )


def news_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated headlines: one edition per language, category from the text length, publisher from the source."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        F.col("lang").alias("edition"),
        i.alias("item_id"),
        title_of(F.col("text")).alias("title"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), (i % 900).cast("string")).alias("url"),
        F.col("source").alias("publisher"),
        F.concat(F.lit("g"), (F.col("n_chars") % 5).cast("string")).alias("category"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=(i % 200).cast("int"))).alias("published"),
        F.array(F.col("source")).alias("topics"),
        F.concat_ws(" ", F.regexp_extract("text", r"^\s*\S+\s+(\S+)", 1), F.col("source")).alias("query"),
        (i % 60).alias("position"),
    )


def topic_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtopics derived from the documents: (language, source), tagged with its five most frequent title words."""
    from pyspark.sql import Window

    a = articles(spark, sf_dir)
    tags = a.select("topic", "subtopic", F.explode("tags").alias("tag"))
    n = tags.groupBy("topic", "subtopic", "tag").count()
    top = n.withColumn(
        "r", F.row_number().over(Window.partitionBy("topic", "subtopic").orderBy(F.desc("count"), "tag"))
    ).filter("r <= 5")
    return (
        top.groupBy("topic", "subtopic")
        .agg(F.sort_array(F.collect_list("tag")).alias("tags"))
        .select(
            "topic", "subtopic", F.concat_ws(" ", "topic", "subtopic").alias("name"), "tags",
            F.concat_ws("/", "topic", "subtopic").alias("ord"), F.lit(False).alias("custom"),
        )
    )


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader notes on the labelled documents: all lines of the text as highlights, latest line first."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    i = F.col("doc_id")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), i.cast("string"))
    lines = F.split("text", "\n")
    return d.select(
        urls.article_id(url).alias("article_id"), "doc_id",
        F.when(i % 3 == 0, title_of(F.col("text"))).otherwise(F.lit("  ")).alias("notes"),
        F.when((F.col("quality") == 1) & (i % 2 == 0), title_of(F.col("text"))).alias("summary"),
        F.when(
            i % 4 != 1,
            F.transform(
                lines,
                lambda x, k: F.struct(
                    (F.lit(30) - k * 10).cast("bigint").alias("start"), x.alias("quote"),
                    F.when(k == 1, F.lit(" Check this ")).alias("note"),
                ),
            ),
        ).alias("highlights"),
        (F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(hours=i.cast("int"))).alias("edited"),
    )


def library_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved-library searches out of the benchmark: all ASCII words, some with all runs of words as phrases, some with an excluded word."""
    ascii_words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+(?: [a-z0-9]+)+"), F.lit(0))
    i = F.col("item_id")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").withColumn("w", ascii_words).select(
        i.alias("query_id"),
        F.col("w").alias("plain"),
        F.when(i % 4 == 0, runs).otherwise(none).alias("phrases"),
        F.when(i % 3 == 0, F.slice("w", -1, 1)).otherwise(none).alias("minus"),
    )
