"""Bibliographic works as typed paper records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators.library import first_per_key

_DATE = "struct<`date-parts`:array<array<int>>>"
WORK_SCHEMA = (
    "DOI string, title array<string>, author array<struct<given:string,family:string,name:string>>, abstract string, "
    "`container-title` array<string>, publisher string, type string, "
    f"issued {_DATE}, published {_DATE}, `published-print` {_DATE}, `published-online` {_DATE}, "
    "URL string, volume string, issue string, page string, subject array<string>, `references-count` bigint, `is-referenced-by-count` bigint"
)


def read_works(spark, path: str) -> DataFrame:
    """Landed works, one JSON object per line, with an explicit schema."""
    return spark.read.schema(WORK_SCHEMA).json(path)


def _date(column: str) -> Column:
    """yyyy[-mm[-dd]] of the first date-parts entry, null when empty."""
    parts = F.filter(F.slice(F.get(F.col(f"`{column}`.`date-parts`"), F.lit(0)), 1, 3), lambda x: x.isNotNull())
    padded = F.transform(parts, lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 2, "0")))
    return F.when(F.size(parts) > 0, F.array_join(padded, "-"))


def paper_records(works: DataFrame) -> DataFrame:
    """One record per work with a DOI: cleaned texts, people, first usable date of four."""
    def clean(c):
        return text.clean(c)

    published = F.coalesce(*[_date(c) for c in ("issued", "published", "published-print", "published-online")])
    people = F.filter(
        F.transform(F.col("author"), lambda p: clean(F.when(F.coalesce(p["name"], F.lit("")) != "", p["name"]).otherwise(
            F.concat_ws(" ", F.nullif(p["given"], F.lit("")), F.nullif(p["family"], F.lit("")))))),
        lambda n: n != "",
    )
    none = F.array().cast("array<string>")
    title = clean(F.coalesce(F.get("title", F.lit(0)), F.lit("")))
    doi = F.lower("DOI")
    return works.filter(F.coalesce("DOI", F.lit("")) != "").select(
        urls.paper_id("DOI").alias("id"), F.col("DOI").alias("doi"),
        F.coalesce(F.nullif(title, F.lit("")), F.lit("Untitled")).alias("title"), F.coalesce(people, none).alias("authors"),
        clean(text.strip_tags(F.coalesce("abstract", F.lit("")))).alias("abstract"),
        clean(F.coalesce(F.get("container-title", F.lit(0)), F.lit(""))).alias("venue"), clean(F.coalesce("publisher", F.lit(""))).alias("publisher"),
        F.replace(F.coalesce("type", F.lit("")), F.lit("-"), F.lit(" ")).alias("type"),
        F.substring(published, 1, 4).try_cast("int").alias("year"), published.alias("published"),
        F.coalesce(F.nullif("URL", F.lit("")), F.concat(F.lit("https://doi.org/"), doi)).alias("url"),
        "volume", "issue", "page", F.coalesce("subject", none).alias("subjects"),
        F.col("references-count").alias("references_count"), F.col("is-referenced-by-count").alias("cited_by"),
    )


def paper_search(works: DataFrame, *, rows: int | None = 50, place: str = "place") -> DataFrame:
    """Records of the first works of every query's answer (``query_id``, place), one per id; ``rows=None``: of all its works."""
    from ..operators.ranking import top_per_key

    first = works
    if rows is not None:
        first = top_per_key(works, ["query_id"], [F.asc(place)], max(1, int(rows)), "_r").drop("_r")
    keyed = first.select("query_id", place, F.lower("DOI").alias("_doi")).filter(F.coalesce("_doi", F.lit("")) != "")
    best = first_per_key(keyed, ["query_id", "_doi"], [F.asc(place)])
    return best.join(first_per_key(paper_records(first).withColumn("_doi", F.lower("doi")), ["_doi"], [F.asc("title")]), "_doi").drop("_doi")


def papers_order(papers: DataFrame) -> DataFrame:
    """Saved date, else publication date, newest first; undated last."""
    return papers.orderBy(F.desc(F.coalesce(F.col("saved_at").cast("string"), F.col("published").cast("string"), F.lit(""))), F.asc("id"))


def shelf_projection(papers: DataFrame) -> DataFrame:
    """The shelf without the bulky raw record."""
    return papers.drop("raw")
