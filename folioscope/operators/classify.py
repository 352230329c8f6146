"""Bulk classification of titles by phrase rules, catch-all, and a fair selection over subtopics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, urls
from ..session import stage
from .library import first_per_key
from .ranking import fair_share, full_rank
from .topics import ngrams, phrase_lengths

EXACT, RELATED, EXPANDED = 0, 1, 2
UNSORTED = ("general-reading", "unsorted")


def _tokens(c):
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def build_rules(tree: DataFrame, related: DataFrame | None = None, expanded: DataFrame | None = None) -> DataFrame:
    """Rule table: phrase, n (words), tier, rank, topic, subtopic.

    The tree's tags make the exact tier, except very short and broad ones. ``related`` and ``expanded``: topic,
    subtopic, phrases; pairs that are not in the tree are ignored. Longer phrases rank first; one rule per phrase
    and tier. All inputs are dimension tables.
    """
    own = tree.select("topic", "subtopic", F.explode("tags").alias("tag"))
    phrase = F.trim(F.lower(F.replace("tag", F.lit("-"), F.lit(" "))))
    own = own.withColumn("phrase", phrase).filter(
        (F.length("phrase") >= 3) & ~F.col("phrase").isin(fixed.BROAD_PHRASES))
    rules = own.select(F.lit(EXACT).alias("tier"), "topic", "subtopic", "phrase")
    valid = tree.select("topic", "subtopic").distinct()
    for tier, extra in ((RELATED, related), (EXPANDED, expanded)):
        if extra is not None:
            rows = extra.join(valid, ["topic", "subtopic"], "left_semi")
            rules = rules.unionByName(
                rows.select(F.lit(tier).alias("tier"), "topic", "subtopic", F.explode("phrases").alias("phrase")))
    words = _tokens(F.col("phrase"))
    rules = rules.select("tier", "topic", "subtopic", F.array_join(words, " ").alias("phrase"), F.size(words).alias("n"))
    rules = rules.filter(F.col("n") > 0).distinct()
    w = Window.partitionBy("tier").orderBy(F.desc("n"), F.desc(F.length("phrase")), "phrase", "topic", "subtopic")
    ranked = rules.withColumn("rank", F.row_number().over(w) - 1)
    return first_per_key(ranked, ["tier", "phrase"], [F.asc("rank")])


def match_titles(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """(post_id, tier, topic, subtopic) of titles with at least four words: best tier, then longest phrase, then rank.

    Titles become word runs and meet the rules by equality, where they are; only matches are grouped, by post.
    """
    rules = stage(rules, "rules")
    lengths = phrase_lengths(rules, F.split("phrase", " "))
    titled = posts.filter(F.size(F.split(F.trim("title"), r"\s+")) >= 4)
    grams = titled.select("post_id", F.explode(ngrams(_tokens(F.col("title")), lengths)).alias("phrase"))
    hits = grams.join(rules, "phrase")
    best = F.min(F.struct("tier", (-F.col("n")).alias("n"), "rank", "topic", "subtopic"))
    return hits.groupBy("post_id").agg(best.alias("m")).select("post_id", "m.tier", "m.topic", "m.subtopic")


def new_links(posts: DataFrame, articles: DataFrame) -> DataFrame:
    """Posts as importable links: canonical URL, title from it when none is given, known URLs and ids left out."""
    rows = posts.withColumn("url", urls.canonical("url")).filter(F.col("url").isNotNull()).withColumn("id", urls.article_id("url"))
    rows = first_per_key(rows, ["url"], [F.asc("post_id")])
    return rows.join(articles.select("url").distinct(), "url", "left_anti").join(articles.select("id").distinct(), "id", "left_anti")


def classified_links(posts: DataFrame, rules: DataFrame) -> DataFrame:
    """Every link with its subtopic; links without a match have null topic. ``level``: 2 exact, 1 related, 0 other."""
    m = match_titles(posts, rules)
    return posts.join(m, "post_id", "left").withColumn(
        "level", F.when(F.col("tier") == EXACT, 2).when(F.col("tier") == RELATED, 1).otherwise(0))


def catch_all_fill(classified: DataFrame, requested: int) -> DataFrame:
    """Matched links and, when they are fewer than requested, the best of the rest under the catch-all subtopic."""
    matched = classified.filter(F.col("topic").isNotNull())
    short = requested - matched.count()
    if short <= 0:
        return matched
    rest = classified.filter(F.col("topic").isNull()).withColumn("_all", F.lit(0))
    fill = full_rank(rest, ["_all"], ["-prio", "-day", "-post_id"], "_r").filter(F.col("_r") <= short).drop("_r", "_all")
    fill = fill.withColumn("topic", F.lit(UNSORTED[0])).withColumn("subtopic", F.lit(UNSORTED[1]))
    return matched.unionByName(fill)


def fair_share_select(links: DataFrame, count: int) -> DataFrame:
    """Exactly ``count`` links: an equal share for each subtopic, the rest by level, priority and date."""
    rows = links.withColumn("key", F.concat_ws("/", "topic", "subtopic"))
    return fair_share(rows, "key", ["-level", "-prio", "-day", "-url", "-title", "-id"], count)


def bulk_report(chosen: DataFrame) -> DataFrame:
    return chosen.agg(
        F.count("*").alias("links"), F.count_distinct("topic", "subtopic").alias("subtopics"),
        F.count_if(F.col("level") == 2).alias("exact"), F.count_if(F.col("level") == 1).alias("related"),
        F.count_if(F.col("level") == 0).alias("broader"),
        F.count_if((F.col("topic") == UNSORTED[0]) & (F.col("subtopic") == UNSORTED[1])).alias("unsorted"),
    )
