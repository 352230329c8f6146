"""Interest profiles of many readers at once, in long form: (reader, kind, key, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..session import stage
from .ranking import top_per_key
from .topics import labels_of


@dataclass
class Profile:
    weights: DataFrame   # reader, kind (label / word / author / dislike), key, weight
    examples: DataFrame  # reader, key (label), title
    readers: DataFrame   # reader, engaged, cold


def engagement_rows(events: DataFrame) -> DataFrame:
    """Reader events -> one row per (reader, article) with the strongest signals kept side by side."""
    kind = F.col("kind")
    return events.filter(kind != "error").groupBy("reader", "doc_id").agg(
        F.max(kind == "purchase").alias("has_notes"),
        F.max(F.when(kind == "view", F.col("ts"))).alias("read_at"),
        F.max(kind == "click").alias("fetched"),
        F.max(F.when(kind == "signup", F.lit("hand"))).alias("saved_by"),
    )


def weighted(engagement: DataFrame, articles: DataFrame, as_of) -> DataFrame:
    """Engaged articles with their decayed weight; rows that are no evidence are dropped."""
    rows = engagement.join(
        articles.select("doc_id", "url", "title", "author", "topic", "subtopic", "tags", "added"), "doc_id")
    source = F.coalesce("saved_by", F.lit("auto"))
    raw = scoring.engagement_weight("has_notes", "read_at", "fetched", source)
    when = F.coalesce("read_at", F.col("added").cast("timestamp"))
    return (
        rows.withColumn("base", raw).filter(F.col("base") > 0)
        .withColumn("weight", scoring.decayed("base", when, as_of))
    )


def _apart(rows: DataFrame, columns: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows without ``columns``, and what these hold, each once; both by its hash ``a``."""
    gaps = F.concat(*[F.isnull(c).cast("string") for c in columns])
    rows = rows.withColumn("a", F.xxhash64(*columns, gaps))
    return stage(rows.drop(*columns), name), stage(rows.select("a", *columns).distinct(), f"{name}_articles")


def _meet(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Join by article, in as many tasks as there are shuffle partitions: few bytes become many rows here."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "a").join(keys.repartition(parts, "a"), "a")


def profile(engaged: DataFrame, dismissed: DataFrame, tree: DataFrame) -> Profile:
    """Sums of weighted labels, title words and authors per reader.

    ``engaged`` is the output of ``weighted``; ``dismissed``: reader, url, title, tags. A reader with fewer than
    eight engaged articles also gets the topic tree as stated interest. Words and labels are made once for each article;
    its readers meet them in tasks dealt by article, and equal (reader, kind, key) in a partial sum before the shuffle.
    """
    engaged, articles = _apart(engaged, ["title", "author", "topic", "subtopic", "tags"], "engaged")
    dismissed, refused = _apart(dismissed, ["title", "tags"], "dismissed")

    def keys(rows, kind, key, factor):
        return rows.select("a", F.lit(kind).alias("kind"), F.explode(key).alias("key")).withColumn("factor", factor)

    def words(rows, factor):
        stems = rows.select("a", F.lit("word").alias("kind"), F.explode(F.transform(text.content_words("title"), text.stem)).alias("key"))
        return stems.groupBy("a", "kind", "key").agg((F.count("*") * F.lit(factor)).alias("factor"))

    one = F.lit(1.0)
    labels = stage(keys(articles, "label", labels_of(), F.when(F.col("key").isin(fixed.GENERIC_LABELS), fixed.GENERIC_DAMP).otherwise(one)), "labels")
    liked = labels.unionByName(words(articles, 1.0)).unionByName(keys(articles.filter(F.col("author") != ""), "author", F.array("author"), one))
    against = F.array_distinct(F.transform(F.coalesce("tags", F.array().cast("array<string>")), text.label))
    disliked = keys(refused, "dislike", against, one).unionByName(words(refused, -fixed.ENGAGEMENT["saved"]))

    readers = (
        engaged.select("reader", F.lit(1).alias("n")).unionByName(dismissed.select("reader", F.lit(0).alias("n")))
        .groupBy("reader").agg(F.sum("n").alias("engaged"))
        .withColumn("cold", F.col("engaged") < fixed.COLD_START)
    )
    # the tree is one dimension row (its size is that of the tree, not of the data)
    stated = tree.select(F.explode(F.concat(F.transform("tags", text.label), F.array(F.concat_ws("/", "topic", "subtopic")))).alias("key"))
    stated = stated.groupBy("key").agg((F.count("*") * fixed.SEED_WEIGHT).alias("weight"))
    seeds = stated.agg(F.collect_list(F.struct("key", "weight")).alias("s")).scalar()
    cold = readers.filter("cold").select("reader", F.explode(seeds).alias("s")).select(
        "reader", F.lit("label").alias("kind"), "s.key", "s.weight")

    weight = (F.col("weight") * F.col("factor")).alias("weight")
    total = _meet(engaged, liked).select("reader", "kind", "key", weight).unionByName(
        _meet(dismissed.withColumn("weight", one), disliked).select("reader", "kind", "key", weight)).unionByName(cold)
    weights = (
        total.groupBy("reader", "kind", "key").agg(F.sum("weight").alias("weight"))
        .filter((F.col("kind") != "word") | (F.col("weight") > 1e-9))
    )
    # a label's best article is found by its number; its title, a whole line, is looked up once for each label
    titled = articles.select("a", F.xxhash64("title").alias("h"), "title")
    best = (
        _meet(engaged.join(titled.select("a", "h"), "a"), labels.select("a", "key"))
        .select("reader", "key", F.struct(F.round("weight", 9).alias("w"), (-F.col("doc_id")).alias("o"), "h").alias("b"))
        .groupBy("reader", "key").agg(F.max("b").alias("b"))
        .select("reader", "key", (-F.col("b.o")).alias("doc_id"), F.col("b.h").alias("h"))
    )
    titles = engaged.join(titled, "a").select("doc_id", "h", "title").dropDuplicates(["doc_id", "h"])
    examples = best.join(titles, ["doc_id", "h"]).select("reader", "key", "title")
    return Profile(weights, examples, readers)


def word_profile(weights: DataFrame, limit: int = fixed.PROFILE_WORDS) -> DataFrame:
    """Each reader's strongest title words, to nudge searches."""
    rows = weights.filter(F.col("kind") == "word").withColumn("w", F.round("weight", 6))
    return top_per_key(rows, ["reader"], [F.desc("w"), F.asc("key")], limit).select("reader", "key", "weight")


def top_labels(weights: DataFrame) -> DataFrame:
    """Of the forty strongest labels: no generic ones, no subtopics, first twelve."""
    rows = weights.filter(F.col("kind") == "label").withColumn("w", F.round("weight", 6))
    forty = top_per_key(rows, ["reader"], [F.desc("w"), F.asc("key")], 40, "r40")
    fine = forty.filter(~F.col("key").contains("/") & ~F.col("key").isin(fixed.GENERIC_LABELS))
    return top_per_key(fine, ["reader"], [F.asc("r40")], 12).select("reader", "rank", "key")


def seed_subtopics(readers: DataFrame, weights: DataFrame, tree: DataFrame, limit: int = fixed.SEEDS) -> DataFrame:
    """Each reader's strongest subtopics, filled up in tree order: (reader, topic, subtopic, ord, rank)."""
    subs = tree.select("topic", "subtopic", "ord", F.concat_ws("/", "topic", "subtopic").alias("key"))
    liked = weights.filter(F.col("kind") == "label").join(subs, "key").select(
        "reader", "topic", "subtopic", "ord", F.round("weight", 6).alias("w"))
    best = top_per_key(liked, ["reader"], [F.desc("w"), F.asc("ord")], limit).drop("rank")
    # a reader can lack at most `limit` subtopics, and at most `limit` of the first ones are taken already
    first = tree.select("ord", "topic", "subtopic").orderBy("ord").limit(2 * limit)
    fill = first.agg(F.collect_list(F.struct("topic", "subtopic", "ord")).alias("s")).scalar()
    more = readers.select("reader", F.explode(fill).alias("s")).select(
        "reader", "s.topic", "s.subtopic", "s.ord", F.lit(0.0).alias("w"))
    both = best.unionByName(more).groupBy("reader", "topic", "subtopic", "ord").agg(F.max("w").alias("w"))
    return top_per_key(both, ["reader"], [F.desc("w"), F.asc("ord")], limit)


def apply_dismissals(actions: DataFrame) -> DataFrame:
    """Dismiss/undo log (reader, url, undo, ts, seq) -> what is dismissed now."""
    last = actions.groupBy("reader", "url").agg(F.max_by(F.struct("undo", "ts"), F.struct("ts", "seq")).alias("a"))
    return last.filter(~F.col("a.undo")).select("reader", "url", F.col("a.ts").alias("ts"))
