"""The topic tree as a table, its phrases, and where a post belongs in it.

``tree``: topic, subtopic, name, tags array<string>, ord (tree order, sortable). ``overrides``: topic, subtopic,
phrases. ``broad``: topic, tag. All three are inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..session import stage


def subtopic_phrases(tree: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Tree rows with their search phrases: the override list, else the tags as words, else the name."""
    own = F.transform("tags", lambda t: F.replace(t, F.lit("-"), F.lit(" ")))
    named = F.array(F.lower("name"))
    if overrides is None:
        given = F.lit(None).cast("array<string>")
    else:
        tree = tree.join(
            overrides.select("topic", "subtopic", F.col("phrases").alias("_given")), ["topic", "subtopic"], "left")
        given = F.col("_given")
    phrases = F.coalesce(F.when(F.size(given) > 0, given), F.when(F.size("tags") > 0, own), named)
    out = tree.withColumn("phrases", phrases)
    return out.drop("_given") if overrides is not None else out


def ngrams(tokens: Column, lengths: list[int]) -> Column:
    """Every run of consecutive tokens whose length is one of ``lengths``, joined by blanks.

    The tokens are made once and each run is put together from its own words, so the work grows with the number of runs.
    """
    none = F.array().cast("array<string>")

    def runs(words, n):
        last = F.size(words) - n
        each = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
        return F.when(last >= 0, each).otherwise(none)

    return F.get(F.transform(F.array(tokens), lambda words: F.array_distinct(F.concat(none, *[runs(words, n) for n in lengths]))), F.lit(0))


def phrase_lengths(phrases: DataFrame, words: Column) -> list[int]:
    """The word counts that occur among a dimension table's phrases: the only run lengths worth making."""
    return sorted(r[0] for r in phrases.select(F.size(words).alias("n")).distinct().collect() if r[0] and r[0] > 0)


def fitting_subtopics(posts: DataFrame, phrased_tree: DataFrame, broad: DataFrame) -> DataFrame:
    """Every subtopic a post fits: (url, topic, subtopic, ord).

    A post fits when it shares a tag with the subtopic's tags or phrase slugs, or when it carries a broad tag of the
    topic and its title holds one of the phrases as whole words. Both tests are equality joins, on tags and on the
    title's word runs; the phrase is checked against the title itself afterwards. The tree is written first: it is made
    once, and joins see that it is the small side, so that the tags of the posts stay where they are.
    """
    subs = stage(phrased_tree.select("topic", "subtopic", "ord", "tags", "phrases"), "subtopics")
    broad = stage(broad.select("topic", "tag"), "broad")
    keys = subs.select(
        "topic", "subtopic", "ord", F.explode(F.array_distinct(F.concat("tags", F.transform("phrases", text.slug)))).alias("tag")
    )
    by_tag = posts.select("url", F.explode(F.array_distinct("tags")).alias("tag")).join(keys, "tag")

    phrases = subs.select("topic", "subtopic", "ord", F.explode("phrases").alias("phrase"))
    phrase_words = F.regexp_extract_all("phrase", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    phrase_keys = phrases.withColumn("gram", F.array_join(phrase_words, " "))
    lengths = phrase_lengths(phrases, phrase_words)
    topical = posts.select("url", F.lower("title").alias("title"), F.explode("tags").alias("tag")).join(broad, "tag").select(
        "url", "title", "topic").distinct()
    tokens = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    by_title = (
        topical.withColumn("gram", F.explode(ngrams(tokens, lengths)))
        .join(phrase_keys, ["topic", "gram"])
        .filter(F.regexp_like("title", F.concat(
            F.lit(r"(?<![\p{L}\p{N}_])\Q"), "phrase", F.lit(r"\E(?![\p{L}\p{N}_])"))))
    )
    cols = ["url", "topic", "subtopic", "ord"]
    fits = by_tag.select(*cols).unionByName(by_title.select(*cols))
    return fits.distinct()


def assign_home(posts: DataFrame, phrased_tree: DataFrame, broad: DataFrame) -> DataFrame:
    """First subtopic in tree order that a post fits: (url, topic, subtopic)."""
    fits = fitting_subtopics(posts, phrased_tree, broad)
    home = fits.groupBy("url").agg(F.min(F.struct("ord", "topic", "subtopic")).alias("h"))
    return home.select("url", "h.topic", "h.subtopic")


def labels_of(tags="tags", topic="topic", subtopic="subtopic") -> Column:
    """Normalised tags plus "topic/subtopic" when both are known."""
    norm = F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")), text.label)
    home = F.when(
        (F.col(topic) != "") & (F.col(subtopic) != ""), F.array(F.concat_ws("/", topic, subtopic))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(norm, home))
