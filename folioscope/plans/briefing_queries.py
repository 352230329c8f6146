"""Briefing editions over every document: one edition per language, near copies are retellings of a story."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import briefing
from ..session import stage
from . import bindings as b
from . import sqlparts as q
from .registry import query

END = "TIMESTAMP '2024-01-31 00:00:00'"
HW, QW = q.headline_words("title"), q.headline_words("query")
SCORED = q.with_(q.ARTICLES, q.TREE, q.NEWS, f"""
items AS (SELECT *, item_id AS arrival, 4 * exp(-((epoch_us({END}) - epoch_us(published)) / 3600e6) / 36)
   + 2 * len(list_intersect({HW}, {QW})) / greatest(1, len({QW})) + 1 / (1 + position / 5.0) AS score FROM news)""")


def items(spark, d):
    n = b.news_items(spark, d)
    end = F.lit(b.AS_OF).cast("timestamp")
    return n.withColumn("score", briefing.feed_score(F.col("title"), F.col("query"), F.col("published"), end, F.col("position"))) \
        .withColumn("arrival", F.col("item_id"))


@query("news_feed_items", SCORED + """SELECT edition, item_id, round(score, 4) AS score FROM items
WHERE published BETWEEN TIMESTAMP '2024-01-24 00:00:00' AND TIMESTAMP '2024-01-31 00:00:00' AND trim(title) <> ''""")
def _(spark, d):
    rows = briefing.window_items(items(spark, d), "2024-01-24 00:00:00", b.AS_OF)
    return rows.select("edition", "item_id", F.round("score", 4).alias("score"))


@query("rolling_news_window", SCORED + "".join(
    f"{' UNION ALL ' if n > 1 else ''}SELECT {n} AS days, edition, count(*) AS n FROM items WHERE published BETWEEN {END} - INTERVAL {n} DAY AND {END} AND trim(title) <> '' GROUP BY edition"
    for n in (1, 3, 7)))
def _(spark, d):
    out = None
    for days, start in ((1, "2024-01-30 00:00:00"), (3, "2024-01-28 00:00:00"), (7, "2024-01-24 00:00:00")):
        rows = briefing.window_items(items(spark, d), start, b.AS_OF).groupBy("edition").agg(F.count("*").alias("n")) \
            .select(F.lit(days).alias("days"), "edition", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cap_per_feed", SCORED + """SELECT edition, publisher, item_id FROM items
QUALIFY row_number() OVER (PARTITION BY edition, publisher ORDER BY position * 1000000 + item_id) <= 40""")
def _(spark, d):
    rows = items(spark, d).withColumn("place", F.col("position") * 1_000_000 + F.col("item_id"))
    return briefing.cap_per_feed(rows, ["edition", "publisher"], "place").select("edition", "publisher", "item_id")


@query("strip_source", SCORED + """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN trim(title) ELSE title END AS title FROM items""")
def _(spark, d):
    n = b.news_items(spark, d)
    shown = F.when(F.col("item_id") % 2 == 0, F.concat_ws(" - ", "title", "publisher")).otherwise(F.col("title"))
    return n.select("item_id", briefing.strip_source(shown, F.col("publisher")).alias("title"))


VOCAB = f""",
vocab AS (SELECT DISTINCT unnest({q.headline_words('t')}) AS word FROM (SELECT topic AS t FROM tree UNION ALL SELECT name FROM tree UNION ALL SELECT replace(unnest(tags), '-', ' ') FROM tree))"""


def vocabulary(spark, d):
    return briefing.interest_vocabulary(b.topic_tree(spark, d))


@query("interest_vocabulary", SCORED + VOCAB + "SELECT word FROM vocab")
def _(spark, d):
    return vocabulary(spark, d)


MERGED = VOCAB + f""",
u1 AS (SELECT edition, url, arg_max({{'item_id': item_id, 'title': title, 'publisher': publisher, 'category': category, 'score': score}}, {{'s': round(score, 6), 'a': -arrival}}) AS r,
         min(arrival) AS arrival, list_sort(list_distinct(flatten(list(topics)))) AS topics FROM items GROUP BY ALL),
u2 AS (SELECT edition, url, r.item_id AS item_id, r.title AS title, r.publisher AS publisher, r.category AS category, r.score AS score, arrival, topics,
         array_to_string(list_sort({q.headline_words('r.title')}), ' ') AS hw FROM u1),
u3 AS (SELECT edition, CASE WHEN hw <> '' THEN hw ELSE 'url ' || url END AS k, arg_max({{'item_id': item_id, 'title': title, 'url': url, 'publisher': publisher, 'category': category, 'score': score}}, {{'s': round(score, 6), 'a': -arrival}}) AS r,
         list_sort(list_distinct(flatten(list(topics)))) AS topics FROM u2 GROUP BY ALL),
merged AS (SELECT edition, r.item_id AS item_id, r.title AS title, r.url AS url, r.publisher AS publisher, r.category AS category, r.score AS score, topics FROM u3)"""


@query("merge_news", SCORED + MERGED + "SELECT edition, item_id, url, round(score, 4) AS score, array_to_string(topics, ' ') AS topics FROM merged")
def _(spark, d):
    return briefing.merge(items(spark, d)).select("edition", "item_id", "url", F.round("score", 4).alias("score"), F.array_join("topics", " ").alias("topics"))


BOOST = MERGED + f""",
boosted AS (SELECT * EXCLUDE (score), score AS base_score, round(score + 1.6 * least(1.0, hits / 2.0), 6) AS score FROM (
  SELECT *, len([w for w in {HW} if w IN (SELECT word FROM vocab)]) AS hits FROM merged)),
rk AS (SELECT *, row_number() OVER (PARTITION BY edition ORDER BY score DESC, url) AS rank, list_sort({HW}) AS hw FROM boosted)"""
BOOST = BOOST.replace("len([w for w in " + HW + " if w IN (SELECT word FROM vocab)])", f"len(list_intersect({HW}, (SELECT list(word) FROM vocab)))")


@query("interest_boost", SCORED + BOOST + "SELECT edition, item_id, hits AS interest_hits, round(base_score, 4) AS base_score, score FROM boosted")
def _(spark, d):
    rows = briefing.interest_boost(briefing.merge(items(spark, d)), vocabulary(spark, d))
    return rows.select("edition", "item_id", F.col("interest_hits").cast("bigint").alias("interest_hits"),
                       F.round("base_score", 4).alias("base_score"), F.round("score", 6).alias("score"))


CLUSTER = (SCORED + BOOST).replace("WITH", "WITH RECURSIVE", 1) + """,
lead AS (SELECT edition, CAST(0 AS BIGINT) AS rank, CAST([] AS STRUCT(r BIGINT, w VARCHAR[])[]) AS heads, CAST(NULL AS BIGINT) AS leader FROM (SELECT DISTINCT edition FROM rk)
  UNION ALL
  SELECT edition, rank, CASE WHEN mine IS NULL THEN list_append(heads, {'r': rank, 'w': hw}) ELSE heads END, coalesce(mine, rank) FROM (
    SELECT l.edition, k.rank, l.heads, k.hw,
      [h.r for h in l.heads if len(list_intersect(h.w, k.hw)) / greatest(1, len(h.w) + len(k.hw) - len(list_intersect(h.w, k.hw))) >= 0.55][1] AS mine
    FROM lead l JOIN rk k ON k.edition = l.edition AND k.rank = l.rank + 1)),
cl AS (SELECT rk.*, leader, count(*) OVER (PARTITION BY rk.edition, leader) - 1 AS related FROM rk JOIN (SELECT edition, rank, leader FROM lead WHERE rank > 0) USING (edition, rank))"""


_CLUSTERED: dict[tuple, object] = {}


def ranked(spark, d):
    return briefing.ranked_items(briefing.interest_boost(briefing.merge(items(spark, d)), vocabulary(spark, d)))


def clustered(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _CLUSTERED:
        _CLUSTERED[key] = stage(briefing.leader_cluster(ranked(spark, d)), "clustered")
    return _CLUSTERED[key]


@query("leader_cluster", CLUSTER + "SELECT edition, item_id, rank, leader, related FROM cl")
def _(spark, d):
    return briefing.leader_cluster(ranked(spark, d)).select("edition", "item_id", "rank", "leader", "related")


@query("cluster_size", CLUSTER + "SELECT edition, leader, count(*) - 1 AS related FROM cl GROUP BY ALL")
def _(spark, d):
    return briefing.cluster_size(clustered(spark, d)).select("edition", "leader", "related")


def picks(src, out, n, prefix):
    return f""",
{prefix} AS (SELECT edition, 0 AS step, CAST([] AS VARCHAR[]) AS cats, CAST([] AS VARCHAR[]) AS pubs, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS rank FROM (SELECT DISTINCT edition FROM {src})
  UNION ALL
  SELECT edition, step + 1, list_append(cats, b.category), list_append(pubs, lower(b.publisher)), list_append(used, b.leader), b.rank FROM (
    SELECT s.edition, s.step, s.cats, s.pubs, s.used, arg_max({{'rank': i.rank, 'category': i.category, 'publisher': i.publisher, 'leader': i.leader}},
       {{'s': round(i.score - 1.8 * len([x for x in s.cats if x = i.category]) - 1.4 * len([x for x in s.pubs if x = lower(i.publisher)]), 6), 'r': -i.rank}}) AS b
    FROM {prefix} s JOIN {src} i ON i.edition = s.edition WHERE NOT list_contains(s.used, i.leader) AND s.step < {n} GROUP BY ALL)),
{out} AS (SELECT i.*, p.step AS pick FROM {prefix} p JOIN {src} i ON i.edition = p.edition AND i.rank = p.rank WHERE step > 0)"""


PICK = CLUSTER + picks("cl", "short", 10, "st")


@query("diverse_pick", PICK + "SELECT edition, item_id, rank, pick FROM short")
def _(spark, d):
    return briefing.diverse_pick(clustered(spark, d)).select("edition", "item_id", "rank", F.col("pick").cast("int").alias("pick"))


@query("select_briefing", PICK + picks("short", "best", 5, "st2") + """
SELECT s.edition, s.item_id, s.pick AS place, b.pick AS reading_pick, round(s.score, 3) AS score,
  'Recent coverage of ' || s.topics[1] || '; selected for freshness, relevance, and ' || CASE WHEN s.hits > 0 THEN 'topics you follow' ELSE 'a mix of topics and publishers' END || '.'
  || CASE WHEN s.related > 0 THEN ' Related coverage was grouped so one story does not crowd out the rest.' ELSE '' END AS reason
FROM short s LEFT JOIN best b USING (edition, rank)""".replace("best b USING (edition, rank)", "best b ON b.edition = s.edition AND b.rank = s.rank"))
def _(spark, d):
    rows = briefing.select_briefing(items(spark, d), vocabulary(spark, d))
    return rows.select("edition", "item_id", F.col("place").cast("int").alias("place"),
                       F.col("reading_pick").cast("int").alias("reading_pick"), "score", "reason")


@query("feed_scan_report", """
WITH f AS (SELECT lang AS edition, source AS topic, max(n_chars) > 5000 AS ok FROM documents GROUP BY ALL),
p AS (SELECT edition, count(*) AS n FROM f WHERE ok GROUP BY edition)
SELECT f.edition, count(*) AS scanned, count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed,
  CASE WHEN max(coalesce(n, 0)) > 0 THEN 'complete' ELSE 'error' END AS state,
  CASE WHEN max(coalesce(n, 0)) = 0 THEN 'No dated articles found in this window. Try a wider window or retry when the news source is available.'
       WHEN max(n) < 5 THEN 'Fewer than five distinct recent stories were available. Showing only verified feed results.' ELSE 'Your five reading picks are ready.' END AS message
FROM f LEFT JOIN p USING (edition) GROUP BY f.edition""")
def _(spark, d):
    feeds = b.table(spark, d, "documents").groupBy(F.col("lang").alias("edition"), F.col("source").alias("topic")).agg((F.max("n_chars") > 5000).alias("ok"))
    return briefing.feed_scan_report(feeds, feeds.filter("ok"))
