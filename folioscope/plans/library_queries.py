"""Library, notebook and saved-search queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import library as lib
from ..operators.ranking import in_order
from . import bindings as b
from . import sqlparts as q
from .registry import query

A = q.with_(q.ARTICLES)
CARD = "doc_id, id, title, topic, subtopic, locked"
CARDS = ["doc_id", "id", "title", "topic", "subtopic", "locked"]


def stored():
    return [F.desc("added"), F.asc("doc_id")]


def on_page():
    """Place on a page, which has a hundred rows at most."""
    return F.row_number().over(Window.orderBy(*stored())).cast("bigint")


@query("library_first_page", A + f"""SELECT {CARD}, row_number() OVER (ORDER BY added DESC, doc_id) AS place FROM articles WHERE topic = 'en' AND locked = false
ORDER BY added DESC, doc_id LIMIT 60""")
def _(spark, d):
    return lib.first_page(b.articles(spark, d), stored(), limit=60, topic="en", access="free").withColumn("place", on_page()).select(*CARDS, "place")


@query("access_filter", A + "SELECT doc_id, id, title, topic, subtopic, locked FROM articles WHERE locked = true")
def _(spark, d):
    return lib.access_filter(b.articles(spark, d), "locked").select(*CARDS)


@query("library_page", A + f"""SELECT {CARD}, total, place - 120 AS place FROM (
  SELECT *, row_number() OVER (ORDER BY added DESC, doc_id) AS place, count(*) OVER () AS total FROM articles WHERE topic = 'en')
WHERE place > 120 AND place <= 180""")
def _(spark, d):
    rows = lib.page(b.articles(spark, d), stored(), offset=120, limit=60, topic="en")
    return rows.withColumn("place", on_page()).select(*CARDS, "total", "place")


COUNTS = """count(*) AS total, count(*) FILTER (locked = false) AS free, count(*) FILTER (locked = true) AS locked,
 count(*) FILTER (notes_count > 0) AS noted"""


def declared_tree(spark, d):
    """Every (language, source) pair that could exist, so that some declared subtopics are empty."""
    docs = b.table(spark, d, "documents")
    return docs.select(F.concat(F.lit("planned-"), "source").alias("subtopic"), F.col("lang").alias("topic")).union(
        docs.select(F.col("source"), F.col("lang"))).distinct()


@query("library_counts", A + f"""
, decl AS (SELECT DISTINCT lang AS topic, 'planned-' || source AS subtopic FROM documents)
SELECT 'library' AS level, '' AS topic, '' AS subtopic, {COUNTS} FROM articles
UNION ALL SELECT 'topic', topic, '', {COUNTS} FROM articles GROUP BY topic
UNION ALL SELECT 'subtopic', topic, subtopic, {COUNTS} FROM articles GROUP BY topic, subtopic
UNION ALL SELECT 'subtopic', topic, subtopic, 0, 0, 0, 0 FROM decl""")
def _(spark, d):
    return lib.counts(b.articles(spark, d), declared_tree(spark, d))


@query("auto_counts", A + """SELECT topic, subtopic, count(*) AS n FROM articles WHERE source = 'auto' GROUP BY ALL
UNION ALL SELECT topic, '', count(*) FROM articles WHERE source = 'auto' GROUP BY topic""")
def _(spark, d):
    return lib.auto_counts(b.articles(spark, d))


@query("library_status", A + """SELECT count(*) FILTER (source = 'auto') AS auto_articles,
count(*) FILTER (locked = true) AS member_only, count(*) FILTER (locked = false) AS free,
(SELECT k FROM (SELECT topic || '/' || subtopic AS k, max(added) AS last FROM articles GROUP BY 1) ORDER BY last DESC, k DESC LIMIT 1) AS last_subtopic
FROM articles""")
def _(spark, d):
    a = b.articles(spark, d)
    visits = a.groupBy(F.concat_ws("/", "topic", "subtopic").alias("subtopic_key")).agg(F.max("added").alias("last"))
    return lib.status(a, visits)


@query("index_status", q.with_(q.PAGE_POSTS) + """SELECT count(*) AS posts, count(DISTINCT day) AS days, min(day) AS oldest,
max(day) AS newest FROM posts""")
def _(spark, d):
    return lib.index_status(b.page_posts(spark, d))


@query("all_labels", A + """SELECT label, count(*) AS n FROM (SELECT replace(lower(trim(unnest(tags))), ' ', '-') AS label FROM articles)
GROUP BY label ORDER BY n DESC, label LIMIT 200""")
def _(spark, d):
    a = b.articles(spark, d)
    tags = a.select(F.explode("tags").alias("t")).select(text.label("t").alias("label"))
    return tags.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(200)


@query("purge_candidates", A + "SELECT id, url FROM articles WHERE source = 'auto' AND locked = false AND pdf IS NULL")
def _(spark, d):
    return lib.purge_candidates(b.articles(spark, d)).select("id", "url")


@query("purge", A + """SELECT id, url FROM articles WHERE NOT coalesce(source = 'auto' AND locked = false AND pdf IS NULL, false)""")
def _(spark, d):
    return lib.purge(b.articles(spark, d)).select("id", "url")


@query("access_todo", A + f"""SELECT id, added, locked_checked, row_number() OVER (ORDER BY added, id) AS place FROM articles WHERE locked IS NULL
AND (locked_checked IS NULL OR locked_checked <> {q.DAY})""")
def _(spark, d):
    return in_order(lib.access_todo(b.articles(spark, d), b.AS_OF).select("id", "added", "locked_checked"))


@query("access_todo_batch", A + f"""SELECT id, added, locked_checked, row_number() OVER (ORDER BY added, id) AS place FROM articles WHERE locked IS NULL
AND (locked_checked IS NULL OR locked_checked < {q.DAY} - 7)""")
def _(spark, d):
    return in_order(lib.access_todo(b.articles(spark, d), b.AS_OF, max_age_days=7).select("id", "added", "locked_checked"))


DISMISSED = """dismissed AS (SELECT DISTINCT a.url FROM engagement e JOIN articles a USING (doc_id) WHERE e.kind = 'error')"""


def dismissed(spark, d):
    e = b.engagement(spark, d).filter(F.col("kind") == "error")
    return e.join(b.articles(spark, d).select("doc_id", "url"), "doc_id").select("url").distinct()


SAVED = "saved AS (SELECT * FROM articles WHERE source = 'auto')"


@query("eligible_posts", q.with_(q.ARTICLES, q.ENGAGEMENT, DISMISSED, SAVED) + """
SELECT doc_id, url FROM articles a WHERE title <> '' AND lang = 'en' AND NOT response
AND url NOT IN (SELECT url FROM saved) AND url NOT IN (SELECT url FROM dismissed)""")
def _(spark, d):
    a = b.articles(spark, d)
    return lib.eligible(a, a.filter("source = 'auto'"), dismissed(spark, d)).select("doc_id", "url")


@query("exclude_known", q.with_(q.ARTICLES, SAVED) + "SELECT doc_id, url FROM articles WHERE url NOT IN (SELECT url FROM saved)")
def _(spark, d):
    a = b.articles(spark, d)
    return lib.exclude_known(a, a.filter("source = 'auto'")).select("doc_id", "url")


@query("day_range", q.with_(q.PAGE_POSTS) + """SELECT post_id, day FROM posts
WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""")
def _(spark, d):
    return lib.day_range(b.page_posts(spark, d), "2024-01-05", "2024-01-20").select("post_id", "day")


@query("mark_saved", q.with_(q.ARTICLES, q.DOC_POSTS) + """SELECT post_id, url,
url IN (SELECT url FROM articles WHERE source = 'bulk') AS saved FROM posts""")
def _(spark, d):
    a = b.articles(spark, d).filter("source = 'bulk'")
    return lib.mark_saved(b.document_posts(spark, d), a).select("post_id", "url", "saved")


@query("enrich_hits", q.with_(q.ARTICLES, q.DOC_POSTS) + """SELECT p.post_id, p.url,
coalesce(m.title, left(p.title, 20)) AS title, CASE WHEN m.url IS NOT NULL THEN m.snippet END AS snippet,
coalesce(nullif(m.author, ''), p.author, '') AS author, coalesce(m.published, p.day) AS published, m.claps, m.locked
FROM posts p LEFT JOIN (SELECT * FROM articles WHERE title <> '' AND source IS DISTINCT FROM 'bulk') m ON m.url = p.url""")
def _(spark, d):
    meta = b.articles(spark, d).filter("source is distinct from 'bulk'")
    hits = b.document_posts(spark, d).select(
        "post_id", "url", F.substring("title", 1, 20).alias("title"), "author", F.col("day").alias("published"))
    return lib.enrich(hits, meta)


@query("available_files", A + """SELECT id, CASE WHEN locked IS NOT NULL THEN '/files/' || pdf END AS pdf_url,
CASE WHEN fetched AND locked = true THEN '/files/doc/' || id || '.html' END AS doc_url FROM articles""")
def _(spark, d):
    a = b.articles(spark, d).withColumn("doc", F.when(F.col("fetched"), F.concat(F.lit("doc/"), "id", F.lit(".html"))))
    files = a.filter("locked is not null").select(F.col("pdf").alias("path")).union(
        a.filter("locked").select("doc"))
    return lib.available_files(a, files).select("id", "pdf_url", "doc_url")


@query("new_since", q.with_(q.ARTICLES, q.ENGAGEMENT) + """
, seen AS (SELECT DISTINCT reader, doc_id FROM engagement),
visits AS (SELECT reader, max(ts) AS last_visit FROM engagement WHERE kind = 'view' AND ts < TIMESTAMP '2024-01-12' GROUP BY reader)
SELECT s.reader, s.doc_id, coalesce(a.source = 'auto' AND a.added > v.last_visit, false) AS is_new
FROM seen s JOIN articles a USING (doc_id) LEFT JOIN visits v USING (reader)""")
def _(spark, d):
    e = b.engagement(spark, d)
    a = b.articles(spark, d).select("doc_id", "source", "added")
    rows = e.select("reader", "doc_id").distinct().join(a, "doc_id")
    early = e.filter((F.col("kind") == "view") & (F.col("ts") < F.lit("2024-01-12").cast("timestamp")))
    return lib.new_since(rows, early.groupBy("reader").agg(F.max("ts").alias("last_visit"))).select(
        "reader", "doc_id", "is_new")


FACET = "count(*) AS total, count(*) FILTER (locked = false) AS free, count(*) FILTER (locked = true) AS locked"


@query("suggestion_facets", A + f"""SELECT 'topic' AS facet, topic, {FACET} FROM articles GROUP BY topic
UNION ALL SELECT 'scope', 'fr', {FACET} FROM articles WHERE topic = 'fr'""")
def _(spark, d):
    return lib.suggestion_facets(b.articles(spark, d), "fr")


@query("suggestion_topic_filter", A + "SELECT id, topic FROM articles WHERE topic = 'de'")
def _(spark, d):
    return lib.scope(b.articles(spark, d), topic="de").select("id", "topic")


@query("canonical_url_dedupe", rf"""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h,
  rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages),
n AS (SELECT page_id, s || '://' || lower(h) || path AS url FROM p WHERE contains(h, '.')),
v AS (SELECT page_id, 'https://' || regexp_extract(url, '//(.*)$', 1) AS url FROM n
      UNION ALL SELECT page_id + 1000000, 'https://' || regexp_extract(url, '//(.*)$', 1) FROM n),
f AS (SELECT url, min(page_id) AS page_id FROM v GROUP BY url),
held AS (SELECT url FROM v WHERE page_id < 1000000 AND contains(url, '/en/'))
SELECT page_id, url, left(sha1(url), 12) AS id FROM f WHERE url NOT IN (SELECT url FROM held)""")
def _(spark, d):
    p = b.table(spark, d, "pages")
    host = F.regexp_extract("url", "//(.*)$", 1)
    incoming = p.select("page_id", F.concat(F.lit("HTTPS://me@"), host, F.lit("#x")).alias("url")).union(
        p.select((F.col("page_id") + 1_000_000).alias("page_id"), host.alias("url")))
    held = incoming.filter("page_id < 1000000 and contains(url, '/en/')").select(urls.normalize_url("url").alias("url"))
    return lib.insert_new(held, incoming, [F.asc("page_id")]).select("page_id", "url", "id")


@query("discover_merge_order", q.with_(q.NEWS) + """
SELECT *, row_number() OVER (ORDER BY published DESC NULLS LAST, item_id) AS place FROM (
  SELECT item_id, url, title, published FROM news QUALIFY row_number() OVER (PARTITION BY url ORDER BY item_id) = 1)""")
def _(spark, d):
    return in_order(lib.discover_merge(b.news_items(spark, d), "item_id").select("item_id", "url", "title", "published"))


@query("tree_merge", A + f"""
, stored AS (SELECT DISTINCT topic, subtopic, 'kept' AS name FROM articles WHERE fetched),
defaults AS (SELECT DISTINCT topic, subtopic, 'default' AS name FROM articles)
SELECT * FROM stored UNION ALL SELECT d.* FROM defaults d ANTI JOIN stored s USING (topic, subtopic)""")
def _(spark, d):
    a = b.articles(spark, d)
    stored_tree = a.filter("fetched").select("topic", "subtopic", F.lit("kept").alias("name")).distinct()
    return lib.merge_tree(stored_tree, a.select("topic", "subtopic", F.lit("default").alias("name")).distinct())


NCOUNT = """(coalesce(len(highlights), 0) + CASE WHEN trim(coalesce(notes, '')) <> '' THEN 1 ELSE 0 END
 + CASE WHEN trim(coalesce(summary, '')) <> '' THEN 1 ELSE 0 END)"""
NB = q.with_(q.ARTICLES, q.NOTES)


@query("notes_count", q.with_(q.NOTES) + f"SELECT article_id, {NCOUNT} AS notes_count FROM notes")
def _(spark, d):
    return b.notes(spark, d).select("article_id", lib.notes_count().alias("notes_count"))


@query("notes_to_articles", NB + f"""SELECT article_id, title, edited, {NCOUNT} AS notes_count, row_number() OVER (ORDER BY edited DESC, article_id) AS place
FROM notes JOIN (SELECT id, title FROM articles WHERE source IS NOT NULL) ON id = article_id WHERE {NCOUNT} > 0""")
def _(spark, d):
    live = b.articles(spark, d).filter("source is not null")
    return in_order(lib.notebook(live, b.notes(spark, d)).select("article_id", "title", "edited", "notes_count"))


@query("notebook_filter", NB + f"""SELECT article_id, edited FROM notes JOIN articles ON id = article_id
WHERE {NCOUNT} > 0 AND (contains(lower(title), 'then') OR contains(lower(author), 'then') OR contains(lower(coalesce(summary, '')), 'then')
 OR contains(lower(coalesce(notes, '')), 'then')
 OR len([1 for h in highlights if contains(lower(coalesce(h.quote, '')), 'then') OR contains(lower(coalesce(h.note, '')), 'then')]) > 0)""")
def _(spark, d):
    entries = lib.notebook(b.articles(spark, d), b.notes(spark, d))
    return lib.notebook_filter(entries, " THEN ").select("article_id", "edited")


@query("notebook_markdown", NB + rf"""
SELECT article_id, '# ' || title || chr(10) || url || chr(10)
 || CASE WHEN trim(coalesce(summary, '')) <> '' THEN chr(10) || '## Summary' || chr(10) || trim(summary) || chr(10) ELSE '' END
 || CASE WHEN trim(coalesce(notes, '')) <> '' THEN chr(10) || '## Notes' || chr(10) || trim(notes) || chr(10) ELSE '' END
 || array_to_string(list_reverse([chr(10) || '> ' || regexp_replace(h.quote, '\s*\n+\s*', ' ', 'g')
     || CASE WHEN trim(coalesce(h.note, '')) <> '' THEN chr(10) || chr(10) || trim(h.note) ELSE '' END || chr(10) for h in coalesce(highlights, [])]), '') AS markdown
FROM notes JOIN articles ON id = article_id WHERE {NCOUNT} > 0""")
def _(spark, d):
    entries = lib.notebook(b.articles(spark, d), b.notes(spark, d))
    entries = entries.withColumn("highlights", F.coalesce(
        "highlights", F.array().cast(entries.schema["highlights"].dataType)))
    return entries.select("article_id", lib.entry_markdown().alias("markdown"))


LIB_SEARCH = q.with_(q.ARTICLES, q.LIBQ) + """
, w AS (SELECT *, list_concat(plain, flatten([string_split(p, ' ') for p in phrases])) AS words FROM libq),
m AS (SELECT query_id, id, added, fetched, plain, phrases, words, minus, lower(title) AS t,
        lower(concat_ws(' ', author, snippet, topic, subtopic)) AS r FROM w, articles WHERE len(words) > 0),
k AS (SELECT *, [x for x in words if contains(t, x)] AS tw, [x for x in words if contains(t, x) OR contains(r, x)] AS aw,
        [instr(t, x) for x in plain if contains(t, x)] AS o,
        [p for p in phrases if contains(t, p)] AS tp FROM m
      WHERE len([x for x in minus if contains(t, x) OR contains(r, x)]) = 0
        AND len([p for p in phrases if NOT contains(t, p) AND NOT contains(r, p)]) = 0),
s AS (SELECT query_id, id, added, round(round(2.5 * len(aw) / len(words) + 1.2 * len(tw) / len(words)
        + 0.6 * CASE WHEN len(o) > 1 THEN len(o) / (list_max(o) - list_min(o) + 1.0) ELSE 0 END
        + 0.5 * len(tp) + 0.3 * CAST(fetched AS INTEGER), 9), 4) AS score FROM k WHERE len(aw) > 0)
SELECT query_id, rank, id, score, total FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, added DESC, id) AS rank,
         count(*) OVER (PARTITION BY query_id) AS total FROM s) WHERE rank <= 20"""


@query("library_search", LIB_SEARCH)
def _(spark, d):
    rows = lib.library_search(b.library_queries(spark, d), b.articles(spark, d), limit=20)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("substring_library_join", q.with_(q.ARTICLES, q.LIBQ) + """
SELECT query_id, count(*) AS matches FROM libq, articles
WHERE len([x for x in plain if contains(lower(title), x) OR contains(lower(concat_ws(' ', author, snippet, topic, subtopic)), x)]) > 0
GROUP BY query_id""")
def _(spark, d):
    none = F.array().cast("array<string>")
    plain_only = b.library_queries(spark, d).withColumn("phrases", none).withColumn("minus", none)
    found = lib.library_search(plain_only, b.articles(spark, d), limit=1)
    return found.select("query_id", F.col("total").alias("matches"))
