"""Sources and change data. The landed files are built by Spark from the given tables, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import reconcile
from ..operators.ranking import in_order
from ..sources import feeds, pages, papers, sitemaps, store
from . import bindings as b
from . import sqlparts as q
from .registry import query




def sitemap_files(spark, d):
    """One landed sitemap text per page and document: the post's URL with and without a priority."""
    a = b.articles(spark, d).select(F.col("doc_id").alias("n"), "title", F.col("author"), F.col("published").alias("day"))
    url = F.concat(F.lit("https://"), "author", F.lit(".example.org/"), text.slug("title"), F.lit("-"), F.substring(F.sha1("title"), 1, 10))
    k = F.col("n") % 3
    prio = F.when(k == 0, F.concat(F.lit("<priority>"), (F.col("n") % 10 / 10).cast("string"), F.lit("</priority>"))).when(
        k == 1, F.lit("<priority>1.0.0</priority>")).otherwise(F.lit(""))
    xml = F.concat(F.lit("<urlset><url>\n<loc> "), url, F.lit(" </loc>"), prio, F.lit("</url><url><loc>https://x.example.org/thanks</loc></url></urlset>"))
    return a.select("day", F.concat(F.lit("m"), F.col("day").cast("string")).alias("lastmod"), xml.alias("text"), url.alias("loc"), "n")


SM = q.with_(q.ARTICLES, """
sm AS (SELECT doc_id AS n, published AS day, title, author,
  'https://' || author || '.example.org/' || trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') || '-' || left(sha1(title), 10) AS url,
  CASE WHEN doc_id % 3 = 0 THEN (doc_id % 10) / 10.0 ELSE 0.2 END AS prio FROM articles),
st AS (SELECT *, trim(replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '-?[0-9a-f]{8,12}$', ''), '-', ' ')) AS t FROM sm),
ok AS (SELECT day, url, upper(left(t, 1)) || t[2:] AS title, author, prio FROM st WHERE len([w for w in string_split(t, ' ') if w <> '']) >= 2)""")


@query("sitemap_ingest", SM + """SELECT day, url, title, author, prio FROM ok WHERE url NOT IN (SELECT url FROM sm WHERE n % 7 = 0)
QUALIFY row_number() OVER (PARTITION BY url ORDER BY day DESC, prio) = 1""")
def _(spark, d):
    raw = sitemap_files(spark, d)
    known = raw.filter("n % 7 = 0").select(F.col("loc").alias("url"))
    return sitemaps.sitemap_ingest(raw, known)


@query("sitemap_ledger", SM + """SELECT sm.day, 'm' || CAST(sm.day AS VARCHAR) AS lastmod, (SELECT count(*) FROM ok WHERE ok.day = sm.day) AS posts FROM (SELECT DISTINCT day FROM sm) sm""")
def _(spark, d):
    return sitemaps.ledger_rows(sitemap_files(spark, d))


@query("sitemap_pending", """
WITH days AS (SELECT DISTINCT CAST(DATE '2024-02-05' - CAST(doc_id AS INTEGER) AS DATE) AS day FROM documents),
led AS (SELECT DISTINCT CAST(DATE '2024-02-05' - CAST(doc_id AS INTEGER) AS DATE) AS day FROM labels)
SELECT days.day, 'https://x.example.org/sitemap/posts/posts-' || CAST(days.day AS VARCHAR) || '.xml' AS url, 'new' AS lastmod, row_number() OVER (ORDER BY days.day DESC) AS place
FROM days LEFT JOIN led USING (day) WHERE days.day BETWEEN DATE '2024-01-31' - 365 AND DATE '2024-01-31' AND (led.day IS NULL OR days.day >= DATE '2024-01-28')""")
def _(spark, d):
    def day(t):
        return F.date_sub(F.lit("2024-02-05").cast("date"), F.col("doc_id").cast("int"))

    days = b.table(spark, d, "documents").select(day("doc_id").alias("day")).distinct()
    xml = F.concat(F.lit("<sitemap><loc>https://x.example.org/sitemap/posts/posts-"), F.col("day").cast("string"),
                   F.lit(".xml</loc>\n<lastmod>new</lastmod></sitemap>"))
    ledger = b.table(spark, d, "labels").select(day("doc_id").alias("day"), F.lit("old").alias("lastmod")).distinct()
    return in_order(sitemaps.sitemap_pending(sitemaps.sitemap_listing(days.select(xml.alias("text"))), ledger, "2024-01-31"))


# ---------------------------------------------------------------- feeds


def escaped(c):
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def tag_feeds(spark, d):
    """One landed feed per document with its title, whole text as snippet and two categories; some have a bad link."""
    a = b.articles(spark, d)
    day = F.col("published").cast("timestamp") + F.make_dt_interval(hours=(F.col("doc_id") % 24).cast("int"))
    item = F.concat(
        F.lit("<rss><channel><item><title><![CDATA["), "title", F.lit("]]></title><link>"),
        F.when(F.col("doc_id") % 9 == 0, F.lit("mailto:x@y")).otherwise(F.concat("url", F.lit("?source=rss"))), F.lit("</link><dc:creator><![CDATA["), "author",
        F.lit("]]></dc:creator><description>"), escaped(F.concat(
            F.lit('<p><img src="https://img.example.org/'), "id", F.lit('.png" /></p><p class="medium-feed-snippet">'), escaped(F.col("snippet")), F.lit("</p>"))),
        F.lit("</description><category>"), escaped(F.col("topic")), F.lit("</category><category>"), "subtopic", F.lit("</category><pubDate>"),
        F.when(F.col("doc_id") % 4 == 0, F.lit("someday")).otherwise(F.concat(F.lit("Mon, "), F.date_format(day, "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))),
        F.lit("</pubDate></item></channel></rss>"))
    return a.select(F.col("subtopic").alias("tag"), item.alias("text"))


@query("tag_feed_items", q.with_(q.ARTICLES) + r"""
SELECT url, trim(title) AS title, author, CASE WHEN doc_id % 4 <> 0 THEN CAST(published AS TIMESTAMP) + CAST(doc_id % 24 AS INTEGER) * INTERVAL 1 HOUR END AS published,
  'https://img.example.org/' || id || '.png' AS image, trim(snippet) AS snippet, topic || '|' || subtopic AS categories, subtopic AS tag FROM articles WHERE doc_id % 9 <> 0""")
def _(spark, d):
    return feeds.tag_feed_items(tag_feeds(spark, d)).select(
        "url", "title", "author", "published", "image", "snippet", F.array_join("categories", "|").alias("categories"), "tag")


def news_feeds(spark, d):
    """Landed feeds of many items: the documents of one language, five hundred numbers at a time, in order."""
    n = b.news_items(spark, d)
    item = F.concat(
        F.lit("<item><title>"), escaped(F.concat_ws(" - ", "title", "publisher")), F.lit("</title><link>"), "url", F.lit("</link><source url='x'>"),
        "publisher", F.lit("</source><pubDate>"), F.date_format("published", "dd MMM yyyy HH:mm"), F.lit(" +0000</pubDate></item>"))
    part = F.floor(F.col("item_id") / 500)
    lists = n.groupBy("edition", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("item_id", item.alias("item")))).alias("items"))
    text = F.concat(F.lit("<rss><channel>"), F.array_join(F.transform("items", lambda x: x["item"]), "\n"), F.lit("</channel></rss>"))
    return lists.select("edition", F.concat(F.lit("g"), (F.col("part") % 5).cast("string")).alias("category"), F.concat_ws(" ", "edition", F.lit("the und")).alias("query"), text.alias("text"))


@query("news_feed_parse", q.with_(q.NEWS) + f"""
SELECT edition, url, trim(title) AS title, publisher, published, 'g' || CAST(item_id // 500 % 5 AS VARCHAR) AS category, position,
  round(4 * exp(-((epoch_us({q.AS_OF}) - epoch_us(published)) / 3600e6) / 36)
   + 2 * len(list_intersect({q.headline_words('title')}, {q.headline_words("edition || ' the und'")})) / greatest(1, len({q.headline_words("edition || ' the und'")}))
   + 1 / (1 + position / 5.0), 4) AS score
FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY edition, item_id // 500 ORDER BY item_id) - 1 AS position) FROM news)
WHERE published BETWEEN {q.AS_OF} - INTERVAL 3 DAY AND {q.AS_OF} AND trim(title) <> ''""")
def _(spark, d):
    rows = feeds.news_feed_items(news_feeds(spark, d), "2024-01-28 00:00:00", b.AS_OF, first=None, title_length=None)
    return rows.select("edition", "url", "title", "publisher", "published", "category", F.col("position").cast("bigint").alias("position"), F.round("score", 4).alias("score"))


FEED = q.with_(q.ARTICLES) + f""",
fq AS (SELECT query_id, words, [x[2] for x in list_sort([[lpad(CAST(list_position(ts, t) AS VARCHAR), 9, '0'), t] for t in list_distinct(ts)])] AS tags FROM (
  SELECT query_id, words, list_concat(list_concat([array_to_string(words, '-')], [words[i] || '-' || words[i + 1] for i in range(1, len(words))]), words) AS ts
  FROM (SELECT item_id AS query_id, [w for w in regexp_extract_all(lower(text), '[a-z0-9]+') if w NOT IN {q.inlist(fixed.FEED_STOPWORDS)}] AS words FROM benchmark) WHERE len(words) > 0)),
ft AS (SELECT query_id, words, unnest(tags) AS tag FROM fq),
fi AS (SELECT url, unnest(tags) AS tag, title, snippet, topic, published FROM articles),
fs AS (SELECT DISTINCT query_id, url, published, len([w for w in words if contains(lower(concat_ws(' ', title, snippet, topic)), w)]) AS score FROM ft JOIN fi USING (tag)),
feed AS (SELECT * FROM fs WHERE score > 0)"""


def feed_queries(spark, d):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(w, " ").alias("text"))


def feed_rows(spark, d):
    """Documents as items of the feeds of their tags."""
    a = b.articles(spark, d)
    return a.select("url", F.explode("tags").alias("tag"), "title", "snippet", F.array("topic").alias("categories"), "published", F.lit(0).alias("position"))


@query("feed_search", FEED + "SELECT query_id, url, score FROM feed")
def _(spark, d):
    return feeds.feed_search(feed_queries(spark, d), feed_rows(spark, d), None).select("query_id", "url", F.col("score").cast("bigint").alias("score"))


@query("feed_topup", FEED + """,
hit AS (SELECT query_id, url FROM feed WHERE score >= 3),
nn AS (SELECT query_id, count(*) AS n FROM hit GROUP BY 1),
ex AS (SELECT f.query_id, f.url, row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, published DESC, f.url) AS r
  FROM feed f LEFT JOIN nn USING (query_id) ANTI JOIN hit ON hit.query_id = f.query_id AND hit.url = f.url WHERE coalesce(n, 0) < 20)
SELECT query_id, url, 'index' AS provider FROM hit UNION ALL SELECT query_id, url, 'feeds' FROM ex WHERE r <= 20""")
def _(spark, d):
    found = feeds.feed_search(feed_queries(spark, d), feed_rows(spark, d), None)
    return feeds.feed_topup(found.filter("score >= 3").select("query_id", "url"), found)


# ---------------------------------------------------------------- pages


def state_pages(spark, d):
    """Post pages with an embedded JSON state, built from the articles; some hold infinite or impossible numbers."""
    a = b.articles(spark, d)
    i = F.col("doc_id")
    k = i % 5
    pid = F.substring("id", 1, 10)

    def js(c):
        return F.to_json(F.struct(c.alias("v")))

    def val(c):  # the JSON text of one string
        return F.regexp_extract(js(c), r'(?s)^\{"v":(.*)\}$', 1)

    claps = F.when(k == 0, F.lit("Infinity")).when(k == 1, F.lit('"many"')).otherwise(F.col("claps").cast("string"))
    date = F.when(k == 2, F.lit("-5")).when(k == 3, F.lit("1e30")).otherwise(F.concat((F.unix_date("published") * 86400).cast("string"), F.lit("000")))
    tag_refs = F.array_join(F.transform("tags", lambda t: F.concat(F.lit('{"__ref":"Tag:'), t, F.lit('"}'))), ",")
    html = F.concat(
        F.lit('<html><body><script>window.__APOLLO_STATE__ = {"ROOT":{},"Post:'), pid, F.lit('":{"id":"x","title":'), val(F.concat(F.lit(" "), "title")),
        F.lit(',"clapCount":'), claps, F.lit(',"readingTime":6.6,"detectedLanguage":'), val(F.col("lang")), F.lit(',"isLocked":'),
        F.coalesce(F.col("locked"), F.lit(False)).cast("string"), F.lit(',"firstPublishedAt":'), date, F.lit(',"creator":{"__ref":"User:1"},"tags":['), tag_refs,
        F.lit('],"previewImage":{"id":"'), "id", F.lit('"},"extendedPreviewContent":{"subtitle":'), val(F.col("snippet")),
        F.lit('}},"User:1":{"name":'), val(F.col("author")), F.lit("}};</script></body></html>"))
    return a.select("doc_id", F.concat(F.lit("https://x.example.org/p/a-title-"), pid).alias("url"),
                    F.when(i % 13 == 0, F.lit("<html>nothing here</html>")).otherwise(html).alias("html"))


@query("page_metadata", q.with_(q.ARTICLES) + """
SELECT 'https://x.example.org/p/a-title-' || left(id, 10) AS url, g AS readable, CASE WHEN g THEN title END AS title, CASE WHEN g THEN trim(snippet) END AS subtitle,
  CASE WHEN g THEN author END AS author, CASE WHEN g AND doc_id % 5 NOT IN (2, 3) THEN CAST(published AS TIMESTAMP) END AS published,
  CASE WHEN g THEN CASE WHEN doc_id % 5 IN (0, 1) THEN 0 ELSE claps END END AS claps, CASE WHEN g THEN CAST(7 AS BIGINT) END AS reading_time, CASE WHEN g THEN lang END AS lang,
  CASE WHEN g THEN coalesce(locked, false) END AS locked, CASE WHEN g THEN array_to_string(list_sort(tags), ' ') END AS tags,
  CASE WHEN g THEN 'https://miro.medium.com/v2/resize:fill:320:214/' || id END AS image
FROM (SELECT *, doc_id % 13 <> 0 AS g FROM articles)""")
def _(spark, d):
    m = pages.page_metadata(state_pages(spark, d))
    return m.select("url", "readable", "title", "subtitle", "author", "published", "claps", "reading_time", "lang", "locked",
                    F.array_join(F.array_sort("tags"), " ").alias("tags"), "image")


@query("page_head_meta", f"""SELECT url, left(trim(regexp_replace({q.clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')), 500) AS title,
CAST(NULL AS VARCHAR) AS image, '' AS published FROM pages""")
def _(spark, d):
    return pages.page_head_meta(b.table(spark, d, "pages"))


@query("readable_extract")
def _(spark, d):
    return pages.readable_extract(pages.page_blocks(b.table(spark, d, "pages")))


@query("readable_block_stats")
def _(spark, d):
    return pages.block_stats(pages.page_blocks(b.table(spark, d, "pages")))


def story_blocks(spark, d):
    """Lines of the documents as blocks; the first line repeats the title as a heading now and then."""
    docs = b.articles(spark, d)
    lines = docs.select("url", "title", "snippet", F.posexplode(F.split("snippet", "\n")).alias("pos", "text"))
    head = F.col("pos") == 0
    return lines.select(
        "url", "pos", F.when(head, "H3").otherwise("P").alias("kind"), F.when(head, F.concat(F.lit("¡"), "title", F.lit("!"))).otherwise(F.col("text")).alias("text"))


@query("drop_repeated_heading", q.with_(q.ARTICLES) + r"""
SELECT url, k - 1 AS pos, CASE WHEN k = 1 THEN 'H3' ELSE 'P' END AS kind, CASE WHEN k = 1 THEN '¡' || title || '!' ELSE string_split(snippet, chr(10))[k] END AS text
FROM (SELECT *, unnest(range(1, len(string_split(snippet, chr(10))) + 1)) AS k FROM articles)
WHERE k > 1 OR regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g') = ''""")
def _(spark, d):
    meta = b.articles(spark, d).select("url", "title", F.lit("").alias("subtitle"))
    return pages.drop_repeated_heading(story_blocks(spark, d), meta).select("url", F.col("pos").cast("bigint").alias("pos"), "kind", "text")


@query("shown_subtitle")
def _(spark, d):
    a = b.articles(spark, d).select("url", F.concat("title", F.lit("…")).alias("subtitle"))
    return pages.shown_subtitle(story_blocks(spark, d), a)


# ---------------------------------------------------------------- papers


def works(spark, d):
    """Works built from the articles: JSON with JATS abstracts, double-encoded entities and one of four dates."""
    a = b.articles(spark, d)
    i = F.col("doc_id")

    def at(k, *parts):
        return F.when(i % 4 == k, F.struct(F.array(F.array(*parts)).alias("date-parts")))

    y, m, day = F.year("published"), F.month("published"), F.dayofmonth("published")
    row = F.struct(
        F.when(i % 11 != 0, F.concat(F.lit("10.5555/X."), F.col("id"))).alias("DOI"), F.array(F.concat("title", F.lit(" &amp;amp; more"))).alias("title"),
        F.array(F.struct(F.lit("Ada").alias("given"), F.col("author").alias("family"), F.lit(None).cast("string").alias("name")),
                F.struct(F.lit(None).cast("string").alias("given"), F.lit(None).cast("string").alias("family"), F.lit("An &lt;Org&gt;").alias("name"))).alias("author"),
        F.concat(F.lit("<jats:p>"), F.regexp_replace("snippet", "[<>&]", " "), F.lit("</jats:p>")).alias("abstract"), F.array("subtopic").alias("container-title"),
        F.lit("journal-article").alias("type"), at(0, y, m, day).alias("issued"), at(1, y, m).alias("published"), at(2, y).alias("published-print"),
        F.col("claps").alias("is-referenced-by-count"),
    )
    return a.select("doc_id", F.from_json(F.to_json(row), papers.WORK_SCHEMA).alias("w")).select("doc_id", "w.*")


@query("paper_records", q.with_(q.ARTICLES) + r"""
SELECT left(sha256(lower('10.5555/X.' || id)), 16) AS id, '10.5555/X.' || id AS doi, trim(regexp_replace(title || ' & more', '[\s ]+', ' ', 'g')) AS title,
  'Ada ' || author || '; An <Org>' AS authors, trim(regexp_replace(regexp_replace(snippet, '[<>&]', ' ', 'g'), '[\s ]+', ' ', 'g')) AS abstract, subtopic AS venue,
  CASE doc_id % 4 WHEN 0 THEN strftime(published, '%Y-%m-%d') WHEN 1 THEN strftime(published, '%Y-%m') WHEN 2 THEN strftime(published, '%Y') END AS published,
  CASE WHEN doc_id % 4 < 3 THEN CAST(year(published) AS INTEGER) END AS year, 'journal article' AS type, 'https://doi.org/' || lower('10.5555/X.' || id) AS url, claps AS cited_by
FROM articles WHERE doc_id % 11 <> 0""")
def _(spark, d):
    return papers.paper_records(works(spark, d)).select(
        "id", "doi", "title", F.array_join("authors", "; ").alias("authors"), "abstract", "venue", "published", "year", "type", "url", "cited_by")


@query("paper_search")
def _(spark, d):
    w = works(spark, d).withColumn("query_id", F.get("container-title", F.lit(0))).withColumn("place", F.col("doc_id"))
    return papers.paper_search(w, rows=None).select("query_id", "place", "id", "doi", "title")


@query("papers_order", q.with_(q.ARTICLES) + """SELECT *, row_number() OVER (ORDER BY shown DESC, id) AS place FROM (
  SELECT id, coalesce(CAST(locked_checked AS VARCHAR), CAST(published AS VARCHAR), '') AS shown FROM articles)""")
def _(spark, d):
    a = b.articles(spark, d).withColumn("saved_at", F.col("locked_checked"))
    return in_order(papers.papers_order(a).select("id", F.coalesce(F.col("saved_at").cast("string"), F.col("published").cast("string"), F.lit("")).alias("shown")))


@query("shelf_projection", q.with_(q.ARTICLES) + "SELECT id, title, published FROM articles")
def _(spark, d):
    return papers.shelf_projection(b.articles(spark, d).select("id", "title", "published", F.col("snippet").alias("raw")))


# ---------------------------------------------------------------- library files


@query("load_library", q.with_(q.ARTICLES) + """SELECT id, url, CASE WHEN source IS NULL AND claps IS NOT NULL THEN 'auto' ELSE source END AS source FROM articles WHERE NOT response""")
def _(spark, d):
    a = b.articles(spark, d).withColumn("url", F.when(~F.col("response"), F.col("url")))
    return store.clean_library(a).select("id", "url", "source")


@query("upsert_rows", q.with_(q.ARTICLES, q.ENGAGEMENT) + """,
inc AS (SELECT a.id, e.kind AS title, e.ts FROM engagement e JOIN articles a USING (doc_id) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY e.ts DESC) = 1)
SELECT id, title FROM inc UNION ALL SELECT id, title FROM articles WHERE id NOT IN (SELECT id FROM inc)""")
def _(spark, d):
    a = b.articles(spark, d)
    incoming = b.engagement(spark, d).join(a.select("doc_id", "id"), "doc_id").select("id", F.col("kind").alias("title"), "ts")
    return store.latest_rows(a.select("id", "title"), incoming, "id", "ts")


EXPORTED = ["id", "url", "title", "author", "topic", "subtopic", "claps", "locked", "source", "pdf"]


@query("library_export", q.with_(q.ARTICLES) + f"""
SELECT id, CASE WHEN source = 'bulk' THEN
  '{{' || array_to_string([x FOR x IN [{", ".join(f"""CASE WHEN {c}::VARCHAR <> '' THEN '"{c}":' || to_json({c})::VARCHAR END""" for c in EXPORTED)}] IF x IS NOT NULL], ',') || '}}'
  ELSE '{{' || array_to_string([{", ".join(f"""'"{c}":' || coalesce(to_json({c})::VARCHAR, 'null')""" for c in EXPORTED)}], ',') || '}}' END AS json FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select("id", store.export_json(EXPORTED).alias("json"))


# ---------------------------------------------------------------- change data

OVER = q.with_(q.ARTICLES) + """,
base AS (SELECT id, title, topic, claps FROM articles WHERE source IS NOT NULL),
ov AS (SELECT id, '+' || title AS title, topic, claps + 1 AS claps, NOT fetched AND response AS deleted FROM articles WHERE fetched OR response)"""


def overlay(spark, d):
    a = b.articles(spark, d)
    base = a.filter("source is not null").select("id", "title", "topic", "claps")
    ov = a.filter("fetched or response").select("id", F.concat(F.lit("+"), "title").alias("title"), "topic", (F.col("claps") + 1).alias("claps"),
                                                (~F.col("fetched") & F.col("response")).alias("deleted"))
    return base, ov


@query("apply_overlay", OVER + """SELECT id, title, topic, claps, id NOT IN (SELECT id FROM base) AS is_new FROM ov WHERE NOT deleted
UNION ALL SELECT id, title, topic, claps, false FROM base WHERE id NOT IN (SELECT id FROM ov)""")
def _(spark, d):
    return reconcile.apply_overlay(*overlay(spark, d))


@query("merge_metadata", """WITH o AS (SELECT DISTINCT source AS key, 'new' AS value FROM documents WHERE lang = 'es') SELECT key, value FROM o
UNION ALL SELECT DISTINCT source, 'old' FROM documents WHERE source NOT IN (SELECT key FROM o)""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    base = docs.select(F.col("source").alias("key"), F.lit("old").alias("value")).distinct()
    return reconcile.merge_metadata(base, docs.filter("lang = 'es'").select(F.col("source").alias("key"), F.lit("new").alias("value")).distinct())


DIFF = OVER + """,
live AS (SELECT id, title, topic, claps FROM ov WHERE NOT deleted UNION ALL SELECT id, title, topic, claps FROM base WHERE id NOT IN (SELECT id FROM ov)),
cur AS (SELECT id, title, CASE WHEN topic = 'de' THEN 'moved' ELSE topic END AS topic, claps FROM live WHERE topic <> 'es'
  UNION ALL SELECT id, title, topic, claps FROM ov WHERE deleted AND topic = 'fr'),
was AS (SELECT id, title, topic, claps FROM ov WHERE NOT deleted UNION ALL SELECT id, title, topic, claps FROM base WHERE id NOT IN (SELECT id FROM ov)),
chg AS (SELECT c.id, c.title, c.topic, c.claps, false AS deleted FROM cur c LEFT JOIN was w USING (id) WHERE w.id IS NULL OR w.topic <> c.topic),
rem AS (SELECT w.id, CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS topic, CAST(NULL AS BIGINT) AS claps, true AS deleted FROM was w WHERE id NOT IN (SELECT id FROM cur))
SELECT * FROM chg UNION ALL SELECT * FROM rem UNION ALL SELECT * FROM ov WHERE id NOT IN (SELECT id FROM chg UNION ALL SELECT id FROM rem)"""


@query("diff_overlay", DIFF)
def _(spark, d):
    base, ov = overlay(spark, d)
    live = reconcile.apply_overlay(base, ov).drop("is_new")
    cur = live.filter("topic <> 'es'").withColumn("topic", F.when(F.col("topic") == "de", "moved").otherwise(F.col("topic")))
    cur = cur.unionByName(ov.filter("deleted and topic = 'fr'").drop("deleted"))
    return reconcile.diff_overlay(cur, base, ov)


FILES = """
WITH loc AS (SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size, sha256(text) AS sha256, lang FROM documents),
rem AS (SELECT path, size, CASE WHEN lang = 'fr' THEN 'stale' ELSE sha256 END AS sha256 FROM loc WHERE lang <> 'es')"""


def manifests(spark, d):
    loc = b.table(spark, d, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"), "lang")
    rem = loc.filter("lang <> 'es'").select("path", "size", F.when(F.col("lang") == "fr", "stale").otherwise(F.col("sha256")).alias("sha256"))
    return loc.drop("lang"), rem


@query("manifest_diff", FILES + """SELECT loc.path, loc.size, loc.sha256, CASE WHEN rem.path IS NULL THEN 'absent' ELSE 'changed' END AS why
FROM loc LEFT JOIN rem USING (path) WHERE rem.path IS NULL OR rem.sha256 <> loc.sha256""")
def _(spark, d):
    return reconcile.manifest_diff(*manifests(spark, d))


@query("content_match", FILES + """SELECT loc.path, loc.size, loc.sha256, r.remote_path FROM loc LEFT JOIN (SELECT size, sha256, min(path) AS remote_path FROM rem GROUP BY ALL) r USING (size, sha256)""")
def _(spark, d):
    return reconcile.content_match(*manifests(spark, d))


@query("reuse_digests", """SELECT 'd/' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size, doc_id AS mtime, CASE WHEN lang = 'en' THEN sha256(text) END AS sha256 FROM documents""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    path = F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path")
    old = docs.select(path, F.col("n_chars").alias("size"), F.when(F.col("lang") == "de", F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("mtime"),
                      F.when(F.col("lang") == "es", "").otherwise(F.sha2("text", 256)).alias("sha256"), "lang").filter("lang <> 'fr'").drop("lang")
    return reconcile.reuse_digests(docs.select(path, F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime")), old)


ACT = q.with_(q.ARTICLES) + r""",
ev AS (SELECT event_id AS seq, ts, user_id, event_type AS kind, CAST(regexp_extract(props, '"k": ?(\d+)', 1) AS BIGINT) AS doc_id FROM events),
act AS (SELECT seq, ts, user_id, kind, a.* FROM ev JOIN (SELECT id, url, title, topic, subtopic, doc_id FROM articles) a USING (doc_id)),
base AS (SELECT id, url, title, topic, subtopic FROM articles WHERE source = 'auto'),
del AS (SELECT id, max(seq) AS s FROM act WHERE kind = 'error' GROUP BY id),
af AS (SELECT act.* FROM act LEFT JOIN del USING (id) WHERE s IS NULL OR seq > s),
ad AS (SELECT id, min(seq) AS s FROM af WHERE kind = 'signup' GROUP BY id),
ids AS (SELECT id, CASE WHEN id IN (SELECT id FROM base) AND id NOT IN (SELECT id FROM del) THEN -1 ELSE (SELECT s FROM ad WHERE ad.id = x.id) END AS since FROM (SELECT id FROM base UNION SELECT id FROM act) x),
lv AS (SELECT af.* FROM af JOIN ids USING (id) WHERE since IS NOT NULL AND seq >= since)
SELECT ids.id, a.url, a.title, a.topic, coalesce((SELECT 'moved-' || CAST(arg_max(user_id, seq) AS VARCHAR) FROM lv WHERE lv.id = ids.id AND kind = 'click'), a.subtopic) AS subtopic,
  (SELECT arg_max(ts, seq) FROM lv WHERE lv.id = ids.id AND kind = 'view') AS read_at, (SELECT arg_max(user_id, seq) FROM lv WHERE lv.id = ids.id AND kind = 'purchase') AS notes_count
FROM ids JOIN articles a ON a.id = ids.id WHERE since IS NOT NULL"""


@query("apply_actions", ACT)
def _(spark, d):
    a = b.articles(spark, d)
    e = b.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type", F.regexp_extract("props", r'"k": ?(\d+)', 1).cast("bigint").alias("doc_id"))
    kind = F.col("event_type")
    rows = e.join(a.select("doc_id", "id", "url", "title", "topic", F.col("subtopic").alias("own")), "doc_id")
    log = rows.select(
        "seq", "id",
        F.when(kind == "signup", "add").when(kind == "click", "move").when(kind == "view", "read").when(kind == "purchase", "notes").otherwise("delete").alias("kind"),
        "url", "title", "topic", F.when(kind == "click", F.concat(F.lit("moved-"), F.col("user_id").cast("string"))).otherwise(F.col("own")).alias("subtopic"),
        "ts", F.col("user_id").alias("notes_count"))
    base = a.filter("source = 'auto'").select("id", "url", "title", "topic", "subtopic", F.lit(None).cast("timestamp").alias("read_at"),
                                              F.lit(None).cast("bigint").alias("notes_count"))
    return reconcile.apply_actions(base, log)
