"""Queries that exercise the column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring, text, urls
from . import bindings as b
from . import sqlparts as q
from .registry import query

DOCW = q.words("text")


@query("words", f"SELECT token, count(*) AS n FROM (SELECT unnest({DOCW}) AS token FROM documents) GROUP BY token")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select(F.explode(text.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("words_full_unicode", f"SELECT token, count(*) AS n FROM (SELECT unnest({DOCW}) AS token FROM documents) GROUP BY token")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select(F.explode(text.words("text")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("stem", f"""SELECT token, {q.stem('token')} AS stem
FROM (SELECT DISTINCT unnest({DOCW}) AS token FROM documents)""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    tokens = docs.select(F.explode(text.words("text")).alias("token")).distinct()
    return tokens.select("token", text.stem("token").alias("stem"))


@query("match_level", f"""
WITH w AS (SELECT {DOCW} AS w FROM documents),
pairs AS (SELECT DISTINCT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM w)),
s AS (SELECT a, b, {q.stem('a')} AS sa, {q.stem('b')} AS sb,
             CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short,
             CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM pairs)
SELECT a, b, CAST(CASE WHEN a = b THEN 2 WHEN sa = sb THEN 1
  WHEN starts_with(long, short) AND (strlen(short) <> length(short)
       OR (length(short) >= 5 AND length(long) - length(short) <= 2)) THEN 1 ELSE 0 END AS INTEGER) AS level
FROM s""")
def _(spark, d):
    docs = b.table(spark, d, "documents").withColumn("w", text.words("text"))
    pair = F.transform(
        F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))),
        lambda x, i: F.struct(x.alias("a"), F.get(F.col("w"), i + 1).alias("b")),
    )
    pairs = docs.select(F.explode(pair).alias("p")).select("p.a", "p.b").distinct()
    return pairs.select("a", "b", text.match_level("a", "b").alias("level"))


@query("stopword_flags", f"""SELECT token, token IN {q.STOP} AS small_word, token IN {q.GENERIC} AS generic_label,
count(*) AS n FROM (SELECT unnest({DOCW}) AS token FROM documents) GROUP BY ALL""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    return (
        docs.select(F.explode(text.words("text")).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n"))
        .select("token", F.col("token").isin(fixed.STOPWORDS).alias("small_word"),
                F.col("token").isin(fixed.GENERIC_LABELS).alias("generic_label"), "n")
    )


def slug_urls(spark, d):
    """Post URLs with a slug and a hex id, made from the document titles."""
    a = b.articles(spark, d)
    hexes = F.substring(F.sha1("url"), 1, 10)
    return a.select(
        "doc_id", "title", "id",
        F.concat(
            F.when(F.col("doc_id") % 3 == 0, F.lit("https://medium.com/@"))
            .when(F.col("doc_id") % 3 == 1, F.lit("https://medium.com/p/"))
            .otherwise(F.concat(F.lit("https://"), F.col("author"), F.lit(".example.org/"))),
            F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("author"), F.lit("/"))).otherwise(F.lit("")),
            text.slug("title"), F.lit("-"),
            F.when(F.col("doc_id") % 2 == 0, hexes).otherwise(F.upper(hexes)),
        ).alias("url"),
    )


def slug_sql(x):
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '-')"


SLUGS = q.with_(q.ARTICLES, f"""
slugs AS (
  SELECT doc_id, title, id,
    CASE doc_id % 3 WHEN 0 THEN 'https://medium.com/@' || author || '/' WHEN 1 THEN 'https://medium.com/p/'
                    ELSE 'https://' || author || '.example.org/' END
    || {slug_sql('title')} || '-'
    || CASE WHEN doc_id % 2 = 0 THEN left(sha1(url), 10) ELSE upper(left(sha1(url), 10)) END AS url
  FROM articles),
last AS (SELECT *, regexp_extract(url, '([^/]*)$', 1) AS seg FROM slugs)""")
CAP = "upper(left({0}, 1)) || lower({0}[2:])"


@query("slug_title", SLUGS + """
SELECT doc_id, upper(left(t, 1)) || t[2:] AS title,
  CASE WHEN NOT starts_with(url, 'https://medium.com/') THEN regexp_extract(url, '^https://([^.]*)', 1)
       WHEN starts_with(url, 'https://medium.com/p/') THEN '' ELSE regexp_extract(url, 'com/([^/]*)', 1) END AS author
FROM (SELECT *, trim(replace(regexp_replace(seg, '-?[0-9a-f]{8,12}$', ''), '-', ' ')) AS t FROM last)""")
def _(spark, d):
    return slug_urls(spark, d).select(
        "doc_id", urls.slug_title("url").alias("title"), urls.author_of("url").alias("author"))


@query("guess_title", SLUGS + f"""
SELECT doc_id, CASE WHEN t = '' THEN url ELSE {CAP.format('t')} END AS title
FROM (SELECT *, trim(replace(regexp_replace(seg, '-[0-9a-f]{{8,14}}$', ''), '-', ' ')) AS t FROM last)""")
def _(spark, d):
    return slug_urls(spark, d).select("doc_id", urls.guess_title("url").alias("title"))


@query("title_from_url", SLUGS + f"""
SELECT doc_id, {CAP.format('t')} AS title
FROM (SELECT *, trim(regexp_replace(replace(regexp_replace(seg, '(?i)-?[0-9a-f]{{8,14}}$', ''), '-', ' '),
             '\\s+', ' ', 'g')) AS t FROM last)""")
def _(spark, d):
    return slug_urls(spark, d).select("doc_id", urls.title_from_url("url").alias("title"))


def odd_urls(spark, d):
    """Page URLs in the forms people paste: bare, without scheme, wrong scheme, credentials and capitals."""
    p = b.table(spark, d, "pages")
    bare = F.regexp_replace("url", "^https?://", "")
    k = F.col("page_id") % 5
    return p.select(
        "page_id",
        F.when(k == 0, F.col("url")).when(k == 1, bare)
        .when(k == 2, F.concat(F.lit("ftp://"), bare))
        .when(k == 3, F.concat(F.lit(" HTTPS://me:secret@"), F.upper(bare), F.lit("/ ")))
        .otherwise(F.lit("not a link")).alias("raw"),
        "url",
    )


ODD = """
WITH odd AS (
  SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '')
    WHEN 2 THEN 'ftp://' || regexp_replace(url, '^https?://', '')
    WHEN 3 THEN ' HTTPS://me:secret@' || upper(regexp_replace(url, '^https?://', '')) || '/ '
    ELSE 'not a link' END AS raw FROM pages),
f AS (SELECT page_id, CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN trim(raw)
    WHEN NOT regexp_matches(trim(raw), '(?i)^[a-z][a-z0-9+.-]*:') THEN 'https://' || trim(raw) END AS u FROM odd),
p AS (SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme,
    regexp_extract(regexp_extract(u, '^[A-Za-z]+://([^/?#]*)', 1), '([^@]*)$', 1) AS host,
    rtrim(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS path FROM f)
"""


@query("normalize_url", ODD + """
SELECT page_id, CASE WHEN contains(host, '.') AND regexp_full_match(regexp_replace(host, ':[^:]*$', ''), '(?i)[a-z0-9.-]+')
  THEN scheme || '://' || lower(host) || path END AS clean FROM p""")
def _(spark, d):
    return odd_urls(spark, d).select("page_id", urls.normalize_url("raw").alias("clean"))


@query("canonical_url", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS s, regexp_extract(url, '^https?://([^/?#]*)', 1) AS h,
  rtrim(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/') AS path FROM pages)
SELECT page_id, CASE WHEN s <> '' AND contains(h, '.') THEN s || '://' || lower(h) || path END AS clean FROM p""")
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", urls.canonical("url").alias("clean"))


@query("article_ids", """SELECT page_id, left(sha1(url), 12) AS article_id,
left(sha256(lower('10.5555/' || url)), 16) AS paper_id FROM pages""")
def _(spark, d):
    return b.table(spark, d, "pages").select(
        "page_id", urls.article_id("url").alias("article_id"),
        urls.paper_id(F.concat(F.lit("10.5555/"), "url")).alias("paper_id"))


@query("slugify", q.with_(q.ARTICLES) + f"""
SELECT doc_id, {slug_sql('title')} AS slug,
  coalesce(nullif(rtrim(left({slug_sql('snippet')}, 70), '-'), ''), 'untitled') AS file_slug FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", text.slug("title").alias("slug"), text.slugify("snippet").alias("file_slug"))


@query("label_norm", q.with_(q.ARTICLES) + "SELECT doc_id, replace(lower(trim(title)), ' ', '-') AS label FROM articles")
def _(spark, d):
    return b.articles(spark, d).select("doc_id", text.label("title").alias("label"))


@query("freshness", q.with_(q.ARTICLES) + f"""
SELECT doc_id, round({q.fresh('published', 240.0)}, 4) AS search_fresh, round({q.fresh('added', 150.0)}, 4) AS profile_fresh,
  round({q.fresh('locked_checked', 150.0)}, 4) AS maybe_fresh FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", F.round(scoring.freshness("published", b.AS_OF), 4).alias("search_fresh"),
        F.round(scoring.freshness("added", b.AS_OF, fixed.PROFILE_HALF_LIFE), 4).alias("profile_fresh"),
        F.round(scoring.freshness("locked_checked", b.AS_OF, fixed.PROFILE_HALF_LIFE), 4).alias("maybe_fresh"))


@query("trend_score", q.with_(q.ARTICLES) + f"""
SELECT doc_id, round({q.trend('claps', 'published')}, 4) AS trend, round({q.trend('claps', 'locked_checked')}, 4) AS other
FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", F.round(scoring.trend_score("claps", "published", b.AS_OF), 4).alias("trend"),
        F.round(scoring.trend_score("claps", "locked_checked", b.AS_OF), 4).alias("other"))


@query("clamp", q.with_(q.ARTICLES) + f"""
SELECT doc_id, round({q.clamp('(prio - 0.1) / 0.9')}, 4) AS share, round({q.clamp('claps / 3000.0')}, 3) AS size_share,
  round(claps / 7.0, 2) AS two FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", F.round(scoring.priority_share("prio"), 4).alias("share"),
        F.round(scoring.clamp(F.col("claps") / 3000.0), 3).alias("size_share"), F.round(F.col("claps") / 7.0, 2).alias("two"))


@query("relative_day", rf"""
WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CAST(n_chars % 400 AS VARCHAR) || 'd' WHEN 1 THEN CAST(n_chars % 60 AS VARCHAR) || 'w'
  WHEN 2 THEN CAST(n_chars % 24 AS VARCHAR) || 'M' WHEN 3 THEN CAST(n_chars % 9 AS VARCHAR) || ' y'
  WHEN 4 THEN '2023-0' || CAST(1 + n_chars % 9 AS VARCHAR) ELSE left(text, 5) END AS span FROM documents)
SELECT doc_id, span, CASE doc_id % 6
  WHEN 0 THEN CAST({q.DAY} - CAST(regexp_extract(span, '\d+') AS INTEGER) AS DATE)
  WHEN 1 THEN CAST({q.DAY} - 7 * CAST(regexp_extract(span, '\d+') AS INTEGER) AS DATE)
  WHEN 2 THEN CAST({q.DAY} - 30 * CAST(regexp_extract(span, '\d+') AS INTEGER) AS DATE)
  WHEN 3 THEN CAST({q.DAY} - 365 * CAST(regexp_extract(span, '\d+') AS INTEGER) AS DATE)
  WHEN 4 THEN CAST(span || '-01' AS DATE) END AS day FROM t""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    n, k = F.col("n_chars"), F.col("doc_id") % 6

    def s(c):
        return c.cast("string")

    span = (
        F.when(k == 0, F.concat(s(n % 400), F.lit("d"))).when(k == 1, F.concat(s(n % 60), F.lit("w")))
        .when(k == 2, F.concat(s(n % 24), F.lit("M"))).when(k == 3, F.concat(s(n % 9), F.lit(" y")))
        .when(k == 4, F.concat(F.lit("2023-0"), s(n % 9 + 1))).otherwise(F.substring("text", 1, 5))
    )
    return docs.select("doc_id", span.alias("span")).withColumn("day", scoring.relative_day("span", b.AS_OF))


@query("headline_words", q.with_(q.NEWS) + f"SELECT item_id, array_to_string(list_sort({q.headline_words('title')}), ' ') AS found FROM news")
def _(spark, d):
    return b.news_items(spark, d).select("item_id", F.array_join(F.array_sort(text.headline_words("title")), " ").alias("found"))


@query("jaccard", f"""
WITH w AS (SELECT doc_id, {q.headline_words(q.title_of('text'))} AS a, {q.headline_words('text')} AS b FROM documents)
SELECT doc_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 4) AS similarity FROM w""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select(
        "doc_id",
        F.round(text.jaccard(text.headline_words(b.title_of(F.col("text"))), text.headline_words("text")), 4)
        .alias("similarity"))


@query("map_cosine", f"""
WITH t AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest({q.words(q.title_of('text'))}) AS k FROM documents) GROUP BY ALL),
f AS (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest({DOCW}) AS k FROM documents) GROUP BY ALL),
tn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM t GROUP BY doc_id),
fn AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM f GROUP BY doc_id),
dot AS (SELECT doc_id, sum(t.n * f.n) AS dot FROM t JOIN f USING (doc_id, k) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(dot / (tn.norm * fn.norm), 0.0), 4) AS similarity
FROM documents d LEFT JOIN dot USING (doc_id) LEFT JOIN tn USING (doc_id) LEFT JOIN fn USING (doc_id)""")
def _(spark, d):
    docs = b.table(spark, d, "documents")

    def counts(c):
        # one map per document, bounded by its own distinct words
        w = docs.select("doc_id", F.explode_outer(text.words(c)).alias("k")).groupBy("doc_id", "k").count()
        entry = F.when(F.col("k").isNotNull(), F.struct("k", F.col("count").cast("double")))
        return w.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))

    a = counts(b.title_of(F.col("text"))).withColumnRenamed("m", "a")
    full = counts(F.col("text")).withColumnRenamed("m", "b")
    return a.join(full, "doc_id").select("doc_id", F.round(scoring.map_cosine("a", "b"), 4).alias("similarity"))


@query("doi", """SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN '10.' || CAST(1000 + doc_id AS VARCHAR) || '/' || lower(source) || '.' || CAST(n_chars AS VARCHAR) END AS doi FROM documents""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    core = F.concat(F.lit("10."), (F.col("doc_id") + 1000).cast("string"), F.lit("/"), F.upper("source"), F.lit("."),
                    F.col("n_chars").cast("string"))
    k = F.col("doc_id") % 5
    raw = (
        F.when(k == 0, F.lit("no identifier 10.12/x")).when(k == 1, core)
        .when(k == 2, F.concat(F.lit("https://doi.org/"), core, F.lit(").")))
        .when(k == 3, F.concat(F.lit(" doi:"), core, F.lit(",")))
        .otherwise(F.concat(F.lit("see <"), core, F.lit("> there")))
    )
    return docs.select("doc_id", urls.normalize_doi(raw).alias("doi"))


PLAIN = f"SELECT page_id, {q.clean(chr(39).join(['regexp_replace(html, ', '<[^>]+>', ', ', ' ', ', ', 'g', ')']))} AS plain FROM pages"


@query("clean_markup", PLAIN)
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.strip_jats("html").alias("plain"))


@query("clean_markup_full_entities", PLAIN)
def _(spark, d):
    return b.table(spark, d, "pages").select("page_id", text.strip_jats("html").alias("plain"))


def redirect_urls(spark, d):
    p = b.table(spark, d, "pages")
    blob = F.concat(F.encode(F.concat(F.lit("\x08\x13\x22"), "url", F.lit("\x01 tail")), "UTF-8"))
    seg = F.rtrim(F.translate(F.replace(F.base64(blob), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))
    k = F.col("page_id") % 3
    return p.select(
        "page_id", "url",
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("https://news.google.com/rss/articles/"), seg, F.lit("?oc=5")))
        .otherwise(F.lit("https://news.google.com/rss/articles/abc")).alias("link"),
    )


@query("redirect_url", """SELECT page_id, CASE WHEN page_id % 3 = 2 THEN 'https://news.google.com/rss/articles/abc' ELSE url END AS resolved FROM pages""")
def _(spark, d):
    return redirect_urls(spark, d).select("page_id", urls.resolve_redirect("link").alias("resolved"))


@query("hardened_casts", """
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars WHEN 1 THEN CAST(round_even(n_chars / 4.0, 0) AS BIGINT) ELSE 0 END AS whole,
  CASE WHEN doc_id % 4 = 0 THEN to_timestamp(n_chars * 100000) AT TIME ZONE 'UTC' END AS moment FROM documents""")
def _(spark, d):
    docs = b.table(spark, d, "documents")
    n, k = F.col("n_chars"), F.col("doc_id") % 5
    raw = (
        F.when(k == 0, n.cast("string")).when(k == 1, (n / 4.0).cast("string")).when(k == 2, F.lit("Infinity"))
        .when(k == 3, F.lit("many")).otherwise(F.lit("9e300"))
    )
    j = F.col("doc_id") % 4
    ms = (F.when(j == 0, (n * 100_000_000).cast("string")).when(j == 1, (-n).cast("string"))
          .when(j == 2, F.lit("NaN")).otherwise(F.lit("1e18")))
    return docs.select("doc_id", scoring.whole(raw).alias("whole"), scoring.moment(ms).alias("moment"))


@query("same_text", q.with_(q.ARTICLES) + r"""
SELECT doc_id, regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g') AS squashed,
  regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g') <> '' AS same_shouted,
  regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g') <> '' AND
  regexp_replace(lower(title), '[^\p{L}\p{N}_]+', '', 'g') = regexp_replace(lower(snippet), '[^\p{L}\p{N}_]+', '', 'g') AS same_snippet
FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", text.squash("title").alias("squashed"),
        text.same_text("title", F.concat(F.lower("title"), F.lit(" !"))).alias("same_shouted"),
        text.same_text("title", "snippet").alias("same_snippet"))


@query("display_helpers", SLUGS + """
SELECT doc_id, CASE WHEN starts_with(url, 'https://medium.com/') THEN regexp_extract(url, '//(medium.com/[^/]*)', 1)
  ELSE regexp_extract(url, '//([^/]*)', 1) END AS host,
  CASE WHEN c >= 1000000 THEN format('{:.1f}M', floor(c / 1e5 + 0.5) / 10) WHEN c >= 10000 THEN CAST(CAST(floor(c / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || 'k'
       ELSE format('{:,}', c) END AS shown
FROM slugs JOIN (SELECT doc_id, claps * CASE WHEN doc_id % 3 = 0 THEN 1 WHEN doc_id % 3 = 1 THEN 10 ELSE 1000 END AS c FROM articles) USING (doc_id)""")
def _(spark, d):
    a = b.articles(spark, d).select(
        "doc_id", (F.col("claps") * F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 10).otherwise(1000)).alias("c"))
    return slug_urls(spark, d).join(a, "doc_id").select(
        "doc_id", urls.source_of("url").alias("host"), text.display_count("c").alias("shown"))


@query("filter_echo", q.with_(q.QUERIES) + """
SELECT query_id, concat_ws('; ',
  CASE WHEN len(phrases) > 0 THEN 'exactly ' || array_to_string([chr(34) || array_to_string(p, ' ') || chr(34) for p in phrases], ' and ') END,
  CASE WHEN author IS NOT NULL THEN 'by ' || author END, CASE WHEN since IS NOT NULL THEN 'since ' || CAST(since AS VARCHAR) END,
  CASE WHEN before IS NOT NULL THEN 'before ' || CAST(before AS VARCHAR) END,
  CASE WHEN len(exclude) > 0 THEN 'without ' || array_to_string(exclude, ', ') END) AS parsed FROM queries""")
def _(spark, d):
    return b.queries(spark, d).select(
        "query_id", text.filter_echo("phrases", "author", "since", "before", "exclude").alias("parsed"))


@query("paper_byline", q.with_(q.ARTICLES) + """
SELECT doc_id, CASE WHEN len(a) = 0 THEN '' WHEN len(a) <= 3 THEN array_to_string(a, ', ')
   ELSE array_to_string(a[1:3], ', ') || ' +' || CAST(len(a) - 3 AS VARCHAR) END AS byline,
  concat_ws(' · ', author, CAST(year(published) AS VARCHAR)) AS venue FROM (SELECT *, list_sort(tags) AS a FROM articles)""")
def _(spark, d):
    return b.articles(spark, d).select(
        "doc_id", text.byline(F.array_sort("tags")).alias("byline"),
        text.venue_line("author", F.year("published")).alias("venue"))


@query("english_slug", q.with_(q.ARTICLES) + rf"""
SELECT doc_id, title FROM articles WHERE regexp_matches(lower(title), '\b({"|".join(fixed.ENGLISH_WORDS)})\b')
  AND NOT regexp_matches(title, '[^\x00-\x7f]')""")
def _(spark, d):
    return b.articles(spark, d).filter(text.is_english_slug("title") & text.is_ascii("title")).select("doc_id", "title")


@query("headline_signature", q.with_(q.ARTICLES) + f"""
SELECT doc_id, CASE WHEN key <> '' THEN key ELSE lower(trim(title)) END AS signature
FROM (SELECT doc_id, title, array_to_string(list_sort(list_distinct([{q.stem('w')} for w in {q.words('title')} if w NOT IN {q.STOP}])), ' ') AS key FROM articles)""")
def _(spark, d):
    return b.articles(spark, d).select("doc_id", text.headline_signature("title").alias("signature"))
