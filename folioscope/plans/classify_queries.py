"""Bulk classification, key sentences and quote anchoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import classify, ranking, textjobs
from ..session import stage
from . import bindings as b
from . import sqlparts as q
from .registry import query

ALIAS = """,
wn AS (SELECT topic, subtopic, tag, row_number() OVER (PARTITION BY topic, subtopic ORDER BY n DESC, tag) AS r
       FROM (SELECT topic, subtopic, tag, count(*) AS n FROM (SELECT topic, subtopic, unnest(tags) AS tag FROM articles) GROUP BY ALL)),
bg0 AS (SELECT topic, subtopic, w, unnest(range(1, len(w))) AS i FROM (SELECT topic, subtopic, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM articles)),
bg AS (SELECT topic, subtopic, phrase, row_number() OVER (PARTITION BY topic, subtopic ORDER BY n DESC, phrase) AS r
       FROM (SELECT topic, subtopic, w[i] || ' ' || w[i + 1] AS phrase, count(*) AS n FROM bg0 GROUP BY ALL)),"""
RULES = q.with_(q.ARTICLES, q.TREE) + ALIAS + f"""
allr AS (
  SELECT 0 AS tier, topic, subtopic, array_to_string(regexp_extract_all(p, '[a-z0-9]+'), ' ') AS phrase FROM (SELECT topic, subtopic, trim(lower(replace(unnest(tags), '-', ' '))) AS p FROM tree)
   WHERE length(p) >= 3 AND p NOT IN {q.inlist(fixed.BROAD_PHRASES)}
  UNION SELECT 1, topic, subtopic, phrase FROM bg SEMI JOIN tree USING (topic, subtopic) WHERE r <= 3
  UNION SELECT 2, topic, subtopic, array_to_string(regexp_extract_all(lower(tag), '[a-z0-9]+'), ' ') FROM wn SEMI JOIN tree USING (topic, subtopic) WHERE r BETWEEN 6 AND 15),
rk AS (SELECT *, len(string_split(phrase, ' ')) AS n FROM allr WHERE phrase <> ''),
rules AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY n DESC, length(phrase) DESC, phrase, topic, subtopic) - 1 AS rank FROM rk)
          QUALIFY row_number() OVER (PARTITION BY tier, phrase ORDER BY rank) = 1)"""


def alias_tables(spark, d):
    """Second and third tier phrases from the data: frequent title word pairs, and less frequent title words."""
    a = b.articles(spark, d)
    words = a.select("topic", "subtopic", F.explode("tags").alias("phrase")).groupBy("topic", "subtopic", "phrase").agg(F.count("*").alias("n"))
    words = ranking.top_per_key(words, ["topic", "subtopic"], [F.desc("n"), F.asc("phrase")], 15).filter("rank between 6 and 15")
    w = F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0))
    pair = F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get("w", i + 1)))
    pairs = a.withColumn("w", w).select("topic", "subtopic", F.explode(pair).alias("phrase"))
    pairs = pairs.groupBy("topic", "subtopic", "phrase").agg(F.count("*").alias("n"))
    pairs = ranking.top_per_key(pairs, ["topic", "subtopic"], [F.desc("n"), F.asc("phrase")], 3)

    def table(df):
        return df.select("topic", "subtopic", F.array("phrase").alias("phrases"))

    return table(pairs), table(words)


_RULES: dict[tuple, object] = {}


def rules(spark, d):
    """The rule table, written once: it is a dimension that several jobs read."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _RULES:
        related, expanded = alias_tables(spark, d)
        _RULES[key] = stage(classify.build_rules(b.topic_tree(spark, d), related, expanded), "rules")
    return _RULES[key]


@query("build_rules", RULES + "SELECT tier, rank, phrase, n, topic, subtopic FROM rules")
def _(spark, d):
    related, expanded = alias_tables(spark, d)
    r = classify.build_rules(b.topic_tree(spark, d), related, expanded)
    return r.select("tier", F.col("rank").cast("bigint").alias("rank"), "phrase", F.col("n").cast("bigint").alias("n"), "topic", "subtopic")


POSTS = """,
lk AS (SELECT a.doc_id AS post_id, a.url, a.id, a.title, a.prio, a.published AS day FROM articles a WHERE source IS DISTINCT FROM 'auto'
       AND url NOT IN (SELECT url FROM articles WHERE source = 'auto')),
mt AS (SELECT post_id, tier, topic, subtopic FROM (
  SELECT l.post_id, r.*, row_number() OVER (PARTITION BY post_id ORDER BY tier, n DESC, rank) AS best FROM
    (SELECT post_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT post_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w FROM lk WHERE len(string_split(trim(title), ' ')) >= 4)) l
    JOIN rules r ON array_to_string(w[i:i + r.n - 1], ' ') = r.phrase) WHERE best = 1),
cl AS (SELECT lk.*, mt.tier, mt.topic, mt.subtopic, CASE tier WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level FROM lk LEFT JOIN mt USING (post_id))"""


def links(spark, d):
    a = b.articles(spark, d)
    posts = a.filter("source is distinct from 'auto'").select(F.col("doc_id").alias("post_id"), "url", "title", "prio", F.col("published").alias("day"))
    return classify.new_links(posts, a.filter("source = 'auto'"))


def classified(spark, d):
    return classify.classified_links(links(spark, d), rules(spark, d))


@query("phrase_rule_match", RULES + POSTS + """SELECT l.post_id, r.tier, r.phrase, r.rank FROM
 (SELECT DISTINCT post_id, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT post_id, w, n, unnest(range(1, len(w) + 2 - n)) AS i FROM
    (SELECT post_id, regexp_extract_all(lower(title), '[a-z0-9]+') AS w, unnest((SELECT list(DISTINCT n) FROM rules)) AS n FROM lk))) l JOIN rules r USING (phrase)""")
def _(spark, d):
    found = stage(rules(spark, d), "rules")
    lengths = classify.phrase_lengths(found, F.split("phrase", " "))
    grams = links(spark, d).select(
        "post_id", F.explode(classify.ngrams(F.regexp_extract_all(F.lower("title"), F.lit("[a-z0-9]+"), F.lit(0)), lengths)).alias("phrase"))
    return grams.join(found, "phrase").select("post_id", "tier", "phrase", F.col("rank").cast("bigint").alias("rank"))


@query("classify_titles", RULES + POSTS + "SELECT post_id, level, topic, subtopic FROM cl")
def _(spark, d):
    return classified(spark, d).select("post_id", "level", "topic", "subtopic")


FILLED = RULES + POSTS + """,
ask AS (SELECT (SELECT count(*) FROM cl WHERE topic IS NOT NULL) + (SELECT count(*) FROM cl WHERE topic IS NULL) // 2 AS n),
filled AS (SELECT post_id, level, topic, subtopic, prio, day, url, title, id FROM cl WHERE topic IS NOT NULL UNION ALL
  SELECT post_id, level, 'general-reading', 'unsorted', prio, day, url, title, id FROM (
    SELECT *, row_number() OVER (ORDER BY prio DESC, day DESC, post_id DESC) AS r FROM cl WHERE topic IS NULL)
  WHERE r <= (SELECT count(*) FROM cl WHERE topic IS NULL) // 2)"""


def filled(spark, d):
    rows = stage(classified(spark, d), "classified")
    n = rows.agg(F.count("topic"), F.count_if(F.col("topic").isNull())).first()
    return classify.catch_all_fill(rows, n[0] + n[1] // 2)


@query("catch_all_fill", FILLED + "SELECT post_id, topic, subtopic FROM filled")
def _(spark, d):
    return filled(spark, d).select("post_id", "topic", "subtopic")


SHARED = FILLED + """,
half AS (SELECT count(*) // 2 AS n, (count(*) // 2) // count(DISTINCT topic || '/' || subtopic) AS share FROM filled),
rr AS (SELECT *, row_number() OVER (PARTITION BY topic, subtopic ORDER BY level DESC, prio DESC, day DESC, url DESC, title DESC, id DESC) AS r FROM filled),
a1 AS (SELECT * FROM rr WHERE r <= (SELECT share FROM half)),
chosen AS (SELECT *, 'share' AS phase FROM a1 UNION ALL
  SELECT * EXCLUDE (g), 'fill' FROM (SELECT *, row_number() OVER (ORDER BY level DESC, prio DESC, day DESC, url DESC, title DESC, id DESC) AS g
    FROM rr WHERE r > (SELECT share FROM half)) WHERE g <= (SELECT n FROM half) - (SELECT count(*) FROM a1))"""


def chosen(spark, d):
    rows = stage(filled(spark, d), "filled")
    return classify.fair_share_select(rows, rows.count() // 2)


@query("fair_share", SHARED + "SELECT post_id, topic, subtopic, phase FROM chosen")
def _(spark, d):
    return chosen(spark, d).select("post_id", "topic", "subtopic", "phase")


@query("bulk_report", SHARED + """SELECT count(*) AS links, count(DISTINCT topic || '/' || subtopic) AS subtopics, count(*) FILTER (level = 2) AS exact,
count(*) FILTER (level = 1) AS related, count(*) FILTER (level = 0) AS broader, count(*) FILTER (topic = 'general-reading') AS unsorted FROM chosen""")
def _(spark, d):
    return classify.bulk_report(chosen(spark, d))


# ---------------------------------------------------------------- key sentences

SENT = f"""
WITH s0 AS (SELECT doc_id, [trim(x) for x in regexp_extract_all(regexp_replace(text, '\\s+', ' ', 'g'), '[^.!?]+[.!?]+')] AS a FROM documents),
s1 AS (SELECT doc_id, [x for x in a if length(x) > 50 AND length(x) < 400 AND NOT regexp_matches(x, '[{{}};=]{{2}}')] AS a FROM s0),
s AS (SELECT doc_id, len(a) AS n, unnest(a) AS sentence, generate_subscripts(a, 1) - 1 AS i FROM s1),
w AS (SELECT doc_id, i, word FROM (SELECT doc_id, i, unnest(regexp_extract_all(lower(sentence), '[a-z][a-z''-]{{2,}}')) AS word FROM s)
      WHERE word NOT IN {q.inlist(fixed.SUMMARY_STOPWORDS)}),
f AS (SELECT doc_id, word, count(DISTINCT i) AS df FROM w GROUP BY ALL)"""


@query("key_sentence_df", SENT + "SELECT doc_id, word, df FROM f")
def _(spark, d):
    return textjobs.sentence_frequencies(b.table(spark, d, "documents"))


@query("key_sentences", SENT + """,
sc AS (SELECT s.doc_id, s.i, s.n, s.sentence, round(coalesce(p.total, 0) / sqrt(coalesce(p.len, 0) + 1) * CASE WHEN s.i < 3 THEN 1.2 ELSE 1 END, 6) AS score
  FROM s LEFT JOIN (SELECT doc_id, i, count(*) AS len, sum(CASE WHEN df > 1 THEN ln(1 + df) ELSE 0 END) AS total FROM w JOIN f USING (doc_id, word) GROUP BY ALL) p USING (doc_id, i)
  WHERE n >= 3)
SELECT doc_id, i, sentence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS r FROM sc)
WHERE r <= least(7, greatest(3, floor(n / 12.0 + 0.5)))""")
def _(spark, d):
    return textjobs.key_sentences(b.table(spark, d, "documents"))


@query("key_sentences_conversations")
def _(spark, d):
    c = b.table(spark, d, "conversations").select(
        (F.col("conv_id") * 100_000 + F.col("turn")).alias("doc_id"), "text")
    return textjobs.key_sentences(c)


# ---------------------------------------------------------------- quotes


def quotes(spark, d):
    return b.table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))


@query("contained_quotes", "SELECT item_id AS quote_id, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text)")
def _(spark, d):
    return textjobs.contained_quotes(quotes(spark, d), b.table(spark, d, "documents"))


def saved_quotes(spark, d):
    """Notes' highlights as saved quotes: the first lines of a text, remembered at a place that has since moved."""
    n = b.notes(spark, d).select("doc_id", "article_id", F.posexplode("highlights").alias("k", "h"))
    return n.select(
        F.concat_ws("#", "article_id", F.col("k").cast("string")).alias("quote_id"), "doc_id", F.col("h.quote").alias("quote"),
        F.col("h.start").cast("int").alias("start"), F.lit("\n").alias("prefix"), F.lit("\n").alias("suffix"))


@query("anchor_quotes", q.with_(q.NOTES) + """
, hq AS (SELECT article_id || '#' || CAST(k - 1 AS VARCHAR) AS quote_id, doc_id, highlights[k].quote AS quote, highlights[k].start AS st FROM (SELECT *, unnest(range(1, len(highlights) + 1)) AS k FROM notes)),
t AS (SELECT hq.*, text, length(quote) AS n FROM hq JOIN documents USING (doc_id)),
occ AS (SELECT quote_id, at_, CASE WHEN at_ = st THEN 100 ELSE (CASE WHEN at_ > 0 AND substr(text, at_, 1) = chr(10) THEN 2 ELSE 0 END) + (CASE WHEN substr(text, at_ + n + 1, 1) = chr(10) THEN 1 ELSE 0 END) - abs(at_ - st) / 1e7 END AS score
  FROM (SELECT *, unnest(range(0, length(text) - n + 1)) AS at_ FROM t WHERE n > 0) WHERE substr(text, at_ + 1, n) = quote),
best AS (SELECT quote_id, at_ FROM occ QUALIFY row_number() OVER (PARTITION BY quote_id ORDER BY score DESC, at_) = 1)
SELECT quote_id, doc_id, at_ AS start, at_ + n AS "end", at_ IS NULL AS orphan FROM t LEFT JOIN best USING (quote_id)""")
def _(spark, d):
    return textjobs.anchor_quotes(saved_quotes(spark, d), b.table(spark, d, "documents")).select(
        "quote_id", "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "orphan")
