"""Interest profiles and recommendations for every reader in the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..operators import ranking, recommend, taste, topics
from ..session import stage
from . import bindings as b
from . import sqlparts as q
from .registry import query

ENG = q.with_(q.ARTICLES, q.ENGAGEMENT, q.TREE, f"""
eng AS (SELECT reader, doc_id, max(kind = 'purchase') AS has_notes, max(ts) FILTER (kind = 'view') AS read_at,
          max(kind = 'click') AS fetched, max(kind = 'signup') AS saved FROM engagement WHERE kind <> 'error' GROUP BY ALL),
wt AS (SELECT reader, a.doc_id, a.url, a.title, a.author, a.topic, a.subtopic, a.tags, base,
          base * (0.35 + 0.65 * {q.fresh('coalesce(read_at, added)', 150.0)}) AS weight,
          list_distinct(list_append(tags, topic || '/' || subtopic)) AS labels
       FROM (SELECT *, CASE WHEN has_notes THEN 3.0 WHEN read_at IS NOT NULL THEN 1.5 WHEN fetched THEN 1.0 WHEN saved THEN 0.4 ELSE 0 END AS base
             FROM (SELECT * EXCLUDE (fetched) FROM articles) JOIN eng USING (doc_id)) a WHERE base > 0),
act AS (SELECT reader, url, kind, ts FROM engagement JOIN articles USING (doc_id) WHERE kind IN ('error', 'signup')),
dism AS (SELECT reader, url, ts FROM act WHERE true QUALIFY row_number() OVER (PARTITION BY reader, url ORDER BY ts DESC) = 1 AND kind = 'error'),
dis AS (SELECT reader, a.url, a.title, a.tags FROM dism JOIN articles a USING (url)),
readers AS (SELECT reader, CAST(sum(n) AS BIGINT) AS engaged, sum(n) < 8 AS cold FROM (SELECT reader, 1 AS n FROM wt UNION ALL SELECT reader, 0 FROM dis) GROUP BY reader)""")

WORDS_OF = f"[{q.stem('w')} for w in {q.words('title')} if w NOT IN {q.STOP}]"
PROFILE = ENG + f""",
contrib AS (
  SELECT reader, 'label' AS kind, key, weight * CASE WHEN key IN {q.GENERIC} THEN 0.3 ELSE 1.0 END AS weight FROM (SELECT reader, unnest(labels) AS key, weight FROM wt)
  UNION ALL SELECT reader, 'word', unnest({WORDS_OF}), weight FROM wt
  UNION ALL SELECT reader, 'author', author, weight FROM wt WHERE author <> ''
  UNION ALL SELECT reader, 'dislike', unnest(list_distinct(tags)), 1.0 FROM dis
  UNION ALL SELECT reader, 'word', unnest({WORDS_OF}), -0.4 FROM dis
  UNION ALL SELECT reader, 'label', unnest(list_append(tags, topic || '/' || subtopic)), 0.5 FROM readers, tree WHERE cold),
prof AS (SELECT reader, kind, key, sum(weight) AS weight FROM contrib GROUP BY ALL HAVING kind <> 'word' OR sum(weight) > 1e-9)"""


def dismissed(spark, d):
    a = b.articles(spark, d)
    actions = (
        b.engagement(spark, d).filter(F.col("kind").isin("error", "signup"))
        .join(a.select("doc_id", "url"), "doc_id")
        .select("reader", "url", (F.col("kind") == "signup").alias("undo"), "ts", F.col("ts").alias("seq"))
    )
    return taste.apply_dismissals(actions)


def parts(spark, d):
    a = b.articles(spark, d)
    engaged = taste.weighted(taste.engagement_rows(b.engagement(spark, d)), a, b.AS_OF)
    dis = dismissed(spark, d).join(a.select("url", "title", "tags"), "url").select("reader", "url", "title", "tags")
    return engaged, dis


_SMALL: dict[tuple, object] = {}


def small(spark, d, make):
    """The tree, or what else several steps read, written once per session and data folder; ``make`` is the function that makes it."""
    key = (spark.sparkContext.applicationId, d, make.__name__)
    if key not in _SMALL:
        _SMALL[key] = stage(make(spark, d), make.__name__)
    return _SMALL[key]


class Staged:
    """The tables of a profile, each written when it is first asked for."""

    def __init__(self, made: taste.Profile):
        self.made, self.kept = made, {}

    def __getattr__(self, name):
        if name not in ("weights", "examples", "readers"):
            raise AttributeError(name)
        if name not in self.kept:
            self.kept[name] = stage(getattr(self.made, name), name)
        return self.kept[name]


_PROFILES: dict[tuple, Staged] = {}


def profile(spark, d, *, staged: bool = False) -> taste.Profile | Staged:
    key = (spark.sparkContext.applicationId, d)
    if staged and key in _PROFILES:
        return _PROFILES[key]
    engaged, dis = parts(spark, d)
    p = taste.profile(engaged, dis, small(spark, d, b.topic_tree) if staged else b.topic_tree(spark, d))
    if not staged:
        return p
    return _PROFILES.setdefault(key, Staged(p))


@query("engagement_weight", ENG + "SELECT reader, doc_id, CAST(base AS DOUBLE) AS base, round(weight, 4) AS weight FROM wt")
def _(spark, d):
    return parts(spark, d)[0].select("reader", "doc_id", "base", F.round("weight", 4).alias("weight"))


@query("labels_of", q.with_(q.ARTICLES) + """SELECT doc_id, array_to_string(list_sort(list_distinct(list_append(tags, topic || '/' || subtopic))), ' ') AS labels FROM articles""")
def _(spark, d):
    return b.articles(spark, d).select("doc_id", F.array_join(F.array_sort(topics.labels_of()), " ").alias("labels"))


@query("apply_dismissals", ENG + "SELECT reader, url, ts FROM dism")
def _(spark, d):
    return dismissed(spark, d)


@query("taste_profile", PROFILE + "SELECT reader, kind, key, round(weight, 4) AS weight FROM prof")
def _(spark, d):
    return profile(spark, d).weights.select("reader", "kind", "key", F.round("weight", 4).alias("weight"))


@query("taste_readers", PROFILE + "SELECT reader, engaged, cold FROM readers")
def _(spark, d):
    return profile(spark, d).readers


@query("example_article", PROFILE + """SELECT reader, key, title FROM (SELECT reader, unnest(labels) AS key, title, weight, doc_id FROM wt)
QUALIFY row_number() OVER (PARTITION BY reader, key ORDER BY round(weight, 9) DESC, doc_id) = 1""")
def _(spark, d):
    return profile(spark, d).examples


@query("word_profile", PROFILE + """SELECT reader, key, round(weight, 4) AS weight FROM prof WHERE kind = 'word'
QUALIFY row_number() OVER (PARTITION BY reader ORDER BY round(weight, 6) DESC, key) <= 120""")
def _(spark, d):
    return taste.word_profile(profile(spark, d).weights).select("reader", "key", F.round("weight", 4).alias("weight"))


@query("top_labels", PROFILE + f"""
, forty AS (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY round(weight, 6) DESC, key) AS r FROM prof WHERE kind = 'label' QUALIFY r <= 40)
SELECT reader, row_number() OVER (PARTITION BY reader ORDER BY r) AS rank, key FROM forty
WHERE NOT contains(key, '/') AND key NOT IN {q.GENERIC} QUALIFY rank <= 12""")
def _(spark, d):
    rows = taste.top_labels(profile(spark, d).weights)
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


@query("seed_subtopics", PROFILE + """
SELECT reader, topic, subtopic, rank FROM (
  SELECT r.reader, t.topic, t.subtopic, row_number() OVER (PARTITION BY r.reader ORDER BY round(coalesce(p.weight, 0), 6) DESC, t.ord) AS rank
  FROM readers r CROSS JOIN tree t LEFT JOIN prof p ON p.reader = r.reader AND p.kind = 'label' AND p.key = t.ord) WHERE rank <= 8""")
def _(spark, d):
    p = profile(spark, d)
    return taste.seed_subtopics(p.readers, p.weights, b.topic_tree(spark, d)).select(
        "reader", "topic", "subtopic", F.col("rank").cast("bigint").alias("rank"))


@query("vector_norm", PROFILE + "SELECT reader, kind, round(sqrt(sum(weight * weight)), 4) AS norm FROM prof GROUP BY ALL")
def _(spark, d):
    return recommend.vector_norm(profile(spark, d).weights, ["reader", "kind"]).select("reader", "kind", F.round("norm", 4).alias("norm"))


# ---------------------------------------------------------------- topic homes

BROAD = """broad AS (SELECT topic, tag FROM (SELECT topic, tag, row_number() OVER (PARTITION BY topic ORDER BY n DESC, tag) AS r
  FROM (SELECT topic, tag, count(*) AS n FROM (SELECT topic, unnest(tags) AS tag FROM articles) GROUP BY ALL)) WHERE r <= 3)"""
HOME = BROAD + r""",
fit AS MATERIALIZED (
  SELECT a.url, t.topic, t.subtopic, t.ord FROM (SELECT url, unnest(tags) AS tag FROM articles) a
  JOIN (SELECT topic, subtopic, ord, unnest(tags) AS tag FROM tree) t USING (tag)
  UNION ALL
  SELECT a.url, t.topic, t.subtopic, t.ord FROM (
    SELECT DISTINCT url, topic, unnest(regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')) AS phrase
    FROM (SELECT url, title, b.topic FROM (SELECT url, title, unnest(tags) AS tag FROM articles) JOIN broad b USING (tag))) a
  JOIN (SELECT topic, subtopic, ord, unnest(tags) AS phrase FROM tree) t ON t.topic = a.topic AND t.phrase = a.phrase),
home AS (SELECT url, topic, subtopic FROM fit QUALIFY row_number() OVER (PARTITION BY url ORDER BY ord) = 1)"""


def broad_tags(spark, d):
    """The three most frequent title words of each topic."""
    n = b.articles(spark, d).select("topic", F.explode("tags").alias("tag")).groupBy("topic", "tag").agg(F.count("*").alias("n"))
    return ranking.top_per_key(n, ["topic"], [F.desc("n"), F.asc("tag")], 3).select("topic", "tag")


def phrased(spark, d):
    return topics.subtopic_phrases(b.topic_tree(spark, d))


@query("subtopic_phrases", q.with_(q.ARTICLES, q.TREE) + """
SELECT topic, subtopic, CASE WHEN topic = 'de' THEN lower(topic) || '|' || subtopic ELSE array_to_string(tags, '|') END AS phrases FROM tree""")
def _(spark, d):
    tree = b.topic_tree(spark, d)
    override = tree.filter("topic = 'de'").select("topic", "subtopic", F.array(F.lower("topic"), "subtopic").alias("phrases"))
    return topics.subtopic_phrases(tree, override).select("topic", "subtopic", F.array_join("phrases", "|").alias("phrases"))


@query("assign_home", q.with_(q.ARTICLES, q.TREE, HOME) + "SELECT url, topic, subtopic FROM home")
def _(spark, d):
    return topics.assign_home(b.articles(spark, d), phrased(spark, d), broad_tags(spark, d))


POOL = """,
cached AS (SELECT a.url, a.title, a.author, a.published, a.claps, a.prio, a.locked, a.tags, home.topic AS ht, home.subtopic AS hs, true AS cached
  FROM articles a LEFT JOIN home USING (url) WHERE title <> '' AND lang = 'en' AND NOT response),
pool AS (SELECT *, list_distinct(CASE WHEN ht IS NULL THEN tags ELSE list_append(tags, ht || '/' || hs) END) AS labels FROM (
  SELECT * FROM cached UNION ALL
  SELECT url, title, author, day, NULL, prio, NULL, [], NULL, NULL, false FROM posts ANTI JOIN cached USING (url)))"""
POOLED = q.with_(q.ARTICLES, q.TREE, q.PAGE_POSTS, HOME) + POOL


def indexed(spark, d):
    p = b.page_posts(spark, d)
    return ranking.top_per_key(
        p.select("url", "title", "author", F.col("day").alias("published"), "prio", "post_id"), ["url"], [F.asc("post_id")], 1
    ).drop("rank", "post_id")


_POOLS: dict[tuple, object] = {}


def pool(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _POOLS:
        cached = b.articles(spark, d).select("url", "title", "author", "published", "claps", "prio", "locked", "tags", "lang", "response")
        tree = topics.subtopic_phrases(small(spark, d, b.topic_tree))
        rows = recommend.candidate_pool(cached, tree, small(spark, d, broad_tags), indexed=indexed(spark, d))
        _POOLS[key] = stage(rows.drop("lang", "response"), "pool")
    return _POOLS[key]


@query("pool_union", POOLED + "SELECT url, cached, title FROM pool")
def _(spark, d):
    cached = b.articles(spark, d).filter((F.col("title") != "") & (F.col("lang") == "en") & ~F.col("response")).select("url", "title")
    return recommend.pool_union(cached, indexed(spark, d).select("url", "title")).select("url", "cached", "title")


@query("candidate_pool", POOLED + """SELECT url, cached, ht AS home_topic, hs AS home_subtopic,
array_to_string(list_sort(labels), ' ') AS labels FROM pool""")
def _(spark, d):
    return pool(spark, d).select("url", "cached", "home_topic", "home_subtopic", F.array_join(F.array_sort("labels"), " ").alias("labels"))


@query("access_filtered_pool", POOLED + "SELECT url FROM pool WHERE cached AND locked = true")
def _(spark, d):
    cached = b.articles(spark, d).select("url", "title", "author", "published", "claps", "prio", "locked", "tags", "lang", "response")
    return recommend.candidate_pool(cached, phrased(spark, d), broad_tags(spark, d), indexed=indexed(spark, d), locked=True).select("url")


@query("want_labels", POOLED + "SELECT url FROM pool WHERE list_has_any(labels, ['that', 'with', 'en/src3'])")
def _(spark, d):
    cached = b.articles(spark, d).select("url", "title", "author", "published", "claps", "prio", "locked", "tags", "lang", "response")
    return recommend.candidate_pool(cached, phrased(spark, d), broad_tags(spark, d), indexed=indexed(spark, d),
                                    want=["that", "with", "en/src3"]).select("url")


IDF = """,
idf AS (SELECT key, ln(((SELECT count(*) FROM pool) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT url, unnest(labels) AS key FROM pool) GROUP BY key)"""


@query("label_idf", POOLED + IDF + "SELECT key, round(idf, 4) AS idf FROM idf")
def _(spark, d):
    return recommend.label_idf(pool(spark, d)).select("key", F.round("idf", 4).alias("idf"))


ONCE = PROFILE + ", " + q.PAGE_POSTS.strip() + ", " + HOME + POOL + IDF
PAIRS = ONCE + f""",
pl AS (SELECT url, key, idf FROM (SELECT url, unnest(labels) AS key FROM pool) JOIN idf USING (key)),
pw AS (SELECT url, key, count(*) AS tf FROM (SELECT url, unnest({WORDS_OF}) AS key FROM pool) GROUP BY ALL),
ln AS (SELECT url, sqrt(sum(idf * idf)) AS ln FROM pl GROUP BY url),
wn AS (SELECT url, sqrt(sum(tf * tf)) AS wn FROM pw GROUP BY url),
own AS (SELECT reader, kind, key, weight * CASE WHEN kind = 'word' THEN 1 ELSE coalesce(idf, 1.0) END AS v FROM prof LEFT JOIN idf USING (key) WHERE kind <> 'author'),
nm AS (SELECT reader, kind, sqrt(sum(v * v)) AS n FROM own GROUP BY ALL),
au AS (SELECT reader, key, weight / max(weight) OVER (PARTITION BY reader) AS share FROM prof WHERE kind = 'author'),
raw AS (
  SELECT reader, url, kind, v * pl.idf AS dot, CASE WHEN kind = 'label' AND key NOT IN {q.GENERIC} THEN key END AS shared, v FROM own JOIN pl USING (key) WHERE kind <> 'word'
  UNION ALL SELECT reader, url, 'word', v * tf, NULL, 0 FROM own JOIN pw USING (key) WHERE kind = 'word'
  UNION ALL SELECT reader, url, 'author', share, NULL, 0 FROM au JOIN pool ON pool.author = au.key),
known AS (SELECT reader, url FROM wt UNION SELECT reader, url FROM dis),
sums AS (SELECT reader, url, sum(dot) FILTER (kind = 'label') AS l, sum(dot) FILTER (kind = 'word') AS w, sum(dot) FILTER (kind = 'dislike') AS d,
    sum(dot) FILTER (kind = 'author') AS a, list(shared ORDER BY round(v, 6) DESC, shared) FILTER (shared IS NOT NULL) AS shared
  FROM raw ANTI JOIN known USING (reader, url) GROUP BY ALL),
base AS (SELECT url, 0.35 * least(1.0, CASE WHEN cached THEN ln(1 + {q.trend('claps', 'published')}) / (SELECT max(ln(1 + {q.trend('claps', 'published')})) FROM pool WHERE cached)
      ELSE 0.6 * {q.clamp('(prio - 0.1) / 0.9')} END) + 0.3 * {q.fresh('published', 240.0)} + CASE WHEN cached THEN 0.05 ELSE 0 END AS base FROM pool),
scored AS (SELECT s.reader, s.url, p.title, cached, ht, coalesce(s.l / (nl.n * ln.ln), 0) AS label_sim, coalesce(s.w / (nw.n * wn.wn), 0) AS word_sim,
    coalesce(s.d / (nd.n * ln.ln), 0) AS dislike, coalesce(s.a, 0) AS author_share, base, coalesce(shared, []) AS shared,
    [x for x in coalesce(shared, []) if NOT contains(x, '/')] AS tags_shared
  FROM sums s JOIN pool p USING (url) JOIN base USING (url) LEFT JOIN ln USING (url) LEFT JOIN wn USING (url)
  LEFT JOIN nm nl ON nl.reader = s.reader AND nl.kind = 'label' LEFT JOIN nm nw ON nw.reader = s.reader AND nw.kind = 'word'
  LEFT JOIN nm nd ON nd.reader = s.reader AND nd.kind = 'dislike'),
final AS (SELECT *, round(label_sim + 0.7 * word_sim + 0.25 * author_share + base - 0.8 * dislike, 4) AS score FROM scored)"""


#: The same without the lists of shared labels, for statements that don't ask for them.
SCORES = PAIRS.replace("list(shared ORDER BY round(v, 6) DESC, shared) FILTER (shared IS NOT NULL) AS shared", "CAST(NULL AS VARCHAR[]) AS shared")


def known(spark, d):
    return small(spark, d, known_pairs)


def known_pairs(spark, d):
    engaged, dis = parts(spark, d)
    return engaged.select("reader", "url").union(dis.select("reader", "url")).distinct()


def scored_pairs(spark, d, columns):
    return recommend.score_pairs(profile(spark, d, staged=True).weights, pool(spark, d), b.AS_OF, known=known(spark, d), columns=columns)


_PAGED: dict[tuple, object] = {}


def paged(spark, d):
    key = (spark.sparkContext.applicationId, d)
    if key not in _PAGED:
        p = profile(spark, d, staged=True)
        _PAGED[key] = recommend.page_pairs(p.weights, pool(spark, d), p.readers, b.AS_OF, limit=60, known=known(spark, d))
    return _PAGED[key]


def pages(spark, d):
    """The page of each reader; all pairs are scored, and those that can be on a page are shaped."""
    return recommend.shape(paged(spark, d), pool(spark, d), profile(spark, d, staged=True).readers, b.AS_OF, limit=60, known=known(spark, d))


@query("label_overlap_join", SCORES + "SELECT reader, url, round(label_sim, 4) AS label_sim FROM scored WHERE label_sim > 0")
def _(spark, d):
    return scored_pairs(spark, d, ["reader", "url", "label_sim"]).filter("label_sim > 0").select("reader", "url", F.round("label_sim", 4).alias("label_sim"))


@query("score_candidates", SCORES + """SELECT reader, url, cached, round(word_sim, 4) AS word_sim, round(author_share, 4) AS author_share,
round(dislike, 4) AS dislike, score FROM final""")
def _(spark, d):
    return scored_pairs(spark, d, ["reader", "url", "cached", "word_sim", "author_share", "dislike", "score"]).select(
        "reader", "url", "cached", F.round("word_sim", 4).alias("word_sim"), F.round("author_share", 4).alias("author_share"),
        F.round("dislike", 4).alias("dislike"), "score")


@query("max_scaling", PROFILE + """SELECT reader, key, round(weight / max(weight) OVER (PARTITION BY reader), 4) AS share,
round(ln(1 + weight) / max(ln(1 + weight)) OVER (PARTITION BY reader), 4) AS log_share FROM prof WHERE kind = 'author'""")
def _(spark, d):
    w = profile(spark, d).weights.filter("kind = 'author'").select("reader", "key", "weight")
    out = ranking.max_scaled(ranking.max_scaled(w, ["reader"], "weight", "share"), ["reader"], "weight", "log_share", log=True)
    return out.select("reader", "key", F.round("share", 4).alias("share"), F.round("log_share", 4).alias("log_share"))


WHY = f"""
, bare AS (SELECT reader, url, title FROM final WHERE len(tags_shared) = 0),
bw AS (SELECT reader, url, word, min(pos) AS pos FROM (SELECT reader, url, unnest({q.words('title')}) AS word, generate_subscripts({q.words('title')}, 1) AS pos FROM bare)
       WHERE word NOT IN {q.STOP} AND length(word) > 2 GROUP BY ALL),
bm AS (SELECT bw.*, round(weight, 6) AS w FROM bw JOIN prof p ON p.reader = bw.reader AND p.kind = 'word' AND p.key = {q.stem('word')} WHERE p.weight > 0),
why AS (SELECT reader, url, list(word ORDER BY w DESC, pos) AS words FROM (SELECT *, row_number() OVER (PARTITION BY reader, url ORDER BY w DESC, pos) AS r FROM bm) WHERE r <= 3 GROUP BY ALL)"""


@query("because_words", PAIRS + WHY + "SELECT reader, url, array_to_string(words, ' ') AS because_words FROM why")
def _(spark, d):
    bare = scored_pairs(spark, d, ["reader", "url", "n_tags", "because_words"]).filter((F.col("n_tags") == 0) & (F.size("because_words") > 0))
    return bare.select("reader", "url", F.array_join("because_words", " ").alias("because_words"))


#: The sixty best of each reader, the length of a page.
PICKED = SCORES + ", pick AS MATERIALIZED (SELECT * FROM final QUALIFY row_number() OVER (PARTITION BY reader ORDER BY score DESC, url) <= 60)"


@query("best_picks", PICKED + " SELECT reader, url, score FROM pick")
def _(spark, d):
    return recommend.best_pairs(profile(spark, d, staged=True).weights, pool(spark, d), b.AS_OF, 60, known=known(spark, d)).select("reader", "url", "score")


@query("explain_pick")
def _(spark, d):
    """The page that each reader sees, explained; places for something new share nothing and have no explanation."""
    p, seen = profile(spark, d, staged=True), stage(pages(spark, d).select("reader", "url").distinct(), "seen")
    rows = recommend.explain(recommend.score_pairs(p.weights, pool(spark, d), b.AS_OF, known=known(spark, d), only=seen), p)
    return rows.select("reader", "url", F.array_join("because", " ").alias("because"), "like",
                       F.array_join("because_words", " ").alias("because_words"), "same_author")


@query("index_candidates")
def _(spark, d):
    from .search_queries import staged_index

    p = profile(spark, d, staged=True)
    tree = topics.subtopic_phrases(small(spark, d, b.topic_tree))
    seeds = taste.seed_subtopics(p.readers, p.weights, tree)
    return recommend.index_candidates(seeds, tree, staged_index(spark, d), b.AS_OF).drop("title")


@query("shape_page")
def _(spark, d):
    return pages(spark, d)


@query("source_mix")
def _(spark, d):
    return recommend.source_mix(pages(spark, d))


SLOTS = """
WITH e AS (SELECT user_id AS reader, event_type AS kind, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS i FROM events),
k0 AS (SELECT reader, event_id, i FROM e WHERE kind = 'view' AND i < 60), f AS (SELECT reader, event_id, i FROM e WHERE kind = 'click' AND i < 18),
x AS (SELECT reader, event_id, i FROM e WHERE kind = 'error' AND i < 8),
sz AS (SELECT reader, coalesce(nf, 0) AS nf, least(coalesce(nk, 0), 60 - coalesce(nf, 0)) AS nk, greatest(1, 60 // (coalesce(nf, 0) + 1)) AS step
  FROM (SELECT DISTINCT reader FROM e) LEFT JOIN (SELECT reader, count(*) AS nk FROM k0 GROUP BY 1) USING (reader) LEFT JOIN (SELECT reader, count(*) AS nf FROM f GROUP BY 1) USING (reader)),
fp AS (SELECT reader, event_id, least(nk + i, (i + 1) * step) AS at_ FROM f JOIN sz USING (reader)),
kp AS (SELECT reader, event_id, gap AS at_ FROM (
   SELECT k0.reader, k0.event_id, k0.i, free.gap FROM k0 JOIN sz USING (reader)
   JOIN (SELECT reader, g AS gap, row_number() OVER (PARTITION BY reader ORDER BY g) - 1 AS n FROM (SELECT reader, unnest(range(0, 200)) AS g FROM sz) t
         ANTI JOIN fp ON fp.reader = t.reader AND fp.at_ = t.g) free ON free.reader = k0.reader AND free.n = k0.i WHERE k0.i < nk)),
mix AS (SELECT reader, event_id, row_number() OVER (PARTITION BY reader ORDER BY at_) - 1 AS i, 'm' AS t FROM (SELECT * FROM fp UNION ALL SELECT * FROM kp)),
xp AS (SELECT x.reader, event_id, least(coalesce(n, 0) + i, 6 + 7 * i) AS at_ FROM x LEFT JOIN (SELECT reader, count(*) AS n FROM mix GROUP BY 1) USING (reader)),
mp AS (SELECT mix.reader, mix.event_id, free.g AS at_ FROM mix JOIN
   (SELECT reader, g, row_number() OVER (PARTITION BY reader ORDER BY g) - 1 AS n FROM (SELECT reader, unnest(range(0, 200)) AS g FROM sz) t
    ANTI JOIN xp ON xp.reader = t.reader AND xp.at_ = t.g) free ON free.reader = mix.reader AND free.n = mix.i)
SELECT reader, CAST(event_id AS VARCHAR) AS url, at_ AS slot FROM (SELECT * FROM xp UNION ALL SELECT * FROM mp) WHERE at_ < 60"""


@query("page_slots", SLOTS)
def _(spark, d):
    e = b.table(spark, d, "events").select(
        F.col("user_id").alias("reader"), "event_type", F.col("event_id").cast("string").alias("url"), "event_id", F.col("value").alias("score"))

    def part(kind, n):
        rows = ranking.top_per_key(e.filter(F.col("event_type") == kind), ["reader"], [F.asc("event_id")], n)
        return rows.select("reader", "url", "score", (F.col("rank") - 1).alias("i"))

    page = recommend.place_slots(part("view", 60), part("click", 18), part("error", 8), 60)
    return page.select("reader", "url", F.col("slot").cast("bigint").alias("slot"))
