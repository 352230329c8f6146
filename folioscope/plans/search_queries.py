"""Search queries: every benchmark query against every document, whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import ranking, search
from ..session import stage
from . import bindings as b
from . import sqlparts as q
from .registry import query

TOK = q.with_(q.DOC_POSTS, q.QUERIES, f"""
pt AS (SELECT *, {q.words('title')} AS tw, {q.words('author')} AS aw FROM posts),
tk0 AS (SELECT post_id, day, len(tw) + len(aw) AS doc_len, 't' AS f, unnest(tw) AS token, generate_subscripts(tw, 1) - 1 AS pos FROM pt
        UNION ALL
        SELECT post_id, day, len(tw) + len(aw), 'a', unnest(aw), generate_subscripts(aw, 1) - 1 FROM pt),
stems AS (SELECT token, {q.stem('token')} AS stem FROM (SELECT DISTINCT token FROM tk0)),
tk AS (SELECT tk0.*, stem FROM tk0 JOIN stems USING (token))""")

MATCH = f""",
u1 AS (SELECT query_id, unnest(terms) AS w, generate_subscripts(terms, 1) - 1 AS unit, len(terms) AS nt FROM queries),
units AS (SELECT query_id, unit, {q.stem('w')} AS stem, unit = nt - 1 AS is_last FROM u1),
uph AS (SELECT query_id, unnest(phrases[1]) AS w, generate_subscripts(phrases[1], 1) - 1 AS idx, len(phrases[1]) AS n FROM queries WHERE len(phrases) > 0),
uph2 AS (SELECT query_id, idx, n, {q.stem('w')} AS stem FROM uph),
runs AS (SELECT query_id, post_id, day, doc_len, f, pos - idx AS st FROM uph2 JOIN tk USING (stem)
         GROUP BY query_id, n, post_id, day, doc_len, f, pos - idx HAVING count(DISTINCT idx) = n),
m AS (
  SELECT query_id, unit, post_id, day, doc_len, sum(CASE f WHEN 't' THEN 10.0 ELSE 2.0 END) AS wf FROM units JOIN tk USING (stem) GROUP BY ALL
  UNION ALL
  SELECT query_id, -1, post_id, day, doc_len, sum(CASE f WHEN 't' THEN 10.0 ELSE 2.0 END)
  FROM (SELECT u.query_id, s.stem FROM units u JOIN (SELECT DISTINCT stem FROM stems) s ON starts_with(s.stem, u.stem) WHERE u.is_last) JOIN tk USING (stem) GROUP BY ALL
  UNION ALL
  SELECT query_id, 100000, post_id, day, doc_len, sum(CASE f WHEN 't' THEN 10.0 ELSE 2.0 END) FROM runs GROUP BY ALL
  UNION ALL
  SELECT query_id, -2, post_id, day, doc_len, 2.0 FROM queries q JOIN tk ON tk.f = 'a' AND tk.token = q.author),
idf AS (SELECT query_id, unit, greatest(1e-6, ln(((SELECT count(*) FROM posts) - count(*) + 0.5) / (count(*) + 0.5))) AS idf FROM m GROUP BY ALL),
p AS (SELECT m.*, idf * wf * 2.2 / (wf + 1.2 * (1 - 0.75 + 0.75 * doc_len / (SELECT avg(len(tw) + len(aw)) FROM pt))) AS part
      FROM m JOIN idf USING (query_id, unit)),
g AS (SELECT query_id, post_id, len(terms) AS nt, len(terms) + len(phrases) AS nu,
        count(*) FILTER (unit >= 0) AS found, count(*) FILTER (unit >= 0 AND unit <> len(terms) - 1) AS found_but,
        max(unit = -1) AS has_open,
        sum(CASE WHEN unit <> -1 THEN part ELSE 0 END) AS sw, sum(CASE WHEN unit <> len(terms) - 1 THEN part ELSE 0 END) AS sp
      FROM p JOIN queries q USING (query_id)
      WHERE (q.since IS NULL OR day >= q.since) AND (q.before IS NULL OR day <= q.before)
      GROUP BY query_id, post_id, nt, nu, author HAVING author IS NULL OR max(unit = -2)),
ban AS (SELECT DISTINCT query_id, post_id FROM (SELECT query_id, {q.stem('x')} AS stem FROM (SELECT query_id, unnest(exclude) AS x FROM queries)) JOIN tk USING (stem)),
modes AS (SELECT query_id, post_id, nt, nu, found = nu AS "all", nt > 0 AND has_open AND found_but = nu - 1 AS prefix,
            found > 0 OR nu = 0 AS "any", -sw AS bm, -sp AS bmp FROM g ANTI JOIN ban USING (query_id, post_id))"""

LADDER = """,
cnt AS (SELECT query_id, nt, nu, count(*) FILTER ("all") AS ca, count(*) FILTER (prefix) AS cp FROM modes GROUP BY ALL),
used AS (SELECT query_id, CASE WHEN ca > 20 THEN 'all' WHEN nt > 0 AND cp > 20 THEN 'prefix' WHEN nu > 1 THEN 'any' WHEN nt > 0 THEN 'prefix' ELSE 'all' END AS mode FROM cnt),
fit AS (SELECT query_id, post_id, mode, round(CASE WHEN mode = 'prefix' THEN bmp ELSE bm END, 6) AS bm FROM modes JOIN used USING (query_id)
        WHERE CASE mode WHEN 'all' THEN "all" WHEN 'prefix' THEN prefix ELSE CASE WHEN nu > 1 THEN "any" ELSE "all" END END),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm, post_id) AS r,
                               least(400, count(*) OVER (PARTITION BY query_id)) AS scanned FROM fit) WHERE r <= 400)"""

HITS = f""",
qt AS (SELECT query_id, unnest(list_distinct(list_concat(list_concat(terms, flatten(phrases)), soft))) AS term FROM queries),
ts AS (SELECT term, {q.stem('term')} AS ts FROM (SELECT DISTINCT term FROM qt)),
lv AS (SELECT term, token, CASE WHEN term = token THEN 2 ELSE 1 END AS level FROM (
  SELECT term, token, ts, stem, CASE WHEN length(term) <= length(token) THEN term ELSE token END AS sh,
         CASE WHEN length(term) <= length(token) THEN token ELSE term END AS lo FROM ts, stems)
  WHERE ts = stem OR (starts_with(lo, sh) AND (strlen(sh) <> length(sh) OR (length(sh) >= 5 AND length(lo) - length(sh) <= 2)))),
hit AS (SELECT query_id, post_id, term, coalesce(max(level) FILTER (f = 't'), 0) AS title_level,
          min(pos) FILTER (f = 't' AND level = 2) AS p2, min(pos) FILTER (f = 't' AND level = 1) AS p1,
          coalesce(max(level) FILTER (f = 'a'), 0) AS author_level
        FROM qt JOIN lv USING (term) JOIN tk USING (token) SEMI JOIN cand ON cand.query_id = qt.query_id AND cand.post_id = tk.post_id
        GROUP BY ALL),
hits AS (SELECT query_id, post_id, term, title_level, coalesce(p2, p1) AS title_at, author_level FROM hit)"""

RANK = f""",
ct AS (SELECT query_id, unnest(list_concat(terms, flatten(phrases))) AS term, generate_subscripts(list_concat(terms, flatten(phrases)), 1) AS o FROM queries),
ch AS (SELECT c.query_id, c.post_id, t.term, t.o, coalesce(h.title_level, 0) AS tl, h.title_at AS at_, coalesce(h.author_level, 0) AS al
       FROM cand c JOIN ct t USING (query_id) LEFT JOIN hits h USING (query_id, post_id, term)),
od AS (SELECT query_id, post_id, count(*) AS k, max(at_) - min(at_) + 1 AS span, min(at_) AS lo,
         coalesce(bool_and(at_ > prev), true) AS up
       FROM (SELECT *, lag(at_) OVER (PARTITION BY query_id, post_id ORDER BY o) AS prev FROM ch WHERE tl > 0) GROUP BY ALL),
cv AS (SELECT query_id, post_id, sum(CASE greatest(tl, al) WHEN 2 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0 END) AS cs,
         count(*) FILTER (greatest(tl, al) = 2) AS ex, count(*) FILTER (tl > 0) AS ntitle, count(*) FILTER (al > 0) AS nauthor, count(*) AS nd
       FROM (SELECT DISTINCT query_id, post_id, term, tl, al FROM ch) GROUP BY ALL),
sf AS (SELECT c.query_id, c.post_id, count(*) FILTER (h.title_level > 0) AS sn
       FROM cand c JOIN (SELECT query_id, unnest(soft) AS term FROM queries) USING (query_id) LEFT JOIN hits h USING (query_id, post_id, term) GROUP BY ALL),
feat AS (
  SELECT c.query_id, c.post_id, pt.url, pt.day, c.bm, c.mode,
    c.bm / min(c.bm) OVER (PARTITION BY c.query_id) AS lex,
    cv.cs / len(list_concat(terms, flatten(phrases))) AS cover, cv.ex / len(list_concat(terms, flatten(phrases))) AS exact,
    CASE WHEN cv.ntitle < 2 THEN CASE WHEN len(phrases) > 0 THEN 1.0 ELSE 0 END ELSE od.k / od.span * CASE WHEN od.up THEN 1.0 ELSE 0.8 END END AS phrase,
    CASE WHEN od.k > 0 THEN 1 - {q.clamp('od.lo / 8.0')} ELSE 0 END AS head,
    CASE WHEN len(soft) > 0 THEN sf.sn / len(soft) ELSE 0 END AS soft,
    CASE WHEN q.author IS NOT NULL THEN 1.0 WHEN cv.nauthor > 0 AND cv.nauthor = cv.nd THEN 0.7 ELSE 0 END AS author_hit,
    {q.fresh('pt.day', 240.0)} AS fresh, {q.clamp('(prio - 0.1) / 0.9')} AS prio, 1 - {q.clamp('(len(tw) - 10) / 16.0')} AS brevity
  FROM cand c JOIN queries q USING (query_id) JOIN pt USING (post_id) JOIN cv USING (query_id, post_id)
  LEFT JOIN od USING (query_id, post_id) LEFT JOIN sf USING (query_id, post_id)),
sc AS (SELECT *, round(lex + 2.2 * cover + 0.5 * exact * cover + 0.9 * phrase * cover + 0.25 * head + 0.1 * soft + 0.6 * author_hit
          + 0.45 * fresh + 0.3 * prio + 0.15 * brevity, 4) AS score FROM feat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, day DESC, url DESC) AS rank FROM sc)"""


_STAGED: dict[tuple, search.Index] = {}


def index(spark, d) -> search.Index:
    return search.build_index(b.document_posts(spark, d))


def staged_index(spark, d) -> search.Index:
    """The index as a table: written once per session and data folder, read by every search query."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STAGED:
        _STAGED[key] = index(spark, d).staged()
    return _STAGED[key]


@query("query_log_normalisation", q.with_(q.QUERIES) + f"""
, raw AS (SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN [t for t in w if t IN {q.STOP}] ELSE w END AS plain,
   CASE item_id % 4 WHEN 0 THEN [w[1:1]] WHEN 1 THEN [w, w[-1:]] ELSE [] END AS phrases
   FROM (SELECT item_id, {q.words('text')} AS w FROM benchmark)),
c AS (SELECT query_id, list_concat([t for t in plain if t NOT IN {q.STOP}], flatten([p for p in phrases if len(p) = 1])) AS terms,
   [t for t in plain if t IN {q.STOP}] AS small, [p for p in phrases if len(p) > 1] AS long FROM raw)
SELECT query_id, array_to_string(list_sort(list_distinct(CASE WHEN len(terms) = 0 AND len(long) = 0 THEN small ELSE terms END)), ' ') AS terms,
  CASE WHEN len(terms) = 0 AND len(long) = 0 THEN '' ELSE array_to_string(small, ' ') END AS soft, len(long) AS n_phrases FROM c""")
def _(spark, d):
    w = text.words("text")
    i = F.col("item_id")
    raw = b.table(spark, d, "benchmark").withColumn("w", w).select(
        i.alias("query_id"),
        F.when(i % 3 == 0, F.filter("w", lambda x: x.isin(fixed.STOPWORDS))).otherwise(F.col("w")).alias("plain"),
        F.when(i % 4 == 0, F.array(F.slice("w", 1, 1))).when(i % 4 == 1, F.array(F.col("w"), F.slice("w", -1, 1)))
        .otherwise(F.array().cast("array<array<string>>")).alias("phrases"),
        F.array().cast("array<string>").alias("exclude"),
        F.lit(None).cast("string").alias("author"), F.lit(None).cast("date").alias("since"), F.lit(None).cast("date").alias("before"),
    )
    n = search.normalise_queries(raw)
    return n.select("query_id", F.array_join(F.array_sort("terms"), " ").alias("terms"),
                    F.array_join("soft", " ").alias("soft"), F.size("phrases").cast("bigint").alias("n_phrases"))


@query("build_postings", TOK + """
SELECT post_id, token, stem, count(*) FILTER (f = 't') AS tf_title, count(*) FILTER (f = 'a') AS tf_author,
  min(pos) FILTER (f = 't') AS first_at, max(doc_len) AS doc_len FROM tk GROUP BY post_id, token, stem""")
def _(spark, d):
    return index(spark, d).postings.select(
        "post_id", "token", "stem", "tf_title", "tf_author", F.get("title_pos", F.lit(0)).cast("bigint").alias("first_at"),
        F.col("doc_len").cast("bigint").alias("doc_len"))


@query("doc_stats", TOK + """SELECT post_id, len(tw) AS title_len, len(tw) + len(aw) AS doc_len FROM pt""")
def _(spark, d):
    return index(spark, d).docs.select("post_id", *[F.col(c).cast("bigint").alias(c) for c in ("title_len", "doc_len")])


@query("term_stats", TOK + "SELECT stem, count(DISTINCT post_id) AS df FROM tk GROUP BY stem")
def _(spark, d):
    return search.term_stats(index(spark, d).postings)


@query("index_to_post", TOK + MATCH + """SELECT DISTINCT query_id, post_id, url, m.day FROM m JOIN posts USING (post_id) WHERE unit >= 0""")
def _(spark, d):
    ix = staged_index(spark, d)
    m = search.unit_matches(ix, b.queries(spark, d), with_open=False).filter("unit >= 0")
    hits = m.select("query_id", "post_id").distinct()
    return hits.join(ix.docs.select("post_id", "url", "day"), "post_id").select("query_id", "post_id", "url", "day")


@query("boolean_match", TOK + MATCH + """SELECT query_id, post_id, "all" AS all_words, prefix AS open_last, "any" AS any_word FROM modes""")
def _(spark, d):
    rows = search.match_modes(staged_index(spark, d), b.queries(spark, d))
    return rows.select("query_id", "post_id", F.col("all").alias("all_words"), F.col("prefix").alias("open_last"),
                       F.col("any").alias("any_word"))


@query("bm25_retrieve", TOK + MATCH + """
SELECT query_id, post_id, round(bm, 6) AS bm FROM modes WHERE "any"
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(bm, 6), post_id) <= 400""")
def _(spark, d):
    rows = search.retrieve(staged_index(spark, d), b.queries(spark, d), mode="any")
    return rows.select("query_id", "post_id", "bm")


@query("widening_ladder", TOK + MATCH + LADDER + "SELECT query_id, mode, scanned, post_id, bm FROM cand")
def _(spark, d):
    rows = search.retrieve(staged_index(spark, d), b.queries(spark, d))
    return rows.select("query_id", "mode", F.col("scanned").cast("bigint").alias("scanned"), "post_id", "bm")


@query("bm25_normalise", TOK + MATCH + LADDER + """SELECT query_id, post_id, round(bm / min(bm) OVER (PARTITION BY query_id), 4) AS lex FROM cand""")
def _(spark, d):
    rows = search.retrieve(staged_index(spark, d), b.queries(spark, d))
    return ranking.bm25_normalise(rows, "query_id").select("query_id", "post_id", F.round("lex", 4).alias("lex"))


@query("term_hits", TOK + MATCH + LADDER + HITS + "SELECT query_id, post_id, term, title_level, title_at, author_level FROM hits")
def _(spark, d):
    ix, qs = staged_index(spark, d), b.queries(spark, d)
    hits = search.term_hits(ix, qs, search.retrieve(ix, qs))
    return hits.withColumn("title_at", F.col("title_at").cast("bigint"))


@query("rank_results", TOK + MATCH + LADDER + HITS + RANK + """SELECT query_id, post_id, mode, rank, score, round(round(cover, 9), 3) AS cover FROM ranked""")
def _(spark, d):
    ix, qs = staged_index(spark, d), b.queries(spark, d)
    ranked = search.rank(ix, qs, search.retrieve(ix, qs), b.AS_OF)
    return ranked.select("query_id", "post_id", "mode", F.col("rank").cast("bigint").alias("rank"), "score", "cover")


@query("stable_rank_order", TOK + MATCH + LADDER + HITS + RANK + "SELECT query_id, rank, url FROM ranked WHERE rank <= 20")
def _(spark, d):
    ix, qs = staged_index(spark, d), b.queries(spark, d)
    ranked = search.rank(ix, qs, search.retrieve(ix, qs), b.AS_OF)
    return ranked.filter("rank <= 20").select("query_id", F.col("rank").cast("bigint").alias("rank"), "url")


ALL_WORDS = LADDER.replace("CASE WHEN ca > 20 THEN 'all' WHEN nt > 0 AND cp > 20 THEN 'prefix' WHEN nu > 1 THEN 'any' WHEN nt > 0 THEN 'prefix' ELSE 'all' END", "'all'")


@query("search_all_words", TOK + MATCH + ALL_WORDS + HITS + RANK + "SELECT query_id, rank, post_id, url, score FROM ranked WHERE rank <= 20")
def _(spark, d):
    ix, qs = staged_index(spark, d), b.queries(spark, d)
    ranked = search.rank(ix, qs, search.retrieve(ix, qs, mode="all"), b.AS_OF)
    return ranked.filter("rank <= 20").select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "post_id", "url", "score")


DIVERSE = f""",
ls AS (SELECT query_id AS list, rank, r.url, p.author AS grp, {q.signature('p.title')} AS sig FROM ranked r JOIN posts p USING (post_id)),
{q.walk(2)},
placed AS (SELECT r.*, p.author, row_number() OVER (PARTITION BY r.query_id ORDER BY k.kept DESC, r.rank) AS position FROM ranked r JOIN kept k ON k.list = r.query_id AND k.rank = r.rank JOIN posts p USING (post_id))"""
SEARCH = (TOK + MATCH + LADDER + HITS + RANK + DIVERSE).replace("WITH ", "WITH RECURSIVE ", 1)
PAGED = """SELECT placed.query_id, position, post_id, placed.url, author, placed.mode, score, scanned > {last} AS more FROM placed JOIN (SELECT DISTINCT query_id, scanned FROM cand) USING (query_id)
WHERE position > {first} AND position <= {last}"""
SHOWN = ["query_id", "position", "post_id", "url", "author", "mode", "score", "more"]


@query("search", SEARCH + PAGED.format(first=0, last=20))
def _(spark, d):
    return search.search(b.queries(spark, d), staged_index(spark, d), b.AS_OF).select(*SHOWN)


@query("search_page", SEARCH.replace("WHEN ca > 20", "WHEN ca > 40").replace("cp > 20", "cp > 40") + PAGED.format(first=20, last=40))
def _(spark, d):
    return search.search(b.queries(spark, d), staged_index(spark, d), b.AS_OF, offset=20).select(*SHOWN)


@query("search_with_prior")
def _(spark, d):
    """Each query nudged by the words of the reader with the same number."""
    from ..operators.taste import word_profile
    from .taste_queries import profile

    prior = word_profile(profile(spark, d, staged=True).weights).select(
        F.col("reader").alias("query_id"), F.col("key").alias("word"), "weight")
    qs = b.queries(spark, d)
    return search.search(qs, staged_index(spark, d), b.AS_OF, prior=prior.join(qs.select("query_id"), "query_id")).select(*SHOWN, "yours")


@query("diversify", q.with_(q.ARTICLES).replace("WITH", "WITH RECURSIVE", 1) + f""",
ls AS (SELECT topic AS list, row_number() OVER (PARTITION BY topic ORDER BY claps DESC, doc_id) AS rank, author AS grp, {q.signature('title')} AS sig, doc_id FROM articles),
{q.walk(2)}
SELECT list, rank, doc_id, kept FROM ls JOIN kept USING (list, rank)""")
def _(spark, d):
    a = b.articles(spark, d).select(F.col("topic").alias("list"), "claps", "doc_id", F.col("author").alias("grp"),
                                    text.headline_signature("title").alias("sig"))
    ranked = ranking.full_rank(a, ["list"], ["-claps", "doc_id"])
    return ranking.diversify(stage(ranked), "list", "rank", "grp", "sig", 2).select(
        "list", F.col("rank").cast("bigint").alias("rank"), "doc_id", "kept")


@query("missing_words_notice", TOK + MATCH + LADDER + HITS + RANK + """
, lack AS (SELECT DISTINCT query_id, term FROM ch JOIN ranked USING (query_id, post_id) WHERE rank <= 20 AND mode <> 'all' AND greatest(tl, al) = 0)
SELECT query_id, string_agg(term, ', ' ORDER BY term) AS missing_words
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY term) AS r FROM lack) WHERE r <= 4 GROUP BY query_id""")
def _(spark, d):
    ix, qs = staged_index(spark, d), b.queries(spark, d)
    ranked = search.rank(ix, qs, search.retrieve(ix, qs), b.AS_OF)
    return search.missing_notice(ranked.filter("rank <= 20"))
