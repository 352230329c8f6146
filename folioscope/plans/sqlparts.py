"""SQL twins of the bindings and of the text expressions, used only to build the oracle statements."""

from __future__ import annotations

from ..functions import fixed
from ..functions.text import LATIN_FROM, LATIN_TO, STEM_PATTERN

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DAY = "DATE '2024-01-31'"


def lst(values) -> str:
    return "[" + ", ".join("'%s'" % v.replace("'", "''") for v in values) + "]"


def inlist(values) -> str:
    return "(" + ", ".join("'%s'" % v.replace("'", "''") for v in values) + ")"


STOP = inlist(fixed.STOPWORDS)
GENERIC = inlist(fixed.GENERIC_LABELS)


def words(x: str) -> str:
    return (
        f"regexp_extract_all(translate(lower(coalesce({x}, '')), '{LATIN_FROM}', '{LATIN_TO}'), "
        r"'[\p{L}\p{N}]+')"
    )


def stem(w: str) -> str:
    base, suf = f"regexp_extract({w}, '{STEM_PATTERN}', 1)", f"regexp_extract({w}, '{STEM_PATTERN}', 2)"
    return (
        f"(CASE WHEN {suf} = '' THEN {w} "
        f"WHEN {suf} = 's' AND right({w}, 2) IN ('ss', 'us', 'is') THEN {w} "
        f"WHEN {suf} IN ('ies', 'ied') THEN {base} || 'y' "
        f"WHEN {suf} IN ('ing', 'ings', 'ed') AND length({base}) > 3 "
        f"AND right({base}, 1) = left(right({base}, 2), 1) "
        f"AND right({base}, 2) NOT IN ('ll', 'ss', 'zz', 'ff') THEN left({base}, length({base}) - 1) "
        f"ELSE {base} END)"
    )


def headline_words(x: str) -> str:
    return (
        f"[w for w in list_distinct(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]{{2,}}')) "
        f"if w NOT IN {inlist(fixed.HEADLINE_STOPWORDS)}]"
    )


#: The references that the given pages hold; ``&amp;`` last, so that nothing is decoded twice in a round.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&hellip;", "…"), ("&mdash;", "—"), ("&ndash;", "–"),
    ("&lsquo;", "‘"), ("&middot;", "·"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&"),
]


def clean(x: str) -> str:
    out = f"coalesce({x}, '')"
    for _ in range(3):
        for name, char in ENTITIES:
            name, char = name.replace("'", "''"), char.replace("'", "''")
            out = f"replace({out}, '{name}', '{char}')"
    return rf"trim(regexp_replace({out}, '[\s ]+', ' ', 'g'))"


def title_of(x: str) -> str:
    return rf"trim(regexp_replace(regexp_extract({x}, '^\s*([^\n]*)', 1), '\s+', ' ', 'g'))"


def fresh(day: str, half_life: float) -> str:
    return (
        f"(CASE WHEN {day} IS NULL THEN 0.0 ELSE pow(0.5, greatest(0.0, (epoch_us({AS_OF}) "
        f"- epoch_us(CAST({day} AS TIMESTAMP))) / 86400e6) / {half_life}) END)"
    )


def trend(claps: str, day: str) -> str:
    return (
        f"(coalesce({claps}, 0) / pow(CASE WHEN {day} IS NULL THEN 30 "
        f"ELSE greatest(0, date_diff('day', CAST({day} AS DATE), {DAY})) END + 3, 0.8))"
    )


def clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


DOC_URL = "'https://' || source || '.example.org/d/' || CAST(doc_id AS VARCHAR)"

ARTICLES = f"""
articles AS (
  SELECT doc_id, substr(sha1(url), 1, 12) AS id, url, title, src AS author, text AS snippet, lang AS topic,
         src AS subtopic, n_chars AS claps, quality = 1 AS locked,
         CAST({DAY} - CAST(doc_id % 200 AS INTEGER) AS DATE) AS published,
         CAST({DAY} - CAST((doc_id * 7) % 90 AS INTEGER) AS DATE) AS added,
         CASE WHEN doc_id % 3 = 0 THEN 'auto' WHEN doc_id % 3 = 1 THEN 'bulk' END AS source,
         CASE WHEN doc_id % 4 = 0 THEN 'pdf/' || substr(sha1(url), 1, 12) || '.pdf' END AS pdf,
         doc_id % 5 = 0 AS fetched, CAST(coalesce(toxic, 0) AS BIGINT) AS notes_count, lang,
         doc_id % 17 = 0 AS response,
         [w for w in list_distinct({words('title')}) if length(w) >= 4] AS tags,
         0.1 + (doc_id % 10) / 10.0 AS prio,
         CASE WHEN doc_id % 6 <> 0 THEN CAST({DAY} - CAST(doc_id % 15 AS INTEGER) AS DATE) END AS locked_checked
  FROM (SELECT d.doc_id, d.text, d.lang, d.source AS src, d.n_chars, l.quality, l.toxic,
               {DOC_URL.replace('source', 'd.source').replace('doc_id', 'd.doc_id')} AS url,
               {title_of('d.text')} AS title
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id))"""

PAGE_POSTS = f"""
posts AS (
  SELECT page_id AS post_id, url, {clean("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
         regexp_extract(url, '^https?://([^./]*)', 1) AS author,
         CAST(DATE '2024-01-01' + CAST(page_id % 30 AS INTEGER) AS DATE) AS day,
         0.1 + (page_id % 10) / 10.0 AS prio
  FROM pages)"""

DOC_POSTS = f"""
posts AS (
  SELECT doc_id AS post_id, {DOC_URL} AS url, text AS title, source AS author,
         CAST({DAY} - CAST(doc_id % 200 AS INTEGER) AS DATE) AS day, 0.1 + (doc_id % 10) / 10.0 AS prio
  FROM documents)"""

ENGAGEMENT = r"""
engagement AS (
  SELECT user_id AS reader, CAST(regexp_extract(props, '"k": ?(\d+)', 1) AS BIGINT) AS doc_id,
         event_type AS kind, ts
  FROM events WHERE regexp_extract(props, '"k": ?(\d+)', 1) <> '')"""

# distinct words of a passage in order of first appearance
_FIRST = "[x[2] for x in list_sort([ [ lpad(CAST(list_position(w, t) AS VARCHAR), 9, '0'), t ] for t in list_distinct(w) ])]"

QUERIES = f"""
queries AS (
  SELECT item_id AS query_id,
         [t for t in ws if t NOT IN {STOP}] AS terms,
         [t for t in ws if t IN {STOP}] AS soft,
         CASE WHEN item_id % 5 = 0 AND len(w) > 1 THEN [w] ELSE [] END AS phrases,
         CASE WHEN item_id % 7 = 0 THEN w[-1:] ELSE [] END AS exclude,
         CASE WHEN item_id % 11 = 0 THEN 'src' || CAST(item_id % 20 AS VARCHAR) END AS author,
         CASE WHEN item_id % 6 = 0 THEN CAST({DAY} - 150 AS DATE) END AS since,
         CASE WHEN item_id % 6 = 1 THEN CAST({DAY} - 10 AS DATE) END AS before
  FROM (SELECT item_id, w, {_FIRST} AS ws FROM (SELECT item_id, {words('text')} AS w FROM benchmark)))"""

NEWS = rf"""
news AS (
  SELECT lang AS edition, doc_id AS item_id, {title_of('text')} AS title,
         'https://' || source || '.example.org/d/' || CAST(doc_id % 900 AS VARCHAR) AS url,
         source AS publisher, 'g' || CAST(n_chars % 5 AS VARCHAR) AS category,
         {AS_OF} - CAST(doc_id % 200 AS INTEGER) * INTERVAL 1 HOUR AS published,
         [source] AS topics,
         concat_ws(' ', regexp_extract(text, '^\s*\S+\s+(\S+)', 1), source) AS query, doc_id % 60 AS position
  FROM documents)"""

TREE = """
tree AS (
  SELECT topic, subtopic, topic || ' ' || subtopic AS name, list_sort(list(tag)) AS tags,
         topic || '/' || subtopic AS ord, false AS custom
  FROM (SELECT topic, subtopic, tag, row_number() OVER (PARTITION BY topic, subtopic ORDER BY n DESC, tag) AS r
        FROM (SELECT topic, subtopic, tag, count(*) AS n
              FROM (SELECT topic, subtopic, unnest(tags) AS tag FROM articles) GROUP BY ALL))
  WHERE r <= 5 GROUP BY topic, subtopic)"""


def with_(*parts: str) -> str:
    """WITH clause of the given parts, in order."""
    return "WITH " + ",".join(parts) + "\n"

NOTES = rf"""
notes AS (
  SELECT left(sha1({DOC_URL.replace('source', 'd.source').replace('doc_id', 'd.doc_id')}), 12) AS article_id, d.doc_id,
    CASE WHEN d.doc_id % 3 = 0 THEN {title_of('d.text')} ELSE '  ' END AS notes,
    CASE WHEN quality = 1 AND d.doc_id % 2 = 0 THEN {title_of('d.text')} END AS summary,
    CASE WHEN d.doc_id % 4 <> 1 THEN
      [{{'start': 40 - 10 * k, 'quote': string_split(d.text, chr(10))[k], 'note': CASE WHEN k = 2 THEN ' Check this ' END}}
       for k in range(1, len(string_split(d.text, chr(10))) + 1)] END AS highlights,
    {AS_OF} - CAST(d.doc_id AS INTEGER) * INTERVAL 1 HOUR AS edited
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

LIBQ = """
libq AS (
  SELECT item_id AS query_id, w AS plain, CASE WHEN item_id % 4 = 0 THEN p ELSE [] END AS phrases,
    CASE WHEN item_id % 3 = 0 THEN w[-1:] ELSE [] END AS minus
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w,
          regexp_extract_all(lower(text), '[a-z0-9]+(?: [a-z0-9]+)+') AS p FROM benchmark))"""


def walk(cap: int) -> str:
    """Diversify as a walk down the list: reads ``ls(list, rank, sig, grp)``, gives ``kept(list, rank, kept)``."""
    return f"""
walk AS (SELECT list, CAST(0 AS BIGINT) AS rank, CAST([] AS UBIGINT[]) AS sigs, CAST([] AS UBIGINT[]) AS grps, false AS kept FROM (SELECT DISTINCT list FROM ls)
  UNION ALL
  SELECT list, rank, CASE WHEN ok THEN list_append(sigs, s) ELSE sigs END, CASE WHEN ok AND g IS NOT NULL THEN list_append(grps, g) ELSE grps END, ok FROM (
    SELECT w.list, l.rank, w.sigs, w.grps, hash(l.sig) AS s, CASE WHEN l.grp <> '' THEN hash(l.grp) END AS g,
      NOT list_contains(w.sigs, hash(l.sig)) AND (coalesce(l.grp, '') = '' OR len([x for x in w.grps if x = hash(l.grp)]) < {cap}) AS ok
    FROM walk w JOIN ls l ON l.list = w.list AND l.rank = w.rank + 1)),
kept AS (SELECT list, rank, kept FROM walk WHERE rank > 0)"""


def signature(title: str) -> str:
    key = f"array_to_string(list_sort(list_distinct([{stem('w')} for w in {words(title)} if w NOT IN {STOP}])), ' ')"
    return f"CASE WHEN {key} <> '' THEN {key} ELSE lower(trim({title})) END"
