"""Operators over the saved library: filters, pages, counts, search, notebook, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..session import stage


def access_filter(df: DataFrame, access: str = "all", col: str = "locked") -> DataFrame:
    """all / free / locked; a row whose access is unknown is in neither of the last two."""
    if access == "free":
        return df.filter(F.col(col) == F.lit(False))
    if access == "locked":
        return df.filter(F.col(col) == F.lit(True))
    return df


def scope(articles: DataFrame, topic: str = "", subtopic: str = "", access: str = "all") -> DataFrame:
    if subtopic and not topic:
        raise ValueError("a subtopic needs its topic")
    if topic:
        articles = articles.filter(F.col("topic") == topic)
    if subtopic:
        articles = articles.filter(F.col("subtopic") == subtopic)
    return access_filter(articles, access)


def first_page(articles: DataFrame, order: list[Column], *, limit: int = 60, **where) -> DataFrame:
    """The first rows of a scope in stored order."""
    return scope(articles, **where).orderBy(*order).limit(max(1, min(limit, 100)))


def page(articles: DataFrame, order: list[Column], *, offset: int = 0, limit: int = 60, **where) -> DataFrame:
    """One page of a scope with the scope's total on every row. The sort keeps offset+limit rows at most."""
    rows = scope(articles, **where)
    total = rows.agg(F.count("*").alias("n"))
    offset, limit = max(0, min(offset, 1_000_000)), max(1, min(limit, 100))
    return rows.orderBy(*order).offset(offset).limit(limit).withColumn("total", total.scalar())


def counts(articles: DataFrame, tree: DataFrame) -> DataFrame:
    """total/free/locked/noted for the library, each topic and each subtopic.

    Declared subtopics without articles count zero; undeclared ones found in the data are included. The articles
    are reduced to one row per subtopic before the roll-up, so only a dimension-sized table is expanded.
    """
    measures = ["total", "free", "locked", "noted"]
    leaf = articles.groupBy(
        F.coalesce("topic", F.lit("")).alias("topic"), F.coalesce("subtopic", F.lit("")).alias("subtopic")
    ).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("locked") == F.lit(False)).alias("free"),
        F.count_if(F.col("locked")).alias("locked"),
        F.count_if(F.coalesce("notes_count", F.lit(0)) > 0).alias("noted"),
    )
    declared = tree.select("topic", "subtopic", *[F.lit(0).cast("bigint").alias(m) for m in measures])
    return (
        leaf.unionByName(declared)
        .rollup("topic", "subtopic")
        .agg(*[F.sum(m).alias(m) for m in measures], F.grouping_id().alias("g"))
        .select(
            F.when(F.col("g") == 3, "library").when(F.col("g") == 1, "topic").otherwise("subtopic").alias("level"),
            F.coalesce("topic", F.lit("")).alias("topic"),
            F.coalesce("subtopic", F.lit("")).alias("subtopic"),
            *measures,
        )
    )


def auto_counts(articles: DataFrame) -> DataFrame:
    """Automatically added rows per subtopic and per topic (subtopic '' is the topic's row)."""
    leaf = articles.filter(F.col("source") == "auto").groupBy("topic", "subtopic").agg(F.count("*").alias("n"))
    topics = leaf.groupBy("topic").agg(F.sum("n").alias("n"))
    return leaf.unionByName(topics.select("topic", F.lit("").alias("subtopic"), "n"))


def status(articles: DataFrame, visits: DataFrame) -> DataFrame:
    """Counts by origin and access, and the subtopic curated last. ``visits``: (subtopic_key, last)."""
    latest = visits.agg(F.max_by("subtopic_key", F.struct("last", "subtopic_key")).alias("k"))
    return articles.agg(
        F.count_if(F.col("source") == "auto").alias("auto_articles"),
        F.count_if(F.col("locked")).alias("member_only"),
        F.count_if(F.col("locked") == F.lit(False)).alias("free"),
    ).withColumn("last_subtopic", latest.scalar())


def index_status(posts: DataFrame) -> DataFrame:
    return posts.agg(
        F.count("*").alias("posts"), F.count_distinct("day").alias("days"),
        F.min("day").alias("oldest"), F.max("day").alias("newest"),
    )


def purge_candidates(articles: DataFrame) -> DataFrame:
    """Free rows that were added automatically and never downloaded."""
    return articles.filter((F.col("source") == "auto") & (F.col("locked") == F.lit(False)) & F.col("pdf").isNull())


def purge(articles: DataFrame) -> DataFrame:
    return articles.join(purge_candidates(articles).select("id"), "id", "left_anti")


def access_todo(articles: DataFrame, as_of, *, max_age_days: int | None = None) -> DataFrame:
    """Rows whose access still has to be looked up, oldest first.

    Default: never checked, or unknown and not checked today. With ``max_age_days`` (the batch variant): unknown
    and last checked longer ago than that. ``locked_checked`` null means never checked.
    """
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    unknown, checked = F.col("locked").isNull(), F.col("locked_checked")
    if max_age_days is None:
        todo = unknown & (checked.isNull() | (checked != today))
    else:
        todo = unknown & (checked.isNull() | (checked < F.date_sub(today, max_age_days)))
    return articles.filter(todo).orderBy(F.asc("added"), F.asc("id"))


def eligible(posts: DataFrame, articles: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Titled English (or unknown-language) posts that are no replies, not in the library and not dismissed."""
    ok = (F.coalesce("title", F.lit("")) != "") & F.coalesce(F.col("lang") == "en", F.lit(True))
    rows = posts.filter(ok & ~F.coalesce("response", F.lit(False)))
    return exclude_known(rows, articles, dismissed)


def exclude_known(posts: DataFrame, articles: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    known = articles.select("url")
    if dismissed is not None:
        known = known.unionByName(dismissed.select("url"))
    return posts.join(known.distinct(), "url", "left_anti")


def day_range(posts: DataFrame, since=None, before=None, col: str = "day") -> DataFrame:
    """Both ends inclusive."""
    if since is not None:
        posts = posts.filter(F.col(col) >= F.lit(since).cast("date"))
    if before is not None:
        posts = posts.filter(F.col(col) <= F.lit(before).cast("date"))
    return posts


def mark_saved(hits: DataFrame, articles: DataFrame) -> DataFrame:
    saved = articles.select("url").distinct().withColumn("_s", F.lit(True))
    return hits.join(saved, "url", "left").withColumn("saved", F.coalesce("_s", F.lit(False))).drop("_s")


def enrich(hits: DataFrame, post_meta: DataFrame) -> DataFrame:
    """Real title, snippet, claps, access from the page cache; author and date fall back to the hit."""
    m = post_meta.filter(F.coalesce("title", F.lit("")) != "").select(
        "url", F.lit(True).alias("_m"),
        *[F.col(c).alias("_" + c) for c in ("title", "snippet", "author", "claps", "locked", "published")],
    )
    known = F.col("_m").isNotNull()
    return hits.join(m, "url", "left").select(
        *[c for c in hits.columns if c not in ("title", "author", "published", "snippet", "claps", "locked")],
        F.coalesce("_title", "title").alias("title"),
        F.when(known, F.coalesce("_snippet", F.lit(""))).alias("snippet"),
        F.coalesce(F.nullif("_author", F.lit("")), "author", F.lit("")).alias("author"),
        F.coalesce("_published", "published").alias("published"),
        F.col("_claps").alias("claps"), F.col("_locked").alias("locked"),
    )


def available_files(articles: DataFrame, files: DataFrame) -> DataFrame:
    """Links to the saved document and PDF, only where the file is in the manifest (``path``)."""
    have = files.select("path").distinct()
    pdf = have.select(F.col("path").alias("pdf"), F.lit(True).alias("_pdf"))
    doc = have.select(F.col("path").alias("doc"), F.lit(True).alias("_doc"))
    out = articles.join(pdf, "pdf", "left").join(doc, "doc", "left")
    return (
        out.withColumn("pdf_url", F.when(F.col("_pdf"), F.concat(F.lit("/files/"), "pdf")))
        .withColumn("doc_url", F.when(F.col("_doc"), F.concat(F.lit("/files/"), "doc")))
        .drop("_pdf", "_doc")
    )


def new_since(rows: DataFrame, last_visit: DataFrame) -> DataFrame:
    """Flag rows added automatically after the reader's last visit; nothing is new on a first visit."""
    flag = (F.col("source") == "auto") & (F.col("added") > F.col("last_visit"))
    return rows.join(last_visit, "reader", "left").withColumn("is_new", F.coalesce(flag, F.lit(False)))


def suggestion_facets(suggestions: DataFrame, topic: str = "") -> DataFrame:
    """all/free/locked counts in the topic scope plus, for every topic with suggestions, its count."""
    leaf = suggestions.groupBy("topic").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("locked") == F.lit(False)).alias("free"),
        F.count_if(F.col("locked")).alias("locked"),
    )
    scoped = leaf.filter(F.col("topic") == topic) if topic else leaf
    head = scoped.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "free", "locked")])
    return leaf.select(F.lit("topic").alias("facet"), "topic", "total", "free", "locked").unionByName(
        head.select(F.lit("scope").alias("facet"), F.lit(topic).alias("topic"), "total", "free", "locked")
    )


def insert_new(articles: DataFrame, incoming: DataFrame, order: list[Column]) -> DataFrame:
    """Incoming rows whose normalised URL is not in the library, one per URL (first by ``order``)."""
    rows = incoming.withColumn("url", urls.normalize_url("url")).filter(F.col("url").isNotNull())
    first = first_per_key(rows, ["url"], order)
    return first.join(articles.select("url").distinct(), "url", "left_anti").withColumn("id", urls.article_id("url"))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of each key. A rank limit of one runs before the shuffle, so copies of a key never gather."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")


def discover_merge(feed_items: DataFrame, feed_order: str = "feed_ord") -> DataFrame:
    """Several feeds as one list: the first feed that carries a URL wins; newest first."""
    return first_per_key(feed_items, ["url"], [F.asc(feed_order)]).orderBy(
        F.desc_nulls_last("published"), F.asc(feed_order)
    )


def merge_tree(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """Stored topic tree plus the default topics and subtopics it lacks; nothing stored is overwritten."""
    extra = defaults.join(stored.select("topic", "subtopic").distinct(), ["topic", "subtopic"], "left_anti")
    return stored.unionByName(extra)


# ---------------------------------------------------------------- notes


def notes_count(highlights="highlights", notes="notes", summary="summary") -> Column:
    def filled(c):
        return (F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")) != "").cast("bigint")

    n = F.coalesce(F.size(highlights), F.lit(0))
    return F.greatest(n, F.lit(0)).cast("bigint") + filled(notes) + filled(summary)


def notebook(articles: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes of live articles that hold anything, newest edit first."""
    rows = notes.withColumn("notes_count", notes_count()).filter(F.col("notes_count") > 0)
    live = articles.select(F.col("id").alias("article_id"), "title", "author", "url")
    return rows.join(live, "article_id").orderBy(F.desc("edited"), F.asc("article_id"))


def notebook_filter(entries: DataFrame, text: str) -> DataFrame:
    """Case-insensitive contains over title, author, summary, notes and every quote and comment."""
    q = text.strip().lower()
    if not q:
        return entries

    def has(c):
        return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(q))

    anywhere = has(F.col("title")) | has(F.col("author")) | has(F.col("summary")) | has(F.col("notes"))
    return entries.filter(anywhere | F.exists("highlights", lambda h: has(h["quote"]) | has(h["note"])))


def entry_markdown() -> Column:
    """One notebook entry as Markdown, highlights in document order."""

    def block(title, body):
        text = F.trim(F.coalesce(body, F.lit("")))
        return F.when(text != "", F.array(F.lit(title), text, F.lit(""))).otherwise(F.array().cast("array<string>"))

    ordered = F.array_sort(
        F.transform("highlights", lambda h, i: F.struct(h["start"].alias("s"), i.alias("i"), h["quote"].alias("q"),
                                                        h["note"].alias("n")))
    )
    quotes = F.transform(
        ordered,
        lambda h: F.concat(
            F.array(F.concat(F.lit("> "), F.regexp_replace(h["q"], r"\s*\n+\s*", " "))),
            F.when(F.trim(F.coalesce(h["n"], F.lit(""))) != "", F.array(F.lit(""), F.trim(h["n"])))
            .otherwise(F.array().cast("array<string>")),
            F.array(F.lit("")),
        ),
    )
    head = F.array(F.concat(F.lit("# "), F.col("title")), F.col("url"), F.lit(""))
    return F.array_join(
        F.concat(head, block("## Summary", F.col("summary")), block("## Notes", F.col("notes")), F.flatten(quotes)), "\n"
    )


# ---------------------------------------------------------------- saved-library search


def library_search(queries: DataFrame, articles: DataFrame, *, limit: int = 20) -> DataFrame:
    """Substring search over title, author, snippet, topic and subtopic for many queries at once.

    ``queries``: query_id, plain array, phrases array<string> (words joined by a blank), minus array. A query word
    is letters and digits only, so it can only occur inside one run of letters and digits of the text: the words
    are matched against the vocabulary of runs, and the runs against the articles, both by equality joins.
    """
    limit = max(1, min(limit, 100))
    q = queries.select(
        "query_id", "plain", "phrases", "minus",
        F.concat("plain", F.flatten(F.transform("phrases", lambda p: F.split(p, " ")))).alias("words"),
    ).filter(F.size("words") > 0)

    low = articles.select(
        "id", "added", "fetched",
        F.lower(F.coalesce("title", F.lit(""))).alias("title"),
        F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("author", "snippet", "topic", "subtopic")]))
        .alias("rest"),
    )

    def runs(c):
        return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), F.lit(0)))

    # a run carries its place, not the title: a needle's first place lies in the first place of some run that holds it
    in_title = low.select("id", F.explode(runs("title")).alias("run"), "title").select("id", "run", F.instr(F.col("title"), F.col("run")).alias("run_at"))
    in_rest = low.select("id", F.explode(runs("rest")).alias("run"), F.lit(None).cast("int").alias("run_at"))
    found = in_title.unionByName(in_rest)

    # one row per query and distinct word: how often it counts, and in which role
    flat = q.select(
        "query_id", "plain", "words", "minus", F.flatten(F.transform("phrases", lambda p: F.split(p, " "))).alias("pw"),
        F.explode(F.array_distinct(F.concat("words", "minus"))).alias("needle"),
    )

    def times(c):
        return F.size(F.filter(c, lambda w: w == F.col("needle")))

    by_query = flat.select(
        "query_id", "needle", times("words").alias("w"), times("plain").alias("p"),
        F.array_contains("minus", F.col("needle")).alias("banned"), F.array_contains("pw", F.col("needle")).cast("int").alias("ph"),
    )
    by_query = stage(by_query, "needles")
    needles = by_query.select("needle").distinct()
    vocabulary = low.select(F.explode(F.array_union(runs("title"), runs("rest"))).alias("run")).distinct()

    def grams(c, n):
        return F.regexp_extract_all(c, F.lit("(?=(.{%d}))" % n), F.lit(1))

    probe = needles.select("needle", F.substring("needle", 1, 3).alias("gram"))
    run_grams = vocabulary.select(
        "run", F.explode(F.array_distinct(F.concat(grams("run", 1), grams("run", 2), grams("run", 3)))).alias("gram")
    )
    pairs = run_grams.join(probe, "gram").filter(F.contains("run", F.col("needle"))).select("run", "needle").distinct()
    pairs = stage(pairs, "runs")

    # an article's runs collapse to the needles it holds, and where in the title, before they meet the queries at the article
    at = F.col("run_at") + F.instr(F.col("run"), F.col("needle")) - 1
    held = found.join(pairs, "run").select("id", "needle", at.alias("at")).repartition("id").groupBy("id", "needle").agg(F.min("at").alias("at"))
    there, asked = F.col("at").isNotNull(), F.col("p") > 0
    hits = (
        held.join(by_query, "needle")
        .groupBy("query_id", "id")
        .agg(
            F.sum("w").alias("n_any"), F.sum(F.when(there, F.col("w")).otherwise(0)).alias("n_title"),
            F.sum(F.when(there, F.col("p")).otherwise(0)).alias("n_order"),
            F.min(F.when(asked, F.col("at"))).alias("lo"), F.max(F.when(asked, F.col("at"))).alias("hi"),
            F.max("banned").alias("banned"), F.sum("ph").alias("n_ph"),
        )
        .filter((F.col("n_any") > 0) & ~F.col("banned"))
    )
    shape = q.select(
        "query_id", F.size("words").alias("n"), "phrases",
        F.size(F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.split(p, " "))))).alias("need_ph"),
    )
    rows = hits.join(shape, "query_id").filter(F.col("n_ph") >= F.col("need_ph"))
    narrow = low.select("id", "added", "fetched")
    zero = F.lit(0).alias("title_phrases")
    plain_rows = rows.filter(F.size("phrases") == 0).join(narrow, "id").withColumn("title_phrases", zero)
    with_phrases = (
        rows.filter(F.size("phrases") > 0).join(low, "id")
        .filter(F.forall("phrases", lambda p: F.contains("title", p) | F.contains("rest", p)))
        .withColumn("title_phrases", F.size(F.filter("phrases", lambda p: F.contains("title", p))))
        .drop("title", "rest")
    )
    ordered = F.when(F.col("n_order") > 1, F.col("n_order") / (F.col("hi") - F.col("lo") + 1)).otherwise(F.lit(0.0))
    score = (
        2.5 * F.col("n_any") / F.col("n") + 1.2 * F.col("n_title") / F.col("n") + 0.6 * ordered
        + 0.5 * F.col("title_phrases") + 0.3 * F.coalesce(F.col("fetched"), F.lit(False)).cast("int")
    )
    scored = plain_rows.unionByName(with_phrases).select("query_id", "id", "added", F.round(F.round(score, 9), 4).alias("score"))
    scored = stage(scored, "library-hits")
    totals = scored.groupBy("query_id").agg(F.count("*").alias("total"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("added"), F.asc("id"))
    top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
    return top.join(totals, "query_id").select("query_id", "rank", "id", "score", "total")
