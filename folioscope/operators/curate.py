"""Curation: caps per subtopic, candidates, the add/rotate plan for every subtopic at once, and its bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text, urls
from ..session import stage
from .library import first_per_key
from .ranking import full_rank, interleave_sides, rotation_pairs, top_per_key
from .search import Index, match_modes
from .topics import assign_home, fitting_subtopics

KEYS = ["topic", "subtopic"]


def subtopic_caps(tree: DataFrame, counts: DataFrame, exhausted: DataFrame, *, goal: int = 0) -> DataFrame:
    """How many automatic articles each subtopic may hold.

    A topic's target is shared by the subtopics that still find candidates; what the exhausted ones hold is settled.
    ``counts``: topic, subtopic, n. ``exhausted``: topic, subtopic.
    """
    subs = (
        tree.select(*KEYS).distinct()
        .join(counts, KEYS, "left")
        .join(exhausted.select(*KEYS).distinct().withColumn("dry", F.lit(True)), KEYS, "left")
        .select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("dry", F.lit(False)).alias("dry"))
    )
    topics = tree.agg(F.greatest(F.lit(1), F.count_distinct("topic"))).scalar()
    target = F.lit(fixed.TOPIC_TARGET) + F.ceil(F.lit(goal) / topics)
    per_topic = subs.groupBy("topic").agg(
        F.sum(F.when(F.col("dry"), F.col("n")).otherwise(0)).alias("settled"),
        F.count_if(~F.col("dry")).alias("open"), F.count("*").alias("all"),
    )
    share = F.ceil(F.greatest(F.lit(0), target - F.col("settled")) / F.when(F.col("open") > 0, F.col("open")).otherwise(F.col("all")))
    return subs.join(per_topic, "topic").select(
        *KEYS, "n", "dry", F.greatest(F.lit(fixed.SUBTOPIC_MIN), share).cast("bigint").alias("cap"),
    ).withColumn("filling", (F.col("n") < F.col("cap")) & ~F.col("dry"))


def candidates(
    index: Index, phrased_tree: DataFrame, held: DataFrame, counts: DataFrame, *, limit: int | None = None, since=None,
    slug_text=None, scan: int | None = fixed.SCAN_LIMIT,
) -> DataFrame:
    """Best-rated posts matching any phrase of a subtopic, minus held ones: (topic, subtopic, url, rank).

    Only the best ``scan`` rows by priority and bm25 are looked at; the bound grows with what the subtopic holds. None: all
    rows are. ``limit`` cuts each subtopic's list; None: whole lists.
    ``slug_text``: column of the index's posts that must look English (default: the last URL segment).
    """
    words = F.transform("phrases", text.words)
    none = F.array().cast("array<string>")
    asked = phrased_tree.join(counts, KEYS, "left").select(
        F.concat_ws("/", *KEYS).alias("query_id"), *KEYS, (F.lit(scan or 0) + 8 * F.coalesce("n", F.lit(0))).alias("scan"),
        F.array_distinct(F.flatten(F.filter(words, lambda p: F.size(p) == 1))).alias("terms"), none.alias("soft"),
        F.filter(words, lambda p: F.size(p) > 1).alias("phrases"), none.alias("exclude"),
        F.lit(None).cast("string").alias("author"),
        (F.lit(since) if since is not None else F.lit(None)).cast("date").alias("since"),
        F.lit(None).cast("date").alias("before"),
    )
    # many joins read the subtopics, few as they are
    asked = stage(asked, "asked")
    queries = asked.drop(*KEYS, "scan")
    # equal priorities are ordered by plain bm25, in which every column weighs the same
    rows = match_modes(index, queries, weights=(1.0, 1.0)).filter("any").select("query_id", "post_id", F.round("bm", 6).alias("bm"))
    # what a post is by itself is told before its rows multiply: neither slugs nor whole texts travel
    slug = slug_text if slug_text is not None else F.replace(urls.last_segment("url"), F.lit("-"), F.lit(" "))
    docs = index.docs.select("post_id", "url", "prio", (text.is_ascii("url") & text.is_english_slug(slug)).alias("fit"))
    rows = rows.join(docs, "post_id").join(asked.select("query_id", *KEYS, "scan"), "query_id")
    if scan is None:
        seen = full_rank(rows, KEYS, ["-prio", "bm", "post_id"], "place")
    else:
        seen = top_per_key(rows, KEYS, [F.desc("prio"), F.asc("bm"), F.asc("post_id")], F.col("scan"), "place")
    allowed = seen.drop("scan").filter("fit").join(held.select("url").distinct(), "url", "left_anti")
    if limit is None:
        return full_rank(allowed, KEYS, ["place"]).select(*KEYS, "url", "prio", "rank")
    return top_per_key(allowed, KEYS, [F.asc("place")], limit).select(*KEYS, "url", "prio", "rank")


def tier(prio):
    """Priority tier a post is found in: 0 (>= 0.7), 1 (>= 0.5), 2 (any)."""
    return F.when(prio >= fixed.PRIORITY_TIERS[0], 0).when(prio >= fixed.PRIORITY_TIERS[1], 1).otherwise(2)


def candidate_union(recent: DataFrame, whole: DataFrame, tagged: DataFrame | None = None, *, thin: int = 40) -> DataFrame:
    """Recent candidates, then the whole window, then (only where those are few) tag matches; first place wins."""
    def part(df, no):
        return df.select(*KEYS, "url", F.struct(F.lit(no).alias("part"), F.col("rank").alias("rank")).alias("o"))

    both = part(recent, 0).unionByName(part(whole, 1))
    if tagged is not None:
        few = both.select(*KEYS, "url").distinct().groupBy(*KEYS).agg(F.count("*").alias("n"))
        asked = tagged.join(few, KEYS, "left").filter(F.coalesce("n", F.lit(0)) < thin)
        both = both.unionByName(part(asked.withColumn("rank", F.lit(0)), 2))
    return both.groupBy(*KEYS, "url").agg(F.min("o").alias("o")).select(*KEYS, "url", "o.part", "o.rank")


def good_candidates(pool: DataFrame, post_meta: DataFrame, phrased_tree: DataFrame, broad: DataFrame, articles: DataFrame,
                    as_of, *, member_only: bool = True) -> DataFrame:
    """Pool rows with a readable English page that is no reply, fits the subtopic and may be added, with their trend.

    A URL wanted by several subtopics stays with the first in tree order.
    """
    ok = (F.coalesce("title", F.lit("")) != "") & F.coalesce(F.col("lang") == "en", F.lit(True)) & ~F.coalesce("response", F.lit(False))
    meta = post_meta.filter(ok)
    if member_only:
        meta = meta.filter(F.col("locked") == F.lit(True))
    meta = meta.join(pool.select("url").distinct(), "url", "left_semi").join(articles.select("url").distinct(), "url", "left_anti")
    fits = fitting_subtopics(meta.select("url", "title", "tags"), phrased_tree, broad)
    rows = pool.select(*KEYS, "url").distinct().join(fits, [*KEYS, "url"])
    rows = first_per_key(rows, ["url"], [F.asc("ord")])
    trend = F.round(scoring.trend_score("claps", "published", as_of), 6)
    return rows.join(meta.select("url", "title", "author", "claps", "locked", "published"), "url").withColumn("trend", trend)


def curate_plan(good: DataFrame, articles: DataFrame, caps: DataFrame, as_of) -> DataFrame:
    """Change table: (topic, subtopic, action, url, step).

    The best candidates fill the free places; after that the k-th next one may replace the k-th weakest automatic
    article that was never downloaded, while each swap pays off. Outside filling, a subtopic changes six times at
    most. No more candidates can matter than there are free places and residents.
    """
    room = F.greatest(F.lit(0), F.col("cap") - F.col("n"))
    most = F.when(F.col("filling"), room + F.col("n")).otherwise(F.lit(fixed.CHANGES_PER_RUN))
    places = caps.select(*KEYS, "filling", room.alias("room"), most.alias("most"))
    ranked = top_per_key(good.join(places, KEYS), KEYS, [F.desc("trend"), F.asc("url")], F.col("most"), "step")
    ranked = stage(ranked.select(*KEYS, "url", "trend", "step", "room"), "ranked")
    added = ranked.filter(F.col("step") <= F.col("room"))
    waiting = ranked.filter(F.col("step") > F.col("room")).withColumn("rank", (F.col("step") - F.col("room")).cast("int"))

    old = articles.filter((F.col("source") == "auto") & F.col("pdf").isNull()).select(
        *KEYS, "id", F.col("url").alias("old_url"), F.round(scoring.trend_score("claps", "published", as_of), 6).alias("trend"))
    need = waiting.groupBy(*KEYS).agg(F.max("rank").alias("need"))
    weak = top_per_key(old.join(need, KEYS), KEYS, [F.asc("trend"), F.asc("id")], F.col("need"))
    swaps = rotation_pairs(waiting, weak.select(*KEYS, "rank", "trend", F.col("old_url").alias("id")), KEYS).filter("swap")

    def rows(df, action, url):
        return df.select(*KEYS, F.lit(action).alias("action"), F.col(url).alias("url"), F.col("step").cast("bigint").alias("step"))

    return rows(added, "add", "url").unionByName(rows(swaps, "rotate in", "url")).unionByName(rows(swaps, "rotate out", "drop_id"))


def bulk_goal_plan(good: DataFrame, caps: DataFrame, *, free: int, locked: int) -> DataFrame:
    """Adds towards a one-off goal of free and member-only articles: (topic, subtopic, url, locked, source, slot).

    Only known access counts. Each subtopic alternates the two kinds up to its free places; the quotas then are
    handed out over the subtopics in order. Nothing is ever replaced. Free rows are marked so that they stay.
    """
    known = good.filter(F.col("locked").isNotNull())
    slots = interleave_sides(known, KEYS, "locked", ["-trend", "url"])
    room = caps.select(*KEYS, F.greatest(F.lit(0), F.col("cap") - F.col("n")).alias("room"))
    numbered = full_rank(slots, KEYS, ["slot"], "place").join(room, KEYS).filter(F.col("place") <= F.col("room"))
    ranked = full_rank(numbered, ["locked"], ["topic", "subtopic", "place"], "turn")
    quota = F.when(F.col("locked"), F.lit(locked)).otherwise(F.lit(free))
    return ranked.filter(F.col("turn") <= quota).select(
        *KEYS, "url", "locked", F.when(F.col("locked"), "auto").otherwise("bulk").alias("source"), "slot")


def access_settle(articles: DataFrame, fetched: DataFrame, as_of) -> DataFrame:
    """Join freshly read pages (url, locked, claps): access and check date recorded, claps never go down, then purge.

    Only URLs present in ``fetched`` change; a null ``locked`` there means the page was refused.
    """
    today = F.to_date(F.lit(as_of).cast("timestamp"))
    f = fetched.select("url", F.col("locked").alias("_l"), F.col("claps").alias("_c"), F.lit(True).alias("_seen"))
    rows = articles.join(f, "url", "left")
    seen = F.coalesce("_seen", F.lit(False))
    rows = rows.select(
        *[c for c in articles.columns if c not in ("locked", "claps", "locked_checked")],
        F.when(seen, F.col("_l")).otherwise(F.col("locked")).alias("locked"),
        F.when(seen & F.col("claps").isNotNull(), F.greatest("claps", "_c")).otherwise(F.col("claps")).alias("claps"),
        F.when(seen, today).otherwise(F.col("locked_checked")).alias("locked_checked"), seen.alias("_seen"),
    )
    doomed = (F.col("source") == "auto") & (F.col("locked") == F.lit(False)) & F.col("pdf").isNull() & F.col("_seen")
    return rows.filter(~F.coalesce(doomed, F.lit(False))).drop("_seen")


def trending_suggestions(post_meta: DataFrame, articles: DataFrame, phrased_tree: DataFrame, broad: DataFrame, as_of, *, limit: int | None = 300) -> DataFrame:
    """Read posts outside the library with a home, by trend; ``limit=None``: all of them."""
    from .library import eligible

    rows = eligible(post_meta, articles)
    home = assign_home(rows, phrased_tree, broad)
    trend = F.round(scoring.trend_score("claps", "published", as_of), 2)
    rows = rows.drop("topic", "subtopic").join(home, "url").withColumn("trend", trend)
    rows = rows.orderBy(F.desc("trend"), F.asc("url"))
    return rows if limit is None else rows.limit(limit)


def shortage_report(caps: DataFrame, plan: DataFrame) -> DataFrame:
    """Subtopics below their cap for which the plan adds nothing; they count as settled next time."""
    active = plan.filter(F.col("action") != "rotate out").select(*KEYS).distinct()
    return caps.filter(F.col("n") < F.col("cap")).join(active, KEYS, "left_anti").select(*KEYS, "n", "cap")
