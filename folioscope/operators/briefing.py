"""News briefings for many editions at once: score, merge, boost, cluster, diverse picks.

Items: edition, item_id, title, url, publisher, category, published, topics array<string>, score, arrival.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..session import stage
from .library import first_per_key
from .ranking import full_rank, top_per_key


def feed_score(title, query, published, end, position) -> Column:
    """Fresh, on topic and high in its feed: 4*exp(-age/36h) + 2*share of query words + 1/(1+position/5)."""
    hours = (F.unix_micros(end) - F.unix_micros(published)) / 3600e6
    q = text.headline_words(query)
    share = F.size(F.array_intersect(text.headline_words(title), q)) / F.greatest(F.lit(1), F.size(q))
    return 4 * F.exp(-hours / 36) + 2 * share + 1 / (1 + position / F.lit(5.0))


def window_items(items: DataFrame, start, end) -> DataFrame:
    """Items with a title, a plain http(s) link and a date within [start, end], both ends included."""
    ok_url = F.col("url").rlike(r"^https?://[^/?#@]+([/?#]|$)")
    at = F.col("published")
    inside = (at >= F.lit(start).cast("timestamp")) & (at <= F.lit(end).cast("timestamp"))
    return items.filter(ok_url & inside & (F.trim("title") != ""))


def cap_per_feed(items: DataFrame, feed: list[str], position: str = "position") -> DataFrame:
    """The first forty items of every feed."""
    return top_per_key(items, feed, [F.asc(position)], fixed.FEED_ITEMS, "_r").drop("_r")


def strip_source(title, source) -> Column:
    """Drop a trailing " - source"."""
    tail = F.concat(F.lit(" - "), source)
    return F.when(F.endswith(title, tail), F.trim(F.left(title, F.length(title) - F.length(tail)))).otherwise(title)


def interest_vocabulary(tree: DataFrame) -> DataFrame:
    """Distinct headline words of topic names, subtopic names and tags."""
    names = F.array("topic", "name")
    texts = F.concat(names, F.transform("tags", lambda t: F.replace(t, F.lit("-"), F.lit(" "))))
    words = tree.select(F.explode(texts).alias("t")).select(F.explode(text.headline_words("t")).alias("word"))
    return words.distinct()


def merge(items: DataFrame) -> DataFrame:
    """One row per story: first by URL, then by the set of headline words (when there are any).

    The best-scored copy stays (the earlier one on a tie) with the union of the topics. Both steps are partial
    aggregations, so a story with millions of copies never gathers; topics are a set, not a list of the copies.
    """
    def step(df, key):
        best = F.max_by(
            F.struct("item_id", "title", "url", "publisher", "category", "published", "score"),
            F.struct(F.round("score", 6).alias("s"), (-F.col("arrival")).alias("a")),
        )
        base = df.groupBy("edition", key).agg(best.alias("b"), F.min("arrival").alias("arrival"))
        topics = (
            df.select("edition", key, F.explode("topics").alias("topic")).distinct()
            .groupBy("edition", key).agg(F.array_sort(F.collect_list("topic")).alias("topics"))
        )
        return base.join(topics, ["edition", key], "left").select(
            "edition", "b.*", F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), "arrival")

    by_url = step(items.withColumn("k1", F.col("url")), "k1")
    words = F.array_join(F.array_sort(text.headline_words("title")), " ")
    return step(by_url.withColumn("k2", F.when(words != "", words).otherwise(F.concat(F.lit("\x00"), "url"))), "k2")


def interest_boost(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds 1.6 * min(1, hits/2) for headline words the reader follows; keeps the score before it."""
    words = items.select("edition", "item_id", F.explode(text.headline_words("title")).alias("word"))
    hits = words.join(vocabulary, "word", "left_semi").groupBy("edition", "item_id").agg(F.count("*").alias("hits"))
    rows = items.join(hits, ["edition", "item_id"], "left").withColumn("interest_hits", F.coalesce("hits", F.lit(0)))
    return rows.drop("hits").withColumn("base_score", F.col("score")).withColumn(
        "score", F.col("score") + fixed.INTEREST_BOOST * F.least(F.lit(1.0), F.col("interest_hits") / 2))


# ---------------------------------------------------------------- clustering


SHORT, MEDIUM = 16, 40  # sizes up to which three and two words make a key; longer sets use single words


def _shared_needed(n: int, threshold: float) -> int:
    """Fewest common words of two similar sets of which the larger has n words."""
    return max(1, math.ceil(threshold * n - 1e-9))


def _key_width(n: int, threshold: float) -> int:
    """Words per blocking key for pairs whose larger set has n words: more for short titles, fewer for long ones."""
    return min(_shared_needed(n, threshold), 3 if n <= SHORT else 2 if n <= MEDIUM else 1)


def blocking_keys(words: Column, threshold: float) -> Column:
    """Keys of a word list ordered from rare to frequent, such that similar sets share at least one key.

    Two sets with Jaccard >= t share k words among the first n - ceil(t*n) + k of each. A key is k of those words;
    k depends on the size of the larger set of the pair, so a set carries keys for every size it can meet.
    """
    n = F.size(words)
    none = F.array().cast("array<string>")
    sizes: dict[int, list[int]] = {1: [], 2: [], 3: []}
    for size in range(1, MEDIUM + 1):
        for k in {_key_width(m, threshold) for m in range(size, int(size / threshold + 1e-9) + 1)}:
            sizes[k].append(size)
    keys = []
    for k, wanted in sizes.items():
        head = F.slice(words, F.lit(1), (n - F.greatest(F.lit(1), F.ceil(threshold * n - 1e-9)) + k).cast("int"))
        asked = n.isin(wanted) if wanted else F.lit(False)
        if k == 1:
            asked = asked | (n > MEDIUM)
        keys.append(F.when(asked, _combinations(head, k)).otherwise(none))
    return F.array_distinct(F.concat(*keys))


def _combinations(words: Column, k: int) -> Column:
    """All k-word keys of a short list, in list order, prefixed by k."""
    name = lambda *parts: F.concat_ws(" ", F.lit(str(k)), F.concat_ws(" ", F.array_sort(F.array(*parts))))
    if k == 1:
        return F.transform(words, lambda a: name(a))

    def after(i):
        return F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0)))

    if k == 2:
        return F.flatten(F.transform(words, lambda a, i: F.transform(after(i), lambda b: name(a, b))))
    return F.flatten(F.transform(words, lambda a, i: F.flatten(F.transform(
        after(i), lambda b, j: F.transform(
            F.slice(words, i + j + 3, F.greatest(F.size(words) - i - j - 2, F.lit(0))), lambda c: name(a, b, c))))))


def _lead_in_order(rows: DataFrame) -> DataFrame:
    """(edition, rank) of those that lead when each edition is walked once: nobody in ``leads`` (closer, better ranks) leads."""

    def walk(batches):
        current, leading = object(), set()
        for batch in batches:
            keep = []
            for i, (edition, rank, leads) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)))):
                if edition != current:
                    current, leading = edition, set()
                if leading.isdisjoint(leads):
                    leading.add(rank)
                    keep.append(i)
            yield batch.select(["edition", "rank"]).take(pa.array(keep, pa.int64()))

    rows = rows.select("edition", "rank", "leads")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:2])
    return rows.repartition("edition").sortWithinPartitions("edition", "rank").mapInArrow(walk, kinds)


def leader_cluster(items: DataFrame, threshold: float = fixed.CLUSTER_SIMILARITY, *, rounds: int = 8) -> DataFrame:
    """Cluster each edition's headlines: in rank order, join the first leader that is close enough, else lead.

    Items need ``rank`` (1 = best) and ``title``; adds ``leader`` (the leader's rank) and ``related`` (members - 1).
    Headlines with the same words are one unit. Then, in at most ``rounds`` rounds, a unit that is the best open one under
    all of its keys becomes a leader, and the open units close to a new leader become members. A key never pairs its units
    with each other, only with its one new leader, so a crowd of near copies costs one row per copy and key. Units that
    wait longer (chains in which each is close to the next) get their edges once, and their leaders, the first
    independent set of that graph, come from one walk in rank order. Finally every member takes the best of the leaders
    it is close to.
    """
    rows = stage(items.withColumn("_w", F.array_sort(text.headline_words("title"))), "headlines")
    unit_of = rows.select("edition", "rank", F.array_join("_w", " ").alias("u"), "_w")
    units = unit_of.groupBy("edition", "u").agg(F.min("rank").alias("rank"), F.first("_w").alias("w"))
    # headlines without words are never close to anything, not even to each other
    empty = unit_of.filter(F.col("u") == "").select("edition", "rank", F.col("rank").alias("leader"))
    units = units.filter(F.col("u") != "")
    df = units.select("edition", F.explode("w").alias("x")).groupBy("edition", "x").agg(F.count("*").alias("df"))
    ordered = (
        units.select("edition", "rank", F.explode("w").alias("x")).join(df, ["edition", "x"])
        .groupBy("edition", "rank").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
        .select("edition", "rank", F.transform("o", lambda s: s["x"]).alias("w"))
    )
    keyed = stage(ordered, "units")
    every_key = keyed.select("edition", "rank", F.explode(blocking_keys(F.col("w"), threshold)).alias("key"))
    # keys travel as hashes; a key that belongs to one unit alone decides nothing
    every_key = every_key.withColumn("key", F.xxhash64("key"))
    met = every_key.groupBy("edition", "key").agg(F.count("*").alias("n")).filter("n > 1").select("edition", "key")
    keys = stage(every_key.join(met, ["edition", "key"], "left_semi"), "keys")

    def similar(pairs):
        """Pairs (edition, rank, lead) whose words are close enough."""
        other = keyed.select("edition", F.col("rank").alias("lead"), F.col("w").alias("lw"))
        return (
            pairs.distinct().join(other, ["edition", "lead"]).join(keyed.select("edition", "rank", "w"), ["edition", "rank"])
            .filter(text.jaccard("w", "lw") >= threshold).select("edition", "rank", "lead")
        )

    open_units, by_key = keyed.select("edition", "rank"), keys
    leaders = open_units.limit(0)
    for _ in range(rounds):
        first = by_key.groupBy("edition", "key").agg(F.min("rank").alias("lead"))
        behind = by_key.join(first, ["edition", "key"]).filter(F.col("lead") < F.col("rank")).select("edition", "rank", "lead").distinct()
        behind = stage(behind, "behind")
        new = open_units.join(behind.select("edition", "rank").distinct(), ["edition", "rank"], "left_anti")
        new = stage(new, "leaders")
        leaders = leaders.unionByName(new)
        near = similar(behind.join(new.withColumnRenamed("rank", "lead"), ["edition", "lead"]).select("edition", "rank", "lead"))
        open_units = stage(open_units.join(new, ["edition", "rank"], "left_anti").join(
            near.select("edition", "rank").distinct(), ["edition", "rank"], "left_anti"), "open")
        if open_units.isEmpty():
            break
        by_key = keys.join(open_units, ["edition", "rank"], "left_semi")
    else:
        edges = similar(by_key.join(by_key.withColumnRenamed("rank", "lead"), ["edition", "key"]).filter(
            F.col("lead") < F.col("rank")).select("edition", "rank", "lead"))
        lists = edges.groupBy("edition", "rank").agg(F.collect_list("lead").alias("leads"))
        none = F.array().cast(lists.schema["leads"].dataType)
        leaders = leaders.unionByName(stage(_lead_in_order(
            open_units.join(lists, ["edition", "rank"], "left").withColumn("leads", F.coalesce("leads", none))), "leaders"))
    lead_keys = keys.join(leaders, ["edition", "rank"], "left_semi").withColumnRenamed("rank", "lead")
    members = keys.join(leaders, ["edition", "rank"], "left_anti")
    pairs = similar(members.join(lead_keys, ["edition", "key"]).filter(F.col("lead") < F.col("rank")).select("edition", "rank", "lead"))
    found = pairs.groupBy("edition", "rank").agg(F.min("lead").alias("leader")).unionByName(
        leaders.select("edition", "rank", F.col("rank").alias("leader")))
    per_unit = units.select("edition", "u", "rank").join(found, ["edition", "rank"]).select("edition", "u", "leader")
    cluster = (
        unit_of.filter(F.col("u") != "").select("edition", "rank", "u").join(per_unit, ["edition", "u"])
        .select("edition", "rank", "leader").unionByName(empty)
    )
    out = rows.drop("_w").join(cluster, ["edition", "rank"])
    size = cluster_size(out)
    return out.join(size, ["edition", "leader"])


def cluster_size(clustered: DataFrame) -> DataFrame:
    """(edition, leader, related): members besides the one shown."""
    return clustered.groupBy("edition", "leader").agg((F.count("*") - 1).alias("related"))


# ---------------------------------------------------------------- picks


def diverse_pick(items: DataFrame, n: int = fixed.SHORTLIST) -> DataFrame:
    """``n`` items of each edition, at most one per cluster, with falling scores for repeated categories and publishers.

    Each round adds every edition's best item under the penalties so far, by one aggregation over all items; what
    was chosen travels as a short row per edition. Items: edition, rank, score, category, publisher, leader.
    Adds ``pick`` (1..n).
    """
    # within a category, publisher and cluster only the best item can be picked
    slim = first_per_key(
        items.select("edition", "rank", F.round("score", 6).alias("score"), "category", F.lower("publisher").alias("publisher"), "leader"),
        ["edition", "category", "publisher", "leader"], [F.asc("rank")],
    )
    # and of these at most n clusters per category and publisher, because n - 1 earlier picks can use up n - 1
    slim = top_per_key(slim, ["edition", "category", "publisher"], [F.asc("rank")], n, "_r").drop("_r")
    slim = stage(slim, "pickable")
    text_list = F.array().cast("array<string>")
    state = slim.select("edition").distinct().select(
        "edition", text_list.alias("cats"), text_list.alias("pubs"),
        F.array().cast(f"array<{slim.schema['leader'].dataType.simpleString()}>").alias("used"),
        F.array().cast(f"array<{slim.schema['rank'].dataType.simpleString()}>").alias("picked"),
    )
    for _ in range(n):
        rows = slim.join(state, "edition")
        again = lambda seen, value: F.size(F.filter(seen, lambda x: x == value))
        adjusted = (
            F.col("score") - fixed.CATEGORY_PENALTY * again(F.col("cats"), F.col("category"))
            - fixed.PUBLISHER_PENALTY * again(F.col("pubs"), F.col("publisher"))
        )
        free = ~F.array_contains("used", F.col("leader"))
        best = F.max_by(
            F.struct("rank", "category", "publisher", "leader"),
            F.when(free, F.struct(F.round(adjusted, 6).alias("s"), (-F.col("rank")).alias("r"))),
        )
        chosen = rows.groupBy("edition", "cats", "pubs", "used", "picked").agg(best.alias("b"))
        got = F.col("b").isNotNull()

        def more(name, field):
            return F.when(got, F.array_append(name, F.col("b")[field])).otherwise(F.col(name)).alias(name)

        state = chosen.select("edition", more("cats", "category"), more("pubs", "publisher"), more("used", "leader"), more("picked", "rank"))
    picks = state.select("edition", F.posexplode("picked").alias("p", "rank")).select("edition", "rank", (F.col("p") + 1).alias("pick"))
    return items.join(picks, ["edition", "rank"])


def reason_text(topic, hits, related) -> Column:
    focus = F.when(hits > 0, "topics you follow").otherwise("a mix of topics and publishers")
    extra = F.when(related > 0, " Related coverage was grouped so one story does not crowd out the rest.").otherwise("")
    return F.concat(F.lit("Recent coverage of "), topic, F.lit("; selected for freshness, relevance, and "), focus, F.lit("."), extra)


def ranked_items(items: DataFrame) -> DataFrame:
    """Items with their place in the edition by rounded score, then URL."""
    rows = items.withColumn("score", F.round("score", 6))
    return full_rank(rows, ["edition"], ["-score", "url"], "rank")


def select_briefing(items: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Merge, boost, cluster and pick: the shortlist of each edition with its reading picks marked."""
    ranked = ranked_items(interest_boost(merge(items), vocabulary))
    clustered = stage(leader_cluster(ranked), "clustered")
    short = stage(diverse_pick(clustered, fixed.SHORTLIST).withColumnRenamed("pick", "place"), "shortlist")
    best = diverse_pick(short, fixed.PICKS).select("edition", "rank", F.col("pick").alias("reading_pick"))
    rows = short.join(best, ["edition", "rank"], "left")
    return rows.withColumn("score", F.round("score", 3)).withColumn(
        "reason", reason_text(F.get("topics", F.lit(0)), F.col("interest_hits"), F.col("related")))


def feed_scan_report(feeds: DataFrame, picks: DataFrame) -> DataFrame:
    """Per edition: topics scanned, succeeded, failed, the outcome and its message.

    ``feeds``: edition, topic, ok boolean. ``picks``: edition rows of the reading picks.
    """
    scanned = feeds.groupBy("edition").agg(
        F.count("*").alias("scanned"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"))
    n = picks.groupBy("edition").agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0))
    return scanned.join(n, "edition", "left").select(
        "edition", "scanned", "succeeded", "failed",
        F.when(count > 0, "complete").otherwise("error").alias("state"),
        F.when(count == 0, "No dated articles found in this window. Try a wider window or retry when the news source is available.")
        .when(count < fixed.PICKS, "Fewer than five distinct recent stories were available. Showing only verified feed results.")
        .otherwise("Your five reading picks are ready.").alias("message"),
    )
