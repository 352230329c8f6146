"""Recommendations: candidate pool, scores, explanations and the shape of a page, for all readers in one plan.

Only pairs of a reader and a post that share a label, a title word or an author are ever built. What a post scores
without sharing anything does not depend on the reader, so it is kept once per post.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, scoring, text
from ..session import stage
from . import blocks
from .library import first_per_key
from .ranking import diversify, top_per_key
from .topics import assign_home, labels_of


def pool_union(cached: DataFrame, indexed: DataFrame | None) -> DataFrame:
    """Posts from the page cache and from the index; a post in both keeps its cached row."""
    rows = cached.withColumn("cached", F.lit(True))
    if indexed is None:
        return rows
    rows = rows.unionByName(indexed.withColumn("cached", F.lit(False)), allowMissingColumns=True)
    return first_per_key(rows, ["url"], [F.desc("cached")])


def candidate_pool(
    cached: DataFrame, phrased_tree: DataFrame, broad: DataFrame, *, indexed: DataFrame | None = None,
    locked: bool | None = None, want: list[str] | None = None,
) -> DataFrame:
    """Eligible posts with home and labels.

    Index rows say nothing about access, so they only take part when no access is asked for. ``want`` keeps posts
    that carry at least one of the labels.
    """
    ok = (F.coalesce("title", F.lit("")) != "") & F.coalesce(F.col("lang") == "en", F.lit(True))
    rows = cached.filter(ok & ~F.coalesce("response", F.lit(False)))
    if locked is not None:
        rows = rows.filter(F.col("locked") == F.lit(locked))
        indexed = None
    home = assign_home(rows, phrased_tree, broad).withColumnsRenamed({"topic": "home_topic", "subtopic": "home_subtopic"})
    rows = rows.join(home, "url", "left")
    pool = pool_union(rows, indexed).withColumn("labels", labels_of("tags", "home_topic", "home_subtopic"))
    if want:
        pool = pool.filter(F.arrays_overlap("labels", text.strings(want)))
    return pool


def index_candidates(seeds: DataFrame, phrased_tree: DataFrame, index, as_of, *, rows: int = fixed.SEED_ROWS) -> DataFrame:
    """Recent index posts for each reader's seed subtopics: (reader, url, topic, subtopic, prio, ...).

    A subtopic's query does not depend on the reader, so each subtopic is searched once, whoever asks.
    """
    from .search import search

    wanted = phrased_tree.join(seeds.select("topic", "subtopic").distinct(), ["topic", "subtopic"], "left_semi")
    split = F.transform(F.slice("phrases", 1, fixed.SEED_PHRASES), text.words)
    none = F.array().cast("array<string>")
    day = F.date_sub(F.to_date(F.lit(as_of).cast("timestamp")), fixed.SEED_DAYS)
    queries = wanted.select(
        F.concat_ws("/", "topic", "subtopic").alias("query_id"),
        F.array_distinct(F.flatten(F.filter(split, lambda p: F.size(p) == 1))).alias("terms"), none.alias("soft"),
        F.filter(split, lambda p: F.size(p) > 1).alias("phrases"), none.alias("exclude"),
        F.lit(None).cast("string").alias("author"), day.alias("since"), F.lit(None).cast("date").alias("before"),
    )
    hits = search(queries, index, as_of, page_size=rows, mode="any", author_cap=fixed.MAX_PER_AUTHOR)
    hits = hits.join(index.docs.select("post_id", "title", "prio"), "post_id").filter(text.is_english_slug("title"))
    per_reader = seeds.select("reader", F.concat_ws("/", "topic", "subtopic").alias("query_id"), "topic", "subtopic",
                              F.col("rank").alias("seed_rank"))
    found = hits.join(per_reader, "query_id")
    return first_per_key(found, ["reader", "url"], [F.asc("seed_rank")]).select(
        "reader", "post_id", "url", "title", "author", "published", "prio", "topic", "subtopic")


# ---------------------------------------------------------------- scoring


def label_idf(pool: DataFrame) -> DataFrame:
    """ln((n+1)/(df+1))+1 per label over distinct label sets."""
    n = pool.agg(F.greatest(F.lit(1), F.count("*"))).scalar()
    df = pool.select(F.explode(F.array_distinct("labels")).alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    return df.select("key", (F.log((n + 1) / (F.col("df") + 1)) + 1.0).alias("idf"))


def vector_norm(vectors: DataFrame, owner: list[str], weight: str = "weight", out: str = "norm") -> DataFrame:
    return vectors.groupBy(*owner).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias(out))


def post_scores(pool: DataFrame, as_of) -> DataFrame:
    """What a post scores for any reader: quality, freshness and the bonus of a complete card."""
    trend = scoring.trend_score("claps", "published", as_of)
    best = pool.filter("cached").agg(F.max(F.log1p(trend))).scalar()
    scale = F.coalesce(F.when(best > 0, best), F.lit(1.0))
    quality = F.when(F.col("cached"), F.log1p(trend) / scale).otherwise(0.6 * scoring.priority_share("prio"))
    w = fixed.RECOMMEND_WEIGHTS
    base = (
        w["quality"] * F.least(F.lit(1.0), quality) + w["fresh"] * scoring.freshness("published", as_of)
        + F.when(F.col("cached"), w["cached"]).otherwise(0.0)
    )
    return pool.select("url", base.alias("base"))


@dataclass
class Vectors:
    """What readers and posts are compared by."""

    post_labels: DataFrame  # url, key, idf
    post_words: DataFrame  # url, key, tf
    label_norm: DataFrame  # url, label_norm
    word_norm: DataFrame  # url, word_norm
    own: DataFrame  # reader, kind (label, dislike), key, v
    words: DataFrame  # reader, kind (word), key, v
    authors: DataFrame  # reader, kind (author), key, v (share of the best author's weight)
    norms: DataFrame  # reader, label_len, dislike_len, word_len


def vectors(weights: DataFrame, pool: DataFrame) -> Vectors:
    idf = label_idf(pool)
    post_labels = pool.select("url", F.explode("labels").alias("key")).join(idf, "key")
    post_words = (
        pool.select("url", F.explode(F.transform(text.content_words("title"), text.stem)).alias("key"))
        .groupBy("url", "key").agg(F.count("*").cast("double").alias("tf"))
    )
    own = weights.filter(F.col("kind").isin("label", "dislike")).join(idf, "key", "left").select(
        "reader", "kind", "key", (F.col("weight") * F.coalesce("idf", F.lit(1.0))).alias("v"))
    words = weights.filter(F.col("kind") == "word").select("reader", "kind", "key", F.col("weight").alias("v"))
    best_author = weights.filter(F.col("kind") == "author").groupBy("reader").agg(F.max("weight").alias("top"))
    authors = weights.filter((F.col("kind") == "author") & (F.col("weight") > 0)).join(best_author, "reader").select(
        "reader", "kind", "key", (F.col("weight") / F.col("top")).alias("v"))
    norms = own.unionByName(words).groupBy("reader").agg(*[
        F.sqrt(F.sum(F.when(F.col("kind") == k, F.col("v") * F.col("v")))).alias(f"{k}_len") for k in ("label", "dislike", "word")
    ])
    return Vectors(
        post_labels, post_words, vector_norm(post_labels, ["url"], "idf", "label_norm"), vector_norm(post_words, ["url"], "tf", "word_norm"),
        own, words, authors, norms)


#: What ``score_pairs`` returns unless it is asked for less, and what of it is the post's own.
COLUMNS = ["reader", "url", "title", "author", "cached", "home_topic", "home_subtopic", "base", "label_sim", "word_sim", "author_share",
           "dislike", "shared", "score", "affinity", "tags_shared"]
FACTS = ["url", "title", "author", "cached", "home_topic", "home_subtopic", "sig"]


def score_pairs(
    weights: DataFrame, pool: DataFrame, as_of, *, known: DataFrame | None = None, rotation: Column | None = None,
    only: DataFrame | None = None, columns: list[str] | None = None, words: int = 3,
) -> DataFrame:
    """Score of every (reader, post) that share something; ``known`` (reader, url) is left out.

    Adds label and word similarity, author, dislike, the shared labels by weight and the sum. Readers meet posts by blocks
    (``blocks.meetings``). ``only``: pairs (reader, url) to score; then a pair meets the keys of its post, and no list of a
    key is read whole. ``columns``: those of COLUMNS that are wanted, so that titles and lists travel only for those who read
    them; without ``only`` also ``n_tags`` (the number of shared tags), ``sig`` (of the headline) and ``because_words`` (of a
    post that shares no tag, the ``words`` title words the reader reads most).
    """
    wanted = columns or COLUMNS
    if only is None:
        rows = _met(weights, pool, as_of, known, wanted, words)
    else:
        rows = _met_only(weights, pool, as_of, known, only)
    return _scored(rows, rotation).select(*wanted)


def _scored(rows: DataFrame, rotation: Column | None) -> DataFrame:
    w = fixed.RECOMMEND_WEIGHTS
    total = (
        w["labels"] * F.col("label_sim") + w["words"] * F.col("word_sim") + w["author"] * F.col("author_share")
        + F.col("base") - w["dislike"] * F.col("dislike")
    )
    if rotation is not None:
        total = total + w["rotation"] * rotation
    rows = rows.withColumns({"score": F.round(total, 4), "affinity": F.greatest("label_sim", "word_sim")})
    if "shared" in rows.columns:
        rows = rows.withColumn("tags_shared", F.filter("shared", lambda l: ~F.contains(l, F.lit("/"))))
    return rows


def _met(
    weights, pool, as_of, known, wanted: list[str], words: int = 3, best: int | None = None, page: tuple[int, int] | None = None,
    who: DataFrame | None = None,
) -> DataFrame:
    """Pairs that share something, by blocks. ``page``: what can be on the pages of the readers ``who``; then ``weights`` are stored."""
    weights = weights if page else stage(weights, "weights")
    v = vectors(weights, pool)
    own = v.own.unionByName(v.words).unionByName(v.authors).filter("reader IS NOT NULL AND key IS NOT NULL")
    own = own.withColumn("space", F.when(F.col("kind") == "dislike", "label").otherwise(F.col("kind")))
    keys = stage(own.select("space", "key").distinct().withColumn("id", F.monotonically_increasing_id()), "keys")
    lists = "shared" in wanted or "tags_shared" in wanted
    key = F.col("key")
    kind = (
        F.when(F.col("kind") == "dislike", blocks.DISLIKE).when(F.col("kind") == "word", blocks.WORD).when(F.col("kind") == "author", blocks.AUTHOR)
        .when(key.isin(fixed.GENERIC_LABELS), blocks.GENERIC).when(F.contains(key, F.lit("/")), blocks.SUBTOPIC).otherwise(blocks.TAG)
    )
    name = F.when(F.col("kind") == "label", key) if lists else F.lit(None).cast("string")
    entry = F.struct((-F.round("v", 6)).alias("o"), name.alias("key"), "id", "v", kind.cast("int").alias("kind"))
    readers = own.join(keys, ["space", "key"]).groupBy("reader").agg(F.array_sort(F.collect_list(entry)).alias("keys")).join(v.norms, "reader")
    if page:
        readers = who.join(readers, "reader", "left")
    if known is not None:
        readers = readers.join(known.filter("reader IS NOT NULL").groupBy("reader").agg(F.collect_set("url").alias("known")), "reader", "left")
    else:
        readers = readers.withColumn("known", F.array().cast("array<string>"))

    def features(df, space, value):
        return df.select("url", F.lit(space).alias("space"), "key", F.col(value).alias("x"))

    has = features(v.post_labels, "label", "idf").unionByName(features(v.post_words, "word", "tf")).unionByName(
        features(pool.select("url", F.col("author").alias("key"), F.lit(1.0).alias("one")), "author", "one"))

    def norm(space):
        return F.sqrt(F.sum(F.when(F.col("space") == space, F.col("x") * F.col("x")))).alias(f"{space}_norm")

    has = has.join(keys, ["space", "key"], "left").groupBy("url").agg(
        norm("label"), norm("word"), F.collect_list(F.when(F.col("id").isNotNull(), F.struct("id", "x"))).alias("has"))
    # a page has places for posts that share nothing
    has = (has if page else has.filter(F.size("has") > 0)).select("url", "label_norm", "word_norm", F.col("has.id").alias("ids"), F.col("has.x").alias("vals"))
    facts = [c for c in FACTS if c in wanted or c == "url"]
    # rows of a page are many, so that they carry a number for the headline
    own_facts = pool.withColumn("sig", F.xxhash64(headline_key()) if page else headline_key()) if "sig" in facts else pool
    posts = own_facts.select(*facts).join(post_scores(pool, as_of), "url").join(has, "url", "left" if page else "inner")
    if "because_words" in wanted:
        said = title_words(pool, ["url"]).groupBy("url", "word").agg(F.min("pos").alias("pos")).withColumn("key", text.stem("word"))
        said = said.join(keys.filter("space = 'word'"), "key").groupBy("url").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "word"))).alias("said"))
        posts = posts.join(said.select("url", F.col("said.id").alias("said_ids"), F.col("said.word").alias("said_words")), "url", "left")
        none = F.array()
        posts = posts.withColumns({"said_ids": F.coalesce("said_ids", none.cast("array<bigint>")), "said_words": F.coalesce("said_words", none.cast("array<string>"))})
    return blocks.meetings(
        readers, posts, facts, fixed.RECOMMEND_WEIGHTS, (who if page else weights.select("reader").distinct()).count(), pool.count(),
        best=best, page=page, lists=lists, said=words if "because_words" in wanted else 0)


def _met_only(weights, pool, as_of, known, only: DataFrame) -> DataFrame:
    """The pairs of ``only`` that share something: a pair meets the keys of its post."""
    v = vectors(weights, pool)
    post_labels, label_norm, word_norm, norms = v.post_labels, v.label_norm, v.word_norm, v.norms

    def meet(mine, theirs):
        return only.select("reader", "url").join(theirs, "url").join(mine, ["reader", "key"])

    zero = F.lit(0.0)
    shared = meet(v.own, post_labels).select(
        "reader", "url", "kind", (F.col("v") * F.col("idf")).alias("dot"),
        F.when((F.col("kind") == "label") & ~F.col("key").isin(fixed.GENERIC_LABELS),
               F.struct((-F.round("v", 6)).alias("o"), "key")).alias("shared"),
    )
    common = meet(v.words, v.post_words).select(
        "reader", "url", "kind", (F.col("v") * F.col("tf")).alias("dot"), F.lit(None).cast("struct<o:double,key:string>").alias("shared"))
    read = meet(v.authors, pool.select("url", F.col("author").alias("key"))).select(
        "reader", "url", "kind", F.col("v").alias("dot"), F.lit(None).cast("struct<o:double,key:string>").alias("shared"))
    pairs = shared.unionByName(common).unionByName(read)
    if known is not None:
        pairs = pairs.join(known.select("reader", "url").distinct(), ["reader", "url"], "left_anti")
    # the list of shared labels is bounded by the post's own labels
    sums = pairs.groupBy("reader", "url").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("dot")).otherwise(zero)).alias(k + "_dot") for k in ("label", "word", "dislike", "author")],
        F.array_sort(F.collect_list("shared")).alias("shared"),
    )
    facts = pool.select("url", "author", "cached", "title", "home_topic", "home_subtopic").join(post_scores(pool, as_of), "url") \
        .join(label_norm, "url", "left").join(word_norm, "url", "left")
    rows = sums.join(norms, "reader").join(facts, "url")

    def cosine(k, length):
        scale = F.col(f"{k}_len") * F.col(length)
        return F.coalesce(F.when(scale > 0, F.col(f"{k}_dot") / scale), zero)

    return rows.select(
        "reader", "url", "title", "author", "cached", "home_topic", "home_subtopic", "base",
        cosine("label", "label_norm").alias("label_sim"), cosine("word", "word_norm").alias("word_sim"),
        F.col("author_dot").alias("author_share"), cosine("dislike", "label_norm").alias("dislike"),
        F.transform("shared", lambda s: s["key"]).alias("shared"),
    )


def best_pairs(
    weights: DataFrame, pool: DataFrame, as_of, k: int = 60, *, known: DataFrame | None = None, strong: int = 6,
) -> DataFrame:
    """The ``k`` best posts of each reader, exactly those that ``score_pairs`` puts first (by score, then URL), with their rank.

    All pairs are scored, by blocks; a block gives away only what can be among a reader's ``k`` best. ``strong`` is kept for
    callers of the former search by lists of impact and has no effect.
    """
    rows = _scored(_met(weights, pool, as_of, known, COLUMNS, best=k), None).select(*COLUMNS)
    return top_per_key(rows, ["reader"], [F.desc("score"), F.asc("url")], k)


#: Rows of an owner and of a subtopic that each block gives at first for a page.
DEPTH = 10
#: What a page is made from.
SHAPED = ["reader", "url", "author", "cached", "home_topic", "home_subtopic", "score", "affinity", "n_tags", "sig"]


def page_pairs(
    weights: DataFrame, pool: DataFrame, readers: DataFrame, as_of, *, limit: int = 60, known: DataFrame | None = None,
) -> DataFrame:
    """What ``shape`` needs of all pairs for pages of ``limit`` rows, and of the posts that share nothing (not ``met``) the best.

    All pairs are scored, by blocks. Of each block a reader gets the best rows for each list's end and, for its variety, the first
    rows of each owner and signature, and of each subtopic and signature. The lists are walked (``_walked``), to see also whether a
    row that was left out after one (``cut``) could be kept; readers for whom one could get a greater depth. ``weights`` are
    read several times: a stored table.
    """
    who, depth, settled = stage(readers.select("reader").filter("reader IS NOT NULL").distinct(), "who"), DEPTH, None
    while True:
        found = _scored(_met(weights, pool, as_of, known, SHAPED, page=(limit, depth), who=who), None)
        found = stage(_walked(found.select(*SHAPED, "met", "cut"), limit), "paged")
        fine = found.filter(~F.col("open")).drop("cut", "open")
        settled = fine if settled is None else settled.unionByName(fine)
        who = found.filter("open").select("reader")
        if who.isEmpty():
            return settled
        weights, depth = stage(weights.join(who, "reader", "left_semi"), "weights"), depth * 8


def _walked(found: DataFrame, limit: int) -> DataFrame:
    """The rows that a page is made from: each reader's list is walked once, as ``diversify`` does, in one task.

    What is kept, and what fills the lists' ends, decides a page; rows that are neither keep no other from being kept. A reader
    on whose page a row could be that was left out gets a single row that is ``open``.
    """
    places, reserve, cap = limit // fixed.EXPLORE_EVERY, max(1, int(limit * fixed.INDEX_SHARE)), fixed.MAX_PER_AUTHOR
    used = ["met", "cached", "home_topic", "n_tags", "affinity", "author", "home_subtopic", "sig", "cut"]

    def chosen(rows) -> list[int] | None:
        edge = [i for i, (met, cached, topic, n_tags, *_) in enumerate(rows) if not met or cached and topic is not None and n_tags == 0][:places]
        spent = set(edge)
        rest = [i for i, r in enumerate(rows) if r[0] and r[4] > 0 and i not in spent]
        fresh = [i for i in rest if not rows[i][1]]
        seen, held, kept, whole = set(), {}, set(), True
        for i in rest:
            owner, sig, cut = rows[i][5], rows[i][7], rows[i][8]
            if sig not in seen and not (owner and held.get(owner, 0) >= cap):
                seen.add(sig)
                held[owner] = held.get(owner, 0) + 1
                kept.add(i)
            if cut & blocks.CUT_OWNERS or cut & blocks.CUT_OWNER and not (owner and held.get(owner, 0) >= cap):
                whole = False
                break
        if not whole and sum(bool(rows[i][1]) for i in kept) < limit:
            return None
        seen, held, second = set(), {}, set()
        for first in (True, False) if whole else (True,):
            for i in fresh:
                home, sig, cut = rows[i][6], rows[i][7], rows[i][8]
                if (i in kept) == first and sig not in seen and not (home and held.get(home, 0) >= 2):
                    seen.add(sig)
                    held[home] = held.get(home, 0) + 1
                    second.add(i)
                if not first and (cut & blocks.CUT_HOMES or cut & blocks.CUT_HOME and not (home and held.get(home, 0) >= 2)):
                    whole = False
                    break
        if not whole and len(second) < reserve:
            return None
        return sorted({*edge, *kept, *second, *[i for i in rest if rows[i][1]][:limit], *fresh[:reserve]})

    def walk(batches):
        def ended():
            table = pa.Table.from_batches(parts)
            at = chosen(list(zip(*(table.column(c).to_pylist() for c in used))))
            table = table.slice(0, 1) if at is None else table.take(pa.array(at, pa.int64()))
            return table.append_column("open", pa.array([at is None] * table.num_rows, pa.bool_())).to_batches()

        parts, now = [], None
        for batch in batches:
            readers, start = batch.column("reader").to_pylist(), 0
            for i, reader in enumerate(readers):
                if reader != now:
                    if i > start:
                        parts.append(batch.slice(start, i - start))
                    if parts:
                        yield from ended()
                    parts, start, now = [], i, reader
            if len(readers) > start:
                parts.append(batch.slice(start))
        if parts:
            yield from ended()

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = found.repartition(n, "reader").sortWithinPartitions("reader", F.desc("score"), "url")
    return spread.mapInArrow(walk, T.StructType([*found.schema.fields, T.StructField("open", T.BooleanType())]))


def hourly_rotation(as_of) -> Column:
    """A value in [0, 1) that changes with the hour, the same for everyone who asks within it."""
    hour = F.date_trunc("hour", F.lit(as_of).cast("timestamp")).cast("string")
    return F.pmod(F.xxhash64(F.col("url"), hour), F.lit(1_000_003)) / 1_000_003.0


def headline_key() -> Column:
    return F.md5(text.headline_signature("title").cast("binary"))


def _no_tags(scored: DataFrame) -> Column:
    return F.col("n_tags") == 0 if "n_tags" in scored.columns else F.size("tags_shared") == 0


def edge_rows(scored: DataFrame, pool: DataFrame, readers: DataFrame, as_of, limit: int, known: DataFrame | None = None) -> DataFrame:
    """Posts next to a reader's taste: opened posts with a home under none of the reader's tags, best first.

    Those that share something with the reader are in ``scored``. The others score the same for everyone: they come
    from one ranking of posts, read down to as many places as this reader can have used up plus the places needed,
    which is exact for any number of posts. Rows of ``page_pairs`` hold the best of both already.
    """
    k = limit // fixed.EXPLORE_EVERY
    cols = ["reader", "url", "score"]
    if "met" in scored.columns:
        both = scored.filter(~F.col("met") | (F.col("cached") & F.col("home_topic").isNotNull() & _no_tags(scored))).select(*cols)
        return top_per_key(both, ["reader"], [F.desc("score"), F.asc("url")], k)
    near = scored.filter(F.col("cached") & F.col("home_topic").isNotNull() & _no_tags(scored)).select(*cols)
    used = scored.select("reader", "url")
    if known is not None:
        used = used.unionByName(known.select("reader", "url"))
    used = used.distinct()
    depth = used.groupBy("reader").agg(F.count("*").alias("n"))
    plain = post_scores(pool, as_of).join(pool.filter(F.col("cached") & F.col("home_topic").isNotNull()).select("url"), "url") \
        .select("url", F.round("base", 4).alias("score"))
    from .ranking import full_rank

    ranked = full_rank(plain.withColumn("_all", F.lit(0)), ["_all"], ["-score", "url"], "place").drop("_all")
    asked = readers.select("reader").join(depth, "reader", "left").select(
        "reader", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("n", F.lit(0)) + k)).alias("place"))
    far = asked.join(ranked, "place").join(used, ["reader", "url"], "left_anti").select(*cols)
    return top_per_key(near.unionByName(far), ["reader"], [F.desc("score"), F.asc("url")], k)


def shape(scored: DataFrame, pool: DataFrame, readers: DataFrame, as_of, *, limit: int = 60, known: DataFrame | None = None) -> DataFrame:
    """The page of each reader: mostly matches, a reserved share of unopened posts, now and then an explore slot."""
    scored = scored if "met" in scored.columns else stage(scored, "scored")
    edge = stage(edge_rows(scored, pool, readers, as_of, limit, known), "edge")
    rest = scored.filter(F.col("affinity") > 0).join(edge.select("reader", "url"), ["reader", "url"], "left_anti")
    sig = F.col("sig") if "sig" in rest.columns else headline_key()
    rest = rest.select("reader", "url", "author", "cached", "home_subtopic", "score", sig.alias("sig"))
    rest = rest.withColumn("place", F.struct((-F.col("score")).alias("s"), "url"))
    # lists of few rows are walked at once
    rounds = 0 if "met" in scored.columns else 3
    first = diversify(rest, "reader", "place", "author", "sig", fixed.MAX_PER_AUTHOR, rounds=rounds).withColumnRenamed("kept", "kept1")
    first = first if rounds else stage(first, "first")
    order = [F.desc("kept1"), F.asc("place")]
    known_list = top_per_key(first.filter("cached"), ["reader"], order, limit).select(
        "reader", "url", "score", (F.col("rank") - 1).alias("i"))
    unopened = first.filter(~F.col("cached")).withColumn("place2", F.struct((~F.col("kept1")).alias("k"), "place"))
    reserve = int(limit * fixed.INDEX_SHARE)
    second = diversify(unopened, "reader", "place2", "home_subtopic", "sig", 2, rounds=rounds)
    fresh_list = top_per_key(second, ["reader"], [F.desc("kept"), F.asc("place2")], max(reserve, 1)).filter(
        F.col("rank") <= reserve).select("reader", "url", "score", (F.col("rank") - 1).alias("i"))
    known_list, fresh_list = stage(known_list, "opened"), stage(fresh_list, "fresh")
    return place_slots(known_list, fresh_list, edge.select("reader", "url", "score", (F.col("rank") - 1).alias("i")), limit)


def place_slots(known: DataFrame, fresh: DataFrame, edge: DataFrame, limit: int) -> DataFrame:
    """Closed form of the page: where each of the three lists' rows (numbered from 0 by ``i``) ends up.

    Fresh row i goes to min(known + i, (i+1) * step); explore row j to min(length + j, 6 + 7j); the others fill the
    gaps in order, so their place is their number plus the inserted rows at or before it.
    """
    def n(df, name):
        return df.groupBy("reader").agg(F.count("*").alias(name))

    readers = known.select("reader").union(fresh.select("reader")).union(edge.select("reader")).distinct()
    sizes = readers.join(n(known, "nk"), "reader", "left").join(n(fresh, "nf"), "reader", "left").join(
        n(edge, "ne"), "reader", "left").fillna(0, ["nk", "nf", "ne"])
    sizes = sizes.withColumn("nk", F.least(F.col("nk"), F.lit(limit) - F.col("nf")))
    sizes = sizes.withColumn("step", F.greatest(F.lit(1), F.floor(F.lit(limit) / (F.col("nf") + 1))))
    every = fixed.EXPLORE_EVERY

    def numbers(size):
        return F.filter(F.sequence(F.lit(0).cast("bigint"), F.col(size)), lambda i: i < F.col(size))

    sizes = sizes.select(
        "*",
        F.transform(numbers("nf"), lambda i: F.least(F.col("nk") + i, (i + 1) * F.col("step")) - i).alias("fgap"),
        F.transform(numbers("ne"), lambda j: F.least(F.col("nk") + F.col("nf") + j, F.lit(every - 1) + every * j) - j).alias("egap"),
    )

    def before(gaps, i):
        return F.size(F.filter(gaps, lambda g: g <= i))

    cols = ["reader", "url", "score", "i"]
    mixed = (
        known.select(*cols, F.lit("known").alias("kind"))
        .unionByName(fresh.select(*cols, F.lit("fresh").alias("kind")))
        .join(sizes, "reader")
        .filter((F.col("kind") == "fresh") | (F.col("i") < F.col("nk")))
    )
    at = F.when(F.col("kind") == "fresh", F.get("fgap", F.col("i").cast("int")) + F.col("i")).otherwise(
        F.col("i") + before(F.col("fgap"), F.col("i")))
    mixed = mixed.withColumn("at", at)
    mixed = mixed.withColumn("slot", F.col("at") + before(F.col("egap"), F.col("at")))
    explore = edge.select(*cols, F.lit("explore").alias("kind")).join(sizes, "reader").withColumn(
        "slot", F.get("egap", F.col("i").cast("int")) + F.col("i"))
    out = ["reader", "url", "score", "kind", "slot"]
    return mixed.select(*out).unionByName(explore.select(*out)).filter(F.col("slot") < limit)


# ---------------------------------------------------------------- explanations


def title_words(titled: DataFrame, keys: list[str]) -> DataFrame:
    return titled.select(*keys, F.posexplode(text.words("title")).alias("pos", "word")).filter(
        ~F.col("word").isin(fixed.STOPWORDS) & (F.length("word") > 2))


def why_words(titled: DataFrame, weights: DataFrame, keys: list[str], limit: int = 3) -> DataFrame:
    """The words of a title the reader reads most: (keys..., because_words)."""
    words = title_words(titled, keys)
    mine = weights.filter((F.col("kind") == "word") & (F.col("weight") > 0)).select(
        "reader", F.col("key").alias("stem"), F.round("weight", 6).alias("w"))
    hits = words.withColumn("stem", text.stem("word")).join(mine, ["reader", "stem"])
    best = hits.groupBy(*keys, "word").agg(F.max("w").alias("w"), F.min("pos").alias("pos"))
    top = top_per_key(best, keys, [F.desc("w"), F.asc("pos")], limit)
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("because_words"))


def explain(scored: DataFrame, profile) -> DataFrame:
    """Up to three shared tags, the article that best stands for the first shared label, or the shared words."""
    rows = scored.select("reader", "url", "title", "shared", F.slice("tags_shared", 1, 3).alias("because"),
                         (F.col("author_share") > 0).alias("same_author"))
    first = rows.select("reader", "url", F.posexplode("shared").alias("o", "key")).join(
        profile.examples, ["reader", "key"]).groupBy("reader", "url").agg(F.min_by("title", "o").alias("like"))
    bare = rows.filter(F.size("because") == 0).select("reader", "url", "title")
    words = why_words(bare, profile.weights, ["reader", "url"])
    none = F.array().cast("array<string>")
    return rows.join(first, ["reader", "url"], "left").join(words, ["reader", "url"], "left").select(
        "reader", "url", "because", "like", F.coalesce("because_words", none).alias("because_words"), "same_author")


def source_mix(page: DataFrame) -> DataFrame:
    """Picks by origin per reader."""
    return page.groupBy("reader").agg(
        F.count_if(F.col("kind") != "fresh").alias("cache"), F.count_if(F.col("kind") == "fresh").alias("index"))
