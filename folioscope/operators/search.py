"""Full-text search of many structured queries at once: index, bm25 retrieval, widening, ranking, paging.

A post's words stay together in the index rows of that post, and the words of the query batch are the small side of
every join, so retrieval reads the index once and only matching rows travel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring, text
from ..session import stage
from .ranking import bm25_normalise, diversify_bounded, top_per_key

AUTHOR_UNIT, OPEN_UNIT = -2, -1


@dataclass
class Index:
    postings: DataFrame  # post_id, token, stem, tf_title, tf_author, title_pos, author_pos, doc_len, day, lead
    docs: DataFrame      # post_id, url, title, author, day, prio, title_len, doc_len
    tokens: DataFrame | None = None  # token, stem, where stored
    stems: DataFrame | None = None   # stem, df (posts that hold it), where stored

    def staged(self) -> "Index":
        """All four tables written, so that no batch of queries makes the vocabulary anew."""
        kept = Index(stage(self.postings, "postings"), stage(self.docs, "docs"))
        return Index(kept.postings, kept.docs, stage(kept.vocabulary(), "tokens"), stage(term_stats(kept.postings), "stems"))

    def vocabulary(self) -> DataFrame:
        return self.tokens if self.tokens is not None else self.postings.select("token", "stem").distinct()

    def stem_df(self) -> DataFrame:
        return self.stems if self.stems is not None else term_stats(self.postings)


def normalise_queries(raw: DataFrame) -> DataFrame:
    """Structured queries ready to run.

    Small words move to ``soft``, one-word phrases become terms, a query of nothing but small words keeps them, and
    terms are distinct in order. Input: query_id, plain, phrases, exclude, author, since, before.
    """
    none = F.array().cast("array<string>")
    small = F.filter("plain", lambda w: w.isin(fixed.STOPWORDS))
    large = F.filter("plain", lambda w: ~w.isin(fixed.STOPWORDS))
    singles = F.flatten(F.filter("phrases", lambda p: F.size(p) == 1))
    long = F.filter("phrases", lambda p: F.size(p) > 1)
    terms = F.concat(large, singles)
    only_small = (F.size(terms) == 0) & (F.size(long) == 0) & (F.size(small) > 0)
    return raw.select(
        "query_id",
        F.array_distinct(F.when(only_small, small).otherwise(terms)).alias("terms"),
        F.when(only_small, none).otherwise(small).alias("soft"),
        long.alias("phrases"), "exclude", "author", "since", "before",
    )


# ---------------------------------------------------------------- index


def build_index(posts: DataFrame) -> Index:
    """Inverted index rows, one per (post, token), and one row of facts per post.

    The only shuffle moves the texts, spread by post. A post's words are sorted and grouped within its own row, so no
    word is ever a hot key, nothing is aggregated and the larger table of postings does not travel. Rows that share
    their post's id, and those without one, are counted together.
    """
    several = stage(posts.groupBy("post_id").agg(F.count("*").alias("n")).filter("n > 1 or post_id is null").select("post_id"), "several")
    once = posts.join(several, "post_id", "left_anti").filter(F.col("post_id").isNotNull())
    more = posts.join(several.withColumnRenamed("post_id", "_id"), F.col("post_id").eqNullSafe(F.col("_id")), "left_semi")

    def spread(rows):
        return rows.select("post_id", "day", "title", "author").repartition("post_id").select(
            "post_id", "day", text.words("title").alias("tw"), text.words("author").alias("aw")
        ).select("post_id", "day", F.size("tw").alias("n"), (F.size("tw") + F.size("aw")).alias("doc_len"), F.concat("tw", "aw").alias("w"))

    def at(i, field):
        return F.get("placed", i)[field]

    grouped = spread(once).select(
        "post_id", "day", "n", "doc_len",
        F.sort_array(F.transform("w", lambda t, i: F.struct(t.alias("token"), i.alias("pos")))).alias("placed"),
    ).select("*", F.filter(
        F.sequence(F.lit(0), F.greatest(F.col("doc_len") - 1, F.lit(0))),
        lambda i: (i < F.col("doc_len")) & ((i == 0) | (at(i, "token") != at(i - 1, "token"))),
    ).alias("first"))
    last = lambda k: F.coalesce(F.get("first", k + 1), F.col("doc_len")) - 1
    runs = F.transform("first", lambda i, k: F.struct(
        at(i, "token").alias("token"), F.transform(F.sequence(i, last(k)), lambda j: at(j, "pos")).alias("pos")))
    # tokens of one stem next to each other: the first of them counts the post for the stem
    runs = grouped.select("post_id", "day", "doc_len", "n", runs.alias("runs")).select(
        "post_id", "day", "doc_len", "n",
        F.sort_array(F.transform("runs", lambda r: F.struct(text.stem_within(r["token"]).alias("stem"), r["token"].alias("token"), r["pos"].alias("pos")))).alias("runs"))
    marked = F.transform("runs", lambda r, i: F.struct(r.alias("run"), ((i == 0) | (r["stem"] != F.get("runs", i - 1)["stem"])).alias("lead")))
    flat = runs.select("post_id", "day", "doc_len", "n", F.inline(marked)).select(
        "post_id", "day", "doc_len", F.col("run.token").alias("token"),
        F.filter("run.pos", lambda p: p < F.col("n")).alias("title_pos"),
        F.transform(F.filter("run.pos", lambda p: p >= F.col("n")), lambda p: p - F.col("n")).alias("author_pos"),
        F.col("run.stem").alias("stem"), "lead",
    ).select("post_id", "day", "doc_len", "token", F.size("title_pos").cast("bigint").alias("tf_title"),
             F.size("author_pos").cast("bigint").alias("tf_author"), "title_pos", "author_pos", "stem", "lead")
    in_title = F.col("pos") < F.col("n")
    together = (
        spread(more).select("post_id", "day", "n", "doc_len", F.posexplode("w").alias("pos", "token"))
        .groupBy("post_id", "day", "doc_len", "token")
        .agg(
            F.count_if(in_title).alias("tf_title"),
            F.count_if(~in_title).alias("tf_author"),
            F.array_sort(F.collect_list(F.when(in_title, F.col("pos")))).alias("title_pos"),
            F.array_sort(F.collect_list(F.when(~in_title, F.col("pos") - F.col("n")))).alias("author_pos"),
        )
    )
    of_stem = Window.partitionBy("post_id", "stem").orderBy("day", "doc_len", "token")
    together = together.withColumn("stem", text.stem("token")).withColumn(
        "lead", F.col("post_id").isNotNull() & (F.row_number().over(of_stem) == 1))
    postings = flat.unionByName(together)
    title_len = F.size(text.words("title"))
    docs = posts.select(
        "post_id", "url", "title", "author", "day", "prio",
        title_len.alias("title_len"), (title_len + F.size(text.words("author"))).alias("doc_len"),
    )
    return Index(postings, docs)


def term_stats(postings: DataFrame) -> DataFrame:
    """Posts per stem, counted by the one posting of each post that leads its stem; no (stem, post) travels."""
    return postings.groupBy("stem").agg(F.count_if("lead").alias("df"))


# ---------------------------------------------------------------- retrieval


def query_units(queries: DataFrame) -> DataFrame:
    """One row per word of every unit a query asks for: terms, phrases and the author filter."""
    term = queries.select(
        "query_id", F.posexplode("terms").alias("unit", "word"), F.size("terms").alias("n_terms")
    ).select(
        "query_id", "unit", F.lit(0).alias("idx"), F.lit(1).alias("n_idx"), "word",
        (F.col("unit") == F.col("n_terms") - 1).alias("is_last"), F.lit("any").alias("field"),
    )
    phrase = (
        queries.select("query_id", F.posexplode("phrases").alias("p", "words"))
        .select("query_id", (F.lit(100_000) + F.col("p")).alias("unit"), F.size("words").alias("n_idx"),
                F.posexplode("words").alias("idx", "word"))
        .select("query_id", "unit", "idx", "n_idx", "word", F.lit(False).alias("is_last"), F.lit("any").alias("field"))
    )
    author = (
        queries.filter(F.col("author") != "")
        .select("query_id", text.words("author").alias("words"))
        .select("query_id", F.lit(AUTHOR_UNIT).alias("unit"), F.size("words").alias("n_idx"),
                F.posexplode("words").alias("idx", "word"))
        .select("query_id", "unit", "idx", "n_idx", "word", F.lit(False).alias("is_last"), F.lit("author").alias("field"))
    )
    return term.unionByName(phrase).unionByName(author).withColumn("stem", text.stem("word"))


def open_stems(index: Index, units: DataFrame) -> DataFrame:
    """(stem, head): stems of the vocabulary that begin with some query's last term, found by equality on the stems' beginnings."""
    last = units.filter("is_last").select(F.col("stem").alias("head")).distinct()
    vocabulary = index.stem_df().select("stem")
    heads = vocabulary.select(
        "stem", F.explode(F.transform(F.sequence(F.lit(1), F.length("stem")), lambda n: F.left(F.col("stem"), n)))
        .alias("head"),
    )
    return heads.join(last, "head").select("stem", "head")


WEIGHTS = (fixed.TITLE_WEIGHT, fixed.AUTHOR_WEIGHT)


POSTS_PER_TASK = 2000


def post_parts(index: Index) -> int:
    """Tasks that matches of posts are dealt to: by the number of posts, since packed bytes say little about the rows they unfold to."""
    posts = index.docs.count()
    return max(int(index.docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posts // POSTS_PER_TASK))


def unit_matches(index: Index, queries: DataFrame, *, with_open: bool = True, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """(query_id, unit, post_id, day, doc_len, wf): weighted frequency of every unit in every post that has it.

    The words of the batch are written first, so that joins see how few they are. What moves is the postings of these
    words, once, to their posts; a post's frequencies are summed there for each word and each open beginning, and then
    given to the queries that ask for them. A task gets a bounded number of posts, so that its sums stay in memory.
    """
    units = stage(query_units(queries), "units")
    parts = post_parts(index)
    weight = weights[0] * F.col("tf_title") + weights[1] * F.col("tf_author")
    asks = units.filter((F.col("n_idx") == 1) & (F.col("field") == "any")).select(
        "query_id", "unit", F.col("stem").alias("key"), F.lit(False).alias("open"))
    keys = asks.select(F.col("key").alias("stem"), "key", "open").distinct()
    if with_open:
        asks = asks.unionByName(units.filter("is_last").select(
            "query_id", F.lit(OPEN_UNIT).alias("unit"), F.col("stem").alias("key"), F.lit(True).alias("open")))
        keys = keys.unionByName(open_stems(index, units).select("stem", F.col("head").alias("key"), F.lit(True).alias("open")))
    asks, keys = stage(asks, "asks"), stage(keys, "keys")
    one = (
        index.postings.select("post_id", "day", "doc_len", "stem", weight.alias("wf")).join(keys, "stem")
        .select("post_id", "day", "doc_len", "key", "open", "wf").repartition(parts, "post_id")
        .groupBy("post_id", "day", "doc_len", "key", "open").agg(F.sum("wf").alias("wf"))
        .join(asks, ["key", "open"])
        .select("query_id", "post_id", "unit", "day", "doc_len", "wf")
    )
    # words that must stand next to each other: phrases, and the author filter inside the author column
    many = units.filter((F.col("n_idx") > 1) | (F.col("field") == "author")).select(
        "query_id", "unit", "idx", "n_idx", "stem", "field").filter(F.col("query_id").isNotNull())
    # a post must hold the rarest of them; only such posts are asked for the others
    rarest = many.join(index.stem_df(), "stem").groupBy("query_id", "unit").agg(F.min_by("stem", F.struct("df", "idx")).alias("stem"))
    rarest = stage(rarest, "rarest")
    asking = index.postings.select("post_id", "stem").join(rarest, "stem").repartition(parts, "post_id").groupBy("post_id").agg(
        F.collect_set(F.struct("query_id", "unit")).alias("asking"))
    placed = (
        index.postings.select("post_id", "day", "doc_len", "stem", "title_pos", "author_pos")
        .join(many.select("stem").distinct(), "stem", "left_semi").repartition(parts, "post_id").join(asking, "post_id").join(many, "stem")
        .filter(F.array_contains("asking", F.struct("query_id", "unit")))
        .groupBy("query_id", "post_id", "unit", "day", "doc_len", "n_idx", "field")
        .agg(F.collect_list(F.struct("idx", F.col("title_pos").alias("t"), F.col("author_pos").alias("a"))).alias("parts"))
        .filter(F.size(F.array_distinct(F.transform("parts", lambda p: p["idx"]))) == F.col("n_idx"))
    )

    def starts(i, column):
        mine = F.filter("parts", lambda p: p["idx"] == i)
        return F.transform(F.flatten(F.transform(mine, lambda p: p[column])), lambda x: x - i)

    def together(column):
        common = F.aggregate(
            F.sequence(F.lit(0), F.col("n_idx") - 1), starts(F.lit(0), column),
            lambda acc, i: F.array_intersect(acc, starts(i, column)),
        )
        return F.size(common)

    side = F.when(F.col("field") == "author", F.lit(0)).otherwise(together("t"))
    phrase = (
        placed.withColumn("wf", weights[0] * side + weights[1] * together("a"))
        .filter(F.col("wf") > 0)
        .select("query_id", "post_id", "unit", "day", "doc_len", "wf")
    )
    return one.unionByName(phrase)


def bm25_units(index: Index, matches: DataFrame) -> DataFrame:
    """Adds the bm25 part of each (query, unit, post); idf is floored so that common words never count negative."""
    corpus = index.docs.agg(F.count("*").cast("double").alias("n"), F.avg("doc_len").alias("len"))
    n_all = corpus.select("n").scalar()
    avg_len = corpus.select("len").scalar()
    df = matches.groupBy("query_id", "unit").agg(F.count("*").alias("df"))
    idf = F.greatest(F.log((n_all - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(fixed.BM25_IDF_FLOOR))
    df = stage(df.select("query_id", "unit", idf.alias("idf")), "idf")
    k1, b = fixed.BM25_K1, fixed.BM25_B
    part = F.col("idf") * F.col("wf") * (k1 + 1) / (F.col("wf") + k1 * (1 - b + b * F.col("doc_len") / avg_len))
    return matches.join(df, ["query_id", "unit"]).withColumn("part", part).drop("idf")


def match_modes(index: Index, queries: DataFrame, *, weights: tuple[float, float] = WEIGHTS) -> DataFrame:
    """(query_id, post_id) with the modes it satisfies (all / prefix / any), its bm25 in each, and its filters applied.

    bm25 is negated: lower is better. ``weights``: of a word in the title and in the author.
    """
    queries = stage(queries, "queries")
    parts = bm25_units(index, unit_matches(index, queries, weights=weights))
    shape = queries.select(
        "query_id", "since", "before",
        (F.size("terms") + F.size("phrases")).alias("n_units"), F.size("terms").alias("n_terms"),
        F.coalesce(F.col("author") != "", F.lit(False)).alias("by_author"),
    )
    last = F.col("unit") == F.col("n_terms") - 1
    base = F.col("unit") >= 0
    author = F.col("unit") == AUTHOR_UNIT
    zero = F.lit(0.0)
    rows = (
        parts.join(shape, "query_id")
        .filter(F.coalesce(F.col("day") >= F.col("since"), F.col("since").isNull())
                & F.coalesce(F.col("day") <= F.col("before"), F.col("before").isNull()))
        .groupBy("query_id", "post_id", "n_units", "n_terms", "by_author")
        .agg(
            F.count_if(base).alias("found"),
            F.count_if(base & ~last).alias("found_but_last"),
            F.max(F.col("unit") == OPEN_UNIT).alias("has_open"),
            F.max(author).alias("has_author"),
            F.sum(F.when(base | author, F.col("part")).otherwise(zero)).alias("s_words"),
            F.sum(F.when((base & ~last) | author | (F.col("unit") == OPEN_UNIT), F.col("part")).otherwise(zero))
            .alias("s_prefix"),
        )
        .filter(~F.col("by_author") | F.col("has_author"))
    )
    banned = (
        queries.select("query_id", F.explode("exclude").alias("word"))
        .select("query_id", text.stem("word").alias("stem"))
    )
    dropped = index.postings.select("post_id", "stem").join(banned, "stem").groupBy("post_id").agg(
        F.collect_set("query_id").alias("dropped_by"))
    return (
        rows.join(dropped, "post_id", "left")
        .filter(~F.coalesce(F.array_contains("dropped_by", F.col("query_id")), F.lit(False)))
        .select(
            "query_id", "post_id", "n_terms", "n_units",
            (F.col("found") == F.col("n_units")).alias("all"),
            ((F.col("n_terms") > 0) & F.col("has_open") & (F.col("found_but_last") == F.col("n_units") - 1)).alias("prefix"),
            ((F.col("found") > 0) | (F.col("n_units") == 0)).alias("any"),
            (-F.col("s_words")).alias("bm"), (-F.col("s_prefix")).alias("bm_prefix"),
        )
    )


def band(offset: int, page_size: int) -> int:
    """How many retrieved rows are ranked: whole steps, so that consecutive pages rank the same rows."""
    steps = -(-(offset + page_size + 1) // fixed.RERANK_WINDOW)
    return min(steps * fixed.RERANK_WINDOW, fixed.MAX_CANDIDATES)


def retrieve(
    index: Index, queries: DataFrame, *, offset: int = 0, page_size: int = 20, mode: str | None = None, want: int | None = None
) -> DataFrame:
    """Best rows of each query by bm25, in the narrowest mode that fills the page.

    All three modes are counted in the same pass; a query takes the first one with more rows than the page needs,
    else its widest. Columns: query_id, post_id, mode, bm, scanned.
    """
    want = want or band(offset, page_size)
    rows = stage(match_modes(index, queries), "matches")
    if mode:
        used = rows.select("query_id").distinct().withColumn("mode", F.lit(mode))
    else:
        target = F.lit(offset + page_size)

        def enough(c):
            return F.least(F.col(c), F.lit(want)) > target

        found = rows.groupBy("query_id", "n_terms", "n_units").agg(
            *[F.count_if(F.col(m)).alias("n_" + m) for m in ("all", "prefix", "any")]
        )
        used = found.select(
            "query_id",
            F.when(enough("n_all"), "all")
            .when((F.col("n_terms") > 0) & enough("n_prefix"), "prefix")
            .when(F.col("n_units") > 1, "any")
            .when(F.col("n_terms") > 0, "prefix")
            .otherwise("all").alias("mode"),
        )
    rows = rows.join(stage(used, "modes"), "query_id")
    fits = (
        F.when(F.col("mode") == "all", F.col("all")).when(F.col("mode") == "prefix", F.col("prefix"))
        .otherwise(F.when(F.col("n_units") > 1, F.col("any")).otherwise(F.col("all") | ((F.col("n_units") == 0) & F.col("any"))))
    )
    bm = F.when(F.col("mode") == "prefix", F.col("bm_prefix")).otherwise(F.col("bm"))
    rows = rows.filter(fits).select("query_id", "post_id", "mode", F.round(bm, 6).alias("bm"))
    scanned = rows.groupBy("query_id").agg(F.least(F.count("*"), F.lit(want)).alias("scanned"))
    top = top_per_key(rows, ["query_id"], [F.asc("bm"), F.asc("post_id")], want)
    return stage(top.drop("rank").join(scanned, "query_id"), "found")


# ---------------------------------------------------------------- re-ranking


def near_prefixes(word: Column) -> Column:
    """Beginnings of a word that count as the same word: one or two letters shorter, or any non-ASCII beginning."""
    heads = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda n: F.left(word, n))
    return F.filter(
        heads,
        lambda h: (F.length(h) < F.length(word))
        & (~text.is_ascii(h) | ((F.length(h) >= 5) & (F.length(word) - F.length(h) <= 2))),
    )


def token_levels(index: Index, terms: DataFrame) -> DataFrame:
    """(term, token, level) for the tokens of the index that match a query term; equality joins on the vocabulary."""
    vocabulary = index.vocabulary()
    t = terms.select("term").distinct().withColumn("stem", text.stem("term"))
    same_stem = vocabulary.join(t, "stem").select("term", "token")
    longer = vocabulary.select("token", F.explode(near_prefixes(F.col("token"))).alias("term")).join(t, "term").select("term", "token")
    shorter = t.select("term", F.explode(near_prefixes(F.col("term"))).alias("token")).join(vocabulary, "token").select("term", "token")
    pairs = same_stem.unionByName(longer).unionByName(shorter).distinct()
    return pairs.withColumn("level", F.when(F.col("term") == F.col("token"), 2).otherwise(1))


def term_hits(index: Index, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per (query, post, term): best level in title and author, first position of that level in the title."""
    terms = queries.select(
        "query_id", F.explode(F.array_distinct(F.concat("terms", F.flatten("phrases"), "soft"))).alias("term")
    )
    wanted = stage(terms.join(token_levels(index, terms), "term"), "wanted")
    asking = candidates.groupBy("post_id").agg(F.collect_set("query_id").alias("asking"))
    # postings of the batch's words only, and of the candidates only; a query meets them at the post
    found = index.postings.select(
        "post_id", "token", F.get("title_pos", F.lit(0)).alias("at"), (F.size("author_pos") > 0).alias("by")
    ).join(wanted.select("token").distinct(), "token", "left_semi").join(asking, "post_id").join(wanted, "token").filter(
        F.array_contains("asking", F.col("query_id")))
    best = F.min(F.when(F.col("at").isNotNull(), F.struct((-F.col("level")).alias("l"), F.col("at").alias("p"))))
    return found.groupBy("query_id", "post_id", "term").agg(
        best.alias("t"),
        F.coalesce(F.max(F.when(F.col("by"), F.col("level"))), F.lit(0)).alias("author_level"),
    ).select(
        "query_id", "post_id", "term",
        F.coalesce(-F.col("t.l"), F.lit(0)).alias("title_level"), F.col("t.p").alias("title_at"), "author_level",
    )


def taste_similarity(index: Index, candidates: DataFrame, prior: DataFrame) -> DataFrame:
    """Cosine of each candidate's title words with the query's prior (query_id, word, weight)."""
    own = candidates.select("post_id").distinct()
    vec = (
        index.postings.filter((F.col("tf_title") > 0) & ~F.col("token").isin(fixed.STOPWORDS))
        .join(own, "post_id")
        .groupBy("post_id", "stem").agg(F.sum("tf_title").alias("tf"))
    )
    norm = vec.groupBy("post_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("vec_norm"))
    prior_norm = prior.groupBy("query_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("prior_norm"))
    dot = (
        candidates.select("query_id", "post_id").join(vec, "post_id")
        .join(prior.withColumnRenamed("word", "stem"), ["query_id", "stem"])
        .groupBy("query_id", "post_id").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    )
    return dot.join(norm, "post_id").join(prior_norm, "query_id").select(
        "query_id", "post_id", (F.col("dot") / (F.col("vec_norm") * F.col("prior_norm"))).alias("taste"))


def score(index: Index, queries: DataFrame, candidates: DataFrame, as_of, prior: DataFrame | None = None) -> DataFrame:
    """Eleven weighted features per candidate: score, cover, missing words and whether it suits the reader."""
    hits = term_hits(index, queries, candidates)
    # at most one entry per word of the query
    per_post = hits.groupBy("query_id", "post_id").agg(
        F.map_from_entries(F.collect_list(F.struct("term", F.struct("title_level", "title_at", "author_level")))).alias("hit")
    )
    q = queries.select(
        "query_id", F.concat("terms", F.flatten("phrases")).alias("content"), "soft",
        (F.size("phrases") > 0).alias("has_phrase"), F.coalesce(F.col("author") != "", F.lit(False)).alias("by_author"),
    )
    rows = bm25_normalise(candidates, "query_id").join(q, "query_id").join(
        index.docs.select("post_id", "url", "author", F.col("day").alias("published"), "prio", "title_len"), "post_id"
    ).join(per_post, ["query_id", "post_id"], "left")
    if prior is not None:
        rows = rows.join(taste_similarity(index, candidates, prior), ["query_id", "post_id"], "left")
    else:
        rows = rows.withColumn("taste", F.lit(None).cast("double"))
    rows = rows.withColumn("taste", F.coalesce("taste", F.lit(0.0)))

    hit = F.col("hit")

    def level(t, part):
        return F.coalesce(hit[t][part], F.lit(0))

    distinct = F.array_distinct("content")
    best = F.transform(distinct, lambda t: F.greatest(level(t, "title_level"), level(t, "author_level")))
    n = F.size("content")
    in_title = F.filter("content", lambda t: level(t, "title_level") > 0)
    rows = rows.select(
        "*", best.alias("_best"),
        F.transform(in_title, lambda t: hit[t]["title_at"]).alias("_at"),
        F.size(F.array_distinct(in_title)).alias("_n_title"),
        F.size(F.filter(distinct, lambda t: level(t, "author_level") > 0)).alias("_n_author"),
    )
    cover = F.when(
        n > 0,
        F.aggregate("_best", F.lit(0.0), lambda s, l: s + F.when(l == 2, 1.0).when(l == 1, fixed.STEM_CREDIT).otherwise(0.0)) / n,
    ).otherwise(F.lit(1.0))
    exact = F.when(n > 0, F.size(F.filter("_best", lambda l: l == 2)) / n).otherwise(F.lit(1.0))
    soft = F.when(
        F.size("soft") > 0, F.size(F.filter("soft", lambda t: level(t, "title_level") > 0)) / F.size("soft")
    ).otherwise(F.lit(0.0))
    head = F.when(F.size("_at") > 0, 1.0 - scoring.clamp(F.array_min("_at") / 8.0)).otherwise(F.lit(0.0))
    author_hit = F.when(F.col("by_author"), 1.0).when(
        (F.col("_n_author") > 0) & (F.col("_n_author") == F.size(distinct)), 0.7).otherwise(0.0)
    ascending = F.aggregate(
        "_at", F.struct(F.lit(True).alias("ok"), F.lit(-1).alias("last")),
        lambda s, p: F.struct((s["ok"] & (p > s["last"])).alias("ok"), p.alias("last")),
    )["ok"]
    phrase = F.when(F.col("_n_title") < 2, F.when(F.col("has_phrase"), 1.0).otherwise(0.0)).otherwise(
        F.size("_at") / (F.array_max("_at") - F.array_min("_at") + 1) * F.when(ascending, 1.0).otherwise(0.8)
    )
    w = fixed.SEARCH_WEIGHTS
    rows = rows.select(
        "*", cover.alias("_cover"), exact.alias("_exact"), soft.alias("_soft"), head.alias("_head"),
        author_hit.alias("_author"), phrase.alias("_phrase"), scoring.freshness("published", as_of).alias("_fresh"),
    )
    total = (
        w["taste"] * F.col("taste") + w["lex"] * F.col("lex") + w["cover"] * F.col("_cover")
        + w["exact"] * F.col("_exact") * F.col("_cover") + w["phrase"] * F.col("_phrase") * F.col("_cover")
        + w["head"] * F.col("_head") + w["soft"] * F.col("_soft") + w["author"] * F.col("_author")
        + w["fresh"] * F.col("_fresh") + w["prio"] * scoring.priority_share("prio")
        + w["brevity"] * (1.0 - scoring.clamp((F.col("title_len") - fixed.IDEAL_TITLE) / fixed.TITLE_SPREAD))
    )
    missing = F.filter(distinct, lambda t: F.greatest(level(t, "title_level"), level(t, "author_level")) == 0)
    return rows.select(
        "query_id", "post_id", "url", "author", "published", "mode", "scanned", "bm",
        F.round(total, 4).alias("score"), F.round(F.round("_cover", 9), 3).alias("cover"), missing.alias("missing"),
        (F.round("taste", 3) >= fixed.TASTE_SHOWN).alias("yours"),
    )


def rank_order() -> list[Column]:
    """Rounded score, then newer, then URL, all descending; a missing date sorts last."""
    return [F.desc("score"), F.desc_nulls_last("published"), F.desc("url")]


def rank(index: Index, queries: DataFrame, candidates: DataFrame, as_of, prior: DataFrame | None = None) -> DataFrame:
    """Scored candidates with their rank in the query (a band of at most 1,200 rows each)."""
    rows = score(index, queries, candidates, as_of, prior)
    return top_per_key(rows, ["query_id"], rank_order(), fixed.MAX_CANDIDATES)


def headline_signatures(index: Index, posts: DataFrame) -> DataFrame:
    """(post_id, sig) of the given posts, from the stems the index already holds."""
    own = index.postings.filter((F.col("tf_title") > 0) & ~F.col("token").isin(fixed.STOPWORDS)).join(posts, "post_id")
    key = own.groupBy("post_id").agg(F.md5(F.array_join(F.array_sort(F.collect_set("stem")), " ").cast("binary")).alias("key"))
    bare = index.docs.select("post_id", F.md5(F.lower(F.trim("title")).cast("binary")).alias("sig")).join(posts, "post_id").join(key, "post_id", "left_anti")
    return key.withColumnRenamed("key", "sig").unionByName(bare)


def search(
    queries: DataFrame, index: Index, as_of, *, page_size: int = 20, offset: int = 0, mode: str | None = None,
    prior: DataFrame | None = None, author_cap: int = fixed.AUTHOR_CAP,
) -> DataFrame:
    """One page of results for every query: retrieval, ranking, variety, slice."""
    found = retrieve(index, queries, offset=offset, page_size=page_size, mode=mode)
    ranked = stage(rank(index, queries, found, as_of, prior), "band")
    signed = headline_signatures(index, stage(ranked.select("post_id").distinct(), "shown"))
    varied = diversify_bounded(
        ranked.drop("bm").join(signed, "post_id"), "query_id", "rank", "author", "sig", author_cap,
    )
    last = offset + page_size
    return varied.filter((F.col("position") > offset) & (F.col("position") <= last)).withColumn(
        "more", F.col("scanned") > last).drop("sig", "kept", "rank")


def missing_notice(hits: DataFrame) -> DataFrame:
    """Per query: the first four (alphabetically) words that some shown title lacks, when the search was widened."""
    words = hits.filter(F.col("mode") != "all").select("query_id", F.explode("missing").alias("w")).distinct()
    first = top_per_key(words, ["query_id"], [F.asc("w")], 4)
    return first.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("w")), ", ").alias("missing_words"))
