"""Text jobs over whole documents: key sentences and re-anchoring of quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed


def _spread(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key)


def sentences(text):
    """Sentences of 50 to 400 characters that do not look like code."""
    plain = F.regexp_replace(text, r"\s+", " ")
    # the unfinished tail is matched too and dropped below: a pattern that cannot match it would rescan it per letter
    found = F.transform(F.regexp_extract_all(plain, F.lit(r"[^.!?]++(?:[.!?]++|\z)"), F.lit(0)), lambda s: F.trim(s))
    ended = lambda s: F.right(s, F.lit(1)).isin(".", "!", "?")
    return F.filter(
        found, lambda s: ended(s) & (F.length(s) > 50) & (F.length(s) < 400) & ~s.rlike(r"[{};=]{2}"))


def summary_words(sentence):
    found = F.regexp_extract_all(F.lower(sentence), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(fixed.SUMMARY_STOPWORDS))


def sentence_frequencies(documents: DataFrame) -> DataFrame:
    """(doc_id, word, df): in how many of the document's sentences a word occurs."""
    rows = documents.select("doc_id", F.posexplode(sentences("text")).alias("i", "s"))
    words = rows.select("doc_id", "i", F.explode(F.array_distinct(summary_words("s"))).alias("word"))
    return words.groupBy("doc_id", "word").agg(F.count("*").alias("df"))


def key_sentences(documents: DataFrame, most: int = 7) -> DataFrame:
    """Extractive summary: (doc_id, i, sentence, score), sentences in text order.

    Documents are spread by id once; counting, scoring and choosing all happen where the document is.
    """
    docs = _spread(documents.select("doc_id", "text"), "doc_id")
    s = docs.select("doc_id", sentences("text").alias("s")).filter(F.size("s") >= 3)
    rows = s.select("doc_id", F.size("s").alias("n"), F.posexplode("s").alias("i", "sentence"))
    words = rows.select("doc_id", "n", "i", F.explode_outer(summary_words("sentence")).alias("word"))
    used = words.groupBy("doc_id", "n", "i", "word").agg(F.count("word").alias("tf"))
    df = F.count("word").over(Window.partitionBy("doc_id", "word"))
    scored = (
        used.withColumn("df", df)
        .groupBy("doc_id", "n", "i")
        .agg(F.sum("tf").alias("len"),
             F.sum(F.when(F.col("df") > 1, F.col("tf") * F.log(F.col("df") + 1.0)).otherwise(0.0)).alias("sum"))
    )
    score = F.col("sum") / F.sqrt(F.col("len") + 1) * F.when(F.col("i") < 3, 1.2).otherwise(1.0)
    take = F.least(F.lit(most), F.greatest(F.lit(3), F.floor(F.col("n") / 12 + 0.5)))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("i"))
    best = (
        scored.withColumn("score", F.round(score, 6)).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= take)
        .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "score"))).alias("best"))
    )
    chosen = docs.join(best, "doc_id").select("doc_id", "best", F.posexplode(sentences("text")).alias("i", "sentence"))
    return chosen.filter(F.map_contains_key("best", F.col("i"))).select(
        "doc_id", F.col("i").cast("bigint").alias("i"), "sentence", F.col("best")[F.col("i")].alias("score"))


def quote_candidates(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """(quote_id, doc_id) of documents that may hold the quote: they share its rarest word run.

    A quote's first and last words can be cut mid-word, so runs that touch its edges are not used as keys unless
    they are all it has; ``documents`` then are checked by containment of the whole quote.
    """
    run = r"[\p{L}\p{N}]+"

    def runs(c):
        return F.regexp_extract_all(c, F.lit(run), F.lit(0))

    inner = F.regexp_extract_all("quote", F.lit(r"(?<=[^\p{L}\p{N}])" + run + r"(?=[^\p{L}\p{N}])"), F.lit(0))
    keyed = quotes.withColumn("keys", F.array_distinct(inner))
    vocabulary = documents.select("doc_id", F.explode(F.array_distinct(runs("text"))).alias("run"))
    wanted = keyed.select("quote_id", F.explode("keys").alias("run"))
    hits = vocabulary.join(wanted.select("run").distinct(), "run", "left_semi")
    df = hits.groupBy("run").agg(F.count("*").alias("df"))
    # a key no document has gets df 0, and then the quote has no candidate at all
    rarest = wanted.join(df, "run", "left").groupBy("quote_id").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "run")).alias("k")).select("quote_id", F.col("k.run").alias("run"))
    found = hits.join(rarest, "run").select("quote_id", "doc_id")
    short = keyed.filter(F.size("keys") == 0).select("quote_id", "quote")
    # quotes without an inner run are one or two cut words: find runs of the vocabulary that contain their longest piece
    piece = F.try_element_at(F.array_sort(F.transform(runs("quote"), lambda r: F.struct(F.length(r).alias("n"), r.alias("r")))), F.lit(-1))["r"]
    probes = short.filter(F.size(runs("quote")) > 0).select("quote_id", piece.alias("piece")).withColumn("gram", F.substring("piece", 1, 3))
    words = vocabulary.select("run").distinct()

    def grams(n):
        return F.regexp_extract_all("run", F.lit("(?=(.{%d}))" % n), F.lit(1))

    by_gram = words.select("run", F.explode(F.array_distinct(F.concat(grams(1), grams(2), grams(3)))).alias("gram"))
    holds = by_gram.join(probes, "gram").filter(F.contains("run", F.col("piece"))).select("quote_id", "run").distinct()
    held = vocabulary.join(holds, "run").select("quote_id", "doc_id").distinct()
    # quotes of other characters only: their first character is the key
    other = short.filter((F.size(runs("quote")) == 0) & (F.col("quote") != "")).select("quote_id", F.substring("quote", 1, 1).alias("mark"))
    marks = documents.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}]"), F.lit(0)))).alias("mark"))
    return found.unionByName(held).unionByName(marks.join(other, "mark").select("quote_id", "doc_id"))


def contained_quotes(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """(quote_id, doc_id) for every document whose text holds the quote exactly."""
    pairs = quote_candidates(quotes, documents)
    return (
        pairs.join(quotes.select("quote_id", "quote"), "quote_id").join(documents.select("doc_id", "text"), "doc_id")
        .filter(F.contains("text", F.col("quote"))).select("quote_id", "doc_id")
    )


def anchor_quotes(quotes: DataFrame, documents: DataFrame) -> DataFrame:
    """Re-locate saved quotes in their document's present text.

    ``quotes``: quote_id, doc_id, quote, start, prefix, suffix. A quote still at its old place stays; else the
    occurrence with the best 2*prefix + suffix - distance/1e7 wins; no occurrence makes it an orphan (start null).
    """
    q = quotes.withColumn("prefix", F.coalesce("prefix", F.lit(""))).withColumn("suffix", F.coalesce("suffix", F.lit("")))
    rows = q.join(documents.select("doc_id", "text"), "doc_id", "left")
    quote, text = F.col("quote"), F.col("text")
    n = F.length(quote)
    here = (n > 0) & (F.substring(text, F.col("start") + 1, n) == quote)
    rows = rows.withColumn("here", F.coalesce(here, F.lit(False)))
    kept = rows.filter("here").select("quote_id", "doc_id", F.col("start").alias("at"))
    moved = rows.filter(~F.col("here") & (n > 0) & F.contains(text, quote))
    spots = moved.select("*", F.explode(occurrences(text, quote)).alias("at"))
    before = F.when(
        F.col("prefix") == "", True
    ).otherwise(F.substring(text, F.greatest(F.lit(0), F.col("at") - F.length("prefix")) + 1,
                            F.least(F.length("prefix"), F.col("at"))) == F.col("prefix"))
    after = F.substring(text, F.col("at") + n + 1, F.length("suffix")) == F.col("suffix")
    score = F.when(before, 2.0).otherwise(0.0) + F.when(after, 1.0).otherwise(0.0) - F.abs(F.col("at") - F.col("start")) / 1e7
    best = spots.groupBy("quote_id", "doc_id").agg(
        F.max_by("at", F.struct(score.alias("s"), (-F.col("at")).alias("o"))).alias("at"))
    found = kept.unionByName(best)
    return q.select("quote_id", "doc_id", "quote").join(found, ["quote_id", "doc_id"], "left").select(
        "quote_id", "doc_id", F.col("at").alias("start"), (F.col("at") + F.length("quote")).alias("end"),
        F.col("at").isNull().alias("orphan"))


def occurrences(text, quote):
    """0-based offsets of every occurrence of ``quote`` in ``text``, overlapping ones included.

    The text is split where the quote begins; the offsets are the running lengths of the pieces.
    """
    literal = F.concat(F.lit("\\Q"), F.replace(quote, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pieces = F.split(text, F.concat(F.lit("(?s)(?="), literal, F.lit(")")))
    nothing = F.array().cast("array<int>")
    walk = F.aggregate(
        F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), nothing.alias("found")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p)).alias("at"), F.array_append(s["found"], s["at"] + F.length(p)).alias("found")),
    )
    return F.concat(F.when(F.startswith(text, quote), F.array(F.lit(0))).otherwise(nothing), walk["found"])
