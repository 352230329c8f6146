"""Benchmark decontamination with a positional inverted index over the training documents.

A first pass counts, over all documents, the terms that test items use. Each window of a test item (ten consecutive words;
a shorter item is one window) is then looked up by its rarest term. A second pass stores positional postings (document,
term, positions) of the test items' terms for every document that holds a rarest term next to its neighbour in the window
(with ``slack``: as near to it as that allows), and the two words that it found so. Spark joins documents and items on
those two words; for each window the position lists, moved by their places in the window, are intersected from the rarest
term on, which leaves the starts of exact matches. With ``slack`` the same lists are matched within a few words instead,
which finds windows that were edited.

The sets of terms that the passes look for are bits of fixed size (``common.crc_bits``), whatever the size of the test
table; terms with equal bits only add postings that the join drops. An item with a null item_id counts like any other but has
no name in ``items`` and ``near_items``.

Null or empty text has no words: never contaminated, and an item without words is never found. Repeated rows get equal
results (rows are told apart by doc_id and text). Repeated items count once by item_id. Empty tables: no rows, or no
hits. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, tokens
from .op3_quality import let

WINDOW = 10
UNNAMED = "\x00"


def words_of(text: Column) -> Column:
    return F.filter(F.split(common.lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda x: x != "")


def item_name() -> Column:
    """The item's id as a string; an item without one is known by a mark and the hash of its text."""
    mark = F.concat(F.lit(UNNAMED), F.xxhash64("text").cast("string"))
    return F.coalesce(F.col("item_id").cast("string"), mark).alias("item_id")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id string, at, terms array: the distinct windows of each item."""
    rows = items.select(item_name(), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    last = F.greatest(F.size("w") - size, F.lit(0))
    rows = rows.select("item_id", "w", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    return rows.select("item_id", F.slice("w", F.col("at") + 1, F.lit(size)).alias("terms")).distinct()


def term_counts(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(crc long, n long): how often the words whose crc32 is in ``bits`` occur in all documents."""

    def count(batches):
        tokens.release()
        known, held = common.Hashes(zlib.crc32), []
        for batch in batches:
            texts = batch.column(0)
            for i in range(0, len(texts), 256):
                ws = [w for t in texts.slice(i, 256).to_pylist() for w in (t or b"").translate(common.ALNUM).split()]
                h = known.of(ws, np.int64)
                held.append(np.stack(np.unique(h[common.has_bit(bits, h)], return_counts=True)))
                if len(held) == 32:
                    held = [_merge(held)]
        if held:
            crc, n = _merge(held)
            yield pa.RecordBatch.from_arrays([pa.array(crc), pa.array(n)], names=["crc", "n"])

    return docs.select(F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(count, "crc long, n long").groupBy("crc").agg(F.sum("n").alias("n"))


def _merge(held):
    crc, n = np.concatenate(held, axis=1)
    values, at = np.unique(crc, return_inverse=True)
    return np.stack([values, np.bincount(at, weights=n, minlength=len(values)).astype(np.int64)])


def index(docs: DataFrame, vocabulary: np.ndarray, drivers: np.ndarray, anchors: np.ndarray, slack: int = 0) -> DataFrame:
    """Positional postings: doc_id, row, n_words and, where the document holds an anchor, (term, positions); anchors are
    terms without positions.

    ``anchors``: bits of drivers with a neighbour ("a b"); one is found where "b" stands one place after "a", give or take
    ``slack`` places (a place at or before "a" included). The driver of a window of one word is its anchor.
    """
    def anchored(ws, h) -> list[bytes]:
        at = np.flatnonzero(common.has_bit(drivers, h)).tolist()
        if not at:
            return []
        apart = range(1 - slack, 2 + slack)
        n = len(ws)
        pairs = list({ws[a] + b" " + ws[a + d] for p in at for d in apart for a in (p, p - d) if 0 <= a < n and 0 <= a + d < n} | {ws[p] for p in at})
        return [pairs[i] for i in np.flatnonzero(common.has_bit(anchors, np.fromiter(map(zlib.crc32, pairs), np.int64, len(pairs)))).tolist()]

    def post(batches):
        tokens.release()
        known = common.Hashes(zlib.crc32)
        for batch in batches:
            doc, n, term, places = [], [], [], []
            texts = batch.column(2)
            for i in range(batch.num_rows):
                ws = (texts[i].as_py() or b"").translate(common.ALNUM).split()
                doc.append(i), n.append(len(ws)), term.append(None), places.append(None)
                h = known.of(ws, np.int64)
                found = anchored(ws, h)
                if found:
                    for w in found:
                        doc.append(i), n.append(None), term.append(w.decode("utf-8", "replace")), places.append(None)
                    own: dict[bytes, list[int]] = {}
                    for p in np.flatnonzero(common.has_bit(vocabulary, h)).tolist():
                        own.setdefault(ws[p], []).append(p)
                    for w, ps in own.items():
                        doc.append(i), n.append(None), term.append(w.decode("utf-8", "replace")), places.append(ps)
            at = pa.array(doc, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(n, pa.int64()), pa.array(term, pa.string()), pa.array(places, pa.list_(pa.int32()))],
                names=["doc_id", "row", "n_words", "term", "positions"])

    rows = common.doc_rows(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(post, "doc_id long, row long, n_words long, term string, positions array<int>")


def ordered_windows(items: DataFrame, counts: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, at, terms array<struct<n, term, off>> rarest first; windows with a term that no document has are left out."""
    w = windows(items, size)
    w = w.withColumn("key", F.xxhash64("item_id", "terms"))
    each = w.select("item_id", "key", F.size("terms").alias("size"), F.col("terms").alias("words"), F.posexplode("terms").alias("off", "term"))
    each = each.withColumn("crc", F.crc32(F.col("term").cast("binary"))).join(counts, "crc", "left")
    out = each.groupBy("item_id", "key", "size", "words").agg(F.sort_array(F.collect_list(F.struct("n", "term", "off"))).alias("terms"))
    return out.filter(~F.exists("terms", lambda t: t["n"].isNull()))


def item_words(items: DataFrame, counts: DataFrame) -> DataFrame:
    """item_id, words array<struct<n, term>>: each item's words in order with their counts (null: no document has it)."""
    rows = items.select(item_name(), words_of(F.col("text")).alias("w")).distinct()
    each = rows.select("item_id", F.xxhash64("w").alias("key"), F.posexplode("w").alias("at", "term"))
    each = each.withColumn("crc", F.crc32(F.col("term").cast("binary"))).join(counts, "crc", "left")
    out = each.groupBy("item_id", "key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "term"))).alias("w"))
    return out.select("item_id", F.transform("w", lambda x: F.struct(x["n"].alias("n"), x["term"].alias("term"))).alias("words"))


def anchor() -> Column:
    """A window's rarest term with the term after it, or before it where it is the last ("a b"); a window of one word: that."""
    return F.array_join(F.slice("words", F.greatest(F.least(F.col("terms")[0]["off"], F.col("size") - 2), F.lit(0)) + 1, F.lit(2)), " ")


def matches(postings: DataFrame, ordered: DataFrame, words: DataFrame, size: int = WINDOW, slack: int | None = None) -> DataFrame:
    """doc_id, row, item_id, starts array<struct<start, size>> (exact) and near (windows found within ``slack`` words)."""
    # a window's rarest term stands next to its neighbour wherever the window does
    wanted = ordered.select("item_id", anchor().alias("term")).distinct()
    met = postings.filter("term IS NOT NULL AND positions IS NULL").select("doc_id", "row", "term")
    pairs = met.join(wanted, "term").select("doc_id", "row", "item_id").distinct()
    posted = postings.filter("positions IS NOT NULL").select("doc_id", "row", "term", "positions")
    pairs = pairs.join(words, "item_id").withColumnRenamed("doc_id", "_d").withColumnRenamed("row", "_r")
    lists = posted.distinct().groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("lists"))
    both = pairs.join(lists, pairs["_d"].eqNullSafe(lists["doc_id"]) & (pairs["_r"] == lists["row"])).drop("_d", "_r")
    # each window as its terms, rarest first; a term that no document has sorts first and rules the window out
    long = F.least(F.size("words"), F.lit(size))
    term = lambda x, off: F.struct(x["n"].alias("n"), x["term"].alias("term"), off.alias("off"))
    every = F.transform(F.sequence(F.lit(0), F.size("words") - long), lambda i: F.sort_array(F.transform(F.slice("words", i + 1, long), term)))
    both = both.withColumn("windows", F.filter(every, lambda w: w[0]["n"].isNotNull()))

    def moved(t):
        return F.transform(F.coalesce(F.try_element_at("lists", t["term"]), F.array().cast("array<int>")), lambda x: x - t["off"])

    rest = lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0)))
    exact = lambda w: F.aggregate(rest(w), moved(w[0]), lambda s, t: F.when(F.size(s) == 0, s).otherwise(F.array_intersect(s, moved(t))))
    found = F.flatten(F.transform("windows", lambda w: F.transform(exact(w), lambda s: F.struct(s.alias("start"), F.size(w).alias("size")))))
    near = F.lit(None).cast("int")
    if slack is not None:
        close = lambda w: F.aggregate(rest(w), moved(w[0]), lambda s, t: F.when(F.size(s) == 0, s).otherwise(
            let(moved(t), lambda m: F.filter(s, lambda a: F.exists(m, lambda b: F.abs(b - a) <= slack)))))
        near = F.size(F.filter("windows", lambda w: F.size(close(w)) > 0))
    return both.select("doc_id", "row", "item_id", found.alias("starts"), near.alias("near"))


def covered(spans: Column) -> Column:
    """Words inside spans (start, size) sorted by start and size."""
    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        spans, first,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["start"] + s["size"] - F.greatest(s["start"], a["end"]))).cast("long").alias("n"),
            F.greatest(a["end"], s["start"] + s["size"]).alias("end")),
        lambda a: a["n"])


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int | None = None) -> DataFrame:
    """One row per document row: doc_id, row, n_words, n_hit, items (sorted), near_items, contaminated."""
    ordered, words, postings = prepared(docs, items, size, slack or 0)
    found = matches(postings, ordered, words, size, slack)
    named = ~F.startswith("item_id", F.lit(UNNAMED))
    per = found.groupBy("doc_id", "row").agg(
        covered(F.array_sort(F.array_distinct(F.flatten(F.collect_list("starts"))))).alias("n_hit"),
        F.array_sort(F.collect_set(F.when((F.size("starts") > 0) & named, F.col("item_id")))).alias("items"),
        F.array_sort(F.collect_set(F.when((F.col("near") > 0) & named, F.col("item_id")))).alias("near_items"),
    ).withColumnRenamed("doc_id", "_d").withColumnRenamed("row", "_r")
    rows = postings.filter("term IS NULL").select("doc_id", "row", "n_words")
    none = F.array().cast("array<string>")
    return rows.join(per, rows["doc_id"].eqNullSafe(per["_d"]) & (rows["row"] == per["_r"]), "left").select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def prepared(docs: DataFrame, items: DataFrame, size: int = WINDOW, slack: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(windows by rarity, words of the items, postings), all written to the shared folder."""
    terms = windows(items, size).select(F.explode("terms").alias("term")).distinct()
    vocabulary = common.crc_bits(terms, "term")
    counts = common.staged(term_counts(docs, vocabulary), "counts")
    ordered = common.staged(ordered_windows(items, counts, size), "windows")
    words = common.staged(item_words(items, counts), "items")
    first = F.col("terms")[0]
    drivers = common.crc_bits(ordered.select(first["term"].alias("term")).distinct(), "term")
    anchors = common.crc_bits(ordered.select(anchor().alias("pair")).distinct(), "pair")
    return ordered, words, common.staged(index(docs, vocabulary, drivers, anchors, slack), "postings")
