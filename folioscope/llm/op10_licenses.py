"""License scan by diagonal voting.

Templates (phrases and standard notices, with a label) are split into k-grams of words, as documents are: a k-gram in both
votes for the diagonal "place in the document minus place in the template". Spark joins the document's rolling hashes to
the template positions and counts votes by diagonal. Phrases must match whole and word by word: all their votes lie on one
diagonal. A notice may be edited: a word more or less in the document moves the rest of a copy to the next diagonal. Votes on
neighbouring diagonals are merged into a span only where they align, that is where both places grow from vote to vote and
no step leaves the neighbourhood; a span is at most half as long again as its template, and it is kept when the aligned votes,
each place of the template counted once, are enough of it. Spans that overlap are one place; the best one stands for it.

A set of 2**22 bits of the templates' hashes drops, before the join, document k-grams that can't match.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, A-Z lower-cased. Null and empty text: no words.
Repeated rows and repeated or null doc_ids: rows are told apart by (doc_id, text), equal rows get equal results. Empty
table: no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# The phrases of the base and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Opening sentences of public licenses and common notices, with labels of this operator.
NOTICES = [
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd-text"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl-notice"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl-notice"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-notice"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("this work is licensed under the creative commons attribution", "cc-notice"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("released under the mit license", "mit-notice"),
]
#: Whole texts of short public licenses.
TEXTS = [
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
DEALINGS IN THE SOFTWARE.""", "mit-whole"),
    ("""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT
OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "isc-whole"),
]
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k consecutive words."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * MIX + hashes[j : j + len(out)])
    return out


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(common.ALNUM).split()


def template_rows(templates, exact: bool) -> list[tuple]:
    """(template, label, n_words, k, exact, place, hash) of every k-gram; a phrase uses k = 2, a notice k = 3."""
    out = []
    for i, (text, label) in enumerate(templates):
        ws = words(text.encode())
        k = min(2 if exact else 3, len(ws))
        for p, h in enumerate(rolling(np.array([xxhash.xxh3_64_intdigest(w) for w in ws], dtype=np.uint64), k)):
            out.append((text, label, len(ws), k, exact, p, int(np.int64(h.view(np.int64)))))
    return out


def votes(docs: DataFrame, phrases=PHRASES, notices=NOTICES + TEXTS) -> tuple[DataFrame, DataFrame]:
    """(n_words per row, k-gram places joined to template places); both hold doc_id and row, the hash of (doc_id, text)."""
    spark = docs.sparkSession
    rows = template_rows(phrases, True) + template_rows(notices, False)
    kinds = sorted({r[3] for r in rows})
    bits = np.zeros((1 << 22) // 64, dtype=np.uint64)
    for r in rows:
        at = r[6] & ((1 << 22) - 1)
        bits[at >> 6] |= np.uint64(1 << (at & 63))
    template = spark.createDataFrame(rows, "template string, label string, size int, k int, exact boolean, place int, hash long")

    def scan(batches):
        known = common.Hashes(xxhash.xxh3_64_intdigest)
        for batch in batches:
            texts = batch.column(2)
            out = {"doc": [], "n": [], "k": [], "at": [], "hash": []}
            for i in range(batch.num_rows):
                ws = words(texts[i].as_py())
                own = known.of(ws)
                out["doc"].append(np.array([i])), out["n"].append(np.array([len(ws)])), out["k"].append(np.array([0]))
                out["at"].append(np.array([0])), out["hash"].append(np.array([0]))
                for k in kinds:
                    h = rolling(own, k)
                    at = np.flatnonzero(common.has_bit(bits, h))
                    if len(at):
                        out["doc"].append(np.full(len(at), i)), out["n"].append(np.zeros(len(at), np.int64))
                        out["k"].append(np.full(len(at), k)), out["at"].append(at), out["hash"].append(h[at].view(np.int64))
            if not batch.num_rows:
                continue
            doc = pa.array(np.concatenate(out["doc"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc), batch.column(1).take(doc), *(pa.array(np.concatenate(out[c]).astype(np.int64)) for c in ("n", "k", "at", "hash"))],
                names=["doc_id", "row", "n_words", "k", "at", "hash"])

    source = common.doc_rows(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = common.staged(source.mapInArrow(scan, "doc_id long, row long, n_words long, k long, at long, hash long"), "kgrams")
    hits = found.filter("k > 0").drop("n_words").distinct().join(template, ["k", "hash"])
    return found.filter("k = 0").select("doc_id", "row", "n_words"), hits


def aligned(votes, size: int, k: int, drift: int, share: float):
    """Spans (start, end, score) of one template in one document from its votes (at, place), sorted.

    Each vote extends the longest run of earlier votes that it may follow. Only votes of the last ``size * 1.5`` words are
    looked at, so the work is linear in the votes.
    """
    most, total = size + size // 2, size - k + 1
    recent: deque[tuple[int, int, int, int]] = deque()  # at, place, votes in the run, start of the run
    best = None
    for at, place in votes:
        while recent and recent[0][0] < at - most:
            recent.popleft()
        n, start = 1, at
        for at0, place0, n0, start0 in recent:
            follows = at0 < at and place0 < place and abs((at - place) - (at0 - place0)) <= drift and at + k - start0 <= most
            if follows and (n0 + 1, start0) > (n, start):
                n, start = n0 + 1, start0
        recent.append((at, place, n, start))
        if n >= share * total:
            if best is not None and start >= best[2]:
                yield best[1], best[2], best[0]
                best = None
            if best is None or n / total > best[0]:
                best = (n / total, start, at + k)
    if best is not None:
        yield best[1], best[2], best[0]


def spans(hits: DataFrame, drift: int = 2, share: float = 0.7) -> DataFrame:
    """Verified spans: doc_id, row, template, label, exact, start, end (words, exclusive), score.

    A phrase's span holds all of its k-grams on one diagonal. A notice's span is an alignment of its votes (``aligned``).
    """
    key = ["doc_id", "row", "template", "label", "size", "k"]
    votes = hits.withColumn("diagonal", F.col("at") - F.col("place"))
    voted = votes.filter("exact").groupBy(*key, "diagonal").agg(F.countDistinct("place").alias("n"))
    whole = voted.filter(F.col("n") == F.col("size") - F.col("k") + 1).select(
        "doc_id", "row", "template", "label", F.lit(True).alias("exact"), F.col("diagonal").alias("start"),
        (F.col("diagonal") + F.col("size")).alias("end"), F.lit(1.0).alias("score"))
    # a notice needs its share of votes at all before their places are looked at
    near = votes.filter("NOT exact").select(*key, "at", "place").distinct()
    enough = near.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") >= share * (F.col("size") - F.col("k") + 1))
    enough = enough.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("template").alias("_t"), F.col("label").alias("_l"))
    same = near["doc_id"].eqNullSafe(F.col("_d")) & (near["row"] == F.col("_r")) & (near["template"] == F.col("_t")) & (near["label"] == F.col("_l"))
    near = near.join(enough, same, "left_semi")

    def walk(batches):
        group, held = None, []

        def out():
            doc, row, template, label, size, k = group
            return [(doc, row, template, label, False, *s) for s in aligned(held, size, k, drift, share)]

        for batch in batches:
            done = []
            for *own, at, place in zip(*(c.to_pylist() for c in batch.columns)):
                if own != group:
                    done += out() if held else []
                    group, held = own, []
                held.append((at, place))
            yield told(done)
        if held:
            yield told(out())

    def told(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
        cols = list(zip(*rows)) or [[]] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "row", "template", "label", "exact", "start", "end", "score"])

    kinds = "doc_id long, row long, template string, label string, exact boolean, start long, end long, score double"
    near = near.select(*key, "at", "place").repartition("doc_id", "row", "template").sortWithinPartitions("doc_id", "row", "template", "label", "at", "place")
    return whole.unionByName(near.mapInArrow(walk, kinds))


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES + TEXTS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, hits = votes(docs, phrases, notices)
    found = spans(hits)
    join = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.when(F.col("exact"), F.col("start"))
    per = found.groupBy("doc_id", "row").agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        join(F.when(F.col("exact"), F.col("label"))).alias("base_labels"), join("label").alias("labels"), F.max("score").alias("score"))
    per = per.withColumnRenamed("doc_id", "_doc").withColumnRenamed("row", "_row")
    out = rows.join(per, rows["doc_id"].eqNullSafe(per["_doc"]) & (rows["row"] == per["_row"]), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
