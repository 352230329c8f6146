"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams per language are summed by Spark over all training rows. The matrix of log
probabilities (buckets x languages, bounded by both) is broadcast; numpy scores batches of documents by gathering the rows
of their n-grams and adding them up per document.

Null text or text without a letter: ``und`` with score 0. A tie goes to the language that sorts first. Repeated rows: each
is scored. Nothing to learn from: every document is ``und``. Null lang is never learned. Other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .op10_licenses import MIX, mix

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PAD = max(ORDERS) - 1
ASCII = re.compile(rb"[A-Za-z]")


def grams(texts: list[bytes], buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """(bucket of the n-gram at each character, for each order; characters per text), lower-cased, texts one after another."""
    each = [np.frombuffer(t.decode("utf-8", "replace").lower().encode("utf-32-le"), dtype="<u4") for t in texts]
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    pad = np.zeros(PAD, dtype="<u4")
    flat = np.concatenate([y for x in each for y in (x, pad)] or [pad]).astype(np.uint64)
    starts = np.cumsum(sizes + PAD) - sizes - PAD
    keep = np.ones(len(flat), dtype=bool)
    for k in range(PAD):
        keep[starts + sizes + k] = False
    if not len(sizes):
        keep[:] = False
    out, h = [], np.zeros(len(flat), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, PAD + 2):
            nxt = np.concatenate([flat[n - 1 :], np.zeros(n - 1, np.uint64)])
            h = mix(h * MIX + nxt + np.uint64(n))
            if n in ORDERS:
                out.append((h[keep] & np.uint64(buckets - 1)).astype(np.int64))
    return out, sizes


def fit(rows: DataFrame, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log priors, log probabilities [buckets, languages]) from all rows (text binary, lang string)."""
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    n_docs = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row per language
    langs = sorted(n_docs)
    at = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros(buckets * len(langs), dtype=np.int64)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keys, sizes = grams(part.column(0).to_pylist(), buckets)
                lang = np.repeat(np.array([at[x] for x in part.column(1).to_pylist()], dtype=np.int64), sizes) * buckets
                for k in keys:
                    total += np.bincount(k + lang, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["cell", "n"])

    table = np.zeros((len(langs), buckets))
    if langs:
        sums = rows.select("text", "lang").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        table.reshape(-1)[sums["cell"].to_numpy(dtype=np.int64)] = sums["n"].to_numpy(dtype=float)
    logp = np.log((table + 1) / (table.sum(axis=1, keepdims=True) + buckets)).T
    docs = np.array([n_docs[x] for x in langs], dtype=float)
    return langs, np.log(docs / docs.sum()) if langs else docs, logp


def has_letter(text: bytes) -> bool:
    return bool(ASCII.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predict(rows: DataFrame, model, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` with lang_pred and score, the posterior probability of that language."""
    langs, prior, logp = model
    buckets = len(logp)
    shared = rows.sparkSession.sparkContext.broadcast(logp)

    def score(batches):
        table = shared.value
        for batch in batches:
            pred, prob = [], []
            texts = batch.column(batch.num_columns - 1)
            for i in range(0, len(texts), 256):
                own = [t or b"" for t in texts.slice(i, 256).to_pylist()]
                real = [k for k, t in enumerate(own) if langs and has_letter(t)]
                p, s = ["und"] * len(own), [0.0] * len(own)
                if real:
                    keys, sizes = grams([own[k] for k in real], buckets)
                    total = sum(table[k] for k in keys)
                    first = np.cumsum(sizes) - sizes
                    points = np.add.reduceat(total, first, axis=0) + prior
                    best = points.argmax(axis=1)
                    share = 1 / np.exp(points - points.max(axis=1, keepdims=True)).sum(axis=1)
                    for k, b, x in zip(real, best.tolist(), share.tolist()):
                        p[k], s[k] = langs[b], x
                pred += p
                prob += s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(prob, pa.float64())], names=[*keep, "lang_pred", "score"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.select(*keep).dtypes)
    return rows.select(*keep, "text").mapInArrow(score, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    return predict(rows, fit(rows.filter(~F.col("held_out"))), ["doc_id", "held_out"])
