"""Language-model scores by context-tree weighting over bytes.

Text: lower-cased words joined by one space and closed by a line feed, as UTF-8. A byte is eight binary decisions; each of
the 255 decision nodes has a context tree over the last ``depth`` bytes. A tree node holds the counts of zeros and ones
after its context; its Krichevsky-Trofimov estimate is mixed, half and half, with the product over its longer contexts.
That mixture, frozen after training, gives each next bit the weighted average of the estimates of all depths.

Everything depends only on runs of ``depth + 1`` bytes, so the tree is built from their counts: Spark sums them over all
training documents, builds the levels from the deepest up (logarithm of each node's mixture) and then from the root down
(weight and probability of each path): the lowest levels in groups of whole subtrees, the others with one aggregation or
join per level. No model is broadcast: documents are dealt into
blocks of bounded bytes, and each block is joined with the runs and words that occur in it. Words are told apart by 64-bit hashes.

Null and empty text: only the end. Null doc_id counts as training. Repeated rows: each is counted and scored. Empty table:
no rows. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 5
BLOCK_BYTES = 24 << 20
GROUP_RUNS = 300_000


def log_gamma(x: Column) -> Column:
    """Stirling's series after seven steps of the recurrence; x of 1/2 or more."""
    y = x + 7
    steps = F.lit(1.0)
    for k in range(7):
        steps = steps * (x + k)
    inv = 1 / (y * y)
    tail = (F.lit(1 / 12) - inv * (F.lit(1 / 360) - inv * (F.lit(1 / 1260) - inv / 1680))) / y
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + tail - F.ln(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Natural logarithm of the Krichevsky-Trofimov estimate of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def normal(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = (text or b"").translate(common.LOWER).split()
    return words, b" ".join(words) + b"\n"


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``depth + 1`` bytes that end at each byte, as a number; bytes per text). Before a text there are zero bytes."""
    pad = bytes(depth)
    flat = np.frombuffer(b"".join([y for t in texts for y in (pad, t)]), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.zeros(max(0, len(flat) - depth), dtype=np.int64)
    for k in range(depth + 1):
        out = (out << 8) | flat[k : k + len(out)]
    starts = np.cumsum(sizes + depth) - sizes - depth
    keep = np.ones(len(out), dtype=bool)
    for k in range(depth):
        own = starts[1:] - depth + k
        keep[own] = False
    return out[keep], sizes


def word_keys(known: common.Hashes, words: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of the words of some texts, one after another."""
    return known.of([w for ws in words for w in ws]).view(np.int64)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(at, weights=np.concatenate([n for _, n in found]), minlength=len(keys)).astype(np.int64)


def count_block(depth: int):
    """One block's distinct runs and words (by hash), each with its count in training documents."""

    def count(key, rows):
        known = common.Hashes(xxhash.xxh3_64_intdigest, 200_000)
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        found = {True: [none], False: [none]}
        for batch in rows.to_batches(max_chunksize=512):
            both = list(zip(map(normal, batch.column(2).to_pylist()), batch.column(3).to_pylist()))
            for learn in (True, False):
                own = [x for x, held in both if held != learn]
                if own:
                    for is_run, keys in ((True, runs([t for _, t in own], depth)[0]), (False, word_keys(known, [ws for ws, _ in own]))):
                        keys, n = np.unique(keys, return_counts=True)
                        found[is_run].append((keys, n * learn))
            for k, v in found.items():
                if len(v) > 8:
                    found[k] = [_added(v)]
        (run, n), (word, m) = _added(found[True]), _added(found[False])
        return pa.table({
            "block": pa.array(np.full(len(run) + len(word), key[0].as_py(), np.int64)), "is_run": pa.array(np.arange(len(run) + len(word)) < len(run)),
            "key": pa.array(np.concatenate([run, word])), "n": pa.array(np.concatenate([n, m])),
        })

    return count


def np_log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``log_kt`` for arrays."""
    def log_gamma(x):
        y, steps = x + 7, np.ones_like(x)
        for k in range(7):
            steps = steps * (x + k)
        inv = 1 / (y * y)
        tail = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
        return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + tail - np.log(steps)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def subtrees(run: np.ndarray, n: np.ndarray, depth: int, top: int):
    """The levels ``depth`` to ``top`` of some trees: (key = ctx * 256 + node, c0, c1, logw, parent's place), and the runs' bits.

    The bits are (place in the deepest level, whether the bit is one), eight for each run.
    """
    symbol = run & 255
    key = np.concatenate([(run >> 8) << 8 | (symbol + 256) >> (8 - k) for k in range(8)])
    one = np.concatenate([(symbol >> (7 - k) & 1) == 1 for k in range(8)])
    key, at = np.unique(key, return_inverse=True)
    many = np.tile(n, 8).astype(float)
    c0, c1 = (np.bincount(at, weights=many * x, minlength=len(key)) for x in (~one, one))
    out = [[key, c0, c1, np_log_kt(c0, c1), None]]
    for d in range(depth - 1, top - 1, -1):
        key, c0, c1, logw, _ = out[-1]
        up, place = np.unique(((key >> 8) & ((1 << 8 * d) - 1)) << 8 | key & 255, return_inverse=True)
        c0, c1, below = (np.bincount(place, weights=x, minlength=len(up)) for x in (c0, c1, logw))
        out[-1][4] = place
        out.append([up, c0, c1, np.logaddexp(np_log_kt(c0, c1), below) - math.log(2), None])
    return out, at, one


def up_block(depth: int, top: int):
    """Level ``top`` of the subtrees of one group of runs."""

    def up(key, rows):
        found, _, _ = subtrees(rows.column("run").to_numpy(), rows.column("n").to_numpy(), depth, top)
        key, c0, c1, logw, _ = found[-1]
        return pa.table({"ctx": pa.array(key >> 8), "node": pa.array((key & 255).astype(np.int32)), "c0": pa.array(c0.astype(np.int64)),
                         "c1": pa.array(c1.astype(np.int64)), "logw": pa.array(logw)})

    return up


def down_block(depth: int, top: int):
    """run -> log10 probability of its last byte, from what the levels above give for each node of level ``top``."""

    def down(key, rows, above):
        run = rows.column("run").to_numpy()
        found, at, one = subtrees(run, rows.column("n").to_numpy(), depth, top)
        given = above.column("ctx").to_numpy() << 8 | above.column("node").to_numpy()
        order = np.argsort(given)
        place = order[np.searchsorted(given[order], found[-1][0])]
        p1, rest = above.column("p1").to_numpy()[place], above.column("rest").to_numpy()[place]
        for d, (_, c0, c1, logw, _) in zip(range(top, depth + 1), found[::-1]):
            if d > top:
                place = found[depth - d][4]
                p1, rest = p1[place], rest[place]
            w = 1.0 if d == depth else np.minimum(1.0, 0.5 * np.exp(np_log_kt(c0, c1) - logw))
            p1 = p1 + rest * w * (c1 + 0.5) / (c0 + c1 + 1)
            rest = rest * (1 - w)
        p = np.where(one, p1[at], 1 - p1[at])
        return pa.table({"run": pa.array(run), "value": pa.array(np.log10(p).reshape(8, -1).sum(axis=0))})

    return down


def levels(deepest: DataFrame, top: int) -> list[DataFrame]:
    """Levels 0 to ``top`` of all trees from level ``top``: ctx (the last d bytes), node (1 to 255), c0, c1, logw."""
    out = [deepest]
    for d in range(top - 1, -1, -1):
        up = out[0].withColumn("ctx", F.col("ctx").bitwiseAND((1 << 8 * d) - 1)).groupBy("ctx", "node").agg(
            F.sum("c0").alias("c0"), F.sum("c1").alias("c1"), F.sum("logw").alias("below"))
        up = up.withColumn("own", log_kt(F.col("c0"), F.col("c1")))
        most = F.greatest("own", "below")
        mixed = most + F.ln(0.5 * F.exp(F.col("own") - most) + 0.5 * F.exp(F.col("below") - most))
        out.insert(0, common.staged(up.select("ctx", "node", "c0", "c1", mixed.alias("logw")), "level"))
    return out


def paths(tree: list[DataFrame]) -> DataFrame:
    """What the levels above the last one give to its nodes: ctx, node, p1 (of a one, so far), rest (weight left)."""
    kt1 = (F.col("c1") + 0.5) / (F.col("c0") + F.col("c1") + 1.0)
    own = F.least(F.lit(1.0), F.exp(log_kt(F.col("c0"), F.col("c1")) - F.col("logw")) * 0.5)
    above = tree[0].select("ctx", "node", F.lit(0.0).alias("p1"), F.lit(1.0).alias("rest"))
    for d, level in enumerate(tree[:-1]):
        here = above.join(level.select("ctx", "node", kt1.alias("k1"), own.alias("w")), ["ctx", "node"]).select(
            F.col("ctx").alias("up"), "node", (F.col("p1") + F.col("rest") * F.col("w") * F.col("k1")).alias("p1"), (F.col("rest") * (1 - F.col("w"))).alias("rest"))
        below = tree[d + 1].select("ctx", "node", F.col("ctx").bitwiseAND((1 << 8 * d) - 1).alias("up"))
        above = below.join(here, ["up", "node"]).select("ctx", "node", "p1", "rest")
    return above


def run_scores(counts: DataFrame, depth: int) -> DataFrame:
    """run -> log10 probability of its last byte after the bytes before it.

    The two deepest levels are handled in groups of whole subtrees: a subtree below ``depth - 2`` bytes has at most 256**3
    runs, whatever the corpus. The levels above are aggregations and joins.
    """
    top = max(0, depth - 2)
    groups = counts.count() // GROUP_RUNS + 1
    under = lambda ctx: F.pmod(F.xxhash64(ctx.bitwiseAND((1 << 8 * top) - 1)), F.lit(groups)).alias("part")
    dealt = counts.select(under(F.shiftright("run", 8)), "run", "n")
    deepest = dealt.groupBy("part").applyInArrow(up_block(depth, top), "ctx long, node int, c0 long, c1 long, logw double")
    above = paths(levels(common.staged(deepest, "level"), top))
    above = above.select(under(F.col("ctx")), "ctx", "node", "p1", "rest")
    return dealt.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(down_block(depth, top), "run long, value double")


def score_block(depth: int, per_token: float):
    """Scores of a block's documents from the values of its runs and the counts of its words."""

    def score(key, docs, model):
        known = common.Hashes(xxhash.xxh3_64_intdigest, 200_000)
        is_run, keys, values = (model.column(c).to_numpy() for c in ("is_run", "key", "value"))
        run, word = (common.Table(keys[part], values[part]) for part in (is_run, ~is_run))
        out = []
        for batch in docs.to_batches(max_chunksize=512):
            both = list(map(normal, batch.column(2).to_pylist()))
            g, sizes = runs([t for _, t in both], depth)
            points = np.add.reduceat(run.of(g), np.cumsum(sizes) - sizes)
            n_words = np.array([len(ws) for ws, _ in both], dtype=np.int64)
            n = word.of(word_keys(known, [ws for ws, _ in both])) if n_words.sum() else np.zeros(0)
            doc = np.repeat(np.arange(len(both)), n_words)
            out.append(pa.RecordBatch.from_arrays([
                batch.column(1), batch.column(3), pa.array(n_words + 1), pa.array(np.bincount(doc, weights=n > 0, minlength=len(both)).astype(np.int64)),
                pa.array(np.bincount(doc, weights=np.log10(n + 1.0), minlength=len(both)) - n_words * per_token), pa.array(points), pa.array(sizes),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "word_score", "score", "n_bytes"]))
        kinds = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("word_score", pa.float64()),
                 ("score", pa.float64()), ("n_bytes", pa.int64())]
        return pa.Table.from_batches(out, pa.schema(kinds))

    return score


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte of each document.

    ``held_out``: true for rows that are not learned from. Depths up to 6 fit into the 64 bits of a run.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    rows = common.doc_rows(docs).withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    total, train = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 100), F.count(F.when(~F.col("held_out"), 1))).first()
    blocks = max(1, -(-(total or 0) // block_bytes))
    dealt = rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), "doc_id", "text", "held_out")
    needs = common.staged(dealt.groupBy("block").applyInArrow(count_block(depth), "block long, is_run boolean, key long, n long"), "needs")
    counts = common.staged(needs.filter("is_run").groupBy(F.col("key").alias("run")).agg(F.sum("n").alias("n")), "runs")
    words = common.staged(needs.filter("NOT is_run").groupBy("key").agg(F.sum("n").cast("double").alias("value")), "words")
    known, kinds = words.filter("value > 0").agg(F.sum("value"), F.count("*")).first()
    tokens = int(known or 0) + train  # one end for each training document
    size = kinds + (train > 0)
    per_token = math.log10(tokens + size + 1)
    values = run_scores(counts, depth).select(F.lit(True).alias("is_run"), F.col("run").alias("key"), "value").unionByName(
        words.select(F.lit(False).alias("is_run"), "key", "value"))
    model = needs.select("block", "is_run", "key").join(values, ["is_run", "key"])
    out = dealt.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(
        score_block(depth, per_token), "doc_id long, held_out boolean, n_tokens long, n_known long, word_score double, score double, n_bytes long")
    end = math.log10(train + 1) - per_token
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + int(train > 0)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("word_score") + end).alias("base_score"), "score", "n_bytes", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
