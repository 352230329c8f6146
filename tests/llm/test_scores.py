"""Context-tree scores and language identification."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import op1_context_tree as ctw
from folioscope.llm import op4_language as lid


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """All context trees, bit by bit; the probability of a bit is a ratio of two mixtures."""

    def __init__(self, depth):
        self.depth, self.counts = depth, defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)

    def bits(self, text):
        data = bytes(self.depth) + text
        for i in range(self.depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield i, data[i - self.depth : i], node, bit
                node = node << 1 | bit

    def learn(self, text):
        for _, ctx, node, bit in self.bits(text):
            self.put(ctx, node, bit, 1)

    def put(self, ctx, node, bit, n):
        for d in range(self.depth + 1):
            own = ctx[self.depth - d :]
            self.counts[own, node][bit] += n
            if d:
                self.children[own[1:], node].add(own)

    def mixture(self, ctx, node):
        a, b = self.counts[ctx, node] if (ctx, node) in self.counts else (0, 0)
        own = log_kt(a, b)
        if len(ctx) == self.depth:
            return own
        below = sum(self.mixture(c, node) for c in self.children[ctx, node])
        return math.log(0.5) + np.logaddexp(own, below)

    def log10(self, text):
        total = 0.0
        for _, ctx, node, bit in list(self.bits(text)):
            before = self.mixture(b"", node)
            self.put(ctx, node, bit, 1)
            total += self.mixture(b"", node) - before
            self.put(ctx, node, bit, -1)
        return total / math.log(10)


def test_log_gamma(spark):
    xs = [0.5, 1.0, 1.5, 3.25, 17.5, 1e3, 1e7, 1e12]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(ctw.log_gamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-11, abs=1e-10)


@pytest.mark.parametrize("depth", [1, 2, 3])
def test_scores_equal_sequential_mixture(docs, depth):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["ab", "abc", "ba", "Ca"]) for _ in range(rnd.randint(0, 9))) for _ in range(14)] + [None, "é zzz"]
    rows = [(i, t) for i, t in enumerate(texts)]
    held = {3, 7, 15}
    out = {r["doc_id"]: r for r in ctw.score(docs(rows), F.col("doc_id").isin(*held), depth=depth, block_bytes=300).collect()}
    tree, words = Tree(depth), Counter()
    split = {i: (t or "").encode().translate(ctw.common.LOWER).split() for i, t in rows}
    for i, _ in rows:
        if i not in held:
            tree.learn(b" ".join(split[i]) + b"\n")
            words.update([*split[i], None])
    n, v = sum(words.values()), len(words)
    for i, _ in rows:
        r = out[i]
        assert r["score"] == pytest.approx(tree.log10(b" ".join(split[i]) + b"\n"), rel=1e-8)
        toks = [*split[i], None]
        assert r["base_score"] == pytest.approx(sum(math.log10((words[t] + 1) / (n + v + 1)) for t in toks), rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(toks), sum(words[t] > 0 for t in toks), n, i in held)
        assert r["bits_per_byte"] == pytest.approx(-r["score"] * math.log2(10) / r["n_bytes"])


def test_scores_odd_rows(odd, docs):
    out = ctw.score(odd, F.col("doc_id") == 1000004).collect()
    assert len(out) == odd.count()
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1000004}) == 1
    assert ctw.score(docs([]), F.lit(False)).collect() == []
    assert ctw.score(docs([(1, "a b")]), F.lit(True)).first()["n_known"] == 0


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = lid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out AND lang_pred <> 'und'")
    n, good = out.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and good / n > 0.97


def test_language_equals_plain_bayes(docs):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat", "en"), ("der Hund", "de"), ("the dog", "en"), ("die Katze", "de"), ("und die", None)])]
    model = lid.fit(docs(rows).select(F.col("text").cast("binary").alias("text"), "lang"))
    langs, prior, logp = model
    assert langs == ["de", "en"]
    counts = {x: Counter() for x in langs}
    for _, t, x in rows:
        if x:
            for keys in lid.grams([t.encode()])[0]:
                counts[x].update(keys.tolist())
    for _, t, _ in rows:
        points = [prior[i] + sum(math.log((counts[x][k] + 1) / (counts[x].total() + lid.BUCKETS)) for ks in lid.grams([t.encode()])[0] for k in ks.tolist())
                  for i, x in enumerate(langs)]
        r = lid.predict(docs([(1, t)]).select("doc_id", F.col("text").cast("binary").alias("text")), model, ["doc_id"]).first()
        assert r["lang_pred"] == langs[int(np.argmax(points))]
        assert r["score"] == pytest.approx(1 / sum(math.exp(p - max(points)) for p in points))


def test_grams_do_not_cross_texts():
    both, sizes = lid.grams([b"abc", b"", b"de"])
    alone = [lid.grams([t])[0] for t in (b"abc", b"de")]
    assert sizes.tolist() == [3, 0, 2]
    for n in range(3):
        assert both[n].tolist() == [*alone[0][n].tolist(), *alone[1][n].tolist()]


def test_language_odd_rows(odd, docs):
    out = lid.identify(odd).collect()
    assert len(out) == odd.count()
    for r in out:
        if r["doc_id"] in (1000001, 1000002, 1000003, 1000007, 1000009):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 0 <= r["score"] <= 1
    assert lid.identify(docs([])).collect() == []
    assert lid.identify(docs([(1, "text", None)])).first()["lang_pred"] == "und"
