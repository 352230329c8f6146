"""Near duplicates, packing, token files and the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import common
from folioscope.llm import op5_ngram_join as near
from folioscope.llm import op7_packing as packing
from folioscope.llm import op9_token_files as files
from folioscope.llm import tokens
from folioscope.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"


def shingles(t):
    w = (t or "").encode().translate(common.LOWER).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[find(k)].append(i)
    return [(i, len(s), min([x for x in least[find(k)] if x is not None], default=None)) for k, (i, s) in enumerate(sets)]


def same(got, want):
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(want, key=key)


def test_join_equals_brute_force(spark, docs):
    rnd = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 40)) for _ in range(120)]
    for i in range(120):  # a family of near copies around the threshold
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        rows.append((10_000 + i, " ".join(w)))
    shared = " ".join(f"boiler{i}" for i in range(60))
    rows += [(20_000 + i, shared + " " + " ".join(f"own{i}w{k}" for k in range(rnd.randint(5, 90)))) for i in range(60)]
    same(near.join(docs(rows)).collect(), brute_components(rows))


def test_near_copies_meet_at_their_first_shared_shingle(spark):
    """Two nodes that share many shingles make about one row, and none of a pair's links is lost."""
    rnd = random.Random(7)
    order = list(range(1000, 1040))
    own = {node: [s for s in order if rnd.random() < 0.9] for node in range(30)}
    own |= {100: order[:1] + list(range(20)), 101: list(range(40, 60)) + order[-1:], 102: list(range(60, 80)) + order[-1:]}
    posted = [(s, 400, k, node) for node, ss in own.items() for k, s in enumerate(ss)]
    posted = spark.createDataFrame(posted, "shingle long, n long, pos long, node long")
    comp = spark.createDataFrame([(node, 0) for node in range(15)], "node long, comp long")
    rows = [(r["a"], r["b"]) for r in near.apart(posted, comp, 80).collect()]
    of = {node: 0 if node < 15 else node for node in own}
    want = {(a, b) for a in own for b in own if a < b and of[a] != of[b] and set(own[a]) & set(own[b])}
    assert set(rows) == want and (101, 102) in want and len(rows) <= 2.5 * len(want)


def test_join_odd_rows(odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = near.join(odd).collect()
    want = brute_components(rows)
    want = [(i, n, c if n else i) for i, n, c in want]
    same(got, want)
    assert near.join(docs([])).collect() == []


def test_components_of_a_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:])], "a long, b long")
    assert {r["comp"] for r in near.components(links).collect()} == {0}
    assert near.components(links).count() == n


def test_plan_uses_everything():
    rnd = random.Random(2)
    counts = {rnd.randint(1, 64): rnd.randint(1, 500) for _ in range(40)}
    plan = packing.best_two_fit(counts, 64)
    used = defaultdict(int)
    for times, use in plan:
        assert times > 0 and sum(k * n for k, n in use.items()) <= 64
        for k, n in use.items():
            used[k] += n * times
    assert used == counts
    gaps = [0] * 64 + [10**9]  # best fit, largest first
    for k in sorted(counts, reverse=True):
        for _ in range(counts[k]):
            g = next(g for g in range(k, 65) if gaps[g])
            gaps[g] -= 1
            gaps[g - k] += 1
    assert sum(t for t, _ in plan) <= (10**9 - gaps[64]) * 1.01 + 1


def test_two_fit_replaces_the_smallest():
    # greedy: 6 + 3 leaves 1; 2 + 2 instead of 3 fills the bin
    assert packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})


def test_pack_places(spark, docs, odd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    both = docs(rows).unionByName(odd)
    out = packing.pack(packing.pieces(both, tokenizer_path()), part_rows=50).collect()
    enc = direct()
    want = sorted((zlib.crc32(np.array(enc(t), "<u4")[a : a + 4096].tobytes()), a, len(enc(t)[a : a + 4096])) for _, t in texts(both) for a in range(0, len(enc(t)), 4096))
    assert sorted((r["ids_crc32"], r["start"], r["length"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= sum(r["length"] for r in out) / 4096 * 1.03 + 1
    assert packing.pack(packing.pieces(docs([]), tokenizer_path())).collect() == []


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def direct():
    from tokenizers import Tokenizer

    tok, known = Tokenizer.from_file(tokenizer_path()), {}

    def ids(t):
        if t not in known:
            known[t] = tok.encode(t or "", add_special_tokens=False).ids + [1]
        return known[t]

    return ids


def test_files_round_trip(spark, docs, odd):
    special = [(-1, "It's <|endoftext|> a b   x\u0085y é é \x1c ΣΑΣ"), (-2, "İstanbul İ̇ ﬁ 12345")]
    both = docs([(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + special).unionByName(odd)
    folder = common.shared_folder(spark, "tokens")
    manifest = files.write(both, folder, tokenizer_path(), shard_bytes=100_000)
    out = files.read(manifest, folder, tokenizer_path()).collect()
    assert manifest.count() > 3
    enc = direct()
    rows = sorted(texts(both), key=lambda x: (x[0] is not None, x[0], x[1] is not None, x[1]))
    got = sorted(out, key=lambda r: r["start"])
    at = 0
    assert len(got) == len(rows)
    for r, (i, t) in zip(got, rows):
        assert (r["doc_id"], r["start"]) == (i, at)
        if i != 1000004 and i is not None:
            assert (r["n_tokens"], r["ids_crc32"]) == (len(enc(t)), zlib.crc32(np.array(enc(t), "<u4").tobytes()))
        at += r["n_tokens"]
    empty = common.shared_folder(spark, "tokens")
    assert files.read(files.write(docs([]), empty, tokenizer_path()), empty, tokenizer_path()).collect() == []


def test_new_words_share_calls():
    """A call for each new word costs more than its work: words are strung together and their ids told apart again."""
    enc = tokens.Encoder(tokenizer_path())
    odd = [b"", b"a\x01b", b"\xff\xfe bad \xc3", b"<|endoftext|>x", "don't é \u0301 e\u0301 İstanbul ﬁn 日本語 a\u00a0b".encode(), b"  lead\x0b tail\n", b"\x1ca\x85"]
    texts = [*odd, *(" ".join(f"w{i}x{j}," for j in range(40)).encode() for i in range(20))]
    lines, real = [], enc.tokenizer

    class Counted:
        def __getattr__(self, name):
            def call(texts, **more):
                lines.extend(texts)
                return getattr(real, name)(texts, **more)

            return call

    enc.tokenizer = Counted()
    got = [x.tolist() for x in enc.ids(texts, 1)]
    assert got == [[*real.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids, 1] for t in texts]
    assert len(lines) < 20


def test_near_copies_without_ids(spark, docs):
    """Null ids link like others; of a group that shares an id, or has none, one row stays."""
    base = [f"w{i}" for i in range(60)]
    other = [f"v{i}" for i in range(60)]
    edit = lambda ws, k: " ".join(ws[:k] + ["x"] + ws[k + 1 :])
    rows = [(None, " ".join(base)), (None, edit(base, 59)), (7, " ".join(other)), (7, edit(other, 0)), (3, edit(base, 0)), (9, None), (None, None), (9, None)]
    d = docs(rows)
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.join(d).collect()}
    assert found == {(None, 56, 3), (3, 56, 3), (7, 56, 7), (9, 0, 9), (None, 0, None)}
    kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()), key=repr)
    assert [k for k, _ in kept] == [3, 7, 9, None] and kept[1][1] in (rows[2][1], rows[3][1])
    alone = corpus_pipeline.near_duplicates(spark, docs(rows[:2]), SF).collect()
    assert len(alone) == 1 and alone[0]["doc_id"] is None


def test_pipeline_keeps_columns_of_its_names(spark, docs):
    d = docs([(1, "the quick fox jumps over a lazy dog. write to me@example.org " + " ".join(f"a{i}b" for i in range(60)))])
    for stage in (corpus_pipeline.quality, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated):
        assert stage(spark, d, SF).collect() == d.collect()
    from folioscope.llm import op2_pii

    odd = d.withColumns({"_h": F.lit(1), "_id": F.lit("i"), "a.b": F.lit(2), "_s": F.lit(3)})
    out = op2_pii.redact(odd)
    assert out.columns == odd.columns and out.drop("text").collect() == odd.drop("text").collect() and "[EMAIL]" in out.first()["text"]


@pytest.fixture(scope="module")
def stages(spark):
    d, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, d, SF), "test")
        out.append((name, d, after))
        d = after
    return out


def test_pipeline_stages(spark, stages):
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count(), name
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = stages
    from folioscope.llm import op2_pii, op3_quality, op6_decontaminate

    kept = {r["doc_id"] for r in op3_quality.judge(d0).filter("kept").collect()}
    assert {r["doc_id"] for r in d1.collect()} == kept
    assert {r["doc_id"] for r in d2.collect()} == {c for _, _, c in brute_components(texts(d1))}
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert {r["doc_id"] for r in d3.collect()} == {r["doc_id"] for r in op6_decontaminate.decontaminate(d2, items).filter("NOT contaminated").collect()}
    assert {r["doc_id"] for r in d4.collect()} == {r["doc_id"] for r in d3.collect()}
    assert all(not s["spans"] for s in op2_pii.find(d4).collect())
    enc = direct()
    assert d5.agg(F.sum("length")).first()[0] == sum(len(enc(t)) for _, t in texts(d4))


def test_pipeline_run(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() == stages[-1][2].count()


def test_pipeline_odd_rows(spark, odd):
    from pyspark.sql import types as T

    d = odd.select("doc_id", "text", "lang", F.lit(None).cast("string").alias("source"), F.lit(None).cast(T.LongType()).alias("n_chars"))
    for table in (d, d.limit(0)):
        x = table
        for _, stage in corpus_pipeline.STAGES:
            x = common.staged(stage(spark, x, SF), "test")
        assert x.count() == (0 if table is not d else x.count())
