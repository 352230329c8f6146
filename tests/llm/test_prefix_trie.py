"""The prefix trie against one that is built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm import op12_prefix_trie as op
from folioscope.llm.queries import QUERIES

KIND = "conv_id long, turn long, role string, text string, depth string, n string, size string, h1 string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], KIND)


def conversations(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
        leaves[k] = sum(leaves[x] for x in children[k]) if children[k] else 1
        saved[k] = own + sum(saved[x] for x in children[k])
    rows = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(convs[c]) == len(k)))
        rows.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sample(n, seed=3):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 4, 9, 12])):
            rows.append((c - 20, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "hi", "yes é", "no"])))
    return rows


@pytest.mark.parametrize("bits", [None, 3])
def test_against_brute_force(spark, bits, monkeypatch):
    if bits:  # a sketch that proves next to nothing
        monkeypatch.setattr(op, "MOST_BITS", bits)
        monkeypatch.setattr(op, "LEAST_BITS", bits)
    rows = sample(120)
    assert got(op.prefix_trie(table(spark, rows))) == brute(conversations(rows))
    assert got(op.branched_trie(table(spark, rows))) == brute(rebuilt(conversations(rows)))


def test_odd_rows(spark, monkeypatch):
    """Nulls, repeated rows, one long conversation cut into ranges, pieces of ids."""
    monkeypatch.setattr(op, "PIECE", 3)
    rows = [(1, None, None, None), (1, None, None, None), (1, 0, "user", None), (1, 0, "user", ""), (None, 1, "user", "x"), (2, 5, "user", "x"), (2, 5, "user", "x")]
    rows += [(40, k % 700, "user", "same") for k in range(1500)] + [(41, k, "user", "same") for k in range(900)]
    rows += [(100 + k, 0, "user", "hello") for k in range(25)] + [(-3, 0, "user", "q" * 50_000)]
    for made, want in ((op.prefix_trie, conversations), (op.branched_trie, lambda r: rebuilt(conversations(r)))):
        assert got(made(table(spark, rows))) == brute(want(rows))
    assert got(op.branched_trie(table(spark, []))) == []


def test_long_key_adds_up_over_ranges(spark):
    df = spark.range(5000).selectExpr("id % 2 + cast(id > 4000 as long) as k", "id", "id as a", "xxhash64(id) as x").repartition(7)
    out = sorted(map(tuple, op.running(df, "k", [F.col("id")], ["a"], ["x"]).select("k", "id", "a", "x").collect()))
    add, xor = defaultdict(int), defaultdict(int)
    hashes = {r["id"]: r["x"] for r in df.collect()}
    for k, i, a, x in out:
        add[k] += i
        xor[k] ^= hashes[i]
        assert (a, x) == (add[k], xor[k])


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_prefix_trie"](spark, sf)) == brute(rebuilt(conversations(rows)))
