"""Repeated byte strings against brute force, and the transforms against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from folioscope.llm import op11_repeats as op


def brute(rows, size):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if b[i : i + size] in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(b[i : i + size])
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def got_of(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


@pytest.mark.parametrize("size,hot", [(100, 20_000), (100, 2), (40, 20_000)])
def test_against_brute_force(spark, docs, size, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 50)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 80)
            p = p[a : a + rng.randint(90, 300)]
            if rng.random() < 0.4:  # an edit inside
                p = p[: len(p) // 2] + "#" + p[len(p) // 2 + 1 :]
            parts += [p, word()]
        rows.append((k * 3, " ".join(parts)))
    rows += [(500, "a" * 1000), (501, "ab" * 400), (502, "x\x00y" * 90), (503, None), (504, ""), (505, "z" * 99), (506, rows[7][1]), (507, "ab" * 400 + "a" * 300)]
    assert got_of(op.repeats(docs(rows), size, hot)) == brute(rows, size)


def test_odd_rows(spark, odd, docs):
    """Equal rows are one document; null ids come first; nulls and short texts lose nothing."""
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    out = op.repeats(odd)
    assert out.count() == len(rows)
    by = {d: v for d, v in got_of(out).items() if d is not None}
    assert by == brute([r for r in rows if r[0] is not None], 100)
    long = "one two three four five six " * 10
    twice = op.repeats(docs([(None, long), (4, long), (4, long)])).select("doc_id", "n_removed").collect()
    # the text repeats itself every 28 bytes
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in twice) == [(0, 252), (4, 280), (4, 280)]
    assert op.repeats(docs([])).count() == 0


def test_long_text_is_cut_with_overlap(spark, docs, monkeypatch):
    monkeypatch.setattr(op, "CHUNK", 700)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(5000))
    parts, where = zip(*op.chunks([type("T", (), {"as_py": lambda self: text.encode()})()], 700, 100))
    assert sum(len(p) - 99 for q in parts for p in q) == 5000 - 99 and len(where) > 5
    rows = [(1, text), (2, text[1300:2300] + "|" + text[100:250])]
    assert got_of(op.repeats(docs(rows))) == brute(rows, 100)


def test_transform_and_merge():
    """The transform of a collection can be undone; merging two gives the intervals of equal windows."""
    rng = random.Random(1)
    bodies = [bytes(rng.choice(b"ab") for _ in range(rng.randint(9, 30))) for _ in range(40)] + [b"abababababab", b"abababababab"]
    bwt = op.transform(bodies)
    string, offset, back = op.unwind(bwt, np.array([len(b) for b in bodies]))
    suffixes = [bodies[s][o:] for s, o in zip(string, offset)]
    assert suffixes == sorted(suffixes) and len(set(zip(string.tolist(), offset.tolist()))) == sum(len(b) + 1 for b in bodies)
    size = 8
    halves = [bodies[:20], bodies[20:]]
    string, offset, block = op.interleave([(op.transform(h), np.array([len(b) - size + 1 for b in h])) for h in halves], size)
    windows = [bodies[s][o : o + size] for s, o in zip(string, offset)]
    assert windows == sorted(windows) and len(windows) == sum(len(b) - size + 1 for b in bodies)
    assert [a == b for a, b in zip(block, block[1:])] == [a == b for a, b in zip(windows, windows[1:])]
