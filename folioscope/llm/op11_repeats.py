"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards.

A window is a string of ``size`` bytes of a document. Every byte covered by a window that also starts earlier (smaller
doc_id, or same document and earlier start) is removed.

1. Candidates. The smallest hash of the 36-byte grams in a window is its anchor: equal windows have equal anchors. Runs of
   windows with one anchor are one string, told from others by a 64-bit digest; the text moves nowhere yet. Of equal
   strings only the earliest needs a look, all windows of the others are repeats. A string whose anchor belongs to no
   other string, and which doesn't hold its anchor twice, has none. Nothing is lost here: what remains are strings that
   may share a part of their windows.
2. Shards. The remaining strings are dealt into buckets by anchor, each bucket into shards by document. A shard sorts the
   suffixes of its strings (prefix doubling) and passes on their Burrows-Wheeler transform.
3. Merge. A bucket interleaves its shards' transforms: the order of all suffixes by their first h bytes is a sequence of
   shard numbers; the bytes before them, sorted stably, give the order by the first h + 1 bytes. Three bytes are taken at
   once where the bucket has at most 65,536 such triples, else two. Only suffixes that stand h bytes before the end of a
   window take part in round h, so that each round has one element for each window. A boundary between two neighbours
   appears in the round that reaches their first difference; suffixes without a boundary after ``size`` bytes are a
   repeated interval. No suffix is compared or sorted again. The earliest window of an interval stays.
4. Runs of repeated windows are united per document.

A bucket has a bounded number of bytes. An anchor with over ``hot`` different strings doesn't enter a bucket: its windows
are keyed one by one with their own 64-bit digest, the smallest position of a digest stays.

Null text: empty. Texts below ``size`` bytes: nothing is removed. Null doc_id: comes before all others. Rows equal in
doc_id and text are one document, each row gets its result; rows with equal doc_id and different texts are ordered by a
hash of the text. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

GRAM = 36
CHUNK = 1 << 20
LONGEST = 128  # windows in one string
BUCKET = 2_000_000  # bytes in one bucket
SHARDS = 4
HOT = 20_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def grams(b: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all grams of ``size`` bytes, made from hashes of 1, 2, 4, ... bytes."""
    h, length = (b.astype(np.uint64) + np.uint64(1)) * _MIX, 1
    while 2 * length <= size:
        h = _mix(h[:-length]) * np.uint64(3) + h[length:]
        length *= 2
    rest = size - length
    return _mix(_mix(h[:-rest]) * np.uint64(5) + h[rest:]) if rest else _mix(h)


def slide(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    length = 1
    while 2 * length <= width:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    rest = width - length
    return np.minimum(v[:-rest], v[rest:]) if rest else v


def _powers(n: int):
    """Powers of an odd number and of its inverse, modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        m = max(n, 2 * CHUNK)
        both = [np.full(m, x & (2**64 - 1), dtype=np.uint64) for x in (_BASE, pow(_BASE, -1, 2**64))]
        for x in both:
            x[0] = 1
            np.multiply.accumulate(x, out=x)
        _POWERS[0] = (both[0], both[1])
    return _POWERS[0]


def strings_of(b: np.ndarray, base: np.ndarray, length: np.ndarray, size: int):
    """The strings of a chunk: (start in b, windows, anchor, digest, holds its anchor twice).

    ``base`` and ``length``: the chunk's segments, in order; a window doesn't cross them.
    """
    gram = min(GRAM, size)
    wide = size - gram + 1
    with np.errstate(over="ignore"):
        h = grams(b, gram)
        least = slide(h, wide)
        edge = np.zeros(len(least) + 1, dtype=np.int8)
        fits = length >= size
        edge[base[fits]] += 1
        edge[base[fits] + length[fits] - size + 1] -= 1
        valid = np.cumsum(edge[:-1]) > 0
        cut = np.empty(len(least), dtype=bool)
        cut[0], cut[1:] = True, least[1:] != least[:-1]
        cut |= edge[:-1] != 0
        at = np.flatnonzero(cut)
        n = np.diff(np.append(at, len(least)))
        at, n = at[valid[at]], n[valid[at]]
        parts = -(-n // LONGEST)
        if (parts > 1).any():
            first = np.repeat(np.cumsum(parts) - parts, parts)
            k = np.arange(len(first)) - first
            at, n = np.repeat(at, parts) + k * LONGEST, np.minimum(np.repeat(n, parts) - k * LONGEST, LONGEST)
        up, down = _powers(len(h))
        total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * up[: len(h)], out=total[1:])
        digest = _mix((total[at + n - 1 + wide] - total[at]) * down[at] + n.astype(np.uint64))
        anchor = least[at]
        # grams that are the smallest of a window, and equal ones near each other
        around = np.concatenate([np.zeros(wide - 1, np.uint64), least, np.zeros(wide - 1, np.uint64)])
        chosen = np.flatnonzero(~slide(~around, wide) == h)
        near = (h[chosen[1:]] == h[chosen[:-1]]) & (np.diff(chosen) <= wide + LONGEST)
        twice = np.isin(anchor, np.unique(h[chosen[1:][near]])) if near.any() else np.zeros(len(at), dtype=bool)
    return at, n, anchor, digest, twice


def chunks(texts, most: int, size: int):
    """(bytes, segments) of at most about ``most`` bytes; a segment is (row, start in the text). Long texts are cut with overlap."""
    parts, where, total = [], [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or b""
        for start in range(0, max(1, len(text) - size + 1), most):
            part = text[start : start + most + size - 1]
            parts.append(part), where.append((i, start))
            total += len(part)
            if total >= most:
                yield parts, where
                parts, where, total = [], [], 0
    if parts:
        yield parts, where


def candidates(rows: DataFrame, size: int) -> DataFrame:
    """The strings of all documents. ``later``: an equal one with an earlier place was seen in the same chunk."""

    def run(batches):
        for batch in batches:
            doc, row = batch.column(0), batch.column(1).to_numpy()
            null = np.asarray(doc.is_null())
            doc = doc.fill_null(0).to_numpy()
            for parts, where in chunks(batch.column(2), CHUNK, size):
                b = np.frombuffer(b"".join(parts), dtype=np.uint8)
                if len(b) < size:
                    continue
                length = np.array([len(p) for p in parts])
                base = np.cumsum(length) - length
                at, n, anchor, digest, twice = strings_of(b, base, length, size)
                if not len(at):
                    continue
                seg = np.searchsorted(base, at, side="right") - 1
                # empty segments share a base with the next one, which is the last of them
                who = np.array([w[0] for w in where])[seg]
                start = at - base[seg] + np.array([w[1] for w in where])[seg]
                d, r, later = doc[who], row[who], np.zeros(len(at), dtype=bool)
                with np.errstate(over="ignore"):
                    key = anchor * np.uint64(3) + digest
                order = np.argsort(key, kind="stable")
                same = key[order][1:] == key[order][:-1]
                if same.any():
                    member = np.zeros(len(at), dtype=bool)
                    member[1:] |= same
                    member[:-1] |= same
                    own = order[member]
                    own = own[np.lexsort((start[own], r[own], d[own], ~null[who[own]], key[own]))]
                    head = np.ones(len(own), dtype=bool)
                    head[1:] = key[own][1:] != key[own][:-1]
                    first = own[np.maximum.accumulate(np.where(head, np.arange(len(own)), 0))]
                    later[own] = (d[own] != d[first]) | (r[own] != r[first]) | (start[own] != start[first]) | (null[who[own]] != null[who[first]])
                    with np.errstate(over="ignore"):  # these need no meeting: spread them
                        anchor = np.where(later, _mix(digest + _mix(d.astype(np.uint64)) + start.astype(np.uint64) * _MIX), anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(d, mask=null[who]), pa.array(r),
                     pa.array((start.astype(np.int64) << 9) | (n.astype(np.int64) << 1) | twice), pa.array(later)],
                    names=["anchor", "digest", "doc_id", "row", "place", "later"])

    return rows.mapInArrow(run, "anchor long, digest long, doc_id long, row int, place long, later boolean")


def judged(found: DataFrame, hot: int) -> DataFrame:
    """Strings with a place for each: later copies, and those that need a look (``anchor`` not null, ``hot`` or not)."""
    place = F.struct("doc_id", "row", "place")
    same = W.partitionBy("anchor", "digest").orderBy("doc_id", "row", "place")
    out = found.withColumn("first", F.first(place).over(same)).withColumn("head", F.row_number().over(same) == 1)
    out = out.withColumn("texts", F.sum(F.col("head").cast("long")).over(W.partitionBy("anchor")))
    copy = F.col("later") | (place != F.col("first"))
    look = ~copy & F.col("head") & ((F.col("texts") > 1) | (F.col("place").bitwiseAND(1) == 1))
    return out.filter(copy | look).select(
        "doc_id", "row", F.shiftright("place", 9).alias("start"), F.shiftright("place", 1).bitwiseAND(255).cast("int").alias("n"),
        F.when(look, F.col("anchor")).alias("anchor"), (look & (F.col("texts") > hot)).alias("hot"))


def bodies(docs: DataFrame, wanted: DataFrame, size: int, buckets: int) -> DataFrame:
    """The bytes of the wanted strings. Hot ones: one row for each window, keyed by its digest, without bytes."""
    lists = wanted.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("own"))
    long = docs.filter(F.octet_length("text") >= size)  # shorter ones have no strings
    both = long.alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row")))

    def run(batches):
        last = None
        for batch in batches:
            out = []
            for doc, row, text, own in zip(*(batch.column(k) for k in range(4))):
                doc, row = doc.as_py(), row.as_py()
                if (doc, row) == last:  # a repeated row
                    continue
                last, text = (doc, row), text.as_py() or b""
                for s in own.as_py():
                    start, n = s["start"], s["n"]
                    body = text[start : start + n + size - 1]
                    if s["hot"]:
                        with np.errstate(over="ignore"):
                            keys = grams(np.frombuffer(body, dtype=np.uint8), size).view(np.int64).tolist()
                        out += [(0, 0, doc, row, start + j, 1, k, None) for j, k in enumerate(keys)]
                    else:
                        out.append((s["anchor"] % buckets, row % SHARDS, doc, row, start, n, 0, body))
                    if len(out) >= 20_000:
                        yield _bodies(out)
                        out = []
            if out:
                yield _bodies(out)

    text = both.select("d.doc_id", "d.row", "d.text", "l.own")
    return text.mapInArrow(run, "bucket int, shard int, doc_id long, row int, start long, n int, window long, body binary")


def _bodies(out) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["bucket", "shard", "doc_id", "row", "start", "n", "window", "body"])


def transform(body: list[bytes]) -> np.ndarray:
    """Burrows-Wheeler transform of a collection: uint16 codes, byte + 1, 0 where a string begins.

    String k's own end mark is its k-th smallest suffix, so that suffix k of the result is the end of string k.
    """
    length = np.array([len(x) for x in body], dtype=np.int64)
    ends = np.cumsum(length + 1) - 1
    text = np.zeros(int(ends[-1]) + 1, dtype=np.int64)
    inside = np.ones(len(text), dtype=bool)
    inside[ends] = False
    text[inside] = np.frombuffer(b"".join(body), dtype=np.uint8).astype(np.int64) + 1
    used = np.zeros(257, dtype=bool)
    used[text] = True
    used[0] = True
    code = (np.cumsum(used) - 1)[text]
    bits = max(1, int(code.max()).bit_length())
    left = np.repeat(np.cumsum(length + 1) - 1, length + 1) - np.arange(len(text))  # bytes up to the end mark
    rank, depth = code, 1
    packed = max(1, 62 // bits)
    key = np.zeros(len(text), dtype=np.int64)
    for j in range(packed):
        nxt = np.zeros(len(text), dtype=np.int64)
        nxt[: len(text) - j] = code[j:]
        key = (key << bits) | np.where(left >= j, nxt, 0)
    depth, longest = packed, int(length.max()) + 1
    end_rank = np.cumsum(~inside) - 1  # number of the string
    order = np.argsort(key)
    while True:
        sorted_key = key[order]
        rank = np.empty(len(text), dtype=np.int64)
        new = np.empty(len(text), dtype=bool)
        new[0], new[1:] = True, sorted_key[1:] != sorted_key[:-1]
        rank[order] = np.cumsum(new) - 1
        rank += len(body)
        rank[ends] = end_rank[ends]  # end marks come first, in the order of the strings
        if depth >= longest or new.all():
            break
        nxt = np.minimum(np.arange(len(text)) + depth, np.arange(len(text)) + left)
        key = rank * (len(text) + len(body) + 1) + rank[nxt]
        order = np.argsort(key)
        depth *= 2
    # equal up to the end: the end mark decides
    order = np.lexsort((np.arange(len(text)) + left, rank))
    before = np.zeros(len(text), dtype=np.int64)
    before[1:] = text[:-1]
    return before[order].astype(np.uint16)


def shard(key, rows):
    """One row: the transform of a shard's strings and their places, in order."""
    rows = rows.combine_chunks()
    body = rows.column("body").to_pylist()
    doc, null = rows.column("doc_id").fill_null(0).to_numpy(), np.asarray(rows.column("doc_id").is_null())
    return pa.table({
        "bucket": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
        "bwt": [transform(body).tobytes()], "doc": [doc.astype(np.int64).tobytes()], "null": [null.tobytes()],
        "row": [rows.column("row").to_numpy().astype(np.int32).tobytes()], "start": [rows.column("start").to_numpy().astype(np.int64).tobytes()],
        "n": [rows.column("n").to_numpy().astype(np.int32).tobytes()]})


def unwind(bwt: np.ndarray, length: np.ndarray):
    """(string, offset in it, rank of the suffix one byte longer) of each suffix, from the transform."""
    order = np.argsort(bwt, kind="stable")
    back = np.empty(len(bwt), dtype=np.int32)
    back[order] = np.arange(len(bwt), dtype=np.int32)
    string, offset = np.empty(len(bwt), dtype=np.int32), np.empty(len(bwt), dtype=np.int32)
    at, who, left = np.arange(len(length), dtype=np.int32), np.arange(len(length), dtype=np.int32), length.astype(np.int32).copy()
    while len(at):
        string[at], offset[at] = who, left
        go = left > 0
        at, who, left = back[at[go]], who[go], left[go] - 1
    return string, offset, back


def interleave(shards: list[tuple[np.ndarray, np.ndarray]], size: int):
    """Merge transforms. ``shards``: (transform, windows of each string). Returns for all windows, in order of their bytes,
    (shard's string counted over all shards, offset, number of its interval)."""
    b1, string, offset, words = [], [], [], []
    many = 0
    for bwt, n in shards:
        s, o, back = unwind(bwt, n + size - 1)
        string.append(s + many), offset.append(o), b1.append(bwt)
        words.append((bwt[back], bwt[back[back]]))
        many += len(n)
    windows = np.concatenate([n for _, n in shards])
    sizes = [len(x) for x in b1]
    which = np.repeat(np.arange(len(shards)), sizes).astype(np.uint16 if len(shards) > 255 else np.uint8)
    string, offset, c1 = np.concatenate(string), np.concatenate(offset), np.concatenate(b1).astype(np.int32)
    c2, c3 = (np.concatenate([w[k] for w in words]).astype(np.int32) for k in (0, 1))
    used = np.zeros(257, dtype=bool)
    used[c1] = True
    dense, d = (np.cumsum(used) - 1).astype(np.int32), int(used.sum())
    c1, c2, c3 = dense[c1], dense[c2], dense[c3]

    def coded(x, top):
        there = np.zeros(top, dtype=bool)
        there[x] = True
        return (np.cumsum(there) - 1).astype(np.int32)[x], int(there.sum())

    step, (word, kinds) = 3, coded((c3 * d + c2) * d + c1, d**3)
    if kinds > 65536:
        step, (word, kinds) = 2, coded(c2 * d + c1, d**2)
    one, word = c1.astype(np.uint16), word.astype(np.uint16)
    last = offset - windows[string]  # offset - windows: below size - h for those of round h
    z, block, h = None, None, 0
    while h < size:
        s = step if h + step <= size else 1
        at = np.flatnonzero((offset >= size - h) & (last < size - h)).astype(np.int32)  # round h, shard by shard, each in its order
        if z is None:
            z, block = which[at], np.zeros(len(at), dtype=np.int32)
        own = np.empty(len(at), dtype=np.int32)
        own[np.argsort(z, kind="stable")] = at  # the k-th of a shard in the interleave is the shard's k-th
        w = (word if s == step else one)[own]
        order = np.argsort(w, kind="stable")
        z, w, block = z[order], w[order], block[order]
        new = np.empty(len(z), dtype=bool)
        new[:1] = False
        new[1:] = (w[1:] != w[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new, dtype=np.int32)
        h += s
    if z is None:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
    at = np.flatnonzero(last < 0).astype(np.int32)
    own = np.empty(len(at), dtype=np.int32)
    own[np.argsort(z, kind="stable")] = at
    return string[own], offset[own], block


def repeats_in(rows: list[dict], size: int):
    """Runs of repeated windows in a bucket's shards: (null, doc, row, start, windows) arrays."""
    get = lambda k, kind: np.concatenate([np.frombuffer(r[k], dtype=kind) for r in rows])
    null, doc, row, start, n = get("null", bool), get("doc", np.int64), get("row", np.int32), get("start", np.int64), get("n", np.int32)
    string, offset, block = interleave([(np.frombuffer(r["bwt"], np.uint16), np.frombuffer(r["n"], np.int32)) for r in rows], size)
    order = np.lexsort((row, doc, ~null))
    new = np.ones(len(doc), dtype=bool)
    a, b = order[1:], order[:-1]
    new[1:] = (row[a] != row[b]) | (doc[a] != doc[b]) | (null[a] != null[b])
    number = np.empty(len(doc), dtype=np.int64)
    number[order] = np.cumsum(new)
    place = (number[string] << 40) | (start[string] + offset)
    heads = np.flatnonzero(np.diff(block, prepend=-1))
    least = np.repeat(np.minimum.reduceat(place, heads), np.diff(np.append(heads, len(block)))) if len(block) else place
    hit = place > least
    s, o = string[hit].astype(np.int64), offset[hit].astype(np.int64)
    flat = np.sort(s * (2 * LONGEST) + o)  # offsets of windows stay below LONGEST, so strings don't touch
    head = np.diff(flat, prepend=-2) != 1
    at = np.flatnonzero(head)
    s, o, many = flat[at] // (2 * LONGEST), flat[at] % (2 * LONGEST), np.diff(np.append(at, len(flat)))
    return null[s], doc[s], row[s], start[s] + o, many


def merged(shards: DataFrame, size: int) -> DataFrame:
    def run(key, rows):
        null, doc, row, start, n = repeats_in(rows.to_pylist(), size)
        return pa.table({"doc_id": pa.array(doc, pa.int64(), mask=null), "row": pa.array(row, pa.int32()), "start": pa.array(start, pa.int64()),
                         "n": pa.array(n, pa.int32())})

    return shards.groupBy("bucket").applyInArrow(run, "doc_id long, row int, start long, n int")


def removed(docs: DataFrame, ranges: DataFrame, size: int) -> DataFrame:
    """Each row with its spans and the digest of what is left."""
    lists = ranges.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("own"))
    both = docs.alias("d").join(
        lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row")), "left")

    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(4)]
            spans = []
            for text, own in zip(batch.column(1), batch.column(2)):
                text, own = text.as_py() or b"", own.as_py() or []
                found = []
                for s in sorted((s["start"], s["start"] + s["n"] + size - 1) for s in own):
                    if found and s[0] <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], s[1])
                    else:
                        found.append(list(s))
                digest, last = hashlib.sha256(), 0
                for a, b in found:
                    digest.update(text[last:a])
                    last = b
                digest.update(text[last:])
                for c, v in zip(cols, (len(text), sum(b - a for a, b in found), len(found), digest.hexdigest())):
                    c.append(v)
                spans.append([{"start": a, "end": b} for a, b in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.select("d.doc_id", "d.text", "l.own").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")


def repeats(docs: DataFrame, size: int = 100, hot: int = HOT) -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans (bytes, end exclusive)."""
    rows = common.doc_rows(docs).withColumn("text", F.coalesce("text", F.lit(b"")))
    rows = rows.select("doc_id", F.shiftrightunsigned(F.xxhash64("text"), 33).cast("int").alias("row"), "text")
    # dealt by anchor once, which serves both windows
    marks = common.staged(judged(candidates(rows, size).repartition("anchor"), hot), "repeats")
    look = F.col("anchor").isNotNull()
    sums = marks.filter(look).agg(
        F.sum(F.when(~F.col("hot"), F.col("n") + size)), F.sum(F.col("hot").cast("long"))).first()
    ranges = marks.filter(~look).select("doc_id", "row", "start", "n")
    strings = bodies(rows, marks.filter(look), size, max(1, -(-(sums[0] or 0) // BUCKET)))
    if sums[1]:
        strings = common.staged(strings, "strings")  # two readers
        windows = strings.filter("body IS NULL").select("doc_id", "row", "start", "n", "window")
        place = F.struct("doc_id", "row", "start")
        first = windows.groupBy("window").agg(F.min(place).alias("first"))
        ranges = ranges.unionByName(windows.join(first, "window").filter(place != F.col("first")).select("doc_id", "row", "start", "n"))
        strings = strings.filter("body IS NOT NULL")
    if sums[0]:
        kinds = "bucket int, shard int, bwt binary, doc binary, null binary, row binary, start binary, n binary"
        ranges = ranges.unionByName(merged(strings.groupBy("bucket", "shard").applyInArrow(shard, kinds), size))
    return removed(rows, ranges, size)
