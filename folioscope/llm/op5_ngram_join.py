"""N-gram Jaccard self-join with rare-first prefix filtering; result: connected components of similar documents.

A document's set is its distinct five-word shingles (64-bit hashes). Equal sets form one class (by size and a 64-bit
digest of the set); classes are the nodes of the join.

1. Counts of shingles are kept in a table of 2**24 cells (a fixed size). Every set is sorted by (count of its cell, hash),
   rarest first. Any common order gives right results; this one makes prefixes rare.
2. Two sets with a Jaccard similarity of t share a shingle within their first n - ceil(t n) + 1. Only those are posted.
3. Postings meet on the shingle. A pair passes if its sizes allow t (length filter) and the shingles left after the meeting
   point allow the needed overlap (positional filter).
4. Large groups of near copies would give a pair for each two members. Members therefore first meet one leader: of
   the earliest postings of their shingles (those with the fewest rarer shingles before) the one that allows most overlap. Verified links form components; then those
   members that are in another component than the leader of a shingle meet all others outside their component. Near copies share
   many shingles and should meet once: a posting keeps the node's BEFORE shingles before it, and two postings whose nodes share
   one of these don't meet. A pair's first shared shingle has none before it, so no link between
   components is lost, and members of one component never meet again.
5. Each remaining pair is verified once: a suffix filter (shingles per hash range, 64 small counts kept with each class, bound
   the overlap from above), then the exact intersection. Shingles of the classes that still have pairs are made again from
   the text; they are found by bits of fixed size.

Components come from alternating large-star and small-star steps, written to the shared folder at each step.

Fewer than five words: the whole sequence is the one shingle. Null or empty text: no shingles, no links, a component of
its own. Null doc_id: kept; it is never a component's name if others exist, and links like any other. Repeated rows: equal
sets, one class. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens
from .op10_licenses import MIX, mix

WORDS = 5
CELLS = 1 << 24
CHUNK = 1 << 18
FAN_IN = 32
BANDS = 64
BEFORE = 16


def shingles(known: common.Hashes, text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    own = known.of((text or b"").translate(common.LOWER).split())
    if not len(own):
        return own
    k = min(size, len(own))
    out = np.full(len(own) - k + 1, k, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * MIX + own[j : j + len(out)])
    return np.unique(out)


EDGES = (np.arange(1, BANDS, dtype=np.uint64) << np.uint64(58)).astype(np.uint64)


def bands_of(own: np.ndarray) -> bytes | None:
    """Shingles in each of BANDS hash ranges; none for a set so large that a count wouldn't fit."""
    if len(own) > 65_535:
        return None
    return np.diff(np.concatenate([[0], np.searchsorted(own, EDGES), [len(own)]])).astype("<u2").tobytes()


def node_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def describe(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, row, n, node, bands) per row, and per task the counts of shingle cells: part, chunk, cells (null for documents).

    A task's counts stop at 255: one byte for each cell.
    """

    def run(batches):
        from pyspark import TaskContext

        tokens.release()
        known, cells, held, many = common.Hashes(xxhash.xxh3_64_intdigest), np.zeros(CELLS, dtype=np.uint8), [], 0

        def count():
            at, n = np.unique((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), return_counts=True)
            cells[at] = np.minimum(255, cells[at] + n)

        for batch in batches:
            texts, n, node, bands = batch.column(2), [], [], []
            for i in range(batch.num_rows):
                own = shingles(known, texts[i].as_py(), size)
                n.append(len(own)), node.append(node_of(own) if len(own) else None), bands.append(bands_of(own) if len(own) else None)
                held.append(own)
                many += len(own)
                if many > 500_000:
                    count()
                    held, many = [], 0
            rows = batch.num_rows
            yield _described(batch.column(0), batch.column(1), n, node, bands, [None] * rows, [None] * rows, [None] * rows)
        if held:
            count()
        part = TaskContext.get().partitionId()
        if cells.any():
            for c in range(CELLS // CHUNK):
                yield _described(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), [None], [None], [None], [part], [c], [cells[c * CHUNK : (c + 1) * CHUNK].tobytes()])

    rows = common.doc_rows(docs).select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    return rows.mapInArrow(run, "doc_id long, row long, n long, node long, bands binary, part int, chunk int, cells binary")


def _described(doc_id, row, n, node, bands, part, chunk, cells) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, row, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(bands, pa.binary()), pa.array(part, pa.int32()), pa.array(chunk, pa.int32()), pa.array(cells, pa.binary())],
        names=["doc_id", "row", "n", "node", "bands", "part", "chunk", "cells"])


def add_cells(parts: DataFrame) -> np.ndarray:
    """Sum the tasks' tables, at most FAN_IN of a chunk in one group at a time; the result has CELLS numbers up to 65,535."""
    rows = parts.filter("chunk IS NOT NULL").select("part", "chunk", "cells")
    most = rows.agg(F.max("part")).first()[0]
    out = np.zeros(CELLS, dtype=np.uint16)
    if most is None:
        return out

    def read(cells):  # a task's bytes, or sums
        return np.frombuffer(cells, dtype=np.uint8 if len(cells) == CHUNK else np.uint16)

    def add(key, rows):
        total = np.zeros(CHUNK, dtype=np.uint32)
        for x in rows.column("cells"):
            total += read(x.as_py())
        total = np.minimum(total, 65_535).astype(np.uint16)
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "cells": [total.tobytes()]})

    while most > 0:
        rows = rows.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int")).groupBy("part", "chunk").applyInArrow(add, "part int, chunk int, cells binary")
        most //= FAN_IN
    for r in rows.toLocalIterator():
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = read(bytes(r["cells"]))
    return out


def levels_of(cells: np.ndarray) -> np.ndarray:
    """Only the order of magnitude matters: 64 levels in one byte for each cell, so that 16 MB are sent to each worker."""
    table = np.minimum(63, np.round(4 * np.log2(np.arange(65_536) + 1.0))).astype(np.uint8)
    return table[cells]


def postings(docs: DataFrame, shared, percent: int, size: int = WORDS) -> DataFrame:
    """(shingle, n, pos, node) of the rare-first prefix of each set; a set is posted at most once per task.

    ``shared``: broadcast of ``levels_of``.
    """

    def run(batches):
        tokens.release()
        known, seen, levels = common.Hashes(xxhash.xxh3_64_intdigest), set(), shared.value
        for batch in batches:
            out = []
            texts = batch.column(1)
            for i in range(batch.num_rows):
                own = shingles(known, texts[i].as_py(), size)
                n = len(own)
                if not n:
                    continue
                node = node_of(own)
                if node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                first = n - -(-percent * n // 100) + 1
                rare = levels[(own & np.uint64(CELLS - 1)).astype(np.int64)]
                if first < n:
                    edge = np.partition(rare, first - 1)[first - 1]
                    own, rare = own[rare <= edge], rare[rare <= edge]
                own = own[np.lexsort((own, rare))][:first]
                out.append((own.view(np.int64), np.full(len(own), n), np.arange(len(own)), np.full(len(own), node)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["shingle", "n", "pos", "node"])

    return common.doc_rows(docs).mapInArrow(run, "shingle long, n long, pos long, node long")


def fits(a: str, b: str, percent: int) -> Column:
    """Length and positional filter for two postings of one shingle (columns a.n, a.pos, b.n, b.pos)."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    left = F.least(n1 - F.col(f"{a}.pos"), n2 - F.col(f"{b}.pos"))  # overlap from here on
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & ((100 + percent) * left >= percent * (n1 + n2))


def verify(docs: DataFrame, pairs: DataFrame, reps: DataFrame, percent: int, size: int = WORDS) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; ``reps``: node, rep (a document of it), bands."""
    counted = lambda side: reps.select(F.col("node").alias(side), F.col("bands").alias(f"bands_{side}"))
    banded = pairs.distinct().join(counted("a"), "a").join(counted("b"), "b").select("a", "b", "bands_a", "bands_b")

    def may(batches):
        for batch in batches:
            xs, ys = batch.column(2), batch.column(3)
            both = np.asarray(xs.is_valid()) & np.asarray(ys.is_valid())
            keep, at = ~both, np.flatnonzero(both)
            x, y = (np.frombuffer(b"".join(c.take(pa.array(at)).to_pylist()), dtype="<u2").reshape(len(at), BANDS).astype(np.int64) for c in (xs, ys))
            keep[at] = (100 + percent) * np.minimum(x, y).sum(axis=1) >= percent * (x.sum(axis=1) + y.sum(axis=1))
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    pairs = common.staged(banded.mapInArrow(may, "a long, b long"), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = common.staged(nodes.join(reps.select("node", "rep"), "node"), "wanted")
    bits = common.crc_bits(wanted.select(F.col("rep").cast("string").alias("rep")), "rep")

    def run(batches):
        import zlib

        from pyspark import TaskContext

        known, seen, last = common.Hashes(xxhash.xxh3_64_intdigest), set(), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            crcs = np.array([zlib.crc32(b"" if x is None else str(x).encode()) for x in batch.column(0).to_pylist()], dtype=np.int64)
            texts = batch.column(1)
            for i in np.flatnonzero(common.has_bit(bits, crcs) | np.asarray(batch.column(0).is_null())).tolist():
                own = shingles(known, texts[i].as_py(), size)
                node = node_of(own) if len(own) else None
                if node is None or node in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(node)
                last += 1
                out.append((node, last, own.tobytes()))
                if len(out) == 200:
                    yield _sets(out)
                    out = []
            if out:
                yield _sets(out)

    # one of a node's sets is used, by its number: sets are dealt once for both sides, and a crowd around one node can be split
    sets = common.staged(common.doc_rows(docs).mapInArrow(run, "node long, nr long, own binary"), "sets")
    used = sets.groupBy("node").agg(F.min("nr").alias("nr"))
    both = pairs
    for side in ("a", "b"):
        both = both.join(used.select(F.col("node").alias(side), F.col("nr").alias(f"nr_{side}")), side)
    for side in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(side), F.col("nr").alias(f"nr_{side}"), F.col("own").alias(f"own_{side}")), [side, f"nr_{side}"])
    both = both.select("a", "b", "own_a", "own_b")

    def test(batches):
        for batch in batches:
            keep = []
            xs, ys = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(xs[i].as_buffer(), dtype=np.uint64), np.frombuffer(ys[i].as_buffer(), dtype=np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * same >= percent * (len(x) + len(y) - same):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return common.staged(both.mapInArrow(test, "a long, b long"), "links")


def _sets(out) -> pa.RecordBatch:
    a, b, c = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["node", "nr", "own"])


def components(links: DataFrame) -> DataFrame:
    """node -> comp, the smallest node reachable by links (a, b), for all nodes that have links."""
    pairs = common.staged(links.select("a", "b").filter("a <> b"), "edges")
    before = None
    while True:
        # large star: each node links its larger neighbours to the smallest of its neighbours and itself
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: each node links its smaller neighbours and itself to the smallest of them
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x"))
        small = small.select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).filter("a <> b").distinct()
        pairs = common.staged(small, "edges")
        state = pairs.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("comp"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def apart(posted: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b): members in another component than their shingle's leader with all others outside their component."""
    placed = posted.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lead = W.partitionBy("shingle").orderBy("pos", "n", "node").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = placed.select("shingle", "n", "pos", "node", "comp", F.first("comp").over(lead).alias("lead_comp"))
    torn = F.max(F.col("comp") != F.col("lead_comp")).over(W.partitionBy("shingle"))
    placed = placed.withColumn("torn", torn).filter("torn").drop("torn")
    before = W.partitionBy("node").orderBy("pos").rowsBetween(-BEFORE, -1)
    placed = common.staged(placed.withColumn("before", F.collect_list("shingle").over(before)), "placed")
    out = placed.filter("comp <> lead_comp").select("shingle", F.struct("n", "pos", "node", "comp", "before").alias("x"))
    all_ = placed.select("shingle", F.struct("n", "pos", "node", "comp", "before").alias("y"))
    met = out.join(all_, "shingle").filter((F.col("x.comp") != F.col("y.comp")) & fits("x", "y", percent) & ~F.arrays_overlap("x.before", "y.before"))
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def join(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """One row per document row: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return grouped(docs, percent, size).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, percent: int = 80, size: int = WORDS) -> DataFrame:
    """As ``join``, with ``row`` (hash of doc_id and text) and ``group``, a key of the component that needs no doc_id.

    Rows without words have no links: their group is the hash of doc_id and text, so only equal rows share it.
    """
    seen = common.staged(describe(docs, size), "shingled")
    rows = seen.filter("chunk IS NULL").select("doc_id", "row", "n", "node")
    reps = common.staged(seen.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    shared = docs.sparkSession.sparkContext.broadcast(levels_of(add_cells(seen)))
    posted = postings(docs, shared, percent, size)
    # keep shingles that two classes post; the leader is the earliest posting of the shingle
    order = W.partitionBy("shingle").orderBy("pos", "n", "node")
    posted = posted.withColumn("prev", F.lag("node").over(order)).withColumn("next", F.lead("node").over(order))
    posted = posted.withColumn("lead", F.first(F.struct("n", "pos", "node")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    posted = posted.filter("prev IS NOT NULL OR next IS NOT NULL").filter("prev IS NULL OR prev <> node")
    posted = common.staged(posted.select("shingle", "n", "pos", "node", "lead"), "postings")
    shared.unpersist()
    star = posted.select(F.struct("n", "pos", "node").alias("x"), F.col("lead").alias("y")).filter(fits("x", "y", percent))
    left = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) / F.greatest("x.n", "y.n")
    star = star.filter("x.node <> y.node").groupBy("x.node").agg(F.max_by("y.node", F.struct(left, "y.node")).alias("lead"))
    star = common.staged(star.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "star")
    links = verify(docs, star, reps, percent, size)
    comp = common.staged(components(links), "components")
    rest = apart(posted, comp, percent).distinct().join(star, ["a", "b"], "left_anti")
    links = links.unionByName(verify(docs, rest, reps, percent, size))
    comp = common.staged(components(links), "components")
    named = reps.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    names = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = named.select("node", "comp").join(names, "comp").select("node", "comp", "component_id")
    return rows.join(named, "node", "left").select(
        "doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        F.struct(F.col("comp").isNull().alias("bare"), F.coalesce("comp", "row").alias("key")).alias("group"))
