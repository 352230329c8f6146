"""Prefix trie of conversations with count-min screening of prefix digests.

Every prefix of a conversation has a 128-bit digest: the exclusive or of its turns' hashes, each salted with its place.
Digests are running sums, so a conversation of any length is cut into ranges that add up (``running``); texts move nowhere.

1. A count-min sketch counts the digests: two rows of cells, made per task, added up chunk by chunk, and sent to the tasks
   as one bit for each cell, "twice or more". The number of cells follows the number of prefixes, up to 2**26 for each row
   (16 MB of bits in all); beyond that it proves less, and results stay the same.
2. A sketch never counts too little: where it says one, the prefix belongs to one conversation alone, and so do all longer
   ones. This tail is emitted where it stands. Only shorter prefixes, which may be shared, are shuffled and grouped exactly.
3. Of a group come the smallest member and the longest conversation. A conversation that is the smallest member at depth r
   is it at all greater depths; so r, the bytes before r, the member above r, and whether it ends at a leaf are all that a
   second grouping needs for children, leaves and savings of whole subtrees: they become sums over members.
4. The ids that end at a node are sorted into ranges over (node, id) and written as pieces of text; pieces of a node are
   hashed in order as they stream by. No node's ids are held at once.

Order of turns: turn (null first), then hashes of role and text, so that equal turns may stand for each other. Null role or
text: empty. Null conv_id: no conversation, dropped. Repeated rows are turns of their own. No turns left after ``branched``:
a member of the root alone. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

LEAST_BITS, MOST_BITS = 16, 26
PIECE = 4096  # ids in one piece of text
NODE = ["depth", "x1", "x2"]


def running(df: DataFrame, key: str, order: list, adds: list[str], xors: list[str]) -> DataFrame:
    """Running sums and exclusive ors of columns in each key's order; a key of any size is split into ranges."""
    ranged = df.withColumn("_at", F.monotonically_increasing_id())  # equal rows too may be split
    ranged = ranged.repartitionByRange(F.col(key), *order, F.col("_at")).drop("_at").withColumn("_piece", F.spark_partition_id())
    ranged = common.staged(ranged, "ranges")
    local = W.partitionBy(key, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    totals = ranged.groupBy(key, "_piece").agg(*[F.sum(a).alias(a) for a in adds], *[F.bit_xor(x).alias(x) for x in xors])
    earlier = totals.select(
        key, "_piece", *[F.sum(a).over(before).alias(f"_{a}") for a in adds], *[F.bit_xor(x).over(before).alias(f"_{x}") for x in xors],
        F.lag("_piece").over(W.partitionBy(key).orderBy("_piece")).alias("_any"))
    earlier = earlier.filter("_any IS NOT NULL").drop("_any")  # only keys that cross an edge
    out = ranged.select(
        *[c for c in ranged.columns if c not in (*adds, *xors)], *[F.sum(a).over(local).alias(a) for a in adds],
        *[F.bit_xor(x).over(local).alias(x) for x in xors]).join(earlier, [key, "_piece"], "left")
    zero = F.lit(0).cast("long")
    for a in adds:
        out = out.withColumn(a, F.col(a) + F.coalesce(f"_{a}", zero))
    for x in xors:
        out = out.withColumn(x, F.col(x).bitwiseXOR(F.coalesce(f"_{x}", zero)))
    return out.drop("_piece", *[f"_{c}" for c in (*adds, *xors)])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, h1, h2, size): turns in order as hashes of role and text, and the text's bytes."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(12), text, role).alias("h2"), F.octet_length(text).cast("long").alias("size"), F.lit(1).cast("long").alias("place"))
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    return running(rows.filter("conv_id IS NOT NULL"), "conv_id", order, ["place"], []).drop("turn")


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns, rebuilt: each one c begins with the first h turns of conversation c - c % 5,
    its own go on after its first h; h = crc32(c as text) % 9."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9)
    convs = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(sizes, "base", "left").withColumn("kept", F.least("h", F.coalesce("n_base", F.lit(0))))
    lead = turns.filter("place <= 8").withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").filter("place <= h")
    own = turns.join(convs.select("conv_id", "h", "kept"), "conv_id").filter("place > h").withColumn("place", F.expr("kept + place - h"))
    cols = ["conv_id", "place", "h1", "h2", "size"]
    return convs.select("conv_id"), lead.select(cols).unionByName(own.select(cols))


def cell(j: int, bits: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(j), *NODE), 64 - bits)


def sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """Two rows of 2**bits cells, packed: whether a cell counts two or more."""
    low = min(bits, 16)

    def run(batches):
        held, many = [[], []], 0

        def parts():
            for j in (0, 1):
                at, n = np.unique(np.concatenate(held[j]), return_counts=True)
                edges = np.flatnonzero(np.diff(at >> low, prepend=-1))
                for a, b in zip(edges, np.append(edges[1:], len(at))):
                    yield j, int(at[a] >> low), (at[a:b] & ((1 << low) - 1)).astype(np.uint16).tobytes(), np.packbits(n[a:b] > 1).tobytes()

        def flush():
            for k in range(0, len(rows := list(parts())), 1024):
                j, c, a, t = zip(*rows[k : k + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(c, pa.int32()), pa.array(a, pa.binary()), pa.array(t, pa.binary())], names=["j", "chunk", "cells", "twice"])

        for batch in batches:
            held[0].append(batch.column(0).to_numpy()), held[1].append(batch.column(1).to_numpy())
            many += batch.num_rows
            if many > 2_000_000:
                yield from flush()
                held, many = [[], []], 0
        if many:
            yield from flush()

    def add(key, rows):
        count = np.zeros(1 << low, dtype=np.uint8)
        for cells, twice in zip(rows.column("cells"), rows.column("twice")):
            at = np.frombuffer(cells.as_py(), dtype=np.uint16)
            count[at] = np.minimum(2, count[at] + 1 + np.unpackbits(np.frombuffer(twice.as_py(), dtype=np.uint8), count=len(at)))
        return pa.table({"j": pa.array([key[0].as_py()], pa.int32()), "chunk": pa.array([key[1].as_py()], pa.int32()), "bits": [np.packbits(count > 1).tobytes()]})

    made = prefixes.select(cell(0, bits), cell(1, bits)).mapInArrow(run, "j int, chunk int, cells binary, twice binary")
    out = np.zeros((2, 1 << (bits - 3)), dtype=np.uint8)
    size = 1 << (low - 3)
    for r in made.groupBy("j", "chunk").applyInArrow(add, "j int, chunk int, bits binary").toLocalIterator():
        out[r["j"], r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return out


def screened(prefixes: DataFrame, twice: np.ndarray, bits: int) -> DataFrame:
    """The prefixes with ``single``: the sketch counts one, which proves that no other conversation has this prefix."""
    shared, names = prefixes.sparkSession.sparkContext.broadcast(twice), prefixes.columns

    def run(batches):
        table = shared.value
        for batch in batches:
            many = np.ones(batch.num_rows, dtype=bool)
            for j in (0, 1):
                at = batch.column(j).to_numpy()
                many &= (table[j][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(~many)], names=[*names, "single"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in prefixes.schema)
    return prefixes.select(cell(0, bits).alias("_0"), cell(1, bits).alias("_1"), *names).mapInArrow(run, f"{kinds}, single boolean")


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (node, conv_id): ids in ascending order, comma-joined."""

    def pieces(batches):
        node, held = None, []

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([node[2]], pa.int64()), pa.array([held[0]], pa.int64()),
                 pa.array([",".join(map(str, held))])], names=[*NODE, "first", "ids"])

        for batch in batches:
            for *own, c in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if held and (own != node or len(held) == PIECE):
                    yield out()
                    held = []
                node = own
                held.append(c)
        if held:
            yield out()

    def hashed(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for *own, _, ids in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if own != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield told(done)
        if node is not None:
            yield told([(*node, state.hexdigest())])

    def told(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=[*NODE, "ends_sha256"])

    text = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(
        pieces, "depth long, x1 long, x2 long, first long, ids string")
    return text.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of all conversations (conv_id) with their turns (conv_id, place, h1, h2, size)."""
    salted = turns.select("conv_id", "place", F.xxhash64("h1", "place").alias("x1"), F.xxhash64("h2", "place").alias("x2"), "size", F.col("size").alias("bytes"))
    rows = running(salted, "conv_id", [F.col("place")], ["bytes"], ["x1", "x2"])
    rows = common.staged(rows.select("conv_id", F.col("place").alias("depth"), "x1", "x2", "size", "bytes"), "prefixes")
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * rows.count()).bit_length()))
    marked = screened(rows, sketch(rows, bits), bits)
    # of each conversation its length and the depth from which its prefixes are proven to be its own
    ends = marked.groupBy("conv_id").agg(F.max("depth").alias("length"), F.min(F.when(F.col("single"), F.col("depth"))).alias("alone"))
    ends = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0).cast("long")).alias("length"), "alone")
    ends = common.staged(ends.withColumn("alone", F.coalesce("alone", F.col("length") + 1)), "lengths")
    zero = F.lit(0).cast("long")
    root = ends.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), zero.alias("size"), zero.alias("bytes"), "length", "alone")
    known = rows.join(ends, "conv_id")
    maybe = known.filter("depth < alone").unionByName(root)
    # written first, so that a join with a node of many conversations can be split
    groups = common.staged(maybe.groupBy(*NODE).agg(F.min("conv_id").alias("least"), F.max("length").alias("longest")), "groups")
    placed = maybe.join(groups, NODE)
    own, end = F.col("least") == F.col("conv_id"), F.col("depth") == F.col("length")
    # r: depth from which the conversation is the smallest member; above: the smallest member one turn before
    first = placed.groupBy("conv_id").agg(
        F.min(F.when(own, F.col("depth"))).alias("r"), F.max(F.when(~own, F.col("bytes"))).alias("shared_bytes"),
        F.max_by(F.when(~own, F.col("least")), F.when(~own, F.col("depth"))).alias("above"), F.max(own & end & (F.col("longest") == F.col("depth"))).alias("leaf"))
    first = ends.join(first, "conv_id").select(
        "conv_id", "length", "alone", F.coalesce("r", "alone").alias("r"), F.coalesce("shared_bytes", zero).alias("shared_bytes"), "above",
        (F.col("leaf") | (F.col("alone") <= F.col("length"))).alias("leaf"))
    first = common.staged(first, "firsts")
    told = rows.unionByName(root.select(rows.columns)).join(first, "conv_id")
    parent = F.when(F.col("depth") > F.col("r"), F.col("conv_id")).otherwise(F.col("above"))
    child = ((F.col("length") > F.col("depth")) & (F.col("r") <= F.col("depth") + 1)).cast("long")
    saved = F.greatest(zero, F.col("shared_bytes") - (F.col("bytes") - F.col("size")))
    shared = told.filter("depth < alone")
    nodes = shared.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.min_by(parent, "conv_id").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"),
        F.sum(F.col("leaf").cast("long")).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    nodes = nodes.join(digests_of_ends(shared.filter("depth = length")), NODE, "left")
    one = F.lit(1).cast("long")
    tails = told.filter("depth >= alone").select(
        *NODE, "conv_id", parent.alias("parent_conv_id"), one.alias("n_convs"), (F.col("length") > F.col("depth")).cast("long").alias("n_children"),
        one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(F.col("length") == F.col("depth"), F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends_sha256"))
    out = nodes.unionByName(tails)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: its smallest member, depth, the parent's smallest member, members, children, leaves and bytes saved
    in its subtree, and the digest of the conversations that end here."""
    turns = common.staged(numbered(conversations), "turns")
    return trie(turns.select("conv_id").distinct(), turns)


def branched_trie(conversations: DataFrame) -> DataFrame:
    """``prefix_trie`` of the conversations as ``branched`` rebuilds them."""
    convs, turns = branched(common.staged(numbered(conversations), "turns"))
    return trie(common.staged(convs, "conversations"), turns)
