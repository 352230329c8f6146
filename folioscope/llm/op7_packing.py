"""Best-two-fit packing of token sequences.

A bin is filled greedily with the largest piece that still fits. Then its smallest piece is replaced by two unpacked
pieces, if two exist that fit the expanded gap more tightly. Pieces of one length are alike, so the plan is made over the
counts of lengths (at most ``size`` of them, whatever the number of documents): a bin that can be filled the same way n
times is planned once. Each plan step uses up a length, so the plan stays small. Pieces then get their number within
their length from counts per (part, length) and their place from the plan; no length is gathered in one task.

Null text: only the end id. Repeated rows: each is packed. Null doc_id: kept. Empty table: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens
from .tokens import encoder

SIZE = 4096
PART_ROWS = 50_000


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Encode each text, append the end id and cut what is longer than ``size``: doc_id, piece, start, length, ids_crc32."""

    def cut(batches):
        enc = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), enc.ids(part.column(1).to_pylist(), end_id)):
                    for k, a in enumerate(range(0, len(ids), size)):
                        x = ids[a : a + size]
                        rows.append((doc, k, a, len(x), zlib.crc32(x.astype("<u4").tobytes())))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(cols[0], pa.int64()), "piece": pa.array(cols[1], pa.int32()),
                    "start": pa.array(cols[2], pa.int64()), "length": pa.array(cols[3], pa.int64()),
                    "ids_crc32": pa.array(cols[4], pa.int64()),
                })

    return common.doc_rows(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """[(times, {length: pieces of it in a bin})] that uses up ``counts``."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    there = np.flatnonzero(left)
    plan = []
    while len(there):
        use: dict[int, int] = {}
        gap, top = size, len(there)
        while True:
            top = int(np.searchsorted(there[:top], gap, side="right"))
            if top == 0:
                break
            length = int(there[top - 1])
            n = min(gap // length, int(left[length]) - use.get(length, 0))
            if n:
                use[length] = use.get(length, 0) + n
                gap -= n * length
            top -= 1
        small = min(use)
        if gap and small > 1:
            free = there[there < small]
            if len(free):
                room = gap + small
                n_free = left[free] - np.array([use.get(int(x), 0) for x in free])
                free, n_free = free[n_free > 0], n_free[n_free > 0]
                if len(free):
                    at = np.minimum(np.searchsorted(free, room - free, side="right") - 1, np.arange(len(free)))
                    alone = (at == np.arange(len(free))) & (n_free < 2)
                    at = np.where(alone, at - 1, at)
                    total = np.where(at >= 0, free + free[np.maximum(at, 0)], -1)
                    total[total > room] = -1
                    best = int(np.argmax(total))
                    if total[best] > small:
                        use[small] -= 1
                        if not use[small]:
                            del use[small]
                        for x in (int(free[best]), int(free[at[best]])):
                            use[x] = use.get(x, 0) + 1
        times = min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= times * n
        plan.append((times, use))
        there = there[left[there] > 0]
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first number, pieces a bin, first sequence, first offset), by number."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, use in plan:
        offset = 0
        for length, n in sorted(use.items(), reverse=True):
            out.setdefault(length, []).append((used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def pack(rows: DataFrame, size: int = SIZE, part_rows: int = PART_ROWS) -> DataFrame:
    """Give each row (with ``length`` from 1 to ``size``) its sequence_id and offset; other columns stay."""
    rows = common.staged(rows, "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # at most `size` rows
    where = places(best_two_fit(counts, size))
    parts = sum(counts.values()) // part_rows + 1
    keys = [c for c in rows.columns if c != "length"]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    per = dealt.groupBy("_part", "length").count()
    before = W.partitionBy("length").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    per = per.select("_part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy("_part", "length").orderBy(*keys)
    numbered = dealt.withColumn("_nth", F.row_number().over(within) - 1).join(per, ["_part", "length"])
    numbered = numbered.select(*rows.columns, (F.col("_base") + F.col("_nth")).cast("long").alias("_number"))

    def place(batches):
        tokens.release()
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            number = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            values, first = np.unique(length[order], return_index=True)
            for x, idx in zip(values, np.split(order, first[1:])):
                t = where[int(x)]
                row = t[np.searchsorted(t[:, 0], number[idx], side="right") - 1]
                nth = number[idx] - row[:, 0]
                seq[idx] = row[:, 2] + nth // row[:, 1]
                off[idx] = row[:, 3] + nth % row[:, 1] * int(x)
            columns = batch.columns[:-1] + [pa.array(seq), pa.array(off)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return numbered.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
