"""Token-ID output: flat files of unsigned integers with 64-bit document offsets, read back through memory maps.

Texts are dealt into ranges of doc_id; each range is one shard of three files: ids (``.bin``), offsets within the shard
(``.idx``, one more than documents) and document ids (``.doc``). A shard is written under a name of its attempt and then
renamed, so a task that runs again replaces its shard by equal bytes. The ids before a shard (its base) are the prefix sum
of the shards' counts.

Null text: only the end id. Null doc_id: before all others, and null when read. Repeated rows: each is written. Empty
table: no shards with documents. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens
from .tokens import dtype_for, encoder

SHARD_BYTES = 24 << 20  # of text


def _files(folder: str):
    """(file system, path, whether files there can be memory-mapped)."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder, True
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[len("file:"):])
    return system, path, isinstance(system, fs.LocalFileSystem)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the files into ``folder`` and return the manifest: shard, n_docs, n_null, n_ids, base."""
    rows = common.doc_rows(docs)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))

    def shard(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, path, _ = _files(folder)
        system.create_dir(path, recursive=True)
        name, attempt = f"{path}/shard-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        enc, lengths, ids, nulls = encoder(tokenizer), [], [], 0
        with system.open_output_stream(f"{name}.bin{attempt}") as out:
            for batch in batches:
                own = batch.column(0)
                nulls += own.null_count
                ids.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                texts = batch.column(1)
                for i in range(0, len(texts), 256):
                    for x in enc.ids(texts.slice(i, 256).to_pylist(), end_id):
                        lengths.append(len(x))
                        out.write(x.tobytes())
        offsets = np.concatenate([[0], np.cumsum(np.array(lengths, dtype="<i8"))]).astype("<i8")
        for kind, values in (("idx", offsets), ("doc", np.concatenate([np.zeros(0, "<i8"), *ids]))):
            with system.open_output_stream(f"{name}.{kind}{attempt}") as out:
                out.write(values.astype("<i8").tobytes())
        for kind in ("bin", "idx", "doc"):
            system.move(f"{name}.{kind}{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array([task.partitionId()], pa.int32()), "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_null": pa.array([nulls], pa.int64()), "n_ids": pa.array([int(offsets[-1])], pa.int64()),
        })

    ordered = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text")
    made = common.staged(ordered.mapInArrow(shard, "shard int, n_docs long, n_null long, n_ids long"), "manifest")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read(manifest: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """Documents back from the files: doc_id, start, n_tokens, ids_crc32."""
    kind = dtype_for(tokenizer)

    def load(batches):
        tokens.release()
        system, path, mapped = _files(folder)

        def array(name, dtype):
            if system.get_file_info(name).size == 0:
                return np.zeros(0, dtype)
            if mapped:
                return np.memmap(name, dtype=dtype, mode="r")
            with system.open_input_file(name) as f:
                return np.frombuffer(f.read(), dtype=dtype)

        for batch in batches:
            for row in batch.to_pylist():
                name = f"{path}/shard-{row['shard']:06d}"
                ids, at, own = array(f"{name}.bin", kind), array(f"{name}.idx", "<i8"), array(f"{name}.doc", "<i8")
                for i in range(0, row["n_docs"], 10_000):
                    spans = [(int(at[k]), int(at[k + 1])) for k in range(i, min(i + 10_000, row["n_docs"]))]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([None if i + k < row["n_null"] else int(own[i + k]) for k in range(len(spans))], pa.int64()),
                        "start": pa.array([row["base"] + a for a, _ in spans], pa.int64()),
                        "n_tokens": pa.array([b - a for a, b in spans], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in spans], pa.int64()),
                    })

    return manifest.filter("n_docs > 0").repartition("shard").mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")
