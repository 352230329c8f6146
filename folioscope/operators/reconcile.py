"""Change data: overlays, differences, file manifests and action logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(columns: list[str]) -> Column:
    """Digest of a row's persistable fields, independent of column order."""
    return F.sha1(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def apply_overlay(base: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """Base rows with their overrides; deleted ones go, ids unknown to the base come first (``is_new``).

    ``overlay`` has the base's columns plus ``deleted``.
    """
    o = overlay.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("o"), "deleted", F.lit(True).alias("_o"))
    b = base.select(F.col(key), F.struct(*[c for c in base.columns if c != key]).alias("b"), F.lit(True).alias("_b"))
    rows = b.join(o, key, "full").filter(~F.coalesce("deleted", F.lit(False)))
    row = F.when(F.col("_o"), F.col("o")).otherwise(F.col("b"))
    return rows.select(key, row.alias("r"), F.col("_b").isNull().alias("is_new")).select(key, "r.*", "is_new")


def merge_metadata(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Key/value rows; the overlay's values win, the key ``articles`` is not metadata."""
    rows = overlay.filter(F.col("key") != "articles")
    return base.join(rows.select("key"), "key", "left_anti").unionByName(rows)


def diff_overlay(current: DataFrame, base: DataFrame, overlay: DataFrame, key: str = "id", ignore: tuple[str, ...] = ("fetching",)) -> DataFrame:
    """The new overlay: earlier overrides, rows that differ from what was last persisted, and tombstones.

    A row is compared with its persisted override when there is one, else with the base; a tombstoned row that lives
    again is a change. Only digests are compared, so rows travel once.
    """
    cols = [c for c in base.columns if c != key and c not in ignore]
    fp = fingerprint([key, *cols])
    was = (
        base.select(key, fp.alias("base_fp")).join(
            overlay.select(key, fp.alias("over_fp"), "deleted", F.lit(True).alias("_o")), key, "full")
        .select(key, F.when(F.col("_o"), F.when(~F.col("deleted"), F.col("over_fp"))).otherwise(F.col("base_fp")).alias("was"),
                F.coalesce("deleted", F.lit(False)).alias("gone"))
    )
    now = current.select(key, *cols, fp.alias("now"))
    both = was.join(now.withColumn("_n", F.lit(True)), key, "full")
    changed = both.filter(F.col("_n") & ~F.col("now").eqNullSafe(F.col("was"))).select(key, *cols, F.lit(False).alias("deleted"))
    removed = both.filter(F.col("_n").isNull() & ~F.coalesce("gone", F.lit(False))).select(key, *cols, F.lit(True).alias("deleted"))
    fresh = changed.unionByName(removed)
    kept = overlay.select(key, *cols, "deleted").join(fresh.select(key), key, "left_anti")
    return kept.unionByName(fresh)


# ---------------------------------------------------------------- files


def reuse_digests(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """Adds ``sha256`` where size and modification time are unchanged since the last manifest; null = must be hashed."""
    old = previous.select("path", F.col("size").alias("_s"), F.col("mtime").alias("_m"), F.col("sha256").alias("_h"))
    same = (F.col("size") == F.col("_s")) & (F.col("mtime") == F.col("_m")) & (F.col("_h") != "")
    return listing.join(old, "path", "left").select("path", "size", "mtime", F.when(same, F.col("_h")).alias("sha256"))


def hash_files(spark, folder: str, listing: DataFrame) -> DataFrame:
    """Digest of every listed file that has none; only those files are opened, in parallel, below ``folder``."""
    def digests(batches):
        import hashlib

        import pandas as pd
        from pyarrow import fs

        at = folder if "://" in folder else "file://" + re.sub("^file:", "", folder)
        system, root = fs.FileSystem.from_uri(at.rstrip("/"))
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                made = hashlib.sha256()
                with system.open_input_stream(f"{root}/{path}") as f:
                    while part := f.read(1 << 20):
                        made.update(part)
                found.append(made.hexdigest())
            yield pd.DataFrame({"path": pdf["path"], "_new": found})

    hashed = listing.filter(F.col("sha256").isNull()).select("path").mapInPandas(digests, "path string, _new string")
    return listing.join(hashed, "path", "left").select("path", "size", "mtime", F.coalesce("sha256", "_new").alias("sha256"))


def list_files(spark, folder: str) -> DataFrame:
    """path (relative), size, mtime of every file below a folder; contents are not read."""
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    full = F.regexp_replace("path", "^file:(//)?", "")
    return files.select(F.substring(full, len(root) + 1, 1 << 20).alias("path"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("mtime"))


def manifest_diff(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Local files that are absent remotely or differ in size or digest."""
    r = remote.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h"), F.lit(True).alias("_r"))
    rows = local.join(r, "path", "left")
    same = F.col("size").eqNullSafe(F.col("_s")) & F.col("sha256").eqNullSafe(F.col("_h"))
    return rows.filter(F.col("_r").isNull() | ~same).select(
        "path", "size", "sha256", F.when(F.col("_r").isNull(), "absent").otherwise("changed").alias("why"))


def content_match(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Each local file with a remote file of the same content wherever it lies; null = needs an upload.

    Copies of one content on the remote side count once (the first path), so they do not multiply.
    """
    r = remote.groupBy("size", "sha256").agg(F.min("path").alias("remote_path"))
    return local.join(r, ["size", "sha256"], "left").select("path", "size", "sha256", "remote_path")


# ---------------------------------------------------------------- actions


def apply_actions(base: DataFrame, actions: DataFrame) -> DataFrame:
    """Library after a log of add / move / read / notes / delete actions.

    ``base``: id, url, title, topic, subtopic, read_at, notes_count. ``actions``: seq, id, kind plus the fields that
    kind sets. Adding a held article changes nothing; acting on a missing one is ignored; a deleted one can be added
    again. Per article only the last value of each field is kept, so a long log reduces before it moves.
    """
    kind, seq = F.col("kind"), F.col("seq")
    held = base.select("id", F.lit(True).alias("held"))
    gone = actions.filter(kind == "delete").groupBy("id").agg(F.max("seq").alias("deleted"))
    log = actions.join(gone, "id", "left").filter(F.col("deleted").isNull() | (seq > F.col("deleted")))
    begin = log.filter(kind == "add").groupBy("id").agg(F.min("seq").alias("added"))
    alive = (
        held.join(gone, "id", "full").join(begin, "id", "full")
        .select("id", (F.coalesce("held", F.lit(False)) & F.col("deleted").isNull()).alias("stays"), "added")
        .filter(F.col("stays") | F.col("added").isNotNull())
        .select("id", "stays", F.when(~F.col("stays"), F.col("added")).alias("since"))
    )
    live = log.join(alive, "id").filter(F.col("stays") | (seq >= F.col("since")))

    def last(k, *cols):
        return F.max_by(F.struct(*cols), F.when(kind == k, seq))

    fields = live.groupBy("id").agg(
        F.min_by(F.struct("url", "title", "topic", "subtopic"), F.when(kind == "add", seq)).alias("new"),
        last("move", "topic", "subtopic").alias("moved"), last("read", "ts").alias("was_read"),
        last("notes", "notes_count").alias("noted"),
    )
    rows = alive.join(base, "id", "left").join(fields, "id", "left")
    fresh = ~F.col("stays")

    def pick(c):
        return F.when(fresh, F.col("new." + c)).otherwise(F.col(c))

    return rows.select(
        "id", pick("url").alias("url"), pick("title").alias("title"),
        F.coalesce("moved.topic", pick("topic")).alias("topic"),
        F.when(F.col("moved").isNotNull(), F.col("moved.subtopic")).otherwise(pick("subtopic")).alias("subtopic"),
        F.coalesce("was_read.ts", F.when(~fresh, F.col("read_at"))).alias("read_at"),
        F.coalesce("noted.notes_count", F.when(~fresh, F.col("notes_count"))).alias("notes_count"),
    )
