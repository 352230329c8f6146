"""Ranking and list-shaping operators: top-k, exact ranks of large groups, diversify, fair share, interleave, slots."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import stage


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int | Column, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of each key with their rank; ``n`` may be a column of the key.

    Each input partition keeps its own first ``n`` before anything gathers by key, so a key that holds a large share
    of the rows never passes whole through one task. Small limits get this from the optimizer's rank limit; for
    larger ones the first step is written out.
    """
    if not isinstance(n, int) or n >= 1000:
        part = Window.partitionBy(*keys, "_part").orderBy(*order)
        df = df.withColumn("_part", F.spark_partition_id())
        df = df.withColumn(rank, F.row_number().over(part)).filter(F.col(rank) <= n).drop(rank, "_part")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def full_rank(df: DataFrame, keys: list[str], order: list[str], rank: str = "rank", parts: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row within its key, for keys of any size.

    ``order`` lists columns to sort by, "-name" for descending; together with the keys they must be unique. The rows
    are sorted into ranges over (keys, order) and staged; each range ranks its own piece of each key, and one small
    table of piece sizes gives the offsets. No key has to fit one task.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def by(name):
        return F.col(name[1:]).desc_nulls_last() if name.startswith("-") else F.col(name).asc_nulls_first()

    cols = [F.col(k) for k in keys] + [by(o) for o in order]
    ranged = df.repartitionByRange(parts, *cols).withColumn("_piece", F.spark_partition_id())
    ranged = stage(ranged, "ranges")
    local = Window.partitionBy(*keys, "_piece").orderBy(*[by(o) for o in order])
    sizes = ranged.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_local", F.row_number().over(local))
        .join(offsets, [*keys, "_piece"])
        .withColumn(rank, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_piece")
    )


def in_order(ordered: DataFrame, place: str = "place") -> DataFrame:
    """Numbers the rows of a sorted table from 1, in its order, without moving them.

    Each task numbers its own range; one row per task, its size, gives the offsets.
    """
    marked = stage(ordered.withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_m", 33).alias("_p")
    sizes = marked.groupBy(part).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_m").bitwiseAND((1 << 33) - 1) + 1
    return marked.withColumn("_p", part).join(offsets, "_p").withColumn(place, F.col("_before") + within).drop("_m", "_p", "_before")


# ---------------------------------------------------------------- diversify


def _owner(group: str) -> Column:
    """Owners as "@name"; an empty one is never capped, so each of its rows is an owner of its own, named by its rank "#r"."""
    name = F.coalesce(F.col(group).cast("string"), F.lit(""))
    return F.when(name == "", F.concat(F.lit("#"), F.col("r").cast("string"))).otherwise(F.concat(F.lit("@"), name))


def _in_order(rows: DataFrame, cap: int) -> DataFrame:
    """The rows (l, r) that are kept when each list is walked once in rank order; linear in the rows.

    ``rows``: l, r, g, s and ``done`` (kept already: counts for its owner). Lists stream by sorted by rank; a task holds the
    signatures and owner counts of the one list it is in.
    """

    def walk(batches):
        current, seen, held = object(), set(), {}
        for batch in batches:
            keep = []
            for i, (own, g, s, done) in enumerate(zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)))):
                if own != current:
                    current, seen, held = own, set(), {}
                if done or not (s in seen or (g[0] == "@" and held.get(g, 0) >= cap)):
                    seen.add(s)
                    held[g] = held.get(g, 0) + 1
                    if not done:
                        keep.append(i)
            yield batch.select(["l", "r"]).take(pa.array(keep, pa.int64()))

    rows = rows.select("l", "r", "g", "s", "done")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c in ("l", "r"))
    return rows.repartition("l").sortWithinPartitions("l", "r").mapInArrow(walk, kinds)


def diversify_bounded(df: DataFrame, list_col: str, rank: str, group: str, sig: str, cap: int) -> DataFrame:
    """``diversify`` for lists whose length is bounded beforehand: each list is walked once, in one task.

    Adds ``kept`` and ``position`` (kept rows first, both in rank order).
    """
    rows = df.select(F.col(list_col).alias("l"), F.col(rank).alias("r"), group, F.col(sig).alias("s"), F.lit(False).alias("done"))
    kept = _in_order(rows.withColumn("g", _owner(group)), cap).select(F.col("l").alias(list_col), F.col("r").alias(rank), F.lit(True).alias("kept"))
    order = Window.partitionBy(list_col).orderBy(F.desc("kept"), rank)
    flat = df.join(kept, [list_col, rank], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    return flat.withColumn("position", F.row_number().over(order).cast("long"))


def diversify(
    df: DataFrame, list_col: str, rank: str, group: str, sig: str, cap: int, *, rounds: int = 3
) -> DataFrame:
    """Move repeated headlines and over-represented owners to the back of each list, without losing a row.

    Walking a list in rank order, a row is kept unless its signature was kept before or its owner already has ``cap``
    kept rows (an empty owner is never capped). Adds ``kept``. Lists may be of any length: only the first row of each
    (list, owner, signature) can be kept at all. A row waits only for earlier rows of its owner and its signature, so
    in each of ``rounds`` rounds the first open row of an owner that is also the first open row of its signature is
    kept, and open rows of a kept signature or a full owner are settled; a round is three aggregations. Chains that
    wait longer than that, a few rows of a list, are then walked in order, each list in one task.
    """
    rows = df.select(F.col(list_col).alias("l"), F.col(rank).alias("r"), group, F.col(sig).alias("s"))
    rows = rows.select("l", "r", _owner(group).alias("g"), "s")
    firsts = rows.groupBy("l", "g", "s").agg(F.min("r").alias("r"))
    todo = stage(firsts, "todo")
    kept_all = todo.limit(0).select("l", "g", "s", "r")
    for _ in range(rounds):
        first_of_sig = todo.groupBy("l", "s").agg(F.min("r").alias("r"))
        first_of_owner = todo.groupBy("l", "g").agg(F.min("r").alias("r"))
        keep = stage(first_of_owner.join(first_of_sig, ["l", "r"]).select("l", "g", "s", "r"), "kept")
        if keep.isEmpty():
            break
        kept_all = kept_all.unionByName(keep)
        full = (
            kept_all.filter(F.startswith("g", F.lit("@"))).groupBy("l", "g").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= cap).select("l", "g")
        )
        left = todo.join(keep.select("l", "s"), ["l", "s"], "left_anti").join(full, ["l", "g"], "left_anti")
        todo = stage(left, "todo")
    # only lists and owners that still have open rows are walked
    before = kept_all.join(todo.select("l", "g").distinct(), ["l", "g"], "left_semi")
    open_rows = todo.withColumn("done", F.lit(False)).unionByName(before.withColumn("done", F.lit(True)))
    last = _in_order(open_rows, cap)
    flags = kept_all.select("l", "r").unionByName(last).select(
        F.col("l").alias(list_col), F.col("r").alias(rank), F.lit(True).alias("kept"))
    return df.join(flags, [list_col, rank], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


# ---------------------------------------------------------------- shares and mixes


def rotation_pairs(candidates: DataFrame, residents: DataFrame, keys: list[str], *, factor: float = fixed.ROTATE_FACTOR) -> DataFrame:
    """The k-th best candidate against the k-th weakest resident of each key; swaps go on while every one pays off.

    Both sides carry ``rank`` and ``trend``. A swap needs the candidate to beat ``factor`` times the resident, and
    all earlier swaps of the key to have been made.
    """
    r = residents.select(*keys, "rank", F.col("trend").alias("weak_trend"), F.col("id").alias("drop_id"))
    pairs = candidates.join(r, [*keys, "rank"])
    w = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    good = (F.col("trend") > factor * F.col("weak_trend")).cast("int")
    return pairs.withColumn("swap", F.min(good).over(w) == 1)


def fair_share(df: DataFrame, key: str, order: list[str], count: int, *, strict: bool = True) -> DataFrame:
    """``count`` rows: each key's first ``count // keys``, the rest by global order. ``order`` as in ``full_rank``."""
    ranked = stage(full_rank(df, [key], order, "_r"), "shares")
    keys, total = ranked.agg(F.count_distinct(key), F.count("*")).first()
    if total < count and strict:
        raise ValueError(f"only {total:,} rows for a request of {count:,}")
    share = count // max(keys, 1)
    first = ranked.filter(F.col("_r") <= share)
    rest = ranked.filter(F.col("_r") > share)
    left = count - first.count()
    flat = full_rank(rest.withColumn("_all", F.lit(0)), ["_all"], [*order, key], "_g").filter(F.col("_g") <= left)
    return first.withColumn("phase", F.lit("share")).drop("_r").unionByName(
        flat.withColumn("phase", F.lit("fill")).drop("_r", "_g", "_all")
    )


def interleave_sides(df: DataFrame, keys: list[str], side: str, order: list[str]) -> DataFrame:
    """Alternate the two sides of each key (False first), then the tail of the longer. Adds ``slot`` (sortable)."""
    ranked = full_rank(df, [*keys, side], order, "_r")
    return ranked.withColumn("slot", (F.col("_r") - 1) * 2 + F.col(side).cast("int")).drop("_r")


def bm25_normalise(df: DataFrame, list_col: str, bm: str = "bm") -> DataFrame:
    """Retrieval score as a share of the list's best. The minimum is pre-aggregated, then joined back."""
    best = df.groupBy(list_col).agg(F.min(bm).alias("_best"))
    lex = F.when(F.col("_best") != 0, F.col(bm) / F.col("_best")).otherwise(F.lit(0.0))
    return df.join(best, list_col).withColumn("lex", lex).drop("_best")


def max_scaled(df: DataFrame, keys: list[str], value: str, out: str, *, log: bool = False) -> DataFrame:
    """Value (or its log1p) over the key's maximum, 0 where the maximum is 0."""
    v = F.log1p(value) if log else F.col(value)
    top = df.groupBy(*keys).agg(F.max(v).alias("_max"))
    scaled = F.when(F.col("_max") > 0, v / F.col("_max")).otherwise(F.lit(0.0))
    return df.join(top, keys).withColumn(out, scaled).drop("_max")
