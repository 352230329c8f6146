"""What the operators of this package share: reading, staging, word splitting and small fixed-size sets of hashes."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.session import checkpoint_dir
from folioscope.session import stage as staged

__all__ = ["staged", "table", "doc_rows", "lower_ascii", "shared_folder", "ALNUM", "LOWER", "Hashes", "Table", "crc_bits", "has_bit"]

#: Byte tables. LOWER maps A-Z to a-z. ALNUM also turns every ASCII character but letters and digits into a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
ALNUM = bytes(LOWER[b] if b >= 128 or bytes([b]).isalnum() else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_rows(docs: DataFrame) -> DataFrame:
    """(doc_id long, text binary): the only columns that most operators read, so that other columns can't clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared folder of ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Hashes(dict):
    """Word -> 64-bit hash, kept for up to ``most`` words; a missing word is hashed and kept."""

    def __init__(self, fn, most: int = 400_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, word):
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.fn(word)
        return value

    def of(self, words: list[bytes], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=dtype, count=len(words))


class Table:
    """Values by 64-bit key in numpy; each key asked for must be there. Keys lie in buckets by hash, looked through in step."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(63 - max(1, len(keys)).bit_length())
        at = self._bucket(keys)
        order = np.argsort(at)
        self.keys, self.values = keys[order], values[order]
        self.first = np.searchsorted(at[order], np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        at = self.first[self._bucket(keys)]
        miss = np.flatnonzero(self.keys[at] != keys)
        while len(miss):
            at[miss] += 1
            miss = miss[self.keys[at[miss]] != keys[miss]]
        return self.values[at]


def crc_bits(words: DataFrame, column: str, bits: int = 24) -> np.ndarray:
    """A set of strings as 2**bits bits, by crc32: its size doesn't depend on the number of strings. Nulls have no bit.

    Only words of 64 bits that have a bit set come to the driver: at most 2**(bits - 6) rows.
    """
    at = F.pmod(F.crc32(F.col(column).cast("binary")), F.lit(1 << bits))
    rows = (
        words.filter(F.col(column).isNotNull()).select(at.alias("at"))
        .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
        .toPandas()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def has_bit(bits: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """For each crc32 whether the set may hold its string."""
    at = crcs.astype(np.uint64) & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def crc(word: bytes) -> int:
    return zlib.crc32(word)
