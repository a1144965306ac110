"""Where operators put tables that cut lineage, and small guards."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import drop, new_folder, release, shared_folder, stored

__all__ = ["Bits", "arrow_map", "documents", "drop", "most_counted", "new_folder", "pieces", "release", "shared_folder", "small", "stored", "table"]

#: Bytes that are broadcast at most.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if the bytes of its rows, as counted, fit the limit; else as it is.

    df should be a stored table: it is read once to be counted.
    """
    size = F.lit(0).cast("long")
    for f in df.schema:
        kind = f.dataType.simpleString()
        if kind in ("string", "binary"):
            size += F.coalesce(F.octet_length(f.name), F.lit(0)) + 16
        elif kind.startswith("array<string"):
            size += F.coalesce(F.aggregate(f.name, F.lit(0), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0)) + 24), F.lit(0)) + 16
        elif kind.startswith(("array", "map", "struct")):
            raise TypeError(f"no count of bytes for {kind}")
        else:
            size += 8
    total = df.select(F.sum(size + 32)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def most_counted(counts: DataFrame, most: int, n: str = "n") -> DataFrame:
    """The rows of counts with the highest n, at most so many: a histogram of n (8 bins for each power of two) tells where to cut, so nothing is sorted."""
    counts = stored(counts, "counts")
    grade = F.floor(F.log2(n) * 8).cast("int")
    room, least = most, None
    for r in sorted(counts.groupBy(grade.alias("g")).agg(F.count("*").alias("c")).collect(), reverse=True):
        if r["c"] > room:
            break
        room, least = room - r["c"], r["g"]
    return counts.where(F.lit(False) if least is None else grade >= least)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Bits:
    """A Bloom filter of a fixed number of bits, built by Spark's bitmap aggregates.

    The size never grows with the data: a fuller filter passes more rows, and
    the join that follows stays exact.
    """

    LOG2 = 25

    @classmethod
    def build(cls, keys: DataFrame, column: str) -> np.ndarray:
        """keys: a table of longs; gives the filter as bytes (at most 2**25 bits)."""
        mask = (1 << cls.LOG2) - 1
        two = keys.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 34).bitwiseAND(F.lit(mask)))).alias("b"))
        rows = (
            two.select(F.shiftrightunsigned("b", 15).alias("k"), F.col("b").bitwiseAND(F.lit(32767)).alias("p"))
            .groupBy("k")
            .agg(F.expr("bitmap_construct_agg(p)").alias("m"))
            .collect()
        )
        bits = np.zeros((1 << cls.LOG2) // 8, np.uint8)
        for r in rows:
            m = np.frombuffer(r["m"], np.uint8)
            bits[r["k"] * 4096 : r["k"] * 4096 + len(m)] = m
        return bits

    @classmethod
    def test(cls, bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << cls.LOG2) - 1)
        h = h.view(np.uint64)
        out = np.ones(len(h), bool)
        for x in (h & mask, (h >> np.uint64(34)) & mask):
            out &= (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


#: Bytes of a batch that a kernel works on at once; a single longer row makes a batch of its own.
PIECE = 1 << 20
#: Bytes at which Spark ends a batch that it sends to a Python worker.
BATCH = 4 << 20


def pieces(batch, most: int = PIECE):
    """The batch in slices of consecutive rows of at most so many bytes, or of one row."""
    n, size = batch.num_rows, batch.nbytes
    if size <= most or n == 1:
        return [batch]
    half = n // 2
    return [*pieces(batch.slice(0, half), most), *pieces(batch.slice(half), most)]


def trim() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on after their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batched(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(f), with batches that are bounded in bytes, and memory given back after each task."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b")) > BATCH:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, f: Callable, schema: str, most: int = PIECE) -> DataFrame:
    """mapInArrow with f(batch) -> batch or None, over batches of bounded size."""

    def run(batches):
        for whole in batches:
            for b in pieces(whole, most) if whole.num_rows else []:
                out = f(b)
                if out is not None and out.num_rows:
                    yield out

    return batched(df, run, schema)
