"""Benchmark decontamination by winnowing.

A shared span of ``span`` words (10) shows as a shared fingerprint: of each
``span - k + 1`` consecutive k-gram hashes the least one (the rightmost of
equals) is kept on both sides, so every window of ``span`` words keeps at least
one k-gram, and equal windows keep the same one.  Fingerprints of documents
pass a Bloom filter of the benchmark's (fixed size, whatever the benchmark's),
the rest join the benchmark's on (gram length, hash), and each hit is extended
word by word to both sides; runs of at least ``span`` words are leaks.
Benchmark items that are shorter than ``span`` words keep each gram of their
own length, which is winnowing with a window of one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as T

SPAN, GRAM = 10, 6


def fingerprints(w: T.Words, span: int, k: int) -> np.ndarray:
    """Places of the k-grams that winnowing keeps."""
    g = T.grams(w.hash, k)
    at = T.gram_places(w.n, w.first, span)
    if not len(at):
        return at
    least, where = g[at], at.copy()
    for j in range(1, span - k + 1):
        here = g[at + j]
        better = here <= least
        least = np.where(better, here, least)
        where[better] = at[better] + j
    kept = np.zeros(len(g), bool)
    kept[where] = True
    return np.flatnonzero(kept)


def _hits(w: T.Words, span: int, k: int, lengths: list[int], bits: np.ndarray | None):
    """(row, gram length, hash, place in the row, words before, gram, words after) of each fingerprint."""
    out = []
    row = w.row()
    # size 0 in the result: a gram of k words that winnowing has kept; else a whole item of so many words, k among them
    for name, size, kept in [(0, k, fingerprints(w, span, k))] + [(n, n, T.gram_places(w.n, w.first, n)) for n in lengths]:
        h = T.grams(w.hash, size)[kept] if len(kept) else np.zeros(0, np.uint64)
        h = T.mix(h + np.uint64(name))
        if bits is not None and len(h):
            ok = shared.Bits.test(bits, h)
            h, kept = h[ok], kept[ok]
        reach = 0 if name else span - size
        for x, p in zip(h.view(np.int64).tolist(), kept.tolist(), strict=True):
            r = int(row[p])
            a, b = int(w.first[r]), int(w.first[r + 1])
            lo, hi = max(a, p - reach), min(b, p + size + reach)
            before = w.text(lo, p).split(" ")[::-1] if lo < p else []
            after = w.text(p + size, hi).split(" ") if p + size < hi else []
            out.append((r, name, x, p - a, before, w.text(p, p + size), after))
    return out


def _struct(found, ids) -> list[pa.Array]:
    cols = list(zip(*found, strict=True)) if found else [[]] * 7
    return [
        ids.take(pa.array(cols[0], pa.int64())),
        pa.array(cols[1], pa.int32()),
        pa.array(cols[2], pa.int64()),
        pa.array(cols[3], pa.int64()),
        pa.array(cols[4], pa.list_(pa.string())),
        pa.array(cols[5], pa.string()),
        pa.array(cols[6], pa.list_(pa.string())),
    ]


HIT = "size int, fp long, at long, before array<string>, gram string, after array<string>"


def benchmark_index(benchmark: DataFrame, item: str, text: str, span: int, k: int) -> tuple[DataFrame, list[int]]:
    """Fingerprints of the benchmark, as a stored table, and the lengths of its short items (at most span - 1 values)."""
    kind = benchmark.schema[item].dataType.simpleString()
    sizes = shared.arrow_map(
        benchmark.select(text), lambda b: pa.record_batch([pa.array(np.unique((w := T.Words(b.column(0), "alnum")).n[(w.n > 0) & (w.n < span)]), pa.int32())], ["n"]), "n int"
    )
    lengths = sorted(r["n"] for r in sizes.distinct().collect())

    def index(b: pa.RecordBatch) -> pa.RecordBatch:
        w = T.Words(b.column(1), "alnum")
        short = (w.n > 0) & (w.n < span)
        found = [h for h in _hits(w, span, k, lengths, None) if (h[1] == w.n[h[0]] if h[1] else not short[h[0]])]
        return pa.RecordBatch.from_arrays(_struct(found, b.column(0)), ["item", "size", "fp", "at", "before", "gram", "after"])

    out = shared.arrow_map(benchmark.select(item, text), index, f"item {kind}, {HIT}")
    return shared.stored(out, "benchmark-fingerprints"), lengths


def _reach(a: str, b: str):
    """How many words from the gram outwards agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("go")), lambda acc, x: F.struct((acc["n"] + F.when(acc["go"] & x, 1).otherwise(0)).alias("n"), (acc["go"] & x).alias("go")), lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, k: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, hits (array of spans start, end in words), items (sorted).

    Null and empty texts have no words and no hits; benchmark rows with null
    ids or texts match nothing; an empty benchmark leaves all clean.  Rows that
    repeat a doc_id with the same text each get the same result.  Other columns
    of docs are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    index, lengths = benchmark_index(benchmark.where(F.col(item).isNotNull() & F.col(item_text).isNotNull()), item, item_text, span, k)
    bits = spark.sparkContext.broadcast(shared.Bits.build(index.select("fp"), "fp"))

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        w = T.Words(b.column(1), "alnum")
        ids = b.column(0)
        whole = w.hasher.ranges(w.offs[:-1], w.offs[1:]).view(np.int64)
        found = _hits(w, span, k, lengths, bits.value)
        cols = _struct(found, ids)
        rows = np.array([f[0] for f in found], np.int64)
        n = len(ids)
        m = len(found)
        # the row of the document itself carries a key that no fingerprint has, so these rows spread evenly
        own = [ids, pa.array(np.full(n, -1), pa.int32()), pa.array(whole), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.string()), pa.nulls(n, pa.list_(pa.string()))]
        both = [pa.concat_arrays([x, y]) for x, y in zip(own, cols, strict=True)]
        words = pa.concat_arrays([pa.array(w.n.astype(np.int64)), pa.nulls(m, pa.int64())])
        key = pa.concat_arrays([pa.array(whole), pa.array(whole[rows] if m else np.zeros(0, np.int64))])
        return pa.RecordBatch.from_arrays([both[0], key, words, *both[1:]], ["doc", "whole", "n_words", "size", "fp", "at", "before", "gram", "after"])

    found = shared.arrow_map(docs.select(doc_id, text), scan, f"doc {kind}, whole long, n_words long, {HIT}")
    i = index.select("size", "fp", F.col("item"), F.col("before").alias("i_before"), F.col("gram").alias("i_gram"), F.col("after").alias("i_after"))
    i = shared.small(i)
    left, right = _reach("before", "i_before"), _reach("after", "i_after")
    width = F.when(F.col("size") == 0, F.lit(k)).otherwise(F.col("size"))
    joined = (
        found.join(i, ["size", "fp"], "left")
        .withColumn("ok", F.col("gram") == F.col("i_gram"))
        .withColumn("l", F.when(F.col("ok"), left))
        .withColumn("r", F.when(F.col("ok"), right))
        .withColumn("ok", F.col("ok") & ((F.col("size") > 0) | (F.col("l") + F.col("r") + width >= span)))
        .withColumn("hit", F.when(F.col("ok"), F.struct((F.col("at") - F.col("l")).alias("start"), (F.col("at") + width + F.col("r")).alias("end"))))
        .withColumn("hit_item", F.when(F.col("ok"), F.col("item")))
    )
    # rows that are equal in doc and text share one result, given back to each of them
    per = joined.groupBy("doc", "whole").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("hit")).alias("spans"), F.array_sort(F.collect_set("hit_item")).alias("items"), F.sum(F.when(F.col("size") == -1, 1)).alias("copies")
    )
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto")),
        lambda acc: acc["n"],
    )
    return per.select(F.explode(F.array_repeat(F.col("doc"), F.col("copies").cast("int"))).alias(doc_id), "n_words", merged.alias("n_hit"), F.col("spans").alias("hits"), "items")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words and items of the benchmark that they repeat."""
    d = decontaminate(shared.documents(spark, sf_dir), shared.table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return d.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
