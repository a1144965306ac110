"""Quality rules with cross-document line frequency.

Lines are normalised (lower case, digits to 0, single spaces) and hashed; for
each host the distinct documents with a line are counted; lines above the limits
are removed, and a document that loses too much is rejected.  Copies are documents
too: deduplication, not this operator, keeps one of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as T

MIN_DOCS, MIN_SHARE, MOST_REMOVED, MIN_WORDS, MOST_REPEATED = 10, 0.01, 0.5, 10, 20


def _folded() -> np.ndarray:
    t = T.lower_table().copy()
    t[48:58] = 48
    return t


def profile(text: pa.Array) -> dict[str, pa.Array]:
    """Counts and lines of each row of a batch."""
    w = T.Words(text, "nonspace", lower=False)
    data, offs, rows = w.data, w.offs, len(w.n)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbol = np.zeros(256, bool)
    symbol[[ord(c) for c in "#*$%&|<>"]] = True
    symbols = np.concatenate([[0], np.cumsum(symbol[data])])
    chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])

    # lines that have a word: the words between two line feeds of a row
    feeds = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offs[:-1], feeds + 1]))
    begin = begin[begin < len(data)]
    stop = np.minimum(np.append(begin[1:], len(data)), np.concatenate([feeds, [len(data)]])[np.searchsorted(feeds, begin)])
    a, z = np.searchsorted(w.start, begin), np.searchsorted(w.start, stop)
    full = z > a
    begin, stop, a, z = begin[full], stop[full], a[full], z[full]
    row = np.searchsorted(offs, begin, side="right") - 1
    order = np.lexsort((raw := w.hasher.ranges(begin, stop), row))
    same = np.zeros(len(order), bool)
    same[1:] = (raw[order][1:] == raw[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup = np.bincount(row[order][same], minlength=rows)

    # repeated 5-word windows
    at = T.gram_places(w.n, w.first, 5)
    g = T.grams(w.hash, 5)[at] if len(at) else np.zeros(0, np.uint64)
    grow = np.repeat(np.arange(rows), np.maximum(w.n - 4, 0))
    order = np.lexsort((g, grow))
    eq = np.zeros(len(order) + 1, bool)
    if len(order) > 1:
        eq[1:-1] = (g[order][1:] == g[order][:-1]) & (grow[order][1:] == grow[order][:-1])
    again = at[order[eq[:-1] | eq[1:]]]
    covered = np.zeros(len(w.hash) + 1, bool)
    for j in range(5):
        covered[again + j] = True
    repeated = np.concatenate([[0], np.cumsum(covered[:-1])])

    # normalised lines: a hash of the hashes of their folded words
    words = T.Hasher(_folded()[data], 3).ranges(w.start, w.end)
    base = T.U(0xC2B2AE3D27D4EB4F)
    powers, inverse = T.powers(len(words), base), T.powers(len(words) + 1, T.U(pow(int(base), -1, 2**64)))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers, dtype=np.uint64)])
    key = T.mix((total[z] - total[a]) * inverse[a] + (z - a).astype(np.uint64))
    order = np.lexsort((key, row))
    first = np.ones(len(order), bool)
    first[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    starts = np.flatnonzero(first)
    weight = np.add.reduceat((z - a)[order], starts) if len(starts) else np.zeros(0, np.int64)
    key, row = key[order][starts], row[order][starts]
    bounds = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    lines = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(weight.astype(np.int64))], ["h", "w"])
    return {
        "whole": pa.array(w.hasher.ranges(offs[:-1], offs[1:]).view(np.int64)),
        "n_words": pa.array(w.n.astype(np.int64)),
        "word_chars": pa.array((chars[w.first[1:]] - chars[w.first[:-1]]).astype(np.int64)),
        "n_symbols": pa.array((symbols[offs[1:]] - symbols[offs[:-1]]).astype(np.int64)),
        "n_dup_lines": pa.array(dup.astype(np.int64)),
        "n_repeat_words": pa.array((repeated[w.first[1:]] - repeated[w.first[:-1]]).astype(np.int64)),
        "lines": pa.ListArray.from_arrays(bounds, lines),
    }


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, min_share: float = MIN_SHARE, most_removed: float = MOST_REMOVED) -> DataFrame:
    """One row per row of docs: doc_id, the base counts, n_removed_words, base_failed and kept.

    A line goes when at least min_docs distinct documents of its host, and at
    least min_share of the host's documents, have it; documents are told apart by
    doc_id, those without one by their text.  A document is rejected if
    it fails the base rules, or if over most_removed of its words go, or fewer
    than MIN_WORDS remain.  Null and empty texts have no words and fail; null
    hosts form a host of their own.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        p = profile(b.column(2))
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), *p.values()], ["doc", "host", *p])

    fields = "whole long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h: long, w: long>>"
    found = shared.stored(shared.arrow_map(docs.select(doc_id, F.col(host).cast("string"), text), scan, f"doc {kind}, host string, {fields}"), "line-profiles")
    found = found.withColumn("host", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit("null")))
    own = F.xxhash64(F.col("doc").cast("string"), F.when(F.col("doc").isNull(), F.col("whole"))).alias("own")
    hosts = found.select("host", own).distinct().groupBy("host").agg(F.count("*").alias("docs"))
    each = found.select("host", own, F.explode("lines.h").alias("h")).distinct().groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    over = each.join(hosts, "host").where(F.col("n") >= F.col("docs") * min_share).select("host", "h")
    over = shared.small(shared.stored(over, "frequent-lines"))
    lost = (
        found.select("doc", "whole", "host", F.explode("lines").alias("x"))
        .select("doc", "whole", "host", F.col("x.h").alias("h"), F.col("x.w").alias("w"))
        .join(over, ["host", "h"])
        .groupBy("doc", "whole", "host")
        .agg(F.aggregate(F.collect_set(F.struct("h", "w")), F.lit(0).cast("long"), lambda acc, x: acc + x["w"]).alias("lost"))
        .select(F.col("doc").alias("l_doc"), F.col("whole").alias("l_whole"), F.col("host").alias("l_host"), "lost")
    )
    gone = F.coalesce("lost", F.lit(0).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (gone > F.col("n_words") * most_removed) | (F.col("n_words") - gone < MIN_WORDS)
    return (
        found.drop("lines")
        .join(lost, F.col("doc").eqNullSafe(F.col("l_doc")) & (F.col("whole") == F.col("l_whole")) & (F.col("host") == F.col("l_host")), "left")
        .select(F.col("doc").alias(doc_id), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", gone.alias("n_removed_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"))
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdicts of all documents, by host."""
    return quality_rules(shared.documents(spark, sf_dir))
