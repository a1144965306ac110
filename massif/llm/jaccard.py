"""N-gram Jaccard join of documents by signature trees.

Documents with equal sets of shingles form one class; classes are joined by
``setjoin`` (prefix groups, signature trees with dual traversal, exact
verification), and linked classes form components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import setjoin, shared
from . import textkit as T

SHINGLE, PERCENT = 5, 75


def shingles(k: int):
    return lambda column: T.shingle_sets(T.Words(column, "nonspace"), k)


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    Rows link when 100 * intersection >= percent * union of their sets of
    k-word shingles; a row with fewer words, but not none, has its whole
    sequence as its one shingle.  component_id is the least doc_id that links
    reach; without words it is doc_id.  Rows without a doc_id take part, and
    get the least doc_id of their component, null if it has none.  Repeated
    rows are in one component.
    """
    sets = shingles(k)
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("t"))
    frequent = spark.sparkContext.broadcast(setjoin.frequent_hashes(source.select("t"), sets))

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), *setjoin.describe(b.column(1), sets, frequent.value, percent)], ["doc", "node", "n", "prefix", "sig"])

    profiles = shared.stored(shared.arrow_map(source, scan, "doc long, node long, n long, prefix array<long>, sig binary"), "shingle-profiles")
    frequent.destroy()
    # equal sets have equal prefixes and signatures, so any will do
    whole = profiles.where("n > 0").groupBy("node").agg(F.any_value("n").alias("n"), F.any_value("prefix").alias("prefix"), F.any_value("sig").alias("sig"), F.min("doc").alias("doc"))
    classes = shared.stored(whole, "classes")
    rows = shared.stored(profiles.select("doc", "n", "node"), "shingle-counts")
    shared.drop(profiles)

    def loaded(wanted: DataFrame) -> DataFrame:
        """(node, hashes) of these nodes, computed again from the texts of their first documents; a Bloom filter of fixed size lets few others pass."""
        first = classes.select("node", F.coalesce("doc", F.lit(-1)).alias("doc")).join(wanted, "node", "left_semi")
        bits = spark.sparkContext.broadcast(shared.Bits.build(first.select(F.xxhash64("doc").alias("h")), "h"))
        held.append(bits)

        def some(b: pa.RecordBatch) -> pa.RecordBatch | None:
            at = np.flatnonzero(shared.Bits.test(bits.value, b.column(0).to_numpy()))
            if not len(at):
                return None
            h, offs = sets(b.column(1).take(pa.array(at)))
            flat = [h[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(setjoin.node_of(h, offs).view(np.int64)), pa.array(flat, pa.binary())], ["node", "hashes"])

        found = shared.arrow_map(source.select(F.xxhash64(F.coalesce("doc", F.lit(-1))).alias("h"), "t"), some, "node long, hashes binary")
        return found.join(wanted, "node", "left_semi").dropDuplicates(["node"])

    held: list = []
    labels = setjoin.similar_components(classes, loaded, percent)
    for bits in held:
        bits.destroy()
    named = classes.select("node", "doc").join(labels, "node", "left").select("node", "doc", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("doc").alias("component_id"))
    named = named.join(least, "label").select("node", "component_id")
    # texts without words have one node between them, and no class
    out = rows.join(named, "node", "left").select(F.col("doc").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))
    out = shared.stored(out, "components")
    shared.drop(rows, classes, labels)
    return out


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at a Jaccard similarity of 0.75 of their 5-word shingles."""
    return jaccard_components(shared.documents(spark, sf_dir))
