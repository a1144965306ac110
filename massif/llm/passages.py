"""Substring deduplication: passages that repeat, by MinHash banding of paragraphs.

Texts are cut into paragraphs by their content, not by their lines: a paragraph
begins at each word whose hash is the least of its neighbourhood, so equal
passages are cut alike wherever they stand and however their lines are broken.
Paragraphs get MinHash values of their 5-word shingles in bands; those that
collide in a band are candidates, exact Jaccard decides, and components of what
is similar are the clusters of repeats.  Consecutive paragraphs that other
documents hold too make a passage; of each cluster the first occurrence stays,
the others are removals.

Equal paragraphs meet by their hash alone.  The groups of the bands are worked
as in ``setjoin``: neighbours first, then signature trees for what is not yet
connected; none is gathered in one task.
"""

from __future__ import annotations

import os
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import setjoin, shared, sigtree
from . import textkit as T

SHINGLE, PERCENT, RECALL = 5, 75, 0.98
#: Words on either side among which the first word of a paragraph has the least hash: a paragraph has RADIUS + 1 words
#: at least, and 2 * RADIUS + 1 in the mean, so a passage of 50 words holds several whole ones.
RADIUS = 5
#: Words that the whole paragraphs of a passage must hold together.  Up to 2 * RADIUS words or so at either end of what
#: is shared lie in paragraphs that are not shared whole, so this finds passages of 50 words, and leaves shorter lines alone.
LEAST_WORDS = 16


def tuned(percent: int, recall: float = RECALL, rows: int = 2) -> tuple[int, int]:
    """The fewest bands of so many rows that find pairs at the threshold with this probability."""
    bands = 1
    while 1 - (1 - (percent / 100) ** rows) ** bands < recall:
        bands += 1
    return bands, rows


def band_keys(h: np.ndarray, offs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """An array (texts, bands) of keys; texts must not be empty."""
    seeds = np.random.default_rng(11).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(offs) - 1, bands), np.uint64)
    if not len(out):
        return out
    for b in range(bands):
        key = np.full(len(offs) - 1, b + 1, np.uint64)
        for r in range(rows):
            least = np.minimum.reduceat(T.mix(h * seeds[b * rows + r]), offs[:-1])
            key = T.mix(key * np.uint64(0x9FB21C651E98DF25) + least)
        out[:, b] = key
    return out


def beginnings(w: T.Words, radius: int) -> np.ndarray:
    """Places of the words that begin a paragraph: the first of each row, and each that with its next word has a hash below those before it, and not above those after it, within the radius."""
    n = len(w.hash)
    place = np.arange(n) - np.repeat(w.first[:-1], w.n)
    left = np.repeat(w.n, w.n) - 1 - place
    after = np.concatenate([w.hash[1:], np.zeros(min(n, 1), np.uint64)])
    v = T.mix(w.hash * T.U(0x9FB21C651E98DF25) + np.where(left > 0, after, T.U(0)))
    least = np.ones(n, bool)
    for d in range(1, min(radius, n - 1) + 1):
        less = v[d:] < v[:-d]
        least[d:] &= less | (place[d:] < d)
        least[:-d] &= ~less | (left[:-d] < d)
    return np.flatnonzero(least | (place == 0))


def paragraphs(w: T.Words, radius: int) -> tuple[np.ndarray, SimpleNamespace]:
    """The row of each paragraph, and the paragraphs as rows of words."""
    at = beginnings(w, radius)
    first = np.append(at, len(w.hash))
    return w.row()[at], SimpleNamespace(n=np.diff(first), first=first, hash=w.hash)


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, radius: int = RADIUS) -> DataFrame:
    """A row for each passage that other rows of docs hold too: doc_id, para, start, end, words, cluster_doc, cluster_para, removed.

    para counts paragraphs within the text, start and end are code points, words
    are those of the passage's paragraphs, in lower case and whatever the white
    space.  (cluster_doc, cluster_para) is the first occurrence, by doc_id, of
    its first paragraph; that one is not removed.  A passage is cut where it turns
    from what stays to what goes.  Rows that repeat a doc_id, or have none, are
    occurrences of their own; what repeats within one row alone is no passage.
    Null and empty texts have none.  Other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    bands, rows = tuned(percent)
    spark = docs.sparkSession
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc"), F.col(text).alias("t"))

    def cut(b: pa.RecordBatch) -> pa.RecordBatch:
        w = T.Words(b.column(1), "nonspace")
        row, p = paragraphs(w, radius)
        h, offs = T.shingle_sets(p, SHINGLE)
        lead = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)])
        begin = lead[w.offs[:-1][row]]
        count = np.arange(len(row)) - np.searchsorted(row, np.arange(len(w.n)))[row]
        ids = np.frombuffer(os.urandom(8 * len(w.n)), np.int64)
        a, z = w.start[p.first[:-1]], w.end[p.first[1:] - 1]
        small = lambda x: pa.array(x.astype(np.int32))
        cols = [b.column(0).take(pa.array(row)), pa.array(ids[row]), small(count), small(lead[a] - begin), small(lead[z] - begin), small(p.n), pa.array(setjoin.node_of(h, offs).view(np.int64))]
        return pa.RecordBatch.from_arrays(cols, ["doc", "row", "para", "start", "end", "words", "node"])

    def distinct(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each paragraph of a batch once: node, hashes and their bounds."""
        h, offs = T.shingle_sets(paragraphs(T.Words(column, "nonspace"), radius)[1], SHINGLE)
        node, at = np.unique(setjoin.node_of(h, offs), return_index=True)
        return node, *_taken(h, offs, at)

    def banded(b: pa.RecordBatch) -> pa.RecordBatch:
        node, h, offs = distinct(b.column(0))
        # a set of fewer than percent / (100 - percent) hashes is similar to itself alone
        enough = np.flatnonzero((100 - percent) * np.diff(offs) >= percent)
        node, (h, offs) = node[enough], _taken(h, offs, enough)
        keys = band_keys(h, offs, bands, rows)
        return pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(node, bands).view(np.int64)), pa.array(np.repeat(np.diff(offs), bands))], ["key", "node", "n"])

    # rows get random ids, so they are stored before anything reads them twice
    found = shared.stored(shared.arrow_map(source, cut, f"doc {kind}, row long, para int, start int, end int, words int, node long"), "paragraphs")
    near = setjoin.neighbours(shared.arrow_map(source.select("t"), banded, "key long, node long, n long", shared.BATCH))
    groups = shared.stored(near.withColumn("index", F.lit(True)), "bands")
    wanted = shared.stored(groups.select("node").distinct(), "banded-paragraphs")
    bits = spark.sparkContext.broadcast(shared.Bits.build(wanted, "node"))

    def described(b: pa.RecordBatch) -> pa.RecordBatch:
        node, h, offs = distinct(b.column(0))
        h, offs = _taken(h, offs, at := np.flatnonzero(shared.Bits.test(bits.value, node)))
        flat = [h[a:z].tobytes() for a, z in zip(offs[:-1], offs[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node[at].view(np.int64)), pa.array(np.diff(offs)), pa.array(sigtree.signatures(h, offs), pa.binary()), pa.array(flat, pa.binary())], ["node", "n", "sig", "hashes"])

    sets = shared.arrow_map(source.select("t"), described, "node long, n long, sig binary, hashes binary", shared.BATCH)
    nodes = shared.stored(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "paragraph-sets")
    bits.destroy()
    labels = setjoin.joined(groups, nodes, lambda some: nodes.select("node", "hashes").join(some, "node", "left_semi"), percent, whole=True)
    shared.drop(nodes, wanted)

    of = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    named = found.join(shared.small(of), F.col("node") == F.col("_node"), "left").select("doc", "row", "para", "start", "end", "words", F.coalesce("_label", "node").alias("label"))
    clusters = named.groupBy("label").agg(F.min(F.struct("doc", "row", "para")).alias("first"), F.min("row").alias("a"), F.max("row").alias("z")).where("a <> z").select("label", "first")
    clusters = shared.stored(clusters, "clusters")
    again = named.join(shared.small(clusters.select("label", "first.*").toDF("label", "f_doc", "f_row", "f_para")), "label")
    again = again.withColumn("removed", (F.col("f_row") != F.col("row")) | (F.col("f_para") != F.col("para")))
    order = Window.partitionBy("row").orderBy("para")
    apart = F.coalesce(F.col("para") - F.lag("para").over(order) > 1, F.lit(True))
    turned = apart | (F.col("removed") != F.lag("removed").over(order))
    again = again.withColumn("_apart", apart.cast("int")).withColumn("_turned", turned.cast("int"))
    again = again.withColumn("stretch", F.sum("_apart").over(order)).withColumn("part", F.sum("_turned").over(order))
    parts = again.groupBy("row", "stretch", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.min(F.struct("para", "doc", "f_doc", "f_para", "removed")).alias("x"))
    parts = parts.withColumn("all", F.sum("words").over(Window.partitionBy("row", "stretch"))).where(F.col("all") >= least_words)
    out = parts.select(F.col("x.doc").alias(doc_id), "x.para", "start", "end", "words", F.col("x.f_doc").alias("cluster_doc"), F.col("x.f_para").alias("cluster_para"), "x.removed")
    out = shared.stored(out, "passages")
    shared.drop(found, clusters, labels)
    return out


def _taken(h: np.ndarray, offs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of several sets."""
    size = np.diff(offs)[at]
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return h[np.repeat(offs[:-1][at] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across all documents."""
    return repeated_passages(shared.documents(spark, sf_dir))
