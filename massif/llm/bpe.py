"""Byte-level BPE by a global shuffle of distinct words.

1. Documents are cut into pre-tokens.  The most frequent, at most HEAD_WORDS of
   them, are counted, encoded once, and broadcast as flat arrays.
2. Every other pre-token is exploded with its document and position and shuffled
   by word, so that all its occurrences meet: each distinct word is encoded once,
   and its ids go back with the positions, in a stored table.  Frequent words are
   in the head, so no word is hot here.
3. The ids join their documents, and are put in their places by position.  What
   is shuffled for this is the compressed text, as that is smaller than its ids.
4. Decoding joins ids with the token-byte table of the vocabulary, map-side: the
   table has as many rows as the vocabulary file, whatever the data.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textkit as T

#: Pre-tokens in the broadcast head at most; occurrences in a batch from which a pre-token is counted for it.
HEAD_WORDS, COUNTED_FROM = 400_000, 2
#: Words of the head that are hashed at a time.
HASHED = 1 << 15
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(1)
def char_classes() -> np.ndarray:
    """The class of every code point in the sense of \\p{L}, \\p{N} and \\s."""
    import regex

    t = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        t[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return t


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of the batch, the n + 1 bounds of its pre-tokens, and the first pre-token of each row.

    Does what the public pattern does: contractions, runs of letters, of numbers
    or of others, each with one space before it, and runs of white space, of
    which the last character is left to what follows.
    """
    data, offs = T.buffers(column)
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(offs), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    b = data[lead]
    cls = char_classes()[:128][np.minimum(b, 127)]
    wide = np.flatnonzero(b >= 128)
    if len(wide):
        d = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
        at, x = lead[wide], b[wide].astype(np.uint32)
        two = ((x & 0x1F) << 6) | (d[at + 1] & 0x3F)
        three = ((x & 0x0F) << 12) | ((d[at + 1] & 0x3F) << 6) | (d[at + 2] & 0x3F)
        four = ((x & 0x07) << 18) | ((d[at + 1] & 0x3F) << 12) | ((d[at + 2] & 0x3F) << 6) | (d[at + 3] & 0x3F)
        cls[wide] = char_classes()[np.where(x < 0xE0, two, np.where(x < 0xF0, three, four))]
    n = len(lead)
    rows = np.searchsorted(lead, offs)  # first character of each row
    begin = np.zeros(n + 1, bool)
    begin[rows] = True
    edge = begin[:n].copy()
    edge[1:] |= cls[1:] != cls[:-1]
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    kind = cls[start]
    # white space: the last character of a run before something else stands apart
    white = np.flatnonzero(kind == SPACE)
    inner = white[~begin[end[white]]]
    last = end[inner] - 1
    cut = edge
    cut[last] = True
    plain = last[b[last] == 32]
    cut[plain + 1] = False  # a single space goes with what follows
    # contractions: an apostrophe of its own, then one of the endings
    one = start[(kind == OTHER) & (end - start == 1)]
    one = one[(b[one] == 39) & cut[one] & ~begin[one + 1]]
    if len(one):
        bb = np.concatenate([b, np.zeros(2, np.uint8)])
        c1, c2 = bb[one + 1], bb[one + 2]
        c2 = np.where(begin[np.minimum(one + 2, n)], 0, c2)
        single = np.isin(c1, [ord(c) for c in "stmd"])
        double = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l")))
        for found, size in ((one[single], 2), (one[double], 3)):
            cut[found + 1] = False
            after = found + size
            after = after[after < n]
            cut[after] = True
    at = np.flatnonzero(cut)
    bounds = np.append(lead[at], len(data))
    return data, bounds, np.searchsorted(at, rows)


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Table:
    """The token-byte table: the bytes of each id, one after another, and their bounds; small enough to broadcast."""

    def __init__(self, path: str):
        table = ranks(path)
        tokens = [b""] * (max(table.values()) + 1)
        for token, i in table.items():
            tokens[i] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.at = np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int64)

    def ranks(self) -> dict[bytes, int]:
        flat, at = self.bytes.tobytes(), self.at.tolist()
        return {flat[a:z]: i for i, (a, z) in enumerate(zip(at[:-1], at[1:], strict=True)) if z > a}


_CODERS: dict[bytes, object] = {}


def coder(table: Table):
    """Gives the ids of a single pre-token; one for each worker and vocabulary."""
    import tiktoken

    key = hashlib.sha256(table.bytes.tobytes() + table.at.tobytes()).digest()
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = tiktoken.Encoding("massif", pat_str=r"(?s:.+)", mergeable_ranks=table.ranks(), special_tokens={})._encode_single_piece
    return _CODERS[key]


def gather(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[start:end] of each pair, one after another, and the bounds of the parts."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return flat[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def _words(data: np.ndarray, bounds: np.ndarray, at: np.ndarray) -> pa.Array:
    flat, off = gather(data, bounds[at], bounds[at + 1])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(flat)])


class Head:
    """The most frequent pre-tokens: two hashes of each, in order of the first, and their ids."""

    def __init__(self, words: pa.Array, table: Table):
        encode = coder(table)
        ids, size, h1, h2 = array("I"), array("q", [0]), [np.empty(0, np.uint64)], [np.empty(0, np.uint32)]
        for k in range(0, len(words), HASHED):  # hashing takes many times the room of the words
            part = words.slice(k, HASHED)
            data, off = T.buffers(part)
            for of, to in zip(_hashes(data, off[:-1], off[1:]), (h1, h2), strict=True):
                to.append(of)
            for word in part.to_pylist():
                one = encode(word)
                ids.extend(one)
                size.append(len(one))
        h1, h2, at = np.concatenate(h1), np.concatenate(h2), np.cumsum(np.array(size))
        order = np.argsort(h1, kind="stable")
        self.h1, self.h2 = h1[order], h2[order]
        self.ids, self.bounds = gather(np.array(ids, np.uint32), at[order], at[order + 1])

    def find(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pre-token, whether it is in the head, and where its ids begin and end."""
        if not len(self.h1) or len(bounds) < 2:
            n = len(bounds) - 1
            return np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int64)
        first = T.Hasher(data, 1).ranges(bounds[:-1], bounds[1:])
        u, where, back = np.unique(first, return_index=True, return_inverse=True)
        _, second = _hashes(data, bounds[where], bounds[where + 1])
        p = np.minimum(np.searchsorted(self.h1, u), len(self.h1) - 1)
        hit = (self.h1[p] == u) & (self.h2[p] == second)
        return hit[back], np.where(hit, self.bounds[p], 0)[back], np.where(hit, self.bounds[p + 1], 0)[back]


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return T.Hasher(data, 1).ranges(start, end), (T.Hasher(data, 2).ranges(start, end) >> T.U(32)).astype(np.uint32)


def frequent_words(docs: DataFrame, text: str, most: int) -> pa.Array:
    """The most frequent pre-tokens, by lossy counting: batches send what occurs in them more than once.  They steer what is broadcast, never the result."""

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        data, bounds, _ = pretokens(b.column(0))
        _, at, n = np.unique(T.Hasher(data).ranges(bounds[:-1], bounds[1:]), return_index=True, return_counts=True)
        at, n = at[n >= COUNTED_FROM], n[n >= COUNTED_FROM]
        return pa.RecordBatch.from_arrays([_words(data, bounds, at), pa.array(n)], ["word", "n"])

    sums = shared.arrow_map(docs.select(text), count, "word binary, n long", shared.BATCH).groupBy("word").agg(F.sum("n").alias("n"))
    if not most:
        return pa.array([], pa.binary())
    # Arrow holds the words in a few bytes more than they have; rows would take the driver hundreds of bytes each
    return shared.most_counted(sums, most).select("word").toArrow().column(0).cast(pa.binary()).combine_chunks()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", head_words: int = HEAD_WORDS) -> DataFrame:
    """Rows (doc_id, ids): ids is a binary of little-endian 32-bit integers, for every row of docs.

    A null or empty text has no ids (an empty binary).  Rows that repeat are
    encoded each.  Other columns are ignored; doc_id may be null.
    """
    spark = docs.sparkSession
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.xxhash64(F.col("doc").cast("string"), "t"))
    table = spark.sparkContext.broadcast(Table(path))
    head = spark.sparkContext.broadcast(Head(frequent_words(rows, "t", head_words), table.value))

    def explode(b: pa.RecordBatch) -> pa.RecordBatch:
        _, once = np.unique(b.column(0).to_numpy(), return_index=True)  # rows that repeat need their words once
        key, texts = b.column(0).to_numpy()[once], b.column(1).take(pa.array(once))
        data, bounds, first = pretokens(texts)
        tail = np.flatnonzero(~head.value.find(data, bounds)[0])
        row = np.searchsorted(first, tail, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(key[row]), pa.array((tail - first[row]).astype(np.int32)), _words(data, bounds, tail)], ["key", "pos", "word"])

    def encode_once(batches):
        one, last, ids = coder(table.value), None, b""
        for whole in batches:
            for b in shared.pieces(whole):
                out = []
                for word in b.column(2).to_pylist():  # sorted, so equal words follow one another
                    if word != last:
                        last, ids = word, np.array(one(word), "<u4").tobytes()
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["key", "pos", "ids"])

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        c = zstandard.ZstdCompressor(level=1, write_content_size=True)
        data, off = T.buffers(b.column(2))
        raw = memoryview(data)
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.compress(raw[a:z]) for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.binary())], ["doc", "key", "body"])

    def fill(b: pa.RecordBatch) -> pa.RecordBatch:
        d = zstandard.ZstdDecompressor()
        data, bounds, first = pretokens(pa.array([d.decompress(x) for x in b.column(1).to_pylist()], pa.large_binary()))
        found, a, z = head.value.find(data, bounds)
        # the ids of the tail follow those of the head, and each goes to the position of its word
        lists = b.column(2)
        size = pc.list_value_length(lists).fill_null(0).to_numpy()
        flat = lists.flatten()
        more, off = T.buffers(flat.field("ids"))
        at = first[:-1][np.repeat(np.arange(len(size)), size)] + flat.field("pos").to_numpy()
        a[at], z[at], found[at] = off[:-1] // 4 + len(head.value.ids), off[1:] // 4 + len(head.value.ids), True
        if not found.all():
            raise RuntimeError("a pre-token has no ids: the documents changed while they were read")
        ids, off = gather(np.concatenate([head.value.ids, more.view("<u4")]), a, z)
        return pa.RecordBatch.from_arrays([b.column(0), _binary(ids, off[first])], ["doc", "ids"])

    tail = shared.arrow_map(rows.select("key", "t"), explode, "key long, pos int, word binary").repartition("word").sortWithinPartitions("word")
    encoded = shared.stored(shared.batched(tail, encode_once, "key long, pos int, ids binary"), "bpe-ids")
    shared.release(spark)
    lists = encoded.groupBy("key").agg(F.collect_list(F.struct("pos", "ids")).alias("tail"))
    packed = shared.arrow_map(rows.select("doc", "key", "t"), pack, f"doc {kind}, key long, body binary")
    joined = packed.join(lists, "key", "left").select("doc", "body", "tail")
    return shared.arrow_map(joined, fill, f"doc {kind}, ids binary").withColumnRenamed("doc", doc_id)


def _binary(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Parts of an array of ids as binaries."""
    off = (bounds * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(ids))])


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with a column decoded: the bytes (binary) that the ids stand for; null ids decode to nothing."""
    others = [c for c in encoded.columns if c != "decoded"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*others).schema)

    table = encoded.sparkSession.sparkContext.broadcast(Table(path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        c = table.value
        flat, off = T.buffers(b.column(others.index(ids)))
        i = flat.view("<u4").astype(np.int64)
        data, bounds = gather(c.bytes, c.at[i], c.at[i + 1])
        out = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(bounds[off // 4]), pa.py_buffer(data)])
        return pa.RecordBatch.from_arrays([*b.columns, pc.cast(out, pa.binary())], [*others, "decoded"])

    return shared.arrow_map(encoded.select(*others), run, fields + ", decoded binary")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded with the public 50k byte-level vocabulary, and decoded again."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    done = decode(encode(shared.documents(spark, sf_dir), path), path)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
