"""WARC archives in Zstandard form, written and read back.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, itself raw or a Zstandard frame; each record is one frame of its
own, compressed with that dictionary.  The reader streams an archive frame by
frame and checks every record: version line, required headers,
Content-Length against the block, and both digests.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
#: Payloads below this are never revisits; an archive rolls over at this size; records the dictionary is trained on.
LEAST_REVISIT, ARCHIVE_BYTES, TRAINED_ON, DICTIONARY_BYTES = 100, 64 << 20, 200, 16 << 10
#: Parts into which the pages of one digest are dealt.
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
HTTP_RESPONSE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    pass


def record_id(page_id) -> str:
    return f"<urn:page:{page_id}>"


def page_of(uri: str) -> int | None:
    inner = uri.strip("<>").rpartition(":")[2]
    return None if inner == "None" else int(inner)


def _clean(value: str) -> str:
    """A header's value on one line; %, CR, LF and other controls are percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c == "%" or ord(c) < 32 else c for c in value)


def make_record(page_id, url, payload: bytes, refers_to=None) -> bytes:
    """A response record, or a revisit of refers_to, which leaves out the payload."""
    revisit = refers_to is not None
    head = HTTP_RESPONSE % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(url or '')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The headers (names in lower case), block, payload length and digest of one record, checked."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"no WARC record: {raw[:40]!r}")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"not a header: {line!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    length = headers["content-length"]
    if not length.isdigit() or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {length}, but {len(rest) - 4} bytes")
    block = rest[:-4]
    if (d := headers.get("warc-block-digest")) and d != "sha256:" + hashlib.sha256(block).hexdigest():
        raise WarcError("wrong block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    out = {"headers": headers, "block": block, "payload": payload, "payload_bytes": len(payload), "digest": hashlib.sha256(payload).hexdigest()}
    said = headers.get("warc-payload-digest", "").removeprefix("sha256:")
    if headers["warc-type"] == "revisit":
        if payload or not said or "warc-refers-to" not in headers:
            raise WarcError("a revisit needs a payload digest and a reference, and no payload")
        stated = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        out |= {"digest": said, "payload_bytes": int(stated[0].split(b":")[1]), "payload": None}
    elif said and said != out["digest"]:
        raise WarcError("wrong payload digest")
    return out


class Writer:
    """One archive: the dictionary's frame, then a frame for each record."""

    def __init__(self, sink, samples: list[bytes]):
        self.sink, self.size = sink, 0
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 16 else b""
        except zstandard.ZstdError:  # too few or too uniform samples
            found = b""
        packed = zstandard.ZstdCompressor(level=9).compress(found) if found else b""
        self._put(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        data = zstandard.ZstdCompressionDict(found) if found else None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=data, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame at a time, from a file object."""
    head = source.read(8)
    if len(head) < 8:
        raise WarcError("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise WarcError(f"the first frame is no dictionary: {magic:#x}")
    found = source.read(size)
    if len(found) != size:
        raise WarcError("the dictionary's frame is cut short")
    if found[:4] == struct.pack("<I", FRAME):
        found = zstandard.ZstdDecompressor().decompress(found)
    if found and found[:4] != struct.pack("<I", DICTIONARY):
        raise WarcError("not a dictionary")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found) if found else None)
    rest = b""
    while True:
        rest = rest or source.read(1 << 20)
        if not rest:
            return
        one, out = decompressor.decompressobj(), []
        while not one.eof:
            if not rest and not (rest := source.read(1 << 20)):
                raise WarcError("a frame is cut short")
            out.append(one.decompress(rest))
            rest = one.unused_data if one.eof else b""
        yield b"".join(out)


def digest_of(html: str):
    """SHA-256 of a payload that is long enough to be revisited, else null."""
    t = F.coalesce(html, F.lit(""))
    return F.when(F.octet_length(t) >= LEAST_REVISIT, F.sha2(t.cast("binary"), 256))


def first_of_equals(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """(page, digest, refers_to) of the pages that revisit an equal payload, without their payloads.

    The pages of one digest, which may be many, are salted for the join.
    """
    digests = pages.where(F.col(page_id).isNotNull()).select(F.col(page_id).alias("page"), digest_of(html).alias("digest")).where(F.col("digest").isNotNull())
    least = digests.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("most")).where(F.col("refers_to") != F.col("most")).drop("most")
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = digests.distinct().withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALTS)).cast("int"))
    return salted.join(least, ["digest", "salt"]).where(F.col("page") != F.col("refers_to")).select("page", "digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for every row of pages to archives in folder; gives the stored manifest (path, records).

    Each attempt of a task writes files of its own names, and only those of the
    attempt that succeeds are in the manifest.
    """
    revisits = first_of_equals(pages, page_id, html)
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"), digest_of(html).alias("digest"))
    # by page and payload: pages that repeat an id with other payloads are records of their own
    rows = rows.join(revisits, ["page", "digest"], "left").select("page", "url", "html", "refers_to")

    def put(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        state = {"writer": None, "sink": None, "n": 0, "path": ""}
        waiting: list[bytes] = []
        done = []

        def close():
            if state["sink"]:
                state["sink"].close()
                done.append((state["path"], state["n"]))
                state.update(writer=None, sink=None, n=0)

        for whole in batches:
            for b in shared.pieces(whole):
                for page, u, text, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    record = make_record(page, u, (text or "").encode(), refers)
                    if state["writer"]:
                        state["writer"].add(record)
                        state["n"] += 1
                        if state["writer"].size >= archive_bytes:
                            close()
                    else:
                        waiting.append(record)
                        if len(waiting) >= TRAINED_ON:
                            _open(state, fs, base, waiting)
        if waiting:
            _open(state, fs, base, waiting)
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.int64())], ["path", "records"])

    return shared.stored(shared.batched(rows, put, "path string, records long"), "warc-manifest")


def _open(state: dict, fs, base: str, waiting: list[bytes]) -> None:
    """Opens an archive whose dictionary is trained on the waiting records, and writes them."""
    state["path"] = f"{base}/{uuid.uuid4().hex}.warc.zst"
    state["sink"] = fs.open_output_stream(state["path"], compression=None)
    state["writer"] = Writer(state["sink"], waiting)
    for r in waiting:
        state["writer"].add(r)
    state["n"] = len(waiting)
    waiting.clear()


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """A row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload).

    A damaged archive or record raises WarcError, and so fails the job.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    parts = max(1, min(manifest.count(), 8 * manifest.sparkSession.sparkContext.defaultParallelism))

    def get(batches):
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, expected in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                n, rows, size = 0, [], 0
                with fs.open_input_stream(path, compression=None) as f:
                    for raw in read_archive(f):
                        r = parse_record(raw)
                        h = r["headers"]
                        row = (page_of(h["warc-record-id"]), h.get("warc-target-uri"), r["payload_bytes"], r["digest"], h["warc-type"], page_of(h["warc-refers-to"]) if "warc-refers-to" in h else None)
                        rows.append((*row, r["payload"]) if with_payload else row)
                        n, size = n + 1, size + (len(raw) if with_payload else 200)
                        if size > shared.PIECE:
                            yield _rows(rows, with_payload)
                            rows, size = [], 0
                if n != expected:
                    raise WarcError(f"{path}: {n} records, {expected} were written")
                if rows:
                    yield _rows(rows, with_payload)

    return shared.batched(manifest.repartition(parts), get, schema)


def _rows(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes all pages as archives in the shared folder and reads them back.

    Null html is an empty payload; pages with a null id are responses; rows
    that repeat a page_id are records of their own, and none revisits its own id.
    """
    folder = shared.new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, page_id, url, html), folder)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC archives and back."""
    return round_trip(shared.table(spark, sf_dir, "pages")).drop("url")
