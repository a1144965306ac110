import hashlib
import io
import struct

import pytest
import zstandard

from massif.llm import warc


def test_round_trip_and_edges(spark):
    big = "<p>é" + "x" * 200 + "</p>"
    rows = [(5, "u", big), (3, "u\r\nX: y", big), (9, None, big), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (None, "u", big), (3, "u", big)]
    rows += [(100 + i, f"http://h/{i}%", f"<html>{i} body " * 40) for i in range(300)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    folder = warc.shared.new_folder(spark, "warc-test")
    manifest = warc.write_archives(d, folder, archive_bytes=3000)
    assert manifest.count() >= 2
    got = warc.read_archives(manifest, folder, with_payload=True).collect()
    assert len(got) == len(rows)
    kinds = sorted(((x.page_id, x.record_type, x.refers_to) for x in got if x.page_id is None or x.page_id < 100), key=str)
    assert kinds == sorted([(5, "revisit", 3), (3, "response", None), (9, "revisit", 3), (1, "response", None), (2, "response", None), (4, "response", None), (6, "response", None), (None, "response", None), (3, "response", None)], key=str)
    assert all(x.payload_bytes == len(big.encode()) for x in got if x.page_id in (3, 5, 9))
    by = {x.page_id: bytes(x.payload) for x in got if x.record_type == "response"}
    assert all(by[i] == (h or "").encode() for i, _, h in rows if i in by)
    assert warc.round_trip(d.limit(0)).count() == 0


def test_rows_that_repeat_an_id_with_other_payloads(spark):
    a, b = "a" * 150, "b" * 150
    rows = [(1, "u", a), (2, "u", b), (5, "u", a), (5, "u", b), (5, "u", "c" * 150), (5, "u", b)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = [(1, "response", None, a), (2, "response", None, b), (5, "revisit", 1, a), (5, "revisit", 2, b), (5, "response", None, "c" * 150), (5, "revisit", 2, b)]
    assert sorted(((x.page_id, x.record_type, x.refers_to, x.payload_digest) for x in got), key=str) == sorted(((i, k, f, hashlib.sha256(h.encode()).hexdigest()) for i, k, f, h in want), key=str)


def archive(records, samples=()):
    out = io.BytesIO()
    w = warc.Writer(out, list(samples))
    for r in records:
        w.add(r)
    return out.getvalue()


def test_dictionary_frames():
    records = [warc.make_record(i, f"http://host/{i}", f"<html>page {i} text {i * i}</html>".encode() * 5) for i in range(300)]
    data = archive(records, records[:200])
    assert struct.unpack("<I", data[:4])[0] == warc.SKIPPABLE and struct.unpack("<I", data[4:8])[0] > 100
    assert list(warc.read_archive(io.BytesIO(data))) == records
    with pytest.raises(zstandard.ZstdError):  # frames cannot be read without it
        list(warc.read_archive(io.BytesIO(struct.pack("<II", warc.SKIPPABLE, 0) + data[8 + struct.unpack("<I", data[4:8])[0] :])))
    assert list(warc.read_archive(io.BytesIO(archive([])))) == []


@pytest.mark.parametrize("change", [lambda r: r.replace(b"WARC/1.1", b"WARX/1.1"), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 2), lambda r: r[:-5], lambda r: r.replace(b"body", b"BODY"), lambda r: r.replace(b"WARC-Date", b"X-Date"), lambda r: b""])
def test_damage_is_found(change):
    with pytest.raises(warc.WarcError):
        warc.parse_record(change(warc.make_record(1, "u", b"some body")))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(archive([b"x" * 100])[:-3])))
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(io.BytesIO(b"")))
