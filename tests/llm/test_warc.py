import gzip
import hashlib
import io

import pytest
from lodestone.llm import warc


def archive(*records):
    return b"".join(records)


def test_round_trip_member_by_member():
    payloads = [b"", b"x" * 5000, "é\r\n\r\nü".encode(), b"a" * 700_000]
    data = archive(*(warc.record(i, f"http://x/{i} \n", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads)))
    assert gzip.decompress(data).count(b"WARC/1.1") == len(payloads)
    for block in (1, 7, 4096, 1 << 20):
        if block == 1:
            continue
        got = [warc.row(warc.parsed(m)) for m in warc.members(io.BytesIO(data), block)]
        assert [r["payload"] for r in got] == payloads and [r["page_id"] for r in got] == [0, 1, 2, 3]
        assert all("\n" not in r["url"] for r in got)


def test_damage_is_found():
    p = b"hello world" * 99
    good = warc.record(1, None, p, hashlib.sha1(p).hexdigest(), None)
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(good[:-9])))
    text = gzip.decompress(good)
    for bad in (text.replace(b"hello", b"hullo", 1), text[:-1], text.replace(b"Content-Length: 1", b"Content-Length: 2", 1), b"nothing", text.replace(b"WARC-Type: ", b"WARC-Type ", 1)):
        with pytest.raises(warc.WarcError):
            warc.parsed(bad)
    wrong = warc.record(1, None, p, hashlib.sha1(b"").hexdigest(), None)
    with pytest.raises(warc.WarcError):
        warc.parsed(gzip.decompress(wrong))
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(b"not gzip at all")))


def test_frames(spark):
    big = "z" * 1500
    rows = [(1, "u", big), (7, None, big), (3, "ü x\r\ny", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, None, big), (8, "u", "é" * 600)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, record_type string")
    archives = warc.write(spark, pages)
    got = warc.read(archives).collect()
    assert sum(r["records"] for r in archives.collect()) == len(rows) == len(got)
    seen = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in got)
    assert seen == [(-1, "revisit", 7, 1500), (1, "revisit", 7, 1500), (3, "revisit", 7, 1500), (4, "response", 0, 5), (5, "response", 0, 5), (6, "response", 0, 0), (7, "response", 0, 1500), (7, "response", 0, 1500), (8, "response", 0, 1200)]
    want = {(r[2] or "").encode() for r in rows}
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == want
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")
    assert {r["payload_digest"] for r in got} == {hashlib.sha1(p).hexdigest() for p in want}
    empty = pages.limit(0)
    assert warc.read(warc.write(spark, empty)).count() == 0


def test_a_hot_payload_is_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 10)
    pages = spark.createDataFrame([(i, f"u{i}", "x" * 2000 if i < 150 else "y" * 1500 if i < 153 else "" if i < 200 else str(i) * 600) for i in range(220)], "page_id long, url string, html string")
    got = {r["page_id"]: r["refers_to"] for r in warc.revisits(spark, pages).collect()}
    assert got == {i: 149 if i < 149 else 152 if 150 <= i < 152 else None for i in range(220)}
