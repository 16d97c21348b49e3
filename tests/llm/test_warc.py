import hashlib
import io
import zlib

import pytest

from glyphmill.llm import warc


def read_back(spark, rows, **options):
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return warc.read_archives(warc.write_archives(pages, **options), payloads=True).collect()


def test_round_trip(spark):
    long = "é" * 60
    rows = [(5, "http://a/b c", long), (3, "http://x", long), (9, None, "short"), (8, "u", "short"), (1, "u", None), (None, "n", "")]
    rows += [(2, "", long), (2, "", long), (7, "big", "ab\r\n\r\n" * 300_000)]
    found = read_back(spark, rows)
    assert all(r.status == "ok" for r in found) and len(found) == len(rows)
    by = {(r.page_id, r.record_type): r for r in found}
    for key, _, html in rows:
        data = (html or "").encode()
        row = next(r for r in found if r.page_id == key and r.payload_digest == hashlib.sha256(data).hexdigest())
        assert row.payload_bytes == len(data)
        if row.record_type == "response":
            assert bytes(row.payload) == data
    assert by[2, "response"].refers_to is None and sum(r.page_id == 2 and r.record_type == "response" for r in found) == 2
    assert by[3, "revisit"].refers_to == by[5, "revisit"].refers_to == 2 and by[3, "revisit"].payload is None
    assert {r.record_type for r in found if r.page_id in (8, 9, 1, None, 7)} == {"response"}


def test_archives_roll_over(spark):
    rows = [(k, "u", f"{k}" * 200) for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, limit=2000)
    assert manifest.count() > 3 and {r.records for r in manifest.collect()} != {1}
    assert sorted(r.page_id for r in warc.read_archives(manifest).collect()) == list(range(40))


def test_empty_table(spark):
    assert read_back(spark, []) == []


def record(key=1, payload=b"x" * 200, first=None):
    return warc.record_bytes(key, "u", payload, hashlib.sha256(payload).hexdigest(), first)


def member(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_members_are_read_in_blocks_of_any_size(monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK_BYTES", block)
    data = b"".join(member(record(k)) for k in range(5))
    assert [r["page_id"] for r in warc.records_in(data)] == list(range(5))


def test_damage_is_reported():
    good = record()
    assert warc.records_in(member(good)[:-9])[-1]["status"] == "truncated"
    assert warc.records_in(member(good) + b"junk")[-1]["status"] == "undecodable"
    assert warc.records_in(member(b"no record"))[0]["status"] == "malformed"
    assert warc.records_in(member(good.replace(b"xxxx", b"xxxy", 1)))[0]["status"] == "bad-block-digest"
    assert warc.records_in(member(good[:-20] + good[-4:]))[0]["status"] == "bad-length"
    digest = hashlib.sha256(b"x" * 200).hexdigest().encode()
    assert warc.records_in(member(good.replace(b"Payload-Digest: sha256:" + digest, b"Payload-Digest: sha256:" + b"0" * 64)))[0]["status"] == "bad-payload-digest"
    assert warc.records_in(b"") == [] and list(warc.members(io.BytesIO(b""))) == []
