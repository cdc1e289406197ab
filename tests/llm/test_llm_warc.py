import hashlib
import struct
import uuid

import pytest
import zstandard

from hydromelt import session
from hydromelt.llm import warc

SCHEMA = "page_id long, url string, html string, payload string, sha1 string, size string"


def folder(spark):
    return f"{session.scratch_root(spark)}/warc-test-{uuid.uuid4().hex}"


def pages(spark, rows):
    return spark.createDataFrame([(*row, "x", "x", "x") for row in rows], SCHEMA).repartition(3)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    rows = [(i, f"http://h/{i}?a=b c\r\nX: y", f"<p>{i % 40} é</p>" * (i % 50)) for i in range(400)]
    rows += [(500, None, None), (501, "u", ""), (None, "u", rows[7][2]), (None, None, "only here"), (3, "twice", rows[3][2]), (600, "big", "z" * 300_000)]
    where = folder(spark)
    assert warc.write(pages(spark, rows), where).count() > 3
    back = warc.read(spark, where, with_payload=True).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = sorted(((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()),
                    "response" if first.get(h or "") == i else "revisit", None if first.get(h or "") == i else first[h or ""])
                   for i, _, h in rows), key=key)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=key)
    assert got == want
    texts = {i: h or "" for i, _, h in rows if i is not None}
    for r in back:
        if r["record_type"] == "response" and r["page_id"] is not None:
            assert bytes(r["payload"]).decode() == texts[r["page_id"]]
        else:
            assert r["payload"] is None or r["page_id"] is None


def test_small_payloads_are_not_revisits(spark):
    where = folder(spark)
    warc.write(pages(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")]), where, least_bytes=5)
    assert {r["page_id"]: r["refers_to"] for r in warc.read(spark, where).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_no_pages(spark, tmp_path):
    pages(spark, []).write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op3_warc_zstd(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def archive():
    payloads = [f"<p>some page number {i} with words</p>".encode() * 20 for i in range(200)]
    return b"".join(warc.archive(iter([(i, "u", p, len(p), warc.base32_sha1(p), None) for i, p in enumerate(payloads)])))


def test_layout(archive):
    magic, size = struct.unpack("<II", archive[:8])
    assert magic == warc.SKIPPABLE
    dictionary = zstandard.ZstdDecompressor().decompress(archive[8:8 + size])
    assert int.from_bytes(dictionary[:4], "little") == warc.DICTIONARY
    records = [warc.parse(f) for f in warc.frames(archive)]
    assert [r.headers["WARC-Type"] for r in records] == ["warcinfo", *["response"] * 200]
    # A dictionary stored plain is read too.
    plain = struct.pack("<II", warc.SKIPPABLE, len(dictionary)) + dictionary + archive[8 + size:]
    assert list(warc.frames(plain)) == list(warc.frames(archive))


def test_faults_are_found(archive):
    body = warc.page_record(1, "u", b"payload", 7, warc.base32_sha1(b"payload"), None)
    for bad in (body[:-1], body + b"x", body.replace(b"payload", b"pAyload"), body.replace(b"WARC/1.1", b"WARC/9.9"),
                body.replace(b"WARC-Date: ", b"X-Date: "), body.replace(b"Content-Length: 7", b"Content-Length: 8")):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    for bad in (archive[:-3], archive[:20], archive[:5000] + b"\0\0\0\0" + archive[5004:], b"\x5d" + archive[1:8] + b"\0" * 4 + archive[12:]):
        with pytest.raises(warc.BadArchive):
            for frame in warc.frames(bad):
                warc.parse(frame)
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")
