"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Pages are dealt over archives; each task writes one archive to the shared folder and trains the archive's dictionary on its
first payloads. The reader loads the dictionary, decodes frame by frame and checks headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydromelt import session
from hydromelt.llm.common import table, utf8
from hydromelt.operators.joins import checked_broadcast

#: Payload bytes an archive is meant to hold.
ARCHIVE_BYTES = 16 << 20
#: First payload bytes of an archive that its dictionary is trained on, and the dictionary's size.
TRAIN_BYTES = 1 << 20
DICTIONARY_BYTES = 32 << 10
#: Most payloads with copies whose digests are sent to every task (some 10 MB); more are joined by a shuffle.
DUPLICATES = 100_000
#: Compressed bytes given to the decoder at once.
FEED = 16 << 10
#: Fixed values of the formats.
VERSION = b"WARC/1.1\r\n"
SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Own headers that carry the table's key.
PAGE, REFERS = "X-Page-Id", "X-Refers-To-Page-Id"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def clean(url: str) -> str:
    """A URL without what would break a header line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in [*headers, ("Content-Length", len(block))] if value is not None]
    return VERSION + "".join(lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: object,
                date: str = DATE) -> bytes:
    """A response record, or a revisit of ``refers_to``; a revisit's block keeps the HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    again = refers_to is not None
    return record([
        ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else clean(url)), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Profile", IDENTICAL if again else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if again else None), (PAGE, page_id), (REFERS, refers_to),
    ], http if again else http + payload)


def train(payloads: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary, or none if there is too little to learn from."""
    if len(payloads) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, payloads)) // 8), payloads, k=200, d=8)
    except zstandard.ZstdError:
        return None


def archive(rows: Iterator[tuple]) -> Iterator[bytes]:
    """The parts of one archive file: dictionary frame, warcinfo, then a frame per row of :func:`page_record`'s arguments."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"")
        if size >= TRAIN_BYTES:
            break
    dictionary = train([r[2][:64 << 10] for r in held if r[2]])
    if dictionary:
        packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
        yield struct.pack("<II", SKIPPABLE, len(packed)) + packed
    packer = zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=True, write_content_size=True)
    yield packer.compress(record([
        ("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", "")), ("WARC-Date", DATE),
        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
    for row in chain(held, rows):
        yield packer.compress(page_record(*row))


@dataclass(frozen=True)
class Record:
    """A checked record: its headers, and its payload if it has one."""

    headers: dict[str, str]
    payload: bytes | None
    payload_bytes: int
    digest: str


class BadArchive(ValueError):
    """An archive that doesn't hold what its headers say."""


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, after loading the dictionary of its leading skippable frame."""
    at, dictionary = 0, None
    while at < len(data):
        magic = int.from_bytes(data[at:at + 4], "little")
        if magic & 0xFFFFFFF0 == SKIPPABLE & 0xFFFFFFF0:
            size = int.from_bytes(data[at + 4:at + 8], "little")
            body = data[at + 8:at + 8 + size]
            if len(body) < size:
                raise BadArchive("the skippable frame is cut short")
            if at == 0 and magic == SKIPPABLE:
                if int.from_bytes(body[:4], "little") == FRAME:
                    body = zstandard.ZstdDecompressor().decompress(body)
                if int.from_bytes(body[:4], "little") != DICTIONARY:
                    raise BadArchive("the leading skippable frame holds no dictionary")
                dictionary = zstandard.ZstdCompressionDict(body)
            at += 8 + size
            continue
        decoder = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj()
        parts = []
        try:
            while not decoder.eof:
                if at >= len(data):
                    raise BadArchive("the last frame is cut short")
                parts.append(decoder.decompress(data[at:at + FEED]))
                at += len(data[at:at + FEED]) - len(decoder.unused_data)
        except zstandard.ZstdError as error:
            raise BadArchive(f"a frame at or before byte {at} can't be decoded: {error}") from error
        yield b"".join(parts)


def parse(frame: bytes) -> Record:
    """The one record of a frame, with its headers, lengths and digest checked."""
    head, gap, rest = frame.partition(b"\r\n\r\n")
    if not gap or not frame.startswith(VERSION):
        raise BadArchive("a frame doesn't start with a WARC header")
    headers = {}
    for line in head[len(VERSION):].decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or name in headers:
            raise BadArchive(f"bad header line {line!r}")
        headers[name] = value.strip()
    if missing := [name for name in NEEDED if name not in headers]:
        raise BadArchive(f"headers are missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"the block of {headers['WARC-Record-ID']} isn't as long as its header says")
    block, kind = rest[:-4], headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return Record(headers, None, len(block), "")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:")
    if not gap or not length or not digest:
        raise BadArchive(f"{headers['WARC-Record-ID']} has no HTTP headers or no payload digest")
    if kind == "response" and (len(payload) != int(length[1]) or base32_sha1(payload) != digest):
        raise BadArchive(f"the payload of {headers['WARC-Record-ID']} isn't what its headers say")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise BadArchive(f"the revisit {headers['WARC-Record-ID']} has a payload or refers to nothing")
    return Record(headers, payload if kind == "response" else None, int(length[1]), digest)


def write(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html") -> DataFrame:
    """Writes all rows as archives below ``folder``, which all executors can reach; returns path, records, bytes per archive.

    Of equal payloads of at least ``least_bytes`` bytes the one with the smallest id becomes the response, the others revisit
    it; rows that repeat that id are responses too. Null payloads are empty, null URLs and ids are left out of the headers;
    a row with a null id only revisits others that have one. An empty table writes nothing.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), utf8(payload_col).alias("payload")).withColumn(
        "sha1", F.sha1("payload"))
    narrow = session.stage(rows.select("page_id", "sha1", F.octet_length("payload").cast("long").alias("size")), "payloads")
    total = narrow.agg(F.sum("size")).first()[0] or 0
    first = narrow.where(F.col("size") >= least_bytes).groupBy("sha1").agg(
        F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    # Ids pass through headers as text; a copy is told by being unequal to the first id.
    marked = rows.join(checked_broadcast(first, DUPLICATES), "sha1", "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).withColumn(
        "size", F.octet_length("payload").cast("long")).withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")))
    archives = max(1, -(-total // ARCHIVE_BYTES))
    dealt = marked.select("page_id", "url", "payload", "size", "sha1", "refers_to").repartition(
        archives, F.xxhash64("page_id", "url", "sha1")).sortWithinPartitions("page_id", "url", "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((*row[:4], base64.b32encode(bytes.fromhex(row[4])).decode(), row[5]) for batch in batches for row in zip(
            *(c.to_pylist() for c in batch.columns), strict=True))
        one = next(rows, None)
        if one is None:
            return
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root)
        # A repeated attempt writes the same bytes; the last rename wins.
        name, attempt = f"part-{TaskContext.get().partitionId():06d}.warc.zst", TaskContext.get().taskAttemptId()
        size = count = 0
        with store.open_output_stream(f"{root}/.{name}.{attempt}") as out:
            for part in archive(chain([one], rows)):
                out.write(part)
                size += len(part)
                count += 1
        store.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64())], ["path", "bytes"])

    return session.stage(dealt.mapInArrow(run, "path string, bytes long"), "archives")


def read(spark: SparkSession, folder: str, id_type: str = "long", with_payload: bool = False) -> DataFrame:
    """One row per response or revisit record below ``folder``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and the payload if asked for. A record that breaks a check fails the read with its archive's name.

    Null ids and URLs come back as null, null payloads as empty ones; very long payloads are decoded one by one. Repeated records come
    back each, other record types don't, and a folder without archives gives no rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for frame in frames(content):
                r = parse(frame)
                if r.digest:
                    found = (r.headers.get(PAGE), r.headers.get("WARC-Target-URI"), r.payload_bytes, r.digest,
                             r.headers["WARC-Type"], r.headers.get(REFERS))
                    yield (*found, r.payload) if with_payload else found
        except BadArchive as error:
            raise BadArchive(f"{path}: {error}") from error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.binary()] * with_payload]
        for batch in batches:
            for i in range(batch.num_rows):
                held = list(rows(batch.column("path")[i].as_py(), batch.column("content")[i].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row[k] for row in held], kind) for k, kind in enumerate(kinds)], names)

    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    return files.mapInArrow(run, schema + ", payload binary" * with_payload).withColumns(
        {c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op3_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives and read back."""
    pages = table(spark, sf_dir, "pages")
    folder = f"{session.scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    if not write(pages, folder).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH hashed AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
firsts AS (SELECT hex, min(page_id) AS first_id FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0], lambda s:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, k * 5 + 1, 5))::BIGINT >> s) & 31) + 1, 1)), '')), '')
         AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed JOIN firsts USING (hex)
"""
