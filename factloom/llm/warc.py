"""WARC archives with a Zstandard dictionary: a bounded sample of the records trains a dictionary, which leads each
archive in a skippable frame; each record is a frame of its own, compressed with it.

An archive is a row of a binary column (bounded in size, see ARCHIVE_BYTES), which Spark's own writers commit and any
store takes; ``archive_files`` writes such rows as files.

Records with equal payloads of at least MIN_REVISIT bytes: the one with the largest page_id is a response, others are
revisits of it; smaller ones are all responses. Equality is that of length, SHA-1 and xxHash64 together.

Edge cases: a null payload counts as empty; repeated rows of one page_id are written each, and are responses all where
that page_id is the largest; a null page_id is least, and is a response where no other has the payload; an empty table
makes no archive; a payload larger than an archive's bound has an archive to itself; further columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 1000
#: Uncompressed bytes of records in an archive.
ARCHIVE_BYTES = 8 << 20
#: The sample for the dictionary: this many records, those of the least hash, and the leading bytes of each.
SAMPLE_RECORDS, SAMPLE_BYTES, DICT_BYTES = 400, 16_384, 65_536
SKIPPABLE = 0x184D2A5D
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url or "urn:none"),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Of one record: its headers by lower-case name, its kind, and its payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    out: dict = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    n = int(out["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of another length")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    out["http_length"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    out["payload"] = payload if out["warc-type"] == "response" else None
    return out


def train(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary, or nothing where the samples are too few or too small to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def write_archive(records: list[bytes], dictionary: bytes) -> bytes:
    lead = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True)
    return lead + b"".join(map(pack.compress, records))


def read_archive(raw: bytes) -> Iterator[bytes]:
    """The records, in order."""
    at, dictionary = 0, None
    if raw[:4] == struct.pack("<I", SKIPPABLE):
        (n,) = struct.unpack_from("<I", raw, 4)
        dictionary, at = zstandard.ZstdCompressionDict(raw[8 : 8 + n]), 8 + n
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view = memoryview(raw)
    while at < len(raw):
        frame = unpack.decompressobj()
        out, end = [], at
        while not frame.eof:
            step = view[end : end + (1 << 16)]
            if not step:
                raise ValueError("the archive ends within a record")
            out.append(frame.decompress(step))
            end += len(step)
        at = end - len(frame.unused_data)
        yield b"".join(out)


def payloads(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """page_id, url, payload (binary), its length n, digest (SHA-1) and other (xxHash64)."""
    payload = F.encode(F.coalesce(pages[payload_col], F.lit("")), "UTF-8")
    p = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), payload.alias("payload"))
    return p.withColumns({"digest": F.sha1("payload"), "n": F.length("payload").cast("long"), "other": F.xxhash64("payload")})


def with_kinds(p: DataFrame) -> DataFrame:
    """payloads() with refers_to (null for responses). To find the copies only digests are shuffled, reduced on the map
    side; the payloads are shuffled once, by a join whose large partitions Spark can split."""
    groups = (
        p.filter(F.col("n") >= MIN_REVISIT)
        .groupBy("digest", "n", "other")
        .agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .drop("copies")
    )
    return p.join(groups, ["digest", "n", "other"], "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to")
    )


def dictionary_of(p: DataFrame) -> bytes:
    """Trained on a bounded sample: at most SAMPLE_RECORDS records of at most SAMPLE_BYTES each. They are chosen by page_id and
    url, and only theirs are read and sent."""
    chosen = p.select("page_id", "url").distinct().orderBy(F.xxhash64("page_id", "url"), "page_id", "url").limit(SAMPLE_RECORDS)
    c = F.broadcast(chosen.select(F.col("page_id").alias("chosen_id"), F.col("url").alias("chosen_url")))  # SAMPLE_RECORDS rows
    some = p.join(c, p["page_id"].eqNullSafe(c["chosen_id"]) & p["url"].eqNullSafe(c["chosen_url"]), "left_semi")
    one = F.struct("digest", F.substring("payload", 1, SAMPLE_BYTES).alias("lead"))
    some = some.groupBy("page_id", "url").agg(F.min(one).alias("one")).orderBy("page_id", "url")  # of rows of one page_id and url, one
    return train([record(r.page_id, r.url, bytes(r.one.lead), r.one.digest, "response", None) for r in some.collect()])


def archives(records: DataFrame, dictionary: bytes) -> DataFrame:
    """archive (binary), one row for each archive; a task begins another when ARCHIVE_BYTES are reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in common.pieces(batches, "payload"):
            for r in batch.to_pylist():
                kind = "response" if r["refers_to"] is None else "revisit"
                x = record(r["page_id"], r["url"], r["payload"], r["digest"], kind, r["refers_to"])
                if held and size + len(x) > ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.binary())], ["archive"])
                    held, size = [], 0
                held.append(x)
                size += len(x)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_archive(held, dictionary)], pa.binary())], ["archive"])

    return records.mapInArrow(run, "archive binary")


def read_back(archived: DataFrame) -> DataFrame:
    """What the archives say of each record. A response's digest and length are those of the payload that was read."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names, kinds = [x.split()[0] for x in schema.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def one(raw: bytes) -> tuple:
        x = parse(raw)
        page, refers = x["x-page-id"], x.get("x-refers-to-page-id")
        said = base64.b32decode(x["warc-payload-digest"].removeprefix("sha1:")).hex()
        if x["payload"] is not None and (hashlib.sha1(x["payload"]).hexdigest() != said or len(x["payload"]) != x["http_length"]):
            raise ValueError(f"page {page}: the payload isn't what was written")
        return int(page) if page else None, x["http_length"], said, x["warc-type"], int(refers) if refers else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("archive"):
                got = zip(*map(one, read_archive(raw.as_py())), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(got, kinds, strict=True)], names)

    return archived.mapInArrow(run, schema)


def archive_files(archived: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file in a folder that every executor reaches by this URI; returns name and bytes.
    A file's name comes from its content, and it is renamed into place when complete, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        for batch in batches:
            for raw in batch.column("archive").to_pylist():
                name = f"{hashlib.sha256(raw).hexdigest()[:32]}.warc.zst"
                with store.open_output_stream(part := f"{base}/.{name}.{uuid.uuid4().hex}") as out:
                    out.write(raw)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(raw)], pa.int64())], ["name", "bytes"])

    return archived.mapInArrow(run, "name string, bytes long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = payloads(common.table(spark, sf_dir, "pages"))
    return read_back(common.materialize(archives(with_kinds(p), dictionary_of(p))))


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_bytes, payload_digest, max(page_id) AS latest FROM d WHERE payload_bytes >= 1000 GROUP BY ALL)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN g.latest IS NULL OR g.latest = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.latest <> d.page_id THEN g.latest END AS refers_to
FROM d LEFT JOIN g ON g.payload_bytes = d.payload_bytes AND g.payload_digest = d.payload_digest
"""
