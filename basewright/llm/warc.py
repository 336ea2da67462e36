"""WARC archives with dictionary compression: each record is a Zstandard frame of its own.

A dictionary is trained once from a bounded sample of response records (``SAMPLE_RECORDS`` of them, chosen by a
hash of their id, at most ``SAMPLE_BYTES`` of each) and stands in a skippable frame before the records of each
file, so that a reader needs nothing else. Of pages with equal payloads, the one with the smallest id is kept
and the others refer to it; that choice needs digests only, and the texts move once, by page id.

Defined cases: null html is an empty payload; a null id is above all others; rows that repeat the smallest id
with the same payload are all responses; null or odd URLs are replaced by a page URN or escaped; no rows give no
files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import Workspace, partitions

#: The smallest payload for which a revisit record is written.
LEAST_REVISIT = 100
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 1500, 16 << 10, 64 << 10
FILE_BYTES = 256 << 20
DATE = "2000-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, payload_digest, refers_to of the pages that revisit another one, without repeated rows."""
    facts = pages.select("page_id", F.sha2("html", 256).alias("payload_digest")).where(F.octet_length("html") >= least)
    facts = facts.distinct()
    first = facts.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"))
    return facts.join(first, "payload_digest").where(F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    target = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._") if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
        f"WARC-X-Page-ID: {'' if page_id is None else page_id}", f"WARC-X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-X-Refers-To-Page-ID: {refers_to}"]
    block = http + payload if refers_to is None else http
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    return fields, rest[:size]


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; of too few or too even samples, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def as_dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    full = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)


def write_warc(pages: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Writes the archives and returns the manifest: file, records, bytes."""
    spark = pages.sparkSession
    pages = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    work = Workspace(spark, "", folder)
    revisits = work.save(record_types(pages), "revisits")
    share = F.lit(SAMPLE_RECORDS) / F.greatest(F.lit(pages.count()), F.lit(SAMPLE_RECORDS))
    few = pages.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1 << 20)) < share * (1 << 20))
    samples = few.select("page_id", "url", F.substring(F.col("html"), 1, SAMPLE_BYTES).alias("html")).orderBy(F.xxhash64("page_id", "url")).limit(2 * SAMPLE_RECORDS)
    rows = [(r.page_id, r.url, (r.html or "").encode()) for r in samples.collect()]
    dictionary = train_dictionary([build_record(i, u, h, hashlib.sha256(h).hexdigest(), None) for i, u, h in rows])

    whole = pages.select("page_id", "url", "html", F.sha2("html", 256).alias("payload_digest"))
    old = revisits.select(F.col("page_id").alias("old_id"), F.col("payload_digest").alias("old_digest"), "refers_to")
    known = whole.join(old.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("old_id")) & (F.col("payload_digest") == F.col("old_digest")), "left")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level, dict_data=as_dictionary(dictionary))
        part, files, out, n = TaskContext.get().partitionId(), [], None, 0

        def done() -> None:
            out.close()
            files.append((f"pages-{part:06d}-{len(files):03d}.warc.zst", n, out.size))

        for batch in source:
            ids, urls, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4))
            for page_id, url, payload, digest, to in zip(ids, urls, batch.column(2).cast(pa.binary()), digests, refers):
                if out is None:
                    out, n = storage.Output(folder, f"pages-{part:06d}-{len(files):03d}.warc.zst"), 0
                    out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
                out.write(compressor.compress(build_record(page_id, url, payload.as_py(), digest, to)))
                n += 1
                if out.size >= FILE_BYTES:
                    done()
                    out = None
        if out is not None:
            done()
        if files:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*files), (pa.string(), pa.int64(), pa.int64()))], ["file", "records", "bytes"])

    out = known.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "file string, records long, bytes long")
    return work.save(out, "manifest")


def read_frames(file, chunk: int = 1 << 14) -> Iterator[bytes]:
    """The records of an archive, one per frame."""
    magic, size = struct.unpack("<II", file.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    plain = zstandard.ZstdDecompressor(dict_data=as_dictionary(file.read(size)))
    left = b""
    while left or (left := file.read(chunk)):
        frame, parts = plain.decompressobj(), []
        while not frame.eof:
            if not left and not (left := file.read(chunk)):
                raise ValueError("the last record is cut off")
            parts.append(frame.decompress(left))
            left = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, html binary, file string"


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """One row per record; payloads of responses are checked against their digests. html is null for revisits."""
    names = [x.split()[0] for x in READ.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    keep = [k for k, n in enumerate(names) if payloads or n != "html"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table() -> pa.RecordBatch:
            columns = list(zip(*rows))
            return pa.record_batch([pa.array(columns[k], types[k]) for k in keep], [names[k] for k in keep])

        for batch in source:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with storage.reader(folder, name) as file:
                    for record in read_frames(file):
                        fields, block = parse_record(record)
                        kind, digest, payload = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:"), None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["WARC-X-Payload-Length"]):
                                raise ValueError(f"a payload of {name} differs from its digest")
                        number = lambda k: int(fields[k]) if fields.get(k) else None
                        rows.append((number("WARC-X-Page-ID"), number("WARC-X-Payload-Length"), digest, kind, number("WARC-X-Refers-To-Page-ID"), payload if payloads else None, name))
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield table()
                            rows, held = [], 0
                if rows:
                    yield table()

    files = spark.read.schema("file string, records long, bytes long").parquet(f"{folder}/manifest").select("file")
    schema = ", ".join(x for k, x in enumerate(READ.split(", ")) if k in keep)
    return files.repartition(partitions(spark), "file").mapInArrow(run, schema)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "warc").path
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, payloads=False).drop("file")


QUERIES = {"op2_warc": op2_warc}
SQL = {
    "op2_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest
""",
}
