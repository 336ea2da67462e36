import hashlib
import struct

import pytest
import zstandard

from basewright.llm import storage, warc

SCHEMA = "page_id long, url string, html string, refers_to string"


def expected(rows):
    facts = [(i, (h or "").encode()) for i, _, h, _ in rows]
    out = []
    for i, data in facts:
        same = [k for k, d in facts if d == data and k is not None]
        to = min(same) if len(data) >= warc.LEAST_REVISIT and same and min(same) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_archives_round_trip(spark, tmp_path):
    body = lambda k: f"<html><body>{'häuser ' * (k % 40)}{k}\r\n\r\nWARC/1.1</body></html>"
    rows = [(k, f"http://x/{k}?q=ü \r\n", body(k % 37), "x") for k in range(300)]
    rows += [(400, None, None, None), (401, "", "", None), (402, "u", "short", ""), (403, "u", "short", ""), (None, "u", body(5), ""), (None, "u", "only" * 50, ""), (5, "u", body(5), ""), (500, "long", "y" * 3_000_000, "")]
    folder = f"file://{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder)
    got = warc.read_warc(spark, folder).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == expected(rows)
    whole = {(i, hashlib.sha256((h or "").encode()).hexdigest()): (h or "").encode() for i, _, h, _ in rows}
    assert all(bytes(r.html) == whole[r.page_id, r.payload_digest] for r in got if r.record_type == "response")
    assert all(r.html is None for r in got if r.record_type == "revisit")


def test_each_record_is_a_frame_after_the_dictionary(spark, tmp_path):
    folder = f"file://{tmp_path}/one"
    rows = [(k, f"http://h/{k}", f"<p>{k} some repeated words of a page {k * 7}</p>" * 9, "") for k in range(200)]
    manifest = warc.write_warc(spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert sum(r.records for r in manifest) == 200
    data = storage.reader(folder, manifest[0].file).read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = plain.decompressobj().decompress(data[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and first.count(b"WARC-Record-ID") == 1
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(data[8 + size :])


def test_no_pages(spark, tmp_path):
    folder = f"file://{tmp_path}/none"
    warc.write_warc(spark.createDataFrame([], SCHEMA), folder)
    assert warc.read_warc(spark, folder).count() == 0
