import random
import struct
import zlib

import pytest

from basewright.functions import packing
from basewright.sources import container, ranges
from basewright.sources.framing import Bytes, container_records


def head(n):
    return b"FAST\x02\x00\x00\x00" + struct.pack("<I", n)


def odd_record(rng, *blocks):
    """A record in another order of blocks, with some that readers skip."""
    body = b"".join(struct.pack("<BI", kind, n) + data for kind, n, data in blocks)
    return body + struct.pack("<I", zlib.crc32(body))


def file_of(rng, n, planted=0.0, odd=0.0, large=0):
    """Bytes of a file and its records; planted: records inside of descriptions and notes."""
    parts = []
    for i in range(n):
        sequence = "".join(rng.choices("ACGT", k=rng.choice([0, 3, 40, 200])))
        inner = b"".join(packing.record(f"inner {k}", "ACGT" * rng.randint(0, 9), "DNA") for k in range(rng.randint(1, 5)))
        if rng.random() < odd:
            parts.append(odd_record(rng, (4, 3, b"abc"), (6, 4, b"\x27"), (2, 1, b"R"), (1, 1, b"o")))
        elif rng.random() < planted:  # a note of whole records
            parts.append(odd_record(rng, (1, 2, b"ab"), (2, 1, b"D"), (6, 4, b"\x27"), (4, len(inner), inner)))
        else:
            parts.append(packing.record(f"d{i}", sequence, "DNA"))
    if large:
        at = rng.randrange(n)
        inner = b"".join(packing.record(f"inner {k}", "ACGTACGT", "DNA") for k in range(large // 40))
        parts[at] = odd_record(rng, (1, 3, b"big"), (2, 1, b"D"), (4, len(inner), inner), (6, 4, b"\x27"))
    return head(len(parts)) + b"".join(parts)


def rows_of(spark, path, span, mode="PERMISSIVE"):
    return sorted((tuple(r) for r in container.read_records(spark, path, mode, span=span).select("rec_no", "description", "sequence", "nuc", *["error"] * (mode == "PERMISSIVE")).collect()), key=str)


def same(spark, path, spans):
    want = rows_of(spark, path, 1 << 30)
    for span in spans:
        assert rows_of(spark, path, span) == want, span
    return want


@pytest.mark.parametrize("shape", [{}, {"planted": 0.5}, {"odd": 0.3}, {"planted": 0.3, "odd": 0.2, "large": 3000}, {"large": 6000}])
def test_ranges_equal_the_scan_from_front_to_back(spark, tmp_path, shape):
    rng = random.Random(str(shape))
    (tmp_path / "x.seqs").write_bytes(data := file_of(rng, 120, **shape))
    want = same(spark, f"{tmp_path}/x.seqs", (500, 2000))
    assert len(want) == 120 and all(r[4] is None for r in want)
    assert len(list(container_records(Bytes(open(tmp_path / "x.seqs", "rb"))))) == 120 and len(data) > 4000


def test_payloads_that_hold_records_to_the_end(spark, tmp_path, monkeypatch):
    """Every range begins with a lie, so that the rest is followed in one piece."""
    rng = random.Random(3)
    inner = b"".join(packing.record(f"inner {k}", "ACGTACGT", "DNA") for k in range(100))
    one = odd_record(rng, (1, 1, b"a"), (2, 1, b"D"), (6, 4, b"\x27"), (4, len(inner), inner))
    (tmp_path / "x.seqs").write_bytes(head(9) + one * 9)
    assert len(same(spark, f"{tmp_path}/x.seqs", (900,))) == 9


def test_broken_files_equal_the_scan_from_front_to_back(spark, tmp_path):
    rng = random.Random(4)
    data = file_of(rng, 60, planted=0.2)
    shapes = {
        "cut": data[:-9], "half": data[: len(data) // 2], "flipped": data[:3000] + bytes([data[3000] ^ 1]) + data[3001:], "rest": data + b"junk" * 300, "more listed": head(61) + data[12:],
        "fewer listed": head(20) + data[12:], "none listed": head(0) + data[12:], "rest of records": head(60) + data[12:] + data[12:], "flipped early": data[:20] + b"\xff" + data[21:],
        "version": data[:4] + b"\x03" + data[5:], "head only": head(3), "cut head": data[:7],
    }
    for name, content in shapes.items():
        (tmp_path / "x.seqs").write_bytes(content)
        same(spark, f"{tmp_path}/x.seqs", (700,))
        if name == "flipped":
            with pytest.raises(Exception, match="record"):
                rows_of(spark, f"{tmp_path}/x.seqs", 700, "FAILFAST")


def test_likely_starts():
    record = packing.record("name", "ACGT", "DNA")
    assert ranges.likely_starts(b"\x01\x01\x01" + record * 3) == [3 + k * len(record) for k in range(3)]
    assert ranges.likely_starts(b"") == ranges.likely_starts(record[:8]) == []


@pytest.mark.parametrize("version", [1, 2])
def test_one_file_is_read_by_blocks_in_many_tasks(spark, tmp_path, version):
    rows = [("f", i, f"d{i}", "ACGTN" * (i % 50) + "A" * (i % 2), "DNA") for i in range(1, 1500)]
    df = spark.createDataFrame(rows, "file string, rec_no long, description string, sequence string, nuc string")
    container.write_records(df, f"{tmp_path}/out", version, files=1, block=2000)
    raw = container.read_raw(spark, f"{tmp_path}/out", span=8000)
    assert raw.rdd.getNumPartitions() >= 8
    tasks = raw.selectExpr("spark_partition_id() AS task").groupBy("task").count().collect()
    assert len(tasks) >= 8
    got = container.read_records(spark, f"{tmp_path}/out", span=8000).collect()
    assert sorted((r.rec_no, r.description, r.sequence) for r in got) == [r[1:4] for r in rows]
    # a file that was changed afterwards no longer fits its index, and is searched or read from the front
    file = next((tmp_path / "out").rglob("*.seqs"))
    file.write_bytes(file.read_bytes()[:-30])
    got = container.read_records(spark, f"{tmp_path}/out", "PERMISSIVE", span=8000).collect()
    assert sum(r.error is not None for r in got) == 1 and len(got) > 1400


def test_legacy_scan_is_linear():
    import io
    import time

    from basewright.sources.framing import legacy_records

    def seconds(n):
        began = time.perf_counter()
        assert sum(1 for _ in legacy_records(Bytes(io.BytesIO(bytes.fromhex("7231" + "0F0" + "4821" * 24 + "00F") * n)))) == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 16 * seconds(5_000) + 0.1
