import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.functions import codes, packing
from basewright.operators import chunk_scan, chunks, convert
from basewright.sources import container

LETTERS = ("ACGT", "ACGU", "ACGTacgt", "ACGTNRacgtn-", "acgun")
FRAME = "file string, rec_no long, description string, sequence string, nuc string"


def sequences(rng, n):
    return ["".join(rng.choices(rng.choice(LETTERS), k=rng.choice([0, 1, 7, 8, 9, 16, 30, 200, 900]))) for _ in range(n)]


def frame(spark, seed, n=70):
    rows = [(f"f{k % 3}", k, f"d{k} é" if k % 7 else "", s, "RNA" if k % 5 == 0 else "DNA") for k, s in enumerate(sequences(random.Random(seed), n))]
    return spark.createDataFrame(rows, FRAME)


def joined(rows, size):
    """Records of chunks, which have to lie end to end."""
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.rec_no, r.chunk_no)):
        name, nuc, have = out.get((r.file, r.rec_no), (r.description, r.nuc, b""))
        assert len(have) == r.start == r.chunk_no * size and len(r.data) == r.n <= size
        assert nuc == r.nuc and (r.description is not None) == (r.chunk_no == 0)
        out[r.file, r.rec_no] = name, nuc, have + bytes(r.data)
    return {k: (name, have.decode(), nuc) for k, (name, nuc, have) in out.items()}


def whole(rows):
    return {(r.file, r.rec_no): (r.description, r.sequence, r.nuc) for r in rows.collect()}


def block(kind, body, length=None):
    return struct.pack("<BI", kind, len(body) if length is None else length) + body


def record(description, sequence, enc, runs=(), tag=b"D", runs_first=False):
    """A record with any runs, as other writers may leave them."""
    code = block(codes.BLOCK_OF[enc], packing.packed(np.frombuffer(sequence.encode(), np.uint8), enc), len(sequence))
    masks = block(codes.BLOCK_RUNS, b"".join(struct.pack("<II", *r) for r in runs))
    body = block(codes.BLOCK_DESCRIPTION, description.encode()) + block(codes.BLOCK_TYPE, tag) + (masks + code if runs_first else code + masks)
    return body + struct.pack("<I", zlib.crc32(body))


def written(path, records, listed=None):
    path.write_bytes(codes.MAGIC + bytes([codes.VERSION, 0, 0, 0]) + struct.pack("<I", len(records) if listed is None else listed) + b"".join(records))


@pytest.mark.parametrize("size", [8, 24, 64, 1024])
@pytest.mark.parametrize("runs", [1, 3, 1 << 16])
def test_chunks_equal_whole_records(spark, tmp_path, size, runs):
    container.write_records(frame(spark, size), str(tmp_path), files=2, block=1000)
    want = whole(container.read_records(spark, str(tmp_path)))
    got = joined(chunk_scan.read_chunks(spark, str(tmp_path), size, span=3000, runs=runs), size)
    assert got == want and len(got) == 70


def test_legacy_and_files_without_index(spark, tmp_path):
    container.write_records(frame(spark, 5).withColumn("sequence", F.regexp_replace("sequence", "-", "")), f"{tmp_path}/old", version=1)
    container.write_records(frame(spark, 6, 300), f"{tmp_path}/new", files=1)
    (attempt,) = (tmp_path / "new").glob("attempt-*")
    for path in (f"{tmp_path}/old", f"{attempt}/*.seqs"):
        want = whole(container.read_records(spark, path))
        assert joined(chunk_scan.read_chunks(spark, path, 16, span=5000), 16) == want and want


def test_runs_of_others(spark, tmp_path):
    """Runs out of order, over each other, empty, past the end, before the code; of records below and above a chunk."""
    rng, records, want = random.Random(3), [], []
    for k in range(60):
        n = rng.choice([0, 5, 16, 100, 700])
        text = "".join(rng.choices("ACGTNRY-", k=n))
        runs = [(rng.randint(0, n + 5), rng.choice([0, 1, 3, 40, 4_000_000_000])) for _ in range(rng.choice([0, 1, 4, 90]))]
        records.append(record(f"r{k}", text, "4b", runs, runs_first=k % 2 == 1))
        low = {p for a, length in runs for p in range(a, min(n, a + length))}
        want.append("".join(c.lower() if p in low else c for p, c in enumerate(text)))
    # runs of encodings that have none are left aside
    records += [record("two", "ACGT" * 30, "2b", [(0, 9)]), record("three", "ACgt" * 30, "3b", [(0, 9)])]
    want += ["ACGT" * 30, "ACgt" * 30]
    written(tmp_path / "x.seqs", records)
    plain = whole(container.read_records(spark, f"{tmp_path}/x.seqs"))
    assert [plain[k][1] for k in sorted(plain)] == want
    for runs in (1, 7, 1000):
        got = joined(chunk_scan.read_chunks(spark, f"{tmp_path}/x.seqs", 16, runs=runs), 16)
        assert [got[k][1] for k in sorted(got)] == want


def test_blocks_above_the_limit_are_checked_but_not_kept(tmp_path):
    from basewright.sources.framing import Broken, Bytes, placed_record

    data = record("long", "ACGTN" * 20_000, "4b", [(k, 1) for k in range(0, 90_000, 3)])
    (tmp_path / "r").write_bytes(data)
    with open(tmp_path / "r", "rb") as stream:
        _, _, enc, n, payload, code_at, runs, runs_at, runs_size = placed_record(Bytes(stream), 1000)
    assert (enc, n, payload, runs, runs_size) == ("4b", 100_000, None, None, 240_000)
    assert data[code_at : code_at + 50_000] == packing.packed(np.frombuffer(b"ACGTN" * 20_000, np.uint8), "4b") and data[runs_at + 8 : runs_at + 16] == struct.pack("<II", 3, 1)
    for k in (code_at + 7, runs_at + 7):
        (tmp_path / "r").write_bytes(data[:k] + bytes([data[k] ^ 1]) + data[k + 1 :])
        with open(tmp_path / "r", "rb") as stream, pytest.raises(Broken):
            placed_record(Bytes(stream), 1000)


def test_errors(spark, tmp_path):
    good = [record(f"r{k}", "ACGT" * 20, "2b") for k in range(3)]
    broken = good[2][:-9] + bytes([good[2][-9] ^ 1]) + good[2][-8:]
    written(tmp_path / "a.seqs", [*good[:2], broken])
    written(tmp_path / "b.seqs", good)
    path = str(tmp_path)
    with pytest.raises(Exception, match="a.seqs, record 3"):
        chunk_scan.read_chunks(spark, path, 16).count()
    kept = joined(chunk_scan.read_chunks(spark, path, 16, mode="DROPMALFORMED"), 16)
    assert len(kept) == 5 and {v[1] for v in kept.values()} == {"ACGT" * 20}
    rows = chunk_scan.read_chunks(spark, path, 16, mode="PERMISSIVE")
    assert joined(rows.where("error is null"), 16) == kept
    (bad,) = rows.where("error is not null").collect()
    assert bad.file.endswith("a.seqs") and bad.rec_no == 3 and bad.data is None
    for wrong in (12, 0):
        with pytest.raises(ValueError):
            chunk_scan.read_chunks(spark, path, wrong)
    with pytest.raises(ValueError):
        chunk_scan.read_chunks(spark, path, 16, mode="other")


def test_chunks_are_written_as_they_were_read(spark, tmp_path):
    """Types stay, also where no letter shows them."""
    container.write_records(frame(spark, 8), f"{tmp_path}/a", files=2)
    rows = chunk_scan.read_chunks(spark, f"{tmp_path}/a", 32)
    chunks.write_chunks(rows, f"{tmp_path}/b", files=3)
    values = lambda path: sorted(whole(container.read_records(spark, path)).values())
    assert values(f"{tmp_path}/b") == values(f"{tmp_path}/a")


def test_long_conversion_reports_like_the_plain_one(spark, tmp_path):
    rng = random.Random(2)
    records = [(f"r{k}", s + ("TU" if k % 9 == 0 else "")) for k, s in enumerate(sequences(rng, 60))]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.fasta").write_text("".join(f">{name}\n{text}\n" for name, text in records))
    plain = convert.convert_fasta(spark, f"{tmp_path}/in", f"{tmp_path}/plain")
    long = convert.convert_long(spark, f"{tmp_path}/in", f"{tmp_path}/long", size=64)
    assert long.mixed == plain.mixed > 0
    assert long.summary.collect() == plain.summary.collect() and long.summary.first()["mismatches"] > 0
    rows = lambda done: sorted(map(tuple, done.details.drop("index").collect()), key=str)
    assert rows(long) == rows(plain)
    back = [container.read_records(spark, f"{tmp_path}/{name}").select("description", "sequence", "nuc") for name in ("long", "plain")]
    assert sorted(back[0].collect()) == sorted(back[1].collect())
    with pytest.raises(ValueError):
        convert.convert_long(spark, f"{tmp_path}/in", f"{tmp_path}/in")
    assert (tmp_path / "in/x.fasta").exists()
