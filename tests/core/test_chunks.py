import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from basewright.functions import packing
from basewright.operators import chunks
from basewright.sources import container, fasta

LETTERS = ("ACGT", "ACGU", "ACGTacgt", "ACGTNRacgtn-", "acgun")


def sequences(rng, n):
    return ["".join(rng.choices(rng.choice(LETTERS), k=rng.choice([0, 1, 2, 5, 9, 30, 200]))) for _ in range(n)]


def bytes_of(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.file, r.rec_no, r.place)):
        assert len(out.get((r.file, r.rec_no), b"")) == r.place
        out[r.file, r.rec_no] = out.get((r.file, r.rec_no), b"") + bytes(r.bytes)
    return out


def test_checksums_of_parts_make_that_of_the_whole():
    rng = random.Random(1)
    for _ in range(300):
        data = rng.randbytes(rng.randint(0, 400))
        cuts = sorted(rng.randint(0, len(data)) for _ in range(rng.randint(0, 6)))
        pieces = [(a, data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)])]
        rng.shuffle(pieces)
        share = chunks.shifted(np.array([zlib.crc32(p) for _, p in pieces]), np.array([len(data) - a - len(p) for a, p in pieces]))
        assert int(np.bitwise_xor.reduce(share)) == zlib.crc32(data)
    # gigabytes of zeros after a part, by squaring
    a, n = zlib.crc32(b"abc"), 3 << 20
    assert int(chunks.shifted(np.array([a]), np.array([n]))[0]) ^ zlib.crc32(bytes(n)) == zlib.crc32(b"abc" + bytes(n))


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_records_of_chunks_equal_whole_records(spark, size):
    rng = random.Random(size)
    rows = [(f"f{k % 3}", k, f"d{k} é" if k % 7 else "", s) for k, s in enumerate(sequences(rng, 60))]
    rows += [("g", 1, None, None), ("g", 2, "blanks", " AC\nGT\tn ")]
    frame = spark.createDataFrame(rows, "file string, rec_no long, description string, sequence string")
    # sizes differ within a record, too: chunks of two sizes are mixed by cutting twice
    got = bytes_of(chunks.parts(chunks.cut(frame, size)))
    nuc = lambda s: "RNA" if set(s or "") & set("uU") else "DNA"
    assert got == {(f, k): packing.record(d, (s or "").replace("\t", ""), nuc(s)) for f, k, d, s in rows}


def test_chunks_of_any_sizes(spark):
    rng, rows, want = random.Random(9), [], {}
    for k, s in enumerate(sequences(rng, 80)):
        cuts = sorted(rng.randint(0, len(s)) for _ in range(rng.randint(0, 9)))  # equal cuts make empty chunks
        for c, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(s)])):
            rows.append(("f", k, c, a, b - a, "name" if c == 0 else None, s[a:b].encode()))
        want["f", k] = packing.record("name", s, "RNA" if set(s) & set("uU") else "DNA")
    frame = spark.createDataFrame(rows, "file string, rec_no long, chunk_no long, start long, n long, description string, data binary").repartition(5)
    got = chunks.parts(frame)
    assert bytes_of(got) == want
    sums = {(r.file, r.rec_no): (r.crc, r.record_bytes) for r in chunks.checksums(got).collect()}
    assert sums == {k: (zlib.crc32(b[:-4]), len(b)) for k, b in want.items()}
    runs = {}
    for r in chunks.case_runs(frame).orderBy("rec_no", "run_no").collect():
        runs.setdefault(r.rec_no, []).append((r.start, r.len))
    whole = {}
    for k, c, s in sorted((r[1], r[2], r[6]) for r in rows):
        whole[k] = whole.get(k, b"") + s
    assert runs == {k: [tuple(map(int, x)) for x in found] for k, s in whole.items() if len(found := packing.case_runs(np.frombuffer(s, np.uint8)))}
    assert chunks.parts(frame.where("false")).count() == 0


def test_fasta_records_over_splits(spark, tmp_path):
    rng = random.Random(4)
    lines = ["junk", ";x"]
    for k in range(40):
        lines += [f">r{k} > é", *("".join(rng.choices(rng.choice(LETTERS[:4:3]), k=rng.randint(0, 70))) for _ in range(rng.choice([0, 1, 4, 300])))]
    (tmp_path / "a.fasta").write_text("\r\n".join(lines) + "\n")
    (tmp_path / "b.fasta").write_text(">only\nAC\nGT")
    (tmp_path / "c.fasta").write_text("")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = chunks.read_fasta_chunks(spark, str(tmp_path), size=500)
        assert rows.agg(F.max("n")).first()[0] < 600 and rows.groupBy("file", "rec_no").count().agg(F.max("count")).first()[0] > 10
        got = bytes_of(chunks.parts(rows))
        whole = fasta.read_fasta(spark, str(tmp_path)).collect()
        manifest = chunks.write_chunks(rows, f"{tmp_path}/out", files=3).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    nuc = lambda s: "RNA" if set(s) & set("uU") else "DNA"
    assert got == {(r.file, r.rec_no): packing.record(r.description, r.sequence, nuc(r.sequence)) for r in whole} and len(got) == 41
    assert sum(r.records for r in manifest) == 41
    back = container.read_records(spark, f"{tmp_path}/out").collect()
    assert sorted((r.description, r.sequence) for r in back) == sorted((r.description, r.sequence) for r in whole)


def test_symbols_outside_the_alphabet(spark):
    frame = spark.createDataFrame([("f", 1, "d", "ACGTMKL")], "file string, rec_no long, description string, sequence string")
    with pytest.raises(Exception, match="acids.*: L"):
        chunks.parts(chunks.cut(frame, 3))
