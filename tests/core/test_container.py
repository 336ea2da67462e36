import gzip
import io
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from basewright.functions import bases, packing, wire
from basewright.operators import convert
from basewright.sources import compressed, container, edit_text, fasta

GOLDEN = {
    ("r1", "TACG", "DNA"): "0102000000 7231 0201000000 44 0604000000 27 7581f2c2",
    ("r1", "TACGA", "DNA"): "0102000000 7231 0201000000 44 0605000000 2780 3ac84bd4",
    ("r2", "ACgu", "RNA"): "0102000000 7232 0201000000 52 0704000000 47c0 6b27f46c",
    ("r3", "ACnnR-", "DNA"): "0102000000 7233 0201000000 44 0306000000 82ff90 0508000000 0200000002000000 10b3a945",
    ("e", "", "DNA"): "0101000000 65 0201000000 44 0600000000 52dff7fc",
    ("r4", "UACG", "RNA"): "0102000000 7234 0201000000 52 0604000000 27 929bd3db",
}
SCHEMA = "file string, rec_no long, description string, sequence string, nuc string"


def whole(*records):
    return bytes.fromhex("4641535402000000") + struct.pack("<I", len(records)) + b"".join(bytes.fromhex(GOLDEN[r]) for r in records)


def test_golden_records(spark):
    df = spark.createDataFrame(list(GOLDEN), "description string, sequence string, nuc string")
    got = df.select("*", wire.with_checksum(wire.record_body(F.col("description"), F.col("sequence"), F.col("nuc"))).alias("b")).collect()
    assert {tuple(r)[:3]: bytes(r.b) for r in got} == {k: bytes.fromhex(v) for k, v in GOLDEN.items()}


def test_golden_file_is_written_and_read(spark, tmp_path):
    two = [("r1", "TACG", "DNA"), ("r3", "ACnnR-", "DNA")]
    df = spark.createDataFrame([("g", i, *r) for i, r in enumerate(two, 1)], SCHEMA)
    manifest = container.write_records(df, f"{tmp_path}/out", files=1).collect()
    assert len(manifest) == 1 and (manifest[0].records, manifest[0].bytes) == (2, 73)
    assert (tmp_path / "out" / manifest[0].file).read_bytes() == whole(*two)
    assert [tuple(r)[2:] for r in container.read_records(spark, f"{tmp_path}/out").orderBy("rec_no").collect()] == two


def table(rng, n):
    rows = []
    for i in range(n):
        letters, nuc = rng.choice([("ACGT", "DNA"), ("ACGU", "RNA"), ("ACGTacgt", "DNA"), ("ACGTNRacgtn-", "DNA"), ("ACGUNacgun", "RNA")])
        s = "".join(rng.choices(letters, k=rng.choice([0, 1, 7, 60, 3000])))
        rows.append((f"f{i % 3}", i, f"d{i} é {rng.random()}", s, "RNA" if nuc == "RNA" and "U" in s else "DNA"))
    return [r if r[4] == "RNA" else (*r[:3], r[3].replace("U", "T").replace("u", "t"), r[4]) for r in rows]


@pytest.mark.parametrize("legacy", [False, True])
def test_round_trip_over_many_files(spark, tmp_path, legacy):
    rows = [r for r in table(random.Random(3), 200) if not (legacy and "-" in r[3])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    manifest = container.write_records(df, f"{tmp_path}/out", legacy=legacy, files=5)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    assert {str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.seqs")} == {r.file for r in manifest.collect()}
    got = container.read_records(spark, f"{tmp_path}/out").collect()
    assert sorted(tuple(r)[2:] for r in got) == sorted(r[2:] for r in rows)


def test_legacy_stream(spark, tmp_path):
    rows = [("x", 1, "r1", "TACG", "DNA"), ("x", 2, "r2", "UACGN", "RNA"), ("x", 3, "é 3", "NNN", "DNA"), ("x", 4, "x 4", "", "DNA"), ("x", 5, "x sinensis 0x1", "ABAU", "RNA")]
    df = spark.createDataFrame(rows, SCHEMA)
    data = container.record_bytes(F.col("description"), F.col("sequence"), F.col("nuc"), 1)
    digits = [bytes(r.bytes).decode() for r in df.select("rec_no", data.alias("bytes")).orderBy("rec_no").collect()]
    assert digits[:2] == ["72310F0482100F", "7231F0F4821F00F".replace("7231", "7232")]
    container.write_records(df, f"{tmp_path}/out", version=1, files=1)
    got = container.read_records(spark, f"{tmp_path}/out").orderBy("rec_no").collect()
    assert [tuple(r)[1:] for r in got] == [r[1:] for r in rows]


def test_legacy_search_at_any_bit(spark):
    one = lambda d: spark.createDataFrame([(d,)], "d string").select(wire.legacy_decoded(F.col("d")).alias("r")).first().r
    assert tuple(one("72310F0482100F")) == ("r1", "TACG", "DNA")
    assert tuple(one("7231F0F4821F00F")) == ("r1", "UACGN", "RNA")
    for bad in ("7231", "72310F04821", "7231F0F4821F00F0"):
        with pytest.raises(Exception, match="marker"):
            one(bad)


def searched(bits):
    """A record as the search over its bits finds it."""
    for nuc, marker in (("DNA", "000011110000"), ("RNA", "111100001111")):
        if marker in bits:
            before, rest = bits.split(marker, 1)
            break
    else:
        return "No type marker"
    if (stop := rest.find("000000001111")) < 0:
        return "No end marker"
    if stop % 4:
        return "not whole"
    sequence = "".join(" GCSTKYBARMVWDHN"[int(rest[k : k + 4], 2)] for k in range(0, stop, 4))
    return "".join(chr(int(before[k : k + 8], 2)) for k in range(0, len(before), 8)), sequence.replace("T", "U") if nuc == "RNA" else sequence, nuc


def test_legacy_search_equals_that_over_bits(spark):
    """Markers at all alignments, descriptions of any number of bits, codes that are cut or not whole."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("01") for _ in range(n))
    bits = [some(k) + rng.choice(["000011110000", "111100001111"]) + some(4 * rng.randint(0, 6) + rng.choice([0, 0, 0, 1])) + "000000001111" for k in range(40) for _ in range(6)]
    bits = [b + "0" * (-len(b) % 4) for b in bits] + ["0000", "0000111100000000", "10101010"]
    want = {f"{int(b, 2):0{len(b) // 4}X}": searched(b) for b in bits}
    good = [(d,) for d, w in want.items() if isinstance(w, tuple)]
    got = {r.d: tuple(r.r) for r in spark.createDataFrame(good, "d string").select("d", wire.legacy_decoded(F.col("d")).alias("r")).collect()}
    assert len(got) > 150 and got == {d: want[d] for (d,) in good}
    for why in ("No type marker", "No end marker", "not whole"):
        bad = next(d for d, w in want.items() if w == why)
        with pytest.raises(Exception, match=why):
            spark.createDataFrame([(bad,)], "d string").select(wire.legacy_decoded(F.col("d"))).collect()


def test_marker_guard(spark):
    rng = random.Random(4)
    marks = {"DNA": "000011110000" * 3, "RNA": "111100001111" * 3, "NEXT": "000000001111" * 3}
    texts = ["".join(rng.choices(" N", k=40)) for _ in range(60)] + [" N  N  N ", "N NN NN N", "  N  N  N", "CCGG" * 20, "SWSWSWSWSSWW", ""]
    for shift in range(4):
        for m in marks.values():
            bits = "1" * shift + m + "0" * (-(len(m) + shift) % 4)
            texts.append("".join(" GCSTKYBARMVWDHN"[int(bits[i : i + 4], 2)] for i in range(0, len(bits), 4)))
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.h for r in df.select("s", wire.marker_hits(wire.legacy_digits(F.col("s"))).alias("h")).collect()}
    for t in texts:
        bits = "".join(f"{' GCSTKYBARMVWDHN'.index(c):04b}" for c in t)
        want = next(((k, bits.find(m)) for k, m in marks.items() if m in bits), None)
        assert (tuple(got[t]) if got[t] else None) == want, t
    for bad in (" N  N  N ", "A-C"):
        with pytest.raises(Exception, match="marker|symbol"):
            spark.createDataFrame([(bad,)], "s string").select(wire.legacy_record(F.lit("d"), F.col("s"))).collect()


def test_codes_with_markers_off_digit_borders(spark, tmp_path):
    """Letters that hold a marker three times off the borders of digits are written for readers that go by digits, and come back."""
    parts = ["NABNABNABN", "nabnabnabA", "SWSNWSNWSNW", "VWSNWSNWSNN", "GHGNHGNHGNH", "NHGNHGNHGH", "N NN NN N"]
    rows = [("x", i, f"r{i} é", before + part + after, "DNA") for i, (part, before, after) in enumerate((p, b, a) for p in parts for b in ("", "G", "ACGTN") for a in ("", "C", "NAB"))]
    rows += [(f, i + 1000, d, s.replace("T", "U") + "U", "RNA") for f, i, d, s, _ in rows]
    df = spark.createDataFrame(rows, SCHEMA)
    hits = df.select("rec_no", wire.marker_hits(wire.legacy_digits(F.col("sequence"))).alias("h")).where("h IS NOT NULL")
    assert hits.count() == len(rows) and {r[0] for r in hits.select(F.expr("h.bit % 4")).distinct().collect()} == {0, 1, 2, 3}
    container.write_records(df, f"{tmp_path}/out", version=1, files=2, any_bit=False)
    got = container.read_records(spark, f"{tmp_path}/out").orderBy("file", "rec_no").collect()
    assert [tuple(r)[2:] for r in got] == [(d, s.upper(), nuc) for _, _, d, s, nuc in rows]
    with pytest.raises(Exception, match="holds marker RNA three times"):
        container.write_records(df, f"{tmp_path}/guarded", version=1)
    for bad in ("A  N", "A  NC", "  N  N  N", " N  N  N ", "A-C"):  # codes that readers would end early
        with pytest.raises(Exception, match="end marker|symbol"):
            spark.createDataFrame([(bad,)], "s string").select(wire.legacy_record(F.lit("d"), F.col("s"), any_bit=False)).collect()
    good = [(f"b{k}", n, "d", text, "DNA") for k, blanks in enumerate(("A ", "A  ", "  A  ", " N ", "   ")) for n, text in enumerate((blanks, "AC"))]
    container.write_records(spark.createDataFrame(good, SCHEMA), f"{tmp_path}/blanks", version=1, files=1, any_bit=False)
    assert [r.sequence for r in container.read_records(spark, f"{tmp_path}/blanks").orderBy("file", "rec_no").collect()] == [r[3] for r in good]


BROKEN = {
    "magic": b"FASX" + whole()[4:], "version": whole()[:4] + b"\3" + whole()[5:], "short": b"FAST\2",
    "flipped": whole(("r1", "TACG", "DNA")).replace(b"r1", b"s1"), "count": whole()[:8] + struct.pack("<I", 2) + whole(("r1", "TACG", "DNA"))[12:],
}


def blocks(*parts):
    body = b"".join(struct.pack("<BI", k, n) + b for k, n, b in parts)
    return whole()[:8] + struct.pack("<I", 1) + body + struct.pack("<I", zlib.crc32(body))


BROKEN |= {"no type": blocks((1, 1, b"a"), (6, 0, b"")), "no sequence": blocks((1, 1, b"a"), (2, 1, b"D")), "runs": blocks((2, 1, b"D"), (3, 1, b"\x80"), (5, 4, b"abcd")), "bad tag": blocks((2, 1, b"X"), (6, 0, b""))}


@pytest.mark.parametrize("name", BROKEN)
def test_broken_files(spark, tmp_path, name):
    (tmp_path / "a.seqs").write_bytes(BROKEN[name])
    (tmp_path / "b.seqs").write_bytes(whole(("r1", "TACG", "DNA")))
    with pytest.raises(Exception, match="a.seqs|marker"):
        container.read_records(spark, str(tmp_path)).collect()
    rows = container.read_records(spark, str(tmp_path), "PERMISSIVE").collect()
    assert sum(r.error is not None for r in rows) == 1 and sum(r.file.endswith("b.seqs") and r.sequence == "TACG" for r in rows) == 1
    assert all(r.sequence is not None for r in container.read_records(spark, str(tmp_path), "DROPMALFORMED").collect())


def test_unknown_and_repeated_blocks(spark, tmp_path):
    data = blocks((0x7F, 2, b"zz"), (1, 1, b"a"), (2, 1, b"R"), (6, 4, b"\x00"), (6, 4, b"\x27"), (4, 3, b"nop")) + b"rest"
    (tmp_path / "a.seqs").write_bytes(data)
    assert [tuple(r)[1:] for r in container.read_records(spark, str(tmp_path)).collect()] == [(1, "a", "UACG", "RNA")]


def test_unused_payloads_are_not_unpacked(spark, tmp_path):
    (tmp_path / "a.seqs").write_bytes(whole(("r1", "TACG", "DNA")))
    plan = container.read_records(spark, str(tmp_path)).select("description")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_sources_of_one_name_stay_apart(spark, tmp_path):
    rows = [("/a/x.fasta", 1, "a1", "ACGT", "DNA"), ("/b/x.fasta", 1, "b1", "ACG", "DNA"), ("/b/x.fasta", 2, "b2", "AC", "DNA")]
    manifest = container.write_records(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/out", files=1).collect()
    assert {(r.source, r.records) for r in manifest} == {("/a/x.fasta", 1), ("/b/x.fasta", 2)} and len({r.file for r in manifest}) == 2
    assert {r.description for r in container.read_records(spark, f"{tmp_path}/out").collect()} == {"a1", "b1", "b2"}


def test_a_second_write_replaces_the_first(spark, tmp_path):
    rows = [("f", i, f"d{i}", "ACGT", "DNA") for i in range(40)]
    container.write_records(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/out", files=4)
    container.write_records(spark.createDataFrame(rows[:5], SCHEMA), f"{tmp_path}/out", files=1)
    assert container.read_records(spark, f"{tmp_path}/out").count() == 5
    assert {p.name for p in tmp_path.iterdir()} == {"out"}


def test_unknown_version(spark, tmp_path):
    df = spark.createDataFrame([("f", 1, "d", "ACGT", "DNA")], SCHEMA)
    for version in (0, 3, "2"):
        with pytest.raises(ValueError, match="not known"):
            container.write_records(df, f"{tmp_path}/out", version)
        with pytest.raises(ValueError, match="not known"):
            edit_text.save(df, f"{tmp_path}/out", version)
        with pytest.raises(ValueError, match="not known"):
            convert.convert_fasta(spark, f"{tmp_path}/none", f"{tmp_path}/out", version)
    assert not list(tmp_path.iterdir())


def test_legacy_stream_in_small_chunks():
    digits = "72310F0482100F" + "7232F0F4821F00F" + "610F000F" + "0"
    data = bytes.fromhex(digits + "0" * (len(digits) % 2))
    for chunk in (1, 2, 3, 100):
        found = list(container.legacy_records(container.Bytes(io.BytesIO(data)), chunk))
        assert [(r[0], r[1], r[3]) for r in found] == [("r1", "D", 4), ("r2", "R", 5), ("a", "D", 0)]


def test_packing_equals_column_functions(spark):
    rng = random.Random(12)
    rows = [(f"d{i}", s, n) for i, (_, _, _, s, n) in enumerate(table(rng, 120))] + [("é", " AC\nGTn ", "DNA"), ("", "acgu", "rna"), (None, None, None), ("x", "n", "DNA")]
    df = spark.createDataFrame(rows, "description string, sequence string, nuc string")
    body = wire.with_checksum(wire.record_body(F.col("description"), F.col("sequence"), F.col("nuc")))
    for r in df.select("*", body.alias("b")).collect():
        assert packing.record(r.description, r.sequence, r.nuc) == bytes(r.b), r
    enc = bases.encoding(F.col("sequence"))
    parts = df.select(enc.alias("enc"), bases.pack(F.col("sequence"), enc).alias("p"), bases.n_bases(F.col("sequence")).alias("n"), bases.case_runs(F.col("sequence")).alias("runs"), bases.type_tag(F.col("sequence"), F.col("nuc")).alias("tag"))
    for r in parts.select("*", bases.unpack(F.col("p"), F.col("n"), F.col("enc"), F.col("tag"), F.col("runs")).alias("s")).collect():
        assert packing.unpacked(bytes(r.p), r.n, r.enc, r.tag, r.runs if r.enc == "4b" else []) == r.s, r
    with pytest.raises(ValueError, match="acids.*: L"):
        packing.record("a", "MKL", "DNA")


def test_files_of_one_name_are_not_compressed_together(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.fasta").write_text(FASTA)
    with pytest.raises(ValueError, match="x.fasta"):
        compressed.compress_files(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], f"{tmp_path}/out", "zlib")


def test_threads_and_inputs_that_go(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "".join(f">n{i}\n{'ACGT' * 30}\n" for i in range(30_000))
    (tmp_path / "in" / "x.fasta").write_text(text)
    sizes = [compressed.compress_files(spark, f"{tmp_path}/in", f"{tmp_path}/out", "pigz", threads=n, keep=n < 3).first() for n in (1, 3)]
    assert sizes[0].size_bytes == sizes[1].size_bytes and sizes[0].seconds > 0
    assert gzip.decompress((tmp_path / "out" / "x.fasta_pigz.gz").read_bytes()).decode() == text
    assert not (tmp_path / "in" / "x.fasta").exists()


FASTA = ">r1 one > two\nACGT\nAC GT\n>r2\r\nACGU\r\n\n>r3 empty\n>r4\n"


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA, newline="")
    (tmp_path / "b.fasta").write_text("; note\njunk\n>only x\nAC\nGT")
    (tmp_path / "c.fasta").write_text("")
    rows = sorted((r.file[-7:], *tuple(r)[1:]) for r in fasta.read_fasta(spark, str(tmp_path)).collect())
    assert rows == [
        ("a.fasta", 1, "r1", "r1 one > two", "ACGTACGT"), ("a.fasta", 2, "r2", "r2", "ACGU"), ("a.fasta", 3, "r3", "r3 empty", ""),
        ("a.fasta", 4, "r4", "r4", ""), ("b.fasta", 1, "only", "only x", "ACGT"),
    ]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        fasta.read_fasta(spark, f"{tmp_path}/none").collect()


def test_fasta_numbers_over_splits(spark, tmp_path):
    text = "".join(f">n{i} x\n{'ACGT' * (i % 40)}\n" for i in range(1, 3000))
    (tmp_path / "big.fasta").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = fasta.read_fasta(spark, str(tmp_path))
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 2999 and all(r.id == f"n{r.rec_no}" and len(r.sequence) == 4 * (r.rec_no % 40) for r in rows)


def test_compressed_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text(FASTA * 50)
    for method, suffix in compressed.SUFFIXES.items():
        done = compressed.compress_files(spark, f"{tmp_path}/in", f"{tmp_path}/{method}", method).collect()
        assert [r.name for r in done] == [f"a.fasta{suffix}"]
        back = compressed.compress_files(spark, f"{tmp_path}/{method}", f"{tmp_path}/{method}-back", method, decompress=True)
        assert back.first().size_bytes == len(FASTA) * 50
        assert (tmp_path / f"{method}-back" / "a.fasta").read_bytes() == (FASTA * 50).encode()
    assert compressed.file_sizes(spark, f"{tmp_path}/in").first().size_bytes == len(FASTA) * 50
    with pytest.raises(ValueError):
        compressed.compress_files(spark, f"{tmp_path}/in", f"{tmp_path}/x", "lzma")
    fasta.write_fasta(fasta.read_fasta(spark, f"{tmp_path}/in"), f"{tmp_path}/gz", compression="gzip")
    assert fasta.read_fasta(spark, f"{tmp_path}/gz").count() == 200


def test_names(spark):
    df = spark.createDataFrame([("x/a.fasta", "pigz"), ("b.fasta", "bz2")], "p string, m string")
    got = df.select(compressed.output_name(F.col("p")), compressed.compressed_name(F.col("p"), F.col("m"))).collect()
    assert [tuple(r) for r in got] == [("x/a.seqs", "x/a.fasta_pigz.gz"), ("b.seqs", "b.fasta.bz2")]
    for column in (compressed.output_name(F.lit("a.fna")), compressed.compressed_name(F.lit("a"), F.lit("lzma"))):
        with pytest.raises(Exception, match="Not a|Unsupported"):
            spark.range(1).select(column).collect()
