import random

import pytest
from pyspark.sql import functions as F

from basewright.operators import convert, integrity, sizes
from basewright.sources import container, fasta
from basewright.streaming import encode

RECORD = "rec_no long, description string, sequence string"


def test_conversion(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">a 1\nACGT\n>b\nACGUN\n>c\nTTUU\n")
    done = convert.convert_fasta(spark, str(tmp_path / "a.fasta"), f"{tmp_path}/out")
    assert done.mixed == 1 and done.manifest.agg(F.sum("records")).first()[0] == 3
    s = done.summary.first()
    assert (s.mismatches, s.not_found, s.pair_mismatches, s.length_mismatches, s.hash_mismatches, s.any_issue) == (1, 1, 0, 0, 1, True)
    d = done.details.first()
    assert (d.description, d.reason, d.first_diff_at, d.ctx_orig, d.ctx_dec) == ("c", "mixed-T/U-in-original (lossy 0x4 nibble)", 0, "TTUU", "UUUU")
    (tmp_path / "b.fasta").write_text(">a\nMKL*\n")
    with pytest.raises(Exception, match="Unsupported symbol"):
        convert.convert_fasta(spark, str(tmp_path / "b.fasta"), f"{tmp_path}/out2")
    (tmp_path / "c.fasta").write_text(">a\nACGT\n>b\nacgn\n")
    legacy = convert.convert_fasta(spark, str(tmp_path / "c.fasta"), f"{tmp_path}/out3", version=1)
    assert {tuple(r)[2:] for r in container.read_records(spark, f"{tmp_path}/out3").collect()} == {("a", "ACGT", "DNA"), ("b", "ACGN", "DNA")}
    assert legacy.details.first().reason == "base-content-mismatch"


def slow_difference(a, b):
    if a == b:
        return -1
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_first_difference(spark):
    rng = random.Random(6)
    rows = [("", ""), ("A", ""), ("", "A"), ("AC", "ACG"), ("ACG", "AC"), ("A", "C")]
    for _ in range(200):
        a = "".join(rng.choices("AC", k=rng.randint(0, 40)))
        b = a[: rng.randint(0, len(a))] + "".join(rng.choices("AC", k=rng.randint(0, 5)))
        rows.append((a, b))
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", integrity.first_difference(F.col("a"), F.col("b")).alias("i")).collect()
    assert all(r.i == slow_difference(r.a, r.b) for r in got)


def test_reasons(spark):
    rows = [(None, "A"), ("AC", "A"), ("AUT", "ATT"), ("AUA", "ATA"), ("AC", "AG"), ("Au", "At"), ("ac", "AC")]
    got = [r[0] for r in spark.createDataFrame(rows, "o string, d string").select(integrity.mismatch_reason(F.col("o"), F.col("d"))).collect()]
    assert got == ["desc-missing-in-original", "length-mismatch", "mixed-T/U-in-original (lossy 0x4 nibble)", "global-T↔U-normalization"] + ["base-content-mismatch"] * 3


def test_counters_with_equal_descriptions(spark):
    original = [(1, "a", "ACGT"), (2, "a", "TTTT"), (3, "b", "GGGG"), (4, "lost", "")]
    decoded = [(1, "a", "ACGT"), (2, "a", "TTTT"), (3, "b", "ACGT"), (4, "b", "GGGG"), (5, "z", "CC")]
    o, d = spark.createDataFrame(original, RECORD), spark.createDataFrame(decoded, RECORD)
    s = integrity.summary(o, d).first()
    assert tuple(s) == (3, 1, 1, 0, 2, 1, True, 4, 5)
    assert {(r["index"], r.reason) for r in integrity.details(o, d).collect()} == {(1, "base-content-mismatch"), (3, "base-content-mismatch"), (5, "desc-missing-in-original")}
    same = integrity.summary(o.where("rec_no > 1"), o.where("rec_no > 1")).first()
    assert tuple(same) == (0, 0, 0, 0, 0, 0, False, 3, 3)
    empty = spark.createDataFrame([], RECORD)
    assert tuple(integrity.summary(empty, empty).first()) == (0, 0, 0, 0, 0, 0, False, 0, 0)


def test_sizes(spark, tmp_path):
    rows = [("f", i, f"d{i}", s, "DNA") for i, s in enumerate(["ACGT" * 50, "acgt" * 9, "ACGNacgt", ""])]
    df = spark.createDataFrame(rows, "file string, rec_no long, description string, sequence string, nuc string")
    container.write_records(df, f"{tmp_path}/out", files=1)
    written = sum(p.stat().st_size for p in (tmp_path / "out").rglob("*.seqs"))
    assert sizes.container_size(df).first().container_bytes == written
    fasta.write_fasta(df.coalesce(1), f"{tmp_path}/fa")
    got = {r.method: r.size_bytes for r in sizes.variant_sizes(df).collect()}
    assert len(got) == 8 and got["container"] == written
    # a record without bases is its header alone
    assert got["fasta"] == sum(p.stat().st_size for p in (tmp_path / "fa").glob("part-*")) + 1
    histogram = {r.enc: (r.records, r.bases, r.packed_bytes) for r in sizes.encoding_histogram(df).collect()}
    assert histogram == {"2b": (2, 200, 50), "3b": (1, 36, 14), "4b": (1, 8, 4)}
    assert {r.enc: r.records for r in sizes.encoding_histogram(df.limit(0)).collect()} == {"2b": 0, "3b": 0, "4b": 0}
    again = {r.method: r.size_bytes for r in sizes.variant_sizes(df.repartition(3)).collect()}
    assert again == got  # rows may lie anywhere
    assert {r.method: r.size_bytes for r in sizes.plain_sizes(df).collect()} == {m: got[m] for m in ("fasta", "container")}
    report = sizes.bases_per_byte(sizes.variant_sizes(df), 244).collect()
    assert all(r.ncf == round(244 / r.size_bytes, 2) and r.label.startswith(f"{r.size_bytes:,} B") for r in report)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", "ACGT", "DNA"), ("b", "acgn", None), ("c", "MKL*", "DNA")]
    df = spark.createDataFrame(rows, "description string, sequence string, nuc string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    encode.encode_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(60)
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(str, encode.encoded(df).collect()))
    assert {r.description: r.bad_symbol for r in encode.encoded(df).collect()} == {"a": None, "b": None, "c": "L"}


def test_the_summary_moves_no_sequences(spark):
    df = spark.createDataFrame([(1, "a", "ACGT")], RECORD)
    plan = integrity.summary(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert "max_by(sequence" not in plan
