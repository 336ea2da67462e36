import random

import pytest
from pyspark.sql import functions as F

from basewright.functions import bases

TWO = {"T": 0, "U": 0, "C": 1, "A": 2, "G": 3}
FOUR = dict(zip("UTACGRYKMSWBDHVN-", (int(c, 16) for c in "44821965A3C7DEBF0")))


def slow_pack(s, enc):
    if enc == "2b":
        bits = "".join(f"{TWO[c]:02b}" for c in s)
    elif enc == "3b":
        bits = "".join(f"{c.islower():d}{TWO[c.upper()]:02b}" for c in s)
    else:
        bits = "".join(f"{FOUR[c.upper()]:04b}" for c in s)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def slow_runs(s):
    out, i = [], 0
    while i < len(s):
        j = i
        while j < len(s) and s[j].islower():
            j += 1
        if j > i:
            out.append((i, j - i))
        i = max(j, i + 1)
    return out


def some(rng, letters, n):
    return "".join(rng.choices(letters, k=n))


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(1)
    rows = []
    for n in [*range(0, 71), 500, 20_001]:
        rows.append(("2b", some(rng, "ACGT", n)))
        rows.append(("3b", "a" + some(rng, "ACGTacgt", n)))
        rows.append(("4b", "N" + some(rng, "ACGTRYSWKMBDHVN-acgtryswkmbdhvn", n)))
    return rows


def test_encodings_and_round_trips(spark, cases):
    df = spark.createDataFrame(cases, "want string, s string").repartition(4)
    s = F.col("s")
    df = df.select("want", "s", bases.encoding(s).alias("enc"), bases.pack(s, bases.encoding(s)).alias("p"), bases.case_runs(s).alias("runs"), bases.n_bases(s).alias("n"))
    p, n, d = F.col("p"), F.col("n"), F.lit("D")
    back = F.when(F.col("enc") == "2b", bases.unpack_2b(p, n, d)).when(F.col("enc") == "3b", bases.unpack_3b(p, n, d)).otherwise(bases.with_case(bases.unpack_4b(p, n, d), F.col("runs")))
    rows = df.withColumn("back", back).withColumn("size", bases.packed_size(n, F.col("enc"))).collect()
    assert len(rows) == len(cases)
    for r in rows:
        assert r.enc == r.want and bytes(r.p) == slow_pack(r.s, r.enc) and r.back == r.s and r.size == len(r.p)
        assert [tuple(x) for x in r.runs] == slow_runs(r.s)


def test_rna_comes_back_with_u(spark):
    df = spark.createDataFrame([("ACgu", "ACNu", "ACU")], "a string, b string, c string")
    r = df.select(
        bases.unpack_3b(bases.pack_3b(F.col("a")), F.lit(4), F.lit("RNA")).alias("a"),
        bases.unpack_4b(bases.pack_4b(F.col("b")), F.lit(4), F.lit("R")).alias("b"),
        bases.unpack_2b(bases.pack_2b(F.col("c")), F.lit(3), F.lit("R")).alias("c"),
    ).first()
    assert tuple(r) == ("ACgu", "ACNU", "ACU")


def test_alphabet(spark):
    rows = [("MKL*",), ("AC GT\nAC",), ("acß",), (None,), ("",), ("A\rC",), ("-",), ("A C",)]
    df = spark.createDataFrame(rows, "s string")
    got = df.select(bases.bad_symbol(F.col("s")).alias("bad"), bases.encoding(F.col("s"), strict=False).alias("enc"), bases.n_bases(F.col("s")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("L", None, 4), (None, "2b", 6), ("ß", None, 3), (None, "2b", 0), (None, "2b", 0), ("\r", None, 3), (None, "4b", 1), (None, "2b", 2)]


@pytest.mark.parametrize("make,s", [(bases.encoding, "MKL*"), (bases.pack_2b, "Acgt"), (bases.pack_2b, "ACN"), (bases.pack_3b, "AcN"), (bases.pack_4b, "AX"), (bases.pack_4b, "ß")])
def test_errors(spark, make, s):
    with pytest.raises(Exception, match="symbol"):
        spark.createDataFrame([(s,)], "s string").select(make(F.col("s"))).collect()


def test_runs_that_overlap_or_pass_the_end(spark):
    df = spark.createDataFrame([("ACGTACGT", [(1, 3), (2, 4)]), ("ACGT", [(2, 9)]), ("ACGT", None), ("", [])], "s string, r array<struct<start:int,len:int>>")
    for make in (bases.with_case, bases.with_case_arrow):
        assert [r[0] for r in df.select(make(F.col("s"), F.col("r"))).collect()] == ["AcgtacGT", "ACgt", "ACGT", ""]


def test_very_many_runs(spark):
    s = "aCgg" * 20_000
    df = spark.createDataFrame([(s,)], "s string").select("s", bases.case_runs(F.col("s")).alias("r"))
    r = df.select("r", bases.with_case_arrow(F.upper("s"), F.col("r")).alias("back")).first()
    assert [tuple(x) for x in r.r] == slow_runs(s) and r.back == s


def test_predicates(spark):
    df = spark.createDataFrame([("ACGU", "DNA", "rna"), ("acgu", "DNA", None), ("ACGT", "rna", "x"), ("TtU", None, "dna")], "s string, n string, h string")
    s = F.col("s")
    got = df.select(bases.type_tag(s, F.col("n")), bases.nucleotide(s), bases.nucleotide(s, F.col("h")), bases.mixes_t_and_u(s), bases.count_symbol(s, "U")).collect()
    assert [tuple(r) for r in got] == [("R", "RNA", "RNA", False, 1), ("D", "RNA", "RNA", False, 0), ("R", "DNA", "DNA", False, 0), ("R", "RNA", "DNA", True, 1)]
    r = spark.range(1).select(bases.shortened(F.lit("x" * 201)), bases.bases_per_byte(F.lit(5.0), F.lit(8)), bases.bar_label(F.lit(1234567), F.lit(2.5))).first()
    assert tuple(r) == ("x" * 200 + "…", 0.62, "1,234,567 B<br>NCF: 2.50")
    with pytest.raises(Exception, match="No bytes"):
        spark.range(1).select(bases.bases_per_byte(F.lit(5.0), F.col("id"))).collect()
