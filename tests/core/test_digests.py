import random

import pytest
from pyspark.sql import functions as F

from basewright.operators import chunks, digests, integrity

SCHEMA = "file string, rec_no long, description string, sequence string"


def report(spark, original, decoded, cuts=(7, 11), size=5, fan=3):
    a, b = (spark.createDataFrame(rows, SCHEMA) for rows in (original, decoded))
    whole = integrity.Report(a, b)
    found = digests.ChunkReport(chunks.cut(a, cuts[0]), chunks.cut(b, cuts[1]), size=size, fan=fan)
    return whole, found


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["index"], r["description"]))


@pytest.mark.parametrize("cuts", [(7, 11), (3, 64), (100, 1)])
def test_equal_to_whole_sequences(spark, cuts):
    """Differences at and around borders of cells and chunks, prefixes, empty and missing records, repeated descriptions."""
    rng = random.Random(9)
    original, decoded = [], []
    for i in range(70):
        s = "".join(rng.choice("ACGTUacgtu") for _ in range(rng.choice([0, 1, 4, 5, 6, 15, 30, 44, 45, 46, 90])))
        t = list(s)
        for _ in range(rng.choice([0, 1, 1, 2])):
            if t:
                t[rng.randrange(len(t))] = rng.choice("ACGTU")
        t = "".join(t)
        t = rng.choice([t, t, t[: len(t) // 2], t + "ACGTA", t.replace("U", "T")])
        original.append((f"f{i % 2}", i, f"d{i % 50}", s))
        decoded.append((f"f{i % 2}", i, f"d{i % 50}" if i % 13 else f"lost{i}", t))
    whole, found = report(spark, original, decoded, cuts)
    assert rows(found.details()) == rows(whole.details())
    assert found.summary().first() == whole.summary().first()


def test_nothing_to_compare(spark):
    whole, found = report(spark, [], [("f", 1, "a", ""), ("f", 2, "b", "ACGT")])
    assert rows(found.details()) == rows(whole.details())
    assert not report(spark, [("f", 1, "a", "ACGT")], [])[1].details().collect()


def test_long_record_fetches_one_cell(spark):
    """Eight million symbols that differ once: rows that are fetched hold a cell and its context."""
    n, at = 8_000_000, 6_543_210
    s = F.concat(F.repeat(F.lit("ACGTNACGTA"), n // 10))
    a = spark.range(1).select(F.lit("f").alias("file"), F.lit(1).cast("long").alias("rec_no"), F.lit("x").alias("description"), s.alias("sequence"))
    b = a.withColumn("sequence", F.overlay("sequence", F.lit("U"), at + 1, 1))
    found = digests.ChunkReport(chunks.saved(chunks.cut(a, 300_000), "a"), chunks.saved(chunks.cut(b, 170_000), "b"), size=1 << 12, fan=16)
    assert len(found.a.levels) == 4
    pair = found.first_cells(found.decoded.select("place", F.col("place").alias("original_place")))
    assert pair.first().cell == at >> 12
    assert found.a.window(pair, "place").select(F.length("symbols")).first()[0] == (1 << 12) + 2 * integrity.CONTEXT
    row = found.details().first()
    assert row.first_diff_at == at and row.ctx_dec[20] == "U" and row.ctx_orig == ("ACGTNACGTA" * 6)[(at - 20) % 10 :][:40]
    assert (row.orig_T, row.dec_U) == (2 * n // 10, 1)
