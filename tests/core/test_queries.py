import math
import os

import duckdb
import pytest

import __spark_entry__
from basewright.plans import oracle
from basewright.plans import queries as plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted([columns[k] for k in order]), sorted(([value(r[k]) for k in order] for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    want = duck.sql(oracle.SQL[name])
    got = plain([tuple(r) for r in df.collect()], df.columns)
    assert got == plain(want.fetchall(), want.columns)
    assert got[1]


@pytest.mark.parametrize("name", ["legacy_roundtrip", "v1_record_hex"])
def test_texts_whose_code_holds_markers(spark, tmp_path, name):
    """Letters of texts may hold a marker three times off the borders of digits, as one in 51,282 does in 0.5 GB."""
    texts = ["Nab, nab; nab: n...", "sws nws nws nw", "ghg nhg nhg nh", "u nab nab nab n", "xx NHGNHGNHGH", "plain", "", None]
    rows = [(i, t, "en" if i % 2 else None, "web", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, str(tmp_path))
    want = con.sql(oracle.SQL[name])
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), want.columns)
    assert df.count() == len(texts)


def test_the_rest_has_rows(spark):
    for name in set(plans.QUERIES) - set(oracle.SQL):
        assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["enc", "records", "bases", "packed_bytes", "bases_per_byte"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
