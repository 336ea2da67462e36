"""The registered queries on a folder of tables: contract columns and types, row counts, and their SQL where there is some."""

import os

import duckdb
import pytest

import corpus_pipeline
from basewright.llm import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# The columns of each contract.
COLUMNS = {
    "op1_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op3_language": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_top_k": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op5_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op9_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op10_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op11_runs": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op12_near_vectors": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op13_divergence": "lang string, source string, part string, item string, value bigint, rank int",
}


def rows_of(table):
    return duckdb.connect().execute(f"SELECT count(*) FROM '{DATA}/{table}.parquet'").fetchone()[0]


def test_all_are_registered():
    assert set(registry.queries()) == set(COLUMNS)
    assert set(registry.oracle_sql()) == {"op2_warc", "op4_top_k", "op5_secrets", "op12_near_vectors", "op13_divergence"}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    got = registry.queries()[name](spark, DATA)
    types = dict(got.dtypes)
    assert {c: types[c] for c in (x.split()[0] for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    rows = got.collect()
    if name == "op2_warc":
        assert len(rows) == rows_of("pages")
    elif name == "op10_packing":
        assert len({r.doc_id for r in rows}) == rows_of("documents")
        for r in rows:
            assert 0 <= r.offset and r.offset + r.length <= 4096
    elif name not in ("op4_top_k", "op13_divergence"):
        assert len(rows) == rows_of("embeddings" if name == "op12_near_vectors" else "documents")
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
        want = con.sql(registry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        place = [want.columns.index(c) for c in columns]
        assert sorted(str([r[c] for c in columns]) for r in rows) == sorted(str([r[k] for k in place]) for r in want.fetchall())


def test_packing_pads_little(spark):
    from basewright.llm import packing

    rows = packing.op10_packing(spark, DATA).groupBy("sequence_id").sum("length").collect()
    filled = sum(r[1] for r in rows)
    # lengths that are a power of two are stored as they are
    stored = sum(packing.padded(r[1]) for r in rows)
    assert filled <= stored <= 1.03 * filled


def test_a_kept_ledger_is_used_again(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ledger = f"file://{tmp_path}/ledger"
    first = corpus_pipeline.without_secrets(spark, docs, DATA, ledger=ledger).collect()
    files = {p.name for p in (tmp_path / "ledger").glob("*.parquet")}
    n = spark.read.parquet(ledger).count()
    again = corpus_pipeline.without_secrets(spark, docs, DATA, ledger=ledger).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert spark.read.parquet(ledger).count() == n and files
