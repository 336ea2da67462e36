import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual, StringContains
from pyspark.sql.types import StructType

from basewright.sources import commits, container, surface

ROWS = [("f", i, f"d{i} {'x' * (i % 7)}", "ACGTacgtnN"[i % 10 :] * (i % 50), "RNA" if i % 3 == 0 else "DNA") for i in range(1, 301)]
SCHEMA = "file string, rec_no long, description string, sequence string, nuc string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    surface.register(spark)
    path = f"{tmp_path_factory.mktemp('source')}/out"
    container.write_records(spark.createDataFrame(ROWS, SCHEMA), path, files=1, block=500)
    return path


def source(spark, folder, schema=None, **options):
    reader = spark.read.format("basewright").options(**options)
    return (reader.schema(schema) if schema else reader).load(folder)


def test_equals_the_scan(spark, folder):
    columns = ["file", "rec_no", "description", "sequence", "nuc"]
    got = source(spark, folder, span=3000)
    assert got.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, container.read_records(spark, folder).select(columns).collect()))
    files = f"{commits.current(spark, folder)}"
    assert sorted(map(tuple, source(spark, files).select("rec_no", "sequence").collect())) == sorted(map(tuple, got.select("rec_no", "sequence").collect()))


@pytest.mark.parametrize("where", ["rec_no = 77", "rec_no > 40 AND rec_no <= 90", "rec_no < 3 OR rec_no = 9", "description = 'd14 '", "description IN ('d15 x', 'd16 xx', 'zz')", "description LIKE 'd2%' AND rec_no > 220", "rec_no IN (3, 300)", "rec_no = 5 AND rec_no = 6", "description LIKE '%xx' AND nuc = 'RNA'", "file IS NULL"])
def test_filters(spark, folder, where):
    want = sorted(r.rec_no for r in container.read_records(spark, folder).where(where).collect())
    assert sorted(r.rec_no for r in source(spark, folder).where(where).collect()) == want


def test_filters_leave_blocks_unread(spark, folder):
    make = lambda: surface.Records(StructType().add("rec_no", "long"), {"path": folder, "span": "500"})
    whole, some = make(), make()
    rest = list(some.pushFilters([GreaterThan(("rec_no",), 150), LessThanOrEqual(("rec_no",), 160), StringContains(("description",), "x")]))
    assert rest == [StringContains(("description",), "x")]
    read = lambda r: sum(b[2] for p in r.partitions() for b in p.blocks)
    assert 0 < read(some) < read(whole) / 5
    none = make()
    assert list(none.pushFilters([EqualTo(("file",), "nowhere")])) == [] and none.partitions() == []


def test_pushed_filters_show_in_the_plan(spark, folder):
    plan = source(spark, folder).where("rec_no = 77 AND description LIKE '%x%'")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters" in plan and "EqualTo(rec_no,77)" in plan.replace(" ", "")


def test_only_columns_of_the_schema_are_made(spark, folder, monkeypatch):
    reader = surface.Records(StructType().add("rec_no", "long").add("description", "string"), {"path": folder})
    monkeypatch.setattr(surface.packing, "unpacked", lambda *a: pytest.fail("unpacked"))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == len(ROWS)


def test_writes_are_commits(spark, folder, tmp_path):
    rows, path = spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/w"
    rows.write.format("basewright").mode("append").save(path)
    with pytest.raises(Exception, match="overwrite"):
        rows.write.format("basewright").mode("append").save(path)
    bad = rows.withColumn("sequence", F.when(F.col("rec_no") == 200, "A!").otherwise(F.col("sequence")))
    with pytest.raises(Exception, match="nsupported symbol"):
        bad.write.format("basewright").mode("overwrite").save(path)
    assert source(spark, path).count() == len(ROWS)
    rows.where("rec_no < 3").write.format("basewright").mode("overwrite").save(path)
    assert source(spark, path).count() == 2 and container.read_records(spark, path, back=1).count() == len(ROWS)
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "notes.txt").write_text("x")
    with pytest.raises(Exception, match="not written by this sink"):
        rows.write.format("basewright").mode("overwrite").save(f"{tmp_path}/other")
    empty = f"{tmp_path}/none"
    rows.where("false").write.format("basewright").mode("overwrite").save(empty)
    assert source(spark, empty).count() == 0


def test_broken_file(spark, folder, tmp_path):
    (tmp_path / "x.seqs").write_bytes(b"FAST\2\0\0\0\1\0\0\0\1")
    with pytest.raises(Exception, match="record 1"):
        source(spark, f"{tmp_path}/x.seqs").collect()


def test_sql(spark, folder):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW surfaced USING basewright OPTIONS (path '{folder}')")
    got = spark.sql("SELECT count(*) AS n, max(record_encoding(sequence)) AS enc, sum(octet_length(record_bytes(description, sequence, nuc))) AS bytes FROM surfaced").first()
    size = container.read_records(spark, folder).select(F.sum(F.octet_length(container.record_bytes(F.col("description"), F.col("sequence"), F.col("nuc"))))).first()[0]
    assert tuple(got) == (300, "4b", size)
    files = spark.read.format("binaryFile").load(f"{commits.current(spark, folder)}/*.seqs").select("path")
    files.createOrReplaceTempView("surface_files")
    assert spark.sql("SELECT sum(r.rec_no) AS n FROM surface_files f, LATERAL container_records(f.path) r").first().n == sum(r[1] for r in ROWS)
