"""Shared helpers of the training-data operators: working folders, materialised tables and small column builders."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: blank and the code points 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
#: A word is a maximal run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is read from ``spark.checkpoint.dir``. Where a session in one JVM (tests) leaves that unset, a temporary
    folder of this machine is used and set; a session on a cluster has to name one.
    """
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="basewright-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def lean_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of fewer rows and bytes, as rows hold whole texts; a session's own settings stay."""
    for name, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", "67108864b", "8388608b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) == usual:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", value)


class Workspace:
    """A fresh folder under the shared one, for one call of an operator."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None):
        self.spark = spark
        lean_batches(spark)
        self.path = path.rstrip("/") if path else f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Writes a table and reads it back: this cuts the lineage, and a lost executor costs no recomputation.

        by: a column of few values with a folder for each, so that readers of one value read no others.
        """
        where = f"{self.path}/{name}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, name: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_text(df: DataFrame) -> Column:
    return F.coalesce(df["text"], F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``by``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def batches(rows: Iterable, most: int) -> Iterator[list]:
    out: list = []
    for row in rows:
        out.append(row)
        if len(out) >= most:
            yield out
            out = []
    if out:
        yield out
