"""FASTA text as a source and sink of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame) -> DataFrame:
    """Adds rec_no, from 1 in each file, to pieces (file, block, value) as they come from a scan.

    Pieces of a block (a part of a file) follow each other in one task. The first number of each block comes from
    the counts of the blocks before it: one row per block is summed up, never one per record. A piece before a
    file's first record mark goes; only such a first piece has no mark of its own.
    """
    rows = rows.withColumn("scan_", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.count("*").alias("n_"), F.min("scan_").alias("first_"), F.min_by(F.col("value").startswith(">"), "scan_").alias("marked_"))
    by = Window.partitionBy("file").orderBy("block")
    before = F.coalesce(F.sum("n_").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    marked = F.first("marked_").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    number = before + F.when(marked, 1).otherwise(0) - F.col("first_")
    sizes = sizes.select(F.col("file").alias("file_"), F.col("block").alias("block_"), number.alias("shift_"))
    out = rows.join(sizes, (F.col("file") == F.col("file_")) & (F.col("block") == F.col("block_")))
    return out.withColumn("rec_no", F.col("scan_") + F.col("shift_")).where(F.col("rec_no") > 0).drop("scan_", "file_", "block_", "shift_")


def parsed(value: Column) -> tuple[Column, Column]:
    """Header and sequence of a piece of text between two record marks."""
    value = F.regexp_replace(value, "^>", "")
    head = F.regexp_replace(F.substring_index(value, "\n", 1), "\r$", "")
    rest = F.when(F.instr(value, "\n") > 0, F.substring(value, F.instr(value, "\n") + 1, F.length(value))).otherwise("")
    return head, F.translate(rest, "\n\r \t", "")


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, rec_no, id (first word of the header), description (the whole header), sequence.

    What stands before the first record mark of a file is left out, and so are blanks and carriage returns in
    sequences. A missing path is an error of the scan.
    """
    rows = spark.read.option("lineSep", "\n>").text(path)
    rows = rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = numbered(rows)
    head, sequence = parsed(F.col("value"))
    return rows.select("file", "rec_no", F.element_at(F.split(head, r"\s+"), 1).alias("id"), head.alias("description"), sequence.alias("sequence"))


def wrapped(sequence: Column, width: int = 80) -> Column:
    return F.array_join(F.regexp_extract_all(sequence, F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")


def write_fasta(records: DataFrame, path: str, width: int = 80, compression: str = "none") -> None:
    """Text files of records (description, sequence), optionally gzip or bzip2."""
    rows = records.select(F.concat_ws("\n", F.concat(F.lit(">"), F.coalesce("description", F.lit(""))), F.nullif(wrapped(F.col("sequence"), width), F.lit(""))).alias("value"))
    rows.write.option("compression", compression).text(path)
