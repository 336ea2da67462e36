"""FASTA files to containers, with checks before and a round-trip report after."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..sources import commits, container, fasta
from . import chunk_scan, chunks, digests, integrity


@dataclass
class Conversion:
    """manifest of the files; the records that mix T and U, and how many; the report of what came back."""

    manifest: DataFrame
    mixed_rows: DataFrame
    mixed: int
    report: integrity.Report

    @property
    def summary(self) -> DataFrame:
        """One row of counters."""
        return self.report.summary()

    @property
    def details(self) -> DataFrame:
        """The records that differ; found only when asked for."""
        return self.report.details()


def with_types(records: DataFrame) -> DataFrame:
    """Adds nuc; an error at a symbol outside the alphabet."""
    enc = bases.encoding(F.col("sequence"))
    return records.withColumn("nuc", F.when(enc.isNotNull(), bases.nucleotide(F.col("sequence"))))


def mixed_records(records: DataFrame) -> DataFrame:
    """Records with both T and U, of which a container keeps one letter only."""
    return records.where(bases.mixes_t_and_u(F.col("sequence"))).select("file", "rec_no", bases.shortened(F.col("description")).alias("description"))


def convert_fasta(spark: SparkSession, path: str | list[str], folder: str, version: int = 2) -> Conversion:
    """FASTA files to containers in a folder, which must not be or hold an input. Paths may be relative."""
    container.known_version(version)
    paths = [commits.qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    records = fasta.read_fasta(spark, paths)
    manifest = container.write_records(with_types(records).drop("id"), folder, version, inputs=paths)
    mixed = mixed_records(records)
    return Conversion(manifest, mixed, mixed.count(), integrity.Report(records, container.read_records(spark, folder)))


def convert_long(spark: SparkSession, path: str | list[str], folder: str, size: int = chunks.SIZE) -> Conversion:
    """The same for records of any length: they are read, written, read back and compared by chunks of about `size` symbols."""
    paths = [commits.qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    commits.attempt(spark, folder, paths)  # refuses folders before any work is done
    rows = chunks.saved(chunks.read_fasta_chunks(spark, paths, size), "fasta-rows")
    manifest = chunks.write_chunks(rows, folder, inputs=paths, stored=True)
    decoded = chunks.saved(chunk_scan.read_chunks(spark, folder, size), "decoded-chunks")
    report = digests.ChunkReport(rows, decoded, min(size, digests.SIZE))
    mixed = chunks.saved(mixed_chunks(rows), "mixed")
    return Conversion(manifest, mixed, mixed.count(), report)


def mixed_chunks(rows: DataFrame) -> DataFrame:
    """As ``mixed_records``, of chunks: a record's letters may lie in different ones."""
    has = [F.bool_or(F.contains(F.upper(digests.letters(F.col("data"))), F.lit(x))).alias(x) for x in "TU"]
    found = rows.groupBy("file", "rec_no").agg(F.max("description").alias("description"), *has).where("T and U")
    return found.select("file", "rec_no", bases.shortened(F.col("description")).alias("description"))
