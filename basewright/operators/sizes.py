"""Sizes of encodings and of stored variants, and bases per byte."""

from __future__ import annotations

import bz2
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bases, wire
from ..sources.container import record_bytes

ENCODINGS = ("2b", "3b", "4b")


def encoding_histogram(records: DataFrame) -> DataFrame:
    """enc, records, bases, payload bytes and bases per byte; encodings that do not occur are rows of zeros.

    records: sequence (only symbols of the alphabet).
    """
    rows = records.select(bases.encoding(F.col("sequence")).alias("enc"), bases.n_bases(F.col("sequence")).alias("n"))
    sums = [
        x.alias(f"{name}_{e}")
        for e in ENCODINGS
        for name, x in (("records", F.count_if(F.col("enc") == e)), ("bases", F.sum(F.when(F.col("enc") == e, F.col("n")))), ("bytes", F.sum(F.when(F.col("enc") == e, bases.packed_size(F.col("n"), F.lit(e))))))
    ]
    each = [F.struct(F.lit(e).alias("enc"), *[F.coalesce(F.col(f"{name}_{e}"), F.lit(0)).cast("long").alias(name) for name in ("records", "bases", "bytes")]) for e in ENCODINGS]
    out = rows.agg(*sums).select(F.explode(F.array(*each)).alias("e")).select("e.*")
    return out.withColumnRenamed("bytes", "packed_bytes").withColumn("bases_per_byte", F.try_divide(F.col("bases").cast("double"), F.col("packed_bytes").cast("double")))


def container_size(records: DataFrame) -> DataFrame:
    """One row: records, total bases, and bytes of a container that holds them all."""
    s = F.col("sequence")
    rows = records.select("description", bases.n_bases(s).alias("n"), bases.encoding(s).alias("enc"), F.size(F.regexp_extract_all(bases.clean(s), F.lit("[a-z]+"), F.lit(0))).alias("runs"))
    size = wire.record_size(F.col("description"), F.col("n"), F.col("enc"), F.col("runs"))
    return rows.agg(F.count("*").alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_bp"), (F.coalesce(F.sum(size), F.lit(0)) + 12).alias("container_bytes"))


def total_bases(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.sum(F.length("sequence").cast("long")), F.lit(0)).alias("total_bp"))


def bases_per_byte(sizes: DataFrame, total_bp: int) -> DataFrame:
    """sizes: method, size_bytes. Adds the ratio and the label of a bar."""
    rows = sizes.withColumn("ncf", bases.bases_per_byte(F.lit(float(total_bp)), F.col("size_bytes")))
    return rows.withColumn("label", bases.bar_label(F.col("size_bytes"), F.col("ncf")))


#: What compresses a member of each storage variant. The first gzip is made as by a parallel tool at its usual level.
COMPRESSORS = {"": None, "_pgz": lambda: zlib.compressobj(6, zlib.DEFLATED, 31), "_zlib": lambda: zlib.compressobj(-1, zlib.DEFLATED, 31), "_bz2": lambda: bz2.BZ2Compressor(9)}
#: Records of a member.
MEMBER = 4096


def as_fasta(description: Column, sequence: Column, wrap: int = 80) -> Column:
    lines = F.array_join(F.regexp_extract_all(sequence, F.lit(f"(.{{1,{wrap}}})"), F.lit(1)), "\n")
    return F.encode(F.concat(F.lit(">"), F.coalesce(description, F.lit("")), F.lit("\n"), lines, F.lit("\n")), "UTF-8")


def plain_sizes(records: DataFrame, wrap: int = 80) -> DataFrame:
    """Bytes of the records as FASTA text and as a container: method, size_bytes."""
    s, head = F.col("sequence"), F.octet_length(F.coalesce("description", F.lit("")))
    enc, runs = bases.encoding(s), F.size(F.regexp_extract_all(bases.clean(s), F.lit("[a-z]+"), F.lit(0)))
    lines = F.length(s) + F.greatest(F.ceil(F.length(s) / wrap), F.lit(1))
    rows = records.select((head + 2 + lines).cast("long").alias("fasta"), wire.record_size(F.col("description"), bases.n_bases(s), enc, runs).alias("container"))
    rows = rows.agg(F.coalesce(F.sum("fasta"), F.lit(0)).alias("fasta"), (F.coalesce(F.sum("container"), F.lit(0)) + 12).alias("container"))
    return rows.unpivot([], ["fasta", "container"], "method", "size_bytes")


def variant_sizes(records: DataFrame, wrap: int = 80) -> DataFrame:
    """Bytes of the records as FASTA text and as a container, each plain and compressed in three ways: method, size_bytes.

    records: rec_no, description, sequence, nuc, and file where there are several. Every ``MEMBER`` records of a file
    are compressed as a member of their own, which all three formats allow; so sizes are summed, no file is put
    together anywhere, and they do not depend on how the records lie in tasks.
    """
    file = [F.col("file")] if "file" in records.columns else [F.lit("").alias("file")]
    data = record_bytes(F.col("description"), F.col("sequence"), F.col("nuc"))
    rows = records.select(*file, "rec_no", F.floor(F.col("rec_no") / MEMBER).alias("member"), as_fasta(F.col("description"), F.col("sequence"), wrap).alias("fasta"), data.alias("container"))
    rows = rows.repartition("file", "member").sortWithinPartitions("file", "rec_no").select(F.concat_ws("|", "file", "member").alias("key"), "fasta", "container")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, open_ = Counter(), None, {}

        def close() -> None:
            for name, coder in open_.items():
                total[name] += len(coder.flush())
            open_.clear()

        for batch in source:
            for key, *parts in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    close()
                    now = key
                    open_.update({name + k: make() for name in ("fasta", "container") for k, make in COMPRESSORS.items() if make})
                for name, part in zip(("fasta", "container"), parts):
                    total[name] += len(part)
                    for k in COMPRESSORS:
                        if k:
                            total[name + k] += len(open_[name + k].compress(part))
        close()
        yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["method", "size_bytes"])

    def alone(data: bytes, make) -> int:
        return len((coder := make()).compress(data) + coder.flush()) if make else len(data)

    sizes = rows.mapInArrow(run, "method string, size_bytes long")
    heads = [(f"container{k}", alone(b"FAST" + bytes(8), make)) for k, make in COMPRESSORS.items()] + [(f"fasta{k}", 0) for k in COMPRESSORS]
    return sizes.union(records.sparkSession.createDataFrame(heads, "method string, size_bytes long")).groupBy("method").agg(F.sum("size_bytes").alias("size_bytes"))
