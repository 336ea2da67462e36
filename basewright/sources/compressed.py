"""Compressed copies of files, their names and sizes. Whole files are compressed in parallel, one task each."""

from __future__ import annotations

import bz2
import gzip
import time
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import commits
from .container import opened

#: Bytes of a file that are compressed at a time.
BLOCK = 1 << 20
# Methods and what they append to the whole name, so that no two outputs share one.
SUFFIXES = {"pigz": "_pigz.gz", "zlib": "_zlib.gz", "bz2": ".bz2"}


def output_name(path: Column, extension: str = ".seqs") -> Column:
    """The name of a FASTA file's container; an error where it would be the input itself."""
    return F.when(F.contains(path, F.lit(".fasta")), F.replace(path, F.lit(".fasta"), F.lit(extension))).otherwise(F.raise_error(F.concat(F.lit("Not a .fasta name: "), path)).cast("string"))


def compressed_name(path: Column, method: Column) -> Column:
    """The name with the method's suffix; an error for other methods."""
    found = F.raise_error(F.concat(F.lit("Unsupported method: "), F.coalesce(method, F.lit("null")))).cast("string")
    for name, suffix in SUFFIXES.items():
        found = F.when(method == name, F.concat(path, F.lit(suffix))).otherwise(found)
    return found


def file_sizes(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, size_bytes; contents are not read."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))


def gzip_blocks(source: BinaryIO, level: int, threads: int) -> Iterator[bytes]:
    """Blocks of a file as members of one gzip file, so many at a time as there are threads."""
    squeeze = lambda b: zlib.compress(b, level, 31)
    if not (first := source.read(BLOCK)):
        yield squeeze(b"")  # an empty member: nothing at all is no gzip file
        return
    yield squeeze(first)
    with ThreadPoolExecutor(threads) as pool:
        while blocks := [b for b in (source.read(BLOCK) for _ in range(threads)) if b]:
            yield from pool.map(squeeze, blocks)


def streamed(source: BinaryIO, coder) -> Iterator[bytes]:
    while block := source.read(BLOCK):
        yield coder.compress(block)
    yield coder.flush()


def restored(source: BinaryIO, method: str) -> Iterator[bytes]:
    with bz2.open(source) if method == "bz2" else gzip.open(source) as plain:
        while block := plain.read(BLOCK):
            yield block


def changed(source: BinaryIO, method: str, decompress: bool, threads: int) -> Iterator[bytes]:
    if decompress:
        return restored(source, method)
    if method == "pigz":
        return gzip_blocks(source, 6, threads)
    return streamed(source, bz2.BZ2Compressor(9) if method == "bz2" else zlib.compressobj(-1, zlib.DEFLATED, 31))


def compress_files(spark: SparkSession, path: str | list[str], folder: str, method: str, decompress: bool = False, threads: int = 1, keep: bool = True) -> DataFrame:
    """Writes each file compressed (or, of a compressed one, its content) to a folder. Returns name, size_bytes, seconds.

    Files are streamed, one task each; threads: how many blocks of a file ``pigz`` compresses at a time in its task.
    Two inputs of one name are an error. keep: whether inputs stay; they go only when all outputs are there.
    """
    if method not in SUFFIXES:
        raise ValueError(f"Unsupported method: {method}")
    suffix, folder = SUFFIXES[method], commits.qualified(spark, folder)
    files = spark.read.format("binaryFile").load(path).select("path")
    name = F.substring_index("path", "/", -1)
    if twice := files.groupBy(name.alias("name")).count().where("count > 1").first():
        raise ValueError(f"Several inputs are named {twice['name']}")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        where.create_dir(base, recursive=True)
        for batch in source:
            for file in batch.column(0).to_pylist():
                name, size, began = file.rpartition("/")[2], 0, time.perf_counter()
                if decompress and not name.endswith(suffix):
                    raise ValueError(f"{name} does not end in {suffix}")
                name = name.removesuffix(suffix) if decompress else name + suffix
                there, inside = opened(file)
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with there.open_input_stream(inside, compression=None) as data, where.open_output_stream(part, compression=None) as out:
                    for block in changed(data, method, decompress, threads):
                        out.write(block)
                        size += len(block)
                where.move(part, f"{base}/{name}")
                yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([time.perf_counter() - began])], ["name", "size_bytes", "seconds"])

    files.mapInArrow(run, "name string, size_bytes long, seconds double").write.mode("overwrite").parquet(f"{folder}/_manifest")
    if not keep:

        def drop(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in source:
                for file in batch.column(0).to_pylist():
                    where, inside = opened(file)
                    if where.get_file_info(inside).type != fs.FileType.NotFound:
                        where.delete_file(inside)
            yield pa.record_batch([pa.array([], pa.int64())], ["done"])

        files.mapInArrow(drop, "done long").count()
    return spark.read.parquet(f"{folder}/_manifest")
