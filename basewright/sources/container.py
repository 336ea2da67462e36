"""The binary container of records and the legacy bit stream, as sources and sinks.

Files are read in byte ranges of whole records, many at a time. The sink writes a block index beside its files: every few MB
the number and the place of a record. Containers of others have no index; if they are larger than a range, their
records are found and checked first (``ranges``), which reads them twice. Legacy files of others are read from front to back.
Tasks get paths and stream bytes through the file system that pyarrow finds for them (local, hdfs, s3, gs). The reader
frames records and leaves payloads packed: unpacking is a projection on top, which Spark drops where sequences are not used.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, packing, wire
from . import commits, ranges
from .framing import BATCH, Broken, Bytes, container_record, container_records, is_container, legacy_records, opened

RAW = "file string, rec_no long, description string, tag string, enc string, n_bases long, payload binary, runs array<struct<start:int,len:int>>, error string"
NAMES = [x.split()[0] for x in RAW.split(", ")]
VERSIONS = (1, 2)
#: The index: of each block of a file, its first record's number and place, and the file's format version and size.
INDEX = "source string, file string, version int, first long, offset long, records long, bytes long, size long"
#: Bytes of a block.
BLOCK = 4 << 20


def pieces(spark: SparkSession, path: str | list[str], span: int, back: int = 0) -> DataFrame:
    """file, version, first, offset, bytes, records: parts of files of about span bytes at most. version and records are null for files to be read from front to back.

    A file whose size is not that of its index is read like one that has none.
    """
    paths, indexed = [], None
    for p in [path] if isinstance(path, str) else path:
        p = commits.qualified(spark, p)
        now = commits.current(spark, p, back)
        paths.append(now or p)
        if now:
            own = spark.read.parquet(f"{now}/_index").withColumn("file", F.concat(F.lit(f"{now}/"), "file"))
            indexed = own if indexed is None else indexed.union(own)
    # contents are not read here
    files = spark.read.format("binaryFile").load(paths).select(F.col("path").alias("file"), F.col("length").alias("size"))
    columns = ("file", "version", "first", "offset", "bytes", "records")
    known = None
    if indexed is not None:
        known = files.join(indexed, ["file", "size"]).select(*columns)
        files = files.join(indexed.select("file", "size").distinct(), ["file", "size"], "left_anti")
    none = F.lit(None).cast("long")
    small = files.where(F.col("size") <= span).select("file", F.lit(None).cast("int").alias("version"), F.lit(1).cast("long").alias("first"), F.lit(0).cast("long").alias("offset"), F.col("size").alias("bytes"), none.alias("records"))
    large = files.where(F.col("size") > span)
    out = small if known is None else known.union(small)
    if not large.isEmpty():
        out = out.union(ranges.index_of(large, span).withColumn("bytes", none).select(*columns))
    return out


def table(rows: list[tuple]) -> pa.RecordBatch:
    run = pa.list_(pa.struct([("start", pa.int32()), ("len", pa.int32())]))
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), run, pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], NAMES)


def piece_records(file: str, version: int | None, offset: int, size: int | None, n: int | None) -> Iterator[tuple]:
    """Records of a piece of a file, as of ``pieces``."""
    where, name = opened(file)
    with where.open_input_file(name) as stream:
        if version is None:
            data = Bytes(stream)
            data.back(len(head := data.some(5)))
            yield from container_records(data) if is_container(head) else legacy_records(data)
            return
        stream.seek(offset)
        data = Bytes(stream, offset, size)
        if version == 1:
            yield from islice(legacy_records(data), n)
        else:
            for _ in range(n):
                yield container_record(data)


def in_tasks(parts: DataFrame, span: int) -> DataFrame:
    """Pieces dealt to tasks of about span bytes; neighbours in a file go to one task, which reads it from front to back."""
    total = parts.agg(F.sum(F.coalesce("bytes", F.lit(span)))).first()[0] or 0
    return parts.repartitionByRange(max(1, -(-total // span)), "file", "offset").sortWithinPartitions("file", "offset")


def read_raw(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", span: int | None = None, back: int = 0) -> DataFrame:
    """Framed records of container and legacy files, told apart by their first bytes.

    path: folders of the sink, of which the last commit is read, or the one so many before it; or files, folders and
    patterns of others. mode: FAILFAST stops at the first broken file; PERMISSIVE keeps the records of a piece so far and
    adds a row with the error; DROPMALFORMED only keeps the records. span: bytes of a task and of a piece of a file
    without an index, by default spark.sql.files.maxPartitionBytes.
    """
    if mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
        raise ValueError(f"Unknown mode {mode}")
    span = span or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for file, version, first, offset, size, many in zip(*(c.to_pylist() for c in batch.columns)):
                n, rows, held = first - 1, [], 0
                try:
                    for n, record in enumerate(piece_records(file, version, offset, size, many), first):
                        rows.append((file, n, *record, None))
                        held += len(record[0]) + len(record[4]) + 64 * len(record[5]) + 256
                        if held > BATCH:
                            yield table(rows)
                            rows, held = [], 0
                except (Broken, UnicodeDecodeError) as e:
                    if mode == "FAILFAST":
                        raise Broken(f"{file}, record {n + 1}: {e}") from e
                    if mode == "PERMISSIVE":
                        rows.append((file, n + 1, None, None, None, None, None, None, str(e)))
                if rows:
                    yield table(rows)

    return in_tasks(pieces(spark, path, span, back), span).mapInArrow(run, RAW)


def unpacked(raw: DataFrame) -> DataFrame:
    """file, rec_no, description, sequence, nuc of framed records."""

    @F.pandas_udf("string")
    def sequence(payload: pd.Series, n: pd.Series, enc: pd.Series, tag: pd.Series, runs: pd.Series) -> pd.Series:
        pairs = lambda found: [(r["start"], r["len"]) for r in found] if found is not None else []
        rows = zip(payload, n, enc, tag, runs)
        return pd.Series([None if p is None else packing.unpacked(p, int(k), e, t, pairs(r)) for p, k, e, t, r in rows], dtype=object)

    tag = F.col("tag")
    return raw.select(
        "file", "rec_no", "description", sequence("payload", "n_bases", "enc", "tag", "runs").alias("sequence"),
        F.when(tag == "R", "RNA").when(tag == "D", "DNA").alias("nuc"), *[c for c in raw.columns if c == "error"],
    )


def read_records(spark: SparkSession, path: str | list[str], mode: str = "FAILFAST", span: int | None = None, back: int = 0) -> DataFrame:
    out = unpacked(read_raw(spark, path, mode, span, back))
    return out if mode == "PERMISSIVE" else out.drop("error")


def known_version(version: int) -> int:
    if version not in VERSIONS:
        raise ValueError(f"Version {version} is not known")
    return version


def record_bytes(description: Column, sequence: Column, nuc: Column, version: int = 2, legacy: bool = False, any_bit: bool = True) -> Column:
    """A record as bytes, or for version 1, whose records need not be whole bytes, as hexadecimal digits (any_bit as in ``wire.legacy_record``)."""
    if known_version(version) == 1:
        return F.encode(wire.legacy_record(description, sequence, any_bit), "UTF-8")
    if legacy:  # with a copy in the legacy code
        return wire.with_checksum(wire.record_body(description, sequence, nuc, True))

    @F.pandas_udf("binary")
    def record(description: pd.Series, sequence: pd.Series, nuc: pd.Series) -> pd.Series:
        return pd.Series([packing.record(*row) for row in zip(description, sequence, nuc)], dtype=object)

    return record(description, sequence, nuc)


def write_records(records: DataFrame, folder: str, version: int = 2, legacy: bool = False, suffix: str = ".seqs", files: int | None = None, inputs: list[str] = (), check: Callable[[str], None] | None = None, block: int = BLOCK, any_bit: bool = True) -> DataFrame:
    """Writes records (file, rec_no, description, sequence, nuc) in order, commits them, and returns the manifest: source, file, records, bytes.

    The folder's contents change as a whole, and what was there stays until ``commits.vacuum`` (see ``commits``); so the
    records may come from the folder itself. Records are range-partitioned by file and rec_no, so a file name with
    very many records becomes several files of consecutive records, one per task. Names hold the task and the file's
    place in it: sources of equal names in different folders stay apart, and a task that is run again writes the same names.

    inputs: paths that the folder must not be or hold. check: is called with the path of the new files before they count.
    any_bit: whether files of version 1 are also for readers that search markers at any bit; if so, codes that hold one
    three times are an error. ``read_records`` needs no such thing.
    """
    n = files or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    data = record_bytes(F.col("description"), F.col("sequence"), F.col("nuc"), known_version(version), legacy, any_bit)
    # ranges first: finding them reads the rows once more, and that should not pack them
    rows = records.repartitionByRange(n, "file", "rec_no").sortWithinPartitions("file", "rec_no").select("file", data.alias("bytes"), F.lit(True).alias("last"))
    return write_bytes(rows, folder, version, suffix, inputs, check, block)


def write_parts(parts: DataFrame, folder: str, suffix: str = ".seqs", files: int | None = None, inputs: list[str] = (), block: int = BLOCK) -> DataFrame:
    """The same for records in parts (file, rec_no, place, bytes, last): a record's parts are written one after the other, so that none is ever whole in memory."""
    n = files or int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartitionByRange(n, "file", "rec_no").sortWithinPartitions("file", "rec_no", "place").select("file", "bytes", "last")
    return write_bytes(rows, folder, codes.VERSION, suffix, inputs, None, block)


def write_bytes(rows: DataFrame, folder: str, version: int, suffix: str, inputs: list[str], check: Callable[[str], None] | None, block: int) -> DataFrame:
    """rows: file, bytes, last (ends a record), in the order of their files."""
    spark = rows.sparkSession
    part = commits.attempt(spark, folder, inputs)
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(part)
        where.create_dir(base, recursive=True)
        done, now, out, place = [], None, None, 0

        def close() -> None:
            if out is not None:
                done.extend((now, out.name, version, *row, size) for size, blocks in [out.close()] for row in blocks)

        for batch in source:
            for file, data, last in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                if file != now or out is None:
                    close()
                    name = f"{(file or 'records').rstrip('/').rpartition('/')[2]}-{TaskContext.get().partitionId():06d}-{place:04d}{suffix}"
                    now, out, place = file, RecordFile(where, base, name, version, block), place + 1
                out.add(data.as_py(), last)
        close()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done), kinds)], [x.split()[0] for x in INDEX.split(", ")])

    rows.mapInArrow(run, INDEX).write.parquet(f"{part}/_index")
    if check:
        check(part)
    commits.commit(spark, part)
    return manifest(spark, part)


def manifest(spark: SparkSession, part: str) -> DataFrame:
    """source, file (its path in the folder), records, bytes of an attempt's files."""
    rows = spark.read.parquet(f"{part}/_index").groupBy("source", "file").agg(F.sum("records").alias("records"), F.first("size").alias("bytes"))
    return rows.withColumn("file", F.concat(F.lit(part.rpartition("/")[2] + "/"), "file"))


class RecordFile:
    """A file that gets its name when it is closed. The number of records in its head is known only then, so records wait in a spool.

    Blocks (number of the first record, offset, records, bytes) end with a record at a whole byte.
    """

    def __init__(self, where: fs.FileSystem, base: str, name: str, version: int, block: int = BLOCK):
        self.where, self.base, self.name, self.version, self.block = where, base, name, version, block
        self.part = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.spool = where.open_output_stream(self.part + ".body", compression=None)
        self.head = 12 if version != 1 else 0
        self.n, self.digit, self.size, self.blocks, self.begun = 0, b"", self.head, [], (0, self.head)

    def add(self, data: bytes, last: bool = True) -> None:
        """A record, or a part of one that more follow."""
        self.n += last
        if self.version == 1:  # hexadecimal digits; an odd one waits for the next record
            data = self.digit + data
            whole = len(data) // 2 * 2
            data, self.digit = bytes.fromhex(str(data[:whole], "ascii")), data[whole:]
        self.spool.write(data)
        self.size += len(data)
        if last and not self.digit and self.size - self.begun[1] >= self.block:
            self.end_block()

    def end_block(self) -> None:
        before, offset = self.begun
        if self.n > before:
            self.blocks.append((before + 1, offset, self.n - before, self.size - offset))
        self.begun = (self.n, self.size)

    def close(self) -> tuple[int, list[tuple]]:
        """Bytes of the file, and its blocks."""
        if self.digit:
            self.spool.write(bytes.fromhex(str(self.digit, "ascii") + "0"))
            self.size += 1
        self.end_block()
        self.spool.close()
        with self.where.open_input_stream(self.part + ".body", compression=None) as body, self.where.open_output_stream(self.part, compression=None) as out:
            out.write(codes.MAGIC + bytes([codes.VERSION, 0, 0, 0]) + struct.pack("<I", self.n) if self.head else b"")
            while chunk := body.read(BATCH):
                out.write(chunk)
        self.where.delete_file(self.part + ".body")
        path = f"{self.base}/{self.name}"
        if self.where.get_file_info(path).type != fs.FileType.NotFound:  # the same file of an attempt that was lost
            self.where.delete_file(path)
        self.where.move(self.part, path)
        return self.size, self.blocks
