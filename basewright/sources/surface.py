"""Containers for SQL: a data source, a table function and the codec's functions. ``register`` makes them known to a session.

    CREATE TEMPORARY VIEW records USING basewright OPTIONS (path '/data/out')
    SELECT r.* FROM files f, LATERAL container_records(f.path) r

The source reads what was last committed to a folder of the sink, in tasks of consecutive blocks, or files of others, one a task
(``container.read_raw`` also splits those). Filters on rec_no and file leave blocks unread; filters on description leave payloads packed.
Only columns of the schema are made: with ``.schema("rec_no long, description string")`` no sequence is unpacked.
Pieces are planned on the driver from the block index, one small row every few MB.

A write fills an attempt of its own and commits it, as ``container.write_records`` does, and needs ``mode("overwrite")`` where something
is committed already; a failed one leaves what was there. Without a session there is no file system but a mounted one to commit on, so
other schemes are an error there.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..functions import codes, packing
from . import container
from .commits import ATTEMPT, LOG, put_local
from .framing import BATCH, Broken, opened

SCHEMA = "file string, rec_no long, description string, sequence string, nuc string, enc string, n_bases long"
NUC = {"R": "RNA", "D": "DNA"}
SPAN = 128 << 20
HIGH = 1 << 62


@dataclass
class Piece(InputPartition):
    """Consecutive blocks of a file: (first, offset, bytes, records) each."""

    file: str
    version: int | None
    blocks: list[tuple]


def complete(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file:{os.path.abspath(path)}"


def committed(path: str) -> str | None:
    """The attempt that counts in a folder of the sink."""
    where, base = opened(path)
    names = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(f"{base}/{LOG}", allow_not_found=True)) if f.base_name.isdigit())
    if not names:
        return None
    with where.open_input_file(f"{base}/{LOG}/{names[-1]}") as entry:
        return f"{path}/{str(entry.read(), 'utf-8').strip()}"


class Records(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path, self.span = schema.names, complete(options["path"].rstrip("/")), int(options.get("span", SPAN))
        self.low, self.high, self.files, self.described, self.begun = 1, HIGH, None, None, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes those that say which records are read; Spark applies the others."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("rec_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if column == ("rec_no",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            elif column == ("rec_no",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                pass
            elif column in (("file",), ("description",)) and isinstance(f, (EqualTo, In)):
                name = "files" if column == ("file",) else "described"
                own, had = {value} if isinstance(f, EqualTo) else set(value), getattr(self, name)
                setattr(self, name, own if had is None else own & had)
            elif column == ("description",) and isinstance(f, StringStartsWith):
                self.begun.append(value)
            else:
                yield f

    def wanted(self, file: str) -> bool:
        return self.files is None or file in self.files

    def partitions(self) -> list[Piece]:
        found = []
        if now := committed(self.path):
            where, base = opened(now)
            rows = ds.dataset(f"{base}/_index", filesystem=where, format="parquet").to_table().to_pylist()
            blocks = sorted((f"{now}/{r['file']}", r["first"], r["offset"], r["bytes"], r["records"], r["version"]) for r in rows)
            for file, first, offset, size, n, version in blocks:
                if not self.wanted(file) or first > self.high or first + n <= self.low:
                    continue
                last = found[-1] if found else None
                if not last or last.file != file or sum(b[2] for b in last.blocks) + size > self.span:
                    found.append(last := Piece(file, version, []))
                last.blocks.append((first, offset, size, n))
            return found
        where, base = opened(self.path)
        info = where.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [self.path] if info.is_file else [f"{self.path}/{f.base_name}" for f in where.get_file_info(fs.FileSelector(base)) if f.is_file and f.base_name[0] not in "._"]
        return [Piece(file, None, [(1, 0, None, None)]) for file in sorted(files) if self.wanted(file)]

    def read(self, piece: Piece | None) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for first, offset, size, n in piece.blocks if piece else []:  # Spark asks for a piece where there is none
            number = first - 1
            try:
                for number, record in enumerate(container.piece_records(piece.file, piece.version, offset, size, n), first):
                    if number > self.high:
                        break
                    if number >= self.low and (row := self.row(piece.file, number, record)):
                        rows.append(row)
                        held += sum(len(x) for x in row if isinstance(x, str)) + 64
                    if held > BATCH:
                        yield self.batch(rows)
                        rows, held = [], 0
            except (Broken, UnicodeDecodeError) as e:
                raise Broken(f"{piece.file}, record {number + 1}: {e}") from e
        if rows:
            yield self.batch(rows)

    def row(self, file: str, number: int, record: tuple) -> tuple | None:
        description, tag, enc, n, payload, runs = record
        if self.described is not None and description not in self.described or not all(description.startswith(b) for b in self.begun):
            return None
        make = {
            "file": lambda: file, "rec_no": lambda: number, "description": lambda: description, "nuc": lambda: NUC[tag], "enc": lambda: enc, "n_bases": lambda: n,
            "sequence": lambda: packing.unpacked(payload, n, enc, tag, [(r["start"], r["len"]) for r in runs]),
        }
        return tuple(make[c]() for c in self.names)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"rec_no": pa.int64(), "n_bases": pa.int64()}
        return pa.record_batch([pa.array(c, kinds.get(name, pa.string())) for name, c in zip(self.names, zip(*rows))], self.names)


@dataclass
class Written(WriterCommitMessage):
    rows: list[tuple]


class Attempt(DataSourceArrowWriter):
    """Rows of description, sequence, nuc, and file if there is one, in the order of their partitions."""

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        if missing := {"description", "sequence", "nuc"} - set(schema.names):
            raise ValueError(f"Records need {', '.join(sorted(missing))}")
        path = complete(options["path"].rstrip("/"))
        if not path.startswith("file:"):
            raise ValueError(f"{path}: only mounted folders can be committed to here; use container.write_records")
        self.folder = "/" + path[5:].lstrip("/")
        names = os.listdir(self.folder) if os.path.exists(self.folder) else []
        if LOG not in names and any(not n.startswith(ATTEMPT) for n in names):
            raise ValueError(f"{self.folder} holds files that were not written by this sink")
        if LOG in names and not overwrite:
            raise ValueError(f"{self.folder} has a commit; use mode('overwrite')")
        self.attempt = f"{self.folder}/{ATTEMPT}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where = fs.LocalFileSystem()
        where.create_dir(self.attempt, recursive=True)
        done, out, now, place = [], None, None, 0

        def close() -> None:
            if out is not None:
                size, blocks = out.close()
                done.extend((now, out.name, codes.VERSION, *block, size) for block in blocks)

        for batch in iterator:
            columns = [batch.column(c).to_pylist() if c in batch.schema.names else [None] * batch.num_rows for c in ("file", "description", "sequence", "nuc")]
            for file, *record in zip(*columns):
                if file != now or out is None:
                    close()
                    name = f"{(file or 'records').rstrip('/').rpartition('/')[2]}-{TaskContext.get().partitionId():06d}-{place:04d}.seqs"
                    now, out, place = file, container.RecordFile(where, self.attempt, name, codes.VERSION), place + 1
                out.add(packing.record(*record))
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 5]
        rows = [r for m in messages if m for r in m.rows]
        names = [x.split()[0] for x in container.INDEX.split(", ")]
        os.makedirs(f"{self.attempt}/_index", exist_ok=True)
        columns = list(zip(*rows)) or [[]] * len(names)
        pq.write_table(pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names), f"{self.attempt}/_index/part-0.parquet")
        os.makedirs(f"{self.folder}/{LOG}", exist_ok=True)
        while True:
            n = max((int(x) for x in os.listdir(f"{self.folder}/{LOG}") if x.isdigit()), default=0) + 1
            if put_local(f"{self.folder}/{LOG}/{n:020d}", os.path.basename(self.attempt)):
                return

    def abort(self, messages: list[Written | None]) -> None:
        """No log entry names the attempt; ``commits.vacuum`` takes it away."""


class ContainerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "basewright"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Records:
        if unknown := set(schema.names) - {x.split()[0] for x in SCHEMA.split(", ")}:
            raise ValueError(f"Containers have no {', '.join(sorted(unknown))}")
        return Records(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> Attempt:
        return Attempt(schema, self.options, overwrite)


@F.udtf(returnType=T.StructType().add("rec_no", "long").add("description", "string").add("sequence", "string").add("nuc", "string"), useArrow=False)
class ContainerRecords:
    """Records of one file from front to back; a lateral join over a table of files reads them in as many tasks as it has."""

    def eval(self, path: str):
        for number, (description, tag, enc, n, payload, runs) in enumerate(container.piece_records(complete(path), None, 0, None, None), 1):
            yield number, description, packing.unpacked(payload, n, enc, tag, [(r["start"], r["len"]) for r in runs]), NUC[tag]


@F.pandas_udf(T.BinaryType())
def record_bytes(description: pd.Series, sequence: pd.Series, nuc: pd.Series) -> pd.Series:
    return pd.Series([packing.record(*row) for row in zip(description, sequence, nuc)], dtype=object)


@F.pandas_udf(T.StringType())
def record_encoding(sequence: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else packing.encoding_of(np.frombuffer(s.replace("\n", "").encode(), np.uint8)) for s in sequence], dtype=object)


def register(spark: SparkSession) -> None:
    """The source ``basewright``, the table function ``container_records(path)`` and the functions ``record_bytes(description, sequence, nuc)`` and ``record_encoding(sequence)``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ContainerSource)
    spark.udtf.register("container_records", ContainerRecords)
    spark.udf.register("record_bytes", record_bytes)
    spark.udf.register("record_encoding", record_encoding)
