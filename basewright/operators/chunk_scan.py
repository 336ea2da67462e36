"""Containers and legacy files as rows of chunks: long records are unpacked by many tasks, and none is ever one value.

Pieces of files (see ``container.pieces``) are followed once from front to back, which checks every record's checksum. Records of
no more than a chunk come out of that at once. Of longer ones only the places of code and lower-case runs are kept;
a second pass unpacks each chunk where its bytes lie. Runs are read in pieces of ``RUNS``, cut at the borders of chunks and sent to
their chunk, where they follow its row in order and are applied one piece after the other, so a task holds one chunk at a time.

Defined cases: an empty record is one empty chunk; runs may come in any order, overlap, and reach past the record's end, where they
are cut; a missing folder is an error, no files give no rows. A record of a legacy file is framed whole, as its end is found by
its digits, and cut into chunks after that. Errors are those of ``container.read_raw`` in all three modes; records of a piece before
its first error are whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import packing
from ..sources import container
from ..sources.framing import BATCH, Broken, Bytes, is_container, legacy_records, listed_records, opened, placed_record
from .chunks import SIZE, saved

#: Runs of lower case that are dealt to chunks at once.
RUNS = 1 << 16
#: A chunk begins at a whole byte in all encodings.
EVEN = 8
CHUNK = "file string, rec_no long, chunk_no long, start long, n long, description string, nuc string, data binary, error string"
#: After a chunk's columns, the places in the file of a longer record's code and runs.
PLACED = f"{CHUNK}, tag string, enc string, n_bases long, code_at long, runs_at long, runs long"
NAMES = [x.split()[0] for x in PLACED.split(", ")]
TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
KINDS = [TYPES[x.split()[1]] for x in PLACED.split(", ")]
NUC = {"D": "DNA", "R": "RNA"}
DEALT = "file string, rec_no long, chunk_no long, turn long, mask binary"


def batch(rows: list[tuple], n: int | None = None) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), KINDS[:n])], NAMES[:n])


def pairs(data: bytes) -> np.ndarray:
    """Rows of start and length."""
    return np.frombuffer(data, "<u4").reshape(-1, 2).astype(np.int64)


def lowered(symbols: np.ndarray, runs: np.ndarray) -> None:
    """Lower-cases letters within runs (rows of start and length, cut at both ends) in place."""
    n = len(symbols)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(runs[:, 0], 0, n), 1)
    np.add.at(edge, np.clip(runs.sum(axis=1), 0, n), -1)
    inside = np.cumsum(edge[:-1]) > 0
    symbols[inside & (symbols >= ord("A")) & (symbols <= ord("Z"))] += 32


def symbols_of(payload: bytes, n: int, enc: str, tag: str) -> np.ndarray:
    return np.frombuffer(packing.unpacked(payload, n, enc, tag).encode(), np.uint8).copy()


def chunk_rows(file: str, rec_no: int, description: str, tag: str, symbols: np.ndarray, size: int) -> Iterator[tuple]:
    for k, start in enumerate(range(0, max(1, len(symbols)), size)):
        data = symbols[start : start + size].tobytes()
        yield (file, rec_no, k, start, len(data), description if k == 0 else None, NUC[tag], data, *[None] * 7)


def piece_rows(file: str, version: int | None, first: int, offset: int, limit: int | None, many: int | None, size: int) -> Iterator[tuple[int, list[tuple]]]:
    """Numbers of a piece's records and their rows: chunks, or one with the places of a longer record."""
    where, name = opened(file)
    with where.open_input_file(name) as stream:
        if version is not None:
            stream.seek(offset)
        data = Bytes(stream, offset, limit if version is not None else None)
        if version is None:
            data.back(len(head := data.some(5)))
            version, many = (2, listed_records(data)) if is_container(head) else (1, None)
        if version == 1:
            for n, (description, tag, enc, length, payload, _) in enumerate(islice(legacy_records(data), many), first):
                per = size // 2
                for k in range(max(1, -(-length // size))):
                    part = symbols_of(payload[k * per : (k + 1) * per], min(size, length - k * size), enc, tag).tobytes()
                    yield n, [(file, n, k, k * size, len(part), description if k == 0 else None, NUC[tag], part, *[None] * 7)]
            return
        for n in range(first, first + many):
            description, tag, enc, length, payload, code_at, runs, runs_at, runs_size = placed_record(data, 8 * size)
            if length > size or payload is None or runs is None:
                yield n, [(file, n, None, None, None, description, NUC[tag], None, None, tag, enc, length, code_at, runs_at, runs_size // 8)]
                continue
            symbols = symbols_of(payload, length, enc, tag)
            if runs:
                lowered(symbols, pairs(runs))
            yield n, list(chunk_rows(file, n, description, tag, symbols, size))


def placed(pieces: DataFrame, size: int, mode: str) -> DataFrame:
    """PLACED rows of pieces."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in source:
            for file, version, first, offset, limit, many in zip(*(c.to_pylist() for c in rows.columns)):
                n, done, held = first - 1, [], 0
                try:
                    for n, found in piece_rows(file, version, first, offset, limit, many, size):
                        done += found
                        held += sum(len(r[5] or "") + len(r[7] or b"") + 256 for r in found)
                        if held > BATCH:
                            yield batch(done)
                            done, held = [], 0
                except (Broken, UnicodeDecodeError) as e:
                    if mode == "FAILFAST":
                        raise Broken(f"{file}, record {n + 1}: {e}") from e
                    if mode == "PERMISSIVE":
                        done.append((file, n + 1, *[None] * 6, str(e), *[None] * 6))
                if done:
                    yield batch(done)

    return pieces.mapInArrow(run, PLACED)


def dealt_runs(long: DataFrame, size: int, tasks: int, runs: int = RUNS) -> DataFrame:
    """DEALT: runs of longer records as pairs of start and length in a chunk; those of a piece of runs are joined where they touch."""
    rows = long.where("runs > 0").select("file", "rec_no", "n_bases", "runs_at", "runs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1, F.lit(runs).cast("long"))).alias("at"))
    rows = rows.select("file", "rec_no", "n_bases", (F.col("runs_at") + 8 * F.col("at")).alias("at"), F.least(F.lit(runs), F.col("runs") - F.col("at")).alias("many"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in source:
            for file, rec_no, n, at, many in zip(*(c.to_pylist() for c in part.columns)):
                where, name = opened(file)
                with where.open_input_file(name) as stream:
                    stream.seek(at)
                    found = pairs(stream.read(8 * many))
                out: list[tuple] = []
                for chunk, mask in by_chunk(found, n, size):
                    out.append((file, rec_no, chunk, 1, mask))
                    if len(out) == 1000:
                        yield dealt(out)
                        out = []
                if out:
                    yield dealt(out)

    def dealt(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 3, pa.binary()))], [x.split()[0] for x in DEALT.split(", ")])

    return rows.repartition(tasks, "file", "rec_no", "at").mapInArrow(run, DEALT)


def by_chunk(runs: np.ndarray, n: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Numbers of the chunks that runs of a record of n symbols touch, and their runs there."""
    begin, end = runs[:, 0], np.minimum(runs.sum(axis=1), n)
    begin, end = begin[begin < end], end[begin < end]
    if not len(begin):
        return
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > reach[:-1]])  # runs that overlap or touch are one
    begin, end = begin[new], reach[np.concatenate([new[1:], [True]])]
    low, high = begin // size, (end - 1) // size
    for chunk in np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(*np.unique(np.stack([low, high]), axis=1))])).tolist():
        own = slice(np.searchsorted(high, chunk), np.searchsorted(low, chunk, "right"))
        a, b = np.maximum(begin[own], chunk * size), np.minimum(end[own], (chunk + 1) * size)
        yield chunk, np.stack([a - chunk * size, b - a], axis=1).astype("<u4").tobytes()


def unpacked(long: DataFrame, size: int, tasks: int, runs: int = RUNS) -> DataFrame:
    """CHUNK rows of longer records."""
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n_bases") - 1, F.lit(0)) / size))).alias("chunk_no")
    rows = long.select("file", "rec_no", chunk, F.lit(0).cast("long").alias("turn"), F.lit(None).cast("binary").alias("mask"), "description", "tag", "enc", "n_bases", "code_at")
    rows = rows.withColumn("description", F.when(F.col("chunk_no") == 0, F.col("description")))
    rows = rows.unionByName(dealt_runs(long, size, tasks, runs), allowMissingColumns=True)
    rows = rows.repartition(tasks, "file", "rec_no", "chunk_no").sortWithinPartitions("file", "rec_no", "chunk_no", "turn")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, symbols = None, None
        for part in source:
            for file, rec_no, chunk, turn, mask, description, tag, enc, n, at in zip(*(c.to_pylist() for c in part.columns)):
                if turn:
                    lowered(symbols, pairs(mask))
                    continue
                if now is not None:
                    yield batch([(*now, symbols.tobytes(), None)], 9)
                start, bits = chunk * size, packing.BITS[enc]
                many = min(size, n - start)
                where, name = opened(file)
                with where.open_input_file(name) as stream:
                    stream.seek(at + start * bits // 8)
                    payload = stream.read(-(-many * bits // 8))
                now, symbols = (file, rec_no, chunk, start, many, description, NUC[tag]), symbols_of(payload, many, enc, tag)
        if now is not None:
            yield batch([(*now, symbols.tobytes(), None)], 9)

    return rows.select("file", "rec_no", "chunk_no", "turn", "mask", "description", "tag", "enc", "n_bases", "code_at").mapInArrow(run, CHUNK)


def read_chunks(spark: SparkSession, path: str | list[str], size: int = SIZE, mode: str = "FAILFAST", span: int | None = None, back: int = 0, runs: int = RUNS) -> DataFrame:
    """file, rec_no, chunk_no, start, n, description (in a record's first chunk), nuc, data; with PERMISSIVE also error.

    size: symbols of a chunk, a multiple of 8. path, mode, span and back are those of ``container.read_raw``. The rows are written
    to the shared folder between the two passes.
    """
    if mode not in ("FAILFAST", "PERMISSIVE", "DROPMALFORMED"):
        raise ValueError(f"Unknown mode {mode}")
    if size < EVEN or size % EVEN:
        raise ValueError(f"Size {size} of chunks is not a multiple of {EVEN}")
    span = span or spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    rows = saved(placed(container.in_tasks(container.pieces(spark, path, span, back), span), size, mode), "placed")
    columns = [x.split()[0] for x in CHUNK.split(", ")][: None if mode == "PERMISSIVE" else -1]
    whole, long = rows.where("n_bases is null"), rows.where("n_bases is not null")
    symbols = long.agg(F.sum("n_bases"), F.count("*")).first()
    if not symbols[1]:
        return whole.select(*columns)
    tasks = max(1, -(-(symbols[0] or 0) // span))
    return whole.select(*columns).union(unpacked(long, size, tasks, runs).select(*columns))
