"""Records of any length as rows of chunks: read, encoded and written without a whole sequence in one value.

A chunk is (file, rec_no, chunk_no, start, n, description, data): data are n symbols from place start of the record,
description is set in a record's first chunk only. What crosses a border between chunks is brought together by small
tables of border values: bytes that two or more chunks share (3-bit symbols straddle bytes), runs of lower case that
go on in the next chunk, and the checksum, which is put together from those of the parts. A record's parts are
(file, rec_no, place, bytes), place being the first byte's in the record; their bytes in order are ``packing.record`` of the whole.

Windows by record run over border values and sizes, one or two rows a chunk, never over symbols or runs.

Defined cases: blanks, tabs and line breaks are no symbols; a symbol outside the alphabet is an error; what stands before a file's
first header is left out; a header without sequence is a record of one empty chunk; no rows give an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codes, packing
from ..sources import commits, container
from ..sources.scratch import scratch

#: Symbols of a chunk, as a rule.
SIZE = 1 << 20
LOWER, DEGENERATE, UPPER_U, LOWER_U = 1, 2, 4, 8
BLANKS = b"\n\r \t"
POLYNOMIAL = 0xEDB88320
EDGE = T.StructType().add("at", T.LongType()).add("value", T.IntegerType())
RUN = T.StructType().add("start", T.LongType()).add("len", T.LongType())
PACKED = T.StructType().add("whole_at", T.LongType()).add("whole", T.BinaryType()).add("edges", T.ArrayType(EDGE)).add("runs", T.ArrayType(RUN))


def saved(rows: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Writes a table to a folder, by default one of its own, and reads it back."""
    path = f"{folder}/{name}" if folder else scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_fasta_chunks(spark: SparkSession, path: str | list[str], size: int = SIZE) -> DataFrame:
    """Chunks of about `size` symbols of FASTA files, which are split inside records, too."""
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    fields = [("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("local", pa.int64()), ("description", pa.string()), ("data", pa.binary())]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, part, local, name, held, n = None, 0, 0, None, [], 0
        done: list[tuple] = []

        def cut() -> None:
            nonlocal part, name, held, n
            if at is not None and (held or name is not None):
                done.append((*at, part, local, name, b"".join(held)))
                part, name, held, n = part + 1, None, [], 0

        for batch in source:
            for value, file, block in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    cut()
                    at, part, local, name, held, n = (file, block), 0, 0, None, [], 0
                if value.startswith(">"):
                    cut()
                    local, name = local + 1, value[1:].removesuffix("\r")
                    continue
                if data := value.encode().translate(None, BLANKS):
                    held.append(data)
                    n += len(data)
                    if n >= size:
                        cut()
            if sum(len(d[5]) for d in done) >= size or len(done) >= 1000:
                yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*done), fields)], [f for f, _ in fields])
                done.clear()
        cut()
        if done:
            yield pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*done), fields)], [f for f, _ in fields])

    rows = saved(lines.mapInArrow(run, "file string, block long, part long, local long, description string, data binary"), "fasta-chunks")
    # numbers of records from the counts of the blocks before, then places from the sizes of a record's chunks
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("file", "block").agg(F.max("local").alias("heads")).withColumn("before", F.coalesce(F.sum("heads").over(before), F.lit(0))).drop("heads")
    places = rows.select("file", "block", "part", "local", F.octet_length("data").cast("long").alias("n")).join(blocks, ["file", "block"])
    places = places.withColumn("rec_no", F.col("local") + F.col("before")).where("rec_no > 0")
    order = Window.partitionBy("file", "rec_no").orderBy("block", "part")
    start = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = places.select("file", "block", "part", "rec_no", (F.row_number().over(order) - 1).cast("long").alias("chunk_no"), start.alias("start"), "n")
    return rows.drop("local").join(places, ["file", "block", "part"]).select("file", "rec_no", "chunk_no", "start", "n", "description", "data")


def cut(records: DataFrame, size: Column | int = SIZE) -> DataFrame:
    """Chunks of records (file, rec_no, description, sequence)."""
    size = F.lit(size) if isinstance(size, int) else size
    text = F.translate(F.coalesce("sequence", F.lit("")), BLANKS.decode(), "")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0)), size)
    rows = records.select("file", "rec_no", F.coalesce("description", F.lit("")).alias("description"), text.alias("text"), size.alias("size"), F.posexplode(starts).alias("chunk_no", "start"))
    data = F.substring("text", F.col("start") + 1, F.col("size")).cast("binary")
    rows = rows.select("file", "rec_no", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("start").cast("long").alias("start"), F.octet_length(data).cast("long").alias("n"), F.when(F.col("chunk_no") == 0, F.col("description")).alias("description"), data.alias("data"))
    return rows


@F.pandas_udf(T.IntegerType())
def traits(data: pd.Series) -> pd.Series:
    """What a chunk says of its record's encoding and type, as bits; an error for symbols outside the alphabet."""

    def one(chunk: bytes) -> int:
        symbols = np.frombuffer(chunk, np.uint8)
        enc = packing.encoding_of(symbols)
        lower = enc == "3b" or (enc == "4b" and packing.lower_case(symbols).any())
        return LOWER * bool(lower) + DEGENERATE * (enc == "4b") + UPPER_U * (b"U" in chunk) + LOWER_U * (b"u" in chunk)

    return pd.Series([one(chunk) for chunk in data], dtype="int32")


@F.pandas_udf(PACKED)
def packed(data: pd.Series, start: pd.Series, enc: pd.Series) -> pd.DataFrame:
    """Whole bytes of a chunk's code, the bits of bytes that it may share with others, and its runs of lower case by places in the record."""

    def one(chunk: bytes, start: int, enc: str) -> tuple:
        symbols, bits = np.frombuffer(chunk, np.uint8), packing.BITS[enc]
        begin, end = start * bits, (start + len(symbols)) * bits
        flat = np.unpackbits(packing.DIGITS[enc][symbols][:, None], axis=1)[:, 8 - bits :].ravel()
        code = np.packbits(np.concatenate([np.zeros(begin % 8, np.uint8), flat]))
        first, low, high = begin // 8, -(-begin // 8), end // 8
        shared = {k for k, cut_ in ((first, begin % 8), (high, end % 8)) if cut_ and len(symbols)}
        edges = [{"at": k, "value": int(code[k - first])} for k in sorted(shared)]
        runs = packing.case_runs(symbols) if enc == "4b" else ()
        return low, code[low - first : max(low, high) - first].tobytes(), edges, [{"start": start + int(a), "len": int(n)} for a, n in runs]

    return pd.DataFrame([one(*row) for row in zip(data, start, enc)], columns=["whole_at", "whole", "edges", "runs"])


def shift_table() -> np.ndarray:
    """Row k: the images of the 32 bits of a checksum when 2**k zero bytes follow."""
    one_bit = np.array([POLYNOMIAL, *(1 << k for k in range(31))], np.uint64)  # bit 0 falls out and brings the polynomial
    squared = lambda m: np.array([applied(m, np.array([c], np.uint64))[0] for c in m], np.uint64)
    rows = [squared(squared(squared(one_bit)))]
    while len(rows) < 48:
        rows.append(squared(rows[-1]))
    return np.stack(rows)


def applied(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A matrix over two elements, by its columns, times each value."""
    out = np.zeros_like(values)
    for bit, column in enumerate(matrix):
        out ^= np.where(values >> np.uint64(bit) & np.uint64(1), column, np.uint64(0))
    return out


SHIFTS = shift_table()


def shifted(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What checksums of parts add to that of the whole when so many bytes come after them. The whole's is the exclusive or of all parts' shares."""
    out, after = crc.astype(np.uint64), after.astype(np.uint64)
    for k, matrix in enumerate(SHIFTS):
        if len(some := np.flatnonzero(after >> np.uint64(k) & np.uint64(1))):
            out[some] = applied(matrix, out[some])
    return out


@F.pandas_udf(T.LongType())
def checksum_share(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(shifted(crc.to_numpy(), after.to_numpy()).astype(np.int64))


@F.pandas_udf(T.BinaryType())
def head(description: pd.Series, rna: pd.Series, enc: pd.Series, n: pd.Series) -> pd.Series:
    """A record's bytes before its code."""

    def one(description: str, rna: bool, enc: str, n: int) -> bytes:
        described = (description or "").encode()
        return packing.block(codes.BLOCK_DESCRIPTION, len(described), described) + packing.block(codes.BLOCK_TYPE, 1, b"R" if rna else b"D") + packing.block(codes.BLOCK_OF[enc], int(n), b"")

    return pd.Series([one(*row) for row in zip(description, rna, enc, n)], dtype=object)


@F.pandas_udf(T.BinaryType())
def run_bytes(runs: pd.Series) -> pd.Series:
    return pd.Series([b"".join(struct.pack("<II", r["start"], r["len"]) for r in own) for own in runs], dtype=object)


@F.pandas_udf(T.BinaryType())
def little_endian(kind: pd.Series, value: pd.Series) -> pd.Series:
    """Four bytes of a number, after a block's kind where there is one."""
    return pd.Series([(bytes([int(k)]) if k >= 0 else b"") + struct.pack("<I", int(v)) for k, v in zip(kind, value)], dtype=object)


def facts(chunks: DataFrame) -> DataFrame:
    """file, rec_no, description, n, enc, rna of each record: letters u make it RNA, and so does a column nuc of that name in any of its chunks."""
    hint = F.coalesce(F.bool_or(F.upper("nuc").startswith("R")), F.lit(False)) if "nuc" in chunks.columns else F.lit(False)
    rows = chunks.withColumn("traits", traits("data")).groupBy("file", "rec_no").agg(F.max("description").alias("description"), F.sum("n").alias("n"), F.bit_or("traits").alias("traits"), hint.alias("hint"))
    has = lambda bit: F.col("traits").bitwiseAND(F.lit(bit)) > 0
    enc = F.when(has(DEGENERATE), "4b").when(has(LOWER), "3b").otherwise("2b")
    return rows.select("file", "rec_no", "description", "n", enc.alias("enc"), (has(UPPER_U) | has(LOWER_U) | F.col("hint")).alias("rna"))


def stitched(rows: DataFrame) -> DataFrame:
    """rows: file, rec_no, chunk_no, start, n, runs. file, rec_no, chunk_no, runs (those that begin in the chunk, in order), before (runs of the record in chunks before)."""
    touches = lambda r: (r["start"] == F.col("start")) | (r["start"] + r["len"] == F.col("start") + F.col("n"))
    edges = rows.select("file", "rec_no", "chunk_no", F.explode(F.filter("runs", touches)).alias("r")).select("file", "rec_no", "chunk_no", F.col("r.start").alias("at"), F.col("r.len").alias("len"))
    along = Window.partitionBy("file", "rec_no").orderBy("at")
    new = F.coalesce(F.lag(F.col("at") + F.col("len")).over(along) != F.col("at"), F.lit(True))
    edges = edges.withColumn("new", new.cast("long")).withColumn("run", F.sum("new").over(along))
    edges = edges.groupBy("file", "rec_no", "run").agg(F.min("at").alias("start"), F.sum("len").alias("len"), F.min("chunk_no").alias("chunk_no"))
    edges = edges.groupBy("file", "rec_no", "chunk_no").agg(F.collect_list(F.struct("start", "len")).alias("edges"))  # two at most
    none = F.array().cast("array<struct<start:long,len:long>>")
    inner = rows.select("file", "rec_no", "chunk_no", F.filter("runs", lambda r: ~touches(r)).alias("inner"))
    out = inner.join(edges, ["file", "rec_no", "chunk_no"], "left").select("file", "rec_no", "chunk_no", F.array_sort(F.concat("inner", F.coalesce("edges", none))).alias("runs"))
    out = saved(out.where(F.size("runs") > 0), "chunk-runs")
    before = Window.partitionBy("file", "rec_no").orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = out.select("file", "rec_no", "chunk_no", F.size("runs").cast("long").alias("k"))
    counts = counts.select("file", "rec_no", "chunk_no", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    return out.join(counts, ["file", "rec_no", "chunk_no"])


def case_runs(chunks: DataFrame) -> DataFrame:
    """file, rec_no, run_no, start, len of each run of lower-case letters."""
    found = chunks.select("file", "rec_no", "chunk_no", "start", "n", packed("data", "start", F.lit("4b")).alias("p")).select("file", "rec_no", "chunk_no", "start", "n", "p.runs")
    rows = stitched(saved(found, "runs")).select("file", "rec_no", "before", F.posexplode("runs").alias("k", "r"))
    return rows.select("file", "rec_no", (F.col("before") + F.col("k")).alias("run_no"), "r.start", "r.len")


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table of ours that nothing reads any more."""
    where, found = commits.located(spark, path)
    where.delete(found, True)


def parts(chunks: DataFrame) -> DataFrame:
    """file, rec_no, place, bytes, last: the records of chunks as a container holds them, in parts. A record's last part is its checksum."""
    folder = scratch(chunks.sparkSession, "record-parts")
    out = parts_of(saved(chunks, "chunks", folder), folder)
    dropped(chunks.sparkSession, f"{folder}/chunks")
    return out


def parts_of(chunks: DataFrame, folder: str) -> DataFrame:
    """The same for chunks that are a written table. The parts are tables in the folder."""
    key, spark = ["file", "rec_no"], chunks.sparkSession
    known = saved(facts(chunks), "facts", folder).withColumn("head", head("description", "rna", "enc", "n"))
    code = chunks.join(known.select(*key, "enc"), key).select(*key, "chunk_no", "start", "n", packed("data", "start", "enc").alias("p")).select(*key, "chunk_no", "start", "n", "p.*")
    code = saved(code, "code", folder)
    runs = stitched(code.where(F.size("runs") > 0).select(*key, "chunk_no", "start", "n", "runs"))
    many = runs.groupBy(*key).agg(F.sum(F.size("runs")).alias("many"))
    bits = F.when(F.col("enc") == "2b", 2).when(F.col("enc") == "3b", 3).otherwise(4)
    size = F.ceil(F.col("n") * bits / 8).cast("long")
    known = known.join(many, key, "left").withColumn("many", F.coalesce("many", F.lit(0)))
    known = saved(known.select(*key, "head", "many", F.octet_length("head").cast("long").alias("code_at"), (F.octet_length("head") + size).alias("runs_at")), "places", folder)
    known = known.withColumn("end", F.col("runs_at") + F.when(F.col("many") > 0, 5 + 8 * F.col("many")).otherwise(0))
    edges = code.select(*key, F.explode("edges").alias("e")).groupBy(*key, F.col("e.at").alias("at")).agg(F.bit_or("e.value").alias("value"))
    wholes = code.where(F.octet_length("whole") > 0).select(*key, F.col("whole_at").alias("at"), F.col("whole").alias("bytes"))
    wholes = wholes.union(edges.select(*key, "at", F.unhex(F.lpad(F.hex("value"), 2, "0"))))
    own = known.select(*key, F.lit(0).cast("long").alias("place"), F.col("head").alias("bytes"))
    own = own.union(known.where("many > 0").select(*key, "runs_at", little_endian(F.lit(codes.BLOCK_RUNS), 8 * F.col("many"))))
    own = own.union(wholes.join(known.select(*key, "code_at"), key).select(*key, F.col("code_at") + F.col("at"), "bytes"))
    own = own.union(runs.join(known.select(*key, "runs_at"), key).select(*key, F.col("runs_at") + 5 + 8 * F.col("before"), run_bytes("runs")))
    own = saved(own, "parts", folder)
    dropped(spark, f"{folder}/code")
    sums = own.select(*key, "place", F.crc32("bytes").alias("crc"), F.octet_length("bytes").alias("k")).join(known.select(*key, "end"), key)
    sums = sums.select(*key, "end", checksum_share("crc", F.col("end") - F.col("place") - F.col("k")).alias("share")).groupBy(*key, "end").agg(F.bit_xor("share").alias("crc"))
    sums = saved(sums.select(*key, F.col("end").alias("place"), little_endian(F.lit(-1), "crc").alias("bytes")), "checksums", folder)
    return own.withColumn("last", F.lit(False)).union(sums.withColumn("last", F.lit(True)))


def checksums(rows: DataFrame) -> DataFrame:
    """rows: of parts(). file, rec_no, crc, record_bytes."""
    digits = F.hex("bytes")
    crc = F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")
    return rows.where("last").select("file", "rec_no", crc.alias("crc"), (F.col("place") + 4).alias("record_bytes"))


def write_chunks(chunks: DataFrame, folder: str, files: int | None = None, inputs: list[str] = (), stored: bool = False) -> DataFrame:
    """Writes the records of chunks to a container folder, part by part, and returns the manifest. A record is in one file.

    stored: the chunks are a written table, of which no copy is made. Tables of parts are deleted when the files are committed.
    """
    spark = chunks.sparkSession
    work = scratch(spark, "record-parts")
    done = container.write_parts(parts_of(chunks if stored else saved(chunks, "chunks", work), work), folder, files=files, inputs=inputs)
    dropped(spark, work)
    return done
