"""Token-ID output: whole texts to Huffman-coded binary files in ascending doc_id order, and back.

Spark range-partitions the texts by id; every partition becomes one file. One pass encodes the texts and keeps
the ids (compressed, on executor disks, recomputed if an executor is lost) while counting ids per task; the
counts of the whole corpus give one code for all files; a second pass writes the files.

Defined cases: a null text is an empty one and has just the end id; null ids come first; rows with the same id
keep one entry each, ordered by text; no rows give no files and an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import huffman, storage
from .common import Workspace, document_text, partitions
from .subwords import MANY, coder, tokenizer_path

#: Texts in one Arrow batch of ids are flushed at this many bytes.
BATCH_BYTES = 4 << 20
ENCODED = "doc_id long, ids binary, n_tokens long"
RESULT = "doc_id long, n_tokens long, ids_crc32 long, file string, position long, row long"


def in_order(docs: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id and whole text, range-partitioned and sorted by doc_id, then text."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), document_text(docs).alias("text"))
    return texts.repartitionByRange(n or partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")


def tokenise(texts: DataFrame, path: str) -> DataFrame:
    """Adds the ids of each text, with the end id, as compressed little-endian numbers."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = coder(path, MANY), zstandard.ZstdCompressor(level=1)
        for batch in source:
            docs, ids, counts, held = [], [], [], 0
            for doc, found in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1))):
                docs.append(doc)
                counts.append(len(found))
                ids.append(pack.compress(found.tobytes()))
                held += len(ids[-1])
                if held > BATCH_BYTES:
                    yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "ids", "n_tokens"])
                    docs, ids, counts, held = [], [], [], 0
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(ids, pa.binary()), pa.array(counts, pa.int64())], ["doc_id", "ids", "n_tokens"])

    return texts.mapInArrow(run, ENCODED)


def id_counts(encoded: DataFrame, size: int, dtype: str) -> np.ndarray:
    """How often each id occurs in the corpus: summed per task, then by id. The result has one number per id."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, unpack = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in source:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(unpack.decompress(ids.as_py()), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size, np.int64)
    out[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, limit: int = 16, files: int | None = None) -> DataFrame:
    """Writes the files and returns the manifest: part, file, documents, tokens, bytes."""
    path = tokenizer or tokenizer_path()
    words = coder(path, MANY)
    size, dtype = words.size, words.dtype.str
    encoded = tokenise(in_order(docs, files), path).persist(StorageLevel.DISK_ONLY)
    lengths = huffman.code_lengths(id_counts(encoded, size, dtype), limit)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, unpack = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor()
        for batch in source:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    writer = huffman.Writer(storage.Output(folder, f"tokens-{part:06d}.huf"), lengths, limit)
                writer.write(doc, np.frombuffer(unpack.decompress(ids.as_py()), dtype))
        if writer is not None:
            writer.close()
            yield pa.record_batch([pa.array([x]) for x in (part, f"tokens-{part:06d}.huf", len(writer.docs), writer.tokens, writer.out.size)], ["part", "file", "documents", "tokens", "bytes"])

    work = Workspace(docs.sparkSession, "", folder)
    manifest = work.save(encoded.select("doc_id", "ids").mapInArrow(run, "part long, file string, documents long, tokens long, bytes long"), "manifest")
    encoded.unpersist()
    return manifest


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of the files: its tokens, their CRC32 as unsigned 32-bit numbers, and its place."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for name in batch.column(0).to_pylist():
                rows, at = [], 0
                with storage.reader(folder, name) as file:
                    for row, (doc, n, runs) in enumerate(huffman.read_documents(file)):
                        crc = 0
                        for ids in runs:
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        rows.append((doc, n, crc, name, at, row))
                        at += n
                for k in range(0, len(rows), 10_000):
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000]), (pa.int64(),) * 3 + (pa.string(),) + (pa.int64(),) * 2)], ["doc_id", "n_tokens", "ids_crc32", "file", "position", "row"])

    manifest = spark.read.parquet(f"{folder}/manifest")
    base = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(base, F.lit(0)).alias("base"))  # one row per file
    rows = manifest.select("file").repartition(partitions(spark), "file").mapInArrow(run, RESULT)
    return rows.join(F.broadcast(files) if files.count() <= 100_000 else files, "file").select(
        "doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32", "file", "position"
    )


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark, "token-files").path
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return read_token_files(spark, folder)


QUERIES = {"op1_token_files": op1_token_files}
SQL: dict[str, str] = {}
