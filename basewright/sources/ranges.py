"""One container file in many tasks: byte ranges of whole records.

The sink leaves a block index beside its files. For files of others, which only checksums divide into records, the
index is found here. Every range of a file is searched for the first place from which blocks can be followed until a
checksum closes a record; from there records are followed to the end of the range. Such a place may be a lie: a payload
may hold a whole record with its checksum. So a range counts only if it begins just where the range before it has ended;
a range that does not is followed again from there, until all agree. The first of them is mended for good each time, so
this ends, and after ``ROUNDS`` times a file's rest is followed in one piece. Records are the same as from front to back.

Ranges are rows of one table; one row a range is ordered by file, none a record.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes
from .framing import BATCH, Broken, Bytes, is_container, opened, placed_record
from .scratch import scratch

#: After so many rounds the rest of a file is one range. Bytes searched at once, and how many of them two searches share.
ROUNDS, WINDOW, OVERLAP = 4, 4 << 20, 1 << 16
TYPE_BLOCK = re.compile(rb"\x02\x01\x00\x00\x00[DR]")
FOUND = "file string, begin long, end long, size long, start long, records long, stop long, broken boolean, listed long"
NAMES = [x.split()[0] for x in FOUND.split(", ")]
HEAD = 12


def likely_starts(data: bytes) -> list[int]:
    """Places of a description block that a type block follows, as writers begin their records."""
    bytes_ = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(bytes_[:-11] == codes.BLOCK_DESCRIPTION) if len(bytes_) > 11 else np.array([], np.int64)
    length = sum(bytes_[at + k].astype(np.int64) << 8 * (k - 1) for k in range(1, 5))
    after = at + 5 + length
    inside = after <= len(bytes_) - 6
    at, after = at[inside], after[inside]
    good = np.ones(len(at), bool)
    for k, b in enumerate(b"\x02\x01\x00\x00\x00"):
        good &= bytes_[after + k] == b
    return at[good & np.isin(bytes_[after + 5], list(b"DR"))].tolist()


def first_record(stream, begin: int, end: int) -> int | None:
    """The first likely start in a range from which a checksum closes a record."""
    at = begin
    while at < end:
        stream.seek(at)
        data = Bytes(stream, at).some(WINDOW + OVERLAP)
        for k in likely_starts(data):
            if k < WINDOW and at + k < end:
                stream.seek(at + k)
                try:
                    placed_record(Bytes(stream, at + k), BATCH)
                except (Broken, UnicodeDecodeError):
                    continue
                return at + k
        at += WINDOW
    return None


def followed(stream, start: int | None, end: int) -> tuple[int, int | None, bool]:
    """Records from a start to the end of a range, where the last of them ends, and whether one is broken."""
    n, stop = 0, None
    if start is None:
        return n, stop, False
    stream.seek(start)
    data = Bytes(stream, start)
    stop = start
    while stop < end:
        try:
            placed_record(data, BATCH)
        except (Broken, UnicodeDecodeError):
            return n, stop, True
        n, stop = n + 1, data.place
    return n, stop, False


def searched(ranges: DataFrame, seek: bool) -> DataFrame:
    """ranges: file, begin, end, size, start. FOUND; seek: starts are found, not given."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for file, begin, end, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                where, name = opened(file)
                with where.open_input_file(name) as stream:
                    head = stream.read(HEAD)
                    if not is_container(head) or len(head) < HEAD:  # read from front to back, as are its errors
                        row = (None, 0, None, False, None)
                    else:
                        start = HEAD if begin == 0 else first_record(stream, begin, end) if seek else start
                        row = (start, *followed(stream, start, end), struct.unpack_from("<I", head, 8)[0])
                yield pa.record_batch([pa.array([v], t) for v, t in zip((file, begin, end, size, *row), (pa.string(), *[pa.int64()] * 6, pa.bool_(), pa.int64()))], NAMES)

    return ranges.select("file", "begin", "end", "size", "start").mapInArrow(run, FOUND)


def checked(found: DataFrame) -> DataFrame:
    """Adds due (where the range before has ended), lost (a record before is broken), first (number of its first record) and bad (begins elsewhere)."""
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    due = F.coalesce(F.max("stop").over(before), F.lit(HEAD))
    rows = found.withColumns({"due": due, "lost": F.coalesce(F.bool_or("broken").over(before), F.lit(False)), "first": 1 + F.coalesce(F.sum("records").over(before), F.lit(0))})
    fits = F.when(F.col("due") < F.col("end"), F.coalesce(F.col("start") == F.col("due"), F.lit(False))).otherwise(F.col("start").isNull())
    return rows.withColumn("bad", ~F.col("lost") & (F.col("begin") > 0) & F.col("listed").isNotNull() & ~fits)


def index_of(files: DataFrame, span: int) -> DataFrame:
    """files: file, size. file, version, first, offset, records: pieces of whole records of at most about span bytes. A file that is not a container is one piece without a number of records.

    The last piece of a file has as many records as the file's head lists, so that reading it finds what is missing.
    """
    spark = files.sparkSession
    tasks = lambda rows, n: rows.repartition(max(1, n), "file", "begin")
    ranges = files.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(span).cast("long"))).alias("begin"), "size")
    ranges = ranges.select("file", "begin", F.least(F.col("begin") + span, "size").alias("end"), "size", F.lit(None).cast("long").alias("start"))
    most = 4 * spark.sparkContext.defaultParallelism
    table = saved(spark, searched(tasks(ranges, most), True))
    for turn in range(1, 1 << 30):
        rows = checked(table)
        bad = rows.where("bad")
        if bad.isEmpty():
            break
        if turn < ROUNDS:
            again = bad.select("file", "begin", "end", "size", F.when(F.col("due") < F.col("end"), F.col("due")).alias("start"))
            kept = rows.where(~F.col("bad"))
        else:  # the rest of each file from its first range that is not right
            first = bad.groupBy("file").agg(F.min_by(F.struct("begin", "due", "size"), "begin").alias("f")).select("file", "f.*")
            again = first.select("file", "begin", F.col("size").alias("end"), "size", F.when(F.col("due") < F.col("size"), F.col("due")).alias("start"))
            kept = rows.join(first.select("file", F.col("begin").alias("cut")), "file", "left").where(F.col("cut").isNull() | (F.col("begin") < F.col("cut")))
        table = saved(spark, kept.select(*NAMES).union(searched(tasks(again, most), False)))
    rows = rows.where(~F.col("lost") & (F.col("listed").isNull() | (F.col("first") <= F.col("listed"))))
    plain = F.col("listed").isNull()
    last = (F.col("end") == F.col("size")) | F.col("broken")
    left = F.col("listed") - F.col("first") + 1
    records = F.when(last, left).otherwise(F.least("records", left))
    return rows.where((plain & (F.col("begin") == 0)) | (~plain & (records > 0))).select(
        "file", F.when(plain, None).otherwise(codes.VERSION).alias("version"), F.when(plain, 1).otherwise(F.col("first")).alias("first"),
        F.when(plain, 0).otherwise(F.when(last, F.coalesce("start", "due")).otherwise(F.col("start"))).alias("offset"), F.when(~plain, records).alias("records"),
    )


def saved(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = scratch(spark, "ranges")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
