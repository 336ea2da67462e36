"""The editable text form of records: rendering, parsing, checking and saving.

A record is a header line ``>description | NUC=type | ENC=encoding``, lines of sequence, and an empty line. Lines
that begin with ``#`` are comments anywhere. Of a header with `` | `` only the first part is the description.

Files are read in blocks, which may begin inside of a record. What a block's lines do to the parser is one small row: how
many headers they hold, and whether a record is open after them or whether that is as before. Rows of the blocks before say
in what state a block begins, so that only these rows, and never lines, are put in order over a file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bases
from . import commits, container, fasta
from .scratch import scratch

WRAP = 80
HEAD = "# Sequence records as text\n# Headers begin with '>' and may end in '| NUC=DNA' or '| NUC=RNA'\n# An empty line ends a record; degenerate codes and lower case are kept\n"
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def rendered(description: Column, sequence: Column, nuc: Column, width: int = WRAP) -> Column:
    """One record as text, without the empty line after it. The encoding shown is what a container would use (4b where none fits)."""
    enc = F.coalesce(bases.encoding(sequence, strict=False), F.lit("4b"))
    head = F.concat(F.lit(">"), F.coalesce(description, F.lit("")), F.lit(" | NUC="), nuc, F.lit(" | ENC="), enc)
    return F.concat_ws("\n", head, F.nullif(fasta.wrapped(bases.text(sequence), width), F.lit("")))


def write_edit_text(records: DataFrame, path: str, width: int = WRAP) -> None:
    """Text files of records (file, rec_no, description, sequence, nuc) in order; every file begins with the comment lines."""
    rows = records.repartitionByRange("file", "rec_no").sortWithinPartitions("file", "rec_no")
    text = F.concat(rendered(F.col("description"), F.col("sequence"), F.col("nuc"), width), F.lit("\n"))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows.select(F.concat(F.when(first, HEAD).otherwise(""), text).alias("value")).write.text(path)


def stripped(s: Column) -> Column:
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def parse(texts: DataFrame, carry: bool = False) -> DataFrame:
    """texts: file, text. Rows of file, rec_no, description, sequence, nuc_hint, problem (null if there is none).

    Sequence lines outside of a record are a problem, or with ``carry`` the beginning of the next record. A file
    without records is one row with a problem.
    """
    lines = texts.select("file", F.posexplode(F.split(F.coalesce("text", F.lit("")), BREAKS, -1)).alias("at", "line"))
    lines = lines.where(~F.col("line").startswith("#"))
    head, empty = F.col("line").startswith(">"), F.col("line") == ""
    so_far = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.select("file", "at", "line", head.alias("head"), F.count_if(head).over(so_far).alias("heads"), (F.coalesce(F.max(F.when(empty, F.col("at"))).over(so_far), F.lit(-1)) > F.coalesce(F.max(F.when(head, F.col("at"))).over(so_far), F.lit(-1))).alias("closed"))
    outside = ~F.col("head") & (F.col("closed") | (F.col("heads") == 0))
    lines = lines.withColumn("rec_no", F.col("heads") + outside.cast("int"))
    piece = F.when(~F.col("head"), F.struct("at", stripped(F.col("line")).alias("s")))
    stray = F.bool_or(outside & (F.col("line") != "")).alias("stray")
    records = lines.groupBy("file", "rec_no").agg(F.max(F.when(F.col("head"), F.col("line"))).alias("line"), F.array_sort(F.collect_list(piece)).alias("pieces"), stray)
    return finished(records, texts.select("file"), carry)


def finished(records: DataFrame, files: DataFrame, carry: bool) -> DataFrame:
    """records: file, rec_no, line (the header, null for what follows the last record), pieces (structs with lines s in order), stray (any outside of a record); files: all of them."""
    header = stripped(F.substring("line", 2, 1 << 30))
    parts = F.split(header, r" \| ", -1)
    named = F.contains(header, F.lit(" | "))
    hints = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.upper(stripped(p)))
    hints = F.transform(F.filter(hints, lambda p: p.startswith("NUC=")), lambda p: stripped(F.substring(p, 5, 1 << 30)))
    hints = F.filter(hints, lambda h: h.isin("DNA", "RNA"))
    sequence = F.translate(F.array_join(F.transform("pieces", lambda p: p["s"]), ""), " \t", "")
    out = records.select(
        "file", F.col("rec_no").cast("long").alias("rec_no"), F.when(named, stripped(F.get(parts, F.lit(0)))).otherwise(header).alias("description"),
        sequence.alias("sequence"), F.when(named, F.get(hints, F.size(hints) - 1)).alias("nuc_hint"), "stray", "line",
    )
    problem = F.when(F.col("line").isNull(), F.when(F.col("stray"), "Sequence after the last record"))
    problem = problem.when(F.lit(not carry) & F.col("stray"), "Sequence outside of a record").when(F.col("sequence") == "", "Record has no sequence")
    out = out.withColumn("problem", problem)
    # a row without header is what no record takes up: only a problem, and none where it may be dropped
    out = out.where(F.col("line").isNotNull() | (F.col("problem").isNotNull() & F.lit(not carry))).drop("stray", "line")
    none = files.join(out.where(F.col("description").isNotNull()).select("file").distinct(), "file", "left_anti")
    empty_rows = none.select("file", F.lit(0).cast("long").alias("rec_no"), *[F.lit(None).cast("string").alias(c) for c in ("description", "sequence", "nuc_hint")], F.lit("No records").alias("problem"))
    return out.unionByName(empty_rows)


#: Bytes of sequence that a block hands on at once.
PIECE = 1 << 20
SEGMENT = [("file", pa.string()), ("block", pa.int64()), ("part", pa.int64()), ("heads", pa.int64()), ("open", pa.bool_()), ("line", pa.string()), ("s", pa.string()), ("stray", pa.bool_())]


def segments(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, block, value) to parts of a block that lie between headers and empty lines.

    heads: headers of the block so far. open: whether the part is in a record; null before the block's first header or empty line. line: a
    header, in a part of its own. s: stripped lines. stray: whether a line of the part is not empty.
    """
    breaks = re.compile(BREAKS)
    at, part, heads, open_, held, size = None, 0, 0, None, [], 0
    done: list[tuple] = []

    def put(line: str | None = None) -> None:
        nonlocal part, held, size
        done.append((*at, part, heads, open_, line, "".join(held), bool(held)))
        part, held, size = part + 1, [], 0

    def table() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, t) for c, (_, t) in zip(zip(*done), SEGMENT)], [n for n, _ in SEGMENT])
        done.clear()
        return out

    for batch in source:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, block) != at:
                if held:
                    put()
                at, part, heads, open_ = (file, block), 0, 0, None
            for line in breaks.split(str(value, "utf-8", "replace").removesuffix("\r")):
                if line.startswith("#"):
                    continue
                if line == "" or line.startswith(">"):
                    if held:
                        put()
                    open_ = line != ""
                    if open_:
                        heads += 1
                        put(line)
                    elif not done or done[-1][:2] != at or done[-1][4] is not False:
                        put()
                    continue
                held.append(line.strip())
                size += len(line)
                if size > PIECE:
                    put()
        if sum(len(d[6]) for d in done) > PIECE or len(done) > 5000:
            yield table()
    if held:
        put()
    if done:
        yield table()


def parse_blocks(lines: DataFrame, files: DataFrame, carry: bool = False) -> DataFrame:
    """The same as ``parse`` for lines of blocks: file, block, value (binary). A block's lines follow each other in one partition; blocks of a file are in order of their numbers, wherever they are.

    files: file, of all files, also those without lines.
    """
    spark, path = lines.sparkSession, scratch(lines.sparkSession, "edit-text-parts")
    kinds = "file string, block long, part long, heads long, open boolean, line string, s string, stray boolean"
    lines.select("file", "block", "value").mapInArrow(segments, kinds).write.parquet(path)
    rows = spark.read.schema(kinds).parquet(path)
    own = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    after = F.max_by("open", F.when(F.col("open").isNotNull(), F.col("part")))
    blocks = rows.groupBy("file", "block").agg(F.max("heads").alias("n"), after.alias("after"))
    blocks = blocks.select("file", "block", F.coalesce(F.sum("n").over(own), F.lit(0)).alias("before"), F.coalesce(F.last("after", ignorenulls=True).over(own), F.lit(False)).alias("opened"))
    rows = rows.join(blocks, ["file", "block"])
    outside = ~F.coalesce("open", "opened")
    rows = rows.select("file", "block", "part", "line", "s", (F.col("heads") + F.col("before") + outside.cast("int")).alias("rec_no"), (outside & F.col("stray")).alias("stray"))
    pieces = F.array_sort(F.collect_list(F.when(F.col("s") != "", F.struct("block", "part", "s"))))
    return finished(rows.groupBy("file", "rec_no").agg(F.max("line").alias("line"), pieces.alias("pieces"), F.bool_or("stray").alias("stray")), files, carry)


def read_edit_text(spark: SparkSession, path: str | list[str], carry: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """Records of text files of any size as file, rec_no, description, sequence, nuc_hint, nuc; PERMISSIVE adds their problems, FAILFAST stops at one. Only a record is one value.

    Files of no bytes give no row, as Spark's file sources leave them out; a file of comments is one row with a problem.
    """
    path = [commits.qualified(spark, p) for p in ([path] if isinstance(path, str) else path)]
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"))  # contents are not read
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    rows = parse_blocks(lines, files, carry).withColumn("nuc", bases.nucleotide(F.col("sequence"), F.col("nuc_hint")))
    if mode == "PERMISSIVE":
        return rows
    error = F.raise_error(F.concat("file", F.lit(", record "), "rec_no", F.lit(": "), "problem")).cast("string")
    return rows.withColumn("sequence", F.when(F.col("problem").isNull(), F.col("sequence")).otherwise(error)).drop("problem")


def unfit() -> Column:
    """Why a record is not fit to be saved: an empty description or sequence, or an unknown type; null if it is."""
    reason = F.when(F.coalesce("description", F.lit("")) == "", "empty description").when(F.coalesce("sequence", F.lit("")) == "", "empty sequence")
    return reason.when(~F.coalesce(F.col("nuc").isin("DNA", "RNA"), F.lit(False)), "unknown type")


def violations(records: DataFrame) -> DataFrame:
    """Records that are not fit to be saved, with the reason."""
    return records.select("file", "rec_no", unfit().alias("reason")).where(F.col("reason").isNotNull())


def save(records: DataFrame, folder: str, version: int = 2) -> DataFrame:
    """Writes containers, reads and checks them, and only then commits them; ``commits.restore`` brings back what was there before."""
    spark = records.sparkSession

    def check(path: str) -> None:
        n, bad = container.read_records(spark, path).agg(F.count("*"), F.count_if(unfit().isNotNull())).first()
        if not n or bad:
            raise ValueError(f"{n} records were written, of which {bad} are not valid; {folder} is as it was")

    container.write_records(records, folder, version, check=check)
    return container.read_records(spark, folder)
