"""Command line: convert FASTA files, compare storage variants, show and encode edit text, check containers.

    python -m basewright convert x.fasta [out] [--version 1 | --long]
    python -m basewright compare x.fasta
    python -m basewright show folder
    python -m basewright encode text folder [--version 1]
    python -m basewright check folder
    python -m basewright compress path folder [--method pigz] [--threads 4] [--decompress] [--replace]

convert writes to a folder beside the input, x.seqs, if none is named; --long does so by chunks, for records of any length. --log-level, before the command, sets how much Spark logs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import convert, integrity, sizes
from .sources import compressed, container, edit_text, fasta

SHOWN = 10


def run_convert(spark: SparkSession, args: argparse.Namespace) -> int:
    output = args.output or spark.range(1).select(compressed.output_name(F.lit(args.input))).first()[0]
    done = convert.convert_long(spark, args.input, output) if args.long else convert.convert_fasta(spark, args.input, output, args.version)
    if done.mixed:
        print(f"{done.mixed} records hold both T and U, of which one letter is kept; the first are:")
        done.mixed_rows.orderBy("file", "rec_no").limit(SHOWN).show(truncate=False)
    summary = done.summary.first()
    print("\n".join(f"{name}: {summary[name]}" for name in done.summary.columns))
    if summary["any_issue"]:
        integrity.first_details(done.details, SHOWN).show(truncate=False)
    return int(summary["any_issue"])


def run_compare(spark: SparkSession, args: argparse.Namespace) -> int:
    records = convert.with_types(fasta.read_fasta(spark, args.input))
    total = sizes.total_bases(records).first()[0]
    sizes.bases_per_byte(sizes.variant_sizes(records).where("size_bytes > 0"), total).orderBy("method").show(truncate=False)
    return 0


def run_show(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = container.read_records(spark, args.input)
    print(edit_text.HEAD)
    for row in rows.orderBy("file", "rec_no").select(edit_text.rendered(F.col("description"), F.col("sequence"), F.col("nuc"))).toLocalIterator():
        print(row[0], end="\n\n")
    return 0


def run_encode(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = edit_text.save(edit_text.read_edit_text(spark, args.input), args.output, args.version)
    print(f"{rows.count()} records")
    return 0


def run_check(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = container.read_records(spark, args.input, "PERMISSIVE")
    bad = edit_text.violations(rows.where("error IS NULL")).unionByName(rows.where("error IS NOT NULL").select("file", "rec_no", F.col("error").alias("reason")))
    n = bad.count()
    bad.orderBy("file", "rec_no").limit(SHOWN).show(truncate=False)
    print(f"{rows.where('error IS NULL').count()} records, {n} problems")
    return int(n > 0)


def run_compress(spark: SparkSession, args: argparse.Namespace) -> int:
    compressed.compress_files(spark, args.input, args.output, args.method, args.decompress, args.threads, keep=not args.replace).show(truncate=False)
    return 0


COMMANDS = {"convert": (run_convert, True), "compare": (run_compare, False), "show": (run_show, False), "encode": (run_encode, True), "check": (run_check, False), "compress": (run_compress, True)}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="basewright", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--log-level", choices=("ALL", "TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "OFF"))
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (_, writes) in COMMANDS.items():
        sub = commands.add_parser(name)
        sub.add_argument("input")
        if writes:
            sub.add_argument("output", nargs="?" if name == "convert" else None)
        if name == "compress":
            sub.add_argument("--method", choices=tuple(compressed.SUFFIXES), default="pigz")
            sub.add_argument("--threads", type=int, default=1)
            sub.add_argument("--decompress", action="store_true")
            sub.add_argument("--replace", action="store_true")
        elif writes:
            form = sub.add_mutually_exclusive_group()
            form.add_argument("--version", type=int, choices=(1, 2), default=2)
            if name == "convert":
                form.add_argument("--long", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName("basewright").getOrCreate()
    if args.log_level:
        spark.sparkContext.setLogLevel(args.log_level)
    return COMMANDS[args.command][0](spark, args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
