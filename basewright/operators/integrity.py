"""Round-trip report: decoded records against the originals, by joins and one aggregation.

Frames: ``original`` and ``decoded``, both of rec_no, description, sequence and, where rec_no alone does not tell
records apart, file. Of originals with the same description the last counts. Long sequences are compared by SHA-256 first; equal hashes stand for
equal texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import count_symbol, text
from ..sources.scratch import scratch

CONTEXT = 20


def first_difference(a: Column, b: Column) -> Column:
    """Index of the first unequal symbol, the shorter length for a prefix, -1 if equal.

    The common prefix is found by halving: each step compares one block of the two texts.
    """
    n = F.least(F.length(a), F.length(b))
    zero = F.struct(F.lit(0).alias("low"), n.alias("high"))

    def step(s: Column, _: Column) -> Column:
        half = F.floor((s["low"] + s["high"] + 1) / 2).cast("int")
        size = half - s["low"]
        same = F.substring(a, s["low"] + 1, size) == F.substring(b, s["low"] + 1, size)
        return F.struct(F.when(same, half).otherwise(s["low"]).alias("low"), F.when(same, s["high"]).otherwise(half - 1).alias("high"))

    halvings = F.ceil(F.log2(n + 1)).cast("int") + 1
    found = F.aggregate(F.sequence(F.lit(1), halvings), zero, step, lambda s: s["low"])
    return F.when(a == b, -1).otherwise(found)


def mismatch_reason(original: Column, decoded: Column) -> Column:
    """Why the two differ; original is null if there is none."""
    same = F.translate(original, "U", "T") == F.translate(decoded, "U", "T")
    has = lambda s, x: F.contains(s, F.lit(x))
    differs = (has(original, "U") != has(decoded, "U")) | (has(original, "T") != has(decoded, "T"))
    return reason(original.isNull(), F.length(original) != F.length(decoded), same, has(original, "U") & has(original, "T"), differs)


def reason(missing: Column, sized: Column, same: Column, mixed: Column, differs: Column) -> Column:
    """sized: of unequal lengths; same: equal with T for U; mixed: the original has both; differs: one has letters T or U that the other has not."""
    return (
        F.when(missing, "desc-missing-in-original")
        .when(sized, "length-mismatch")
        .when(same & mixed, "mixed-T/U-in-original (lossy 0x4 nibble)")
        .when(same & differs, "global-T↔U-normalization")
        .when(same, "T/U-only-difference")
        .otherwise("base-content-mismatch")
    )


def context(sequence: Column, other: Column, at: Column) -> Column:
    """Symbols around a difference; the end is cut by the other sequence's length."""
    start = F.greatest(at - CONTEXT, F.lit(0))
    size = F.greatest(F.least(F.length(other), at + CONTEXT) - start, F.lit(0))
    return F.when(at < 0, "").otherwise(F.substring(sequence, start + 1, size))


def facts(records: DataFrame) -> DataFrame:
    """description, place (rec_no, in its file where there is one), hash and length of the sequence."""
    place = F.struct(*[c for c in ("file", "rec_no") if c in records.columns])
    return records.select("description", place.alias("place"), F.sha2("sequence", 256).alias("sha"), F.length("sequence").alias("size"))


def saved(records: DataFrame, name: str) -> DataFrame:
    """The facts as a written table: sequences are read and hashed once, and all counters and joins read these few columns."""
    spark, path, rows = records.sparkSession, scratch(records.sparkSession, name), facts(records)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def last_of_each(original: DataFrame) -> DataFrame:
    """original: facts. description with place, hash and length of its last record."""
    last = F.max_by(F.struct("place", "sha", "size"), "place")
    return original.groupBy("description").agg(last.alias("last")).select("description", *[F.col(f"last.{c}").alias(f"original_{c}") for c in ("place", "sha", "size")])


def compared(original: DataFrame, decoded: DataFrame) -> DataFrame:
    """Facts of decoded records with those of the last original of the description (null if none), whether the sequence and the pair are known, and whether it is equal."""
    known = original.groupBy("sha").agg(F.lit(True).alias("known"))
    pairs = original.groupBy("description", "sha").agg(F.lit(True).alias("paired"))
    rows = decoded.join(last_of_each(original), "description", "left").join(known, "sha", "left").join(pairs, ["description", "sha"], "left")
    return rows.withColumns({"known": F.coalesce("known", F.lit(False)), "paired": F.coalesce("paired", F.lit(False)), "equal": F.col("sha").eqNullSafe(F.col("original_sha"))})


class Report:
    """What came back of original records. Both frames are read and hashed once, when the report is made; summary and details read only the facts."""

    def __init__(self, original: DataFrame, decoded: DataFrame):
        self.records = original, decoded
        self.original, self.decoded = saved(original, "original-facts"), saved(decoded, "decoded-facts")

    def summary(self) -> DataFrame:
        """One row: five counters of decoded records, originals of whose description none came back, whether any is above zero, and how many records there are."""
        rows, there = compared(self.original, self.decoded), F.col("original_sha").isNotNull()
        out = rows.agg(
            F.count_if(~F.col("equal")).alias("mismatches"),
            F.count_if(~F.col("known")).alias("not_found"),
            F.count_if(F.col("known") & ~F.col("paired")).alias("pair_mismatches"),
            F.count_if(there & (F.col("original_size") != F.col("size"))).alias("length_mismatches"),
            F.count_if(there & (F.col("original_sha") != F.col("sha"))).alias("hash_mismatches"),
            F.count("*").alias("decoded"),
        )
        back = self.decoded.groupBy("description").agg(F.lit(True).alias("back"))
        lost = self.original.join(back, "description", "left").agg(F.count_if(F.col("back").isNull()).alias("missing"), F.count("*").alias("originals"))
        counters = ("mismatches", "not_found", "pair_mismatches", "length_mismatches", "hash_mismatches", "missing")
        out = out.crossJoin(lost)  # one row each
        return out.select(*counters, (F.greatest(*counters) > 0).alias("any_issue"), "originals", "decoded")

    def details(self) -> DataFrame:
        """One row per decoded record that differs from the original of its description. Only sequences of these are fetched."""
        rows = compared(self.original, self.decoded).where(~F.col("equal")).select("description", "place", "original_place")
        original, decoded = self.records
        sequence = lambda records: records.select(F.struct(*[c for c in ("file", "rec_no") if c in records.columns]).alias("at"), "sequence")
        rows = rows.join(sequence(decoded).withColumnsRenamed({"at": "place", "sequence": "decoded"}), "place")
        rows = rows.join(sequence(original).withColumnsRenamed({"at": "original_place", "sequence": "original"}), "original_place", "left")
        a, b = text(F.col("original")), F.col("decoded")
        rows = rows.withColumn("at", first_difference(a, b))
        return rows.select(
            F.col("place.rec_no").cast("long").alias("index"), "description", mismatch_reason(F.col("original"), b).alias("reason"), F.col("at").alias("first_diff_at"),
            *[count_symbol(s, x).alias(f"{name}_{x}") for name, s in (("orig", a), ("dec", b)) for x in "TU"],
            context(a, b, F.col("at")).alias("ctx_orig"), context(b, b, F.col("at")).alias("ctx_dec"),
        )


def summary(original: DataFrame, decoded: DataFrame) -> DataFrame:
    return Report(original, decoded).summary()


def details(original: DataFrame, decoded: DataFrame) -> DataFrame:
    return Report(original, decoded).details()


def first_details(rows: DataFrame, n: int = 10) -> DataFrame:
    """The report's few details: those of the first records."""
    return rows.orderBy("index").limit(n)


def sequence_names(original: DataFrame) -> DataFrame:
    """Each different sequence, by its hash, with the set of its descriptions as rows (no set is gathered in one value)."""
    return original.select(F.sha2("sequence", 256).alias("sha"), "description").distinct()
