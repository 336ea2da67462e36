"""Secret scans through an incremental ledger of blobs.

Every version of a path is addressed by the SHA-256 of its content. The ledger holds, for each blob and rule
version, the spans found. A scan takes the distinct blobs of the given versions, leaves out the pairs of blob
and rule version that the ledger has, scans the rest once each, adds the findings (clean blobs as well) to the
ledger, and joins the ledger back to all paths. So equal files, and versions seen before, are never read again.

All of it is DataFrame operations. Spark's regular expressions give matches but no places: a text is split at
the matches of a rule, and the lengths of the parts and of the matches add up to the places. Rules first match
without a least length and drop short matches afterwards, as a short match uses up its characters.

Blobs move by the row id of their first version; contents are never grouped by a key that copies share.

Defined cases: a null text is empty; null paths keep their row; repeated rows are versions of their own; no rows
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, document_text


@dataclass(frozen=True)
class Rule:
    """kind; pattern (Java and RE2); the group whose length counts; the least length; the rule's version."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"

    @property
    def key(self) -> str:
        """What the ledger knows the rule by: another pattern, group or length is another rule."""
        return f"{self.kind}@{self.version}:{sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"


#: In the order in which kinds are listed at equal starts.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # runs of hex digits are maximal, so shorter ones can be left out at once
)
#: Matches or spans of a text that are worked off together.
STEP = 256
SPAN = "struct<start:int,order:int,kind:string,stop:int>"


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def rule_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule: [start, stop) in code points, leftmost matches first."""
    pattern = F.lit(rule.pattern)
    sizes = lambda parts: F.transform(parts, F.char_length)
    whole = sizes(F.regexp_extract_all(text, pattern, F.lit(0)))
    part = whole if rule.group == 0 else sizes(F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    lengths = F.struct(sizes(F.split(text, rule.pattern, -1)).alias("gaps"), whole.alias("whole"), part.alias("part"))
    return F.when(text.rlike(rule.pattern), let(lengths, lambda v: added_up(v, rule, order))).otherwise(no_spans())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def slices(n: Column) -> Column:
    """First places of slices of ``STEP``; none of nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(STEP))).otherwise(F.array().cast("array<int>"))


def added_up(lengths: Column, rule: Rule, order: int) -> Column:
    """Spans from the lengths of the gaps before matches, of the matches, and of the part of each that must be long enough.

    An array grows by being copied, so places are added up within slices first, and the slices are joined once.
    """

    def of_slice(begin: Column) -> Column:
        own = [F.slice(lengths[c], begin + 1, F.lit(STEP)) for c in ("gaps", "whole", "part")]
        matches = F.zip_with(F.zip_with(own[0], own[1], lambda g, w: F.struct(g.alias("gap"), w.alias("size"))), own[2], lambda x, p: F.struct(x["gap"], x["size"], p.alias("part")))
        matches = F.filter(matches, lambda m: m["size"].isNotNull())  # there is a gap after the last match

        def step(state: Column, m: Column) -> Column:
            start = state["at"] + m["gap"]
            span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (start + m["size"]).alias("stop"))
            found = F.when(m["part"] >= rule.least, F.concat(state["found"], F.array(span))).otherwise(state["found"])
            return F.struct((start + m["size"]).alias("at"), found.alias("found"))

        return F.aggregate(matches, F.struct(F.lit(0).alias("at"), no_spans().alias("found")), step)

    def join(state: Column, s: Column) -> Column:
        moved = F.transform(s["found"], lambda x: F.struct((x["start"] + state["at"]).alias("start"), x["order"], x["kind"], (x["stop"] + state["at"]).alias("stop")))
        return F.struct((state["at"] + s["at"]).alias("at"), F.concat(state["found"], F.array(moved)).alias("found"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("found"))
    parts = F.transform(slices(F.size(lengths["whole"])), of_slice)
    return F.aggregate(parts, zero, join, lambda s: F.flatten(s["found"]))


def pairs(rules: tuple[Rule, ...], blobs: DataFrame) -> DataFrame:
    """One row per blob and rule version."""
    return blobs.select("blob", F.explode(F.array(*[F.lit(r.key) for r in rules])).alias("rule"))


def scan_versions(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions: path, text (not null). Returns path, blob, spans for each row; adds to the ledger, a folder of Parquet files."""
    spark = versions.sparkSession
    work = Workspace(spark, "secret-scan")
    named = work.save(versions.select("path", F.sha2("text", 256).alias("blob")), "blobs")
    first = named.groupBy("blob").agg(F.min("path").alias("path"))
    known = ledger_table(spark, ledger)
    due = pairs(rules, first).join(known.select("blob", "rule"), ["blob", "rule"], "left_anti").groupBy("blob").agg(F.collect_set("rule").alias("due"))
    due = work.save(due.join(first, "blob").select(F.col("path").alias("due_path"), F.col("blob").alias("due_blob"), "due"), "due")
    texts = versions.withColumn("blob", F.sha2("text", 256))
    same = F.col("path").eqNullSafe(F.col("due_path")) & (F.col("blob") == F.col("due_blob"))
    texts = texts.join(due.hint("shuffle_hash"), same).select("blob", "text", "due")
    each = [
        F.struct(
            F.lit(r.key).alias("rule"),
            F.when(F.array_contains("due", r.key), rule_spans(F.col("text"), r, k)).alias("spans"),
        )
        for k, r in enumerate(rules)
    ]
    new = texts.select("blob", F.explode(F.array(*each)).alias("e")).select("blob", "e.rule", "e.spans").where(F.col("spans").isNotNull())
    new.write.mode("append").option("compression", "zstd").parquet(ledger)
    wanted = [r.key for r in rules]
    found = ledger_table(spark, ledger).where(F.col("rule").isin(wanted) & (F.size("spans") > 0))
    found = work.save(found.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans")), "found")
    # copies of one blob may be very many: both sides are plain shuffles, so that large partitions can be split
    return named.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", no_spans()).alias("spans"))


def ledger_table(spark: SparkSession, path: str) -> DataFrame:
    schema = f"blob string, rule string, spans array<{SPAN}>"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans (by start) replaced by a mark.

    Spans are taken by slices, each from the part of the text that it lies in, as a place in a text is found from its front.
    """

    def of_slice(state: Column, begin: Column) -> Column:
        own, base = F.slice(spans, begin + 1, F.lit(STEP)), state["at"]
        part = F.substring(text, base + 1, F.greatest(F.array_max(F.transform(own, lambda s: s["stop"])) - base, F.lit(0)))

        def in_part(part: Column) -> Column:
            def step(now: Column, s: Column) -> Column:
                more = F.concat(F.substring(part, now["at"] - base + 1, s["start"] - now["at"]), F.lit(mark))
                out = F.when(s["start"] < now["at"], now["out"]).otherwise(F.concat(now["out"], F.array(more)))
                return F.struct(F.greatest(now["at"], s["stop"]).alias("at"), out.alias("out"))

            zero = F.struct(base.alias("at"), F.array().cast("array<string>").alias("out"))
            return F.aggregate(own, zero, step, lambda now: F.struct(now["at"], F.concat(state["out"], F.array(F.array_join(now["out"], ""))).alias("out")))

        return let(part, in_part)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(slices(F.size(spans)), zero, of_slice, rest)).otherwise(text)


def redacted(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of docs, each text without the secrets that the scan of all texts has found."""
    found = scan_versions(as_versions(docs), ledger, rules).where(F.size("spans") > 0)
    found = found.select("blob", "spans").distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes with the columns added
    own = names[docs.columns.index("text")]
    held = docs.toDF(*names).withColumn("key", F.sha2(own, 256)).join(found, F.col("key") == F.col("blob"), "left")
    text = redact(F.col(own), F.coalesce("spans", no_spans())).alias(own)
    return held.select(*[text if c == own else c for c in names]).toDF(*docs.columns)


def as_versions(docs: DataFrame, path: str = "doc_id") -> DataFrame:
    """Documents as versions: an id as path, and the text, null as empty."""
    return docs.select(docs[path].alias("path"), document_text(docs).alias("text"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = Workspace(spark, "secret-ledger").path
    rows = scan_versions(as_versions(spark.read.parquet(f"{sf_dir}/documents.parquet")), ledger)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col("path").alias("doc_id"), *[count(r.kind) for r in RULES],
        F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def _duckdb_spans(rule: Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, w, g, parts, i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
      string_split_regex(t, '{pattern}') AS parts, unnest(range(1, len(w) + 1)) AS i
    FROM d WHERE regexp_matches(t, '{pattern}')
  ) WHERE length(g[i]) >= {rule.least}"""


QUERIES = {"op5_secrets": op5_secrets}
SQL = {
    "op5_secrets": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(_duckdb_spans(r, k) for k, r in enumerate(RULES))}
), s AS (
  SELECT doc_id, o, kind, length(array_to_string(parts[1:i], '')) + length(array_to_string(w[1:i-1], '')) AS a, length(w[i]) AS n FROM m
), j AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, o) AS spans FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (doc_id)
""",
}
