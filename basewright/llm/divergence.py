"""Divergence of sources: how far the word shares of a language's sources lie apart, and which words make a source stand out.

Terms are counted by language and source in one pass over the texts, with partial counts in the tasks. A kept term is
a column of counts over its language's sources. Columns are sparse (source, count) lists, and equal columns are merged
into one with the number of terms that it stands for: rare terms have few different columns, so most of a vocabulary is
compared once. Every pair of sources is evaluated once for each different column and multiplied by that number; only at
the end the original terms are ranked by the value of their column.

Different columns are dealt out in lots of ``LOT``, pairs of sources in slices of ``SLICE`` by all; a task holds the
counts of one lot and the sums of one slice. Nothing is broadcast or collected. All arithmetic is exact: 64-bit where
a billion times the largest count fits, Python numbers or decimals elsewhere.

Defined cases: null text, lang and source are empty strings; repeated rows count as documents of their own; a language
without kept terms gives its pairs of sources with value 0; a language of one source gives no pair; no rows give an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

#: A kept term is in so many documents of its language; shares are of SCALE, each count with PRIOR more; ranks of terms end at TOP.
DOCUMENTS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Columns of a lot, first sources of a slice, and entries that a counting task holds.
LOT, SLICE, HELD = 4096, 256, 400_000
#: Bytes of terms to themselves, A-Z lower-cased; all others to blanks. Bytes from 128 on are parts of other letters.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and characters beyond ASCII."""
    return text.translate(TERM_BYTES).split()


def partial_counts(docs: DataFrame) -> DataFrame:
    """docs: lang, source, text (binary), none null. lang, source, term, n (occurrences), docs (documents); some rows of a term; a null term for each group."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)
        found: dict[tuple, Counter] = defaultdict(Counter)

        def emptied() -> Iterator[pa.RecordBatch]:
            for group, own in counts.items():
                terms, n = [None, *own], len(own) + 1
                columns = [pa.array([group[0]] * n, pa.string()), pa.array([group[1]] * n, pa.string()), pa.array(terms, pa.binary())]
                columns += [pa.array([0, *own.values()], pa.int64()), pa.array([0, *map(found[group].__getitem__, own)], pa.int64())]
                yield pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])
            counts.clear()
            found.clear()

        held = 0
        for batch in source:
            for lang, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own, terms = counts[lang, name], terms_of(text.as_py())
                held -= len(own)
                own.update(terms)
                held += len(own)
                found[lang, name].update(set(terms))
                if held > HELD:
                    yield from emptied()
                    held = 0
        yield from emptied()

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def whole(column: Column, digits: int = 38) -> Column:
    return column.cast(f"decimal({digits},0)")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exactly."""
    part = F.call_function("div", whole(F.lit(SCALE), 10) * whole(count + PRIOR, 19), whole(total + PRIOR * terms, 19))
    return part.cast("long") + 1


def shares(counts: np.ndarray, total: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The same for rows of counts and one total a column."""
    below = total + PRIOR * terms
    if int(counts.max(initial=0)) + PRIOR >= (1 << 63) // SCALE:
        return ((SCALE * (counts.astype(object) + PRIOR)) // below.astype(object) + 1).astype(np.int64)
    return SCALE * (counts + PRIOR) // below + 1


def pair_sums(columns: DataFrame, groups: DataFrame, work: Workspace) -> DataFrame:
    """columns: lang, column, terms (how many it stands for). groups: lang, source, at, total, kept. lang, a, b (places of sources), value."""
    size = columns.groupBy("lang").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))
    size = size.join(groups.groupBy("lang").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "lang")
    size = work.save(size, "lots")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lot = F.pmod(F.xxhash64("column"), F.col("lots")).cast("int").alias("lot")
    dealt = columns.join(size, "lang").select("lang", "column", "terms", lot, every("slices").alias("slice"))
    around = groups.join(size, "lang").select("lang", "source", "at", "total", "kept", "slices", every("lots").alias("lot"))
    around = around.select("lang", "source", "at", "total", "kept", "lot", every("slices").alias("slice"))

    def compared(rows: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values("at", ignore_index=True)
        place, n = {s: k for k, s in enumerate(groups["source"])}, len(groups)
        if rows.empty or not n:
            return pd.DataFrame({"lang": pd.Series([], dtype=object), "a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64"), "value": pd.Series([], dtype="int64")})
        first = int(rows["slice"].iloc[0]) * SLICE
        own = np.arange(first, min(n, first + SLICE))
        sums, total, kept = np.zeros((len(own), n), np.int64), groups["total"].to_numpy(), groups["kept"].to_numpy()
        step = max(1, (1 << 20) // n)
        for k in range(0, len(rows), step):
            part = rows.iloc[k : k + step]
            counts = np.zeros((len(part), n), np.int64)
            for row, column in zip(counts, part["column"]):
                for e in column:
                    row[place[e["source"]]] = e["n"]
            p, times = shares(counts, total, kept), part["terms"].to_numpy()
            for row, s in zip(sums, own):
                row += times @ np.abs(p - p[:, [s]])
        a, b = np.meshgrid(own, np.arange(n), indexing="ij")
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "a": a.ravel(), "b": b.ravel(), "value": sums.ravel()})

    key = ("lang", "lot", "slice")
    parts = dealt.groupBy(*key).cogroup(around.groupBy(*key)).applyInPandas(compared, "lang string, a long, b long, value long")
    return parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank. docs: text, lang, source."""
    work = Workspace(docs.sparkSession, "divergence")
    named = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    rows = docs.select(named("lang").alias("lang"), named("source").alias("source"), named("text").cast("binary").alias("text"))
    counts = partial_counts(rows).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = work.save(counts, "counts")
    terms = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
    terms = work.save(terms.where(F.col("docs") >= DOCUMENTS).select("lang", F.col("term").cast("string").alias("term"), "column"), "terms")
    work.save(counts.where(F.col("term").isNull()).select("lang", "source"), "groups")
    # a column's name is its least term
    columns = work.save(terms.groupBy("lang", "column").agg(F.count("*").alias("terms"), F.min("term").alias("name")), "columns")
    entries = columns.select("lang", "name", "terms", F.aggregate("column", F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("all"), F.explode("column").alias("e"))
    entries = work.save(entries.select("lang", "name", "terms", "all", "e.source", "e.n"), "entries")
    groups, whole_lang = totals(work.spark.read.parquet(f"{work.path}/groups"), columns, entries, work)

    sums = pair_sums(columns, groups, work)
    pairs = groups.select("lang", "source", F.col("at").alias("a")).join(groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b")), "lang").where(F.col("a") != F.col("b"))
    pairs = pairs.join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    own = entries.join(groups, ["lang", "source"]).join(whole_lang, "lang")
    over = own.select("lang", "source", "name", (share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("all"), F.col("lang_total"), F.col("kept"))).alias("value")).where("value > 0")
    members = terms.join(columns, ["lang", "column"]).select("lang", "name", "term")
    stand = over.join(members, ["lang", "name"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(by))
    return ranked(pairs).union(ranked(stand).where(F.col("rank") <= TOP))


def totals(named: DataFrame, columns: DataFrame, entries: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Of every group: its place among its language's sources, its total over kept terms, how many terms are kept; and the total of every language with kept terms."""
    kept = columns.groupBy("lang").agg(F.sum("terms").alias("kept"))
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("total"))
    at = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = named.withColumn("at", at).join(sums, ["lang", "source"], "left").join(kept, "lang", "left")
    groups = work.save(groups.select("lang", "source", "at", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "totals")
    return groups, sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_divergence": op13_divergence}
SQL = {
    "op13_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN v USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) USING (lang, source)
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // CAST(g.total + 5 * g.v AS HUGEINT) AS p
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // CAST(any_value(t.total) + 5 * any_value(v) AS HUGEINT) AS q
  FROM c JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) t USING (lang) JOIN v USING (lang) GROUP BY lang, term
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.f, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) s
    ON s.lang = a.lang AND s.s = a.source AND s.t = b.source
), term AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
""",
}
