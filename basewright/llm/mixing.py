"""Mixing sources to target weights by fitting word budgets exactly.

Each source's budget is its share of all words by weight, at most ``most`` times its own size. Every document is
taken floor(budget / size of the source) times; what then remains is less than the source's size and is fitted
with documents taken once more: of each exact length a share in proportion, then whole documents from the
longest length down to a small rest, and the rest by a bounded-knapsack dynamic programme over the counts of
documents left of each length. Which documents of a length are taken follows a seeded hash.

The programme sees one row per source and length, never documents. The choice of the first n documents of a
length needs no sort of all of them: hashes are cut into ranges of about ``RANGE`` documents, whole ranges are
taken by running sums over their counts, and only one range per length is ranked.

Defined cases: a null text has no words; null sources are one source, after all others; rows that repeat an id
are documents of their own, and of equal ones it does not matter which is taken; documents without words are never taken; no rows give an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace

MOST, SEED, RANGE = 3, 17, 512
#: Words left to the dynamic programme, besides the longest document.
REST = 1 << 14


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int = REST) -> np.ndarray:
    """How many documents of each length to take so that their words come as near to the budget as the method can, not above it."""
    lengths, counts = lengths.astype(np.int64), counts.astype(np.int64)
    total = int((lengths * counts).sum())
    take = np.zeros(len(lengths), np.int64)
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left, room = counts - take, budget - int((lengths * take).sum())
    for i in np.argsort(-lengths, kind="stable").tolist():
        if room <= rest or not lengths[i]:
            break
        n = min(int(left[i]), (room - rest + int(lengths[i]) - 1) // int(lengths[i]), room // int(lengths[i]))
        take[i] += n
        left[i] -= n
        room -= n * int(lengths[i])
    return take + knapsack(lengths, left, room)


def knapsack(lengths: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """Bounded subset sum: the largest total up to ``room``, each length at most as often as counted.

    Counts are split into powers of two; ``by[s]`` is the item that first reached the total s.
    """
    items = []
    for i, (length, count) in enumerate(zip(lengths.tolist(), counts.tolist())):
        size = 1
        while length and count and length * size <= room:
            n = min(size, count)
            items.append((i, n))
            count, size = count - n, size * 2
    by = np.full(room + 1, -1, np.int32)
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    for k, (i, n) in enumerate(items):
        step = n * int(lengths[i])
        if step > room or reached[room]:
            continue
        new = reached[:-step] & ~reached[step:]
        by[step:][new] = k
        reached[step:] |= new
    take, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        i, n = items[by[at]]
        take[i] += n
        at -= n * int(lengths[i])
    return take


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3), most: int = MOST) -> DataFrame:
    """source, source_size, target. Of the sources in order of most * size / weight, the first few are full; the rest share by weight.

    sizes: source, source_size, one row per source; the windows run over these few rows.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[rank % len(weights)]
    rows = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("level", level)
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(everything)["level"]
    rows = rows.withColumn("open", open_level)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("open") * F.col("weight"), F.col("cap"))).alias("target"))


def lots(docs: DataFrame, seed: int = SEED) -> Column:
    """The hash of each document by which documents of one length are taken."""
    return F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), most: int = MOST, seed: int = SEED) -> DataFrame:
    """Per document: its lot, size, source_size, target of its source, times it is taken, and words taken."""
    work = Workspace(docs.sparkSession, "mix")
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].alias("source"), size.alias("size"), lots(docs, seed).alias("lot"))
    rows = work.save(rows, "sizes")
    lengths = work.save(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    shares = targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    shares = work.save(shares, "targets")

    def plan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")  # so that reruns agree
        size, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
        budget = int(round(target))
        base = min(budget // size, most) if size else 0
        more = fit(rows["size"].to_numpy(), rows["n"].to_numpy(), budget - base * size if base < most else 0)
        return rows.assign(base=base, more=more)[["source", "size", "n", "base", "more"]]

    sized = lengths.join(shares.withColumnRenamed("source", "source_"), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    plans = work.save(sized.groupBy("source").applyInPandas(plan, "source string, size long, n long, base long, more long"), "plans")

    # ranges of the hash, so that a length shared by very many documents is not ranked in one task
    cuts = plans.select(F.col("source").alias("source_"), F.col("size").alias("size_"), "base", "more", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE)).cast("long").alias("ranges"))
    known = rows.join(cuts, F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_"))).drop("source_", "size_")
    spot = F.shiftrightunsigned("lot", 31)  # 33 bits: its product with the number of ranges stays a signed 64-bit number
    known = work.save(known.withColumn("range", F.shiftright(spot * F.col("ranges"), 33)), "ranges")
    some = (F.col("more") > 0) & (F.col("size") > 0)
    counts = known.where(some).groupBy("source", "size", "range", "more").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source", "size").orderBy("range"))
    counts = counts.select(F.col("source").alias("source_"), F.col("size").alias("size_"), F.col("range").alias("range_"), (F.col("more") - running + F.col("n")).alias("open"), F.col("n").alias("held"))
    same = F.col("source").eqNullSafe(F.col("source_")) & (F.col("size") == F.col("size_")) & (F.col("range") == F.col("range_"))
    marked = known.join(counts.where(F.col("open") > 0), same, "left").drop("source_", "size_", "range_")
    whole = F.col("open") >= F.col("held")
    place = F.row_number().over(Window.partitionBy("source", "size", "range").orderBy("lot", "doc_id"))
    ranked = marked.where(F.col("open").isNotNull() & ~whole).withColumn("extra", (place <= F.col("open")).cast("long"))
    rest = marked.where(F.col("open").isNull() | whole).withColumn("extra", F.col("open").isNotNull().cast("long"))
    taken = ranked.unionByName(rest)
    few = shares.withColumnRenamed("source", "source_")
    few = F.broadcast(few) if shares.count() <= 10_000 else few
    out = taken.join(few, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    times = F.when(F.col("size") > 0, F.col("base") + F.col("extra")).otherwise(F.lit(0))
    return out.select("doc_id", "lot", "source", "size", "source_size", "target", times.cast("long").alias("times"), (times * F.col("size")).cast("long").alias("taken"))


def taken(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Rows with equal id and text stand for each other."""
    times = mix(docs, seed=seed).groupBy("doc_id", "lot").agg(F.sum("times").alias("times")).where(F.col("times") > 0)
    names = [f"c{k}" for k in range(len(docs.columns))]  # free of clashes with the columns added
    own = docs.withColumn("", lots(docs, seed)).toDF(*names, "own_lot")
    held = own.join(times, F.col(names[docs.columns.index("doc_id")]).cast("long").eqNullSafe(F.col("doc_id")) & (F.col("own_lot") == F.col("lot")))
    held = held.dropDuplicates(["doc_id", "lot"]).select(*names, F.explode(F.sequence(F.lit(1), F.col("times"))))
    return held.select(*names).toDF(*docs.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
