"""Exact top-k search by integer inner products, pruned block by block.

Vectors are sorted so that near ones lie together and cut into ranges of ``BLOCK`` documents. Of every block the
largest and smallest value of each dimension are known; a query's bound for a block is the sum of its products
with the maxima (for its negative components, the minima). A query takes blocks in order of falling bounds, in
waves, and scores them through the blocks' forward indexes (the vectors of the block, by document) until the
next bound is below its kth score. Ties at the kth score are kept apart by the smaller id, so a block is left
out only if its bound is strictly below.

Ranges are held in shards of about ``SHARD`` vectors. A query first searches the shard that it lies in, which gives
a score that its kth best reaches at least. Of all other shards only the extremes are compared with the query (slices
of ``SLICE`` extremes meet groups of ``GROUP`` queries), and only pairs of query and shard whose bound reaches that
score are sent: each due shard meets its queries in groups of about ``GROUP``. All sizes are fixed, so no task grows
with the input, and each gives at most k rows per query.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count
as having zeros at the end; rows with a null id take no part; repeated rows with the same id and vector count
once, and no row with the query's own id is its candidate; no rows give an empty result; other columns are
ignored. Components and scores are signed 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace

BLOCK, SHARD, GROUP, SLICE = 64, 8192, 4096, 2048
RESULT = "query_id long, vec_id long, score long"


def integer_vector(vector: Column, scale: int = 256) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out


def bounds_of(queries: np.ndarray, high: np.ndarray, low: np.ndarray, exact: bool) -> np.ndarray:
    """The most that the product of each query and any vector between the extremes can be."""
    return products(np.maximum(queries, 0), high, exact) + products(np.minimum(queries, 0), low, exact)


def is_exact(a: np.ndarray, b: np.ndarray) -> bool:
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**52


def products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """a @ b.T; by floating point where every partial sum is below 2**53 and so exact."""
    if exact:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Shard:
    """Blocks of documents with their extremes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        self.ids, self.vectors, self.block = ids, vectors, block
        self.starts = np.arange(0, len(ids), block)
        self.high = np.maximum.reduceat(vectors, self.starts, axis=0)
        self.low = np.minimum.reduceat(vectors, self.starts, axis=0)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows (query's place, vec_id, score) of each query's k best here, and how many products were made.

        least: scores below which no row of a query is wanted.
        """
        exact = is_exact(queries, self.vectors)
        n, m = len(query_ids), len(self.starts)
        bounds = bounds_of(queries, self.high, self.low, exact)
        least = np.full(n, np.iinfo(np.int64).min) if least is None else least
        order = np.argsort(-bounds, axis=1, kind="stable")
        floor = np.iinfo(np.int64).min + 1
        best = np.full((n, k), floor)
        best_id = np.full((n, k), np.iinfo(np.int64).max)
        made, begin, wave = 0, 0, 2
        live = np.arange(n)
        while begin < m and len(live):
            end = min(m, begin + wave)
            blocks = order[live, begin:end]
            keep = np.take_along_axis(bounds[live], blocks, 1) >= np.maximum(best[live, -1:], least[live, None])
            where, column = np.nonzero(keep)
            place, block = live[where], blocks[where, column]
            by = np.argsort(block, kind="stable")
            place, block = place[by], block[by]
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows, start = place[a:b], int(self.starts[block[a]])
                ids = self.ids[start : start + self.block]
                scores = products(queries[rows], self.vectors[start : start + self.block], exact)
                made += scores.size
                scores[query_ids[rows][:, None] == ids] = floor
                both = np.concatenate([best[rows], scores], 1)
                both_id = np.concatenate([best_id[rows], np.where(scores == floor, np.iinfo(np.int64).max, ids)], 1)
                top = np.lexsort((both_id, -both), axis=1)[:, :k]
                best[rows], best_id[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(both_id, top, 1)
            begin, wave = end, wave * 2
            if begin < m:
                live = live[bounds[live, order[live, begin]] >= np.maximum(best[live, -1], least[live])]
        where, column = np.nonzero(best_id != np.iinfo(np.int64).max)
        return where, best_id[where, column], best[where, column], made


def nearness(vector: Column) -> Column:
    """A sort key that keeps near vectors together: places and signs of the components of at least half the largest."""
    parts = F.transform(vector, lambda x, i: F.struct(F.abs(x).alias("size"), F.concat(F.lpad(i.cast("string"), 6, "0"), F.when(x < 0, "-").otherwise("+")).alias("name")))
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    named = F.transform(F.filter(parts, lambda e: e["size"] * 2 >= largest), lambda e: e["name"])
    return F.coalesce(F.concat_ws("", F.slice(named, 1, 6)), F.lit(""))


def extremes(held: DataFrame) -> DataFrame:
    """held: shard, v. The largest and smallest value of each place, by shard; shorter vectors have zeros at the end."""

    def partial(source: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in source:
            for shard, own in rows.groupby("shard"):
                v = matrix(own["v"], max(map(len, own["v"])))
                yield pd.DataFrame({"shard": [shard], "high": [v.max(0)], "low": [v.min(0)]})

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, rows["high"]))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "high": [matrix(rows["high"], width).max(0)], "low": [matrix(rows["low"], width).min(0)]})

    schema = "shard int, high array<long>, low array<long>"
    return held.select("shard", "v").mapInPandas(partial, schema).groupBy("shard").applyInPandas(merged, schema)


def due_pairs(queries: DataFrame, shards: DataFrame, n_queries: int, n_shards: int) -> DataFrame:
    """queries: id, v, home, least. shards: of extremes. id, v, least and shard where a shard's bound reaches the least score, its home left out."""
    groups, slices = -(-n_queries // GROUP) or 1, -(-n_shards // SLICE) or 1
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("id", "v", "home", "least", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), spread(slices).alias("slice"))
    known = shards.select("*", F.pmod("shard", F.lit(slices)).alias("slice")).select("*", spread(groups).alias("group"))

    def meet(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if asked.empty or known.empty:
            return pd.DataFrame({"id": [], "shard": [], "at": []}).astype("int64")
        width = max(map(len, [*asked["v"], *known["high"]]))
        # beyond a shard's longest vector all are zero there
        q, high, low = matrix(asked["v"], width), matrix(known["high"], width), matrix(known["low"], width)
        bounds = bounds_of(q, high, low, is_exact(q, np.concatenate([high, low])))
        where, shard = np.nonzero((bounds >= asked["least"].to_numpy()[:, None]) & (asked["home"].to_numpy()[:, None] != known["shard"].to_numpy()))
        return pd.DataFrame({"id": asked["id"].to_numpy()[where], "shard": known["shard"].to_numpy()[shard], "at": asked["at"].to_numpy()[where]})

    at = F.xxhash64("id", "v")  # tells rows of one id apart
    pairs = asked.withColumn("at", at).groupBy("group", "slice").cogroup(known.groupBy("group", "slice")).applyInPandas(meet, "id long, shard int, at long")
    own = queries.select(F.col("id").alias("own_id"), "v", "least", at.alias("own_at"))
    return pairs.join(own, (F.col("id") == F.col("own_id")) & (F.col("at") == F.col("own_at"))).select("id", "v", "least", "shard")


def searched(held: DataFrame, queries: DataFrame, k: int, work: Workspace, name: str) -> DataFrame:
    """held: id, v, key, shard. queries: id, v, least, shard; both written already. query_id, vec_id, score of each query's k best in its shard."""
    many = work.save(queries.groupBy("shard").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")), name)
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")
    queries = queries.join(many, "shard").select("id", "v", "least", "shard", part)
    held = held.join(many, "shard").select("id", "v", "key", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def search(docs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or asked.empty:
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})
        width = max(map(len, [*docs["v"], *asked["v"]]))
        docs, ids = docs.sort_values(["key", "id"]), asked["id"].to_numpy()
        where, found, score, _ = Shard(docs["id"].to_numpy(), matrix(docs["v"], width)).search(ids, matrix(asked["v"], width), k, asked["least"].to_numpy())
        return pd.DataFrame({"query_id": ids[where], "vec_id": found, "score": score})

    return held.groupBy("shard", "part").cogroup(queries.groupBy("shard", "part")).applyInPandas(search, RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows other than its own; ties go to the smaller id."""
    spark = vectors.sparkSession
    work = Workspace(spark, "top-k")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"), is_query.alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", integer_vector(F.col("v"), scale).alias("v"), "q")
    rows = work.save(rows.withColumn("key", nearness(F.col("v"))).dropDuplicates(["id", "v"]), "rows")
    size, asked = rows.agg(F.count("*"), F.count_if("q")).first()
    ranged = rows.repartitionByRange(-(-size // shard) or 1, "key", "id")
    held = work.save(ranged.select("id", "v", "q", "key", F.spark_partition_id().alias("shard")), "shards")
    nothing = F.lit(np.iinfo(np.int64).min)
    queries = work.save(held.where("q").select("id", "v", nothing.alias("least"), "shard"), "queries")
    near = work.save(searched(held, queries, k, work, "parts-of-homes"), "near")
    # the kth best of a query's own shard; rows of one id share the lower one
    kth = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    kth = kth.select(F.col("query_id").alias("id"), F.get("s", F.lit(k - 1)).alias("least"))  # at most k rows of a query and shard
    asks = queries.select("id", "v", F.col("shard").alias("home")).join(kth, "id", "left").withColumn("least", F.coalesce("least", nothing))
    asks = work.save(asks, "asks")
    shards = work.save(extremes(held), "extremes")
    due = work.save(due_pairs(asks, shards, asked, shards.count()), "due")
    near = near.union(searched(held, due, k, work, "parts-of-due"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = near.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return near.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(rows, F.col("vec_id") % 50 == 0)


QUERIES = {"op4_top_k": op4_top_k}
SQL = {
    "op4_top_k": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT DISTINCT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, d.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
}
