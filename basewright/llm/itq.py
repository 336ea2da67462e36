"""Near-duplicate embeddings through iterative quantisation and multi-index Hamming tables.

Vectors are scaled to length one. A rotation of their principal axes is learned so that the signs of the rotated vectors
are as near to them as can be (iterative quantisation), and the signs are the code. Where more bits are needed than a
rotation gives, further rotations are learned from other starts. The code is cut into tables of consecutive bits; two vectors
are candidates where a table agrees, and then if their whole codes are within a radius. Cosines of the original vectors
decide, so nothing below the threshold is linked.

How many bits a table has grows with the logarithm of the number of vectors, so that by chance about ``BUCKET`` vectors
share a value; how many tables there are follows from the chance that a pair at the threshold differs in a bit (its
angle over pi), so that such a pair is missed with a chance of at most ``MISS``; nearer pairs are missed less often.

Only places of a table's value where some candidate lies are joined with vectors. A value of more than ``SLICE`` vectors
is dealt over slices, and each pair of slices is a task's group. A pair counts in the first table where it agrees. What
leaves a task is the number of links of each vector and a spanning forest of them, never the pairs. Equal vectors are
one class with its size, and are not compared.

Fitted on at most ``SAMPLE`` vectors, taken by hash; all vectors are coded, compared and linked.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing and are their
own components; shorter vectors count as having zeros at the end; repeated rows each keep a row and link with each other;
a null id is never a component's id where another one can be, and rows with one are not kept; no rows give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, partitions
from .simhash import bundles, components, spread

COSINE = 0.9
#: Vectors of the fit and its rounds; vectors that share a table's value by chance; share of pairs at the threshold that may be missed.
SAMPLE, ROUNDS, BUCKET, MISS = 8192, 40, 256, 0.01
#: Standard deviations that a pair's code distance may lie above its mean; vectors of a slice; cells of a block of comparisons.
WIDE, SLICE, CELLS = 4.0, 8192, 1 << 22


def plan(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits of a table, and tables."""
    bits = max(4, math.ceil(math.log2(max(1, classes) / BUCKET)))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log1p(-agree))


def radius_of(bits: int, cosine: float = COSINE) -> int:
    """Code distance that nearly no pair at the threshold exceeds."""
    flip = math.acos(cosine) / math.pi
    return min(bits, math.ceil(bits * flip + WIDE * math.sqrt(bits * flip * (1 - flip))))


def unit_rows(vectors, width: int) -> np.ndarray:
    """Rows of length one; shorter vectors end in zeros. None is zero."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    out /= np.abs(out).max(1, keepdims=True)  # squares neither overflow nor vanish
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def rotations(sample: np.ndarray, bits: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the sample and a matrix of at least so many columns, whose products with centred vectors have the signs of the code."""
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    centred = sample - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1]  # those of most variance first
    projected = centred @ axes
    rng, found = np.random.default_rng(seed), []
    while len(found) * axes.shape[1] < bits:
        turn = np.linalg.qr(rng.standard_normal((axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS):
            signs = np.where(projected @ turn >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(signs.T @ projected)
            turn = (u @ v).T  # the rotation that brings the vectors nearest to their signs
        found.append(axes @ turn)
    return mean, np.concatenate(found, 1)


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))


def coded(classes: DataFrame, mean: np.ndarray, turn: np.ndarray, bits: int, tables: int) -> DataFrame:
    """classes: node, v. Adds code (words of 64 bits, signed) and keys (one number a table)."""
    turn, weights = turn[:, : bits * tables], 1 << np.arange(bits, dtype=np.int64)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows = unit_rows(batch.column(1).to_pylist(), len(mean))
            signs = (rows - mean) @ turn > 0
            words = np.packbits(np.pad(signs, ((0, 0), (0, -signs.shape[1] % 64))), axis=1).view(">i8").astype(np.int64)
            keys = signs.reshape(len(rows), tables, bits) @ weights
            yield pa.record_batch([batch.column(0), pa.array(words.tolist(), pa.list_(pa.int64())), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["node", "code", "keys"])

    return classes.select("node", "v").mapInArrow(run, "node long, code array<long>, keys array<long>")


def dealt(codes: DataFrame, work: Workspace, size: int) -> DataFrame:
    """table, key, part, mine (belongs to the part's first slice), theirs (to its second), node, code; a key of more than `size` has several parts, one for each pair of slices."""
    rows = codes.select("node", "code", F.posexplode("keys").alias("table", "key"))
    many = rows.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1")
    many = work.save(many.select("table", "key", F.ceil(F.col("n") / size).cast("long").alias("slices")), "buckets")
    rows = rows.join(many, ["table", "key"]).withColumn("own", F.pmod(F.xxhash64("node"), F.col("slices")))
    part = lambda other: F.struct((F.least(F.col("own"), other) * F.col("slices") + F.greatest(F.col("own"), other)).alias("part"), (F.col("own") <= other).alias("mine"), (F.col("own") >= other).alias("theirs"))
    parts = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1), part))
    return rows.select("table", "key", parts.alias("p"), "node", "code").select("table", "key", "p.*", "node", "code")


def grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), "table", "key", "part").sortWithinPartitions("table", "key", "part", "node")


def pairs_of(table: int, codes: np.ndarray, mine: np.ndarray, theirs: np.ndarray, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of candidates (each pair once) of a group: codes within the radius that agree in no earlier table."""
    first, second = np.flatnonzero(mine), np.flatnonzero(theirs)
    whole = codes.view(np.uint64)
    early = np.packbits(np.pad(np.arange(whole.shape[1] * 64)[None, :] < bits * table, ((0, 0), (0, 0))), axis=1).view(">u8").astype(np.uint64)[0] if table else None
    step = max(1, CELLS // max(1, len(second)))
    for k in range(0, len(first), step):
        rows = first[k : k + step]
        far = np.zeros((len(rows), len(second)), np.int32)
        for w in range(whole.shape[1]):
            far += np.bitwise_count(whole[rows, w][:, None] ^ whole[second, w][None, :])
        # pairs within a slice are met in both orders
        a, b = np.nonzero(far <= radius)
        a, b = rows[a], second[b]
        once = (a < b) | ~(theirs[a] & mine[b])
        a, b = a[once & (a != b)], b[once & (a != b)]
        if early is not None and len(a):
            differ = np.unpackbits(((whole[a] ^ whole[b]) & early).astype(">u8").view(np.uint8), axis=1)[:, : bits * table]
            new = differ.reshape(len(a), table, bits).any(2).all(1)
            a, b = a[new], b[new]
        if len(a):
            yield a, b


def matrix(column, width: int, kind) -> np.ndarray:
    return np.array(column.tolist(), kind).reshape(len(column), width)


def cuts(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of rows with equal keys."""
    new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
    return list(zip(new.tolist(), [*new[1:].tolist(), len(keys[0])]))


def met(rows: DataFrame, bits: int, radius: int, words: int) -> DataFrame:
    """rows: dealt. Those of each group that have a candidate in it."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key, part, mine, theirs, node, code in bundles(flat(source)):
            codes = matrix(code, words, np.int64)
            for begin, end in cuts(table, key, part):
                some = np.zeros(end - begin, bool)
                for a, b in pairs_of(int(table[begin]), codes[begin:end], mine[begin:end], theirs[begin:end], bits, radius):
                    some[a] = some[b] = True
                at = begin + np.flatnonzero(some)
                if len(at):
                    columns = [pa.array(c[at]) for c in (table, key, part, mine, theirs, node)]
                    yield pa.record_batch([*columns, pa.array(codes[at].tolist(), pa.list_(pa.int64()))], ["table", "key", "part", "mine", "theirs", "node", "code"])

    return rows.mapInArrow(run, "table int, key long, part long, mine boolean, theirs boolean, node long, code array<long>")


def flat(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose lists become arrays of Python's, as bundles() wants plain columns."""
    return (b for b in source if b.num_rows)


def confirmed(rows: DataFrame, bits: int, radius: int, words: int, cosine: float) -> DataFrame:
    """rows: met, with v and size of the node. node, links (vectors of linked classes), other (a linked class, or the node itself)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key, part, mine, theirs, node, code, v, size in bundles(flat(source), 1 << 14):
            codes = matrix(code, words, np.int64)
            for begin, end in cuts(table, key, part):
                units = unit_rows(v[begin:end], max(map(len, v[begin:end])))
                n, own = size[begin:end], node[begin:end]
                links, labels = np.zeros(end - begin, np.int64), np.arange(end - begin)
                for a, b in pairs_of(int(table[begin]), codes[begin:end], mine[begin:end], theirs[begin:end], bits, radius):
                    for k in range(0, len(a), 1 << 14):
                        x, y = a[k : k + (1 << 14)], b[k : k + (1 << 14)]
                        near = np.einsum("ij,ij->i", units[x], units[y]) >= cosine
                        x, y = x[near], y[near]
                        np.add.at(links, x, n[y])
                        np.add.at(links, y, n[x])
                        spread(labels, x, y)
                at = np.flatnonzero(links)
                if len(at):
                    yield pa.record_batch([pa.array(own[at]), pa.array(links[at]), pa.array(own[labels[at]])], ["node", "links", "other"])

    return rows.mapInArrow(run, "node long, links long, other long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_column: str = "vec_id", vector_column: str = "embedding", sample: int = SAMPLE, size: int = SLICE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; vectors of at least the cosine are linked, but for the share `miss` of pairs at just that cosine."""
    spark = vectors.sparkSession
    work = Workspace(spark, "near-vectors")
    v = F.transform(vectors[vector_column], lambda x: x.cast("double") + 0.0)  # -0.0 is 0.0
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), F.when(usable(v), v).alias("v"))
    rows = work.save(rows.withColumn("lot", F.xxhash64("v")), "rows")
    classes = rows.where("v IS NOT NULL").groupBy("lot", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    classes = work.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    count, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    found = linked(classes, count, width, cosine, sample, size, miss, work) if count else None
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = alone
    if found is not None:
        own = rows.where("v IS NOT NULL").join(found, ["lot", "v"]).select("vec_id", "n_links", "component_id")
        out = own.union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def linked(classes: DataFrame, count: int, width: int, cosine: float, sample: int, size: int, miss: float, work: Workspace) -> DataFrame:
    """classes: lot, v, least, size, node. lot, v, n_links, component_id."""
    bits, tables = plan(count, cosine, miss)
    radius, words = radius_of(bits * tables, cosine), -(-bits * tables // 64)
    held = classes.orderBy(F.xxhash64(F.lit(1), "lot"), "lot", "v").limit(sample).select("v").collect()
    mean, turn = rotations(unit_rows([r.v for r in held], width), bits * tables)
    codes = work.save(coded(classes, mean, turn, bits, tables), "codes")
    some = work.save(met(grouped(dealt(codes, work, size)), bits, radius, words), "met")
    held = some.join(classes.select("node", "v", "size"), "node").select("table", "key", "part", "mine", "theirs", "node", "code", "v", "size")
    links = work.save(confirmed(grouped(held), bits, radius, words, cosine), "links")
    edges = links.where(F.col("node") != F.col("other")).select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()
    known = components(work.save(edges, "edges"), work).withColumnRenamed("node", "node_")
    n = links.groupBy(F.col("node").alias("linked")).agg(F.sum("links").alias("n"))
    found = classes.join(known, F.col("node") == F.col("node_"), "left").join(n, F.col("node") == F.col("linked"), "left")
    found = found.select("lot", "v", "least", F.coalesce("component", "node").alias("component"), (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    found = work.save(found, "found")
    ids = found.groupBy("component").agg(F.min("least").alias("component_id"))
    return found.join(ids, "component").select("lot", "v", "n_links", "component_id")


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op12_near_vectors": op12_near_vectors}
#: All pairs by brute force; equal where no link is missed.
SQL = {
    "op12_near_vectors": """
WITH RECURSIVE e AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings
), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM e WHERE v IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.size * b.size) >= 0.9
), reach AS (SELECT vec_id, vec_id AS to_id FROM e UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.to_id
), c AS (SELECT vec_id, min(to_id) AS component_id FROM reach GROUP BY vec_id
), n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
""",
}
