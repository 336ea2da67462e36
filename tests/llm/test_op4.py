import math

import numpy as np
from pyspark.sql import functions as F

from basewright.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, queries, k):
    ok = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in ok:
        if queries(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def test_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.3, (9, 12))
    f32 = lambda a: [float(x) for x in np.asarray(a, np.float32)]
    rows = [(i, f32(centres[i % 9] + rng.normal(0, 0.1, 12)), "x") for i in range(700)]
    rows += [(1000 + i, f32(centres[1]), None) for i in range(90)]  # a large group of ties
    rows += [(2000, None, ""), (2010, [0.5, None], ""), (2020, [float("nan")] * 12, ""), (2030, [float("inf")], ""), (2040, [], ""), (2050, [0.25], ""), (None, [1.0], ""), (20, rows[20][1], "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    asked = lambda i: i % 10 == 0
    for shard, group, part in ((8192, 4096, 2048), (100, 30, 3)):
        monkeypatch.setattr(topk, "GROUP", group)
        monkeypatch.setattr(topk, "SLICE", part)
        got = topk.top_k(docs, F.col("vec_id") % 10 == 0, shard=shard).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, asked, 5)


def test_blocks_are_left_out():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (40, 16))
    vectors = np.repeat(centres, 64, 0) + rng.integers(-6, 7, (40 * 64, 16))
    ids = np.arange(len(vectors))
    where, found, score, made = topk.Shard(ids, vectors).search(ids[::50], vectors[::50], 5)
    assert made < 0.3 * len(ids) * len(ids[::50])
    true = vectors[::50] @ vectors.T
    true[np.arange(len(true)), ids[::50]] = np.iinfo(np.int64).min + 1
    assert np.array_equal(score.reshape(-1, 5), -np.sort(-true, 1)[:, :5])


def test_large_components_and_nothing(spark):
    big = [(i, [1e12 * (i + 1), -3.0], "") for i in range(6)]
    got = topk.top_k(spark.createDataFrame(big, SCHEMA), F.col("vec_id") == 0, scale=1).collect()
    rows = [(i, [float(np.float32(v)) for v in x], s) for i, x, s in big]
    exact = {i: [math.floor(v) for v in x] for i, x, s in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    assert {(r.vec_id, r.score) for r in got} == {(i, wrap(dot(exact[0], exact[i]))) for i in range(1, 6)}
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0


def test_only_due_shards_are_sent(spark, monkeypatch):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (20, 16))
    rows = [(i, [float(x) for x in centres[i % 20] + rng.normal(0, 0.02, 16)], "") for i in range(2000)]
    docs, sent = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), []
    due = topk.due_pairs

    def counted(queries, shards, *sizes):
        pairs = due(queries, shards, *sizes)
        sent.extend([pairs.count(), queries.count() * shards.count()])
        return pairs

    monkeypatch.setattr(topk, "due_pairs", counted)
    got = topk.top_k(docs, F.col("vec_id") % 50 == 0, shard=100).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, lambda i: i % 50 == 0, 5)
    assert sent[0] < 0.3 * sent[1]
