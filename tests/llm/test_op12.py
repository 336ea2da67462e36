import numpy as np
import pytest

from basewright.llm import itq


def turned(rng, v, cosine):
    """A vector of random length at just this cosine from v."""
    v = v / np.linalg.norm(v)
    other = rng.standard_normal(len(v))
    other -= other @ v * v
    return (cosine * v + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)) * rng.uniform(0.1, 5)


def slow(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) by all pairs; rows of (id, vector)."""
    good = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    width = max(len(v) for _, v in rows if v is not None)
    units = np.zeros((len(rows), width))
    for k, (_, v) in enumerate(rows):
        if good[k]:
            v = np.array(v, float) / np.abs(v).max()
            units[k, : len(v)] = v / np.linalg.norm(v)
    near = units @ units.T >= cosine
    np.fill_diagonal(near, False)
    label = list(range(len(rows)))
    for _ in rows:
        new = [min([label[k], *(label[j] for j in np.flatnonzero(near[k]))]) for k in range(len(rows))]
        if new == label:
            break
        label = new
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    return [(i, int(near[k].sum()), least.get(label[k]), i is not None and i == least.get(label[k])) for k, (i, _) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<double>, size int, node int").repartition(4)


@pytest.mark.parametrize("size", [8192, 7])
def test_equals_brute_force(spark, size):
    rng = np.random.default_rng(1)
    rows = [(k, rng.standard_normal(24)) for k in range(200)]
    for k in range(40):  # chains, clusters and scaled copies
        base = rows[k % 7][1]
        rows.append((1000 + k, turned(rng, base, rng.uniform(0.96, 1))))
    rows += [(2000 + k, rows[k][1] * 3) for k in range(5)] + [(3000 + k, rows[3][1]) for k in range(30)] + [(7, rows[7][1])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 24), (4003, [1.0, None]), (4004, [float("nan")] * 3), (4005, [float("inf"), 1]), (None, rows[9][1]), (None, [0.0])]
    rows += [(4006, [1e200, 1e200]), (4007, [1e-200, 1.01e-200]), (4008, [1.0, 1.0] + [-0.0] * 22)]
    got = itq.near_vectors(frame(spark, rows), size=size, miss=1e-12).collect()
    assert sorted(map(tuple, got), key=str) == sorted(slow(rows), key=str)
    assert itq.near_vectors(frame(spark, rows).where("false")).count() == 0
    assert itq.near_vectors(frame(spark, [(1, None)])).collect() == [(1, 0, 1, True)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(1500):
        v = rng.standard_normal(64)
        rows += [(2 * k, v), (2 * k + 1, turned(rng, v, rng.uniform(0.9005, 0.91)))]
    got = {r.vec_id: r for r in itq.near_vectors(frame(spark, rows)).collect()}
    want = slow(rows)
    links = sum(r[1] for r in want)
    assert links >= 3000 and all(got[i].n_links <= n for i, n, *_ in want)
    assert sum(r.n_links for r in got.values()) >= 0.97 * links
    # pairs as far apart as planted copies are
    near = [(2 * k, rows[2 * k][1]) for k in range(1500)] + [(2 * k + 1, turned(rng, rows[2 * k][1], 0.97)) for k in range(1500)]
    assert sum(r.n_links for r in itq.near_vectors(frame(spark, near)).collect()) >= 0.995 * 3000


def test_tables_follow_from_the_number_of_vectors():
    for n, bits in ((1, 4), (50_000, 8), (10**6, 12), (10**9, 22)):
        b, tables = itq.plan(n)
        assert b == bits and (1 - (1 - np.arccos(0.9) / np.pi) ** b) ** tables <= itq.MISS


def test_rotation_quantises_better_than_the_start():
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((8, 16)) * 2
    x = itq.unit_rows(centres[rng.integers(0, 8, 2000)] + 0.3 * rng.standard_normal((2000, 16)), 16)
    mean, turn = itq.rotations(x, 40)
    assert turn.shape[1] >= 40 and np.allclose(turn[:, :16].T @ turn[:, :16], np.eye(16))
    loss = lambda t: np.square(np.sign(y := (x - mean) @ t) * np.abs(y).mean() - y).sum()
    assert loss(turn[:, :16]) < loss(np.linalg.qr(rng.standard_normal((16, 16)))[0])
