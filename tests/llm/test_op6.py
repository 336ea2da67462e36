import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from basewright.llm import mixing

WORDS = re.compile("[^\x20\x09-\x0d]+")


def share(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing, as the rule says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = total - sum(full.values())
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        now = {s: rest * weight[s] / w for s in open_}
        over = [s for s in open_ if now[s] > most * sizes[s]]
        if not over:
            return full | now
        full |= {s: float(most * sizes[s]) for s in over}


def test_knapsack_is_exact():
    rng = random.Random(2)
    for _ in range(80):
        lengths = np.array(rng.sample(range(1, 60), rng.randint(1, 6)))
        counts = np.array([rng.randint(0, 5) for _ in lengths])
        room = rng.randint(0, 150)
        reach = {0}
        for n, c in zip(lengths.tolist(), counts.tolist()):
            reach = {s + k * n for s in reach for k in range(c + 1)}
        take = mixing.knapsack(lengths, counts, room)
        assert (take <= counts).all() and (take >= 0).all()
        assert int((take * lengths).sum()) == max(s for s in reach if s <= room)


def test_fit_of_large_budgets():
    rng = np.random.default_rng(4)
    lengths = rng.choice(np.arange(1, 5000), 900, False)
    counts = rng.integers(1, 10**6, 900)
    for part in (0.001, 0.3, 0.77, 0.999):
        budget = int((lengths * counts).sum() * part)
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((take * lengths).sum()) == budget


def table(seed, hot):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        source = rng.choice(["a", "b", "b", "b", "cc", "dü", None, "e"] + ["hot"] * hot)
        text = None if rng.random() < 0.02 else " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 3, 3, 17, 40, rng.randint(0, 300)])))
        rows.append((i, text, source, "x", 1))
    rows += [(7, "twice here", "a", "x", 1)] * 3 + [(None, "no id at all", "b", None, None)]
    return rows


SCHEMA = "doc_id long, text string, source string, size string, target int"


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 30)])
def test_targets_are_met(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 16)
    rows = table(seed, hot)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, longest = Counter(), Counter(), defaultdict(int)
    for _, text, source, *_ in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = share(sizes)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-6
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1, source
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, "", 1), (2, " ", "a", "", 1)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.taken, r.target) for r in got) == [(1, 0, 0.0), (2, 0, 0.0)]
