import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from basewright.llm import divergence as dv


def slow(rows, least=30):
    """rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
    out = []
    for lang in {r[1] for r in rows}:
        own = [(terms(t), s) for t, g, s in rows if g == lang]
        documents = Counter(w for t, _ in own for w in set(t))
        kept = [w for w, n in documents.items() if n >= least]
        share = lambda counts: {w: 1 + 10**9 * (counts[w] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for w in kept}
        count = {s: Counter(w for t, x in own if x == s for w in t) for s in {s for _, s in own}}
        p, q = {s: share(c) for s, c in count.items()}, share(sum(count.values(), Counter()))
        for s in p:
            pair = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in p if o != s]
            term = [(p[s][w] - q[w], w) for w in kept if count[s][w] and p[s][w] > q[w]]
            for part, found, top in (("pair", pair, None), ("term", term, 50)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:top], 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "B", "é", "Ünï", "x1y", "z-z", "don't", "日本", "q\x00r", "ſ", "K"] + [f"w{chr(97 + k)}" for k in range(20)] + [f"r{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(120)]
    rows = []
    for k in range(1600):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None])
        rows.append((" ".join(rng.choices(words, k=rng.randint(0, 30))), lang, source))
    rows += [(None, "en", "empty"), ("", "fr", "one"), ("a", "fr", "two"), (None, None, None), ("a b", "it", "only")]
    rows += [("same text here", "en", "s1")] * 40  # repeated rows are documents of their own
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, source string, value int, item string").repartition(7)
    got = sorted(map(tuple, dv.divergence(frame).collect()))
    want = slow(rows)
    assert got == want
    assert len({r[0] for r in want}) == 4  # one source makes no pair
    assert max(r[5] for r in want if r[2] == "term") == 50
    assert dv.divergence(frame.where("false")).collect() == []


def test_lots_and_slices_change_nothing(spark, monkeypatch):
    rng = random.Random(4)
    words = [chr(97 + k) * 3 for k in range(26)]
    rows = [(" ".join(rng.choices(words, k=30)), "en", f"s{rng.randint(0, 8)}") for _ in range(200)]
    monkeypatch.setattr(dv, "LOT", 3)
    monkeypatch.setattr(dv, "SLICE", 2)
    monkeypatch.setattr(dv, "HELD", 50)
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(map(tuple, dv.divergence(frame).collect())) == slow(rows)


def test_equal_columns_are_merged(spark):
    rows = [("alpha beta gamma", "en", "s1"), ("alpha beta", "en", "s2")] * 40
    counts = dv.partial_counts(spark.createDataFrame(rows, "text string, lang string, source string").select("lang", "source", F.col("text").cast("binary")))
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("column"))
    assert terms.count() == 3


def test_large_counts_are_exact(spark):
    big = 3 * 10**13
    got = dv.shares(np.array([[big, 7]]), np.array([2 * big, 10**15]), np.array([3, 3])).tolist()
    want = [[1 + 10**9 * (n + 5) // (t + 15) for n, t in ((big, 2 * big), (7, 10**15))]]
    assert got == want
    row = spark.sql(f"SELECT {big} AS n, {2 * big} AS t, 3L AS v").select(dv.share(F.col("n"), F.col("t"), F.col("v"))).first()
    assert row[0] == want[0][0]
