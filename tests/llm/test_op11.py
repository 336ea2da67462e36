import hashlib
import random
import zlib

import pytest

from basewright.llm import runs


def slow_runs(words, least=24, periods=3):
    """Every period is tried; a stretch counts only under its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            k = i
            while k + q < n and words[k] == words[k + q]:
                k += 1
            if k + q - i >= max(least, periods * q):
                found.setdefault((i, k + q - i), q)
            i = k
    return sorted((s, n, q) for (s, n), q in found.items())


def slow_row(doc_id, text):
    words = [w.encode() for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32((str(doc_id) if doc_id is not None else "").encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = slow_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for s, n, q in found:  # by start, then period
        if best is None or n * best[2] > best[1] * q:
            best = s, n, q
    top = (*best, best[1] * 1000 // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return doc_id, len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def shaped(rng, n):
    """Words with many nested repeats."""
    out = []
    while len(out) < n:
        unit = [rng.choice("ab") for _ in range(rng.randint(1, 4))]
        unit *= rng.randint(1, 6)
        if rng.random() < 0.5:
            unit = (unit + [rng.choice("abc")]) * rng.randint(1, 5)
        out += unit
    return out


def test_runs_equal_all_periods():
    rng = random.Random(5)
    for k in range(3000):
        words = shaped(rng, rng.randint(1, 90)) if k % 2 else [rng.choice("abc"[: 1 + k % 3]) for _ in range(rng.randint(0, 60))]
        least = rng.choice((1, 4, 24))
        assert runs.runs_of(words, least) == slow_runs(words, least), (words, least)


def test_edges_are_next_smaller_suffixes():
    rng = random.Random(6)
    for _ in range(1500):
        w = shaped(rng, rng.randint(1, 40))
        n = len(w)
        for descending in (False, True):
            key = [[-ord(c) if descending else ord(c) for c in w[i:]] for i in range(n)]
            following, common, _ = runs.lyndon_edges(w, descending)
            for i in range(n):
                j = next((j for j in range(i + 1, n) if key[j] < key[i]), n)
                m = 0
                while j + m < n and w[i + m] == w[j + m]:
                    m += 1
                assert (following[i], common[i] if j < n else 0) == (j, m)


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def test_steps_are_linear():
    rng, n = random.Random(7), 20_000
    cases = {
        "power": ["x"] * n, "pairs": ["x", "y"] * (n // 2), "fibonacci": fibonacci(n), "thue-morse": ["ab"[bin(i).count("1") % 2] for i in range(n)],
        "random": [rng.choice("ab") for _ in range(n)], "shaped": shaped(rng, n), "square": (s := [rng.choice("ab") for _ in range(n // 2)]) + s, "period": (fibonacci(377) * 60)[:n],
        "ladder": [c for k in range(200) for c in "a" * k + "b"], "cube": fibonacci(89) * 3 + shaped(rng, 10_000), "falling": [chr(200 - k) for k in range(150) for _ in range(100)],
    }
    for name, w in cases.items():
        for descending in (False, True):
            assert runs.lyndon_edges(w, descending)[2] <= 3 * len(w), name


def test_rows_equal_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "word", "a " * 30, "a b " * 24, "é b " * 20 + "c", "A a " * 13]
    texts += [" ".join(shaped(rng, rng.randint(20, 200))) for _ in range(60)]
    texts += [" ".join(rng.choice(("ab", "b", "abc", "zz")) for _ in range(rng.randint(24, 300))) for _ in range(120)]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)] + [(None, "b a " * 40, "x", 3), (7, "a b " * 14, "y", 4), (7, "a b " * 14, "y", 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, start int").repartition(5)
    got = sorted(map(tuple, runs.word_runs(frame).collect()), key=str)
    assert got == sorted((slow_row(i, t) for i, t, *_ in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 40
    assert runs.word_runs(frame.where("false")).count() == 0


@pytest.mark.parametrize("words", [200_000])
def test_very_long_text(words):
    row = runs.described(1, b"a b a a b " * (words // 5))
    assert row[1] == 1 and row[2:6] == (0, words, 5, 200 * words)
