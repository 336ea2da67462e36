import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from basewright.llm import quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string, distance int"


def slow_counts(text):
    text = text or ""
    words = WORD.findall(text)
    seen = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(again)


def half_up(x):
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def slow_estimate(x, floors):
    """Mean and covariance at the least determinant that concentration steps reach from three starts."""
    pick = lambda v, q: np.sort(v)[math.ceil(q * len(v)) - 1]
    far = lambda v, mean, cov: np.einsum("ij,jk,ik->i", v - mean, np.linalg.inv(cov + floors), v - mean)
    det = lambda cov: 0.5 * np.linalg.slogdet(cov + floors)[1]
    median = np.array([pick(c, 0.5) for c in x.T])
    ranges = np.diag([((pick(c, 0.75) - pick(c, 0.25)) / 1.349) ** 2 for c in x.T])
    ends = [[median, np.zeros((4, 4))], [median, ranges], [x.mean(0), np.cov(x.T, bias=True)]]
    for _ in range(quality.STEPS):
        moved = 0
        for e in ends:
            d, old = far(x, *e), det(e[1])
            near = x[d <= pick(d, quality.SUPPORT) + 1e-9]
            e[:] = [near.mean(0), np.cov(near.T, bias=True)]
            moved = max(moved, abs(det(e[1]) - old))
        if moved < 1e-9:
            break
    mean, cov = min(ends, key=lambda e: round(det(e[1]), 9))
    return mean, cov, max(1.0, pick(far(x, mean, cov), 0.5) / quality.MEDIAN)


def slow_verdicts(rows, prior):
    facts = []
    for doc, text, lang, source, *_ in rows:
        n, chars, symbols, lines, dup, rep = slow_counts(text)
        failed = n < 50 or 100 * rep > 50 * n
        x = [half_up(1000 * v) for v in (math.log(chars / n), math.log1p(10 * symbols / n), dup / lines, rep / n)] if n else None
        facts.append((doc, lang, source, failed, x))
    floors = np.diag([(f * 1000) ** 2 for f in quality.FLOORS])
    members = defaultdict(list)
    for _, lang, source, failed, x in facts:
        if not failed:
            for key in ((), (lang,), (lang, source)):
                members[key].append(x)
    own = {key: slow_estimate(np.array(x, float), floors) for key, x in members.items()}

    def shrunk(key):
        """An estimate with its share of that of the level above."""
        above = shrunk(key[:-1]) if key else None
        if key not in own:
            return above
        part = len(members[key]) / (len(members[key]) + prior)
        return own[key] if above is None else tuple(part * a + (1 - part) * b for a, b in zip(own[key], above))

    out = []
    for doc, lang, source, failed, x in facts:
        d, found = None, shrunk((lang, source))
        if x is not None and found:
            v = np.array(x) - found[0]
            d = float(v @ np.linalg.inv(found[1] + floors) @ v) / found[2]
        out.append((doc, failed, d, not failed and (d is None or d <= quality.CUTOFF)))
    return out


def texts(rng, n):
    syllables = ["an", "er", "tion", "le", "che", "ß", "é", "st"]
    for i in range(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.choice([3, 60, 60, 120, 400]))]
        if i % 9 == 0:
            words = [w + rng.choice("#$%&|") * 3 for w in words]
        if i % 13 == 0:
            words = words[:10] * 9
        for k in range(12, len(words), 12):
            words[k] += rng.choice(["\n", "\n\n", " \t"])
        yield " ".join(words) + ("\n" + " ".join(words[:6])) * (i % 7 == 0)


def test_counts_and_verdicts_equal_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, t, rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None, "tiny"]), "x", 1) for i, t in enumerate(texts(rng, 900))]
    rows += [(2000, None, "en", "a", "", 0), (2001, "", None, None, "", 0), (2002, "\n \x0b", "fr", "z", "", 0), (2003, "a b\nc " * 40_000, "en", "a", "", 0), (None, "a b c", "en", "a", "", 0), (1, rows[1][1], rows[1][2], rows[1][3], "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.n_words): r for r in quality.assess(docs, prior=40).collect()}
    verdicts = slow_verdicts(rows, 40)
    for (doc, text, *_), (_, failed, d, kept) in zip(rows, verdicts):
        n, chars, symbols, _, dup, rep = slow_counts(text)
        r = got[doc, n]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (chars, symbols, dup, rep, failed)
        assert (r.distance is None) == (d is None) and (d is None or abs(r.distance - d) < 1e-6 * max(1, d))
        assert r.kept == kept
    assert {True, False} == {kept for _, failed, _, kept in verdicts if not failed}


def test_few_or_no_documents(spark):
    assert quality.assess(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "word " * 10 + " ".join(map(str, range(60))), "en", "a", "", 0)]
    assert [(r.base_failed, round(r.distance, 6), r.kept) for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()] == [(False, 0.0, True)]


def test_half_of_the_lines_repeated_is_rejected(spark):
    rng = random.Random(3)
    line = lambda: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(10))
    rows = [(i, "\n".join(line() for _ in range(12)), "en", "a", "", 0) for i in range(300)]
    rows += [(1000 + i, "".join("ok\n" + line() + "\n" for _ in range(10)) + "ok\nok", "en", "a", "", 0) for i in range(5)]
    got = quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(2 * r.n_dup_lines == 22 and not r.base_failed and not r.kept for r in got if r.doc_id >= 1000)
    assert all(r.kept for r in got if r.doc_id < 1000)


def test_each_language_and_source_has_its_own_estimate(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghij", k=n))
    usual = {"a": 4, "b": 7, "c": 11}
    text = lambda n: " ".join(word(max(2, n + rng.choice([-1, 0, 1]))) for _ in range(80))
    rows = [(i, text(usual[s]), "en", s, "", 0) for i, s in enumerate("abc" * 60)]
    # as long as the words of one source, and as odd in the other
    rows += [(1000, text(11), "en", "a", "", 0), (1001, text(4), "en", "c", "", 0), (1002, text(7), "en", "b", "", 0)]
    kept = {r.doc_id: r.kept for r in quality.assess(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(180)) and (kept[1000], kept[1001], kept[1002]) == (False, False, True)
