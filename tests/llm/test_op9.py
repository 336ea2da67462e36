import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from basewright.llm import attention, lm_scoring
from basewright.llm.subwords import END_ID, WordCoder, as_coded, coder, split, tokenizer_path

SHAPE = attention.Shape(width=6, hidden=5, window=8, overlap=3, rows=20, groups=4, members=3, tails=2, contexts=5)
SCHEMA = "doc_id long, text string, lang string, n long, word int, base string, row int"


def small_model(seed=0):
    rng = np.random.default_rng(seed)
    vocabulary = attention.Vocabulary(rng.integers(0, 50, 30), SHAPE, rng.integers(0, 9, (12, 5)))
    model = attention.Model.first(SHAPE, vocabulary, seed)
    model.U[:], model.V[:] = rng.standard_normal(model.U.shape), rng.standard_normal(model.V.shape)
    return model, vocabulary


def slow_score(model, vocabulary, ids, end):
    """One window after the other, one place after the other."""
    whole, total, done, start = [end, *ids], 0.0, 0, 0
    d = SHAPE.width
    while done < len(ids):
        part = whole[start : start + SHAPE.window]
        e = model.E[vocabulary.row[part]] + model.P[: len(part)]
        q, k, v = np.split(e @ model.A, 3, 1)
        for i in range(len(part)):
            if start + i < done or start + i >= len(ids):
                continue
            w = q[i] @ k[: i + 1].T / d**0.5
            w = np.exp(w - w.max())
            h = e[i] + (w / w.sum()) @ v[: i + 1] @ model.O
            top = h + np.maximum(h @ model.H + model.c, 0) @ model.G
            y = whole[start + i + 1]
            c = vocabulary.cls[y]
            log = lambda out, j: float(out[j] - out.max()) - math.log(np.exp((out - out.max()).astype(float)).sum())
            total += log(top @ model.U[:-1] + model.U[-1], c) + vocabulary.share[y]
            total += log(top @ model.V[c][:-1] + model.V[c][-1], vocabulary.place[y]) if c < SHAPE.groups else 0
        done = start + SHAPE.window
        start += SHAPE.window - SHAPE.overlap
    return total / math.log(10)


def test_probabilities_add_up():
    model, vocabulary = small_model()
    one = [math.exp(math.log(10) * s) for s in attention.Scorer(model, vocabulary, 2)([np.array([i]) for i in range(30)])]
    assert abs(sum(one) - 1) < 1e-4


def test_windows_score_each_id_once():
    model, vocabulary = small_model(1)
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, 30, n) for n in (1, 2, 7, 8, 9, 12, 13, 14, 18, 100, 1)]
    got = attention.Scorer(model, vocabulary, 2, at_once=4)(texts)
    assert np.allclose(got, [slow_score(model, vocabulary, t.tolist(), 2) for t in texts], rtol=1e-4)


def test_large_outputs():
    model, vocabulary = small_model(7)
    model.U[-1] += np.float32(200)
    model.A[:] *= 30
    texts = [np.arange(20)]
    assert np.allclose(attention.Scorer(model, vocabulary, 2)(texts), [slow_score(model, vocabulary, texts[0].tolist(), 2)], rtol=1e-3)


def test_later_ids_change_nothing_before():
    model, _ = small_model(3)
    x = np.array([[3, 4, 5, 6, 7, 8, 9, 10]])
    other = x.copy()
    other[0, 5:] = 1
    a, b = model.hidden(x)[-1], model.hidden(other)[-1]
    assert np.allclose(a[:5], b[:5]) and not np.allclose(a[5:], b[5:])


def test_gradients_equal_differences():
    model, vocabulary = small_model(4)
    model = attention.Model(SHAPE, vocabulary.rows, model.flat.astype(np.float64))
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 20, (3, 8)), rng.integers(0, 30, 24)
    cls, place = vocabulary.cls[y], vocabulary.place[y]
    loss = lambda: -float(model.logs(model.hidden(x)[-1], cls, place).mean())
    grad, rows = model.gradients(x, cls, place)
    for name, g in grad.items():
        view = getattr(model, name)
        for _ in range(8):
            at = tuple(rng.integers(0, s) for s in view.shape)
            if name == "E":
                at = (rows[rng.integers(0, len(rows))], at[1])
            want = g[np.searchsorted(rows, at[0]), at[1]] if name == "E" else g[at]
            old = view[at]
            view[at] = old + 1e-5
            up = loss()
            view[at] = old - 1e-5
            down = loss()
            view[at] = old
            assert abs((up - down) / 2e-5 - want) < 1e-4, name


def test_classes_are_even():
    rng = np.random.default_rng(6)
    group = attention.dealt(rng.standard_normal((24 * 16, 10)), 16)
    assert (np.bincount(group, minlength=16) == 24).all()
    for n in (3, 12, 30, 100):
        v = attention.Vocabulary(rng.integers(0, 50, n), SHAPE, rng.integers(0, 9, (12, 5)))
        own = v.cls < SHAPE.groups
        pairs = set(zip(v.cls[own].tolist(), v.place[own].tolist()))
        assert len(pairs) == own.sum() and v.place.max() < SHAPE.members


def prose(rng, n):
    words, out = ["the cat", "a dog", "Sits on", "runs to", "the mat.", "my house!"], []
    for i in range(n):
        out.append(words[(2 * i + rng.randint(0, 1)) % 6])
    return " ".join(out)


def table():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([2, 10, 60])) + f" x{rng.randint(0, 400)}", "en") for i in range(300)]
    rows += [(900, None, "en"), (901, "", None), (902, " \n", "en"), (903, "word " * 30_000, "en"), (904, "ÄÉ Äé\x1cb <|endoftext|>", "en"), (5, rows[5][1], "en"), (None, "no id", None)]
    rows += [(905, "x" * 70_000, "en")]
    return [(*r, 1, 2, "b", 3) for r in rows]


def brute(rows):
    split = lambda t: [*re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    count = Counter(w for i, t, *_ in rows if not held(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    return sorted(
        (str(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in split(t)), 6))
        for i, t, *_ in rows
    )


def test_base_equals_brute_force_and_model_learns(spark, monkeypatch):
    rows = table()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for share in (lm_scoring.SHARE, 50):
        monkeypatch.setattr(lm_scoring, "SHARE", share)
        monkeypatch.setattr(lm_scoring, "HELD", 40)
        got = lm_scoring.score(docs, lm_scoring.learned_from(docs["doc_id"])).collect()
        assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == brute(rows)
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    words = coder(tokenizer_path())
    texts = {i: t for i, t, *_ in rows}
    counts = np.bincount(np.concatenate([words.encode((t or "").encode()) for _, t, *_ in rows]), minlength=words.size)
    flat = np.log10((counts + 0.5) / (counts + 0.5).sum())
    plain = sum(flat[words.encode(texts[r.doc_id].encode())].sum() for r in got if r.doc_id is not None and r.doc_id < 300)
    assert sum(r.score for r in got if r.doc_id is not None and r.doc_id < 300) > plain  # context helps


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 1, 1, "", 1)], SCHEMA)
    r = lm_scoring.score(docs, docs["doc_id"] < 0).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0
    assert lm_scoring.score(docs.limit(0), docs["doc_id"] > 0).count() == 0


def test_changes_are_summed_over_levels(spark):
    rows = [(k, np.full(3, k, np.float32).tobytes()) for k in range(50)]
    total = lm_scoring.summed(spark.createDataFrame(rows, "at int, change binary").repartition(20), 50, fan=3)
    assert total.tolist() == [1225.0] * 3


def test_partitions_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 2)
    monkeypatch.setattr(lm_scoring, "BATCH", 8)
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    docs = spark.createDataFrame(table()[:150], SCHEMA)
    seen = [lm_scoring.score(docs.repartition(n), lm_scoring.learned_from(docs["doc_id"])).orderBy("doc_id", "n_tokens").collect() for n in (1, 7)]
    assert len(seen[0]) == 150
    assert np.allclose(*[[r.score for r in rows] for rows in seen], rtol=1e-4)


def test_every_text_trains_a_large_corpus(spark, monkeypatch):
    rows = [(i, f"x{i} " + "word " * 22_000, "en", 1, 1, "", 1) for i in range(100)]  # more than two million words
    seen = []

    def untrained(windows, vocabulary, path, shape):
        seen.append(windows.agg(F.sum("n")).first()[0])
        return attention.Model.first(shape, vocabulary, 0)

    monkeypatch.setattr(lm_scoring, "train", untrained)
    lm_scoring.score(spark.createDataFrame(rows, SCHEMA).repartition(4), F.lit(True))
    words, window = coder(tokenizer_path()), attention.Shape().window
    assert seen == [sum(len(attention.cut(words.encode(t.encode()), END_ID, window)) for _, t, *_ in rows)]


def test_every_window_is_met(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "STEPS", 20)
    monkeypatch.setattr(lm_scoring, "BATCH", 8)
    docs = spark.createDataFrame([(1, "some words here " * 60_000, "en", 1, 1, "", 1), (2, "more of them", "en", 1, 1, "", 1)], SCHEMA)
    path, shape = tokenizer_path(), attention.Shape()
    rows = lm_scoring.training_windows(docs, path, shape).collect()
    assert len(rows) > 16 and max(r.n for r in rows) <= 256  # a long text is many rows
    windows = np.concatenate([np.frombuffer(r.windows, coder(path).dtype).reshape(-1, shape.window + 1) for r in rows])
    vocabulary = attention.Vocabulary(np.bincount(windows.ravel(), minlength=coder(path).size), shape)
    starts = []
    monkeypatch.setattr(lm_scoring, "summed", lambda changes, *_: starts.extend(np.frombuffer(r.change, np.float32) for r in changes.collect()))
    lm_scoring.train(spark.createDataFrame(rows, "round int, lot long, n long, windows binary"), vocabulary, path, shape)
    met = sum(s[-vocabulary.rows - 1 : -1].astype(np.int64) for s in starts)
    # each round's windows are met once or more, by every id in them
    assert (met >= np.bincount(vocabulary.row[windows[:, :-1]].ravel(), minlength=vocabulary.rows)).all()


def test_an_uneven_last_batch_is_met(monkeypatch):
    model, vocabulary = small_model(9)
    windows = np.random.default_rng(9).integers(0, 30, (11, 9))
    met = attention.train(model, windows, vocabulary, 3, 4, (0.01, 0.001), 1)
    assert (met == np.bincount(vocabulary.row[windows[:, :-1]].ravel(), minlength=model.rows)).all()


def test_default_model_sees_eight_ids_before():
    shape = attention.Shape()
    vocabulary = attention.Vocabulary(np.arange(5000, 0, -1), shape)
    model = attention.Model.first(shape, vocabulary, 1)
    scorer = attention.Scorer(model, vocabulary, 2)
    ids = np.random.default_rng(10).integers(0, 5000, 300)
    score = lambda x: scorer([np.array(x)])[0]
    # score of the id at each place, given all ids before it, with and without the eighth id before it changed
    for at in range(8, 300):
        changed = ids[: at + 1].copy()
        changed[at - 8] = (changed[at - 8] + 1) % 5000
        one = [score(x[: at + 1]) - score(x[:at]) for x in (ids, changed)]
        assert abs(one[0] - one[1]) > 1e-9, at
    assert (shape.width, shape.hidden, shape.window) >= (16, 32, 32) and shape.own >= 1024


def test_each_word_of_a_batch_is_coded_once(monkeypatch):
    words, asked = WordCoder(tokenizer_path()), Counter()
    slow = WordCoder.word
    monkeypatch.setattr(WordCoder, "word", lambda self, w: (asked.update([w]), slow(self, w))[1])
    texts = pa.array(["the cat, The cat ", "\na CAT the", "", " the"] * 50)
    found, places, sizes = split(as_coded(texts))
    ids = words.encode_words(found, places, sizes)
    assert max(asked.values()) == 1 and set(asked) - {b""} == {b"the", b"cat,", b"cat", b"a"}
    assert sizes.tolist() == [5, 4, 1, 2] * 50 and len(ids) == 200
    assert found[-1] == b"" and [found[p] for p in places[:9]] == [b"the", b"cat,", b"the", b"cat", b"", b"a", b"cat", b"the", b""]


def test_texts_are_cut_once_for_training_and_scores(spark):
    rows, path, shape = table(), tokenizer_path(), attention.Shape()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    none = lm_scoring.Common([], np.zeros(0))
    coded = lm_scoring.coded_texts(docs, lm_scoring.learned_from(docs["doc_id"]), none, path, shape).cache()
    found = coded.collect()
    ids = lm_scoring.read_ids(pa.array([r.windows for r in found], pa.binary()), pa.array([r.ids for r in found]), path, shape)
    words = coder(path)
    want = Counter((i, words.encode((t or "").encode()).tobytes()) for i, t, *_ in rows)
    # what is scored: each text whole, with a number of its own
    assert Counter((r.doc_id, x.tobytes()) for r, x in zip(found, ids) if r.row is not None) == want
    assert len({r.row for r in found} - {None}) == len(rows)
    # what trains: the ids of the learned texts, those of long ones in parts
    train = [x for r, x in zip(found, ids) if r.round < lm_scoring.ROUNDS]
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    total = lambda parts: np.bincount(np.concatenate(parts), minlength=words.size)
    assert (total(train) == total([np.frombuffer(x, words.dtype) for (i, x), n in want.items() for _ in range(n) if not held(i)])).all()
    assert (lm_scoring.subword_counts(coded.where(F.col("round") < lm_scoring.ROUNDS), path, shape) == total(train)).all()
    assert any(r.row is None for r in found) and max(r.n for r in found if r.round < lm_scoring.ROUNDS) <= lm_scoring.ROW
    vocabulary = attention.Vocabulary(total(train), shape)
    model = attention.Model.first(shape, vocabulary, 1)
    got = {r.row: r.score for r in lm_scoring.score_texts(coded, model, vocabulary, path).collect()}
    scores = attention.Scorer(model, vocabulary, END_ID)([x for r, x in zip(found, ids) if r.row is not None])
    assert np.allclose([got[r.row] for r in found if r.row is not None], scores, rtol=1e-5)


def test_most_frequent_words_travel(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARE", 5)
    for n, least in (([9, 7, 7, 3, 3, 3, 1], 7), ([5, 4, 3, 2, 1], 1), ([2] * 6, 3), ([1] * 5, 1), ([], 1)):
        counts = spark.createDataFrame([(x,) for x in n], "n long")
        assert lm_scoring.least_common(counts, sum(n)) == least
