import random
import zlib

import numpy as np

from basewright.llm import language

SYLLABLES = {"aa": ["ba", "be", "zu", "ko"], "bb": ["chi", "ñe", "lo", "ru"], "cc": ["öst", "ung", "ei", "ver"]}


def slow_grams(text):
    letters = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    letters = f" {' '.join(letters.split())} "
    return {letters[i : i + n] for n in (1, 2, 3) for i in range(len(letters) - n + 1)} if letters.strip() else set()


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def table(rng, n):
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        rows.append((i, prose(rng, lang, rng.choice([8, 30, 120])), lang, "s", 0.5, "no"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, score double, lang_pred string"


def test_grams():
    for text in ("", " 12 !", "a", "Ab  c", "ÄÖ-ß 3 x", "日本 語", "éa", "x" * 5000):
        assert len(language.grams(text)) == len(slow_grams(text))
    assert len(language.grams(None)) == 0
    assert len(np.intersect1d(language.grams("The CAT"), language.grams("the cat"))) == len(slow_grams("the cat"))


def test_kernel_equals_its_definition():
    rng = random.Random(3)
    texts = [prose(rng, lang, n) for lang in SYLLABLES for n in (1, 5, 40)] + ["", "??"]
    marks = texts[:7]
    known, held = language.landmarks_of([language.grams(t) for t in marks])
    found = language.Classifier([], known, held, np.empty((0, 0))).kernel([language.grams(t) for t in texts])
    for i, a in enumerate(texts):
        for j, b in enumerate(marks):
            x, y = slow_grams(a), slow_grams(b)
            want = len(x & y) / (len(x) * len(y)) ** 0.5 if x else 0
            assert abs(found[i, j] - want) < 1e-5


def test_features_span_the_landmarks():
    rng = random.Random(4)
    known, held = language.landmarks_of([language.grams(prose(rng, lang, 30)) for lang in SYLLABLES for _ in range(4)])
    own = held.T @ held
    root = language.root_inverse(own)
    assert np.allclose((own @ root) @ (own @ root).T, own, atol=1e-3)


def test_held_out_accuracy_and_rest(spark):
    rng = random.Random(5)
    rows = table(rng, 400)
    odd = [(1000, None, "aa", "", 0.0, ""), (1001, " 1 2 ?", "bb", "", 0.0, ""), (1002, "", None, "", 0.0, ""), (3, rows[3][1], rows[3][2], "", 0.0, ""), (None, rows[5][1], None, "", 0.0, ""), (1003, prose(rng, "cc", 60_000), None, "", 0.0, "")]
    docs = spark.createDataFrame(rows + odd, SCHEMA)
    model = language.fit(docs, language.learned_from(docs["doc_id"]))
    got = language.predict(docs, model, "doc_id", "lang").collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r.lang and r.doc_id < 1000 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 80 and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = table(random.Random(6), 150)
    held = lambda r: zlib.crc32(str(r[0]).encode()) % 3 == 1
    other = [(*r[:2], "xx", *r[3:]) if held(r) else r for r in rows]
    found = []
    for some in (rows, other):
        docs = spark.createDataFrame(some, SCHEMA)
        model = language.fit(docs, language.learned_from(docs["doc_id"]))
        found.append(sorted((r.doc_id, r.lang_pred) for r in language.predict(docs, model, "doc_id").collect()))
    assert found[0] == found[1]


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None, "", 0.0, "")], SCHEMA)
    for some in (docs, docs.limit(0)):
        model = language.fit(some, language.learned_from(some["doc_id"]))
        assert all(r.lang_pred == "und" for r in language.predict(some, model, "doc_id").collect())


def test_one_language(spark):
    docs = spark.createDataFrame([r for r in table(random.Random(7), 60) if r[2] == "aa"], SCHEMA)
    model = language.fit(docs, language.learned_from(docs["doc_id"]))
    assert {r.lang_pred for r in language.predict(docs, model, "doc_id").collect()} == {"aa"}


def test_a_stage_keeps_texts_where_nothing_was_learned(spark):
    schema = "doc_id long, text string, lang string, lang_pred string"
    rows = [(k, "some words of a language", None, "x") for k in range(20)] + [(20, "12 ?", None, "x"), (21, None, None, "x"), (22, "", None, "x")]
    docs = spark.createDataFrame(rows, schema)
    kept = language.accepted(docs, language.fit(docs, language.learned_from(docs["doc_id"])))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(20)) and kept.columns == docs.columns


def test_a_stage_rejects_scores_near_chance(spark):
    rows = [(k, "the words of one language" if k % 2 else "die Wörter der anderen Sprache", "en" if k % 2 else "de") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, language.learned_from(docs["doc_id"]))
    more = spark.createDataFrame([(100, "the words", None), (101, "die Wörter", None)], docs.schema)
    assert {r.doc_id: r.lang for r in language.accepted(more, model).collect()} == {100: "en", 101: "de"}
    assert language.accepted(more, model, over=4.1).count() == 0
