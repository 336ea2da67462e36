import random
import re

from pyspark.sql import functions as F

from basewright.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def brute(text):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(a, k, b) for a, _, k, b in sorted(out)]


def random_text(rng):
    parts = ["password", "PassWD", "secret", "toKen", "apikey", "API_KEY", "=", ":", ' = "', "': ", "abcdefgh", "abc", "x+/_.=-yz", "AKIA", "AKIAABCDEF123456", "A1B2C3D4E5F6G7", "0123456789abcdef", "deadbeef" * 4, " ", "\n", "ſecret", "é😀", "ß", "."]
    return "".join(rng.choices(parts, k=rng.randint(0, 40)))


def versions(spark, rows):
    return secrets.as_versions(spark.createDataFrame(rows, "doc_id long, text string, spans string, blob int"))


def test_spans_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    texts = [random_text(rng) for _ in range(400)] + ["password=secret:abcdefghij", "", None, "long " * 30000 + "token=abcdefgh1"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "", 1), (None, "AKIA" + "Z" * 12, "", 1)] + [(5000 + i, texts[0], "", 0) for i in range(50)]
    got = secrets.scan_versions(versions(spark, rows), f"file://{tmp_path}/ledger").collect()
    assert len(got) == len(rows)
    want = sorted(((i, brute(t or "")) for i, t, *_ in rows), key=str)
    assert sorted(((r.path, [(s.start, s.kind, s.stop) for s in r.spans]) for r in got), key=str) == want


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    first = [(1, "token=abcdefgh", "", 0), (2, "clean", "", 0), (3, "clean", "", 0)]
    secrets.scan_versions(versions(spark, first), ledger).collect()
    table = lambda: {(r.blob, r.rule) for r in spark.read.parquet(ledger).collect()}
    assert spark.read.parquet(ledger).count() == len(table()) == 2 * 3
    # history: path 1 changes, path 4 is a copy; then one rule gets a new version
    second = [*first, (1, "AKIA" + "Q" * 16, "", 0), (4, "token=abcdefgh", "", 0)]
    got = secrets.scan_versions(versions(spark, second), ledger).collect()
    assert sorted((r.path, len(r.spans)) for r in got) == [(1, 1), (1, 1), (2, 0), (3, 0), (4, 1)]
    assert spark.read.parquet(ledger).count() == len(table()) == 3 * 3
    longer = tuple(secrets.Rule(r.kind, r.pattern, r.group, 9, "2") if r.kind == "assign" else r for r in secrets.RULES)
    got = secrets.scan_versions(versions(spark, second), ledger, longer).collect()
    assert sorted((r.path, len(r.spans)) for r in got) == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)]
    assert spark.read.parquet(ledger).count() == len(table()) == 3 * 4


def test_redaction(spark, tmp_path):
    text = 'é token = "' + "ab12" * 10 + '" and AKIA' + "Z" * 16
    rows = versions(spark, [(1, text, "", 0), (2, "clean", "", 0)])
    got = secrets.scan_versions(rows, f"file://{tmp_path}/ledger").join(rows, "path").select("path", secrets.redact(F.col("text"), F.col("spans")).alias("t"))
    assert {r.path: r.t for r in got.collect()} == {1: 'é [SECRET]" and [SECRET]', 2: "clean"}


def test_no_versions(spark, tmp_path):
    assert secrets.scan_versions(versions(spark, []), f"file://{tmp_path}/ledger").count() == 0


def test_very_many_matches_in_one_text(spark):
    import time

    rng = random.Random(2)
    words = [f"AKIA{rng.randrange(16**12):012X}{'é' * rng.randint(0, 2)}" if rng.random() < 0.9 else "AKIAshort token=abcdefgh1" for _ in range(40_000)]
    text = " ".join(words)
    frame = spark.createDataFrame([(1, text, "", 0)], "doc_id long, text string, spans string, blob int")
    spans = F.array_sort(F.concat(*[secrets.rule_spans(F.col("text"), r, k) for k, r in enumerate(secrets.RULES)]))
    began = time.perf_counter()
    got = frame.select(spans.alias("s")).first().s
    took = time.perf_counter() - began
    assert [(s.start, s.kind, s.stop) for s in got] == brute(text) and len(got) > 39_000
    held = spark.createDataFrame([(text, got)], f"text string, s array<{secrets.SPAN}>")
    began = time.perf_counter()
    clean = held.select(secrets.redact(F.col("text"), F.col("s")).alias("t")).first().t
    took += time.perf_counter() - began
    want, at = [], 0
    for a, _, b in brute(text):
        if a >= at:
            want += [text[at:a], "[SECRET]"]
        at = max(at, b)
    assert clean == "".join(want) + text[at:]
    assert took < 25  # seconds, on a slow machine; it was minutes while arrays grew by copies


def test_another_pattern_is_another_rule(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    rows = versions(spark, [(1, "AKIA" + "Q" * 16, "", 0)])
    secrets.scan_versions(rows, ledger).collect()
    other = tuple(secrets.Rule(r.kind, "BKIA[A-Z]+" if r.kind == "access" else r.pattern, r.group, r.least) for r in secrets.RULES)
    assert [len(r.spans) for r in secrets.scan_versions(rows, ledger, other).collect()] == [0]
    assert spark.read.parquet(ledger).count() == 4
