import random

import pytest

from basewright.sources import container, edit_text

GOOD = "# comment\n>r1 x | NUC=RNA | ENC=2b\nACGU\nAC GU\n\n>r2\nacgt\n"


def parsed(spark, *texts, carry=False):
    df = spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, text string")
    return sorted((r.file, r.rec_no, r.description, r.sequence, r.nuc_hint, r.problem) for r in edit_text.parse(df, carry).collect())


def test_well_formed(spark):
    assert parsed(spark, GOOD) == [("f0", 1, "r1 x", "ACGUACGU", "RNA", None), ("f0", 2, "r2", "acgt", None, None)]


CASES = {
    "header_only": (">a\n", [(1, "a", "", None, "Record has no sequence")]),
    "no_records": ("# x\n\n", [(0, None, None, None, "No records")]),
    "bad_hint": (">a | NUC=protein\nAC", [(1, "a", "AC", None, None)]),
    "last_hint": (">a | NUC=dna | x | NUC=RNA | NUC=y\nAC", [(1, "a", "AC", "RNA", None)]),
    "empty_header": (">\nAC", [(1, "", "AC", None, None)]),
    "bar": (">a|b |c\nAC", [(1, "a|b |c", "AC", None, None)]),
    "breaks": (">a\r\nAC\x0cGT TT\r\n", [(1, "a", "ACGTTT", None, None)]),
    "comment_inside": (">a\nAC\n#no\n G\tT \n", [(1, "a", "ACGT", None, None)]),
    "two_headers": (">a\n>b\nAC", [(1, "a", "", None, "Record has no sequence"), (2, "b", "AC", None, None)]),
    "before": ("AC\n>a\nGT", [(1, "a", "ACGT", None, "Sequence outside of a record")]),
    "blank_inside": (">a\nAC\n\nGT\n>b\nTT", [(1, "a", "AC", None, None), (2, "b", "GTTT", None, "Sequence outside of a record")]),
    "after_last": (">a\nAC\n\nGT\n", [(1, "a", "AC", None, None), (2, None, "GT", None, "Sequence after the last record")]),
    "spaces_line": (">a\nAC\n  \nGT", [(1, "a", "ACGT", None, None)]),
}


@pytest.mark.parametrize("name", CASES)
def test_cases(spark, name):
    text, want = CASES[name]
    assert [r[1:] for r in parsed(spark, text)] == want


def slow(text):
    """Line by line, with strays carried on."""
    out, head, parts = [], None, []

    def flush():
        nonlocal head, parts
        if head is None:
            return
        out.append((head, "".join(parts).replace(" ", "").replace("\t", "")))
        head, parts = None, []

    for line in text.splitlines():
        if line == "":
            flush()
        elif line.startswith("#"):
            continue
        elif line.startswith(">"):
            flush()
            head = line[1:].strip().split(" | ")[0].strip()
        else:
            parts.append(line.strip())
    flush()
    return out


def test_carrying_equals_a_line_by_line_parser(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choice(["", "", ">h", ">k | NUC=DNA", "AC", " G T", "#c", "N" * 90]) for _ in range(rng.randint(0, 14))) for _ in range(120)]
    got = {}
    for file, _, description, sequence, _, problem in parsed(spark, *texts, carry=True):
        if description is not None:
            got.setdefault(file, []).append((description, sequence))
    for i, t in enumerate(texts):
        assert got.get(f"f{i}", []) == slow(t), repr(t)


@pytest.mark.parametrize("carry", [False, True])
def test_any_cut_into_blocks_gives_the_same(spark, carry):
    """Texts are cut between lines anywhere, stray lines and empty ones over the cuts, and blocks come in any order."""
    rng = random.Random(11)
    texts = ["\n".join(rng.choice(["", "", ">h", ">k | NUC=DNA", "AC", " G T", "#c", "G\x0cT", "A\r", "\x0b"]) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    blocks = []
    for i, t in enumerate(texts):
        block = 0
        for k, line in enumerate(t.split("\n")):
            block += k > 0 and rng.random() < 0.4
            blocks.append((f"f{i}", block, k, line.encode()))
    rows = spark.createDataFrame(blocks, "file string, block long, k long, value binary").repartition(7, "file", "block").sortWithinPartitions("file", "block", "k").drop("k")
    files = spark.createDataFrame([(f"f{i}",) for i in range(len(texts))], "file string")
    found = edit_text.parse_blocks(rows, files, carry).collect()
    key = lambda r: tuple(x or "" for x in (r[0], str(r[1]), *r[2:]))
    got = sorted(((r.file, r.rec_no, r.description, r.sequence, r.nuc_hint, r.problem) for r in found), key=key)
    want = sorted(parsed(spark, *texts, carry=carry), key=key)
    assert got == want


def test_a_file_in_many_tasks(spark, tmp_path):
    text = "".join(f">r{i} | NUC=RNA\n" + "ACGTN acgtn\r\n" * (i % 90) + ("\nAC\n" if i % 11 == 0 else "\n") for i in range(400))
    (tmp_path / "big.txt").write_text(text, newline="")
    (tmp_path / "empty.txt").write_text("# nothing\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert spark.read.text(f"{tmp_path}/big.txt").rdd.getNumPartitions() > 8
        got = edit_text.read_edit_text(spark, f"{tmp_path}/*.txt", mode="PERMISSIVE").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.problem for r in got if r.file.endswith("empty.txt")] == ["No records"]
    got = sorted((r.rec_no, r.description, r.sequence, r.nuc_hint, r.problem) for r in got if r.file.endswith("big.txt"))
    assert got == [r[1:] for r in parsed(spark, text)]


def test_files(spark, tmp_path):
    rows = [("f", i, f"d{i}", "ACGTNnacgt" * (1 + i * 20), "DNA") for i in range(1, 30)]
    df = spark.createDataFrame(rows, "file string, rec_no long, description string, sequence string, nuc string")
    edit_text.write_edit_text(df, f"{tmp_path}/t")
    got = edit_text.read_edit_text(spark, f"{tmp_path}/t").collect()
    assert sorted((r.description, r.sequence, r.nuc) for r in got) == sorted((r[2], r[3], r[4]) for r in rows)
    (tmp_path / "bad.txt").write_text(">a\n")
    with pytest.raises(Exception, match="no sequence"):
        edit_text.read_edit_text(spark, f"{tmp_path}/bad.txt").collect()
    assert edit_text.read_edit_text(spark, f"{tmp_path}/bad.txt", mode="PERMISSIVE").first().problem


def test_saving_keeps_what_was_there(spark, tmp_path):
    schema = "file string, rec_no long, description string, sequence string, nuc string"
    first = spark.createDataFrame([("f", 1, "a", "ACGT", "DNA")], schema)
    second = spark.createDataFrame([("f", 1, "b", "ACGU", "RNA")], schema)
    folder = f"{tmp_path}/s"
    edit_text.save(first, folder)
    assert edit_text.save(second, folder).first().description == "b"
    assert container.read_records(spark, folder, back=1).first().description == "a"
    with pytest.raises(ValueError):
        edit_text.save(spark.createDataFrame([("f", 1, "", "ACGT", "DNA")], schema), folder)
    assert container.read_records(spark, folder).first().description == "b"
    reasons = {r.reason for r in edit_text.violations(spark.createDataFrame([("f", 1, None, "A", "DNA"), ("f", 2, "x", "", "DNA"), ("f", 3, "x", "A", None), ("f", 4, "x", "A", "RNA")], schema)).collect()}
    assert reasons == {"empty description", "empty sequence", "unknown type"}
