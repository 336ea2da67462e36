import os
import time
from concurrent.futures import ThreadPoolExecutor

import pytest

from basewright import __main__ as command
from basewright.operators import convert
from basewright.sources import commits, container, edit_text

SCHEMA = "file string, rec_no long, description string, sequence string, nuc string"


def frame(spark, name, n=6):
    return spark.createDataFrame([("f", i, f"{name}{i}", "ACGT" * i, "DNA") for i in range(1, n + 1)], SCHEMA)


def held(spark, folder, back=0):
    return {r.description[0] for r in container.read_records(spark, folder, back=back).collect()}


class Killed(Exception):
    pass


def killed(*_, **__):
    raise Killed


@pytest.mark.parametrize("step", ["task", "index", "check", "before the log", "entry is written", "entry is put", "after the entry"])
def test_a_write_that_is_killed_leaves_the_last_commit(spark, tmp_path, monkeypatch, step):
    folder = f"{tmp_path}/out"
    container.write_records(frame(spark, "a"), folder)
    check = None
    if step == "task":  # the second file of a task is bad
        rows = frame(spark, "b").union(spark.createDataFrame([("f", 9, "b", "MKL", "DNA")], SCHEMA))
    else:
        rows = frame(spark, "b")
    if step == "index":
        monkeypatch.setattr(type(rows.write), "parquet", killed)
    elif step == "check":
        check = killed
    elif step == "before the log":
        monkeypatch.setattr(commits, "commit", killed)
    elif step == "entry is written":
        monkeypatch.setattr(commits, "linked", killed)
    elif step == "entry is put":
        linked = commits.linked
        monkeypatch.setattr(commits, "linked", lambda *x: linked(*x) and killed())
    elif step == "after the entry":
        monkeypatch.setattr(container, "manifest", killed)
    with pytest.raises(Exception):
        container.write_records(rows, folder, check=check)
    monkeypatch.undo()
    assert held(spark, folder) == {"b" if step in ("entry is put", "after the entry") else "a"}
    container.write_records(frame(spark, "c"), folder)
    assert held(spark, folder) == {"c"}


def test_nothing_committed_is_an_error(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/out"
    with monkeypatch.context() as m:
        m.setattr(commits, "commit", killed)
        with pytest.raises(Killed):
            container.write_records(frame(spark, "a"), folder)
    with pytest.raises(FileNotFoundError, match="committed"):
        container.read_records(spark, folder)
    container.write_records(frame(spark, "b"), folder)
    assert held(spark, folder) == {"b"}


def test_a_reader_keeps_what_it_has_begun_to_read(spark, tmp_path):
    folder = f"{tmp_path}/out"
    container.write_records(frame(spark, "a"), folder)
    before = container.read_records(spark, folder)
    # records of the folder itself are written back to it
    container.write_records(before.selectExpr("file", "rec_no", "concat('b', description) AS description", "sequence", "nuc"), folder)
    assert {r.description[0] for r in before.collect()} == {"a"} and held(spark, folder) == {"b"} and held(spark, folder, 1) == {"a"}
    with pytest.raises(FileNotFoundError, match="2 commits"):
        held(spark, folder, 2)


def test_writers_at_the_same_time(spark, tmp_path):
    folder = f"{tmp_path}/out"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda x: container.write_records(frame(spark, x), folder, files=1).collect(), "abcd"))
    assert [len(held(spark, folder, back)) for back in range(4)] == [1] * 4
    assert set.union(*(held(spark, folder, back) for back in range(4))) == set("abcd")


@pytest.mark.parametrize("way", ["linked", "renamed"])
def test_an_entry_is_put_once(spark, tmp_path, monkeypatch, way):
    if way == "renamed":
        monkeypatch.setattr(commits, "linked", lambda part, found: commits.renamed(spark, part, found))
    assert commits.put_if_absent(spark, f"{tmp_path}/00", "one") and not commits.put_if_absent(spark, f"{tmp_path}/00", "two")
    assert commits.contents(spark, f"{tmp_path}/00") == "one"
    assert [p for p in os.listdir(tmp_path) if not p.endswith(".crc")] == ["00"]


def test_restore_and_vacuum(spark, tmp_path):
    folder = f"{tmp_path}/out"
    for x in "abc":
        edit_text.save(frame(spark, x), folder)
    assert commits.restore(spark, folder) == 4 and held(spark, folder) == {"b"} and held(spark, folder, 1) == {"c"}
    (tmp_path / "out" / "notes.txt").write_text("mine")
    assert commits.vacuum(spark, folder) == [] and len(commits.vacuum(spark, folder, keep=2, hours=-1)) == 1
    assert held(spark, folder) == {"b"} and held(spark, folder, 1) == {"c"} and (tmp_path / "out" / "notes.txt").exists()


def test_folders_of_others_are_refused(spark, tmp_path):
    work = tmp_path / "work"
    work.mkdir()
    (work / "x.fasta").write_text(">a\nACGT\n")
    (work / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="holds the input"):
        convert.convert_fasta(spark, f"{work}/x.fasta", str(work))
    with pytest.raises(ValueError, match="holds the input"):
        convert.convert_fasta(spark, str(work), str(work))
    with pytest.raises(ValueError, match="not written by this sink"):
        container.write_records(frame(spark, "a"), str(work))
    with pytest.raises(ValueError, match="is a file"):
        edit_text.save(frame(spark, "a"), f"{work}/notes.txt")
    assert {p.name for p in work.iterdir()} == {"x.fasta", "notes.txt"}
    assert (work / "x.fasta").read_text() == ">a\nACGT\n"


def test_relative_paths_and_the_folder_beside_the_input(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "x.fasta").write_text(">a 1\nACGT\n>b\nACGNacgt\n")
    # Hadoop's working folder is that of the JVM
    relative = os.path.relpath(tmp_path, spark.sparkContext._jvm.java.lang.System.getProperty("user.dir"))
    assert command.main(["convert", f"{relative}/x.fasta", f"{relative}/out"], spark) == 0
    assert command.main(["check", f"{relative}/out"], spark) == 0
    assert "2 records, 0 problems" in capsys.readouterr().out
    assert command.main(["convert", f"{relative}/x.fasta"], spark) == 0
    assert {p.name for p in tmp_path.iterdir()} == {"x.fasta", "out", "x.seqs"}
    (tmp_path / "t.txt").write_text(">c | nuc=rna\nACG\n")
    assert command.main(["encode", f"{relative}/t.txt", f"{relative}/out"], spark) == 0
    assert container.read_records(spark, f"{relative}/out").first().sequence == "ACG"
    assert container.read_records(spark, f"{relative}/out", back=1).count() == 2


def test_old_entries_stay_readable_while_writers_wait(spark, tmp_path):
    folder = f"{tmp_path}/out"
    container.write_records(frame(spark, "a"), folder)
    with ThreadPoolExecutor(2) as pool:
        done = pool.submit(lambda: [container.write_records(frame(spark, x, 3 + k), folder).collect() for k, x in enumerate("bcd")])
        sizes = {"a": 6, "b": 3, "c": 4, "d": 5}
        while not done.done():
            rows = container.read_records(spark, folder).collect()
            assert len({r.description[0] for r in rows}) == 1 and len(rows) == sizes[rows[0].description[0]]
            time.sleep(0.05)
        done.result()
