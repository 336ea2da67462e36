import pytest

from basewright import __main__ as command
from basewright.sources import container


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "a.fasta").write_text(">a 1\nACGT\n>b\nACGNacgt\n")
    assert command.main(["convert", f"{tmp_path}/a.fasta", f"{tmp_path}/out"], spark) == 0
    assert "mismatches: 0" in capsys.readouterr().out
    assert command.main(["check", f"{tmp_path}/out"], spark) == 0
    assert "2 records, 0 problems" in capsys.readouterr().out
    assert command.main(["show", f"{tmp_path}/out"], spark) == 0
    text = capsys.readouterr().out
    assert ">a 1 | NUC=DNA | ENC=2b\nACGT\n" in text
    (tmp_path / "t.txt").write_text(text.replace(">b", ">c"))
    assert command.main(["encode", f"{tmp_path}/t.txt", f"{tmp_path}/new", "--version", "1"], spark) == 0
    assert {r.description for r in container.read_records(spark, f"{tmp_path}/new").collect()} == {"a 1", "c"}
    capsys.readouterr()
    assert command.main(["compare", f"{tmp_path}/a.fasta"], spark) == 0
    assert "container_bz2" in capsys.readouterr().out


def test_problems_are_told(spark, tmp_path, capsys):
    (tmp_path / "a.fasta").write_text(">a\nTTUU\n")
    assert command.main(["convert", f"{tmp_path}/a.fasta", f"{tmp_path}/out"], spark) == 1
    out = capsys.readouterr().out
    assert "1 records hold both T and U" in out and "mixed-T/U-in-original" in out
    assert command.main(["convert", f"{tmp_path}/a.fasta", f"{tmp_path}/long", "--long"], spark) == 1
    assert capsys.readouterr().out == out
    for file in (tmp_path / "out").rglob("*.seqs"):
        file.write_bytes(file.read_bytes()[:-3])
    assert command.main(["check", f"{tmp_path}/out"], spark) == 1
    with pytest.raises(SystemExit):
        command.main(["mend", "x"], spark)


def test_compress(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.fasta").write_text(">a\nACGT\n")
    assert command.main(["--log-level", "ERROR", "compress", f"{tmp_path}/in", f"{tmp_path}/out", "--threads", "2", "--replace"], spark) == 0
    assert not (tmp_path / "in" / "x.fasta").exists()
    assert command.main(["compress", f"{tmp_path}/out", f"{tmp_path}/back", "--decompress"], spark) == 0
    assert (tmp_path / "back" / "x.fasta").read_text() == ">a\nACGT\n"


def test_compress_to_a_relative_folder(spark, tmp_path, monkeypatch):
    """Tasks get the folder that the driver means."""
    (tmp_path / "x.fasta").write_text(">a\nACGT\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(command.compressed.commits, "qualified", lambda spark, path: f"file:{tmp_path}/{path}")
    assert command.main(["compress", f"{tmp_path}/x.fasta", "out"], spark) == 0
    assert [f.name for f in (tmp_path / "out").iterdir() if f.name.startswith("x.fasta")]
