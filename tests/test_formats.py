"""Formats of extractors, and the command lines."""

import json

import pytest
from pyspark.sql import functions as F

from tesserine import cli
from tesserine.sources import formats, readers

LINES = ['{"content": "first"}', "", "plain", '{"content": ""}', '{"content": null}', '{"content": ["a", 1]}', "   ", '{"content": 0}', "[1]", '{"content": "été"}', "{broken"]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(LINES))
    (tmp_path / "in" / "deep" / "b.jsonl").write_bytes("x\r\ny\rz\r\n\r\n".encode())
    (tmp_path / "in" / "empty.jsonl").write_text("")
    (tmp_path / "in" / "other.txt").write_text("not read")
    return str(tmp_path / "in")


def rows(df):
    return sorted((r["file"].rsplit("/", 1)[-1], r["entry_idx"], r["line_no"], r["text"]) for r in df.collect())


def test_the_format_equals_the_reader(spark, folder, monkeypatch):
    want = rows(readers.jsonl_entries(readers.read_lines(spark, folder, "*.jsonl")))
    mine = formats.entries(spark, folder, glob="*.jsonl")
    assert rows(mine) == want and len(want) == 12
    assert {r["file"] for r in mine.collect()} == {r["file"] for r in readers.read_files(spark, folder, "*.jsonl").collect()}
    assert set(formats.register_formats(spark)) >= {"tesserine-jsonl", "tesserine-text"}
    plain = spark.read.format("tesserine-text").option("pathGlobFilter", "*.jsonl").load(f"file://{folder}")
    assert [r[3] for r in rows(plain) if r[0] == "b.jsonl"] == ["x", "y", "z"]
    assert list(formats._lines(formats.fs.LocalFileSystem(), f"{folder}/deep/b.jsonl")) == ["x", "y", "z", "", ""]
    monkeypatch.setattr(formats, "BLOCK", 2)
    assert list(formats._lines(formats.fs.LocalFileSystem(), f"{folder}/deep/b.jsonl")) == ["x", "y", "z", "", ""]
    assert list(formats._lines(formats.fs.LocalFileSystem(), f"{folder}/a.jsonl")) == LINES


def test_a_new_extractor_is_registered(spark, folder):
    def words(lines):
        entry = 0
        for line_no, line in enumerate(lines, 1):
            for word in line.split():
                yield entry, line_no, word
                entry += 1

    with pytest.raises(ValueError):
        readers.Domain("d", folder, extractor="words")
    formats.register_extractor("words", words)
    try:
        assert readers.Domain("d", folder, extractor="words").extractor == "words"
        got = formats.entries(spark, folder, "words", "b.jsonl")
        assert [r[1:] for r in rows(got)] == [(0, 1, "x"), (1, 2, "y"), (2, 3, "z")]
        with pytest.raises(ValueError):
            formats.register_extractor("words", words)
    finally:
        del formats._EXTRACTORS["words"]
    for wrong in ("words", "notification"):
        with pytest.raises(ValueError):
            formats.entries(spark, folder, wrong)


# --- command lines


def said(capsys):
    return json.loads(capsys.readouterr().out)


def test_an_index_from_the_command_line(spark, folder, tmp_path, capsys):
    root = str(tmp_path / "index")
    assert cli.main(["index", "build", "--dir", folder, "--pattern", "*.jsonl", "--output", root]) == 0
    assert said(capsys)["added"] == 2  # Spark's file source passes over empty files
    (tmp_path / "in" / "c.jsonl").write_text("\nfirst plain\n")
    assert cli.main(["index", "update", "--dir", folder, "--pattern", "*.jsonl", "--index", root]) == 0
    assert said(capsys)["added"] == 1
    assert cli.main(["index", "query", "--index", root, "--query", "first plain"]) == 0
    hits = said(capsys)["hits"]
    assert [(h["file"].rsplit("/", 1)[-1], h["entry_idx"], h["line_no"]) for h in hits] == [("c.jsonl", 0, 2)]
    assert cli.main(["index", "query", "--index", root, "--query", "first plain", "--any"]) == 0
    assert len(said(capsys)["hits"]) == 3
    other = str(tmp_path / "text-index")
    assert cli.main(["index", "build", "--dir", folder, "--pattern", "*.txt", "--extractor", "text", "--output", other]) == 0
    assert said(capsys)["added"] == 1
    assert cli.main(["index", "query", "--index", other, "--query", "read"]) == 0
    assert len(said(capsys)["hits"]) == 1
    assert cli.main(["index", "query", "--index", str(tmp_path / "none"), "--query", "x"]) == 1


def test_maintenance_and_archives_from_the_command_line(spark, tmp_path, capsys):
    from test_runs import T0, graph_of

    from tesserine.operators.runs import GraphStore

    root, where = str(tmp_path / "graph"), str(tmp_path / "runs")
    graphs = GraphStore(spark, root)
    obs = [(1, "a", "Shared words here"), (2, "b", "shared words too")]
    graphs.commit(graph_of(spark, [("a", "Bug"), ("b", "Fix"), ("c", "TestSuite")], obs))
    assert cli.main(["maintain", "--graph", root, "--runs", where, "--run-id", "r"]) == 0
    assert said(capsys) == {"run_id": "r", "added_relations": 1, "renamed": 2, "applied": False}
    assert graphs.read().relations.count() == 0
    assert cli.main(["maintain", "--graph", root, "--runs", where, "--replay", "r", "--from-stage", "validate", "--apply"]) == 0
    assert said(capsys)["applied"] is True
    assert {r["entity_type"] for r in graphs.read().entities.collect()} == {"Bug", "fix", "test"} and graphs.read().relations.count() == 1
    assert cli.main(["maintain", "--graph", root, "--runs", where, "--replay", "none"]) == 1
    capsys.readouterr()
    assert cli.main(["archive", "--graph", root, "--archive-dir", str(tmp_path / "old"), "--days", "90", "--now", "2024-12-01"]) == 0
    assert said(capsys) | {"archive_path": ""} == {"archived": 2, "total_before": 2, "backup_version": None, "deleted": 0, "index_rebuilt": False, "archive_path": ""}
    assert cli.main(["archive", "--graph", root, "--archive-dir", str(tmp_path / "old"), "--now", "2024-12-01", "--apply"]) == 0
    done = said(capsys)
    assert done["deleted"] == 2 and spark.read.json(done["archive_path"]).count() == 2 and graphs.read().observations.where(F.col("created_at") < F.lit(T0)).count() == 0
    assert cli.main(["archive", "--graph", root, "--archive-dir", str(tmp_path / "old"), "--days", "-1"]) == 1
