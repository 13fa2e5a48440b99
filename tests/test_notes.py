"""Notes written as files and read again: whole, or not at all."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.plans import packets
from loomgraph.schema import NODES
from loomgraph.sources.notes import load_vault, note_text, parse_note, save_vault

ODD = ["plain", "null", "~", "", "123", "true", "2020-01-01", "a: b", "- x", "'quoted'", '"', "é\tü", "# no comment", "line\nend", "  spaces ", "[[link]]", "--- ", "x" * 300]


def row(i, text):
    rel = [{"type": "depends_on", "target": text or "t", "evidence": None, "scope": None}, {"type": "supersedes", "target": "t", "evidence": "of " + text, "scope": {"k": text or "v"}}, {"type": "relates_to", "target": "t", "evidence": None, "scope": {}}]
    return {"path": f"d{i % 3}/e/n{i}.md", "id": f"id {text}", "node_type": "Note", "title": text, "status": text if i % 2 else None, "valid_from": None, "valid_until": "2020-01-01", "scope": {"k": text, "l": "1"} if i % 3 else {}, "relations": rel if i % 4 else [], "body": f"{text}\n---\nmore\r\n"}


def test_a_note_as_text_is_the_same_note_again():
    for i, text in enumerate(ODD):
        assert parse_note(note_text(row(i, text)), row(i, text)["path"]) == row(i, text)


def test_vault_round_trip(spark, tmp_path):
    rows = [row(i, t) for i, t in enumerate(ODD)]
    root = str(tmp_path / "vault")
    df = spark.createDataFrame(rows, NODES).repartition(4)
    save_vault(df, root)
    (tmp_path / "vault" / ".hidden").mkdir()
    (tmp_path / "vault" / ".hidden" / "x.md").write_text("---\n")
    (tmp_path / "vault" / "bad.MD").write_bytes(b"\xff")
    (tmp_path / "vault" / "other.txt").write_text("---\n")
    g = load_vault(spark, root)
    assert sorted((r.asDict(recursive=True) for r in g.nodes.collect()), key=lambda r: r["path"]) == sorted(rows, key=lambda r: r["path"])
    assert [r.path for r in g.malformed.collect()] == ["bad.MD"]
    before = sorted(os.listdir(tmp_path))
    with pytest.raises(Exception, match="exists"):
        save_vault(df, root)
    # a task fails: what was there stays as it was, and nothing else is left
    with pytest.raises(Exception, match="no path of a note"):
        save_vault(df.withColumn("path", F.when(F.col("path") == "d1/e/n4.md", F.lit("../out.md")).otherwise(F.col("path"))), root, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == before == ["vault"] and load_vault(spark, root).nodes.count() == len(rows)
    save_vault(spark.createDataFrame([("a/b.md", "no front"), ("c.markdown", None)], "path string, content string").na.fill(""), root, overwrite=True)
    g = load_vault(spark, root)
    assert g.nodes.count() == 0 and {r.path for r in g.malformed.collect()} == {"a/b.md", "c.markdown"} and os.listdir(tmp_path) == ["vault"]
    assert load_vault(spark, str(tmp_path / "nothing")).nodes.count() == 0


def test_errors_have_their_classes():
    for day in ("2020-13-01", "2020-1-1", "x"):
        with pytest.raises(packets.InvalidDateFormat):
            packets.check_date(day)
    assert issubclass(packets.MissingAsOf, packets.QueryError) and issubclass(packets.UnsupportedMode, packets.QueryError)
