"""Notes: Markdown files with YAML in front, read by a Python data source named ``notes``."""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomgraph.functions.paths import normalize_one
from loomgraph.operators.graph import Graph
from loomgraph.schema import DERIVED_ONLY, NODE_COLUMNS, SCAN
from loomgraph.session import saved, scratch, workers_find_us

#: Fixed texts of the error column.
NO_FRONT = "Missing or malformed YAML frontmatter delimiter (expected opening and closing '---')"


class NoteError(ValueError):
    pass


class _Strict(yaml.BaseLoader):
    """All scalars stay text; a key may come once."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if not isinstance(k, str):
                raise yaml.YAMLError(f"key {k!r} is no text")
            if keys.count(k) > 1:
                raise yaml.YAMLError(f"duplicate field `{k}`")
        return super().construct_mapping(node, deep)


def _plain_null(node) -> bool:
    return isinstance(node, yaml.ScalarNode) and node.style is None and node.value in ("", "~", "null", "Null", "NULL")


def split_note(text: str) -> tuple[str, str] | None:
    """(YAML, body), or nothing where the note doesn't begin with it."""
    text = text.lstrip("﻿")
    if not text.startswith("---"):
        return None
    lines = text.split("\n")
    if lines[0].strip() != "---":
        return None
    for i, line in enumerate(lines[1:], 1):
        if line.strip() in ("---", "..."):
            return "\n".join(lines[1:i]), "\n".join(lines[i + 1 :])
    return None


def _fields(front: str) -> dict:
    """The mapping in front; keys whose value is a plain null are left out."""
    loader = _Strict(front)
    try:
        node = loader.get_single_node()
        if not isinstance(node, yaml.MappingNode):
            raise yaml.YAMLError("expected a mapping")
        absent = {k.value for k, v in node.value if isinstance(k, yaml.ScalarNode) and _plain_null(v)}
        return {k: v for k, v in loader.construct_document(node).items() if k not in absent}
    finally:
        loader.dispose()


def _text(d: dict, key: str, needed: bool = False) -> str | None:
    value = d.get(key)
    if value is None and needed:
        raise yaml.YAMLError(f"missing field `{key}`")
    if value is not None and not isinstance(value, str):
        raise yaml.YAMLError(f"{key}: expected a string")
    return value


def _scope(value) -> dict[str, str]:
    if not isinstance(value, dict) or not all(isinstance(v, str) for v in value.values()):
        raise yaml.YAMLError("scope: expected a map of strings")
    return value


def parse_note(text: str, path: str) -> dict:
    """The note as a row of ``schema.NODES``; raises ``NoteError`` with the text for the error column."""
    parts = split_note(text)
    if parts is None:
        raise NoteError(NO_FRONT)
    try:
        d = _fields(parts[0])
        relations = []
        for r in d.get("relations", []):
            if not isinstance(r, dict):
                raise yaml.YAMLError("relations: expected a mapping")
            r = {k: v for k, v in r.items() if v not in ("", "~", "null") or k == "target"}
            relations.append({"type": _text(r, "type", True), "target": _text(r, "target", True), "evidence": _text(r, "evidence"), "scope": None if r.get("scope") is None else _scope(r["scope"])})
        row = {"path": path, "id": _text(d, "id", True), "node_type": _text(d, "type", True), "title": _text(d, "title", True), "status": _text(d, "status"), "valid_from": _text(d, "valid_from"), "valid_until": _text(d, "valid_until"), "scope": _scope(d.get("scope", {})), "relations": relations, "body": parts[1]}
    except (yaml.YAMLError, AttributeError, TypeError) as e:
        raise NoteError(f"Invalid YAML frontmatter: {e}") from e
    for r in relations:
        if r["type"] in DERIVED_ONLY:
            raise NoteError(f"Inverse relation type '{r['type']}' cannot be declared in frontmatter (inverse relations are dynamically derived)")
    return row


def note_files(root: str, fail: bool = False) -> list[str]:
    """Paths below ``root``, sorted; hidden files and folders are left out, links not followed."""
    def stop(e: OSError) -> None:
        if fail:
            raise e

    out = []
    for folder, folders, files in os.walk(root, onerror=stop):
        folders[:] = [f for f in folders if not f.startswith(".")]
        out += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if not f.startswith(".") and f.lower().endswith((".md", ".markdown"))]
    return sorted(out)


def read_row(root: str, path: str) -> tuple:
    try:
        row = parse_note(Path(root, path).read_bytes().decode("utf-8"), path)
    except (OSError, UnicodeDecodeError) as e:
        return (path, *[None] * (len(NODE_COLUMNS) - 1), f"I/O error reading note: {e}")
    except NoteError as e:
        return (path, *[None] * (len(NODE_COLUMNS) - 1), str(e))
    return (*(row[c] for c in NODE_COLUMNS), None)


def _entries(folder: str) -> list[os.DirEntry]:
    """What lies in a folder but what is hidden; a folder that can't be read is empty."""
    try:
        with os.scandir(folder) as found:
            return sorted((e for e in found if not e.name.startswith(".")), key=lambda e: e.name)
    except OSError:
        return []


def folders_below(root: str) -> Iterator[str]:
    """Folders as seen from ``root``, itself first; links aren't followed."""
    todo = [""]
    while todo:
        at = todo.pop()
        yield at
        todo += [f"{at}{e.name}/" for e in reversed(_entries(os.path.join(root, at))) if e.is_dir(follow_symlinks=False)]


class _Part(InputPartition):
    """Those files of a folder whose names' checksums leave ``rest`` by ``shards``."""

    def __init__(self, folder: str, shards: int, rest: int):
        self.folder, self.shards, self.rest = folder, shards, rest


class _Reader(DataSourceReader):
    """The driver knows folders only: files are listed where they are read."""

    def __init__(self, root: str, shards: int):
        self.root, self.shards = root, shards

    def partitions(self) -> list[_Part]:
        return [_Part(f, self.shards, i) for f in folders_below(self.root) for i in range(self.shards)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for e in _entries(os.path.join(self.root, partition.folder)):
            if e.name.lower().endswith((".md", ".markdown")) and not e.is_dir() and zlib.crc32(e.name.encode()) % partition.shards == partition.rest:
                yield read_row(self.root, partition.folder + e.name)


def note_text(row: dict) -> str:
    """A note as a file: what isn't null or empty in front, then the body. ``parse_note`` gives the row again."""
    given = {"id": row["id"], "type": row["node_type"], "title": row["title"], "status": row["status"], "valid_from": row["valid_from"], "valid_until": row["valid_until"]}
    front = {k: v for k, v in given.items() if v is not None}
    if row["scope"]:
        front["scope"] = dict(row["scope"])
    if row["relations"]:
        front["relations"] = [{k: dict(v) if k == "scope" else v for k, v in (("type", r["type"]), ("target", r["target"]), ("evidence", r["evidence"]), ("scope", r["scope"])) if v is not None} for r in row["relations"]]
    return f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True, width=1 << 30)}---\n{row['body'] or ''}"


@dataclass
class _Written(WriterCommitMessage):
    files: int


class _Writer(DataSourceWriter):
    """Tasks write into a staged folder; it takes the place of the old one when all are done, so no reader sees a part.

    A file's name is its note's path, so a task that is run again writes the same files again, each whole.
    """

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = os.path.abspath(root), overwrite
        self.staged = f"{self.root}.{uuid.uuid4().hex}.staged"
        if os.path.exists(self.root) and not overwrite:
            raise NoteError(f"Folder '{root}' exists")
        os.makedirs(self.staged)

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        n, mark = 0, TaskContext.get().taskAttemptId()
        for row in rows:
            d = row.asDict(recursive=True)
            if d["path"] is None or (path := normalize_one(d["path"])) is None or d["path"].startswith("/") or not path.lower().endswith((".md", ".markdown")):
                raise NoteError(f"'{d['path']}' is no path of a note in the vault")
            file = Path(self.staged, path)
            file.parent.mkdir(parents=True, exist_ok=True)
            temp = file.with_name(f".{mark}.tmp")
            temp.write_bytes((d["content"] if "content" in d else note_text(d)).encode())
            os.replace(temp, file)
            n += 1
        return _Written(n)

    def commit(self, messages: list[_Written | None]) -> None:
        old = f"{self.root}.{uuid.uuid4().hex}.old"
        if os.path.exists(self.root):
            os.rename(self.root, old)
        os.rename(self.staged, self.root)
        shutil.rmtree(old, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


class NotesSource(DataSource):
    """Options: path (a folder that all executors see) and shards (parts of each folder for reading, 4).

    Written are rows of ``schema.NODES``, or of path and content, a file for each; of rows with one path one counts.
    """

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return SCAN

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("shards", "4")))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder of intermediate tables as a path of the file system, where files of notes can lie."""
    found = re.sub("^file:(//)?", "", scratch(spark))
    if not found.startswith("/"):
        raise ValueError(f"'{found}' is no folder of the file system")
    return found


def save_vault(rows: DataFrame, root: str, overwrite: bool = False) -> None:
    """Writes notes as files below ``root``: all of them or none."""
    workers_find_us(rows.sparkSession)
    rows.sparkSession.dataSource.register(NotesSource)
    rows.write.format("notes").option("path", root).mode("overwrite" if overwrite else "append").save()


def load_vault(spark: SparkSession, root: str) -> Graph:
    workers_find_us(spark)
    spark.dataSource.register(NotesSource)
    rows: DataFrame = saved(spark.read.format("notes").option("path", root).load())
    return Graph(rows.where("error is null").select(*NODE_COLUMNS), rows.where("error is not null").select("path", "error"))
