"""Planning and applying note normalisations, each bound to hashes of the file before and after."""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import re
import sys
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import SparkSession

from loomgraph.functions.paths import folder_of, normalize_one, relative_one, slug_one
from loomgraph.session import workers_find_us
from loomgraph.sources.notes import note_files, split_note

ORDER = ("id", "type", "title", "status", "valid_from", "valid_until", "scope", "relations")
_LINK = re.compile(r"\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]")
_FENCE = re.compile(r"\s*(```|~~~)")


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def wikilink_target(src: str, target: str, files: list[str]) -> str:
    """A link from ``src`` to the first file named by ``target``; unknown names become ``./name.md``. Anchors stay."""
    base, sign, anchor = target.strip().partition("#")
    for form in (lambda x: x, str.lower):
        for p in files:
            name = p.rpartition("/")[2]
            if form(base) in {form(x) for x in (p, p.removesuffix(".md"), name, name.rpartition(".")[0])}:
                return relative_one(folder_of(src), p) + sign + anchor
    return (base if base.startswith(("./", "../")) else f"./{base}") + ("" if base.endswith((".md", ".markdown")) else ".md") + sign + anchor


def rewrite_wikilinks(body: str, src: str, files: list[str]) -> str:
    """Wikilinks outside code fences become Markdown links."""
    out, fenced = [], False
    for line in body.split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
        elif not fenced:
            line = _LINK.sub(lambda m: f"[{m[2] or m[1]}]({wikilink_target(src, m[1], files)})", line)
        out.append(line)
    return "\n".join(out)


def normalized(text: str, src: str, files: list[str]) -> str | None:
    """The note in canonical form, or nothing if it is in it: an id, top-level ``supersedes`` as relations, links by path."""
    parts = split_note(text)
    front, body = parts if parts else ("", text.lstrip("﻿"))
    d = yaml.safe_load(front) if front.strip() else {}
    if d is None:
        d = {}
    if not isinstance(d, dict):
        raise yaml.YAMLError("expected a mapping")
    new = rewrite_wikilinks(body, src, files)
    stem = src.rpartition("/")[2].rpartition(".")[0]
    title = m[1].strip() if (m := re.search(r"^# (.+)$", body, re.MULTILINE)) else stem
    changed = new != body or parts is None
    if not isinstance(d.get("id"), str) or not d["id"].strip():
        d, changed = d | {"id": slug_one(stem)}, True
    for k, v in (("type", "Note"), ("title", title)):
        if k not in d:
            d, changed = d | {k: v}, True
    if "supersedes" in d:
        old = d.pop("supersedes")
        names = [x for x in (old if isinstance(old, list) else [old]) if isinstance(x, str)]
        d["relations"] = [*(d.get("relations") or []), *({"type": "supersedes", "target": n} for n in names)]
        changed = True
    relations = d.get("relations") or []
    for r in relations:
        t = r.get("target", "") if isinstance(r, dict) else ""
        if isinstance(t, str) and t.startswith("[["):
            changed = True
    if not changed:
        return None
    for r in relations:
        if isinstance(r, dict) and isinstance(r.get("target"), str):
            t = r["target"].strip()
            r["target"] = wikilink_target(src, t[2:-2].partition("|")[0] if t.startswith("[[") and t.endswith("]]") else t, files) if not t.startswith(("./", "../")) else t
    ordered = {k: _plain(d[k]) for k in ORDER if k in d} | {k: _plain(d[k]) for k in d if k not in ORDER}
    return f"---\n{yaml.safe_dump(ordered, sort_keys=False, allow_unicode=True)}---\n{new}"


def _plain(x):
    return x.isoformat() if hasattr(x, "isoformat") else {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else [_plain(v) for v in x] if isinstance(x, list) else x


def diff_of(path: str, old: str, new: str) -> str:
    """A unified diff; line ends are part of its lines."""
    return "".join(x if x.endswith("\n") else x + "\n\\ No newline at end of file\n" for x in difflib.unified_diff(old.splitlines(True), new.splitlines(True), f"a/{path}", f"b/{path}"))


def apply_diff(old: str, diff: str) -> str:
    """The new text, placed by the hunks' headers."""
    lines, out, at, last = old.splitlines(True), [], 0, ""
    hunk = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")
    for line in diff.splitlines(True):
        if m := hunk.match(line):
            begin = int(m[1]) - (1 if m[2] != "0" else 0)
            out += lines[at:begin]
            at = begin
        elif line.startswith(("---", "+++")) and not out and at == 0 and line[3:4] == " ":
            continue
        elif line.startswith("+"):
            out.append(line[1:])
        elif line.startswith("-"):
            at += 1
        elif line.startswith(" "):
            out.append(line[1:])
            at += 1
        elif line.startswith("\\") and out:
            if last[:1] in ("+", " "):  # the line before has no line end
                out[-1] = out[-1].removesuffix("\n")
        last = line
    return "".join(out + lines[at:])


def plan(spark: SparkSession, root: str) -> dict:
    """Actions for all notes that aren't in canonical form, by path; files are read and compared on the executors."""
    workers_find_us(spark)
    files = note_files(root, fail=True)
    names = spark.sparkContext.broadcast(files)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p in b["path"]:
                old = Path(root, p).read_bytes().decode("utf-8")
                try:
                    new = normalized(old, p, names.value)
                except yaml.YAMLError as e:
                    print(f"Warning: skipping '{p}': {e}", file=sys.stderr)
                    continue
                if new is not None and new != old:
                    rows.append((p, sha256(old), sha256(new), diff_of(p, old, new)))
            yield pd.DataFrame(rows, columns=["path", "source_sha256", "expected_new_sha256", "diff"])

    table = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files) // 100, 1000)))
    rows = table.mapInPandas(work, "path string, source_sha256 string, expected_new_sha256 string, diff string").orderBy("path").collect()
    return {"plan_version": "0.1.0", "vault_root": root, "actions": [r.asDict() for r in rows]}


def read_plan(path: str) -> dict:
    p = json.loads(Path(path).read_text())
    for a in p["actions"]:
        for other in ("patch", "unified_diff"):
            if other in a:
                a.setdefault("diff", a.pop(other))
    return p


def apply(root: str, given: dict, dry_run: bool = False) -> dict:
    """Checks all hashes before the first write; a file that already has its new hash counts as up to date."""
    todo, same = [], 0
    for a in given["actions"]:
        rel = normalize_one(a["path"])
        if rel is None or a["path"].startswith("/") or not os.path.realpath(os.path.join(root, rel)).startswith(os.path.realpath(root) + os.sep):
            raise ValueError(f"Path '{a['path']}' leaves the vault")
        file = Path(root, rel)
        old = file.read_bytes().decode("utf-8")
        if sha256(old) == a["expected_new_sha256"]:
            same += 1
        elif sha256(old) != a["source_sha256"]:
            raise ValueError(f"Hash mismatch for '{a['path']}': the file changed since the plan was made")
        else:
            new = apply_diff(old, a["diff"])
            if sha256(new) != a["expected_new_sha256"]:
                raise ValueError(f"Patched content of '{a['path']}' doesn't have the expected hash")
            todo.append((file, new))
    if not dry_run:
        for file, new in todo:
            temp = file.with_name(f".{file.name}.tmp")
            temp.write_bytes(new.encode())
            os.replace(temp, file)
    return {"modified": len(todo), "already_up_to_date": same, "dry_run": dry_run}


__all__ = ["apply", "apply_diff", "diff_of", "normalized", "plan", "read_plan", "rewrite_wikilinks", "sha256", "wikilink_target"]
