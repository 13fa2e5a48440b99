"""Five tools over JSON-RPC lines on standard input and output: query, inspect, lint, read, write."""

from __future__ import annotations

import contextlib
import datetime
import fcntl
import json
import os
import sys
from collections.abc import Iterator
from pathlib import Path

import yaml
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import cli, render
from loomgraph.functions.paths import normalize_one
from loomgraph.operators.lint import id_cycles
from loomgraph.plans import packets
from loomgraph.schema import DERIVED_ONLY, PERMITTED_TYPES


class ToolError(ValueError):
    pass


@contextlib.contextmanager
def write_lock(root: str) -> Iterator[None]:
    git = Path(root, ".git")
    with open((git if git.is_dir() else Path(root)) / ".vault.lock", "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def _replace(file: Path, text: str) -> None:
    """Writes the whole file or nothing; no temporary file stays."""
    temp = file.with_name(f".{file.stem}.tmp.{os.getpid()}")
    try:
        temp.write_text(text)
        os.replace(temp, file)
    finally:
        temp.unlink(missing_ok=True)


def _schema(needed: str, **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": needed.split()}


def _says(text: str, kind: str = "string") -> dict:
    return {"type": kind, "description": text}


_PAIRS = {"type": "object", "additionalProperties": {"type": "string"}, "description": "Key-value pairs of the context, e.g. env=prod"}
_RELATION = _schema("type target", type=_says("One of supersedes, depends_on, supported_by, caused_by, relates_to, contradicts"), target=_says("Id of the note at the other end"), evidence=_says("Citation or reason"), scope=_PAIRS)
#: What each tool does and takes.
TOOLS = {
    "query": ("Guidance around a note: current, its lineage, its impact, or as of a date", _schema("seed", seed=_says("Id or path of the note to start from"), mode=_says("current (default), lineage, impact or historical"), scope=_PAIRS, as_of=_says("YYYY-MM-DD, for historical alone"))),
    "inspect": ("The vault's inventory, or one note with its relations in both directions", _schema("", target=_says("Id or path of a note; the inventory if left out"))),
    "lint": ("Integrity findings of the vault", _schema("")),
    "vault_read": ("The text of a note", _schema("node_id", node_id=_says("Id or path of a note"))),
    "vault_write_canonical": ("Writes a note, if its relations hold, and logs it in today's daily note", _schema("id title type body daily_summary", id=_says("Id of the note, its file name"), title=_says("Title"), type=_says(f"One of {', '.join(PERMITTED_TYPES)}"), relations={"type": "array", "items": _RELATION, "description": "Forward relations"}, body=_says("Markdown without front matter"), daily_summary=_says("Line for the daily log"))),
}


class Tools:
    def __init__(self, spark: SparkSession, root: str, today=None):
        self.spark, self.root = spark, root
        self.today = today or (lambda: datetime.date.today().isoformat())

    def graph(self):
        return cli.vault(self.spark, self.root)

    def query(self, seed: str, mode: str = "current", scope: dict | None = None, as_of: str | None = None) -> str:
        try:
            p = cli.answer(self.graph(), self.root, seed, mode, scope or {}, as_of)
        except (packets.UnresolvedConflict, packets.SupersessionCycle) as e:
            return str(e)
        return render.PACKET[p["mode"]](p)

    def inspect(self, target: str | None = None) -> str:
        if not target:
            return render.vault_page(cli.inventory(self.graph(), self.root))
        try:
            return render.node_page(*cli.node_detail(self.graph(), target, self.root))
        except packets.SeedNotFound:
            raise ToolError(f"Node not found: '{target}'") from None

    def lint(self) -> str:
        return render.lint(cli.lint_report(self.graph(), self.root))

    def _inside(self, rel: str) -> Path:
        if ".." in rel or rel.startswith(("/", "\\")):
            raise ToolError(f"Path '{rel}' leaves the vault")
        file = Path(self.root, rel)
        if not os.path.realpath(file).startswith(os.path.realpath(self.root) + os.sep):
            raise ToolError(f"Path '{rel}' leaves the vault")
        return file

    def read(self, node_id: str) -> str:
        for name in (node_id, f"{node_id}.md"):
            if (file := self._inside(name)).is_file():
                return file.read_text()
        return self._inside(packets.find_seed(self.graph(), node_id, self.root)).read_text()

    def write(self, id: str, title: str, type: str, body: str, daily_summary: str, relations: list[dict] | None = None) -> str:
        relations = relations or []
        with write_lock(self.root):
            if type not in PERMITTED_TYPES:
                raise ToolError(f"Invalid note type '{type}'. Permitted types: {', '.join(PERMITTED_TYPES)}")
            for r in relations:
                if r["type"] in DERIVED_ONLY:
                    raise ToolError(f"Invalid relation type '{r['type']}'. Inverse relations are dynamic and cannot be stored in note frontmatter.")
            id = id.removesuffix(".md").strip()
            if not id or any(x in id for x in ("/", "\\", "..")):
                raise ToolError(f"Invalid note id: '{id}' cannot contain path separators or '..'")
            if any(r["type"] == "supersedes" and r["target"].strip() in (id, f"{id}.md", f"./{id}.md") for r in relations):
                raise ToolError(f"Note '{id}' cannot supersede itself")
            if relations:
                g, ids = self.graph(), {}
                for r in relations:
                    try:
                        ids[r["target"]] = packets.find_seed(g, r["target"], self.root)
                    except packets.SeedNotFound:
                        raise ToolError(f"Relation target '{r['target']}' does not resolve to any note in the vault") from None
                over = [r["target"] for r in relations if r["type"] == "supersedes"]
                if over:
                    names = {r.path: r.id for r in g.bare.where(F.col("path").isin(list(ids.values()))).collect()}
                    new = self.spark.createDataFrame([(id, names[ids[t]]) for t in over], "s string, d string")
                    old = g.of("supersedes").where(F.col("src_id") != id).select(F.col("src_id").alias("s"), F.col("dst_id").alias("d"))
                    if (c := id_cycles(old.unionByName(new)).first()) is not None:
                        raise ToolError(f"Supersession cycle detected: {' -> '.join([*c.cycle, c.cycle[0]])}")
            front = {"id": id, "type": type, "title": title} | ({"relations": relations} if relations else {})
            file = Path(self.root, f"{id}.md")
            before = file.read_bytes() if file.exists() else None
            _replace(file, f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True)}---\n\n{body.strip()}\n")
            day = self.today()
            try:
                log, entry = Path(self.root, "Daily", f"{day}.md"), f"- [[{id}]]: {daily_summary.strip()}\n"
                log.parent.mkdir(exist_ok=True)
                old = log.read_text() if log.exists() else f"# {day}\n\n## Log\n\n"
                _replace(log, old + ("" if not old or old.endswith("\n") else "\n") + entry)
            except OSError as e:
                if before is None:
                    file.unlink()
                else:
                    file.write_bytes(before)
                raise ToolError(f"Failed to update daily log file: {e}") from e
            return f"Successfully wrote canonical note '{id}' and updated daily log Daily/{day}.md"

    CALLS = {"query": "query", "inspect": "inspect", "lint": "lint", "vault_read": "read", "vault_write_canonical": "write"}

    def handle(self, message: dict) -> dict | None:
        method, params = message.get("method"), message.get("params") or {}
        if "id" not in message:
            return None
        ok = lambda result: {"jsonrpc": "2.0", "id": message["id"], "result": result}
        bad = lambda code, text: {"jsonrpc": "2.0", "id": message["id"], "error": {"code": code, "message": text}}
        if method == "initialize":
            return ok({"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "loomgraph", "version": "0.1.0"}})
        if method == "ping":
            return ok({})
        if method == "tools/list":
            return ok({"tools": [{"name": n, "description": said, "inputSchema": schema} for n, (said, schema) in TOOLS.items()]})
        if method != "tools/call":
            return bad(-32601, f"Method not found: {method}")
        if params.get("name") not in self.CALLS:
            return bad(-32602, f"Unknown tool: {params.get('name')}")
        try:
            said = getattr(self, self.CALLS[params["name"]])(**(params.get("arguments") or {}))
        except (ValueError, TypeError, KeyError, OSError) as e:
            return bad(-32602, str(e))
        return ok({"content": [{"type": "text", "text": said}], "isError": False})


def serve(spark: SparkSession, root: str, lines=None, out=None) -> int:
    tools, out = Tools(spark, root), out or sys.stdout
    for line in lines or sys.stdin:
        if line.strip():
            reply = tools.handle(json.loads(line))
            if reply is not None:
                print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
    return 0


__all__ = ["Tools", "serve"]
