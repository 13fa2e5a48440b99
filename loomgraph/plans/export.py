"""Export: each parsed note written again with plain Markdown links, and a manifest."""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import yaml
from pyspark.sql import functions as F

from loomgraph.functions.paths import folder_of, normalize_one, relative_one, resolve_one
from loomgraph.operators.graph import Graph

_CODE = re.compile(r"(`+)(?:.|\n)*?\1(?!`)")
_LINK = re.compile(r"(!?)\[([^\[\]]*)\]\(([^()\s]+)\)|(!?)\[\[([^\[\]|]+)(?:\|([^\[\]]+))?\]\]")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})")


class Targets:
    """Where link targets lead: ids and path keys, as dictionaries of one vault."""

    def __init__(self, ids: dict[str, str], keys: dict[str, str]):
        self.ids, self.keys = ids, keys

    def find(self, src: str, target: str) -> str | None:
        near = resolve_one(folder_of(src), target)
        if target.startswith(("./", "../")):
            return self.keys.get(near) if near else None
        return self.ids.get(target) or (near and self.keys.get(near)) or self.keys.get(normalize_one(target) or "\0")

    def link(self, src: str, dest: str) -> str | None:
        """The relative link for ``dest``; nothing for outside links and unknown notes."""
        if dest.startswith(("#", "mailto:", "data:")) or "://" in dest:
            return None
        base, sign, anchor = dest.partition("#")
        path = self.find(src, base)
        return relative_one(folder_of(src), path) + sign + anchor if path else None


def convert_links(targets: Targets, src: str, body: str) -> str:
    """Links to notes become relative paths outside code; images stay; unknown wikilinks become ``./name.md``."""

    def one(m: re.Match) -> str:
        if m[1] or m[4]:
            return m[0]
        if m[3] is not None:
            to = targets.link(src, m[3])
            return f"[{m[2]}]({to})" if to else m[0]
        base, sign, anchor = m[5].strip().partition("#")
        return f"[{m[6] or m[5]}]({targets.link(src, m[5].strip()) or f'./{base}.md' + sign + anchor})"

    def outside(text: str) -> str:
        out, at = [], 0
        for m in _CODE.finditer(text):
            out += [_LINK.sub(one, text[at : m.start()]), m[0]]
            at = m.end()
        return "".join([*out, _LINK.sub(one, text[at:])])

    out, plain, fence = [], [], None
    for line in body.split("\n"):
        m = _FENCE.match(line)
        if fence is None and m:
            out += [outside("\n".join(plain))] * bool(plain)
            plain, fence = [], m[1]
            out.append(line)
        elif fence is not None:
            out.append(line)
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and line.strip() == m[1]:
                fence = None
        else:
            plain.append(line)
    out += [outside("\n".join(plain))] * bool(plain)
    return "\n".join(out)


def front_of(row) -> str:
    d = {"id": row.id, "type": row.node_type, "title": row.title, "status": row.status, "valid_from": row.valid_from, "valid_until": row.valid_until, "scope": dict(row.scope or {}), "relations": [{k: v for k, v in {"type": r.type, "target": r.target, "evidence": r.evidence, "scope": None if r.scope is None else dict(r.scope)}.items() if v is not None} for r in row.relations]}
    return yaml.safe_dump({k: v for k, v in d.items() if v not in (None, {}, [])}, sort_keys=False, allow_unicode=True)


def manifest(g: Graph, root: str, out: str) -> dict:
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.size("scope") > 0).alias("scoped")).first()
    r = g.relations.agg(F.count("*").alias("all"), F.count("evidence").alias("evidence"), F.count("rel_scope").alias("scoped")).first()
    by = {x.type: x.n for x in g.relations.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()}
    nodes = g.nodes.select("id", "path", "node_type", "title", F.size("relations").alias("relations")).orderBy("id", "path").collect()
    return {"format": "okf", "vault_path": root, "export_path": out, "total_nodes": n.nodes, "total_relations": r["all"], "relations_by_type": by, "extension_attributes": {"scoped_nodes": n.scoped, "evidence_references": r.evidence, "scoped_relations": r.scoped}, "nodes": [x.asDict() for x in nodes]}


def export(g: Graph, root: str, out: str) -> dict:
    """Writes the notes from the executors, one file a row (``out`` is a folder that all share), and the manifest."""
    ids = {r.id: r.path for r in g.ids.collect()}
    keys = {r.key: r.path for r in g.path_keys.collect()}
    given = g.nodes.sparkSession.sparkContext.broadcast(Targets(ids, keys))

    def write(rows) -> None:
        for row in rows:
            file = Path(out, row.path)
            file.parent.mkdir(parents=True, exist_ok=True)
            temp = file.with_name(f".{file.name}.tmp")
            temp.write_bytes(f"---\n{front_of(row)}---\n{convert_links(given.value, row.path, row.body)}".encode())
            os.replace(temp, file)

    g.nodes.foreachPartition(write)
    m = manifest(g, root, out)
    Path(out).mkdir(parents=True, exist_ok=True)
    Path(out, "manifest.json").write_text(json.dumps(m, indent=2, ensure_ascii=False))
    return m
