"""Markdown and plain text of packets and reports. Headings, labels and marks are fixed texts."""

from __future__ import annotations

from loomgraph.plans.packets import scope_text

PRODUCT = "Loomgraph"
RULE = ["---", ""]
NOT_CURRENT = ["> [!WARNING]", "> The following note(s) are SUPERSEDED and retained solely for historical rationale and decision provenance.", "> DO NOT treat this content as current architectural guidance.", ""]


def _labelled(pairs: list[tuple[str, str | None]]) -> list[str]:
    return [f"- **{label}**: {value}" for label, value in pairs if value]


def _brackets(scope: dict | None) -> str | None:
    return f"[{scope_text(scope)}]" if scope else None


def _code(name: str | None) -> str | None:
    return f"`{name}`" if name else None


def _head(p: dict, what: str, pairs: list[tuple[str, str | None]]) -> list[str]:
    seed = f"`{p['seed']}`" + (f" (\"{p['seed_title']}\")" if "seed_title" in p else "")
    return [f"# {PRODUCT} — {what}", "", *_labelled([("Mode", p["mode"]), ("Seed", seed), *pairs, ("Scope Filter", _brackets(p["query_scope"])), ("Resolution", p["message"])]), ""]


def _box(kind: str, title: str, lines: list[str]) -> list[str]:
    return [f"> [!{kind}]", f"> **{title}:**", *(f"> - {x}" for x in lines), ""] if lines else []


def _lifecycle(n: dict) -> list[tuple[str, str | None]]:
    return [("Type", n["type"]), ("Status", n.get("status")), ("Valid From", n.get("valid_from")), ("Valid Until", n.get("valid_until"))]


def _content(n: dict) -> list[str]:
    body = (n.get("body") or "").strip()
    return ["", "#### Content", "", body] if body else []


def _relation(r: dict) -> str:
    more = [f"evidence: {r['evidence']}"] if r.get("evidence") else []
    more += [f"scope: [{scope_text(r['scope'])}]"] if r.get("scope") is not None else []
    return f"  - {r['type']} -> {r['target']}" + (f" ({', '.join(more)})" if more else "")


def _title(n: dict, mark: str = "", number: str = "") -> list[str]:
    return [f"### {number}{n.get('title') or n['id']} (`{n['id']}`){mark}", ""]


def _rationale(p: dict) -> list[str]:
    out = [*RULE, "## Historical Rationale (SUPERSEDED)", "", *NOT_CURRENT] if p["historical_rationale"] else []
    for x in p["historical_rationale"]:
        out += [*_title(x["node"], " [SUPERSEDED]"), *_labelled([("Type", x["node"]["type"]), ("Superseded By", _code(x["superseded_by"])), ("Evidence", x.get("evidence")), ("Supersession Scope", _brackets(x.get("scope")))]), *_content(x["node"]), ""]
    return out


def current(p: dict) -> str:
    c, what = p["unresolved_conflict"], "Agent Context Packet"
    if c:
        out = _head(p, what, [("Active Guidance", "None (Strict abstention)"), ("Status", "UNRESOLVED CONFLICT (Strict abstention)")]) + _box("NOTE", "Advisories", p["advisories"])
        cycle = c.get("cycle")
        out += ["> [!WARNING]", f"> ### {c['alert']}", *(f"> {x}" for x in _labelled([("Kind", c["kind"]), ("Predecessor", _code(c.get("predecessor"))), ("Cycle Path", " -> ".join([*cycle, cycle[0]]) if cycle else None)])), "> - **Competing Candidates**:"]
        out += [f">   - `{x['id']}`" + (f" (evidence: {x['evidence']})" if x.get("evidence") else "") for x in c["candidates"]]
        out += ["", *RULE, "## Competing Candidates", ""]
        for x in c["candidates"]:
            out += [*_title(x, " [DISPUTED]"), *_labelled([("ID", _code(x["id"])), ("Path", x.get("path")), ("Evidence", x.get("evidence")), ("Scope", _brackets(x.get("scope")))]), ""]
        return "\n".join(out + _rationale(p))
    n = p["active_note"]
    out = _head(p, what, [("Active Guidance", _code(p["active_guidance_id"])), ("Status", "CURRENT GUIDANCE" if p["is_current"] else "SUPERSEDED (Resolved to successor)")]) + _box("NOTE", "Advisories", p["advisories"])
    out += [*RULE, "## Active Guidance", "", *_title(n), *_labelled([*_lifecycle(n), ("Scope", _brackets(n.get("scope"))), ("Path", n.get("path"))])]
    if n.get("relations"):
        out += [f"- **Relations** ({len(n['relations'])}):", *map(_relation, n["relations"])]
    return "\n".join([*out, *_content(n), "", *_rationale(p)])


def lineage(p: dict) -> str:
    out = _head(p, "Decision Lineage Packet", [("Active Guidance", _code(p["active_guidance_id"])), ("Chain Length", str(len(p["chain"])))]) + _box("NOTE", "Advisories", p["advisories"])
    out += [*RULE, "## Chronological Replacement Chain", "", " -> ".join(f"`{e['node']['id']}`" for e in p["chain"]), ""]
    for i, e in enumerate(p["chain"], 1):
        n, backed = e["node"], e.get("supported_by")
        pairs = [*_lifecycle(n), ("Supersedes", _code(e.get("supersedes"))), ("Adopted Evidence", e.get("adopted_evidence")), ("Superseded By", _code(e.get("superseded_by"))), ("Supersession Evidence", e.get("supersession_evidence")), ("Supported By", f"[{', '.join(map(_code, backed))}]" if backed else None), ("Scope", _brackets(n.get("scope"))), ("Path", n.get("path"))]
        out += [*_title(n, " [CURRENT GUIDANCE]" if e["is_current"] else " [SUPERSEDED]", f"{i}. "), *_labelled(pairs), *_content(n), ""]
    if p["empirical_evidence"]:
        out += [*RULE, "## Empirical Evidence", ""]
    for n in p["empirical_evidence"]:
        out += [*_title(n), *_labelled([("Type", n["type"]), ("Status", n.get("status")), ("Path", n.get("path"))]), *_content(n), ""]
    return "\n".join(out)


def impact(p: dict) -> str:
    out = _head(p, "Impact Analysis Packet", [("Total Dependents", str(p["total_dependents"])), ("Max Depth", str(p["max_depth"]))])
    out += [*RULE, "## Downstream Dependents", ""]
    if not p["dependents"]:
        out += ["No downstream components depend on this note.", ""]
    for i, d in enumerate(p["dependents"], 1):
        out += [*_title(d, number=f"{i}. "), *_labelled([("Type", d["node_type"]), ("Depth", str(d["depth"])), ("Dependency Path", " -> ".join(map(_code, d["path"]))), ("Scope", _brackets(d.get("scope"))), ("Path", d.get("file_path"))]), ""]
    return "\n".join(out)


def historical(p: dict) -> str:
    out = _head(p, "Historical Context Packet", [("As Of", _code(p["as_of"])), ("Active Guidance", _code(p["active_guidance_id"]) or "None"), ("Status", p["status"])])
    out += _box("WARNING", "Warnings", p["warnings"]) + _box("NOTE", "Advisories", p["advisories"]) + [*RULE, f"## Active Guidance (as of {p['as_of']})", ""]
    n = p["active_note"]
    if n is None:
        return "\n".join([*out, f"No active guidance found for `{p['seed']}` as of `{p['as_of']}`.", ""])
    return "\n".join([*out, *_title(n), *_labelled([*_lifecycle(n), ("Scope", _brackets(n.get("scope"))), ("Path", n.get("path"))]), *_content(n), ""])


PACKET = {"current": current, "lineage": lineage, "impact": impact, "historical": historical}


def lint(report: dict) -> str:
    out = [f"Vault: {report['vault_path']}", f"Checked {report['total_nodes']} nodes and {report['total_edges']} edges."]
    if report["healthy"]:
        return "\n".join([*out, "✓ Graph is healthy. No integrity violations found.", ""])
    out += ["", f"Integrity Violations ({len(report['findings'])}):", *(f"  - [{f['severity']}] [{f['kind']}] {f['message']}" for f in report["findings"])]
    return "\n".join([*out, "", f"Lint failed with {report['errors']} error(s) and {report['warnings']} warning(s).", ""])


def inventory(i: dict) -> str:
    out = [f"Vault: {i['vault_path']}", f"Total Nodes: {i['total_nodes']}", f"Total Edges: {i['total_edges']}"]
    out += ["Edges by Type:", *(f"  - {k}: {n}" for k, n in i["edges_by_type"].items())] if i["edges_by_type"] else []
    out += [f"Malformed Files ({len(i['malformed_files'])}):", *(f"  - {m['path']}: {m['error']}" for m in i["malformed_files"])] if i["malformed_files"] else []
    return "\n".join([*out, ""])


def node(n: dict) -> str:
    out = [f"Node: {n['id']}", f"Type: {n['type']}", f"Title: {n['title']}", *(f"{label}: {n[k]}" for k, label in (("status", "Status"), ("valid_from", "Valid From"), ("valid_until", "Valid Until")) if n.get(k))]
    if n.get("scope"):
        out += ["Scope:", *(f"  {k}: {v}" for k, v in sorted(n["scope"].items()))]
    if n.get("relations"):
        out += [f"Relations ({len(n['relations'])}):", *map(_relation, n["relations"])]
    return "\n".join([*out, ""])


def vault_page(i: dict) -> str:
    """The inventory for the tool server."""
    out = ["# Vault Inventory", "", *_labelled([("Total Nodes", str(i["total_nodes"])), ("Total Edges", str(i["total_edges"]))]), "", "## Relations by Type", *(f"- {k}: {n}" for k, n in i["edges_by_type"].items())]
    out += ["", "## Malformed Files", *(f"- {m['path']}: {m['error']}" for m in i["malformed_files"])] if i["malformed_files"] else []
    return "\n".join([*out, ""])


def node_page(n: dict, inverse: list[dict]) -> str:
    """A note and what points at it, for the tool server."""
    out = [f"# {PRODUCT} Inspect: {n['id']}", "", *_labelled([("Title", n["title"]), ("Type", n["type"]), ("Status", n.get("status")), ("Path", n.get("path")), ("Valid From", n.get("valid_from")), ("Valid Until", n.get("valid_until")), ("Scope", scope_text(n.get("scope") or {}))])]
    for label, relations in (("Forward", n.get("relations") or []), ("Inverse", inverse)):
        out += ["", f"## {label} Relations ({len(relations)})"] + (["_None_"] if not relations else [])
        for r in relations:
            more = [f"evidence: \"{r['evidence']}\""] if label == "Forward" and r.get("evidence") else []
            more += [f"scope: [{scope_text(r['scope'])}]"] if label == "Forward" and r.get("scope") else []
            out.append(f"- {r['type']} -> [[{r['target']}]]" + (f" ({', '.join(more)})" if more else ""))
    return "\n".join([*out, ""])
