"""Answers for one seed as nested dictionaries, from the few notes that the seed's walk can reach.

Only those notes are collected: frontiers grow over the edges by semi-joins until nothing new is met.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.functions.scope import overlap
from loomgraph.operators.graph import Graph
from loomgraph.operators.lint import ordered_cycle, strong_components
from loomgraph.schema import INACTIVE

#: Fixed texts.
MARK = "[UNRESOLVED_CONFLICT]"
ABSTAIN = "Strictly abstaining from selecting a winner."


class QueryError(ValueError):
    kind = "Query"


class SeedNotFound(QueryError):
    pass


class UnsupportedMode(QueryError):
    pass


class MissingAsOf(QueryError):
    pass


class InvalidDateFormat(QueryError):
    pass


class UnresolvedConflict(QueryError):
    pass


class SupersessionCycle(QueryError):
    pass


def scope_text(scope: dict[str, str]) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(scope.items()))


def check_date(day: str) -> str:
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", day) or not 1 <= int(day[5:7]) <= 12 or not 1 <= int(day[8:]) <= 31:
        raise InvalidDateFormat(f"Invalid date format '{day}'. Expected YYYY-MM-DD")
    return day


@dataclass
class Reach:
    """The collected notes (by path) and edges around a seed."""

    nodes: dict[str, dict]
    edges: list[dict]
    into: dict[tuple[str, str], list[dict]] = field(default_factory=dict)
    out: dict[tuple[str, str], list[dict]] = field(default_factory=dict)

    def __post_init__(self):
        for e in sorted(self.edges, key=lambda e: (e["src_path"], e["ord"])):
            self.into.setdefault((e["dst_path"], e["type"]), []).append(e)
            self.out.setdefault((e["src_path"], e["type"]), []).append(e)

    def scope(self, path: str) -> dict[str, str]:
        return dict(self.nodes[path]["scope"] or {})

    def active(self, path: str) -> bool:
        n = self.nodes[path]
        return (n["status"] or "").lower() not in INACTIVE and not any(overlap(e["eff_scope"], self.scope(path)) for e in self.into.get((path, "supersedes"), ()))


def _given(d: dict) -> dict:
    """Without absent fields."""
    return {k: v for k, v in d.items() if v is not None}


def note(n: dict) -> dict:
    """A note for output with its relations and body: absent and empty fields left out."""
    relations = [_given({k: dict(v) if k == "scope" and v is not None else v for k, v in r.items()}) for r in n.get("relations") or ()]
    d = {"id": n["id"], "type": n["node_type"], "title": n["title"], "status": n["status"], "valid_from": n["valid_from"], "valid_until": n["valid_until"], "scope": dict(n["scope"] or {}), "relations": relations, "path": n["path"], "body": n.get("body")}
    return {k: v for k, v in d.items() if v not in (None, {}, [])}


def find_seeds(g: Graph, seeds: list[str], root: str = "") -> dict[str, tuple[str, str]]:
    """(path, id) of each seed that is a note: an id, else a path in the vault, with or without its extension, also below the vault's folder."""
    tries: dict[str, list[str]] = {}
    for seed in seeds:
        wanted = seed.strip()
        forms = [wanted] + ([wanted[len(root.rstrip("/")) + 1 :]] if root and wanted.startswith(root.rstrip("/") + "/") else [])
        tries[seed] = [k for k in map(paths.normalize_one, forms) if k]
    names, keys = [s.strip() for s in seeds], sorted({k for t in tries.values() for k in t})
    by_id = g.ids.where(F.col("id").isin(names)).select(F.col("id").alias("key"), "path", F.lit(0).alias("rank"))
    by_path = g.path_keys.where(F.col("key").isin(keys)).select("key", "path", F.lit(1).alias("rank"))
    hits = by_id.unionByName(by_path).join(g.bare.select("path", "id"), "path").orderBy("rank", "path").collect()
    out = {}
    for seed in seeds:
        hit = next((h for h in hits if (h.key == seed.strip() if h.rank == 0 else h.key in tries[seed])), None)
        if hit is not None:
            out[seed] = (hit.path, hit.id)
    return out


def find_seed(g: Graph, seed: str, root: str = "") -> str:
    """The path of a seed."""
    hit = find_seeds(g, [seed], root).get(seed)
    if hit is None:
        raise SeedNotFound(f"Seed note '{seed}' not found in vault '{root}'")
    return hit[0]


def reach(g: Graph, start: str, both: tuple[str, ...], into: tuple[str, ...] = (), beside: tuple[str, ...] = ("contradicts", "supported_by")) -> Reach:
    """Notes met from ``start`` over edges of ``both`` in either direction and of ``into`` against it, and their neighbours over ``beside``."""
    spark = g.nodes.sparkSession
    edges = g.edges
    seen, front, got = {start}, {start}, {}

    def touching(front: set[str], kinds: tuple[str, ...], ends: tuple[str, ...]) -> list[dict]:
        f = spark.createDataFrame([(p,) for p in sorted(front)], "p string")
        hits = [edges.where(F.col("type").isin(*kinds)).join(F.broadcast(f), F.col(end) == F.col("p"), "left_semi") for end in ends]
        return [r.asDict(recursive=True) for h in hits for r in h.collect()]

    while front:
        rows = (touching(front, both, ("src_path", "dst_path")) if both else []) + (touching(front, into, ("dst_path",)) if into else [])
        got |= {(e["src_path"], e["ord"]): e for e in rows}
        front = {x for e in rows for x in (e["src_path"], e["dst_path"])} - seen
        seen |= front
    if beside:
        rows = touching(seen, beside, ("src_path", "dst_path"))
        got |= {(e["src_path"], e["ord"]): e for e in rows}
        around = {x for e in rows for x in (e["src_path"], e["dst_path"])} - seen
        if around:  # whether those are active depends on what supersedes them
            rows = touching(around, ("supersedes",), ("dst_path",))
            got |= {(e["src_path"], e["ord"]): e for e in rows}
    seen |= {x for e in got.values() for x in (e["src_path"], e["dst_path"])}
    f = spark.createDataFrame([(p,) for p in sorted(seen)], "path string")
    rows = g.nodes.join(f, "path", "left_semi").collect()
    return Reach({r.path: r.asDict(recursive=True) for r in rows}, list(got.values()))


def _transitively(r: Reach, b: str, a: str, scope: dict) -> bool:
    todo, seen = [(b, None)], {b}
    while todo:
        at, last = todo.pop(0)
        for e in r.out.get((at, "supersedes"), ()):
            if overlap(e["eff_scope"], scope) and (last is None or overlap(e["eff_scope"], last)):
                if e["dst_path"] == a:
                    return a != b
                if e["dst_path"] not in seen:
                    seen.add(e["dst_path"])
                    todo.append((e["dst_path"], e["eff_scope"]))
    return False


def current_packet(g: Graph, seed: str, scope: dict[str, str], root: str = "") -> dict:
    start = find_seed(g, seed, root)
    r = reach(g, start, ("supersedes",))
    ident = lambda p: r.nodes[p]["id"]
    at, visited, chain, past, advised = start, [], [], [], []

    def packet(status: str, message: str, found: str | None = None, conflict: dict | None = None) -> dict:
        return {"mode": "current", "seed": seed, "active_guidance_id": ident(found) if found else None, "is_current": found == start, "status": status, "query_scope": dict(scope), "active_note": note(r.nodes[found]) if found else None, "unresolved_conflict": conflict, "supersession_chain": chain, "historical_rationale": past, "advisories": advised, "message": message}

    def candidate(p: str, evidence: str | None, scoped: dict | None) -> dict:
        return _given({"id": ident(p), "title": r.nodes[p]["title"], "path": p, "evidence": evidence, "scope": scoped or None})

    def declared(p: str, kind: str) -> str | None:
        """The evidence of the note's first relation of a kind."""
        return next((x["evidence"] for x in r.nodes[p]["relations"] or () if x["type"] == kind), None)

    def listed(es: list[dict]) -> list[dict]:
        return sorted((candidate(e["src_path"], e["evidence"], e["eff_scope"]) for e in es), key=lambda c: c["id"])

    def conflict(kind: str, message: str, candidates: list[dict], predecessor: str | None = None, cycle: list[str] | None = None) -> dict:
        said = f"{MARK} {message}"
        return packet("unresolved_conflict", said, None, _given({"alert": MARK, "kind": kind, "message": said, "predecessor": predecessor, "cycle": cycle, "candidates": candidates}))

    while True:
        if at in visited:
            members = visited[visited.index(at) :]
            after: dict[str, list[str]] = {}
            for e in r.edges:
                if e["type"] == "supersedes":
                    after.setdefault(e["src_id"], []).append(e["dst_id"])
            cycle = ordered_cycle({ident(p) for p in members}, after, ident(at))
            del chain[visited.index(at) :], past[visited.index(at) :]
            inside = {p: next((e for e in r.out.get((p, "supersedes"), ()) if e["dst_path"] in members), None) for p in members}
            turning = [candidate(p, (e or {}).get("evidence") or declared(p, "supersedes"), (e or {}).get("rel_scope") or r.scope(p)) for p, e in inside.items()]
            return conflict("supersession_cycle", f"Supersession cycle detected: {' -> '.join([*cycle, cycle[0]])}. {ABSTAIN}", sorted(turning, key=lambda c: c["id"]), None, cycle)
        visited.append(at)
        edges = r.into.get((at, "supersedes"), [])
        hits = [e for e in edges if overlap(scope, e["eff_scope"])]
        for e in edges:
            said = f"A successor exists in another scope: '{e['src_id']}' (scope: [{scope_text(e['eff_scope'])}])"
            if e not in hits and said not in advised:
                advised.append(said)
        if not hits:
            break
        if len(hits) > 1:
            live = [e for e in hits if r.active(e["src_path"])]
            left = [e for e in live if not any(x is not e and _transitively(r, x["src_path"], e["src_path"], e["eff_scope"]) for x in live)]
            names = lambda es: ", ".join(sorted(x["src_id"] for x in es))
            if len(left) > 1:
                return conflict("competing_successors", f"Competing successors found for '{ident(at)}': {names(left)}. {ABSTAIN}", listed(left), ident(at))
            if not left:
                pairs = [(e["src_id"], e["dst_id"]) for e in r.edges if e["type"] == "supersedes"]
                loops = [c for c in strong_components(pairs) if len(c) > 1 or any((x, x) in pairs for x in c)]
                turning = next((c for e in hits for c in loops if e["src_id"] in c), None)
                if turning:
                    after = {}
                    for a, b in pairs:
                        after.setdefault(a, []).append(b)
                    cycle = ordered_cycle(turning, after, min(turning))
                    return conflict("supersession_cycle", f"Supersession cycle detected among successors of '{ident(at)}': {' -> '.join([*cycle, cycle[0]])}. {ABSTAIN}", listed(hits), ident(at), cycle)
                if live:
                    return conflict("competing_successors", f"Competing successors found for '{ident(at)}': {names(live)}. {ABSTAIN}", listed(live), ident(at))
                return conflict("superseded_without_active_successor", f"Note '{ident(at)}' has been superseded, but all successors are inactive in the requested scope.", listed(hits), ident(at))
            hits = left
        e = hits[0]
        chain.append(_given({"predecessor": ident(at), "successor": e["src_id"], "evidence": e["evidence"], "scope": e["rel_scope"]}))
        past.append(_given({"node": note(r.nodes[at]), "superseded_by": e["src_id"], "evidence": e["evidence"], "scope": e["rel_scope"]}))
        at = e["src_path"]
    against = []
    for e in r.out.get((at, "contradicts"), []):
        against.append((e["dst_path"], e["eff_scope"], r.scope(e["dst_path"]), e["evidence"], True))
    for e in r.into.get((at, "contradicts"), []):
        against.append((e["src_path"], r.scope(at), e["eff_scope"], e["evidence"], False))
    against = [x for x in against if x[0] != at and r.active(x[0]) and overlap(x[1], x[2]) and overlap(scope, x[1]) and overlap(scope, x[2])]
    if against:
        other, _, _, evidence, outgoing = min(against, key=lambda x: ident(x[0]))
        # the other side's evidence: of its own edge back, else of its first contradiction
        a, b = (other, at) if outgoing else (at, other)
        back = next((e["evidence"] for e in r.out.get((a, "contradicts"), ()) if e["dst_path"] == b), None) or declared(a, "contradicts")
        mine, its = (evidence, back) if outgoing else (back, evidence)
        pair = [candidate(at, mine, r.scope(at)), candidate(other, its, r.scope(other))]
        return conflict("contradiction", f"Active contradiction between '{ident(at)}' and '{ident(other)}' with overlapping scopes.", pair)
    if at != start:
        return packet("superseded", f"Resolved superseded note '{ident(start)}' along {len(chain)} supersession hop(s) to active guidance '{ident(at)}'.", at)
    if advised:
        return packet("current_in_scope", f"Note '{ident(start)}' has no active successors in the requested scope and is itself current guidance.", at)
    return packet("current", f"Note '{ident(start)}' has no successors and is itself current guidance.", at)


def _chain(r: Reach, start: str, scope: dict[str, str]) -> tuple[list[str], list[dict], list[str]]:
    """(paths from the root on, the edges between them, advisories) by the strict rule."""
    root, seen = start, {start}
    while True:
        back = [e for e in r.out.get((root, "supersedes"), ()) if overlap(scope, e["rel_scope"] if e["rel_scope"] is not None else r.scope(e["dst_path"]))]
        if len(back) != 1 or back[0]["dst_path"] in seen:
            if len(back) == 1:
                ids = [r.nodes[p]["id"] for p in [root, *sorted(seen - {root})]]
                raise SupersessionCycle(f"Supersession cycle detected: {' -> '.join([*ids, ids[0]])}")
            break
        root = back[0]["dst_path"]
        seen.add(root)
    walk, steps, advised = [root], [], []
    while True:
        edges = r.into.get((walk[-1], "supersedes"), [])
        hits = [e for e in edges if overlap(scope, e["eff_scope"])]
        for e in edges:
            said = f"A successor exists in another scope: '{e['src_id']}' (scope: [{scope_text(e['eff_scope'])}])"
            if e not in hits and said not in advised:
                advised.append(said)
        if not hits:
            return walk, steps, advised
        if len(hits) > 1:
            rivals = ", ".join(f"'{e['src_id']}'" + (f" (evidence: {e['evidence']})" if e["evidence"] else "") for e in hits)
            raise UnresolvedConflict(f"Unresolved conflict: {MARK} Competing successors found for '{r.nodes[walk[-1]]['id']}': {rivals}. {ABSTAIN}")
        if hits[0]["src_path"] in walk:
            ids = [r.nodes[p]["id"] for p in walk]
            raise SupersessionCycle(f"Supersession cycle detected: {' -> '.join([*ids, ids[0]])}")
        steps.append(hits[0])
        walk.append(hits[0]["src_path"])


def lineage_packet(g: Graph, seed: str, scope: dict[str, str], root: str = "") -> dict:
    start = find_seed(g, seed, root)
    r = reach(g, start, ("supersedes",))
    walk, steps, advised = _chain(r, start, scope)
    raw = {p: [x["target"] for x in r.nodes[p]["relations"] or () if x["type"] == "supported_by"] for p in walk}
    found = find_seeds(g, sorted({t for ts in raw.values() for t in ts}), root) if any(raw.values()) else {}
    chain, evidence = [], {}
    for i, p in enumerate(walk):
        edges = r.out.get((p, "supported_by"), ())
        for e in edges:
            evidence.setdefault(e["dst_id"], note(r.nodes[e["dst_path"]]))
        backed = {e["dst_id"] for e in edges} | {found[t][1] if t in found else t for t in raw[p]}
        entry = {"node": note(r.nodes[p]), "supersedes": r.nodes[walk[i - 1]]["id"] if i else None, "superseded_by": r.nodes[walk[i + 1]]["id"] if i < len(steps) else None, "adopted_evidence": steps[i - 1]["evidence"] if i else None, "supersession_evidence": steps[i]["evidence"] if i < len(steps) else None, "supported_by": sorted(backed) or None, "is_current": i == len(walk) - 1}
        chain.append(_given(entry))
    names = [r.nodes[p]["id"] for p in walk]
    said = f"Note '{r.nodes[start]['id']}' has no supersession lineage and is itself current guidance." if len(walk) == 1 else f"Traced chronological replacement chain across {len(walk)} node(s): {' -> '.join(repr(n) for n in names)}."
    moves = [_given({"predecessor": e["dst_id"], "successor": e["src_id"], "evidence": e["evidence"], "scope": e["rel_scope"]}) for e in steps]
    return {"mode": "lineage", "seed": seed, "active_guidance_id": names[-1], "query_scope": dict(scope), "chain": chain, "transitions": moves, "empirical_evidence": list(evidence.values()), "advisories": advised, "message": said}


def impact_packet(g: Graph, seed: str, scope: dict[str, str], root: str = "") -> dict:
    start = find_seed(g, seed, root)
    r = reach(g, start, (), ("depends_on",), ())
    top, seen, front, found = r.nodes[start], {start}, [(start, [r.nodes[start]["id"]])], []
    depth = 0
    while front:
        depth, nxt = depth + 1, []
        for at, trail in front:
            for e in sorted(r.into.get((at, "depends_on"), ()), key=lambda e: (e["src_id"], e["src_path"])):
                if e["src_path"] not in seen:
                    seen.add(e["src_path"])
                    n = r.nodes[e["src_path"]]
                    nxt.append((e["src_path"], [*trail, n["id"]]))
                    found.append({k: v for k, v in {"id": n["id"], "title": n["title"], "node_type": n["node_type"], "depth": depth, "path": [*trail, n["id"]], "scope": n["scope"], "file_path": n["path"]}.items() if v not in (None, {})})
        front = nxt
    deepest = max((x["depth"] for x in found), default=0)
    said = f"Found {len(found)} downstream component(s) dependent on '{top['id']}' across {deepest} dependency level(s)." if found else f"No downstream components depend on '{top['id']}'."
    return {"mode": "impact", "seed": seed, "seed_title": top["title"], "query_scope": dict(scope), "total_dependents": len(found), "max_depth": deepest, "dependents": found, "message": said}


def historical_packet(g: Graph, seed: str, as_of: str, scope: dict[str, str], root: str = "") -> dict:
    check_date(as_of)
    start = find_seed(g, seed, root)
    r = reach(g, start, ("supersedes",), (), ())
    walk, _, advised = _chain(r, start, scope)
    ns = [r.nodes[p] for p in walk]
    name, warned = r.nodes[start]["id"], []
    for n in ns:
        if n["valid_from"] is None:
            warned.append(f"Note '{n['id']}' lacks lifecycle dates ('valid_from' / 'valid_until'); unable to strictly verify interval bounds." if n["valid_until"] is None else f"Note '{n['id']}' is missing 'valid_from' date; unable to strictly verify start of validity.")

    def packet(status: str, message: str, n: dict | None = None) -> dict:
        return {"mode": "historical", "seed": seed, "as_of": as_of, "active_guidance_id": n["id"] if n else None, "is_active": n is not None, "status": status, "query_scope": dict(scope), "active_note": note(n) if n else None, "warnings": warned, "advisories": advised, "message": message}

    known = [n["valid_from"] for n in ns if n["valid_from"] is not None]
    if not known:
        return packet("indeterminate", f"As of {as_of}, guidance for '{name}' is indeterminate due to missing lifecycle dates ('valid_from').")
    if as_of < min(known):
        if ns[0]["valid_from"] is None:
            return packet("indeterminate", f"As of {as_of}, guidance for '{name}' is indeterminate: earliest note '{ns[0]['id']}' lacks 'valid_from' and cannot be verified as active prior to known date '{min(known)}'.")
        return packet("not_yet_valid", f"As of {as_of}, guidance for '{name}' was not yet valid (earliest valid_from is '{min(known)}').")
    live, over, vague = [], None, False
    for i, n in enumerate(ns):
        after = ns[i + 1]["valid_from"] if i + 1 < len(ns) else None
        vague |= n["valid_from"] is None or (i + 1 < len(ns) and after is None)
        if n["valid_from"] is not None and n["valid_from"] <= as_of:
            if (after is None or as_of < after) and (n["valid_until"] is None or as_of <= n["valid_until"]):
                live.append(n)
            if n["valid_until"] is not None and as_of > n["valid_until"]:
                over = n
    if len(live) > 1:
        raise UnresolvedConflict(f"Unresolved conflict: {MARK} Multiple competing active notes match as_of '{as_of}': {', '.join(repr(n['id']) for n in live)}. {ABSTAIN}")
    if live:
        return packet("active", f"Resolved active guidance as of {as_of} to '{live[0]['id']}'.", live[0])
    if over:
        return packet("expired", f"As of {as_of}, guidance for '{name}' had expired (note '{over['id']}' valid_until was '{over['valid_until']}').")
    if vague:
        return packet("indeterminate", f"As of {as_of}, guidance for '{name}' is indeterminate due to missing lifecycle dates in the supersession chain.")
    return packet("no_active_guidance", f"No guidance was active for '{name}' as of {as_of}.")


#: Always in the output, even if empty.
KEPT = {"query_scope", "chain", "dependents", "candidates", "findings", "actions", "edges_by_type", "malformed_files"}


def trimmed(packet: dict) -> dict:
    """Without null and empty fields, but for those that are always there."""
    return {k: v for k, v in packet.items() if k in KEPT or v not in (None, [], {})}
