"""A vault of our own with every kind of finding, and what each operator says about it."""

import io
import json

import pytest

from loomgraph import cli, render
from loomgraph.functions import paths, scope
from loomgraph.operators import graph as gr
from loomgraph.operators import lint, walks
from loomgraph.plans import export, normalize, packets
from loomgraph.sources.notes import NoteError, load_vault, parse_note, split_note
from loomgraph.toolserver import Tools, serve

NORTH = {"region": "north"}
NOTES = {
    "glossary": dict(type="Concept"),
    "tariff-v1": dict(type="Decision", valid_from="2019-03-01", valid_until="2020-10-31", scope=NORTH, rel=[("depends_on", "glossary")], body="Flat price."),
    "tariff-v2": dict(type="Decision", valid_from="2020-11-01", scope=NORTH, rel=[("supersedes", "./tariff-v1.md", "audit 4"), ("supported_by", "audit"), ("supported_by", "unwritten report")]),
    "tariff-v3": dict(type="Decision", valid_from="2022-04-15", scope=NORTH, rel=[("supersedes", "tariff-v2", "survey 7"), ("depends_on", "glossary.md")], body="Two prices."),
    "audit": dict(type="Review", status="final", body="Too many exceptions."),
    "billing": dict(type="Service", scope=NORTH, rel=[("depends_on", "tariff-v3")]),
    "portal": dict(type="Application", rel=[("depends_on", "billing")]),
    "old-map": dict(type="Concept", status="Archived", valid_from="2015-01-01", valid_until="2016-01-01"),
    "storage": dict(type="Decision"),
    "storage-disk": dict(type="Decision", rel=[("supersedes", "storage", "bench A")]),
    "storage-tape": dict(type="Decision", scope={"tier": "cold"}, rel=[("supersedes", "storage")]),
    "left": dict(type="Proposal", rel=[("supersedes", "right", "note L")]),
    "right": dict(type="Proposal", rel=[("supersedes", "left")]),
    "quota-hard": dict(type="Decision", rel=[("contradicts", "quota-soft", "memo 1")]),
    "quota-soft": dict(type="Decision", rel=[("contradicts", "audit", "memo 0"), ("contradicts", "quota-hard", "memo 2")]),
    "orphan": dict(type="Decision", rel=[("depends_on", "./absent.md")]),
    "key-policy": dict(type="Decision"),
    "key-policy-eu": dict(type="Decision", scope={"region": "eu"}, rel=[("supersedes", "key-policy")]),
}


def write(root, notes):
    for name, n in notes.items():
        lines = ["---", f"id: {name}", f"type: {n['type']}", f"title: On {name}"]
        lines += [f"{k}: {n[k]}" for k in ("status", "valid_from", "valid_until") if k in n]
        if "scope" in n:
            lines += ["scope:", *(f"  {k}: {v}" for k, v in n["scope"].items())]
        if "rel" in n:
            lines.append("relations:")
            for r in n["rel"]:
                lines += [f"  - type: {r[0]}", f"    target: {r[1]}"] + ([f"    evidence: {r[2]}"] if len(r) > 2 else [])
        (root / f"{name}.md").write_text("\n".join([*lines, "---", n.get("body", ""), ""]))


@pytest.fixture
def root(tmp_path):
    write(tmp_path, NOTES)
    return tmp_path


def test_inventory_and_findings(spark, root):
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("---\nid: x\n")
    (root / "_bad.md").write_text("no front")
    g = load_vault(spark, str(root))
    assert cli.inventory(g, "v")["edges_by_type"] == {"contradicts": 3, "depends_on": 4, "supersedes": 7, "supported_by": 1}
    found = [(r.kind, r.source, r.target) for r in lint.findings(g).collect()]
    conflicts = [("conflicting_assertion", a, b) for a, b in (("quota-hard", "quota-soft"), ("quota-soft", "audit"), ("storage-disk", "storage-tape"))]
    assert found == [("broken_target", "orphan", "./absent.md"), ("broken_target", "tariff-v2", "unwritten report"), *conflicts, ("malformed_file", "_bad.md", None), ("scope_mismatch", "key-policy-eu", "key-policy"), ("scope_mismatch", "storage-tape", "storage"), ("supersession_cycle", "left", None)]
    assert {(r.type, r.target) for r in gr.inverse_relations(g).where("id = 'glossary'").collect()} == {("required_by", "tariff-v1"), ("required_by", "tariff-v3")}


def test_batch_agrees_with_single_answers(spark, root):
    g = load_vault(spark, str(root))
    for asked in ({}, {"tier": "hot"}):
        got = {r.seed: (r.status, r.conflict, r.active_guidance_id) for r in walks.current(g, asked).collect()}
        for seed in ("storage", "tariff-v1", "tariff-v3", "left", "old-map", "quota-hard", "key-policy"):
            p = packets.current_packet(g, seed, asked)
            kind = p["unresolved_conflict"]["kind"] if p["unresolved_conflict"] else None
            assert got[seed] == (p["status"], kind, p["active_guidance_id"]), seed


def test_current_packet(spark, root):
    g = load_vault(spark, str(root))
    p = packets.current_packet(g, "tariff-v1", {})
    assert (p["active_guidance_id"], p["status"], p["is_current"]) == ("tariff-v3", "superseded", False)
    assert p["supersession_chain"] == [{"predecessor": "tariff-v1", "successor": "tariff-v2", "evidence": "audit 4"}, {"predecessor": "tariff-v2", "successor": "tariff-v3", "evidence": "survey 7"}]
    assert [(h["node"]["id"], h["superseded_by"], h["evidence"]) for h in p["historical_rationale"]] == [("tariff-v1", "tariff-v2", "audit 4"), ("tariff-v2", "tariff-v3", "survey 7")]
    assert p["active_note"]["relations"][0] == {"type": "supersedes", "target": "tariff-v2", "evidence": "survey 7"} and p["active_note"]["body"].strip() == "Two prices."
    text = render.current(p)
    for part in ("- **Status**: SUPERSEDED (Resolved to successor)", "## Active Guidance\n\n### On tariff-v3 (`tariff-v3`)", "- **Relations** (2):\n  - supersedes -> tariff-v2 (evidence: survey 7)", "#### Content\n\nTwo prices.", "## Historical Rationale (SUPERSEDED)", "> DO NOT treat this content as current", "### On tariff-v1 (`tariff-v1`) [SUPERSEDED]\n\n- **Type**: Decision\n- **Superseded By**: `tariff-v2`", "#### Content\n\nFlat price."):
        assert part in text, part
    assert "- **Status**: CURRENT GUIDANCE" in render.current(packets.current_packet(g, "glossary.md", {}))
    assert packets.current_packet(g, "storage", {"tier": "hot"})["advisories"] == ["A successor exists in another scope: 'storage-tape' (scope: [tier=cold])"]


def test_conflicts(spark, root):
    g = load_vault(spark, str(root))
    c = packets.current_packet(g, "storage", {})["unresolved_conflict"]
    assert c["candidates"] == [{"id": "storage-disk", "title": "On storage-disk", "path": "storage-disk.md", "evidence": "bench A"}, {"id": "storage-tape", "title": "On storage-tape", "path": "storage-tape.md", "scope": {"tier": "cold"}}]
    text = render.current(packets.current_packet(g, "storage", {}))
    for part in ("> ### [UNRESOLVED_CONFLICT]\n> - **Kind**: competing_successors\n> - **Predecessor**: `storage`", ">   - `storage-disk` (evidence: bench A)\n>   - `storage-tape`", "### On storage-tape (`storage-tape`) [DISPUTED]"):
        assert part in text, part
    p = packets.current_packet(g, "right", {})
    assert p["unresolved_conflict"]["cycle"] == ["right", "left"] and [x.get("evidence") for x in p["unresolved_conflict"]["candidates"]] == ["note L", None]
    assert "> - **Cycle Path**: right -> left -> right" in render.current(p)
    # each side's own evidence, whichever side is asked
    for seed, want in (("quota-hard", [("quota-hard", "memo 1"), ("quota-soft", "memo 2")]), ("audit", [("audit", None), ("quota-soft", "memo 0")])):
        c = packets.current_packet(g, seed, {})["unresolved_conflict"]
        assert (c["kind"], [(x["id"], x.get("evidence")) for x in c["candidates"]]) == ("contradiction", want)


def test_lineage_impact_history(spark, root):
    g = load_vault(spark, str(root))
    p = packets.lineage_packet(g, "tariff-v2", {})
    assert [(e["node"]["id"], e.get("adopted_evidence"), e.get("supersession_evidence"), e["is_current"]) for e in p["chain"]] == [("tariff-v1", None, "audit 4", False), ("tariff-v2", "audit 4", "survey 7", False), ("tariff-v3", "survey 7", None, True)]
    assert p["chain"][1]["supported_by"] == ["audit", "unwritten report"] and [n["id"] for n in p["empirical_evidence"]] == ["audit"]
    assert p["transitions"][1] == {"predecessor": "tariff-v2", "successor": "tariff-v3", "evidence": "survey 7"}
    text = render.lineage(p)
    for part in ("- **Chain Length**: 3", "`tariff-v1` -> `tariff-v2` -> `tariff-v3`", "### 1. On tariff-v1 (`tariff-v1`) [SUPERSEDED]", "### 3. On tariff-v3 (`tariff-v3`) [CURRENT GUIDANCE]", "- **Supported By**: [`audit`, `unwritten report`]", "## Empirical Evidence\n\n### On audit (`audit`)\n\n- **Type**: Review\n- **Status**: final"):
        assert part in text, part
    p = packets.impact_packet(g, "glossary.md", {})
    assert [(d["id"], d["depth"]) for d in p["dependents"]] == [("tariff-v1", 1), ("tariff-v3", 1), ("billing", 2), ("portal", 3)]
    assert "- **Dependency Path**: `glossary` -> `tariff-v3` -> `billing` -> `portal`" in render.impact(p) and '`glossary.md` ("On glossary")' in render.impact(p)
    assert "No downstream components depend on this note." in render.impact(packets.impact_packet(g, "portal", {}))
    for day, status, who in (("2018-07-07", "not_yet_valid", None), ("2019-03-01", "active", "tariff-v1"), ("2021-12-31", "active", "tariff-v2"), ("2030-01-01", "active", "tariff-v3")):
        p = packets.historical_packet(g, "tariff-v3", day, {})
        assert (p["status"], p["active_guidance_id"]) == (status, who)
        assert {r.root: r.status for r in walks.historical(g, day).collect()}["tariff-v1.md"] == status
        assert f"## Active Guidance (as of {day})" in render.historical(p) and ("No active guidance found" in render.historical(p)) == (who is None)
    assert packets.historical_packet(g, "old-map", "2017-01-01", {})["status"] == "expired"
    assert packets.historical_packet(g, "portal", "2017-01-01", {})["status"] == "indeterminate"
    with pytest.raises(packets.SupersessionCycle):
        packets.lineage_packet(g, "left", {})


def test_transitive_successor_wins(spark, tmp_path):
    p, q = {"env": "p"}, {"env": "q"}
    write(tmp_path, {"base": dict(type="Note"), "a": dict(type="Note", scope=q, rel=[("supersedes", "base")]), "x": dict(type="Note", scope=p, rel=[("supersedes", "a")]), "b": dict(type="Note", scope=p, rel=[("supersedes", "base"), ("supersedes", "x")])})
    g = load_vault(spark, str(tmp_path))
    got = {r.seed: r.active_guidance_id for r in walks.current(g).collect()}
    assert got == {s: packets.current_packet(g, s, {})["active_guidance_id"] for s in got}


def test_command_line(spark, root, capsys):
    v = str(root)
    assert cli.main(["lint", v], spark) == 1 and "Integrity Violations (8)" in capsys.readouterr().out
    assert cli.main(["query", v, "--seed", "storage"], spark) == 2 and "UNRESOLVED CONFLICT" in capsys.readouterr().out
    assert cli.main(["query", v, "--seed", "old-map", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)["status"] == "current"
    assert cli.main(["query", v, "--seed", "nobody"], spark) == 1 and "not found" in capsys.readouterr().err
    assert cli.main(["query", v, "--seed", "old-map", "--mode", "historical", "--as-of", "2026-13-01"], spark) == 1
    assert cli.main(["inspect", v], spark) == 0 and "Edges by Type:\n  - contradicts: 3" in capsys.readouterr().out
    assert cli.main(["inspect", f"{v}/tariff-v1.md"], spark) == 0 and "Node: tariff-v1\nType: Decision" in capsys.readouterr().out


def test_plan_and_apply(spark, tmp_path):
    write(tmp_path, {"old": dict(type="Note")})
    (tmp_path / "Legacy Note.md").write_text("---\ntitle: Legacy\ntype: Note\nsupersedes: \"[[old]]\"\n---\n# Legacy\nSee [[old|the old]].\n```\n[[old]]\n```\nend")
    p = normalize.plan(spark, str(tmp_path))
    assert [a["path"] for a in p["actions"]] == ["Legacy Note.md"]
    assert normalize.apply(str(tmp_path), p, dry_run=True)["modified"] == 1
    assert normalize.apply(str(tmp_path), p)["modified"] == 1
    assert normalize.apply(str(tmp_path), p) == {"modified": 0, "already_up_to_date": 1, "dry_run": False}
    assert normalize.plan(spark, str(tmp_path))["actions"] == []
    text = (tmp_path / "Legacy Note.md").read_text()
    assert "[the old](./old.md)" in text and "```\n[[old]]\n```" in text
    n = parse_note(text, "x")
    assert n["id"] == "legacy-note" and n["relations"][0]["target"] == "./old.md"
    (tmp_path / "old.md").write_text("changed")
    with pytest.raises(ValueError, match="Hash mismatch"):
        normalize.apply(str(tmp_path), {"actions": [{"path": "old.md", "source_sha256": "0", "expected_new_sha256": "1", "diff": ""}]})
    with pytest.raises(ValueError, match="leaves"):
        normalize.apply(str(tmp_path), {"actions": [{"path": "../x.md", "source_sha256": "0", "expected_new_sha256": "1", "diff": ""}]})


def test_export_round_trip(spark, root, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    (root / "links.md").write_text("---\nid: links\ntype: Note\ntitle: L\n---\n[a](audit) `[[audit]]` [[audit#x]] ![i](audit) [[none]]\n```\n[[audit]]\n```\n")
    g = load_vault(spark, str(root))
    m = export.export(g, str(root), out)
    assert (m["total_nodes"], m["relations_by_type"]["depends_on"]) == (19, 5)
    body = open(f"{out}/links.md").read()
    assert "[a](./audit.md) `[[audit]]` [audit#x](./audit.md#x) ![i](audit) [none](./none.md)\n```\n[[audit]]" in body
    again = load_vault(spark, out)
    key = ["path", "id", "title", "status", "valid_from"]
    assert sorted(again.nodes.select(*key).collect()) == sorted(g.nodes.select(*key).collect())


def test_tool_server(spark, root):
    t = Tools(spark, str(root), today=lambda: "2031-05-06")
    call = lambda name, **a: t.handle({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}})
    said = lambda reply: reply["result"]["content"][0]["text"]
    good = dict(id="new", title="New", type="Note", relations=[{"type": "depends_on", "target": "audit"}], body="\ntext\n\n", daily_summary=" done ")
    assert said(call("vault_write_canonical", **good)) == "Successfully wrote canonical note 'new' and updated daily log Daily/2031-05-06.md"
    log = root / "Daily" / "2031-05-06.md"
    assert log.read_text() == "# 2031-05-06\n\n## Log\n\n- [[new]]: done\n" and (root / "new.md").read_text().endswith("---\n\ntext\n")
    log.write_text("# kept")
    assert "result" in call("vault_write_canonical", **{k: v for k, v in good.items() if k != "relations"}) and log.read_text() == "# kept\n- [[new]]: done\n"
    assert "result" in call("vault_write_canonical", **good)
    page = said(call("inspect", target="audit"))
    assert "## Forward Relations (0)\n_None_" in page and "## Inverse Relations (3)" in page and "- required_by -> [[new]]" in page
    assert said(call("inspect")).startswith("# Vault Inventory\n\n- **Total Nodes**: 19") and "Node not found: 'nobody'" in call("inspect", target="nobody")["error"]["message"]
    for change in (dict(type="Odd"), dict(relations=[{"type": "supports", "target": "audit"}]), dict(id="../x"), dict(relations=[{"type": "depends_on", "target": "nope"}]), dict(relations=[{"type": "supersedes", "target": "new"}]), dict(relations=[{"type": "supersedes", "target": "audit"}])):
        assert "error" in call("vault_write_canonical", **(good | change)), change  # the last: the vault has a ring already
    # what can't be logged is taken back
    log.unlink()
    log.mkdir()
    before = (root / "new.md").read_text()
    assert "error" in call("vault_write_canonical", **(good | {"body": "other"})) and (root / "new.md").read_text() == before
    assert "error" in call("vault_write_canonical", **(good | {"id": "newer"})) and not (root / "newer.md").exists()
    assert not [f for d in (root, root / "Daily") for f in d.iterdir() if ".tmp" in f.name]
    assert "error" in call("vault_read", node_id="../x") and "On audit" in said(call("vault_read", node_id="audit"))
    tools = {x["name"]: x for x in t.handle({"id": 1, "method": "tools/list"})["result"]["tools"]}
    assert tools["query"]["inputSchema"]["required"] == ["seed"] and set(tools["vault_write_canonical"]["inputSchema"]["properties"]) == {"id", "title", "type", "relations", "body", "daily_summary"}
    assert all(x["description"] for x in tools.values())
    out = io.StringIO()
    serve(spark, str(root), ['{"jsonrpc":"2.0","id":1,"method":"initialize"}\n', '{"jsonrpc":"2.0","method":"initialized"}\n', '{"jsonrpc":"2.0","id":2,"method":"tools/list"}\n'], out)
    assert len(out.getvalue().splitlines()) == 2


def test_notes_are_read_as_text():
    n = parse_note("﻿---\nid: 7\ntype: on\ntitle: yes\nvalid_from: 2026-01-01\nvalid_until: null\nscope: {phase: 2}\nrelations:\n  - {type: x, target: t, scope: {}}\nmore: [1]\n...\nbody", "p")
    assert (n["id"], n["node_type"], n["valid_from"], n["valid_until"], n["scope"], n["relations"][0]["scope"], n["body"]) == ("7", "on", "2026-01-01", None, {"phase": "2"}, {}, "body")
    for bad in ("x", "---\nid: a\n", "---\nid: a\nid: b\ntype: t\ntitle: t\n---", "---\ntype: t\ntitle: t\n---", "---\nid: a\ntype: t\ntitle: t\nrelations:\n - {type: caused, target: x}\n---"):
        with pytest.raises(NoteError):
            parse_note(bad, "p")
    assert split_note("--- \na: 1\n---\n") == ("a: 1", "")


def test_paths_and_scopes(spark):
    from pyspark.sql import functions as F

    cases = [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", None), ("a/../../b", None), ("a\\b", "a/b"), ("", "")]
    df = spark.createDataFrame(cases, "p string, w string").select("p", "w", paths.normalize(F.col("p")).alias("g"))
    assert all(r.w == r.g == paths.normalize_one(r.p) for r in df.collect())
    pairs = [("a/b", "a/c.md"), ("", "x/y.md"), ("a", "b.md"), ("a/b", "a/b/c/d.md"), ("a", "a/x.md")]
    df = spark.createDataFrame(pairs, "f string, p string").select("f", "p", paths.relative(F.col("f"), F.col("p")).alias("g"))
    assert all(r.g == paths.relative_one(r.f, r.p) for r in df.collect())
    words = [("A b_C--d!",), ("é!",), ("  x ",)]
    assert all(r.g == paths.slug_one(r.t) for r in spark.createDataFrame(words, "t string").select("t", paths.slug(F.col("t")).alias("g")).collect())
    scopes = [{}, {"e": "p"}, {"e": "s"}, {"e": "p", "x": "1"}]
    for a in scopes:
        for b in scopes:
            r = spark.range(1).select(scope.overlaps(scope.literal(a), scope.literal(b)).alias("o"), scope.covers(scope.literal(a), scope.literal(b)).alias("c")).first()
            assert r.o == scope.overlap(a, b) == scope.overlap(b, a) and r.c == (a.items() <= b.items())
    assert scope.parse_arguments(["a=1, b=2", "a=3"]) == {"a": "3", "b": "2"}
    with pytest.raises(ValueError):
        scope.parse_arguments(["a"])


def test_doubling_ends_every_chain(spark):
    def chain(name, steps):
        return [(f"{name}{i:04d}", f"{name}{i + 1:04d}") for i in range(steps)]

    def want(rows):
        nxt, out = dict(rows), {}
        for p in {x for r in rows for x in r}:
            at, hops = p, 0
            while at in nxt and hops <= len(nxt):
                at, hops = nxt[at], hops + 1
            out[p] = (None, None, True) if at in nxt else (at, hops, False)
        return out

    hot = chain("h", 600) + [e for i in range(40) for e in chain(f"c{i:02d}_", 14)]
    circle = [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")]
    for rows in (chain("a", 5), chain("a", 9), chain("a", 600), hot, chain("a", 5) + circle, hot + circle, circle):
        following = spark.createDataFrame(rows, "path string, next string")
        nodes = following.select("path").union(following.select("next")).distinct()
        got = {r.path: (None, None, True) if r.turns else (r.last, r.hops, False) for r in walks.doubled(nodes, following).collect()}
        assert got == want(rows)
