"""Command line: inspect, lint, query, plan, apply, export, serve.  ``python -m loomgraph.cli --help``"""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomgraph import render
from loomgraph.functions.scope import parse_arguments
from loomgraph.operators import graph as gr
from loomgraph.operators import lint as checks
from loomgraph.plans import export as exporting
from loomgraph.plans import normalize, packets
from loomgraph.sources.notes import NoteError, load_vault, parse_note


def session() -> SparkSession:
    return SparkSession.builder.appName("loomgraph").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", os.environ.get("LOOMGRAPH_PARTITIONS", "4")).config("spark.log.level", "ERROR").getOrCreate()


def vault(spark: SparkSession, root: str) -> gr.Graph:
    if not os.path.isdir(root):
        raise ValueError(f"Vault path '{root}' does not exist or is not a directory")
    return load_vault(spark, root)


def inventory(g: gr.Graph, root: str) -> dict:
    n = gr.inventory(g).first()
    by = {r.type: r.n for r in gr.edges_by_type(g).orderBy("type").collect()}
    bad = [r.asDict() for r in g.malformed.orderBy("path").collect()] if g.malformed is not None else []
    return {"vault_path": root, "total_nodes": n.total_nodes, "total_edges": n.total_edges, "edges_by_type": by, "malformed_files": bad}


def lint_report(g: gr.Graph, root: str) -> dict:
    found = [{k: v for k, v in r.asDict().items() if v is not None} for r in checks.findings(g).collect()]
    n, errors = gr.inventory(g).first(), sum(f["severity"] == "error" for f in found)
    return {"vault_path": root, "healthy": errors == 0, "total_nodes": n.total_nodes, "total_edges": n.total_edges, "errors": errors, "warnings": len(found) - errors, "findings": found}


def node_detail(g: gr.Graph, target: str, root: str) -> tuple[dict, list[dict]]:
    path = packets.find_seed(g, target, root)
    r = g.nodes.where(F.col("path") == path).first()
    n = packets.note(r.asDict(recursive=True))
    inverse = gr.inverse_relations(g).where(F.col("path") == path).orderBy("target", "type").collect()
    return n, [{"type": x.type, "target": x.target, "evidence": x.evidence} for x in inverse]


def answer(g: gr.Graph, root: str, seed: str, mode: str, scope: dict[str, str], as_of: str | None) -> dict:
    mode = mode.lower()
    if mode == "historical":
        if not as_of:
            raise packets.MissingAsOf("Missing required '--as-of <YYYY-MM-DD>' parameter for historical query mode")
        return packets.historical_packet(g, seed, packets.check_date(as_of), scope, root)
    make = {"current": packets.current_packet, "lineage": packets.lineage_packet, "impact": packets.impact_packet}.get(mode)
    if make is None:
        raise packets.UnsupportedMode(f"Unsupported query mode '{mode}'. Currently supported modes: current, lineage, impact, historical")
    return make(g, seed, scope, root)


def as_json(x) -> str:
    return json.dumps(x, indent=2, ensure_ascii=False)


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "inspect":
        if os.path.isdir(args.path):
            i = inventory(load_vault(spark, args.path), args.path)
            print(as_json(i) if args.json else render.inventory(i))
        else:
            n = parse_note(Path(args.path).read_bytes().decode("utf-8"), args.path)
            d = packets.note(n)
            print(as_json(d) if args.json else render.node(d))
        return 0
    if args.command == "lint":
        r = lint_report(vault(spark, args.path), args.path)
        print(as_json(r) if args.json else render.lint(r))
        return 0 if r["healthy"] else 1
    if args.command == "query":
        scope = parse_arguments(args.scope or [])
        p = answer(vault(spark, args.vault), args.vault, args.seed, args.mode, scope, args.as_of)
        print(as_json(packets.trimmed(p)) if args.json else render.PACKET[p["mode"]](p))
        return 2 if p.get("unresolved_conflict") else 0
    if args.command == "plan":
        p = as_json(normalize.plan(spark, args.vault))
        if args.out:
            Path(args.out).write_text(p)
        else:
            print(p)
        return 0
    if args.command == "apply":
        r = normalize.apply(args.vault, normalize.read_plan(args.plan), args.dry_run)
        if args.dry_run:
            print(f"Validation successful. {r['modified']} files would be modified ({r['already_up_to_date']} already up-to-date). [dry-run]")
        else:
            print(f"Applied {r['modified']} changes ({r['already_up_to_date']} files already up-to-date).")
        return 0
    if args.command == "export":
        if args.format.lower() != "okf":
            raise ValueError(f"Unsupported export format '{args.format}'")
        m = exporting.export(vault(spark, args.vault), args.vault, args.out)
        print(as_json(m) if args.json else f"Exported {m['total_nodes']} notes and {m['total_relations']} relations to {args.out}")
        return 0
    from loomgraph.toolserver import serve

    return serve(spark, args.vault)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("inspect", "lint"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--json", action="store_true")
    c = sub.add_parser("query")
    c.add_argument("vault")
    c.add_argument("--seed", required=True)
    c.add_argument("--mode", default="current")
    c.add_argument("--as-of")
    c.add_argument("--scope", action="append")
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("plan")
    c.add_argument("vault")
    c.add_argument("--out")
    c = sub.add_parser("apply")
    c.add_argument("vault")
    c.add_argument("--plan", required=True)
    c.add_argument("--dry-run", action="store_true")
    c = sub.add_parser("export")
    c.add_argument("vault")
    c.add_argument("--format", default="okf")
    c.add_argument("--out", required=True)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("serve")
    c.add_argument("--vault", default=".")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args, spark or session())
    except (ValueError, OSError, NoteError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
