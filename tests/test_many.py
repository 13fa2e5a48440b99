"""Operators for many seeds, links or successors at once, against brute force on small vaults."""

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import paths, scope
from loomgraph.operators import asof, lint, order, walks, wikilinks
from loomgraph.operators.graph import Graph
from loomgraph.plans import changes
from loomgraph.sources.derived import notes, relation


# --- what was valid on a date


def dated(spark, chains):
    """Chains of (first day, last day), each replacing the one before it."""
    rows = [(f"c{c:02}-{i}", f"c{c:02}-{i - 1}" if i else None, a, b) for c, chain in enumerate(chains) for i, (a, b) in enumerate(chain)]
    df = spark.createDataFrame(rows, "id string, before string, first string, last string")
    rel = F.when(F.col("before").isNotNull(), F.array(relation("supersedes", F.col("before")))).otherwise(F.array())
    return Graph(notes(df, id=F.col("id"), valid_from=F.col("first"), valid_until=F.col("last"), relations=rel))


def answer(chain, day):
    firsts = [a for a, _ in chain if a is not None]
    if not firsts or (day < min(firsts) and chain[0][0] is None):
        return "indeterminate", None
    if day < min(firsts):
        return "not_yet_valid", None
    live, vague, over = [], any(a is None for a, _ in chain), False
    for i, (a, b) in enumerate(chain):
        if a is None or day < a:
            continue
        over |= b is not None and day > b
        after = chain[i + 1][0] if i + 1 < len(chain) else None
        if (after is None or day < after) and (b is None or day <= b):
            live.append(i)
    if len(live) > 1:
        return "UnresolvedConflict", None
    return ("active", live[0]) if live else ("expired" if over else "indeterminate" if vague else "no_active_guidance", None)


def test_many_dates(spark):
    rng = random.Random(5)
    day = lambda: f"2020-01-{rng.randint(1, 28):02}"
    chains = [[(rng.choice([day(), day(), day(), None]), rng.choice([None, None, day()])) for _ in range(rng.randint(1, 5))] for _ in range(40)]
    asked = [(c, rng.randrange(len(chains[c])), day()) for c in (rng.randrange(40) for _ in range(500))]
    asked += [(c, 0, a) for c, chain in enumerate(chains) for a, _ in chain if a] + [(c, 0, b) for c, chain in enumerate(chains) for _, b in chain if b]
    rows = [(f"c{c:02}-{i}", d, c) for c, i, d in asked]
    bad = [("c00-0", None, -1), ("nobody", "2020-01-01", -2), ("c00-0", "2020-13-01", -3), ("c00-0", "2020-1-01", -4), (None, "2020-01-01", -5)]
    table = spark.createDataFrame(rows + bad, "seed string, as_of string, root int").repartition(5)
    got = asof.historical_for(dated(spark, chains), table).collect()
    want = Counter()
    for seed, d, c in rows:
        status, i = answer(chains[c], d)
        want[seed, d, c, status, None if i is None else f"c{c:02}-{i}"] += 1
    want.update((*b, s, None) for b, s in zip(bad, ("MissingAsOf", "SeedNotFound", "InvalidDateFormat", "InvalidDateFormat", "SeedNotFound"), strict=True))
    assert Counter(map(tuple, got)) == want
    assert {"active", "expired", "not_yet_valid", "indeterminate", "no_active_guidance"} <= {r.status for r in got} | {"no_active_guidance"}


def test_running_totals_of_a_hot_key(spark):
    rows = [("hot", i, 1, i) for i in range(700)] + [(f"k{i % 9}", i, i, -1) for i in range(90)]
    got = order.running(spark.createDataFrame(rows, "key string, at int, a long, b long").repartition(6), "key", ["at"], ["a", "b"]).collect()
    want, sums = [], {}
    for k, at, a, b in sorted(rows):
        x, y = sums.get(k, (0, 0))
        sums[k] = (x + a, y + b)
        want.append((k, at, *sums[k]))
    assert sorted((r.key, r.at, r.a, r.b) for r in got) == want


# --- competing successors


def test_competing_successors(spark):
    rng = random.Random(3)
    pick = lambda: {k: rng.choice("12") for k in rng.sample("abc", rng.randint(0, 3))}
    for _ in range(2):
        names = [f"m{i:02}" for i in range(14)]
        edges = [(n, p, pick()) for n in names for p in ("base", "other") if rng.random() < 0.8]
        edges += [(*rng.sample(names, 2), {"own": "no"}) for _ in range(12)] + [(names[0], "base", pick())]
        every = sorted({x for a, b, _ in edges for x in (a, b)})
        rows = [(n, n in names[:2], [{"target": b, "scope": s} for a, b, s in edges if a == n]) for n in every]
        df = spark.createDataFrame(rows, "id string, off boolean, r array<struct<target:string,scope:map<string,string>>>")
        rel = F.transform("r", lambda x: relation("supersedes", x.target, None, x.scope))
        g = Graph(notes(df, id=F.col("id"), scope=F.create_map(F.lit("own"), F.lit("yes")), status=F.when(F.col("off"), "Retired"), relations=rel))
        direct = {(a, b) for a, b, _ in edges}
        dead = set(names[:2]) | {b for a, b, s in edges if b in names and scope.overlap(s, {"own": "yes"})}
        want, pairs = {}, Counter()
        for p in every:
            up = [(a, s) for a, b, s in edges if b == p and a not in dead]
            for (a, s), (b, t) in itertools.combinations(up, 2):
                if scope.overlap(s, t) and (a, b) not in direct and (b, a) not in direct:
                    want.setdefault((min(a, b), max(a, b)), p)
                    pairs[p] += 1
        assert {(r.source, r.target): r.predecessor for r in lint.competing_pairs(g).collect()} == want and len(want) > 20
        got = Counter()
        for r in lint.competing_classes(g).collect():
            got[r.predecessor] += r.n_pairs - r.n_settled
        assert got == pairs


# --- links


def test_targets_by_id_and_path(spark):
    files = ["a/x.md", "a/y.markdown", "b/x.md", "x.md", "z", "a/z.md", "b/c/w.md", "w.markdown", "a/w", "a/w.md"]
    ids = {p: f"id{i}" for i, p in enumerate(files)} | {"b/x.md": "y", "x.md": "z.md"}
    forms = ["x", "x.md", "./x", "../x", "../x.md", "/x", "z", "y", "id0", "./id0", "../../x", "w", "w.md", "a/w", "c/w", "../a/y", " x ", "..\\a\\x", "a//x.md", "", "nothing", "w.markdown", "z.md", "../c/../x"]
    df = spark.createDataFrame([(p, ids[p], forms) for p in files], "path string, id string, t array<string>")
    g = Graph(notes(df, id=F.col("id"), path=F.col("path"), relations=F.transform("t", lambda x: relation("relates_to", x))))

    def by_path(p):
        if not p:
            return None
        more = [] if p.endswith((".md", ".markdown")) else [f"{p}.md", f"{p}.markdown"]
        return next((x for x in [p, *more] if x in files), None)

    def find(src, target):
        target = target.strip()
        near = by_path(paths.resolve_one(paths.folder_of(src), target))
        if target.startswith(("./", "../")):
            return near
        return next((p for p in files if ids[p] == target), None) or near or by_path(paths.normalize_one(target))

    got = {(r.src_path, r.target_raw): r.dst_path for r in g.resolved.collect()}
    assert got == {(p, t): find(p, t) for p in files for t in forms}


def test_ids_are_found_without_paths(spark, monkeypatch):
    """Where all targets are ids no path is looked up; an id that repeats means the greatest path, and edges carry that note's scope."""
    def never(self):
        raise AssertionError("paths were looked up")

    df = spark.createDataFrame([("a.md", "a", ["b", " c "], "1"), ("b1.md", "b", ["c"], "2"), ("b2.md", "b", [], "3"), ("c.md", "c", None, "4")], "path string, id string, t array<string>, s string")
    nodes = notes(df, id=F.col("id"), path=F.col("path"), scope=F.create_map(F.lit("s"), F.col("s")), relations=F.transform("t", lambda x: relation("supersedes", x)))
    monkeypatch.setattr(Graph, "path_keys", property(never))
    got = {(r.src_path, r.dst_path, r.dst_id, r.dst_scope["s"], r.dst_declares) for r in Graph(nodes).edges.collect()}
    assert got == {("a.md", "b2.md", "b", "3", False), ("a.md", "c.md", "c", "4", False), ("b1.md", "c.md", "c", "4", False)}


def test_wikilinks(spark):
    files = ["a/One.md", "b/one.markdown", "two.md", "a/.hidden", "c/Two words.md", "d/x.y.md", "e/plain"]
    bodies = [
        "See [[one]] and [[ONE.md|first]]\n```\n[[one]]\n```\nthen [[b/one.markdown#part | s | t]], [[ two ]] [[]] [[#top]]",
        "no link\n", "", None, "[[x.y]] [[X]] [[.hidden]] [[plain]]\r\n~~~\n[[one]]\n", "[[[one]]] [[one]\n]] [[Two words]] [[../up.md]] [[q\\r]]\n\n", "  ```\n[[one]]\n~~~\n[[c/two Words]]",
    ]
    df = spark.createDataFrame(list(zip(files, bodies, strict=True)), "path string, body string")

    def target(src, name):
        base, _, anchor = (x.strip() for x in name.partition("#"))
        base, anchor = base.replace("\\", "/"), f"#{anchor}" if anchor else ""
        if not base:
            return anchor
        for p in sorted(files):
            file = p.rpartition("/")[2]
            stem = file.rpartition(".")[0] or file
            if base.lower() in {p.lower(), stem.lower(), file.lower()} or f"{base}.md".lower() == p.lower():
                return paths.relative_one(paths.folder_of(src), p) + anchor
        base += "" if base.endswith((".md", ".markdown")) else ".md"
        return (base if base.startswith(("./", "../")) else f"./{base}") + anchor

    def new(src, body):
        out, fence = [], False
        for line in body.split("\n"):
            if line.lstrip().startswith(("```", "~~~")):
                fence = not fence
            elif not fence:
                def put(m):
                    name, sign, said = m[1].strip().partition("|")
                    return f"[{said.strip() if sign else name.strip()}]({target(src, name.strip())})"

                line = re.sub(r"\[\[(.*?)\]\]", put, line)
            out.append(line)
        return "\n".join(out)

    want = {p: new(p, b) for p, b in zip(files, bodies, strict=True) if b and new(p, b) != b}
    assert {r.path: r.body for r in wikilinks.rewritten(df).collect()} == want and len(want) == 4


# --- dependents


def test_impact_in_the_order_of_discovery(spark):
    rng = random.Random(12)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(a, b) for a, b in (rng.sample(names, 2) for _ in range(110))] + [(f"t{i + 1:02}", f"t{i:02}") for i in range(8)] + [("t00", "n00")]
    seeds = ["n00", "n07", "n33", "t05", "alone"]
    want = {}
    for seed in seeds:
        queue, way = [seed], {seed: [seed]}
        for at in queue:
            for x in sorted({a for a, b in pairs if b == at} - set(way)):
                way[x] = [*way[at], x]
                queue.append(x)
        want |= {(seed, x): w for x, w in way.items() if x != seed}
    edges = spark.createDataFrame([*pairs, *pairs[:5]], "src string, dst string")
    got = walks.impact(edges, spark.createDataFrame([(s,) for s in [*seeds, "n00"]], "node string")).collect()
    assert {(r.seed, r.node): r.trail for r in got} == want and len(got) == len(want)
    assert all(r.depth == len(r.trail) - 1 for r in got)
    assert walks.impact(edges, spark.createDataFrame([], "node string")).count() == 0


def test_impact_orders_only_what_others_depend_on(spark, monkeypatch):
    """30 leaves of several ways: a table with places holds the seeds and the two nodes between, and the ways are the first found."""
    placed = []

    class Seen(walks.Growing):
        def add(self, rows):
            out = super().add(rows)
            placed.append(out.count() if {"rank", "place"} & set(out.columns) else 0)
            return out

    monkeypatch.setattr(walks, "Growing", Seen)
    pairs = [("b1", "s"), ("a2", "s")] + [(f"x{i:02}", p) for i in range(30) for p in ("b1", "a2")] + [("x03", "s"), ("b1", "t")]
    got = walks.impact(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("s",), ("t",)], "node string")).collect()
    want = {("s", f"x{i:02}"): ["s", "a2", f"x{i:02}"] for i in range(30)} | {("t", f"x{i:02}"): ["t", "b1", f"x{i:02}"] for i in range(30)}
    want |= {("s", "a2"): ["s", "a2"], ("s", "b1"): ["s", "b1"], ("t", "b1"): ["t", "b1"], ("s", "x03"): ["s", "x03"]}
    assert {(r.seed, r.node): r.trail for r in got} == want and len(got) == len(want)
    assert sum(placed) == 5


# --- diffs and plans


def in_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_diffs_are_shortest_and_apply():
    rng = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rng.choice(["a\n", "b\n", "c\r\n", "\n", "d", "--- x\n", "@@ -1 +1 @@\n"]) for _ in range(rng.randint(0, 16))) for _ in range(2))
        if rng.random() < 0.5:
            lines = changes._lines(a)
            for _ in range(min(len(lines), 2)):
                lines[rng.randrange(len(lines))] = rng.choice(["x\n", "y\n", ""])
            b = "".join(lines)
        diff, x, y = changes.unified("p", a, b), changes._lines(a), changes._lines(b)
        assert changes.patched(a, diff) == b and (diff == "") == (a == b)
        assert sum(q - p + s - r for p, q, r, s in changes.changes(x, y)) == len(x) + len(y) - 2 * in_common(x, y)
    long = [f"line {i}\n" for i in range(3000)]
    new = [x for i, x in enumerate(long) if i % 100] + ["end"]
    assert changes.patched("".join(long), changes.unified("p", "".join(long), "".join(new))) == "".join(new)
    assert changes.patched("a\nb\n", changes.unified("p", "a\nc\n", "a\nd\n")) is None


def test_plans_are_applied_as_a_whole_or_not(spark, tmp_path):
    table = str(tmp_path / "notes")
    old = {f"n{i}.md": f"title {i}\nbody\n" for i in range(30)} | {"none.md": None, "empty.md": ""}
    new = {p: (t or "") + "more\n" if i % 2 else t for i, (p, t) in enumerate(old.items())}
    frame = lambda d: spark.createDataFrame(list(d.items()), "path string, text string")
    plan = changes.planned(spark.createDataFrame([(p, old[p], new[p]) for p in old], "path string, old string, new string"))
    frame(old).write.parquet(table)
    read = lambda: {r.path: r.text for r in spark.read.parquet(table).collect()}
    first = read()
    todo = sum((old[p] or "") != (new[p] or "") for p in old)
    assert changes.apply_plan(spark, table, plan, dry_run=True) == {"modified": todo, "up_to_date": 0} and read() == first
    for bad in (("n1.md", "0" * 64, "1" * 64, ""), ("lost.md", "0" * 64, "1" * 64, "")):
        more = spark.createDataFrame([bad], "path string, source_sha256 string, expected_new_sha256 string, diff string")
        status = {r.path: r.status for r in changes.checked(frame(old), plan.union(more)).collect()}[bad[0]]
        assert status == ("ambiguous" if bad[0] == "n1.md" else "missing")
        with pytest.raises(ValueError, match=f"{bad[0]}' is {status}"):
            changes.apply_plan(spark, table, plan.union(more))
        assert read() == first
    wrong = plan.withColumn("expected_new_sha256", F.when(F.col("path") == "n3.md", F.lit("0" * 64)).otherwise(F.col("expected_new_sha256")))
    with pytest.raises(ValueError, match="n3.md' is broken"):
        changes.apply_plan(spark, table, wrong)
    changed = frame(old | {"n5.md": "other"})
    assert {r.path for r in changes.checked(changed, plan).where("status = 'changed'").collect()} == {"n5.md"}
    assert changes.apply_plan(spark, table, plan.union(plan)) == {"modified": todo, "up_to_date": 0}
    assert {p: t or "" for p, t in read().items()} == {p: t or "" for p, t in new.items()} and [p.name for p in tmp_path.iterdir()] == ["notes"]
    assert changes.apply_plan(spark, table, plan) == {"modified": 0, "up_to_date": todo}
