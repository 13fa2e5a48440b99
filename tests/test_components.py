"""Strong components, their order and transitive replacement against brute force."""

import random

from pyspark.sql import functions as F

from loomgraph.functions import scope
from loomgraph.operators import lint, strong, walks
from loomgraph.operators.graph import Graph
from loomgraph.operators.order import numbered
from loomgraph.sources.derived import notes, relation


def cyclic(pairs):
    """Brute force: the components of more than one node or with an edge to itself, by name."""
    return {min(c): c for c in lint.strong_components(pairs) if len(c) > 1 or any(a == b and a in c for a, b in pairs)}


GRAPHS = {
    "long tail and ring": [(f"t{i:03}", f"t{i + 1:03}") for i in range(300)] + [("t300", "r000")] + [(f"r{i:03}", f"r{(i + 1) % 120:03}") for i in range(120)],
    "two rings that share a node": [("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("e", "b"), ("e", "f"), ("f", "f"), ("g", "a")],
    "ladder both ways": [(f"{x}{i:02}", f"{y}{i + 1:02}") for i in range(6) for x in "pq" for y in "pq"] + [("p06", "p02")],
    "acyclic": [("a", "b"), ("a", "c"), ("b", "c"), ("c", "d"), ("b", "d")],
}
rng = random.Random(4)
GRAPHS |= {f"random {n}, {m}": [(f"v{rng.randrange(n):02}", f"v{rng.randrange(n):02}") for _ in range(m)] for n, m in ((30, 25), (40, 50), (40, 90))}


def test_strong_components(spark):
    """All graphs side by side: what is done for one doesn't touch the others."""
    pairs = [(f"{i}{a}", f"{i}{b}") for i, own in enumerate(GRAPHS.values()) for a, b in own]
    edges = spark.createDataFrame([*pairs, *pairs[:3], (None, "a")], "s string, d string")
    want = cyclic(pairs)
    after = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    got = {}
    for r in strong.cycle_members(edges).orderBy("component", "pos").collect():
        got.setdefault(r.component, []).append(r.node)
        assert r.pos == len(got[r.component]) - 1
    assert got == {k: lint.ordered_cycle(c, after, k) for k, c in want.items()} and len(want) > 6


def test_no_edges(spark):
    assert strong.strong_components(spark.createDataFrame([], "s string, d string")).count() == 0


def test_places_of_a_hot_key(spark):
    rows = [("hot", i // 3, "x") for i in range(900)] + [(f"k{i}", None if i % 2 else i, "y") for i in range(50)] + [(None, 1, "z")]
    got = numbered(spark.createDataFrame(rows, "key string, v long, n2 string").repartition(7), "key", "v").where("key is not null").collect()
    assert len(got) == 950
    hot = sorted((r.pos, r.v) for r in got if r.key == "hot")
    assert [p for p, _ in hot] == list(range(900)) and [v for _, v in hot] == [i // 3 for i in range(900)] and {r.n for r in got if r.key == "hot"} == {900}


def vault(spark, edges):
    """Notes of a scope that no edge meets, so that edges inactivate nobody; edges are (newer, older, scope)."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    by = {n: [(b, s) for a, b, s in edges if a == n] for n in names}
    rows = spark.createDataFrame([(n, [{"target": b, "scope": s} for b, s in by[n]]) for n in names], "id string, r array<struct<target:string,scope:map<string,string>>>")
    rel = F.transform("r", lambda x: relation("supersedes", x.target, None, x.scope))
    return Graph(notes(rows, id=F.col("id"), scope=F.create_map(F.lit("own"), F.lit("yes")), relations=rel))


def brute_overtaken(edges, candidates):
    overlap = scope.overlap
    out = set()
    for dst, c, sc in candidates:
        todo = [(i, e) for i, e in enumerate(edges) if e[1] == c and overlap(e[2], sc)]
        seen = {i for i, _ in todo}
        while todo:
            _, (a, _, s) = todo.pop()
            if a == c:
                continue
            if any(d == dst and x == a for d, x, _ in candidates):
                out.add((dst, c))
            more = [(i, e) for i, e in enumerate(edges) if i not in seen and e[1] == a and overlap(e[2], sc) and overlap(e[2], s)]
            seen |= {i for i, _ in more}
            todo += more
    return out


def test_overtaken_over_many_ways(spark):
    """20 diamonds on each other: 2 ** 20 ways, 40 steps; and a scope that changes on the way."""
    off = {"own": "no"}
    edges = [("new", "old", off), ("x", "old", off)]
    for i in range(20):
        low, high = ("x" if i == 0 else f"n{i:02}"), ("new" if i == 19 else f"n{i + 1:02}")
        edges += [(f"l{i:02}", low, off), (f"r{i:02}", low, off), (high, f"l{i:02}", off), (high, f"r{i:02}", off)]
    g = vault(spark, edges)
    rows = [("old", "new", off), ("old", "x", off)]
    got = walks.overtaken(g, spark.createDataFrame(rows, "dst_path string, c string, c_scope map<string,string>"))
    assert [tuple(r) for r in got.collect()] == [("old", "x")] and brute_overtaken(edges, rows) == {("old", "x")}


def test_overtaken_by_scopes(spark):
    rng = random.Random(9)
    for _ in range(3):
        pick = lambda: {k: rng.choice("12") for k in rng.sample("abc", rng.randint(0, 2))} | {"own": "no"}
        names = [f"m{i}" for i in range(8)]
        edges = [(*rng.sample(names, 2), pick()) for _ in range(16)] + [(n, "base", pick()) for n in names[:5]] + [(n, "other", pick()) for n in names[3:7]]
        rows = [(d, c, s) for c, d, s in edges if d in ("base", "other")]
        got = walks.overtaken(vault(spark, edges), spark.createDataFrame(rows, "dst_path string, c string, c_scope map<string,string>"))
        assert {tuple(r) for r in got.collect()} == brute_overtaken(edges, rows)


def test_rows_of_circles_take_few_steps(spark, monkeypatch):
    """Rings that all lead to the next one, which each node at a branch prefers forwards and backwards: not a step for each ring; and
    stretches between two nodes of a component, of two and of none."""
    steps = []
    monkeypatch.setattr(strong, "saved", lambda df, own=strong.saved: (steps.append(1), own(df))[1])
    pairs = []
    for i in range(150):
        a, z, b = f"{999 - i}a", f"z{i:03}c", f"z{i:03}b"
        pairs += [(a, b), (b, z), (z, a), (a, f"{998 - i}a")]
    pairs += [("h0", "h1"), ("h1", "h2"), ("h2", "h0"), ("h0", "s1"), ("s1", "s2"), ("s2", "h2"), ("h1", "x1"), ("x1", "x2"), ("x2", "849a"), ("h0", "g0"), ("g0", "h0")]
    want = cyclic(pairs)
    got = {}
    for r in strong.strong_components(spark.createDataFrame(pairs, "s string, d string")).collect():
        got.setdefault(r.component, set()).add(r.node)
    assert got == want and len(want) == 151 and want["g0"] == {"g0", "h0", "h1", "h2", "s1", "s2"}
    assert len(steps) < 120


def dated(spark, rows):
    """Notes (id, first day, ids that it replaces) in a scope that no edge meets."""
    df = spark.createDataFrame(rows, "id string, day string, t array<string>")
    return Graph(notes(df, id=F.col("id"), valid_from=F.col("day"), scope=F.create_map(F.lit("own"), F.lit("yes")), relations=F.transform("t", lambda x: relation("supersedes", x, None, F.create_map(F.lit("own"), F.lit("no"))))))


def test_circles_are_looked_for_where_they_decide(spark, monkeypatch):
    given = []
    monkeypatch.setattr(walks, "strong_components", lambda e, own=walks.strong_components: (given.append(e.count()), own(e))[1])
    kinds = lambda rows: {r.path: (r.kind, r.next_path) for r in walks.steps(dated(spark, rows)).collect()}
    # of two successors one replaces the other: no circle can change that
    assert kinds([("a", "1", []), ("b", "2", ["a"]), ("c", "3", ["a", "b"])]) == {"a": ("next", "c"), "b": ("next", "c")} and given == []
    # two successors replace each other on one day: the three edges to earlier notes aren't looked at
    circle = [("a", "1", []), ("b", "2", ["a", "c"]), ("c", "2", ["a", "b"]), ("d", "3", ["b"])]
    assert kinds(circle)["a"] == ("supersession_cycle", None) and given == [2]
    # one of a later day is replaced by an earlier one, or by one without a day: all edges are
    for day in ("4", None):
        given.clear()
        assert kinds([("a", "1", []), ("b", day, ["a", "c"]), ("c", "2", ["a", "b"])])["a"] == ("supersession_cycle", None) and given == [4]
