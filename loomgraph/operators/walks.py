"""Following replacements for all notes at once: current guidance, lineage and what was valid on a date.

For a given scope, what happens at a note depends on the note alone, so a table of single steps is built by joins and
aggregates, and walks over it double their length each round: the number of rounds is the logarithm of the longest
chain, whatever the number of seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import scope as sc
from loomgraph.operators.graph import Graph
from loomgraph.operators.strong import id_edges, strong_components
from loomgraph.session import Growing, broadcast_if_small, saved


def matching(g: Graph, scope: dict[str, str]) -> DataFrame:
    """Supersession edges with ``hit``: whether the edge's scope agrees with the asked one."""
    return g.of("supersedes").withColumn("hit", sc.overlaps(sc.literal(scope), F.col("eff_scope")))


def overtaken(g: Graph, rivals: DataFrame) -> DataFrame:
    """(dst_path, c): candidates that another candidate of the same note supersedes, directly or over others.

    ``rivals`` is (dst_path, c, c_scope). Each edge's scope must overlap the candidate's and that of the edge before. The search goes
    back from each candidate over states (candidate, scope, edge): what may come before an edge depends on that edge alone, so each state
    counts once, however many ways lead to it, and notes with many candidates cost their edges, not their pairs. A walk may meet a
    note again. It ends for a candidate that is overtaken at all its notes.
    """
    edges = saved(g.of("supersedes").select(F.monotonically_increasing_id().alias("edge"), F.col("src_path").alias("s"), F.col("dst_path").alias("d"), F.col("eff_scope").alias("e")))
    # who is the only candidate of a note has nobody to be overtaken by
    several = rivals.groupBy("dst_path").agg((F.min("c") < F.max("c")).alias("several")).where("several").select("dst_path")
    rivals = saved(rivals.join(several, "dst_path", "left_semi").withColumn("sig", sc.signature(F.col("c_scope"))))
    goals = rivals.select("c", "sig", "c_scope").dropDuplicates(["c", "sig"])
    state = ["c", "sig", "c_scope", "edge", "at", "e"]
    meets = lambda *more: [sc.overlaps(F.col("e"), F.col("c_scope")), *more]

    def wanted(rows: DataFrame, *more: Column) -> DataFrame:
        for m in meets(*more):
            rows = rows.where(m)
        return rows.select("c", "sig", "c_scope", "edge", F.col("s").alias("at"), "e").where("at <> c").dropDuplicates(["c", "sig", "edge"])

    front = wanted(goals.join(edges, F.col("c") == F.col("d")))
    seen = Growing(front.select(*state))
    rival = rivals.select("dst_path", F.col("c").alias("at"))

    def reached(front: DataFrame) -> DataFrame:
        return rivals.select("dst_path", "c", "sig").join(front.select("c", "sig", "at"), ["c", "sig"]).join(rival, ["dst_path", "at"], "left_semi").select("dst_path", "c", "sig").distinct()

    found = Growing(reached(seen.last()))
    while not seen.last().isEmpty():
        unfound = rivals.join(found.all(), ["dst_path", "c", "sig"], "left_anti").select("c", "sig").distinct()
        front = seen.last().join(unfound, ["c", "sig"], "left_semi").select("c", "sig", "c_scope", "at", F.col("e").alias("after"))
        nxt = wanted(front.join(edges, F.col("at") == F.col("d")).drop("at"), sc.overlaps(F.col("e"), F.col("after")))
        found.add(reached(seen.add(nxt.join(seen.all().select("c", "sig", "edge"), ["c", "sig", "edge"], "left_anti"))).join(found.all(), ["dst_path", "c", "sig"], "left_anti"))
    return found.all().select("dst_path", "c").distinct()


def candidates(g: Graph, scope: dict[str, str] | None = None) -> DataFrame:
    """(dst_path, c, src_id, c_scope, live): the successors of each note in scope, and whether they are active."""
    hits = matching(g, scope or {}).where("hit").select("dst_path", F.col("src_path").alias("c"), "src_id", F.col("eff_scope").alias("c_scope"))
    live = g.active.select(F.col("path").alias("c"), F.lit(True).alias("live"))
    return saved(hits.join(live, "c", "left").withColumn("live", F.coalesce("live", F.lit(False))))


def turning_ids(g: Graph, asked: DataFrame) -> DataFrame:
    """(src_id): ids on a circle of supersession, of all notes or at least those in asked(src_id).

    Where no note supersedes one that is later than itself, a circle's notes are all of one day, so only edges within a day are looked at.
    """
    if asked.isEmpty():
        return asked.select("src_id")
    day = saved(g.bare.groupBy("id").agg(F.max("valid_from").alias("day")))
    of = lambda end, name: day.select(F.col("id").alias(end), F.col("day").alias(name))
    edges = saved(id_edges(g).join(of("s", "own"), "s").join(of("d", "other"), "d"))
    if edges.where("not coalesce(other <= own, false)").isEmpty():
        edges = edges.where("own = other")
    return strong_components(edges.select("s", "d")).select(F.col("node").alias("src_id"))


def steps(g: Graph, scope: dict[str, str] | None = None) -> DataFrame:
    """(path, kind, next_path, candidates): what comes after each note that has a successor in scope.

    kind: next, competing_successors, supersession_cycle or superseded_without_active_successor.
    """
    hits = candidates(g, scope)
    count = hits.groupBy("dst_path").agg(F.count("*").alias("n"), F.count_if("live").alias("n_live"), F.min("c").alias("only"), F.array_sort(F.collect_list("src_id")).alias("all_ids"), F.array_sort(F.collect_list(F.when(F.col("live"), F.col("src_id")))).alias("live_ids"))
    many = count.where("n > 1").select("dst_path")
    if many.isEmpty():
        return count.select(F.col("dst_path").alias("path"), F.lit("next").alias("kind"), F.col("only").alias("next_path"), F.array().cast("array<string>").alias("candidates"))
    rivals = hits.where("live").join(many, "dst_path", "left_semi")
    lost = overtaken(g, rivals.select("dst_path", "c", "c_scope").dropDuplicates(["dst_path", "c"]))
    left = rivals.join(lost, ["dst_path", "c"], "left_anti").groupBy("dst_path").agg(F.count("*").alias("n_left"), F.min("c").alias("one"), F.array_sort(F.collect_list("src_id")).alias("left_ids"))
    t = saved(count.join(left, "dst_path", "left"))
    # circles only matter where several successors are known and none of them is left
    open_hits = hits.join(t.where("n > 1 and n_left is null").select("dst_path"), "dst_path", "left_semi").select("dst_path", "src_id")
    turning = turning_ids(g, open_hits)
    turning = open_hits.join(turning, "src_id", "left_semi").select("dst_path").distinct().withColumn("turns", F.lit(True))
    t = t.join(turning, "dst_path", "left")
    n_left = F.coalesce("n_left", F.lit(0))
    kind = F.when((F.col("n") == 1) | (n_left == 1), "next").when(n_left > 1, "competing_successors").when(F.col("turns"), "supersession_cycle").when(F.col("n_live") > 0, "competing_successors").otherwise("superseded_without_active_successor")
    cand = F.when(n_left > 1, F.col("left_ids")).when(F.col("turns"), F.col("all_ids")).when(F.col("n_live") > 0, F.col("live_ids")).otherwise(F.col("all_ids"))
    return t.select(F.col("dst_path").alias("path"), kind.alias("kind"), F.when(F.col("n") == 1, F.col("only")).when(n_left == 1, F.col("one")).alias("next_path"), F.when(kind != "next", cand).otherwise(F.array().cast("array<string>")).alias("candidates"))


def doubled(nodes: DataFrame, following: DataFrame) -> DataFrame:
    """(path, last, hops, turns): where the walk over ``following(path, next)`` from each of ``nodes(path)`` ends.

    ``turns`` is true for walks that go in a circle; their ``last`` and ``hops`` mean nothing. Of a walk that ends after n
    steps, each later part is a walk too. So if a round ends no walk, none ends between its length and twice that, hence
    none beyond: all that still move are circles.
    """
    jump = saved(following.select("path", F.col("next").alias("to"), F.lit(1).cast("long").alias("n")))
    at = nodes.select("path").join(following, "path", "left").select("path", F.coalesce("next", "path").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    at, before = saved(at), jump.count()
    while True:
        # `at` has gone as many steps as `jump` strides, or to its end; `jump` has a row for each note with a next one
        ends = jump.select(F.col("path").alias("last"), "to", "n")
        moving = jump.join(following.select(F.col("path").alias("to")), "to", "left_semi").count()
        if moving in (0, before):
            break
        before = moving
        at = saved(at.join(ends, "last", "left").select("path", F.coalesce("to", "last").alias("last"), (F.col("hops") + F.coalesce("n", F.lit(0))).alias("hops")))
        b = jump.select(F.col("path").alias("to"), F.col("to").alias("far"), F.col("n").alias("m"))
        jump = saved(jump.join(b, "to", "left").select("path", F.coalesce("far", "to").alias("to"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")))
    still = following.select(F.col("path").alias("last"), F.lit(True).alias("turns"))
    return at.join(still, "last", "left").select("path", "last", "hops", F.coalesce("turns", F.lit(False)).alias("turns"))


def contradicted(g: Graph, scope: dict[str, str] | None = None) -> DataFrame:
    """(path, other_id): for notes that an active note contradicts in scope, the smallest id of those."""
    asked, e = sc.literal(scope or {}), g.of("contradicts").where("src_path <> dst_path")
    out = e.select(F.col("src_path").alias("path"), F.col("dst_path").alias("other"), F.col("dst_id").alias("other_id"), F.col("eff_scope").alias("a"), F.col("dst_scope").alias("b"))
    into = e.select(F.col("dst_path").alias("path"), F.col("src_path").alias("other"), F.col("src_id").alias("other_id"), F.col("dst_scope").alias("a"), F.col("eff_scope").alias("b"))
    both = out.unionByName(into).join(g.active.withColumnRenamed("path", "other"), "other", "left_semi")
    both = both.where(sc.overlaps(F.col("a"), F.col("b")) & sc.overlaps(asked, F.col("a")) & sc.overlaps(asked, F.col("b")))
    return both.groupBy("path").agg(F.min("other_id").alias("other_id"))


def advisories(g: Graph, scope: dict[str, str]) -> DataFrame:
    """(path, advisory): successors of each note in scopes other than the asked one."""
    e = matching(g, scope).where(~F.col("hit"))
    return e.select(F.col("dst_path").alias("path"), F.concat(F.lit("A successor exists in another scope: '"), F.col("src_id"), F.lit("' (scope: ["), sc.text(F.col("eff_scope")), F.lit("])")).alias("advisory")).distinct()


def current(g: Graph, scope: dict[str, str] | None = None) -> DataFrame:
    """(seed, path, status, conflict, active_guidance_id, hops) for every note as a seed."""
    table = saved(steps(g, scope))
    walk = doubled(g.bare, table.where("kind = 'next'").select("path", F.col("next_path").alias("next")))
    names = g.bare.select(F.col("path").alias("last"), F.col("id").alias("last_id"))
    ends = table.where("kind <> 'next'").select(F.col("path").alias("last"), F.col("kind").alias("conflict"))
    against = contradicted(g, scope).select(F.col("path").alias("last"), "other_id")
    warned = advisories(g, scope or {}).select("path").distinct().withColumn("warned", F.lit(True))
    t = walk.join(names, "last").join(ends, "last", "left").join(against, "last", "left").join(warned, "path", "left").join(g.bare.select("path", F.col("id").alias("seed")), "path")
    conflict = F.when(F.col("turns"), "supersession_cycle").when(F.col("conflict").isNotNull(), F.col("conflict")).when(F.col("other_id").isNotNull(), "contradiction")
    status = F.when(conflict.isNotNull(), "unresolved_conflict").when((F.col("hops") == 0) & F.coalesce("warned", F.lit(False)), "current_in_scope").when(F.col("hops") == 0, "current").otherwise("superseded")
    return t.select("seed", "path", status.alias("status"), conflict.alias("conflict"), F.when(conflict.isNull(), F.col("last_id")).alias("active_guidance_id"), F.when(~F.col("turns"), F.col("hops")).alias("hops"))


def chains(g: Graph, scope: dict[str, str] | None = None) -> DataFrame:
    """(root, pos, path, id, adopted_evidence, superseding_evidence, previous, next, error) of every replacement chain.

    A walk goes back while exactly one predecessor matches; a note with several matching successors, or a circle, is an error.
    """
    asked = sc.literal(scope or {})
    e = g.of("supersedes")
    hits = e.where(sc.overlaps(asked, F.col("eff_scope")))
    forks = hits.groupBy("dst_path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("dst_path").alias("path"))
    # backwards, an absent scope is that of the predecessor
    back = e.where(sc.overlaps(asked, F.coalesce("rel_scope", "dst_scope"))).groupBy(F.col("src_path").alias("path")).agg(F.count("*").alias("n"), F.min("dst_path").alias("next"), F.min("evidence").alias("evidence")).where("n = 1")
    back = saved(back.select("path", "next", "evidence"))
    walk = doubled(g.bare, back.select("path", "next"))
    t = walk.join(g.bare.select("path", "id", "title", "valid_from", "valid_until"), "path").join(back.select("path", "evidence"), "path", "left").join(forks.withColumn("fork", F.lit(True)), "path", "left")
    w = Window.partitionBy("last").orderBy("hops", "id")
    bad = F.max(F.when(F.col("turns"), "SupersessionCycle").when(F.col("fork"), "UnresolvedConflict")).over(Window.partitionBy("last"))
    return t.select(F.col("last").alias("root"), F.col("hops").alias("pos"), "path", "id", "title", "valid_from", "valid_until", F.col("evidence").alias("adopted_evidence"), F.lead("evidence").over(w).alias("superseding_evidence"), F.lag("id").over(w).alias("previous"), F.lead("id").over(w).alias("next"), bad.alias("error"))


def historical(g: Graph, as_of: str, scope: dict[str, str] | None = None) -> DataFrame:
    """(root, status, active_guidance_id) of every chain on a date; dates are compared as text."""
    w = Window.partitionBy("root").orderBy("pos", "id")
    c = chains(g, scope).withColumns({"after": F.lead("valid_from").over(w), "has_after": F.lead("id").over(w).isNotNull()})
    day, started = F.lit(as_of), F.col("valid_from").isNotNull() & (F.col("valid_from") <= F.lit(as_of))
    live = started & (F.col("after").isNull() | (day < F.col("after"))) & (F.col("valid_until").isNull() | (day <= F.col("valid_until")))
    vague = F.col("valid_from").isNull() | (F.col("has_after") & F.col("after").isNull())
    a = c.groupBy("root").agg(F.max("error").alias("error"), F.min("valid_from").alias("first"), F.min_by(F.coalesce("valid_from", F.lit("")), "pos").alias("root_from"), F.count_if(live).alias("n_live"), F.max(F.when(live, F.col("id"))).alias("one"), F.count_if(started & (day > F.col("valid_until"))).alias("n_over"), F.count_if(vague).alias("n_vague"))
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("first").isNull(), "indeterminate").when((day < F.col("first")) & (F.col("root_from") == ""), "indeterminate").when(day < F.col("first"), "not_yet_valid").when(F.col("n_live") > 1, "UnresolvedConflict").when(F.col("n_live") == 1, "active").when(F.col("n_over") > 0, "expired").when(F.col("n_vague") > 0, "indeterminate").otherwise("no_active_guidance")
    return a.select("root", status.alias("status"), F.when(status == "active", F.col("one")).alias("active_guidance_id"))


def impact(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth, trail): what depends on each of seeds(node), over ``edges(src, dst)``, each once and by the way on which a
    breadth-first search from that seed finds it.

    A node counts at its least depth, found by the dependency that was itself found first; among what one finds, ids decide. So the rows
    of a level are in the order of their finder's place and their own id, and the finder is the one with the least place. Only nodes
    that others depend on are put in order and carry their trail; the rest, mostly the bulk, hold their finder's place alone, and get
    their trails from it by one join at the end.
    """
    # joined by a hash first, then by name: names that begin alike are slow to sort
    by_hash = lambda df, c: df.withColumn("h", F.xxhash64(c))
    needed = by_hash(edges.select(F.col("dst").alias("src")).distinct(), "src").withColumn("inner", F.lit(True))
    edges = by_hash(edges.select("src", "dst"), "src").join(needed, ["h", "src"], "left").select("src", "dst", F.coalesce("inner", F.lit(False)).alias("inner"))
    edges = by_hash(saved(edges), "dst")  # read in every round
    first = saved(seeds.select(F.col("node").alias("seed"), "node").distinct())
    found = Growing(first.select("seed", "node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("by"), F.lit(True).alias("inner")))
    front = Growing(first.select("seed", "node", F.lit(0).alias("depth"), F.monotonically_increasing_id().alias("place"), F.array("node").alias("trail")))
    depth = 0
    while n := front.last().count():
        depth += 1
        start = by_hash(front.last().select("seed", F.col("node").alias("dst"), "place"), "dst")
        nxt = edges.join(broadcast_if_small(start, n), ["h", "dst"]).select("seed", F.col("src").alias("node"), F.col("place").alias("by"), "inner")
        # what was found before comes first, and goes
        nxt = nxt.union(found.all().select("seed", "node", F.lit(-1).cast("long"), F.lit(False)))
        nxt = nxt.groupBy("seed", "node").agg(F.min("by").alias("by"), F.bool_or("inner").alias("inner")).where("by >= 0").withColumn("depth", F.lit(depth))
        nxt = found.add(nxt).where("inner").join(front.last().select(F.col("place").alias("by"), "trail"), "by")
        nxt = saved(nxt.withColumn("trail", F.array_append("trail", F.col("node"))))
        # sorted rows lie in ascending partitions, so the number ascends with them
        front.add(nxt.orderBy("by", "node").withColumn("place", F.monotonically_increasing_id()))
    finder = front.all().select((F.col("depth") + 1).alias("depth"), F.col("place").alias("by"), "trail")
    return found.all().where("depth > 0").join(finder, ["by", "depth"]).select("seed", "node", "depth", F.array_append("trail", F.col("node")).alias("trail"))
