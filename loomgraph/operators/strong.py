"""Strongly connected components of a distributed graph, and the order of their members. Joins and aggregates only.

Rounds shrink the graph until nothing is left. Nodes with one way in and one way out are bypassed, a whole stretch of them at once, and
those without a way in or out go. Each node chooses its smallest next one; of the walks over these choices, doubled until they settle,
those that turn show circles, which become one node each, and those that end without having had another choice are no part of any circle
and go, however long they were. The next round does the same against the edges. What these leave (graphs whose nodes have several ways
in and out) is coloured by the smallest node that reaches each node; the nodes that reach their colour's node in turn are its component.
Steps grow with the logarithm of unbranched stretches, also where these are rows of circles; colouring takes as many steps as the
shortest ways in the branched rest are long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.order import numbered
from loomgraph.session import Growing, saved


def id_edges(g: Graph) -> DataFrame:
    """Supersession as edges(s, d) of ids."""
    return g.of("supersedes").select(F.col("src_id").alias("s"), F.col("dst_id").alias("d"))


def _walked(edges: DataFrame) -> DataFrame:
    """(s, to, low, lone, on): where each node's walk over smallest next nodes has come to, the smallest node on it, whether no node of it
    had a choice, and whether it goes on for ever (else it has ended)."""
    pick = saved(edges.groupBy("s").agg(F.min("d").alias("to"), (F.count("*") == 1).alias("lone")))
    known = pick.select(F.col("s").alias("to"), F.lit(True).alias("on"))
    jump = saved(pick.join(known, "to", "left").select("s", "to", F.least("s", "to").alias("low"), "lone", F.coalesce("on", F.lit(False)).alias("on"), F.lit(True).alias("changed")))
    before = ends = None
    while True:
        now = jump.where("on").agg(F.count("*").alias("n"), F.count_if("changed").alias("changed")).first()
        if now.n == 0:
            return jump
        # no minimum fell and no walk ended, so what moves turns; if no end is left then either, all of them are on circles, and each minimum is its circle's
        if now.changed == 0 and now.n == before:
            last, ends = ends, jump.where("on").select("to").distinct().count()
            if ends == last:
                return jump
        else:
            ends = None
        before = now.n
        b = jump.select(F.col("s").alias("to"), F.col("to").alias("far"), F.col("low").alias("low2"), F.col("lone").alias("lone2"), F.col("on").alias("on2"))
        least = F.least("low", F.coalesce("low2", "low"))
        jump = saved(jump.join(b, "to", "left").select("s", F.coalesce("far", "to").alias("to"), least.alias("low"), (F.col("lone") & F.coalesce("lone2", F.lit(True))).alias("lone"), F.coalesce("on2", F.lit(False)).alias("on"), (least != F.col("low")).alias("changed")))


def _straightened(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges(s, d) in which an edge stands for each stretch of nodes with one way in and one way out, without nodes that lack either way;
    and inner(node, u, w): the nodes of the stretches, each with the nodes before and after its stretch.

    A node of a stretch is in the component that its two ends share, or in none. Circles of such nodes alone are left as they are.
    """
    both = edges.select(F.col("s").alias("node"), F.col("d").alias("w"), F.lit(None).cast("string").alias("u")).union(edges.select(F.col("d"), F.lit(None).cast("string"), F.col("s")))
    ways = saved(both.groupBy("node").agg(F.count("u").alias("n_in"), F.count("w").alias("n_out"), F.min("u").alias("u"), F.min("w").alias("w")))
    middle = ways.where("n_in = 1 and n_out = 1").select("node", "u", "w")
    more = middle.select(F.col("node").alias("w"), F.lit(True).alias("on"))
    on = F.coalesce("on", F.lit(False))
    jump, before = saved(middle.join(more, "w", "left").select("node", F.when(on, F.col("w")).otherwise(F.col("node")).alias("last"), on.alias("on"))), None
    # as many steps as the logarithm of the longest stretch; if a doubling ends none, what still moves are circles
    while (moving := jump.where("on").count()) not in (0, before):
        before = moving
        b = jump.select(F.col("node").alias("last"), F.col("last").alias("far"), F.col("on").alias("on2"))
        jump = saved(jump.join(b, "last").select("node", F.col("far").alias("last"), F.col("on2").alias("on")))
    ended = jump.where("not on").select("node", "last")
    first = middle.join(middle.select(F.col("node").alias("u")), "u", "left_anti").select("node", "u").join(ended, "node").select("last", "u")
    ends = saved(first.join(middle.select(F.col("node").alias("last"), "w"), "last"))
    inner = saved(ended.join(ends, "last").select("node", "u", "w"))
    gone = inner.select("node").union(ways.where("n_in = 0 or n_out = 0").select("node"))
    left = edges.union(ends.where("u <> w").select("u", "w"))
    for end in "sd":
        left = left.join(gone.withColumnRenamed("node", end), end, "left_anti")
    return saved(left.select("s", "d").distinct()), inner


def _bypassed(member: DataFrame | None, inner: DataFrame) -> DataFrame:
    """member(node, label) with the nodes of inner(node, u, w) whose ends have one label or are one node, and such nodes."""
    if member is None:
        found = inner.where("u = w").select("node", F.col("u").alias("label"), "u", F.lit(None).cast("string").alias("old"))
    else:
        of = lambda end: member.select(F.col("node").alias(end), F.col("label").alias(f"of_{end}"))
        label = F.when(F.col("u") == F.col("w"), F.coalesce("of_u", "u")).when(F.col("of_u") == F.col("of_w"), F.col("of_u"))
        found = inner.join(of("u"), "u", "left").join(of("w"), "w", "left").select("node", label.alias("label"), "u", F.col("of_u").alias("old")).where("label is not null")
    found = saved(found)
    out = found.select("node", "label").union(found.where("old is null").select(F.col("u"), "label").distinct())
    return saved(out if member is None else out.union(member))


def _renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """edges(s, d) with the nodes of names(node, to) called by their new name; edges within a node go."""
    for end in "sd":
        edges = edges.join(names.select(F.col("node").alias(end), F.col("to").alias(f"{end}2")), end, "left").withColumn(end, F.coalesce(f"{end}2", end))
    return edges.where("s <> d").select("s", "d").distinct()


def _coloured(edges: DataFrame) -> DataFrame:
    """names(node, to): the whole components of those nodes that no smaller node reaches, by that node."""
    nodes = saved(edges.select(F.col("s").alias("node")).union(edges.select(F.col("d").alias("node"))).distinct())
    colour = front = saved(nodes.withColumn("colour", F.col("node")))
    while not front.isEmpty():
        given = edges.join(front.select(F.col("node").alias("s"), "colour"), "s").groupBy(F.col("d").alias("node")).agg(F.min("colour").alias("new"))
        both = saved(colour.join(given, "node", "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("fell")))
        colour, front = both.select("node", "colour"), both.where("fell").select("node", "colour")
    own = edges.join(colour.select(F.col("node").alias("s"), F.col("colour").alias("a")), "s").join(colour.select(F.col("node").alias("d"), F.col("colour").alias("b")), "d")
    own = saved(own.where("a = b").select("s", "d"))
    back = Growing(colour.where("node = colour"))
    while not back.last().isEmpty():
        nxt = own.join(back.last().select(F.col("node").alias("d"), "colour"), "d").select(F.col("s").alias("node"), "colour").distinct()
        back.add(nxt.join(back.all().select("node"), "node", "left_anti"))
    return back.all().select("node", F.col("colour").alias("to"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the nodes of edges(s, d) that lie on a circle, with the smallest node of their component.

    A node with an edge to itself is a component. Repeated edges count once, null ends not at all; no edges give no rows.
    """
    every = saved(edges.select("s", "d").where("s is not null and d is not null").distinct())
    left, undo, turn = saved(every.where("s <> d")), [], 0
    while not left.isEmpty():
        turn += 1
        if turn % 5 in (1, 4):
            left, inner = _straightened(left)
            undo.append(("bypassed", inner))
        elif turn % 5 in (2, 3):
            jump = _walked(left)
            circle = jump.where("on").select(F.col("to").alias("s")).distinct()
            joined = saved(jump.join(circle, "s", "left_semi").select(F.col("s").alias("node"), F.col("low").alias("to")))
            undo.append(("joined", joined))
            gone = jump.where("not on and lone").select("s")
            left = left.join(gone, "s", "left_anti").join(gone.withColumnRenamed("s", "d"), "d", "left_anti").join(jump.select(F.col("s").alias("d")), "d", "left_semi")
            # the next round goes against the edges
            left = saved(_renamed(left.select("s", "d"), joined).select(F.col("d").alias("s"), F.col("s").alias("d")))
        else:
            whole = saved(_coloured(left))
            undo.append(("joined", whole))
            left = saved(left.join(whole.select(F.col("node").alias("s")), "s", "left_anti").join(whole.select(F.col("node").alias("d")), "d", "left_anti").select("s", "d"))
    member = None
    for how, n in reversed(undo):
        if n.isEmpty():
            continue
        if how == "bypassed":
            member = _bypassed(member, n)
            continue
        up = n.select("node", "to") if member is None else n.join(member.select(F.col("node").alias("to"), "label"), "to", "left").select("node", F.coalesce("label", "to").alias("to"))
        up = up.select("node", F.col("to").alias("label"))
        member = saved(up if member is None else up.union(member.join(up.select("node"), "node", "left_anti")))
    out = every.where("s = d").select(F.col("s").alias("node"), F.col("s").alias("component"))
    if member is not None:
        several = member.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1").select("label", "component")
        member = saved(member.join(several, "label").select("node", "component"))
        out = member.union(out.join(member.select("node"), "node", "left_anti"))
    return out.distinct()


def cycle_members(edges: DataFrame) -> DataFrame:
    """(component, pos, node): the members of each component in order, from the smallest on.

    From each the smallest next member follows, until one comes again; members that this walk leaves out follow by name. The walk
    doubles its length in each step, and places are found without bringing a component together.
    """
    part = saved(strong_components(edges))
    side = lambda end, c: part.select(F.col("node").alias(end), F.col("component").alias(c))
    inner = edges.select("s", "d").where("s <> d").join(side("s", "a"), "s").join(side("d", "b"), "d").where("a = b")
    jump = saved(inner.groupBy(F.col("s").alias("node")).agg(F.min("d").alias("to")))
    path, length = Growing(part.where("node = component").select("node", F.lit(0).cast("long").alias("pos"))), 1
    while True:
        ahead = path.all().join(jump, "node").groupBy(F.col("to").alias("node")).agg(F.min(F.col("pos") + length).alias("pos"))
        if path.add(ahead.join(path.all().select("node"), "node", "left_anti")).isEmpty():
            break
        jump, length = saved(jump.join(jump.select(F.col("node").alias("to"), F.col("to").alias("far")), "to").select("node", F.col("far").alias("to"))), length * 2
    rank = part.join(path.all().withColumnRenamed("pos", "walk"), "node", "left").withColumn("walk", F.coalesce("walk", F.lit((1 << 63) - 1)))
    return numbered(rank, "component", "walk", "node").select("component", "pos", "node")
