"""The test tables presented as a graph of notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.schema import NODE_COLUMNS, RELATION, SCOPE


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(rows: DataFrame, **given) -> DataFrame:
    """Rows of ``schema.NODES`` from the columns given; ``id`` is also the path."""
    null = {c: F.lit(None).cast("string") for c in NODE_COLUMNS} | {"scope": F.create_map().cast(SCOPE), "relations": F.array().cast(f"array<{RELATION}>")}
    have = null | {"path": given["id"], "node_type": F.lit("Note"), "title": given["id"]} | given
    return rows.select(*(have[c].cast(f"array<{RELATION}>").alias(c) if c == "relations" else have[c].alias(c) for c in NODE_COLUMNS))


def relation(kind: str, target, evidence=None, scope=None):
    return F.struct(F.lit(kind).alias("type"), target.alias("target"), (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence"), (F.lit(None).cast(SCOPE) if scope is None else scope).alias("scope"))


def key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(src, dst): nation on region, customer and supplier on nation, order on customer, line on order."""
    t = lambda n: read(spark, sf_dir, n)
    parts = [
        t("nation").select(key("nation-", "n_nationkey").alias("src"), key("region-", "n_regionkey").alias("dst")),
        t("customer").select(key("customer-", "c_custkey").alias("src"), key("nation-", "c_nationkey").alias("dst")),
        t("supplier").select(key("supplier-", "s_suppkey").alias("src"), key("nation-", "s_nationkey").alias("dst")),
        t("orders").select(key("order-", "o_orderkey").alias("src"), key("customer-", "o_custkey").alias("dst")),
        t("lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("src"), key("order-", "l_orderkey").alias("dst")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_chain(spark: SparkSession, sf_dir: str, ties: bool = False) -> Graph:
    """Each order replaces the customer's one before it; with ``ties``, orders of one day all replace the last one before that day."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    w = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    if ties:
        before = F.max(F.struct("day", "o_orderkey")).over(Window.partitionBy("o_custkey").orderBy(F.unix_date(F.to_date("day"))).rangeBetween(Window.unboundedPreceding, -1)).o_orderkey
    else:
        before = F.lag("o_orderkey").over(w)
    rel = F.when(F.col("before").isNotNull(), F.array(relation("supersedes", key("order-", "before"), key("clerk-", "o_custkey")))).otherwise(F.array())
    return Graph(notes(o.withColumn("before", before), id=key("order-", "o_orderkey"), valid_from=F.col("day"), scope=F.create_map(F.lit("priority"), F.col("o_orderpriority"), F.lit("status"), F.col("o_orderstatus")), relations=rel))


def part_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(s, d): part k to part (k * k + 1) mod n."""
    p = read(spark, sf_dir, "part").select("p_partkey")
    n = p.agg(F.count("*").alias("n"))
    e = p.crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("k"), ((F.col("p_partkey") * F.col("p_partkey") + 1) % F.col("n")).alias("to"))
    return e.select(key("part-", "k").alias("s"), key("part-", "to").alias("d"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``foreign_keys``, and parts on two suppliers, lines on their part and supplier: many ways lead to a line."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    p = p.crossJoin(F.broadcast(read(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))))
    parts = p.select(key("part-", "k").alias("src"), F.explode(F.array(F.col("k") % F.col("n"), (F.col("k") * 7 + 1) % F.col("n"))).alias("to")).select("src", key("supplier-", "to").alias("dst"))
    name = F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    lines = read(spark, sf_dir, "lineitem").select(name.alias("src"), F.explode(F.array(key("part-", "l_partkey"), key("supplier-", "l_suppkey"))).alias("dst"))
    return foreign_keys(spark, sf_dir).unionByName(parts).unionByName(lines)


def order_terms(spark: SparkSession, sf_dir: str) -> Graph:
    """``order_chain`` with terms: every third order is valid for 60 days, every 23rd has no first day."""
    g = order_chain(spark, sf_dir)
    k = F.regexp_extract("id", "[0-9]+$", 0).cast("long")
    until = F.when(k % 3 == 0, F.date_format(F.date_add(F.to_date("valid_from"), 60), "yyyy-MM-dd"))
    return Graph(g.nodes.withColumn("valid_until", until).withColumn("valid_from", F.when(k % 23 != 0, F.col("valid_from"))))


def order_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, seed, as_of): each event asks for an order on a day some decades before its own; few ask for none or on no day."""
    e = read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    e = e.crossJoin(F.broadcast(read(spark, sf_dir, "orders").agg(F.count("*").alias("n"))))
    i = F.col("event_id")
    as_of = F.date_format(F.date_sub("day", (i * 13 % 2900 + 7900).cast("int")), "yyyy-MM-dd")
    return e.select("event_id", F.concat(F.lit("order-"), (i * 7 % (F.col("n") + 5)).cast("string")).alias("seed"), F.when(i % 97 == 0, "1998-6-1").when(i % 89 != 0, as_of).alias("as_of"))


def part_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges(s, d) over parts, counted from 0: every third is in one ring with chords, the next third a long tail into it, the rest rings of
    seven, each leading to the next."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    p = p.crossJoin(F.broadcast(p.agg(F.min("k").alias("low"), F.max("k").alias("n")))).select((F.col("k") - F.col("low")).alias("k"), (F.col("n") - F.col("low")).alias("n"))
    k, n = F.col("k"), F.col("n")
    first = F.floor(k / 21) * 21 + 2
    ring = F.array(F.when(k + 3 <= n, k + 3).otherwise(0), F.floor(k / 3) * 7 % (F.floor(n / 3) + 1) * 3)
    tail = F.array(F.when(k + 3 <= n, k + 3).otherwise(0))
    small = F.array(F.when((F.floor((k + 3) / 21) * 21 + 2 == first) & (k + 3 <= n), k + 3).otherwise(first), F.when((k == first) & (k + 21 <= n), k + 21))
    e = p.select("k", F.explode(F.when(k % 3 == 0, ring).when(k % 3 == 1, tail).otherwise(small)).alias("to")).where("to is not null")
    return e.select(key("part-", "k").alias("s"), key("part-", "to").alias("d"))


def rival_orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Orders of one year (but every third) all replace the customer's last order of the years before; within a year each also replaces a
    change of the order before it, which replaces that order. A change's scope is another than an order's, so it inactivates none."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("pr"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.year("o_orderdate").alias("y"))
    past = Window.partitionBy("c").orderBy("y").rangeBetween(Window.unboundedPreceding, -1)
    o = o.withColumns({"before": F.max(F.struct("day", "k")).over(past).k, "prev": F.lag("k").over(Window.partitionBy("c", "y").orderBy("day", "k"))})
    same, change = F.create_map(F.lit("priority"), F.col("pr")), F.create_map(F.lit("channel"), F.lit("change"), F.lit("priority"), F.col("pr"))
    some = lambda *r: F.filter(F.array(*r), lambda x: x.isNotNull())
    own = some(F.when(F.col("before").isNotNull() & (F.col("k") % 3 != 0), relation("supersedes", key("order-", "before"), None, same)), F.when(F.col("prev").isNotNull(), relation("supersedes", key("change-", "k"), None, same)))
    orders = notes(o, id=key("order-", "k"), valid_from=F.col("day"), scope=F.create_map(F.lit("channel"), F.lit("book"), F.lit("priority"), F.col("pr")), relations=own)
    changes = notes(o.where("prev is not null"), id=key("change-", "k"), valid_from=F.col("day"), scope=change, relations=F.array(relation("supersedes", key("order-", "prev"), None, change)))
    return Graph(orders.unionByName(changes))


def line_hubs(spark: SparkSession, sf_dir: str) -> Graph:
    """Lines of orders replace their part, in the scope of their return flag, of their status or of both, by turns; lines of an even order
    also replace the one hub. Some lines replace the part's next line, in a scope that inactivates none."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("st"))
    w = Window.partitionBy("p").orderBy("l_orderkey", "l_linenumber")
    name = F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    line = line.withColumn("id", name).withColumn("next", F.when(F.col("l_orderkey") % 10 == 0, F.lead("id").over(w)))
    flag, st = (F.lit("flag"), F.col("flag")), (F.lit("status"), F.col("st"))
    own = F.when(F.col("l_orderkey") % 3 == 0, F.create_map(*flag)).when(F.col("l_orderkey") % 3 == 1, F.create_map(*st)).otherwise(F.create_map(*flag, *st))
    kind = lambda x: F.create_map(F.lit("kind"), F.lit(x))
    rel = F.filter(F.array(relation("supersedes", key("part-", "p"), None, own), F.when(F.col("l_orderkey") % 2 == 0, relation("supersedes", F.lit("hub"), None, own)), F.when(F.col("next").isNotNull(), relation("supersedes", F.col("next"), None, kind("other")))), lambda x: x.isNotNull())
    lines = notes(line, id=F.col("id"), scope=kind("line"), relations=rel)
    rest = line.select(key("part-", "p").alias("id")).distinct().union(spark.createDataFrame([("hub",)], "id string"))
    return Graph(lines.unionByName(notes(rest, id=F.col("id"))))


LINK = 'href="/([^"/\\\\\\s]+)"'


def page_links(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages in a folder for each language, with the links of their HTML as relations, written in five ways; and notes for the linked
    words: by the word's length one that has it as id, one in the English folder, one in the root, by either extension, or none."""
    p = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("x"), F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1)).alias("lang"), F.regexp_extract_all("html", F.lit(LINK), 1).alias("words"))

    def link(w, i):
        form = (F.col("page_id") + i) % 5
        return relation("relates_to", F.when(form == 0, w).when(form == 1, F.concat(F.lit("./"), w)).when(form == 2, F.concat(F.lit("../"), w)).when(form == 3, F.concat(F.lit("/"), w, F.lit(".md"))).otherwise(F.concat(F.lit("../../"), w)))

    page = notes(p, id=key("page-", "page_id"), path=F.concat("lang", F.lit("/p"), F.col("page_id").cast("string"), F.lit(".md")), relations=F.transform("words", link))
    w = p.select(F.explode("words").alias("w")).distinct().withColumn("n", F.length("w") % 6)
    place = lambda when, before, ident, after: F.when(F.col("n").isin(*when), F.struct(F.concat(F.lit(ident), "w").alias("id"), F.concat(F.lit(before), "w", F.lit(after)).alias("path")))
    word = w.select(F.explode(F.array(place((0, 1), "notes/", "", ".md"), place((1, 2), "xen/", "en ", ".md"), place((2, 3), "", "root ", ".md"), place((4,), "", "long ", ".markdown"))).alias("x")).where("x is not null").select("x.*")
    return Graph(page.unionByName(notes(word, id=F.col("id"), path=F.col("path"))))


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, body): documents as notes, two of which share each name, with two lines of links to others by path, name or stem in any case,
    with anchors and texts, to none, and some between fences."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    d = d.crossJoin(F.broadcast(d.agg(F.floor((F.max("doc_id") + 2) / 2).alias("half"))))
    i, text = F.col("doc_id"), lambda c: c.cast("string")
    other = (i * 7 + 3) % F.col("half")
    name = F.when(i % 6 == 0, F.concat(F.lit("doc-"), text(other))).when(i % 6 == 1, F.concat(F.lit("DOC-"), text(other), F.lit("#Top"))).when(i % 6 == 2, F.concat(F.lit("Doc-"), text(other), F.lit(".MD"))).when(i % 6 == 3, F.concat("lang", F.lit("/doc-"), text(i % F.col("half"))))
    name = name.when(i % 6 == 4, F.concat(F.upper("lang"), F.lit("/doc-"), text(i % F.col("half")), F.lit(".md # b "))).otherwise(F.concat(F.lit("lost "), text(other)))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit("\nSee [["), name, F.lit("]], [[ #here | up ]] and [["), name, F.lit("|that one]]]\n  ~~~ x\n[[doc-1]] [[lost]]\n```\nNo [[end], no [link]; [[../up]]\r\n"))
    return d.select(F.concat("lang", F.lit("/doc-"), text(i % F.col("half")), F.when(i < F.col("half"), ".md").otherwise(".markdown")).alias("path"), body.alias("body"), "doc_id")


def edited_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, old, new): documents and what becomes of them: some lines go, some are quoted, and half of the texts get an end."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("old"))
    i = F.col("doc_id")
    lines = F.filter(F.transform(F.split("old", "\n", -1), lambda x, j: F.struct(x.alias("x"), ((i + j) % 7).alias("k"))), lambda y: y.k != 0)
    new = F.array_join(F.transform(lines, lambda y: F.when(y.k == 3, F.concat(F.lit("> "), y.x)).otherwise(y.x)), "\n")
    return d.select(key("doc-", "doc_id").alias("path"), "old", F.when(i % 2 == 0, F.concat(new, F.lit("\nThe end\n"))).otherwise(new).alias("new"), "doc_id")


def vault_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content): documents as files of notes in folders by language and source; every ninth lacks its front, every eleventh has a
    relation of a kind that is never declared."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id").cast("string")
    front = F.concat(F.lit("---\nid: doc-"), i, F.lit("\ntype: Note\ntitle: 'no "), i, F.lit("'\nscope: {lang: "), "lang", F.lit("}\nrelations:\n- type: "), F.when(F.col("doc_id") % 11 == 0, "required_by").otherwise("depends_on"), F.lit("\n  target: doc-0\n---\n"))
    return d.select(F.concat("lang", F.lit("/"), (F.col("doc_id") % 5).cast("string"), F.lit("/doc-"), i, F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".markdown")).alias("path"), F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("no front\n"), "text")).otherwise(F.concat(front, "text")).alias("content"))


def opinions(spark: SparkSession, sf_dir: str) -> Graph:
    """Labelled documents in the order of their ids within a language and source; a good one contradicts a toxic one after it."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(read(spark, sf_dir, "labels"), "doc_id")
    w = Window.partitionBy("lang", "source").orderBy("doc_id")
    d = d.withColumns({"to": F.lead("doc_id").over(w), "to_toxic": F.lead("toxic").over(w)})
    rel = F.when((F.col("quality") == 1) & (F.col("toxic") == 0) & (F.col("to_toxic") == 1), F.array(relation("contradicts", key("doc-", "to")))).otherwise(F.array())
    return Graph(notes(d, id=key("doc-", "doc_id"), scope=F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")), relations=rel, status=F.when(F.col("doc_id") % 7 == 0, "deprecated").otherwise("stable")))


def references(spark: SparkSession, sf_dir: str) -> Graph:
    """Each document depends on the document twice as far on; beyond the last there is none."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 2 + 1).alias("to"))
    return Graph(notes(d, id=key("doc-", "doc_id"), relations=F.array(relation("depends_on", key("doc-", "to")))))
