"""Wikilinks turned into Markdown links, for all notes at once: links meet files by name in one join, and only the lines that hold links
are written anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions import paths
from loomgraph.session import saved

LINK = "\\[\\[([^\\n]*?)\\]\\]"
FENCE = "^\\s*(```|~~~)"


def folded(name: Column) -> Column:
    """ASCII letters in lower case, nothing else changed."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def file_names(files: DataFrame) -> DataFrame:
    """(name, dst): what each file of files(path) may be called (its path, its path without ``.md``, its file's name with and without the
    extension, in any case of ASCII letters), and the least path of those that may be called so."""
    p, file = F.col("path"), F.regexp_extract("path", "([^/]*)$", 1)
    stem = F.when(file.rlike("^.+\\."), F.regexp_extract(file, "^(.+)\\.[^.]*$", 1)).otherwise(file)
    called = F.array(p, F.when(folded(p).endswith(".md"), F.left(p, F.length(p) - 3)), stem, file)
    return files.select(p, F.explode(F.transform(called, folded)).alias("name")).where("name is not null").groupBy("name").agg(F.min("path").alias("dst"))


def links_of(notes: DataFrame) -> DataFrame:
    """(path, no, line, at, inner): the wikilinks of notes(path, body), by the line's number and the link's place in it.

    Lines between two fences hold none. A link ends at the first ``]]`` of its line.
    """
    marked = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct(i.alias("no"), x.alias("line"), x.rlike(FENCE).alias("fence")))
    some = F.filter(marked, lambda x: x.fence | F.contains(x.line, F.lit("[[")))
    # what is carried on: the lines kept, and whether a fence is open
    start = F.struct(F.lit(False).alias("open"), F.array().cast("array<struct<no:int,line:string>>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        kept = F.when(x.fence | a.open, a.kept).otherwise(F.array_append(a.kept, F.struct(x.no.alias("no"), x.line.alias("line"))))
        return F.struct((a.open != x.fence).alias("open"), kept.alias("kept"))

    lines = notes.where(F.contains("body", F.lit("[["))).select("path", F.explode(F.aggregate(some, start, step, lambda a: a.kept)).alias("x"))
    return lines.select("path", "x.no", "x.line", F.posexplode(F.regexp_extract_all("x.line", F.lit(LINK), 1)).alias("at", "inner"))


def markdown_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """``links_of`` rows with ``link``: the Markdown link to the file of that name, as seen from the note; a name that no file has becomes
    ``./name.md``. What follows ``#`` stays, and so does what follows ``|`` as the text."""
    space = F.lit(" \t\n\x0b\x0c\r")
    trim = lambda c: F.btrim(c, space)
    before = lambda c, sign: F.regexp_extract(c, f"^([^{sign}]*)", 1)
    after = lambda c, sign: F.regexp_extract(c, f"^[^{sign}]*[{sign}](.*)$", 1)
    inner = trim(F.col("inner"))
    target = trim(before(inner, "|"))
    said = F.when(F.contains(inner, F.lit("|")), trim(after(inner, "|"))).otherwise(target)
    base, anchor = F.replace(trim(before(target, "#")), F.lit("\\"), F.lit("/")), trim(after(target, "#"))
    named = links.select("*", said.alias("said"), base.alias("base"), F.when(anchor != "", F.concat(F.lit("#"), anchor)).otherwise("").alias("anchor"), folded(base).alias("name"))
    met = named.join(file_names(files), "name", "left")
    ended = F.when(F.col("base").endswith(".md") | F.col("base").endswith(".markdown"), F.col("base")).otherwise(F.concat("base", F.lit(".md")))
    unknown = F.when(ended.startswith("./") | ended.startswith("../"), ended).otherwise(F.concat(F.lit("./"), ended))
    to = F.when(F.col("base") == "", F.lit("")).when(F.col("dst").isNotNull(), paths.relative(paths.directory(F.col("path")), F.col("dst"))).otherwise(unknown)
    return met.select("path", "no", "line", "at", "inner", "dst", F.concat(F.lit("["), "said", F.lit("]("), to, "anchor", F.lit(")")).alias("link"))


def rewritten(notes: DataFrame) -> DataFrame:
    """(path, body, n_links, n_known): the notes of notes(path, body) that hold wikilinks, with Markdown links in their place.

    Line ends stay. Notes without links aren't returned; null bodies have none; each path is one note.
    """
    links = saved(markdown_links(links_of(notes), notes))
    lines = links.groupBy("path", "no").agg(F.first("line").alias("line"), F.array_sort(F.collect_list(F.struct("at", "link"))).alias("new"), F.count("*").alias("links"), F.count("dst").alias("known"))
    rest = F.split("line", LINK, -1)
    joined = F.concat(F.get(rest, F.lit(0)), F.array_join(F.transform("new", lambda x, i: F.concat(x.link, F.get(rest, i + 1))), ""))
    new = lines.select("path", "no", joined.alias("new"), "links", "known")
    every = notes.join(new.select("path").distinct(), "path", "left_semi").select("path", F.posexplode(F.split("body", "\n", -1)).alias("no", "old")).join(new, ["path", "no"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("new", "old").alias("line")))), lambda x: x.line), "\n")
    return every.groupBy("path").agg(text.alias("body"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_known"))
