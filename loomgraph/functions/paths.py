"""Path algebra in POSIX form, as native expressions and, for single notes, in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Without ``.``, ``..`` and doubled separators; null where ``..`` leaves the root."""
    start = F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, p: Column) -> Column:
        to = lambda ok, parts: F.struct(ok.alias("ok"), parts.alias("parts"))
        up = F.when(F.size(a.parts) > 0, to(a.ok, F.slice(a.parts, 1, F.greatest(F.size(a.parts) - 1, F.lit(0))))).otherwise(to(F.lit(False), a.parts))
        return F.when((p == "") | (p == "."), a).when(p == "..", up).otherwise(to(a.ok, F.array_append(a.parts, p)))

    return F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), start, step, lambda a: F.when(a.ok, F.array_join(a.parts, "/")))


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def resolve(folder: Column, target: Column) -> Column:
    """``target`` as seen from ``folder``; a leading slash is the vault's root."""
    slashed = F.replace(target, F.lit("\\"), F.lit("/"))
    return normalize(F.when(slashed.startswith("/"), slashed).otherwise(F.concat(folder, F.lit("/"), slashed)))


def relative(folder: Column, path: Column) -> Column:
    """The way from ``folder`` to ``path``; ``./`` in front unless it begins by going up."""
    def way(a: Column, b: Column) -> Column:
        same = F.aggregate(F.zip_with(a, F.slice(b, 1, F.size(b) - 1), lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s.n + F.when(s.on & e, 1).otherwise(0)).alias("n"), (s.on & e).alias("on")), lambda s: s.n)
        ups = F.array_repeat(F.lit(".."), F.size(a) - same)
        rest = F.array_join(F.concat(ups, F.slice(b, same + 1, F.size(b) - same)), "/")
        return F.when(F.size(ups) > 0, rest).otherwise(F.concat(F.lit("./"), rest))

    return way(F.filter(F.split(folder, "/"), lambda x: x != ""), F.filter(F.split(path, "/"), lambda x: x != ""))


def slug(text: Column) -> Column:
    """Letters and digits of ASCII in lower case; runs of ``-``, ``_`` and white space become one ``-``; ``untitled`` if nothing is left."""
    kept = F.lower(F.regexp_replace(text, "[^A-Za-z0-9\\-_\\s]", ""))
    out = F.trim(F.regexp_replace(kept, "[-_\\s]+", "-"))
    out = F.regexp_replace(out, "^-+|-+$", "")
    return F.when(out == "", "untitled").otherwise(out)


def normalize_one(path: str) -> str | None:
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not parts:
                return None
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)


def folder_of(path: str) -> str:
    return path.rpartition("/")[0]


def resolve_one(folder: str, target: str) -> str | None:
    target = target.replace("\\", "/")
    return normalize_one(target if target.startswith("/") else f"{folder}/{target}")


def relative_one(folder: str, path: str) -> str:
    a, b = [x for x in folder.split("/") if x], [x for x in path.split("/") if x]
    n = 0
    while n < min(len(a), len(b) - 1) and a[n] == b[n]:
        n += 1
    ups = [".."] * (len(a) - n)
    return "/".join(ups + b[n:]) if ups else "./" + "/".join(b[n:])


def slug_one(text: str) -> str:
    out: list[str] = []
    for c in text:
        if c.isascii() and c.isalnum():
            out.append(c.lower())
        elif (c in "-_" or c.isspace()) and out and out[-1] != "-":
            out.append("-")
    return "".join(out).strip("-") or "untitled"
