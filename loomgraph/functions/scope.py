"""Scopes are maps of strings; an empty one is global. All predicates are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(scope: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in sorted(scope.items()) for x in kv]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def overlaps(a: Column, b: Column) -> Column:
    """No key that both have disagrees."""
    return F.forall(F.map_keys(a), lambda k: b[k].isNull() | (b[k] == a[k]))


def covers(wide: Column, narrow: Column) -> Column:
    """Every entry of ``wide`` is an entry of ``narrow``."""
    return F.forall(F.map_keys(wide), lambda k: F.coalesce(narrow[k] == wide[k], F.lit(False)))


def signature(scope: Column) -> Column:
    """A text that is equal for equal scopes; maps themselves can't be grouped or joined."""
    return F.to_json(F.array_sort(F.map_entries(scope)))


def text(scope: Column) -> Column:
    """``k=v, k=v``, by key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(scope)), lambda e: F.concat(e.key, F.lit("="), e.value)), ", ")


def quoted(scope: Column) -> Column:
    """``{"k": "v"}``, by key."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(scope)), lambda e: F.concat(F.lit('"'), e.key, F.lit('": "'), e.value, F.lit('"'))), ", "), F.lit("}"))


def parse_arguments(given: list[str]) -> dict[str, str]:
    """``k=v`` arguments, each perhaps a comma list; the last value of a key counts."""
    out: dict[str, str] = {}
    for part in (p.strip() for arg in given for p in arg.split(",")):
        if not part:
            continue
        key, sign, value = part.partition("=")
        if not sign:
            raise ValueError(f"Invalid scope format '{part}'. Expected KEY=VALUE")
        if not key.strip() or not value.strip():
            raise ValueError(f"Invalid scope pair '{part}': key and value cannot be empty")
        out[key.strip()] = value.strip()
    return out


def overlap(a: dict[str, str], b: dict[str, str]) -> bool:
    """The same predicate for scopes on the driver."""
    return all(b.get(k, v) == v for k, v in a.items())
