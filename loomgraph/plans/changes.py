"""Line diffs of many notes, and plans of them applied to a table of notes as a whole or not at all.

The diff is Myers' in linear space; what Spark deals out are the notes, and each is compared within its task. A plan is checked against
current hashes by a join, patched notes go into a staged table, and that takes the old one's place only if no action is refused.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.session import saved, workers_find_us

CONTEXT = 3
_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_NO_END = "\\ No newline at end of file\n"
#: Statuses of an action by which a plan is refused.
REFUSED = ("changed", "missing", "ambiguous", "broken")


def _meeting_point(a: list[int], b: list[int]) -> tuple[int, int]:
    """Where a shortest way from the begin and one from the end of two different lists meet."""
    n, m = len(a), len(b)
    ahead, back, gap = {1: 0}, {1: 0}, n - m
    for d in range((n + m + 1) // 2 + 1):
        for far, near, flip in ((ahead, back, False), (back, ahead, True)):
            for k in range(-d, d + 1, 2):
                x = far[k + 1] if k == -d or (k != d and far[k - 1] < far[k + 1]) else far[k - 1] + 1
                y = x - k
                while x < n and y < m and (a[n - 1 - x] == b[m - 1 - y] if flip else a[x] == b[y]):
                    x, y = x + 1, y + 1
                far[k] = x
                bound = d if flip else d - 1
                if (gap % 2 == 1) != flip and -bound <= gap - k <= bound and x + near.get(gap - k, -1) >= n:
                    return (n - x, m - y) if flip else (x, y)
    raise AssertionError("two ways always meet")


def changes(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(from, to, from, to) of each stretch of lines of ``old`` that a stretch of ``new`` stands for; a shortest script."""
    number: dict[str, int] = {}
    a, b = ([number.setdefault(x, len(number)) for x in lines] for lines in (old, new))
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        p, q, r, s = todo.pop()
        while p < q and r < s and a[p] == b[r]:
            p, r = p + 1, r + 1
        while p < q and r < s and a[q - 1] == b[s - 1]:
            q, s = q - 1, s - 1
        if p == q or r == s:
            if p < q or r < s:
                out.append((p, q, r, s))
            continue
        x, y = _meeting_point(a[p:q], b[r:s])
        todo += [(p + x, q, r + y, s), (p, p + x, r, r + y)]
    joined: list[tuple[int, int, int, int]] = []
    for c in out:
        if joined and joined[-1][1] == c[0] and joined[-1][3] == c[2]:
            c = (joined[-1][0], c[1], joined.pop()[2], c[3])
        joined.append(c)
    return joined


def unified(path: str, old: str, new: str) -> str:
    """A unified diff with three lines around each change; line ends belong to the lines, and one that is missing at the end is noted."""
    a, b = _lines(old), _lines(new)
    groups: list[list[tuple[int, int, int, int]]] = []
    for c in changes(a, b):
        if groups and c[0] - groups[-1][-1][1] <= 2 * CONTEXT:
            groups[-1].append(c)
        else:
            groups.append([c])
    out = [f"--- a/{path}\n+++ b/{path}\n"] if groups else []
    say = lambda sign, line: out.append(sign + (line if line.endswith("\n") else f"{line}\n{_NO_END}"))
    for g in groups:
        before = min(CONTEXT, g[0][0], g[0][2])
        p, r = g[0][0] - before, g[0][2] - before
        q = min(len(a), g[-1][1] + CONTEXT)
        s = g[-1][3] + q - g[-1][1]
        place = lambda lo, hi: f"{lo + (hi > lo)},{hi - lo}"
        out.append(f"@@ -{place(p, q)} +{place(r, s)} @@\n")
        at = p
        for w, x, y, z in g:
            for line in a[at:w]:
                say(" ", line)
            for line in a[w:x]:
                say("-", line)
            for line in b[y:z]:
                say("+", line)
            at = x
        for line in a[at:q]:
            say(" ", line)
    return "".join(out)


def _lines(text: str) -> list[str]:
    """Lines with their ends; only ``\\n`` ends a line."""
    return re.findall("[^\n]*\n|[^\n]+", text)


def patched(old: str, diff: str) -> str | None:
    """``old`` with a unified diff applied; nothing if the diff doesn't fit."""
    a, out, at, lines = _lines(old), [], 0, _lines(diff)
    i = 0
    while i < len(lines) and not lines[i].startswith("@@"):
        i += 1
    while i < len(lines):
        m = _HEAD.match(lines[i])
        if not m:
            return None
        n_old, n_new = (int(m[g]) if m[g] is not None else 1 for g in (2, 4))
        begin = int(m[1]) - (n_old > 0)
        if begin < at or begin > len(a):
            return None
        out += a[at:begin]
        at, i = begin, i + 1
        while n_old or n_new:
            if i >= len(lines):
                return None
            sign, line = lines[i][:1], lines[i][1:]
            i += 1
            if i < len(lines) and lines[i].startswith("\\"):
                line, i = line.removesuffix("\n"), i + 1
            if sign not in " +-" or (sign in " -" and (at >= len(a) or a[at] != line)):
                return None
            at += sign in " -"
            n_old -= sign in " -"
            n_new -= sign in " +"
            if sign in " +":
                out.append(line)
    return "".join(out + a[at:])


def planned(pairs: DataFrame) -> DataFrame:
    """(path, source_sha256, expected_new_sha256, diff) of pairs(path, old, new) whose texts differ; null texts count as empty."""
    workers_find_us(pairs.sparkSession)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    differ = pairs.select("path", text("old"), text("new")).where("old <> new")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                b = big.slice(lo, 256)
                path, old, new = (c.to_pylist() for c in b.columns)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([unified(p, x, y) for p, x, y in zip(path, old, new, strict=True)], pa.string()), b.column(1), b.column(2)], ["path", "diff", "old", "new"])

    out = differ.mapInArrow(run, "path string, diff string, old string, new string")
    return out.select("path", F.sha2("old", 256).alias("source_sha256"), F.sha2("new", 256).alias("expected_new_sha256"), "diff")


def checked(notes: DataFrame, actions: DataFrame) -> DataFrame:
    """(path, status, text): notes(path, text) with the actions of a plan, set against their current hashes.

    Status is modified (and ``text`` new), up_to_date (it has the expected hash), untouched (no action), or by which the plan is refused:
    changed (neither hash), missing (no such note), ambiguous (several actions for a note), broken (the diff doesn't give what was expected).
    """
    workers_find_us(notes.sparkSession)
    one = actions.select("path", F.struct("source_sha256", "expected_new_sha256", "diff").alias("a")).distinct().groupBy("path").agg(F.count("*").alias("n"), F.first("a").alias("a"))
    both = notes.select("path", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("here")).join(one, "path", "full")
    now = F.sha2("text", 256)
    status = F.when(F.col("n").isNull(), "untouched").when(F.col("here").isNull(), "missing").when(F.col("n") > 1, "ambiguous").when(now == F.col("a.source_sha256"), "modified").when(now == F.col("a.expected_new_sha256"), "up_to_date").otherwise("changed")
    told = both.select("path", status.alias("status"), "text", "a.diff", F.col("a.expected_new_sha256").alias("expected"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, status, text, diff, expected in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = patched(text, diff)
                good = new is not None and hashlib.sha256(new.encode()).hexdigest() == expected
                rows.append((path, status if good else "broken", new if good else text))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["path", "status", "text"])

    touched = told.where("status = 'modified'").mapInArrow(run, "path string, status string, text string")
    return touched.union(told.where("status <> 'modified'").select("path", "status", "text"))


def apply_plan(spark: SparkSession, table: str, actions: DataFrame, dry_run: bool = False) -> dict[str, int]:
    """Counts of modified and up_to_date notes of the Parquet table (path, text) in folder ``table``, after the plan was applied to it.

    A plan that is refused raises an error that names the least path, and nothing is written; nor is it in a dry run. Else the staged table
    takes the old one's place by two renames, and the old one goes afterwards.
    """
    staged = saved(checked(spark.read.parquet(table), actions))
    count = {r.status: r.n for r in staged.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if any(s in count for s in REFUSED):
        first = staged.where(F.col("status").isin(*REFUSED)).orderBy("path").first()
        raise ValueError(f"Plan refused, nothing was written: '{first.path}' is {first.status} ({sum(count.get(s, 0) for s in REFUSED)} in all)")
    done = {k: count.get(k, 0) for k in ("modified", "up_to_date")}
    if dry_run or not done["modified"]:
        return done
    mark = uuid.uuid4().hex
    to = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    table = table.rstrip("/")
    staged.select("path", "text").write.parquet(f"{table}.{mark}.new")
    files = to(table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for a, b in ((table, f"{table}.{mark}.old"), (f"{table}.{mark}.new", table)):
        if not files.rename(to(a), to(b)):
            raise OSError(f"'{a}' can't be renamed")
    files.delete(to(f"{table}.{mark}.old"), True)
    return done
