"""Repair of conversations: the cheapest edits that make the roles follow a grammar, by dynamic programming in DuckDB.

A conversation must have the role initials ``(s?(ua)+)?``. Its rows stand by turn and are cut into segments of ``SEGMENT`` rows, which
are dealt by hash; a task gives its segments, some ten thousand rows at a time, to one recursive query. Each recursion advances one row
in all segments and keeps, for each state of the grammar, the least cost and of its audits the least in ASCII. A segment that isn't a
conversation's first is solved from each state, so segments are joined by the same recursion, 64 at a time, whatever the length of a
conversation. The repaired rows come from a scan of each conversation's rows behind its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import workers_find_us, written
from loomgraph.llm.manifest import group_key
from loomgraph.operators.order import numbered

SPACES = " \t\n\x0b\x0c\r"
#: Rows of a segment, segments joined at once, rows of one recursive query.
SEGMENT, FAN, AT_ONCE = 256, 64, 20_000
#: Costs of the edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States of the grammar: nothing yet, after the system's row, after a user's, after an assistant's. Conversations may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Where a row by the role that a state asks for leads to.
ONWARD = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ASKED = {USER: "user", ASSISTANT: "assistant"}


def _inserted(state: int) -> list[tuple[str, int, int]]:
    """(audit, cost, state) of no, one and two rows put in; more lead back to a state at a higher cost."""
    one = ONWARD[state]
    return [("", 0, state), ("I", INSERT, one), ("II", 2 * INSERT, ONWARD[one])]


def _moves() -> list[tuple[int, str, bool, bool, str, int, int]]:
    """(state, initial, truncated, must go, audit, cost, next state) of one row and what is put in behind it."""
    out = []
    for state in range(4):
        for initial in ("s", "u", "a", "-"):
            for short in (False, True):
                more = TRUNCATED * short
                stay = [("R", REROLE + more, ONWARD[state])]
                if (state, initial) in KEPT:
                    stay.append(("K", KEEP + more, KEPT[state, initial]))
                for must, edits in ((False, [*stay, ("D", DELETE, state)]), (True, [("D", DELETE, state)])):
                    out += [(state, initial, short, must, a + b, x + y, end) for a, x, to in edits for b, y, end in _inserted(to)]
    return out


#: ``item`` holds the rows of a segment (or the segments of a group) and ``step`` what each allows from each state; ``i`` counts items.
_WALK = """
with recursive walk(seg, src, state, i, best) using key (seg, src, state) as (
  select seg, src, state, 0, {'cost': cost, 'audit': audit} from begun
  union
  select w.seg, w.src, s.state_to, w.i + 1, min({'cost': w.best.cost + s.cost, 'audit': w.best.audit || s.audit})
  from walk w join item x on x.seg = w.seg and x.i = w.i join step s on s.kind = x.kind and s.state = w.state
  group by w.seg, w.src, s.state_to, w.i)
select seg, src, state as dst, best.cost as cost, best.audit as audit from walk join (select seg as own, count(*) as n from item group by seg) on own = seg where i = n
"""
_SOLVED = pa.schema([("key", pa.string()), ("seg", pa.int64()), ("n", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])
_SOLVED_DDL = "key string, seg long, n long, src int, dst int, cost long, audit string, illegal long"


def _database():
    import duckdb

    db = duckdb.connect()
    db.execute("set threads = 1; set memory_limit = '400MB'; set temp_directory = ''; set enable_progress_bar = false")
    return db


def _whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """A sorted stream in tables of about ``AT_ONCE`` rows that don't cut groups of equal ``by``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        for lo in range(0, b.num_rows, AT_ONCE):
            held.append(b.slice(lo, AT_ONCE))
            if sum(x.num_rows for x in held) >= AT_ONCE:
                t = pa.Table.from_batches(held).combine_chunks()
                last, cut = [t[c][-1] for c in by], t.num_rows
                while cut and all(t[c][cut - 1] == x for c, x in zip(by, last, strict=True)):
                    cut -= 1
                if cut:
                    yield t.slice(0, cut)
                    held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """What each segment costs from each state to each state; rows are (key, pos, n, initial, short, must)."""
    seg = F.floor(F.col("pos") / size)
    # a segment's last row is seen by the next one too, for the pair across the border
    border = (F.col("pos") % size == size - 1) & (F.col("pos") + 1 < F.col("n"))
    dealt = rows.withColumn("seg", F.explode(F.when(border, F.array(seg, seg + 1)).otherwise(F.array(seg)))).withColumn("i", F.col("pos") - F.col("seg") * size)
    stream = dealt.select("key", "seg", "n", "i", "initial", "short", "must").repartition("key", "seg").sortWithinPartitions("key", "seg", "i")
    moves = pa.table({k: list(v) for k, v in zip(("state", "initial", "short", "must", "audit", "cost", "state_to"), zip(*_moves(), strict=True), strict=True)})
    units = pa.table({"first": [True] * 3 + [False] * 4, "src": [START] * 3 + [0, 1, 2, 3], "state": [x[2] for x in _inserted(START)] + [0, 1, 2, 3], "cost": [x[1] for x in _inserted(START)] + [0] * 4, "audit": [x[0] for x in _inserted(START)] + [""] * 4})

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            db.register("moves", moves)
            db.register("units", units)
            db.execute("create table step as select *, initial || cast(short as int) || cast(must as int) as kind from moves")
            for t in _whole(batches, ("key", "seg")):
                db.register("given", t)
                db.execute("create or replace table own as select row_number() over () as seg, * from (select key, seg as no, any_value(n) as n from given group by key, seg)")
                db.execute("create or replace table every as select o.seg, g.i, g.initial, (case when g.initial in ('s', 'u', 'a') then g.initial else '-' end) || cast(g.short as int) || cast(g.must as int) as kind from given g join own o on o.key = g.key and o.no = g.seg")
                db.execute("create or replace table item as select seg, i, kind from every where i >= 0")
                db.execute("create or replace table begun as select o.seg, u.src, u.state, u.cost, u.audit from own o join units u on u.first = (o.no = 0)")
                db.execute(f"create or replace table solved as {_WALK}")
                out = db.sql("""
                  with pairs as (select seg, i, lag(initial) over (partition by seg order by i) || initial as two from every),
                  bad as (select seg, count(*) filter (two not in ('su', 'ua', 'au')) as illegal from pairs group by seg)
                  select key, no as seg, n, src, dst, cost, audit, illegal from solved join own using (seg) join bad using (seg)""").to_arrow_table()
                yield from out.cast(_SOLVED).to_batches()

    return stream.mapInArrow(solve, _SOLVED_DDL)


def _joined(segments: DataFrame, fan: int) -> DataFrame:
    """Groups of ``fan`` neighbouring segments, each solved as one."""
    stream = segments.withColumns({"group": F.floor(F.col("seg") / fan), "i": F.col("seg") % fan}).repartition("key", "group").sortWithinPartitions("key", "group", "i")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _database() as db:
            for t in _whole(batches, ("key", "group")):
                db.register("given", t)
                db.execute("create or replace table own as select row_number() over () as seg, * from (select key, \"group\" as no, any_value(n) as n, sum(illegal) as illegal from (select distinct key, \"group\", i, n, illegal from given) group by all)")
                db.execute("create or replace table step as select o.seg || ':' || i as kind, o.seg, i, src as state, dst as state_to, cost, audit from given g join own o on o.key = g.key and o.no = g.\"group\"")
                db.execute("create or replace table item as select distinct seg, i, kind from step")
                db.execute("create or replace table begun as select distinct seg, state as src, state, 0 as cost, '' as audit from step where i = 0")
                out = db.sql(f"select key, no as seg, n, src, dst, cost, audit, illegal from ({_WALK}) join own using (seg)").to_arrow_table()
                yield from out.cast(_SOLVED).to_batches()

    return stream.mapInArrow(solve, _SOLVED_DDL)


def _last(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))


def ordered(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(key, conv_id, turn, role, text, pos, n, fault): rows in their conversations by turn, role and text, nulls first, each with its
    first fault: blank, duplicate (role and text seen earlier), truncated (the last character ends no sentence) or none."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    flat = rows.select(group_key(F.col(conv_col)).alias("key"), F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    placed = numbered(flat, "key", "turn", "role", "text").withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(6), "text")})
    same = ["key", "role", "h1", "h2"]
    again = placed.groupBy(*same).agg(F.min("pos").alias("earliest"), F.count("*").alias("times")).where("times > 1").drop("times")
    last = _last(F.col("text"))
    fault = F.when(last == "", "blank").when(F.col("pos") > F.col("earliest"), "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    return placed.join(again, same, "left").select("key", "conv_id", "turn", "role", "text", "pos", "n", fault.alias("fault"))


def plans(rows: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """(key, cost, audit, illegal) of each conversation of ``ordered`` rows: the cheapest edits, of equal ones the least in ASCII (D
    delete, I insert, K keep, R rerole), and the number of neighbours whose roles may not follow each other."""
    workers_find_us(rows.sparkSession)
    marks = written(rows.select("key", "pos", "n", F.left("role", F.lit(1)).alias("initial"), F.coalesce(F.col("fault") == "truncated", F.lit(False)).alias("short"), F.coalesce(F.col("fault").isin("blank", "duplicate"), F.lit(False)).alias("must")))
    most, length = marks.agg(F.max("n")).first()[0] or 0, segment
    solved = _segments(marks, segment)
    while most > length:
        solved = written(solved)
        longer = F.col("n") > length
        solved, length = solved.where(~longer).union(_joined(solved.where(longer), fan)), length * fan
    best = solved.where(F.col("dst").isin(*ENDS)).groupBy("key").agg(F.min(F.struct("cost", "audit")).alias("best"), F.max("illegal").alias("illegal"))
    return best.select("key", "best.cost", "best.audit", "illegal")


def _edited(rows: Iterator[tuple[str, int, str, str, str]]) -> Iterator[tuple[str, int, str, str | None, str | None]]:
    """(key, place, edit, role, text) of sorted (key, pos, role, text, audit), the audit first; for each key first an edit of ""."""
    key, audit, at, place, state = None, "", 0, 0, START

    def put_in() -> Iterator[tuple]:
        nonlocal at, place, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, ONWARD[state]
            yield key, (place := place + 1) - 1, "I", ASKED[state], ""

    for k, pos, role, text, plan in rows:
        if pos < 0:
            yield from put_in()
            key, audit, at, place, state = k, plan, 0, 0, START
            yield key, -1, "", None, None
            continue
        yield from put_in()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        if edit == "R":
            state = ONWARD[state]
            role = ASKED[state]
        else:
            state = KEPT[state, role[:1]]
        yield key, place, edit, role, text
        place += 1
    yield from put_in()


def _streamed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Each conversation's audit before its rows, in one sorted stream for each task."""
    null = F.lit(None).cast("string")
    both = rows.select("key", "pos", "role", "text", null.alias("audit")).union(plan.select("key", F.lit(-1).cast("long"), null, null, "audit"))
    return both.repartition("key").sortWithinPartitions("key", "pos")


def _tuples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(lo, 1024).columns), strict=True)


def repaired(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, place, edit, role, text): the rows of each repaired conversation in order, put in ones with an empty text."""
    workers_find_us(rows.sparkSession)
    schema = pa.schema([("key", pa.string()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for x in _edited(_tuples(batches)):
            if x[2]:
                held.append(x)
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    return _streamed(rows, plan).mapInArrow(run, "key string, place long, edit string, role string, text string")


def digests(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(key, repaired_sha256): SHA-256 of the repaired rows as ``role:text``, joined by line ends; it is fed row by row."""
    workers_find_us(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[str, str]] = []
        key, sha = None, hashlib.sha256()
        rest = lambda: pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["key", "repaired_sha256"])
        for k, place, edit, role, text in _edited(_tuples(batches)):
            if not edit:
                if key is not None:
                    done.append((key, sha.hexdigest()))
                key, sha = k, hashlib.sha256()
                if len(done) >= 4096:
                    yield rest()
                    done = []
            else:
                sha.update(("\n" * (place > 0) + role + ":" + text).encode())
        if key is not None:
            done.append((key, sha.hexdigest()))
        yield rest()

    return _streamed(rows, plan).mapInArrow(run, "key string, repaired_sha256 string")


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment: int = SEGMENT, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Ordered rows with their faults, and a report on each conversation: (key, conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit).

    Rows stand by turn, then role and text, nulls first; null roles and texts count as one space. Each row keeps its role (K, free), is
    given the role that the grammar asks for (R, 3) or goes (D, 4; blank and duplicate rows must go); rows with an empty text may be put
    in anywhere (I, 3); a truncated row that stays costs 3 more. ``gaps`` are the numbers missing between the least and the greatest
    turn, nulls aside. Rows without a conversation id are one conversation. Repeated rows are duplicates. Other columns aren't read; no
    rows give no conversations.
    """
    placed = written(ordered(rows, conv_col, turn_col, role_col, text_col))
    plan = plans(placed, segment, fan)
    fault = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    turns = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    seen = placed.groupBy("key").agg(F.first("conv_id").alias("conv_id"), fault("blank"), fault("duplicate"), fault("truncated"))
    gaps = placed.groupBy("key").agg(turns.alias("gaps"))
    report = written(seen.join(gaps, "key").join(plan, "key"))
    return placed, report.select("key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
