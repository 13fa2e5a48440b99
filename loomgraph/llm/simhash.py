"""Near copies by 64-bit SimHash fingerprints, joined in a binary trie.

Fingerprints: one bit per position, set if over half of the hashes of the text's word shingles have it. Texts with
the same fingerprint are one class. Classes meet in a binary trie that is traversed with pairs of nodes: a pair
carries the number of bits in which the two paths differ and is dropped when that exceeds the budget.

To deal the traversal out over a cluster, the 64 bits are cut into ``budget + 1`` blocks and there is one trie for
each block put first (the others follow in ring order). If two fingerprints differ in at most ``budget`` bits, then
in at least one of these tries the paths differ, after each l blocks, in at most l * budget / (budget + 1) bits
(cycle lemma), so each trie uses this growing budget: the first block must agree, and the node reached by it is a unit
of work. Nodes with more than ``leaf`` members are opened into pairs of their children, level by level, only along
bits that vary among their members; no task ever gets a larger node than ``leaf``, however many near copies there are.
Each task returns a spanning forest of the links it found, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import batch, broadcast_if_small, find, unite, workers_find_us, written
from loomgraph.llm.components import components

BITS = 64


def fingerprint(text: str | None, ngram: int = 4, seed: int = 42) -> int:
    """SimHash of one text; null or wordless: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= ngram:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    starts = [0, *(e + 1 for e in ends)]
    digest, n, counts = xxhash.xxh64_intdigest, len(words) - ngram + 1, np.zeros(BITS, np.int64)
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[lo:hi], ends[lo + ngram - 1 : hi + ngram - 1], strict=True)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * c > n else "0" for c in counts.tolist()), 2)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, seed: int = 42, *more: str) -> DataFrame:
    """(id, fp): one row per row of ``docs``; ``fp`` is the fingerprint's 64 bits as a signed long. ``more`` longs are handed on."""
    workers_find_us(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), *((c, pa.int64()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), ngram, seed) for t in b.column(1)], dtype=np.uint64)
            yield batch(schema, id=b.column(0), fp=fp.view(np.int64), **{c: b.column(2 + i) for i, c in enumerate(more)})

    out = ", ".join(f"{f.name} long" for f in schema)
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *more).mapInArrow(run, out)


def _blocks(budget: int) -> list[int]:
    m = budget + 1
    return [BITS // m + (i < BITS % m) for i in range(m)]


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def _limits(budget: int) -> np.ndarray:
    """[rotation, bits passed]: differing bits allowed once that many bits have been compared."""
    sizes, m = _blocks(budget), budget + 1
    out = np.zeros((m, BITS + 1), np.int64)
    for r in range(m):
        ends = np.cumsum(sizes[r:] + sizes[:r])
        for d in range(1, BITS + 1):
            out[r, d] = (int(np.searchsorted(ends, d)) + 1) * budget // m
    return out


def traverse(group: np.ndarray, side: np.ndarray, fp: np.ndarray, rot: np.ndarray, budget: int, chunk: int = 400_000, small: int = 8) -> np.ndarray:
    """Links among the rows of each group, as a forest: for each row, the smallest row that its links reach.

    Rows are sorted by group, side and fingerprint. A group with one side is joined with itself, else its two sides.
    """
    n, limits = len(fp), _limits(budget)
    parent = np.arange(n)
    change = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]) if n else np.zeros(0, np.int64)
    lo, hi = change, np.r_[change[1:], n]
    first = np.r_[True, group[lo[1:]] != group[lo[:-1]]] if n else np.zeros(0, bool)
    lead = np.flatnonzero(first)
    two = np.r_[~first[1:], False][lead] if n else np.zeros(0, bool)
    # a group of one side that is only half of a pair of children has nothing to meet
    alone = ~two & (side[lo[lead]] == 2)
    pair = lead[two | alone]
    other = np.where(two[two | alone], pair + 1, pair)
    stack = [(0, lo[pair], hi[pair], lo[other], hi[other], np.zeros(len(pair), np.int64), rot[lo[pair]])]
    ones: dict[int, np.ndarray] = {}

    def verify(a0, a1, b0, b1):
        na, nb = a1 - a0, b1 - b0
        total = na * nb
        k = np.repeat(np.arange(len(total)), total)
        at = np.arange(len(k)) - np.repeat(np.cumsum(total) - total, total)
        i, j = a0[k] + at // nb[k], b0[k] + at % nb[k]
        near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        unite(parent, i[near], j[near])

    while stack:
        depth, a0, a1, b0, b1, err, r = stack.pop()
        if len(a0) > chunk:
            half = len(a0) // 2
            stack += [tuple([depth, *(x[s] for x in (a0, a1, b0, b1, err, r))]) for s in (slice(half), slice(half, None))]
            continue
        done = ((a1 - a0) * (b1 - b0) <= small) | (depth == BITS)
        verify(a0[done], a1[done], b0[done], b1[done])
        go = ~done
        if not go.any():
            continue
        a0, a1, b0, b1, err, r = (x[go] for x in (a0, a1, b0, b1, err, r))
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fp >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)]
        c, same = ones[depth], a0 == b0
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        kids = [(a0, am, b0, bm, err, r, None), (am, a1, bm, b1, err, r, None), (a0, am, bm, b1, err + 1, r, None), (am, a1, b0, bm, err + 1, r, ~same)]
        a0, a1, b0, b1, err, r = (np.concatenate([x[i] if x[6] is None else x[i][x[6]] for x in kids]) for i in range(6))
        keep = (a1 > a0) & (b1 > b0) & (err <= limits[r, depth + 1]) & ~((a0 == b0) & (a1 - a0 == 1))
        if keep.any():
            stack.append((depth + 1, *(x[keep] for x in (a0, a1, b0, b1, err, r))))
    return find(parent, np.arange(n))


def _forest(budget: int, rows: int = 60_000):
    out = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        rot, p, q, side, rep = (t.column(c).to_numpy() for c in ("rot", "p", "q", "side", "rep"))
        fp = t.column("rfp").to_numpy().view(np.uint64)
        new = np.r_[True, (rot[1:] != rot[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])]
        group = np.cumsum(new)
        order = np.lexsort((fp, side, group))
        root = traverse(group[order], side[order], fp[order], rot[order], budget)
        rep = rep[order]
        linked = root != np.arange(len(root))
        return batch(out, u=rep[linked], v=rep[root[linked]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by node pair; work is done whenever enough whole pairs are held."""
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows == 0:
                continue
            held.append(b)
            if sum(x.num_rows for x in held) < rows:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            rot, p, q = (t.column(c).to_numpy() for c in ("rot", "p", "q"))
            cut = np.flatnonzero((rot[1:] != rot[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1]))
            if len(cut):
                at = int(cut[-1]) + 1
                yield links([t.slice(0, at)])
                held = [t.slice(at)]
        if held:
            yield links(held)

    return run


def trie_links(classes: DataFrame, budget: int = 4, leaf: int = 4096) -> DataFrame:
    """Edges (u, v) between representatives that connect all of ``classes(fp, rep)`` with ``budget`` or fewer differing bits.

    ``fp`` must be distinct. Edges are a spanning forest per task, so classes that link are connected, not all paired.
    """
    workers_find_us(classes.sparkSession)
    sizes, m = _blocks(budget), budget + 1
    offsets = [sum(sizes[:r]) for r in range(m)]
    tries = F.explode(F.array(*(F.struct(F.lit(r).alias("rot"), _rotated(F.col("fp"), offsets[r]).alias("rfp"), F.shiftrightunsigned(_rotated(F.col("fp"), offsets[r]), BITS - sizes[r]).alias("p")) for r in range(m))))
    nodes = classes.select("rep", tries.alias("t")).select("t.rot", "t.p", F.col("t.p").alias("q"), F.lit(2).alias("side"), "t.rfp", "rep")
    flow, key, leaves = "rot int, p long, q long, side int, rfp long, rep long", ["rot", "p", "q"], []
    for level in range(1, m):
        full = nodes.groupBy(key).agg(F.count("*").alias("n"), F.bit_or("rfp").bitwiseXOR(F.bit_and("rfp")).alias("vary")).where(F.col("n") > leaf).drop("n")
        full = written(full)
        n_full = full.count()
        if n_full == 0:
            break
        full = broadcast_if_small(full, n_full)
        leaves.append(nodes.join(full, key, "left_anti"))
        nodes = written(_opened(nodes.join(full, key), level, budget, sizes))
    leaves.append(nodes)
    todo = leaves[0]
    for more in leaves[1:]:
        todo = todo.unionByName(more)
    todo = todo.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in flow.split(", ")))
    return todo.repartition(*key).sortWithinPartitions(*key).mapInArrow(_forest(budget), "u long, v long")


def _within(vary: Column, spent: Column, allowed: int):
    return lambda x: (x.bitwiseAND(F.bitwise_not(vary)) == 0) & (F.bit_count(x) + spent <= allowed)


def _opened(rows: DataFrame, level: int, budget: int, sizes: list[int]) -> DataFrame:
    """Rows of node pairs at ``level`` blocks, dealt to the pairs of their children within the budget."""
    m, parts = budget + 1, []
    for r in range(m):
        ring = sizes[r:] + sizes[:r]
        passed, width = sum(ring[:level]), ring[level]
        allowed = (level + 1) * budget // m
        child = F.shiftrightunsigned(F.col("rfp"), BITS - passed - width).bitwiseAND(F.lit((1 << width) - 1))
        vary = F.shiftrightunsigned(F.col("vary"), BITS - passed - width).bitwiseAND(F.lit((1 << width) - 1))
        flips = F.array(*(F.lit(x).cast("long") for x in range(1 << width) if x.bit_count() <= allowed))
        spent = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
        flip = F.explode(F.filter(flips, _within(vary, spent, allowed)))
        x = rows.where(F.col("rot") == r).select("rot", "p", "q", "side", "rfp", "rep", child.alias("c"), flip.alias("f"))
        own = F.when(F.col("side") == 1, F.col("q")).otherwise(F.col("p"))
        far = F.when(F.col("side") == 1, F.col("p")).otherwise(F.col("q"))
        x = x.select("rot", "rfp", "rep", F.shiftleft(own, width).bitwiseOR(F.col("c")).alias("mine"), F.shiftleft(far, width).bitwiseOR(F.col("c").bitwiseXOR(F.col("f"))).alias("its"))
        side = F.when(F.col("mine") == F.col("its"), 2).when(F.col("mine") < F.col("its"), 0).otherwise(1)
        parts.append(x.select("rot", F.least("mine", "its").alias("p"), F.greatest("mine", "its").alias("q"), side.alias("side"), "rfp", "rep"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def _grouped(fps: DataFrame, budget: int, leaf: int) -> DataFrame:
    """(fp, group): the smallest fingerprint that the links of each reach."""
    classes = written(fps.select("fp").distinct())
    found = components(trie_links(classes.select("fp", F.col("fp").alias("rep")), budget, leaf))
    return classes.join(found, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("group"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, seed: int = 42, budget: int = 4, leaf: int = 4096) -> DataFrame:
    """(doc_id, fingerprint, component_id, kept) for each row of ``docs``.

    Null and wordless texts have fingerprint 0 and link like any other. Rows that repeat an id are all returned and link by
    their own texts. ``component_id`` is the smallest id that links reach. Rows without an id link as others do but can't name a
    component: one without any other id in its component has a null ``component_id``. ``kept`` marks the ids that name their
    component. Other columns of ``docs`` aren't read, so their names don't matter. No rows give no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, ngram, seed))
    of = written(_grouped(fps, budget, leaf))
    least = fps.groupBy("fp").agg(F.min("id").alias("least")).join(of, "fp").groupBy("group").agg(F.min("least").alias("component_id"))
    out = fps.join(of.join(least, "group"), "fp")
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 4, seed: int = 42, budget: int = 4, leaf: int = 4096) -> DataFrame:
    """The rows of ``docs`` that stay if one of each group of near copies does: the one with the smallest id, rows without one
    last; of rows with one id, the one whose text has the smallest hash.

    Texts that share an id are told apart. Of rows that are equal in id and text one stays, by the smallest hash of all its columns
    as a text. Null and wordless texts are one group. Names and types of other columns don't matter. No rows give no rows.
    """
    the_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    hashed = docs.select(the_id.alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    fps = written(fingerprints(hashed, "id", "text", ngram, seed, "th"))
    of = _grouped(fps, budget, leaf)
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    best = fps.groupBy("fp").agg(F.min(rank).alias("best")).join(of, "fp").groupBy("group").agg(F.min("best").alias("best"))
    copies = fps.groupBy("id", "th").agg(F.count("*").alias("n"))
    stays = best.select("best.id", "best.th").alias("b").join(copies.alias("c"), F.col("b.id").eqNullSafe(F.col("c.id")) & (F.col("b.th") == F.col("c.th"))).select("b.id", "b.th", "n")
    stays = written(stays.select(F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "th", "n"))
    rows = docs.select(F.coalesce(the_id, F.lit(0)).alias("id"), the_id.isNull().alias("no_id"), F.xxhash64(text).alias("th"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    kept = rows.join(stays, ["id", "no_id", "th"])
    again = kept.where("n > 1").groupBy("id", "no_id", "th").agg(F.min_by("doc", F.xxhash64(F.col("doc").cast("string"))).alias("doc"))
    return kept.where("n = 1").select("doc").unionByName(again.select("doc")).select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
