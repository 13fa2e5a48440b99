"""A Merkle manifest of a dataset: a tree of hashes for each group of rows, and one over the groups' subroots, with proofs.

The node store lies outside memory. Leaves are sorted by group and key into runs, and numbered there: a run's rows have their place
within the run, and what lies in earlier runs is known from one small count for each run and group. A node's coordinate is (group,
level, place); two consecutive nodes of a level make the node at half their place. Aligned runs of 4096 nodes are whole subtrees:
a task reads such runs in order, each level from the one before, and writes the levels into Parquet partitioned by level; the top level
of all runs is what the next pass reads. Proofs are extracted from the top down by merging sorted scans: the proof of a run's top, the
nodes of the run level by level, then its leaves, each of which leaves with its siblings. A task holds one run at a time.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, workers_find_us, written
from loomgraph.operators.order import numbered

#: Levels that one pass builds; a run has so many nodes that one is left on top.
LEVELS = 12
#: A step of a proof: whether the sibling stands left or right of the path, or there is none, then its digest.
LEFT, RIGHT, ALONE = b"L", b"R", b"-"
STEP = 33


def joined_hash(*digests: bytes) -> bytes:
    """SHA-256 of the digests' texts in lower-case hex, one after another."""
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def folded(leaf: bytes, proof: bytes) -> bytes:
    """The root that a leaf and its proof lead to."""
    at = leaf
    for i in range(0, len(proof), STEP):
        side, other = proof[i : i + 1], proof[i + 1 : i + STEP]
        at = joined_hash(other, at) if side == LEFT else joined_hash(at, other) if side == RIGHT else joined_hash(at)
    return at


def siblings_hash(proof: bytes) -> bytes:
    """SHA-256 of the siblings' texts in the order of the path."""
    return joined_hash(*(proof[i + 1 : i + STEP] for i in range(0, len(proof), STEP) if proof[i : i + 1] != ALONE))


def leaf_digest(*columns: Column | str) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its length in UTF-8 bytes, a colon and the value."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in (F.col(x) if isinstance(x, str) else x for x in columns)]
    return F.unhex(F.sha2(F.concat(*said), 256))


def group_key(column: Column) -> Column:
    """A text that orders groups by UTF-8 bytes, null first."""
    return F.when(column.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), column.cast("string")))


def _runs(batches: Iterator[pa.RecordBatch], *by: str) -> Iterator[list[tuple]]:
    """The rows of a sorted stream, group by group of equal ``by``."""
    own, at = [], None
    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in by), strict=True))
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        for k, row in zip(keys, rows, strict=True):
            if k != at and own:
                yield own
                own = []
            at = k
            own.append(row)
    if own:
        yield own


def _chunks(rows: Iterator[tuple], schema: pa.Schema, size: int = 8192) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


@dataclass
class Tree:
    """Trees over (key, pos, n, digest): a store of nodes by level, and where each pass began."""

    leaves: DataFrame
    passes: list[DataFrame]
    """Of each pass (level, key, n, pos, digest), the levels above what it read up to the top of its runs."""
    levels: int = LEVELS
    """How many levels a pass builds."""

    @classmethod
    def built(cls, leaves: DataFrame, levels: int = LEVELS) -> Tree:
        spark = leaves.sparkSession
        workers_find_us(spark)
        path = f"{scratch(spark)}/nodes-{uuid.uuid4().hex}"
        most = leaves.agg(F.max("n")).first()[0] or 0
        base, passes, entry = 0, [], leaves
        schema = pa.schema([("level", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("pos", pa.int64()), ("digest", pa.binary())])
        while most > 1 << base:

            def climbed(batches: Iterator[pa.RecordBatch], base: int = base) -> Iterator[pa.RecordBatch]:
                def nodes() -> Iterator[tuple]:
                    for own in _runs(batches, "key", "run"):
                        key, n, at, row = own[0][0], own[0][2], own[0][3], [x[4] for x in own]
                        for level in range(base + 1, base + levels + 1):
                            if n <= 1 << level - 1:  # one node was left: the tree's root
                                break
                            row, at = [joined_hash(*row[i : i + 2]) for i in range(0, len(row), 2)], at >> 1
                            for i, d in enumerate(row):
                                yield level, key, n, at + i, d

                return _chunks(nodes(), schema)

            runs = entry.select("key", F.shiftright("pos", levels).alias("run"), "n", "pos", "digest").repartition("key", "run").sortWithinPartitions("key", "run", "pos")
            runs.mapInArrow(climbed, "level int, key string, n long, pos long, digest binary").write.partitionBy("level").parquet(f"{path}/{base}")
            nodes = spark.read.schema("key string, n long, pos long, digest binary, level int").parquet(f"{path}/{base}")
            passes.append(nodes)
            base += levels
            entry = nodes.where((F.col("level") == base) & (F.col("n") > F.lit(1 << base)))
        return cls(leaves, passes, levels)

    def roots(self) -> DataFrame:
        """(key, n, digest): the last node of each tree."""
        out = self.leaves.where("n = 1").select("key", "n", "digest")
        for nodes in self.passes:
            size = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)
            out = out.union(nodes.where((F.col("n") <= size(F.col("level"))) & (F.col("n") > size(F.col("level") - 1))).select("key", "n", "digest"))
        return out

    def proofs(self, beyond: DataFrame, *carried: str) -> DataFrame:
        """(own, digest, proof, root) of each leaf: ``own`` has its ``carried`` columns. ``beyond`` is (key, n, proof, root): what follows
        each key's own proof, and what is known of its root."""
        above = None
        for k in range(max(len(self.passes), 1) - 1, -1, -1):
            base = k * self.levels
            entry = self.leaves if k == 0 else self.passes[k - 1].where((F.col("level") == base) & (F.col("n") > F.lit(1 << base)))
            # trees that end in this pass, and runs of greater ones
            tops = beyond.where((F.col("n") <= F.lit(1 << (base + self.levels))) & (F.col("n") > F.lit(1 << base if k else 0))).select("key", F.lit(0).cast("long").alias("run"), "proof", "root")
            if above is not None:
                tops = tops.union(above.select("own.key", "own.pos", "proof", "root"))
            own = F.struct(*carried) if k == 0 else F.struct("key", "pos")
            above = _merged(entry.withColumn("own", own), self.passes[k] if self.passes else None, tops, base, self.levels)
            above = written(above) if k else above
        return above


def _merged(entry: DataFrame, nodes: DataFrame | None, tops: DataFrame, base: int, levels: int) -> DataFrame:
    """(own, digest, proof, root) of the nodes that a pass read: a run's top, its inner nodes and these come in one sorted stream."""
    null = lambda t: F.lit(None).cast(t)
    own, root = entry.schema["own"].dataType, tops.schema["root"].dataType
    rows = entry.select("key", F.shiftright("pos", levels).alias("run"), F.lit(base).alias("level"), "pos", "n", "digest", null("binary").alias("proof"), "own", null(root).alias("root"))
    rows = rows.union(tops.select("key", "run", F.lit(base + levels), null("long"), null("long"), null("binary"), "proof", null(own), "root"))
    if nodes is not None:
        run = F.call_function("shiftright", F.col("pos"), F.lit(base + levels) - F.col("level"))
        rows = rows.union(nodes.where(F.col("level") < base + levels).select("key", run, "level", "pos", "n", "digest", null("binary"), null(own), null(root)))
    stream = rows.repartition("key", "run").sortWithinPartitions("key", "run", F.desc("level"), "pos")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (first := next(batches, None)) is None:
            return
        schema = pa.schema([first.schema.field("own").with_name("own"), ("digest", pa.binary()), ("proof", pa.binary()), first.schema.field("root")])

        def leaves() -> Iterator[tuple]:
            for top, *below in _runs(itertools.chain([first], batches), "key", "run"):
                at, parent, rest = {(x[2], x[3]): x[5] for x in below}, None, b""
                for _, _, level, pos, n, digest, _, own, _ in below:
                    if level == base:
                        if pos >> 1 != parent:  # both children of a node share what is above it
                            parent, rest = pos >> 1, _steps(at, base, n, pos, 1, levels) + top[6]
                        yield own, digest, _steps(at, base, n, pos, 0, 1) + rest, top[8]

        yield from _chunks(leaves(), schema)

    return stream.mapInArrow(merge, f"own {own.simpleString()}, digest binary, proof binary, root {root.simpleString()}")


def _steps(at: dict[tuple[int, int], bytes], base: int, n: int, pos: int, begin: int, end: int) -> bytes:
    """The steps of a proof from ``begin`` to ``end`` levels above ``base``, below the root of a tree of ``n`` leaves."""
    out = []
    for i in range(begin, end):
        if n <= 1 << base + i:
            break
        p = pos >> i
        other = at.get((base + i, p ^ 1))
        out.append(ALONE + bytes(STEP - 1) if other is None else (LEFT if p & 1 else RIGHT) + other)
    return b"".join(out)


def manifest(rows: DataFrame, columns: tuple[str, ...], group: str, order: str, *carried: str, levels: int = LEVELS) -> DataFrame:
    """(own, leaf, subroot, root, proof): each row's leaf, the hash of its group's tree and of the whole, and its proof.

    A leaf hashes ``columns``. Leaves of one ``group`` stand by ``order`` (null first), then by their hash; groups by UTF-8 bytes, null
    first. Rows that are equal have equal leaves but places of their own. A proof has one step of 33 bytes for each level up to the root:
    the side of the sibling and its digest, or that there is none. ``own`` has the ``carried`` columns. Long texts are hashed whole; one
    row is a tree by itself; no rows give no rows. Other columns, whatever their names, aren't read.
    """
    leaves = rows.select(group_key(F.col(group)).alias("key"), F.col(order).alias("_order"), leaf_digest(*columns).alias("digest"), F.struct(*carried).alias("own"))
    tree = Tree.built(numbered(leaves, "key", "_order", "digest"), levels)
    roots = written(tree.roots())
    top = Tree.built(numbered(roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest", F.col("n").alias("leaves")), "key", "group"), levels)
    whole = top.roots().select("key", "n", F.lit(b"").alias("proof"), F.struct("digest").alias("root"))
    subroots = written(top.proofs(whole, "group", "leaves"))
    beyond = subroots.select(F.col("own.group").alias("key"), F.col("own.leaves").alias("n"), "proof", F.struct(F.col("digest").alias("subroot"), F.col("root.digest").alias("root")).alias("root"))
    return tree.proofs(beyond, "own").select("own.own", F.col("digest").alias("leaf"), "root.subroot", "root.root", "proof")


def verified(rows: DataFrame, leaf: str = "leaf") -> DataFrame:
    """``rows`` of ``manifest`` with ``proof_sha256`` (of the siblings in order) and ``folded_root``: where the bytes in column ``leaf``
    lead to by the proof. A null leaf or proof gives nulls."""
    workers_find_us(rows.sparkSession)
    kept = [c for c in rows.columns if c not in ("proof_sha256", "folded_root")]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = list(zip(b.column(kept.index(leaf)).to_pylist(), b.column(kept.index("proof")).to_pylist(), strict=True))
            proof = [None if p is None else siblings_hash(p).hex() for _, p in pairs]
            root = [None if p is None or x is None else folded(x, p) for x, p in pairs]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proof, pa.string()), pa.array(root, pa.binary())], [*kept, "proof_sha256", "folded_root"])

    return rows.select(*kept).mapInArrow(run, f"{schema}, proof_sha256 string, folded_root binary")
