"""Near copies among embeddings by E8 lattice hashing.

Unit vectors are projected at random to eight dimensions and decoded to the nearest point of the E8 lattice; that point is
the vector's cell. There are several such tables. A vector also looks into the neighbouring cells that lie next nearest
to it. Vectors that meet are verified by their cosine in double precision.

Equal vectors are one class, compared once. Cells hold ids; vectors join them only where others are met. A cell with many members
is dealt out in blocks, each pair of blocks being a task of bounded size. A pair is counted only in the first table and cell where
it meets, so links are counted in place and only sums and a spanning forest leave a task, never pairs.

Defaults are for some millions of vectors: the members of a cell grow with their number, and fall with the eighth power of ``scale``.
A greater scale needs more ``tables`` or ``probes`` for the same recall.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomgraph.llm.common import batch, broadcast_if_small, find, unite, workers_find_us, written
from loomgraph.llm.components import components

#: The 240 shortest vectors of the E8 lattice, doubled: neighbours of a cell.
ROOTS2 = np.array(
    [v for i in range(8) for j in range(i) for a in (2, -2) for b in (2, -2) for v in [[a if k == i else b if k == j else 0 for k in range(8)]]]
    + [[1 - 2 * ((m >> k) & 1) for k in range(8)] for m in range(256) if m.bit_count() % 2 == 0],
    dtype=np.int64,
)


def _d8(y: np.ndarray) -> np.ndarray:
    f = np.rint(y)
    odd = np.flatnonzero(f.sum(axis=1) % 2 != 0)
    gap = y[odd] - f[odd]
    worst = np.abs(gap).argmax(axis=1)
    f[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1.0, -1.0)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row, doubled (integers)."""
    a, b = _d8(y), _d8(y - 0.5) + 0.5
    nearer = ((y - b) ** 2).sum(axis=1) < ((y - a) ** 2).sum(axis=1)
    return np.rint(2 * np.where(nearer[:, None], b, a)).astype(np.int64)


def cells(unit: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """[vectors, tables, 1 + probes]: the key of each vector's cell and of the neighbouring cells next nearest to it."""
    n, dim = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.int64)
    for t in range(tables):
        rng = np.random.default_rng([seed, dim, t])
        y = unit @ rng.standard_normal((dim, 8)) * scale + rng.random(8)
        mix = rng.integers(-(1 << 62), 1 << 62, 8) * 2 + 1
        home = decode(y)
        near = np.argsort(-((y - home / 2) @ ROOTS2.T), axis=1, kind="stable")[:, :probes]
        with np.errstate(over="ignore"):
            out[:, t, 0] = home @ mix
            out[:, t, 1:] = (home[:, None, :] + ROOTS2[near]) @ mix
    return out


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the cells [pairs, 1 + probes] of two vectors in one table: whether they meet in the first's cell, in the second's."""
    return (x[:, :1] == y).any(axis=1), (y[:, :1] == x).any(axis=1)


FLOW = "t int, cell long, i int, j int, side int, rep long, size long, dim int, vec binary, cells array<long>"
KEY = ["dim", "t", "cell", "i", "j"]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that no square overflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaf(threshold: float, tables: int, width: str, rows_held: int = 20_000, bytes_held: int = 16 << 20):
    out = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def one(p: dict) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of one pair of blocks of one cell: (kind, a, b), kind 0: links of a, 1: an edge."""
        side, rep, size, t, cell, dim = p["side"], p["rep"], p["size"], int(p["t"][0]), int(p["cell"][0]), int(p["dim"][0])
        x = _unit(np.frombuffer(b"".join(p["vec"]), width).reshape(-1, dim).astype(np.float64))
        keys = np.concatenate(p["cells"]).reshape(len(rep), tables, -1)
        links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))
        left = np.flatnonzero(side != 1)
        right = left if (side == 2).all() else np.flatnonzero(side == 1)
        for lo in range(0, len(left), 512):
            part = left[lo : lo + 512]
            u, v = np.nonzero(x[part] @ x[right].T >= threshold)
            u, v = part[u], right[v]
            once = rep[u] < rep[v] if right is left else rep[u] != rep[v]
            u, v = u[once], v[once]
            swap = rep[u] > rep[v]
            u, v = np.where(swap, v, u), np.where(swap, u, v)
            for s in range(t + 1):
                if not len(u):
                    break
                in_u, in_v = _met(keys[u, s], keys[v, s])
                here = ~(in_u | in_v) if s < t else np.where(in_u, keys[u, s, 0] == cell, in_v & (keys[v, s, 0] == cell))
                u, v = u[here], v[here]
            links += np.bincount(u, weights=size[v], minlength=len(rep)).astype(np.int64) + np.bincount(v, weights=size[u], minlength=len(rep)).astype(np.int64)
            unite(parent, u, v)
        root, some = find(parent, np.arange(len(rep))), links > 0
        tied = root != np.arange(len(rep))
        return [(np.zeros(some.sum(), np.int32), rep[some], links[some]), (np.ones(tied.sum(), np.int32), rep[tied], rep[root[tied]])]

    def work(t: pa.Table) -> pa.RecordBatch:
        cols = {c: t.column(c).to_numpy() for c in ("t", "cell", "i", "j", "side", "rep", "size", "dim")} | {"vec": t.column("vec").to_pylist(), "cells": list(t.column("cells").to_numpy(zero_copy_only=False))}
        new = np.flatnonzero(np.r_[True, np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in KEY])])
        got = []
        for a, b in zip(new.tolist(), [*new[1:].tolist(), t.num_rows], strict=True):
            if b - a > 1:
                got += one({c: v[a:b] for c, v in cols.items()})
        kind, a, b = (np.concatenate([g[k] for g in got]) if got else np.zeros(0, np.int64) for k in range(3))
        return batch(out, kind=kind.astype(np.int32), a=a, b=b)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) < rows_held and sum(x.nbytes for x in held) < bytes_held:
                continue
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = [t.column(k).to_numpy() for k in KEY]
            cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key]))
            if len(cut):
                yield work(pa.Table.from_batches([t.slice(0, int(cut[-1]) + 1)]))
                held = [t.slice(int(cut[-1]) + 1)]
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, tables: int = 5, probes: int = 1, scale: float = 0.5, block: int = 1024, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``; links are pairs found with cosine >= ``threshold``.

    Null and zero vectors and those with a null or non-finite component link with nothing; so do vectors of different
    length with each other. All arithmetic is in double precision. Rows without an id count as links but name no component. Rows that
    repeat an id are each linked by their own vectors. Other columns aren't read. No rows give no rows.
    """
    workers_find_us(vectors.sparkSession)
    v = F.col("v")
    # components are carried as they come if they are floats, else as doubles
    single = isinstance(getattr(vectors.schema[vector_col].dataType, "elementType", None), FloatType)
    kind, width = ("float", "<f4") if single else ("double", "<f8")
    usable = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)
    clean = F.transform(v, lambda x: F.when(x == 0, F.lit(0.0).cast(kind)).otherwise(x))  # -0.0 is 0.0
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    rows = rows.select("id", F.when(F.coalesce(usable, F.lit(False)), clean).alias("v"))
    rows = rows.select("id", "v", F.when(v.isNotNull(), F.xxhash64(v)).alias("h1"), F.when(v.isNotNull(), F.xxhash64(F.lit("second"), v)).alias("h2"))
    # a class is an arbitrary copy of its vector (they are equal), its smallest id and its number of rows; its hash stands for it
    classes = rows.where("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v"))
    classes = written(classes.withColumn("rep", F.xxhash64("h1", "h2")))
    flat = pa.schema([("rep", pa.int64()), ("size", pa.int64()), ("dim", pa.int32()), ("vec", pa.binary()), ("cells", pa.list_(pa.int64()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1000):
                b = big.slice(lo, 1000)
                vecs = [np.array(x.values.to_numpy(zero_copy_only=False), width) for x in b.column("v")]
                dims = np.array([len(x) for x in vecs])
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    keys = cells(_unit(np.stack([vecs[i] for i in at]).astype(np.float64)), tables, probes, scale, seed)
                    pick = pa.array(at)
                    yield batch(flat, rep=b.column("rep").take(pick), size=b.column("size").take(pick), dim=np.full(len(at), dim, np.int32), vec=[vecs[i].tobytes() for i in at], cells=list(keys.reshape(len(at), -1)))

    known = written(classes.select("rep", "size", "v").mapInArrow(hashed, "rep long, size long, dim int, vec binary, cells array<long>"))
    put = known.select("dim", "rep", F.posexplode("cells").alias("k", "cell")).select("dim", "rep", (F.col("k") / (1 + probes)).cast("int").alias("t"), "cell")
    counts = written(put.groupBy("dim", "t", "cell").agg(F.count("*").alias("n")).where("n > 1"))
    meeting = put.join(broadcast_if_small(counts, counts.count()), ["dim", "t", "cell"])
    blocks = F.ceil(F.col("n") / block).cast("int")
    deal = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "rep"), 33).cast("int")
    meeting = meeting.withColumn("mine", F.pmod(deal, blocks)).withColumn("its", F.explode(F.sequence(F.lit(0), blocks - 1)))
    side = F.when(F.col("mine") == F.col("its"), 2).when(F.col("mine") < F.col("its"), 0).otherwise(1)
    dealt = meeting.select("t", "cell", F.least("mine", "its").alias("i"), F.greatest("mine", "its").alias("j"), side.alias("side"), "rep")
    dealt = dealt.join(known, "rep").select(*(F.col(x.split()[0]) for x in FLOW.split(", ")))
    found = written(dealt.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_leaf(threshold, tables, width), "kind int, a long, b long"))
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("n"))
    comp = components(found.where("kind = 1").select(F.col("a").alias("u"), F.col("b").alias("v")))
    of = classes.select("h1", "h2", "least", "rep", "size").join(links, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    of = written(of.select("h1", "h2", "least", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")))
    named = of.join(of.groupBy("group").agg(F.min("least").alias("component")), "group").select("h1", "h2", "n_links", "component")
    out = rows.select("id", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
