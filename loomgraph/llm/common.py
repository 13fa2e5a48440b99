"""Helpers shared by the operators: durable cuts of the lineage, numpy/Arrow glue."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomgraph.session import broadcast_if_small, scratch, shared_dir, workers_find_us
from loomgraph.session import saved as written

__all__ = ["SPACE", "WORD", "batch", "broadcast_if_small", "find", "scratch", "shared_dir", "table", "unite", "workers_find_us", "written"]

#: What separates words: space and \x09-\x0D, as in ``bytes.split``.
SPACE = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def find(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    r = parent[i]
    while True:
        up = parent[r]
        if (up == r).all():
            return r
        r = up


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Hooks the trees of ``i[k]`` and ``j[k]`` together; a root is the smallest index of its tree."""
    while len(i):
        a, b = find(parent, i), find(parent, j)
        parent[i], parent[j] = a, b
        apart = a != b
        i, j = np.maximum(a, b)[apart], np.minimum(a, b)[apart]
        np.minimum.at(parent, i, j)
