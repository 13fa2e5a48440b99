"""Durable cuts of the lineage for iterative operators."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workers_find_us(spark: SparkSession) -> None:
    """Lets Python workers import this package when it is used from a source folder and not installed."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep) and root in map(os.path.abspath, sys.path):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; on one machine, where it is unset, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/loomgraph/{spark.sparkContext.applicationId}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and reread: survives lost executors and ends the lineage."""
    path = f"{scratch(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table that gets rows round by round; each round is written once and the whole is read as one scan."""

    def __init__(self, first: DataFrame) -> None:
        self.spark, self.schema, self.rounds = first.sparkSession, first.schema, []
        self.path = f"{scratch(self.spark)}/{uuid.uuid4().hex}"
        self.add(first)

    def add(self, rows: DataFrame) -> DataFrame:
        self.rounds.append(f"{self.path}/{len(self.rounds)}")
        rows.select(*self.schema.names).write.option("compression", "zstd").parquet(self.rounds[-1])
        return self.last()

    def last(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.rounds[-1])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.rounds)


def clear(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables; results that are still to be computed from them are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def broadcast_if_small(df: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Broadcasts ``df`` only if its counted rows stay under ``limit``; beyond that Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df
