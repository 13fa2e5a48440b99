"""Places in an order, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import broadcast_if_small, saved


def _run() -> Column:
    return F.shiftright("_at", 33)


def _sorted(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` sorted by ranges of (key, order) and written, with ``_at``: a number that ascends, the run's in its upper bits.

    A key with any share of the rows is spread over as many runs as it fills, also where rows are equal in all columns.
    """
    tie = saved(rows.withColumn("_tie", F.monotonically_increasing_id()))
    return saved(tie.orderBy(key, *(F.col(c).asc_nulls_first() for c in order), "_tie").drop("_tie").withColumn("_at", F.monotonically_increasing_id()))


def _earlier_runs(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0) and ``n`` in their ``key``, in the order of ``order``, nulls first; rows equal in all stand as they come.

    A row's place in its run is known there, and what lies in earlier runs from one small count for each run and key.
    """
    runs = _sorted(rows, key, *order)
    count = runs.groupBy(key, _run().alias("_run")).agg(F.min("_at").alias("_low"), F.count("*").alias("_rows"))
    count = saved(count.withColumns({"_before": F.coalesce(F.sum("_rows").over(_earlier_runs(key)), F.lit(0)), "n": F.sum("_rows").over(Window.partitionBy(key))}).drop("_rows"))
    out = runs.withColumn("_run", _run()).join(broadcast_if_small(count, count.count()), [key, "_run"])
    return out.withColumn("pos", F.col("_at") - F.col("_low") + F.col("_before")).drop("_at", "_run", "_low", "_before")


def running(rows: DataFrame, key: str, order: list[str], sums: list[str]) -> DataFrame:
    """``rows`` with the columns ``sums`` replaced by their totals up to and with each row, in its ``key`` by ``order``, nulls first.

    Totals are taken within runs, and earlier runs add one row for each run and key; no window holds a whole key.
    """
    runs = _sorted(rows, key, *order).withColumn("_run", _run())
    total = runs.groupBy(key, "_run").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    total = saved(total.withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(_earlier_runs(key)), F.lit(0)) for c in sums}))
    own = Window.partitionBy(key, "_run").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = runs.withColumns({c: F.sum(c).over(own) for c in sums}).join(broadcast_if_small(total, total.count()), [key, "_run"])
    return out.withColumns({c: F.col(c) + F.col(f"_{c}") for c in sums}).drop("_at", "_run", *(f"_{c}" for c in sums))
