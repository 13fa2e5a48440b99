"""What was valid on a date, for a table of seeds and dates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.graph import Graph
from loomgraph.operators.order import running
from loomgraph.operators.walks import chains
from loomgraph.session import broadcast_if_small, saved

#: Of what happens on one day, what comes first: a successor ends a note, notes begin, questions, the last day of a note is over.
REPLACED, BEGUN, ASKED, OVER = range(4)


def valid_date(day):
    """YYYY-MM-DD with a month up to 12 and a day up to 31; dates are compared as text."""
    return day.rlike("^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$")


def spans(chain: DataFrame) -> DataFrame:
    """(root, day, step, live, place, over) of ``chains`` rows with ``after``: what changes on a day. ``live`` counts notes that are valid,
    ``place`` adds up their positions (of a single one it is that one's), ``over`` counts notes that began and ran out.

    A note is valid from its first day to the day before its successor's first, or to its own last day.
    """
    begin, end, after = F.col("valid_from"), F.col("valid_until"), F.col("after")
    ever = begin.isNotNull() & (after.isNull() | (begin < after)) & (end.isNull() | (begin <= end))
    row = lambda day, step, sign, over: F.struct(day.alias("day"), F.lit(step).alias("step"), F.lit(sign).cast("long").alias("live"), (F.col("pos") * sign).alias("place"), F.lit(over).cast("long").alias("over"))
    replaced = after.isNotNull() & (end.isNull() | (after <= end))
    changes = F.array(
        F.when(ever, row(begin, BEGUN, 1, 0)),
        F.when(ever & replaced, row(after, REPLACED, -1, 0)).when(ever & end.isNotNull(), row(end, OVER, -1, 0)),
        F.when(begin <= end, row(end, OVER, 0, 1)).when(begin > end, row(begin, BEGUN, 0, 1)),
    )
    return chain.select("root", F.explode(changes).alias("x")).where("x is not null").select("root", "x.*")


def historical_for(g: Graph, asked: DataFrame, scope: dict[str, str] | None = None) -> DataFrame:
    """``asked`` (seed, as_of and any other columns) with ``status`` and ``active_guidance_id``.

    The days on which something changes in a chain and the days that are asked for are sorted together, and running totals are carried
    from the ones to the others: no pair of a question and a note is made. A seed is an id. Status is active, not_yet_valid, expired,
    indeterminate (first days are missing), no_active_guidance, or the error: SeedNotFound, MissingAsOf, InvalidDateFormat,
    UnresolvedConflict, SupersessionCycle. Equal questions are answered each by itself.
    """
    after = F.lead("valid_from").over(Window.partitionBy("root").orderBy("pos", "id"))
    chain = saved(chains(g, scope).withColumn("after", after).select("root", "pos", "path", "id", "valid_from", "valid_until", "after", "error"))
    whole = chain.groupBy("root").agg(F.max("error").alias("error"), F.min("valid_from").alias("first"), F.min_by(F.coalesce("valid_from", F.lit("")), "pos").alias("root_from"), F.bool_or(F.col("valid_from").isNull()).alias("vague"))
    seeds = g.ids.join(chain.select("path", "root"), "path").select(F.col("id").alias("_seed"), "root")
    own = F.struct(*(F.col(f"`{c}`") for c in asked.columns))
    known = saved(asked.select(own.alias("own")).join(seeds, F.col("own.seed") == F.col("_seed"), "left").select("own", "root"))
    wrong = F.when(F.col("own.as_of").isNull(), "MissingAsOf").when(~valid_date(F.col("own.as_of")), "InvalidDateFormat").when(F.col("root").isNull(), "SeedNotFound")
    zero = F.lit(0).cast("long")
    days = known.where(wrong.isNull()).select("root", F.col("own.as_of").alias("day"), F.lit(ASKED).alias("step"), zero.alias("live"), zero.alias("place"), zero.alias("over"), "own")
    both = days.unionByName(spans(chain).join(days.select("root").distinct(), "root", "left_semi"), allowMissingColumns=True)
    at = running(both, "root", ["day", "step"], ["live", "place", "over"]).where(F.col("step") == ASKED)
    at = at.join(broadcast_if_small(saved(whole), whole.count()), "root")
    single = chain.select("root", F.col("pos").alias("place"), F.col("id").alias("one"))
    at = at.withColumn("place", F.when(F.col("live") == 1, F.col("place"))).join(single, ["root", "place"], "left")
    early = F.col("day") < F.col("first")
    status = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("first").isNull() | (early & (F.col("root_from") == "")), "indeterminate").when(early, "not_yet_valid")
    status = status.when(F.col("live") > 1, "UnresolvedConflict").when(F.col("live") == 1, "active").when(F.col("over") > 0, "expired").when(F.col("vague"), "indeterminate").otherwise("no_active_guidance")
    found = at.select("own.*", status.alias("status"), F.when(status == "active", F.col("one")).alias("active_guidance_id"))
    return found.unionByName(known.where(wrong.isNotNull()).select("own.*", wrong.alias("status"), F.lit(None).cast("string").alias("active_guidance_id")))
