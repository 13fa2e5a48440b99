"""Mixing sources to target weights by capped water-filling.

A share of all words is dealt to the sources by weight; no source gets more than ``max_epochs`` times its size, and what
is cut there goes to the others by weight until no source is above its cap. A document is then taken ``floor(target /
source size)`` times whole; the rest of the target is a seeded sample: documents in the order of a seeded hash, each
whole, and the one on the border by the fraction of its words that still fits. The border is found by histograms of the
hash, ten bits at a time, so no source is ever gathered or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import broadcast_if_small, written

STEP, STEPS = 10, 6


def n_words(text: Column) -> Column:
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def water_level(sources: DataFrame, share: float, max_epochs: float) -> float:
    """The words per unit of weight, from sources(source_size, weight); only sums reach the driver, once a round."""
    cap, level = F.col("source_size") * F.lit(float(max_epochs)), -1.0
    while True:
        full = F.col("weight") * F.lit(level) > cap
        total, capped, weight = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight:  # every source is at its cap (or there is none)
            return float("inf") if total else 0.0
        new = (share * total - (capped or 0.0)) / weight
        if new <= level:
            return level
        level = new


def mix(docs: DataFrame, weights: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, seed: int = 8) -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, taken) for each row of ``docs``; ``weights`` is (source, weight).

    Null texts have size 0; null sources are a source of their own; a source without a weight, or with none above 0, gets nothing.
    Rows that are equal in id, text and source share alike what falls on them. Other columns aren't read. No rows give no rows.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text_hash")), 64 - STEP * STEPS)
    words = written(words.withColumn("at", at))
    sizes = words.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("weight")).where("weight > 0").groupBy("_s").agg(F.max("weight").alias("weight"))
    sources = written(sizes.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight")))
    n = sources.count()
    level = water_level(sources.where("weight > 0"), share, max_epochs)
    cap = F.col("source_size") * F.lit(float(max_epochs))
    target = F.when(F.col("weight") > 0, F.least(F.col("weight") * F.lit(level), cap)).otherwise(0.0)
    goal = sources.select("source", "source_size", target.alias("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("whole", epochs).withColumn("rest", F.least(F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"), F.col("source_size")))
    goal = written(goal)
    # the border: documents with hash >> shift below `cut` are taken once more, those equal to it share `rest`
    border = goal.select("source", F.lit(0).cast("long").alias("cut"), "rest", F.lit(0).cast("long").alias("level_size")).where("rest > 0")
    for step in range(1, STEPS + 1):
        shift = STEP * (STEPS - step)
        side = broadcast_if_small(border.select(F.col("source").alias("_s"), "cut", "rest"), n)
        inside = words.where("size > 0").join(side, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("at", shift + STEP) == F.col("cut")))
        slots = inside.groupBy("source", F.shiftright("at", shift).alias("cut"), "rest").agg(F.sum("size").alias("level_size"), F.count("*").alias("n"))
        upto = F.sum("level_size").over(Window.partitionBy("source").orderBy("cut")) - F.col("level_size")  # at most 2 ** STEP slots of a source
        slots = slots.withColumn("before", upto).where("before < rest and rest <= before + level_size")
        border = written(slots.select("source", "cut", (F.col("rest") - F.col("before")).alias("rest"), "level_size", "n"))
        if (border.agg(F.max("n")).first()[0] or 0) <= 1:
            break
    goal = goal.select("source", "source_size", "target", "whole").alias("g").join(border.select(F.col("source").alias("_s"), "cut", "rest", "level_size"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    goal = broadcast_if_small(goal.withColumnRenamed("source", "_s"), n)
    here = F.shiftright("at", shift)
    part = F.when(here < F.col("cut"), F.col("size")).when(here == F.col("cut"), F.floor(F.col("rest") * F.col("size") / F.col("level_size"))).otherwise(0)
    taken = F.col("size") * F.col("whole") + F.coalesce(part, F.lit(0))
    return words.join(goal, F.col("source").eqNullSafe(F.col("_s"))).select("doc_id", "source", "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def cycled_weights(docs: DataFrame, source_col: str = "source", cycle: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): the weights of ``cycle`` in turn, sources in the order of their code points, null last.

    Ranks the distinct sources, which are sorted in one task; give weights of your own if there are very many.
    """
    names = written(docs.select(F.col(source_col).alias("source")).distinct())
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in cycle)), (rank % len(cycle) + 1).cast("int"))
    return names.select("source", weight.alias("weight"))


def repeated(docs: DataFrame, taken: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken whole, and one with the first words for a fraction.

    Documents without words, null texts among them, stay once. Columns and their order are those of ``docs``; other columns' names don't
    matter. Equal rows share alike. No rows give no rows.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("text_hash"), row.alias("doc"))
    t = taken.select("doc_id", "source", "text_hash", "size", "taken").distinct()
    same = rows.doc_id.eqNullSafe(t.doc_id) & rows.source.eqNullSafe(t.source) & (rows.text_hash == t.text_hash)
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1)
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    copies = F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), full.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>"))))
    out = rows.join(t, same).select("doc", copies.alias("words"))
    text = F.col(f"doc.`{text_col}`")
    # pieces are a word and the white space after it; what stands before the first word is a piece too
    pieces = F.col("words").cast("int") + F.when(text.rlike("^[\\x20\\x09-\\x0D]"), 1).otherwise(0)
    head = F.array_join(F.slice(F.split(text, "(?<=[\\x20\\x09-\\x0D])(?=[^\\x20\\x09-\\x0D])"), 1, pieces), "")
    changed = F.when(F.col("words") > 0, head).otherwise(text)
    return out.select(*(changed.alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
