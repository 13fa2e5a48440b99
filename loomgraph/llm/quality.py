"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition on a text that rejects it. Cost (seconds a row) and selectivity (share rejected) of every rule
are measured on a bounded seeded sample; the rules are then tried in the order of rejections per second and the first
one that rejects ends the cascade (a CASE, whose later branches aren't evaluated). The order changes the time, never
the verdict. All statistics are taken over whole texts, inside the row: nothing is exploded or shuffled.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, written

WINDOW = 8


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    spaced = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(spaced, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.array_join(words(text), "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[#*$%&|<>]")), F.lit(0)).cast("long")


def n_capitals(text: Column) -> Column:
    """Capital letters below U+0100."""
    return F.coalesce(F.regexp_count(text, F.lit("[A-Z\\xC0-\\xD6\\xD8-\\xDE]")), F.lit(0)).cast("long")


def n_digits(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[0-9]")), F.lit(0)).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_lines(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    return let(lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Of an array of words: how many are in windows of so many words that it has twice or more, the first time included.

    Windows are compared by a 64-bit hash, doubled up from hashes of 1, 2 and 4 words (``window`` is a power of two).
    """

    def covered(starts: Column) -> Column:
        """Words in the windows that begin at the sorted ``starts``."""
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        return F.aggregate(starts, zero, lambda a, p: F.struct((a.n + p + window - F.greatest(a.end, p)).alias("n"), (p + window).alias("end")), lambda a: a.n)

    def twice(found: Column) -> Column:
        """``found``: (hash, start) of each window, sorted."""
        both = F.zip_with(F.slice(found, 1, F.size(found) - 1), F.slice(found, 2, F.size(found) - 1), lambda a, b: F.when(a.h == b.h, F.array(a.i, b.i)))
        return covered(F.array_sort(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull())))))

    def doubled(h: Column, width: int) -> Column:
        """Hashes of windows twice as wide as those in ``h``."""
        pairs = let(h, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - width), F.slice(x, width + 1, F.size(x) - width), lambda a, b: F.xxhash64(a, b)))
        return pairs if 2 * width == window else doubled(pairs, 2 * width)

    some = let(doubled(F.transform(w, lambda x: F.xxhash64(x)), 1), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)))
    return F.when(F.size(w) <= window, 0).otherwise(some).cast("long")


def n_repeat_words(text: Column) -> Column:
    return let(words(text), lambda w: repeated_words(w))


FIGURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_capitals": n_capitals, "n_digits": n_digits, "n_lines": n_lines, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


def base_figures(text: Column) -> Column:
    """A struct of the base figures, the words split once."""
    return let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), n_symbols(text).alias("n_symbols"), n_dup_lines(text).alias("n_dup_lines"), repeated_words(w).alias("n_repeat_words")))


@dataclass(frozen=True)
class Rule:
    """Rejects a text if ``rejects`` is true; ``rejects`` is given a function from the name of a figure to its column."""

    name: str
    rejects: object


def rules() -> list[Rule]:
    """The rules beside the base ones; limits are generous, for texts in any language with spaces between words."""
    return [
        Rule("words_too_short", lambda f: f("word_chars") * 2 < f("n_words") * 3),
        Rule("words_too_long", lambda f: f("word_chars") > 20 * f("n_words")),
        Rule("too_many_symbols", lambda f: f("n_symbols") * 4 > f("n_words")),
        Rule("too_many_dup_lines", lambda f: 2 * f("n_dup_lines") > f("n_lines")),
        Rule("shouting", lambda f: 2 * f("n_capitals") > f("word_chars")),
        Rule("mostly_digits", lambda f: 2 * f("n_digits") > f("word_chars")),
    ]


def base_rules() -> list[Rule]:
    return [Rule("too_few_words", lambda f: f("n_words") < 20), Rule("repeats", lambda f: 100 * f("n_repeat_words") > 30 * f("n_words"))]


def from_text(text: Column):
    return lambda name: FIGURES[name](text)


def measured_order(docs: DataFrame, text_col: str, given: list[Rule], sample_rows: int = 2000, seed: int = 7) -> list[Rule]:
    """The rules by rejections per second on a sample of about ``sample_rows`` rows (a bound, whatever the size of the table)."""
    total = docs.count()
    if total == 0:
        return list(given)
    sample = written(docs.select(F.col(text_col).alias("t")).sample(min(1.0, sample_rows / total), seed))
    worth = []
    for rule in given:
        began = time.perf_counter()
        rejected = sample.agg(F.count_if(F.coalesce(rule.rejects(from_text(F.col("t"))), F.lit(False)))).first()[0]
        worth.append((-(rejected + 0.5) / (time.perf_counter() - began), rule.name, rule))
    return [x[-1] for x in sorted(worth, key=lambda x: x[:2])]


def verdict(figure, ordered: list[Rule]) -> Column:
    """False at the first rule that rejects; later rules and their figures aren't evaluated then."""
    out = None
    for rule in ordered:
        rejects = F.coalesce(rule.rejects(figure), F.lit(False))
        out = F.when(rejects, F.lit(False)) if out is None else out.when(rejects, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def cascade(docs: DataFrame, text_col: str = "text", given: list[Rule] | None = None, sample_rows: int = 2000) -> DataFrame:
    """``docs`` without the rejected rows, all columns kept; null texts count as empty."""
    ordered = measured_order(docs, text_col, base_rules() + rules() if given is None else given, sample_rows)
    return docs.where(verdict(from_text(F.col(text_col)), ordered))


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of ``docs``.

    Null and empty texts have no words and fail. Repeated rows and ids are each judged. Other columns aren't read.
    """
    ordered, t = measured_order(docs, text_col, rules(), sample_rows), F.col("t")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def judged(f: Column) -> Column:
        failed = (f.n_words < 20) | (100 * f.n_repeat_words > 30 * f.n_words)
        known = lambda name: f[name] if name in names else FIGURES[name](t)
        return F.struct(*(f[x].alias(x) for x in names), failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(verdict(known, ordered)).alias("kept"))

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t")).select("doc_id", F.inline(F.array(let(base_figures(t), judged))))
