"""Toxicity by a classifier chain.

One linear (logistic) model per category, in a fixed order; each sees the words of the text and the probabilities of the
categories before it. In training those probabilities are out-of-fold, so later models learn how far earlier ones can be
trusted. Features are words and word beginnings, once per text, chosen by their association with any category.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from loomgraph.llm.common import workers_find_us

_WORD = re.compile(r"\w+")
#: Lengths of the word beginnings that are features beside whole words.
HEADS = (4, 5, 6)


def features(text: str | None) -> set[str]:
    """Words in lower case and, marked by a star, their beginnings; null has none."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "*" for w in words for n in HEADS if len(w) > n}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    index: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)
    """One per category: of the features, of the categories before it, and the bias."""

    def probabilities(self, rows: np.ndarray, cols: np.ndarray, n: int) -> np.ndarray:
        """[texts, categories] from the (row, feature) pairs of the texts."""
        out, size = np.zeros((n, len(self.categories))), len(self.index)
        for c, w in enumerate(self.weights):
            out[:, c] = sigmoid(np.bincount(rows, weights=w[cols], minlength=n) + out[:, :c] @ w[size : size + c] + w[-1])
        return out

    def pairs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rows, cols, index = [], [], self.index
        for i, t in enumerate(texts):
            words = set(_WORD.findall((t or "").lower()))
            found = {index[w] for w in words if w in index}
            for n in HEADS:
                found.update(index[h] for h in {w[:n] + "*" for w in words if len(w) > n} if h in index)
            cols += found
            rows += [i] * len(found)
        return np.array(rows, np.int64), np.array(cols, np.int64)


def _fit(rows: np.ndarray, cols: np.ndarray, before: np.ndarray, y: np.ndarray, size: int, rounds: int = 120, l2: float = 2e-4, rate: float = 0.25) -> np.ndarray:
    """Logistic regression by Adam on the whole (bounded) sample; deterministic."""
    n, k = len(y), before.shape[1]
    w, m, v = np.zeros(size + k + 1), np.zeros(size + k + 1), np.zeros(size + k + 1)
    if y.sum() == 0:  # nothing to learn from: never
        w[-1] = -30.0
        return w
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    for t in range(1, rounds + 1):
        p = sigmoid(np.bincount(rows, weights=w[cols], minlength=n) + before @ w[size : size + k] + w[-1])
        e = (p - y) / n
        g = np.concatenate([np.bincount(cols, weights=e[rows], minlength=size), before.T @ e, [e.sum()]]) + l2 * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def train(texts: list[str | None], labels: np.ndarray, categories: list[str], size: int = 3000, folds: int = 3) -> Chain:
    """``labels`` is [texts, categories] of 0 and 1. The ``size`` features most tied to a category are kept."""
    count, by = Counter(), [Counter() for _ in categories]
    for t, y in zip(texts, labels, strict=True):
        f = features(t)
        count.update(f)
        for c in np.flatnonzero(y):
            by[c].update(f)
    n, best = len(texts), Counter()
    for c, found in enumerate(by):
        pos = int(labels[:, c].sum())
        for f, a in found.items():
            total = count[f]
            if a < 3 or a * n <= total * pos:
                continue
            b, d = total - a, pos - a
            rest = n - total - d
            chi = n * (a * rest - b * d) ** 2 / max(1.0, float(total) * pos * (n - total) * (n - pos))
            best[f] = max(best[f], chi)
    kept = [f for f, x in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:size] if x > 10.0]
    chain = Chain(list(categories), {f: i for i, f in enumerate(kept)})
    rows, cols = chain.pairs(texts)
    fold, before = np.arange(n) % folds, np.zeros((n, 0))
    for c in range(len(categories)):
        y, out = labels[:, c].astype(float), np.zeros(n)
        chain.weights.append(_fit(rows, cols, before, y, len(kept)))
        if c + 1 == len(categories):
            break
        for k in range(folds):
            inside, held = fold != k, fold == k
            at = np.cumsum(inside) - 1
            sel = inside[rows]
            w = _fit(at[rows[sel]], cols[sel], before[inside], y[inside], len(kept))
            logit = np.bincount(rows, weights=w[cols], minlength=n) + before @ w[len(kept) : len(kept) + c] + w[-1]
            out[held] = sigmoid(logit)[held]
        before = np.column_stack([before, out])
    return chain


def labelled_sample(docs: DataFrame, labels: DataFrame, categories: list[str], rows: int = 6000, seed: int = 10) -> tuple[list[str | None], np.ndarray]:
    """At most ``rows`` labelled texts, up to half of them in some category; a seeded, repeatable choice of whole texts.

    ``labels`` is (doc_id, one 0/1 column per category); of several rows of an id a 1 counts. Of several texts of an id the one with the
    smallest hash is taken. The bound is the only one; it concerns training alone and holds for what reaches the driver.
    """
    flags = [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in categories]
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(*flags).withColumn("any", F.greatest(*categories) if len(categories) > 1 else F.col(categories[0]))
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = known.where("any = 1").orderBy(order, "doc_id").limit(rows // 2).unionByName(known.where("any = 0").orderBy(order, "doc_id").limit(rows - rows // 2))
    text = F.col("text").cast("string")
    texts = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *categories).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    got = texts.select("doc_id", "text", *categories).limit(rows).toPandas().sort_values("doc_id", kind="stable")
    order = np.random.default_rng(seed).permutation(len(got))
    return [got["text"].iloc[i] for i in order], got[categories].to_numpy(np.int64)[order]


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """(doc, p): each row of ``docs`` as a struct, and its probabilities by category. Null texts score as empty."""
    workers_find_us(docs.sparkSession)
    given = docs.sparkSession.sparkContext.broadcast(chain)  # at most `size` words and their weights
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    schema = StructType([rows.schema["doc"], StructField("p", ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            p = given.value.probabilities(*given.value.pairs(texts), len(texts))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(list(p), type=pa.list_(pa.float64()))], names=["doc", "p"])

    return rows.mapInArrow(run, schema)


def by_language(docs: DataFrame, labels: DataFrame, languages: tuple[str, ...] = ("en", "de", "es", "fr")) -> tuple[DataFrame, list[str]]:
    """Labels of the categories toxic_<language>, then toxic, from labels(doc_id, toxic) and docs(doc_id, lang)."""
    both = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).join(docs.select("doc_id", "lang").distinct(), "doc_id")
    cats = [f"toxic_{x}" for x in languages]
    return both.select("doc_id", *(F.when(F.col("lang") == x, F.col("toxic")).otherwise(0).alias(c) for x, c in zip(languages, cats, strict=True)), "toxic"), [*cats, "toxic"]


def judged(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample_rows: int = 6000) -> DataFrame:
    """(doc, p_<category>..., toxic): each row of ``docs`` as a struct, the chain's probabilities (toxicity in each language, then
    overall), and whether p_toxic >= ``threshold``.

    Null and empty texts have no words and get what the model says of none. Without labelled rows nothing is toxic. Long texts are
    read whole. Repeated rows are each scored; names of other columns don't matter; no rows give no rows.
    """
    label_table, categories = by_language(train_docs, labels)
    texts, y = labelled_sample(train_docs, label_table, categories, sample_rows)
    scored = score(docs, train(texts, y, categories))
    out = scored.select("doc", *(F.col("p")[i].alias(f"p_{c}") for i, c in enumerate(categories)))
    return out.withColumn("toxic", F.col("p_toxic") >= threshold)


def non_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the chain, trained on those with a label, doesn't take for toxic."""
    return judged(docs, docs, labels, **options).where("not toxic").select("doc.*")
