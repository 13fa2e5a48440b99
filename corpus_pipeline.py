"""From raw documents to packed training sequences, each stage one operator; every stage is written and reread as Parquet.

Columns other than doc_id, text, lang, source and n_chars are handed on untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, table
from loomgraph.llm.linededup import dedup_lines
from loomgraph.llm.mixing import cycled_weights, mix, repeated
from loomgraph.llm.packing import pack
from loomgraph.llm.queries import tokenizer_files
from loomgraph.llm.simhash import one_of_each
from loomgraph.llm.toxicity import non_toxic


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text; null texts have a null."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model takes for toxic go.

    Null and empty texts stay (no word speaks against them); long ones are judged whole; rows that repeat an id or all are judged each
    by its own text; without labelled rows all stay; no rows give no rows.
    """
    return non_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines go that an earlier document has, equal or near; every document stays, if only as an empty text.

    Null texts stay null. Rows with one id count as one document, rows without one come first; of near lines that begin in one document
    the greater text goes; no rows give no rows.
    """
    return _recounted(dedup_lines(docs).select("doc.*"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; texts that share an id are told apart.

    Null and wordless texts are one group. Rows without an id come last in their group. Of rows equal in id and text one stays; no rows
    give no rows.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for, the last time perhaps only its first words.

    Null sources are a source of their own. Documents without words, null texts among them, stay once. Equal rows share alike. No
    rows give no rows.
    """
    return _recounted(repeated(docs, mix(docs, cycled_weights(docs))))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens.

    Null texts count as empty: their end id alone. Rows that repeat an id or all are packed each by itself; long texts are cut; no rows
    give no rows.
    """
    return pack(docs, *tokenizer_files())


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("packing", packing)]

#: A trained model, 64-bit hashes of another kind and a tokenizer: SQL can't express them. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
