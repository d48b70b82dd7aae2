"""Documents to packed sequences: five stages, each written as Parquet and read again.

Every stage takes null ids and texts, empty and very long texts, repeated rows and empty tables;
what it does with them stands in its docstring. Columns beyond those of documents are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import line_dedup, packing, quality_rules, simhash, toxicity
from tidelog.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model doesn't predict toxic. Null and empty texts score 0 and stay;
    repeated rows stay or go together."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(COLUMNS)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the cascade. Null and empty texts fail and go; repeated
    rows stay or go together."""
    return quality_rules.kept_rows(docs.select(COLUMNS))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; later repeated runs of lines are gone from their texts. A text that repeats
    others as a whole becomes empty and stays; rows with the same id and text count as one."""
    return line_dedup.line_dedup(docs).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group (a null id only where all are
    null). Empty texts are copies of each other; of repeated rows one stays."""
    return simhash.deduplicated(docs).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its sequence and place there. An empty or null text is
    one piece with the end alone; repeated rows are packed each on their own."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality rules", reject_low_quality),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack),
]

#: No SQL expresses a trained model or the tokenizer; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
