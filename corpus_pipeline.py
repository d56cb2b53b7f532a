"""A corpus pipeline: STAGES in order, each on what the one before it kept."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docvalid.llm import mixing, ngram_join, packing, pii, toxicity
from docvalid.llm.shared import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` whose text the factorization machine doesn't score as toxic."""
    machine = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, machine)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect: that with the smallest doc_id; all without words."""
    return ngram_join.one_of_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values in their texts; n_chars counts the new text.

    The key is the session's; without one a warning says that the public one of tests is used.
    """
    if (key := spark.conf.get(pii.SETTING, None)) is None:
        warnings.warn(f"{pii.SETTING} is not set: pseudonyms under the public key can be undone", stacklevel=2)
        key = pii.KEY
    new = pii.pseudonymise(docs, key)
    return new.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times."""
    return mixing.take(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", one_of_near_copies),
    ("pii", pseudonyms),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL has no factorization machine, Feistel permutation or tokenizer: tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
