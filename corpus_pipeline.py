"""The corpus pipeline: five filtering and encoding stages over ``documents``.

Every stage works on all that its predecessor kept; stages are written as
Parquet and read again in between.  All but the last return the columns they
were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm.bpe import token_digests
from brindle.llm.decontamination import without_leaks
from brindle.llm.ngram_join import keep_one
from brindle.llm.quality_rules import keep_good
from brindle.llm.queries import table, vocabulary_path
from brindle.llm.scratch import Scratch
from brindle.llm.ship import ship
from brindle.llm.toxicity import train_toxicity, without_toxic


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    ship(spark)
    return keep_good(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents predicted toxic, by a model of the labelled ones among ``docs``."""
    return without_toxic(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ship(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    ship(spark)
    return token_digests(docs, vocabulary_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("decontamination", decontamination),
    ("bpe", bpe),
]

#: A learnt model decides in the second stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
