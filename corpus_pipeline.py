"""The corpus pipeline: five stages over ``documents``, each calling one operator.

Every stage reads what its predecessor kept as Parquet. All but the last return the
columns of documents; the last returns the packed pieces of the mixed corpus.

Defined results of every stage but the last: the rows that stay keep all their columns,
whatever their names, with their values; null texts count as empty; null ids are no ids
(such rows are never duplicates of others); very long texts are read whole; an empty
table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probelake.llm import mixing, near_dup, packing, quality_rules, toxicity
from probelake.llm.common import crc_mod, store


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules.

    Null and empty texts fail (too few words); repeated rows stay or go together.
    """
    return quality_rules.quality_filter(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; learned from labels outside the held-out fold.

    Without labels of both kinds nothing is rejected; a score of exactly 0.5 is; repeated
    rows stay or go together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels, crc_mod(F.col("id"), 5) != 0)
    return toxicity.drop_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: shingles of five words, a similarity of 0.8 or more.

    The smallest id stays; of rows that repeat id and text one stays; unlike texts of one
    id all stay.
    """
    return near_dup.drop_near_duplicates(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: 0, 1 or 2 times.

    A null source is a source of its own; repeated rows are documents of their own; ties
    of the seeded hash go by id.
    """
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their sequences.

    A null text has its end id only; repeated rows are packed each; null ids stay null.
    """
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: SQL can express neither the models nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result; each stage before is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
