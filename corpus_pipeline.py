"""The training-data pipeline: each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import mixing, quality
from veilframe.llm.common import saved, table
from veilframe.llm.exact_dedup import exact_dedup
from veilframe.llm.near_dedup import near_dedup
from veilframe.llm.packing import pack
from veilframe.llm.queries import domains_of

# Shares of tokens that the corpus is mixed to, whatever its own mix; the labelled table names the domains. The unwanted
# domains' shares are upper bounds: a corpus that has less of them already keeps its mix.
TARGETS = {"clean": 0.97, "toxic": 0.03, "low": 0.0}
UNWANTED = ("toxic", "low")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the discriminant, fitted on the labelled rows among them, finds good stay."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays: the one with the largest id."""
    return exact_dedup(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates stays."""
    return near_dedup(docs)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their domains are wanted: clean ones at least once, since their share never goes down."""
    mixed = mixing.mix(docs, domains_of(table(spark, sf_dir, "labels")), TARGETS, at_most=UNWANTED)
    return mixing.apply_mix(docs, mixed)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", reject_low_quality),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

# Learned models and iterative fits are not SQL; tests compare the stages with brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
