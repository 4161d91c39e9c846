"""Pipeline from raw documents to sampled segmentations, stage by stage.

Each stage takes the documents its predecessor kept, and its decisions take effect: rejected,
duplicate and contaminated documents go, repeated strings are cut out.  Between stages the
documents are written to the shared folder and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paddock.llm import containment, near_dedup, neighbours, piece_lattice, suffix_dedup
from paddock.scratch import materialise
from paddock.session import configure

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled documents vote for."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return neighbours.accepted(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: similarity 0.8 on shingles of five words."""
    return near_dedup.one_of_each(docs, words=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that occur elsewhere: passages of some 50 short words are that long."""
    return suffix_dedup.without_repeats(docs, length=200)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return containment.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, with their inclusion scores."""
    return piece_lattice.sampled_segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("segment", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; the last one's rows are computed when they are read."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
