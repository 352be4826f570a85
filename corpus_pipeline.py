"""The corpus pipeline: quality rules, near-duplicates, personal data,
mixing, packing. Every stage takes (spark, docs, sf_dir) and works on all
that its predecessor kept; its result is written as Parquet to the shared
folder and read again as the next one's ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushwin.llm import mixing, neardup, packing, pii, quality
from hushwin.llm.common import scope, staged, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.kept_rows(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates."""
    return neardup.kept_rows(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return pii.mask_rows(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it."""
    return mixing.mixed_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: one row per piece, with its token ids."""
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_stage), ("near-duplicates", near_duplicate_stage), ("personal data", personal_data_stage),
          ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

#: Expectation-maximisation, hashing of shingle sets and token ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark):            # what a stage wrote for itself goes when its result is written
            docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
