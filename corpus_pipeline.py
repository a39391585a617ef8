"""A training-corpus pipeline: each stage works on all that the one before kept.

The result of each stage is written as Parquet to the shared folder and read again, so a
lost executor costs no more than the running stage. Empty tables and stages that keep
nothing give empty results with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from maintspark.llm.common import read, saved
from maintspark.llm.decontaminate import drop_contaminated
from maintspark.llm.jaccard_join import keep_one
from maintspark.llm.mixing import mix
from maintspark.llm.quality import keep_good
from maintspark.llm.token_store import op2_token_store


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items go."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, weighted to even out sources, languages and topics."""
    return mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of what is left: doc_id, start, n_tokens, ids_crc32."""
    return op2_token_store(spark, docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't express the classifier; the stages' operators have brute-force, round-trip or accuracy tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
