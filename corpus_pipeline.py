"""A corpus pipeline in stages, each of which applies one operator of tidewheel.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import exact, mixing, ngram_join, packing, repetition
from tidewheel.llm.common import cut, fresh, quoted, shared_path
from tidewheel.llm.queries import tokenizer_path
from tidewheel.llm.warc import delete_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; the others go."""
    prefix = fresh([c[: len("quality_")] for c in docs.columns], "quality_")
    judged = repetition.quality_rules(docs, prefix=prefix)
    return judged.filter(F.col(f"{prefix}kept")).select(*[F.col(quoted(c)) for c in docs.columns])


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.unique_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the row with the smallest doc_id stays."""
    return ngram_join.one_of_each_class(docs, spread=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target weights: documents come once, more often, or not at all."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.packed_digests(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("source_mixing", mixture),
    ("mixture_packing", packed),
]

#: SQL can't express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, materialised. Stages hand their rows on as Parquet in the shared folder."""
    docs, folders = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    try:
        for _, stage in STAGES[:-1]:
            folders.append(shared_path(spark, "stage"))
            stage(spark, docs, sf_dir).write.parquet(folders[-1])
            docs = spark.read.parquet(folders[-1])
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        for folder in folders:
            delete_folder(folder)
