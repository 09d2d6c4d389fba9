"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, leaks of the benchmark, packing.

Each stage takes what its predecessor kept; all but the last return the columns of documents, the last the packing.
Every stage takes nulls in any column, empty and very long texts, repeated rows, an empty table and extra columns of any
name: what it makes of them is said at the operator that it calls and, in short, at the stage. The stages whose result
comes from Python workers set Arrow batches of 4 MB for the session, as the batches lie beside a heap that is full by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratal.llm import decontamination, jaccard_join, packing, quality, toxicity
from stratal.llm.common import fresh_path, keep_batches_small


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier of quality rejects.

    A null or empty text is scored as one without words, a long one whole; rows that repeat an id or a text are judged
    alike; columns are passed on as they are; without labels of both classes none is rejected or, if all are bad, all.
    """
    keep_batches_small(spark)
    return quality.good(docs, _table(spark, sf_dir, "labels"))


def toxicity_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that are predicted toxic; nulls, long texts, repeats and columns as in the first stage."""
    keep_batches_small(spark)
    return toxicity.not_toxic(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each group of near copies: five words, a similarity of 0.8.

    Rows without an id link like any other; rows that agree in id and text are one; texts without words all stay.
    """
    return jaccard_join.one_of_each_group(docs, width=5, percent=80)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold an item of the benchmark, in whatever order its parts stand.

    Null and empty texts hold none; an empty benchmark drops nothing; repeated rows meet one fate; columns stay.
    """
    keep_batches_small(spark)
    return decontamination.decontaminated(docs, _table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 1024 tokens; a smaller memory of pieces, as the executor's heap is full by now.

    A null text is an empty one (its end token alone); repeated and null ids are documents of their own.
    """
    return packing.pack(docs, memo_pieces=80_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity_classifier", toxicity_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # SQL can't express the trained models and the tokenizer; the tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each but the last written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
