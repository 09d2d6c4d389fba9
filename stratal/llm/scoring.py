"""What the two classifiers share: the bounded labelled sample, scores of whole texts, filtering by score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratal.llm.common import by_bytes, fold_held_out, local_rows, texts_of, written

MAX_TRAIN_ROWS = 8_000
MAX_TRAIN_CHARS = 20_000_000
SAMPLE_PARTS = 32


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN_ROWS, max_chars: int = MAX_TRAIN_CHARS) -> tuple[DataFrame, str]:
    """doc_id, text, label (0 or 1) of whole documents outside the held-out fold, in the order of a hash of the id: a row
    an id, max_rows of them at most, leaving out those with which max_chars characters would be exceeded; written, with
    its path.

    The ids are gathered on the driver and broadcast; max_rows bounds both. Of several texts of an id that of the least
    hash stands for it, of several labels the largest; null labels and labels without a document are left out.
    """
    spark = docs.sparkSession
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~fold_held_out(F.col("doc_id")))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    ids = F.broadcast(local_rows(spark, [(r["doc_id"], r["label"], k) for k, r in enumerate(chosen)], "doc_id long, label int, place int"))
    texts = texts_of(docs).withColumn("h", F.xxhash64("text"))
    least = texts.select("doc_id", "h", F.length("text").alias("n")).join(ids, "doc_id").groupBy("place").agg(F.min(F.struct("h", "n")).alias("r"))
    taken, reached = [], 0
    for place, (h, n) in sorted(least.collect()):
        if reached + n <= max_chars:
            reached += n
            taken.append((chosen[place]["doc_id"], h, chosen[place]["label"]))
    taken = F.broadcast(local_rows(spark, taken, "doc_id long, h long, label int"))
    found = texts.join(taken, ["doc_id", "h"]).groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
    return written(found.repartition(SAMPLE_PARTS), "sample")


def scored(docs: DataFrame, scorer, threshold: float, slice_bytes: int = 1_500_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; scorer() gives, on the executor, texts -> probabilities.

    Null texts are scored as empty ones, long ones whole; null and repeated ids are rows like any other (a null id is
    not held out), an empty table gives none and other columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        score = scorer()
        for batch in by_bytes(batches, limit=slice_bytes):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    out = texts_of(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(fold_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def kept_by_score(docs: DataFrame, scorer, keep, slice_bytes: int = 1_500_000) -> DataFrame:
    """The rows of docs, all columns whatever their names, whose score keep() accepts; nothing is shuffled.

    A null text is scored as an empty one and stays null; repeated rows meet one fate; an empty table stays empty.
    """
    column = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        score = scorer()
        for batch in by_bytes(batches, column=column, limit=slice_bytes):
            yield batch.filter(pa.array(keep(score([t or "" for t in batch.column(column).to_pylist()]))))

    return docs.mapInArrow(run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def temperature_of(margins: np.ndarray, target: np.ndarray) -> float:
    """The temperature that makes sigmoid(margin / temperature) likeliest, from a grid; 1 without rows."""
    if not len(margins):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [-np.mean(np.log(np.where(target == 1, sigmoid(margins / t), 1 - sigmoid(margins / t)) + 1e-12)) for t in grid]
    return float(grid[int(np.argmin(loss))])
