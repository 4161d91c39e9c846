"""Labelled rows for the two classifiers: the fold that learns, and a bounded sample of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose crc32(doc_id as text) has this remainder by four are never learned from.
HELD_OUT = 2


def held_out(doc_id: Column) -> Column:
    """Whether the row is left out of learning; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == HELD_OUT, F.lit(False))


def learning_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the learning rows; an id with several labels takes the lower."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min("label").alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, label, text) of at most ``per_class`` learning rows of each class, and the class sizes.

    Rows are taken in the order of a hash of the id, so the sample does not depend on how the
    tables are split.  The ids are at most twice ``per_class``: that bounds their broadcast.
    Of rows that repeat an id the lowest text is taken.
    """
    rows = learning_labels(labels, label)
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    part = [
        rows.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)
    ]
    ids = F.broadcast(part[0].unionByName(part[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = texts.join(ids, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found, sizes
