"""Bounded samples of labelled documents, to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

#: Labelled rows that a classifier learns from at most: those with the smallest hashes of their doc_id.
FIT_ROWS = 8000


def labelled_sample(labels: DataFrame, label: str, folds: int, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, label): at most `rows` labelled documents outside the held-out fold (crc32(doc_id) mod folds is 0).

    Null labels and null ids are left out; repeated labels of one document count once, the larger label wins.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (crc_mod("doc_id", folds) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
