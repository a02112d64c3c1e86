"""Duplicate checks of statement images and rows: exact hashes, row-set overlap, perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import ordered


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 0 if either is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def sign_bits(v: Column) -> Column:
    """The signs of up to 64 components as the bits of a long, the first one lowest."""
    bits = F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def circular_neighbours(df: DataFrame, group: str, order: str) -> DataFrame:
    """Each row of a group with two or more paired with the next, the last with the first. Groups may be of any size."""
    near = ordered.neighbours(df.select(group, order), [group], [order], [order], circular=True)
    return near.where("group_size > 1").select(group, F.col(order).alias("original"), F.col("after")[order].alias("candidate"))


def sweep(pairs: DataFrame, thresholds: tuple[float, ...] = (0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """(threshold, recall, false_positive_rate, sha_recall, mean_jaccard): pairs hold kind (variant or negative),
    jaccard and same_sha; a pair fires if the hashes match or the overlap reaches the threshold. The overlap is
    computed once; the thresholds are an array of literals."""
    each = pairs.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    fired = (F.col("same_sha") | (F.col("jaccard") >= F.col("threshold"))).cast("double")
    variant = F.col("kind") == "variant"
    return each.groupBy("threshold").agg(F.avg(F.when(variant, fired)).alias("recall"), F.avg(F.when(~variant, fired)).alias("false_positive_rate"), F.avg(F.when(variant, F.col("same_sha").cast("double"))).alias("sha_recall"), F.avg("jaccard").alias("mean_jaccard"))
