"""Exact percentiles of groups of any size, by refining histograms.

Doubles map to 64-bit whole numbers of the same order. A pass counts the rows of a group by the next bits of that number,
map-side first; the count up to each bin tells in which one a wanted rank lies, and only rows of such bins go on. So a task
holds bins, never a group's values, and what is left shrinks by the number of bins a pass. Where few rows are left of every
wanted bin they are sorted; a value that very many rows share is told by its bits alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..sources.scratch import keep

KEY = "_key"
#: Bits of a pass, and up to how many rows of a bin are sorted at once.
BITS, FEW = 12, 10_000
TOP = np.int64(-(2**63))


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 (unsigned, in int64) in the order of doubles; -0.0 counts as 0.0, NaN as the largest."""
    bits = (np.asarray(x, float) + 0.0).view(np.int64)
    bits = np.where(np.isnan(x), np.int64(0x7FF8000000000000), bits)
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)) ^ TOP


def doubles(bits: np.ndarray) -> np.ndarray:
    """The inverse of ordered_bits()."""
    bits = np.asarray(bits, np.int64) ^ TOP
    return (bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))).view(float)


@F.arrow_udf(LongType())
def _bits(x: pa.Array) -> pa.Array:
    return pa.array(ordered_bits(x.to_numpy(zero_copy_only=False)), mask=np.asarray(x.is_null()))


@F.arrow_udf(DoubleType())
def _doubles(x: pa.Array) -> pa.Array:
    return pa.array(doubles(x.to_numpy(zero_copy_only=False)), mask=np.asarray(x.is_null()))


def _prefix(bits: Column, known: int) -> Column:
    """The leading bits of a number."""
    return F.shiftrightunsigned(bits, 64 - known) if known else F.lit(0).cast("long")


def at_ranks(rows: DataFrame, ranks: DataFrame, bits: int = BITS, few: int = FEW) -> DataFrame:
    """(_key, rank, value): the values at wanted ranks (from 0) of groups. rows: _key, value, none null; ranks: _key, rank."""
    rows = rows.select(KEY, "value", _bits("value").alias("_b"))
    wanted = ranks.select(KEY, "rank", F.lit(0).cast("long").alias("_p"), F.col("rank").alias("_left"))
    known = 0
    while True:
        step = min(bits, 64 - known)
        bins = rows.groupBy(KEY, _prefix(F.col("_b"), known).alias("_p"), _prefix(F.col("_b"), known + step).alias("_q")).agg(F.count("*").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(KEY, "_p").orderBy("_q"))
        bins = bins.select(KEY, "_p", "_q", "_n", upto.alias("_upto"))
        inside = (F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_n"))
        wanted = keep(wanted.join(bins, [KEY, "_p"]).where(inside).select(KEY, "rank", F.col("_q").alias("_p"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_n"), "ranks")
        known += step
        if known == 64:
            return wanted.select(KEY, "rank", _doubles("_p").alias("value"))
        most = wanted.agg(F.max("_n")).first()[0]
        bins = wanted.select(KEY, "_p").distinct()
        wanted = wanted.drop("_n")
        rows = rows.withColumn("_p", _prefix(F.col("_b"), known)).join(bins, [KEY, "_p"])
        if most is None or most <= few:
            held = rows.groupBy(KEY, "_p").agg(F.sort_array(F.collect_list("value")).alias("_v"))
            return wanted.join(held, [KEY, "_p"]).select(KEY, "rank", F.get("_v", F.col("_left").cast("int")).alias("value"))
        rows = keep(rows.drop("_p"), "left")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float], bits: int = BITS, few: int = FEW) -> DataFrame:
    """(keys, n, share, value): percentiles, linear between rows, of non-null values, bit by bit what percentile() gives.
    Null keys are a group; groups without values have no rows."""
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias(KEY), F.col(value).cast("double").alias("value"))
    sizes = keep(rows.groupBy(KEY).agg(F.count("*").alias("n")), "sizes")
    place = sizes.select(KEY, "n", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("_at", (F.col("n") - 1) * F.col("share"))
    place = place.withColumns({"_lo": F.floor("_at"), "_hi": F.ceil("_at")})
    ranks = place.select(KEY, F.explode(F.array("_lo", "_hi")).alias("rank")).distinct()
    found = at_ranks(rows, ranks, bits, few)
    side = lambda c: found.select(KEY, F.col("rank").alias(c), F.col("value").alias(f"{c}_v"))
    both = place.join(side("_lo"), [KEY, "_lo"]).join(side("_hi"), [KEY, "_hi"])
    mixed = (F.col("_hi") - F.col("_at")) * F.col("_lo_v") + (F.col("_at") - F.col("_lo")) * F.col("_hi_v")
    return both.select(f"{KEY}.*", "n", "share", F.when((F.col("_lo") == F.col("_hi")) | (F.col("_lo_v") == F.col("_hi_v")), F.col("_lo_v")).otherwise(mixed).alias("value"))
