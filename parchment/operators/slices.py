"""Sliced means with clustered bootstrap intervals."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import keep


@dataclass(frozen=True)
class Slice:
    """One table: its name, key columns, and which rows it takes (None: all)."""

    table: str
    keys: tuple[str, ...]
    where: Column | None = None


def sliced(scores: DataFrame, slices: Sequence[Slice], metric: str = "metric", value: str = "value", cluster: str = "sample_id") -> DataFrame:
    """(table, keys..., metric, cluster, total, n): sums of each slice's clusters, one shuffle for all tables.

    Each row is expanded to the slices that take it; keys a table doesn't have are null there, which its name tells
    from null keys. Null values don't count; they go after the sums, as a filter on a value would work it out a second
    time."""
    names = list(dict.fromkeys(k for s in slices for k in s.keys))
    rows = [F.when(s.where if s.where is not None else F.lit(True), F.struct(F.lit(s.table).alias("table"), *((F.col(k) if k in s.keys else F.lit(None)).cast("string").alias(k) for k in names))) for s in slices]
    long = scores.select(F.explode(F.array_compact(F.array(*rows))).alias("s"), F.col(metric).alias("metric"), F.col(cluster).alias("cluster"), F.col(value).cast("double").alias("v"))
    return long.groupBy("s.table", *(F.col(f"s.{k}").alias(k) for k in names), "metric", "cluster").agg(F.sum("v").alias("total"), F.count("v").alias("n")).where("n > 0")


def means(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, mean, n, clusters): micro means over all values."""
    return clusters.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean"), F.sum("n").alias("n"), F.count("*").alias("clusters"))


def _interval(total: np.ndarray, n: np.ndarray, resamples: int, seed: int, alpha: float) -> tuple[float, float, float]:
    """Micro mean of clusters in order, and its percentile interval, which holds it."""
    rng, mean, means = np.random.default_rng(seed), float(total.sum() / n.sum()), []
    rows = max(1, (1 << 20) // len(n))  # resamples drawn at once; the generator goes on where it stopped
    for i in range(0, resamples, rows):
        pick = rng.integers(0, len(n), (min(rows, resamples - i), len(n)))
        means.append(total[pick].sum(1) / n[pick].sum(1))
    lo, hi = np.percentile(np.concatenate(means), [100 * alpha / 2, 100 * (1 - alpha / 2)])
    return mean, min(float(lo), mean), max(float(hi), mean)


def bootstrap_numpy(clusters: DataFrame, keys: Sequence[str], resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(keys, mean, n, lo, hi): percentile intervals of the micro mean, whole clusters resampled by numpy's default
    generator in the order of cluster names. A cell's clusters (sums only) are held by one task."""
    schema = clusters.select(*keys, F.lit(0.0).alias("mean"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).schema

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cluster")
        mean, lo, hi = _interval(pdf["total"].to_numpy(), pdf["n"].to_numpy(), resamples, seed, alpha)
        return pd.DataFrame([[*pdf.iloc[0][list(keys)], mean, pdf["n"].sum(), lo, hi]], columns=[*keys, "mean", "n", "lo", "hi"])

    return clusters.groupBy(*keys).applyInPandas(cell, schema)


def hashed_uniform() -> Column:
    """A number from 0 to under 1 by a hash of (cluster, r)."""
    return F.pmod(F.xxhash64("cluster", "r"), F.lit(1_000_000)) / 1e6


def digest_uniform() -> Column:
    """hashed_uniform() by MD5 of `cluster:r`, which other engines can work out as well; slower."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "cluster", "r").cast("binary")), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)


#: Where Poisson(1)'s distribution function passes to 1, 2, ..., 8.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(8)))


def bootstrap(clusters: DataFrame, keys: Sequence[str], resamples: int = 200, alpha: float = 0.05, uniform: Callable[[], Column] = hashed_uniform) -> DataFrame:
    """(keys, mean, n, lo, hi) without holding a cell: a Poisson bootstrap. Each cluster gets, in resample r, the
    weight that a hash of (cluster, r) draws from Poisson(1), so sums of any size aggregate in parts. A cluster isn't
    written out once a resample: Spark's partial sums take each expanded row as it comes, before anything is shuffled.
    Resample 0 weighs all clusters 1 and gives the mean, so that clusters are worked out once."""
    weight = F.lit(0)
    for k, acc in enumerate(POISSON, 1):
        weight = F.when(F.col("u") >= acc, k).otherwise(weight)
    r = clusters.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(resamples)))).withColumn("u", uniform())
    r = r.withColumn("w", F.when(F.col("r") == 0, 1).otherwise(weight))
    per = r.groupBy(*keys, "r").agg(F.try_divide(F.sum(F.col("total") * F.col("w")), F.sum(F.col("n") * F.col("w"))).alias("m"), F.sum("n").alias("n"))
    drawn, all_ = F.when(F.col("r") > 0, F.col("m")), F.col("r") == 0
    ends = per.groupBy(*keys).agg(F.max(F.when(all_, F.col("m"))).alias("mean"), F.max(F.when(all_, F.col("n"))).alias("n"), F.percentile(drawn, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return ends.select(*keys, "mean", "n", F.least("mean", F.col("q")[0]).alias("lo"), F.greatest("mean", F.col("q")[1]).alias("hi"))


def field_rates(fields: DataFrame) -> DataFrame:
    """Field rows as long rows: exact, fuzzy and lenient for all; false accepts where the truth is null, false
    rejects where it isn't."""
    null = F.col("gt").isNull()
    rows = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("field_exact", "field_fuzzy", "field_lenient")]
    rows += [F.when(null, F.struct(F.lit("fa_rate").alias("metric"), F.col("false_accept").cast("double").alias("value"))), F.when(~null, F.struct(F.lit("fr_rate").alias("metric"), F.col("false_reject").cast("double").alias("value")))]
    return fields.withColumn("_m", F.explode(F.array_compact(F.array(*rows)))).select("*", "_m.metric", "_m.value").drop("_m")


def paired_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], resamples: int = 200, alpha: float = 0.05, uniform: Callable[[], Column] = hashed_uniform) -> DataFrame:
    """Bootstrap of the difference of two runs' values, cluster by cluster; better if the interval excludes 0."""
    both = a.join(b.select(*keys, "cluster", F.col("total").alias("t2"), F.col("n").alias("n2")), [*keys, "cluster"])
    diff = both.select(*keys, "cluster", (F.col("total") / F.col("n") - F.col("t2") / F.col("n2")).alias("total"), F.lit(1).cast("long").alias("n"))
    out = bootstrap(diff, keys, resamples, alpha, uniform)
    return out.withColumn("verdict", F.when(F.col("lo") > 0, "better").when(F.col("hi") < 0, "worse").otherwise("same"))


#: The standard tables of scores and of fields. A metric of a task with one subtask alone has no subtask table.
FIELD_SLICES = (Slice("critical_model", ("is_critical", "model")),)


def standard_slices(scores: DataFrame) -> tuple[DataFrame, list[Slice]]:
    """scores with _subtasks, the number of distinct subtasks of their task, and the six tables over them."""
    many = scores.groupBy("task").agg(F.count_distinct("subtask").alias("_subtasks"))
    statement = F.col("task") == "statement"
    tables = [
        Slice("task_model", ("task", "model")), Slice("task_subtask_model", ("task", "subtask", "model"), F.col("_subtasks") > 1), Slice("condition_model", ("condition", "model")),
        Slice("task_condition_model", ("task", "condition", "model")), Slice("bank_doctype_model", ("bank", "doc_type", "model"), statement),
        Slice("domain_model", ("domain", "model"), ~statement & F.col("domain").isin("Government", "Finance")),
    ]
    return scores.join(F.broadcast(many), "task", "left"), tables  # one row a task


def aggregates(scores: DataFrame, keys: Sequence[str] = ("table", "task", "subtask", "model", "condition", "bank", "doc_type", "domain"), resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, metric, mean, n, lo, hi) of the standard tables, ordered by table and keys."""
    rows, tables = standard_slices(scores)
    # Ordering samples its rows in a pass of its own, so the few of them are written first.
    return keep(bootstrap_numpy(sliced(rows, tables), [*keys, "metric"], resamples, seed), "aggregates").orderBy(*keys, "metric")


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def interval(cluster: pa.Array, total: pa.Array, n: pa.Array) -> list[float]:
    """An aggregate, also for SQL text: mean, lo and hi of bootstrap_numpy() of a group's clusters, 1,000 resamples. Null
    sums don't count. A group's clusters are held by one task, as there."""
    rows = pa.table([cluster, total.cast(pa.float64()), n.cast(pa.int64())], names=["cluster", "total", "n"]).drop_null().sort_by("cluster")
    return list(_interval(rows.column("total").to_numpy(), rows.column("n").to_numpy(), 1000, 42, 0.05)) if len(rows) else []
