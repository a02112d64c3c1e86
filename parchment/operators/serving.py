"""Latency and cost of serving, parity of two servings, capability levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latency(df: DataFrame, keys: list[str], value: str, *shares: float) -> DataFrame:
    """(keys, n, mean, p50, ...): exact percentiles, linear between rows, of non-null values."""
    known = F.col(value).isNotNull()
    return df.where(known).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), *(F.percentile(value, F.lit(s)).alias(f"p{round(100 * s)}") for s in shares))


def summary(df: DataFrame, keys: list[str], error: str, value: str) -> DataFrame:
    """(keys, pages, errors, error_rate, mean, p95): latency of rows without an error."""
    good = F.when(F.col(error).isNull(), F.col(value))
    return df.groupBy(*keys).agg(F.count("*").alias("pages"), F.count(error).alias("errors"), (F.count(error) / F.count("*")).alias("error_rate"), F.avg(good).alias("mean"), F.percentile(good, F.lit(0.95)).alias("p95"))


def integral(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """(keys, area): a step function's integral over seconds; each value holds until the next row."""
    nxt = F.lead(at).over(Window.partitionBy(*keys).orderBy(at))
    seconds = (F.unix_micros(nxt) - F.unix_micros(F.col(at))) / 1e6
    return df.withColumn("_s", seconds).groupBy(*keys).agg(F.sum(F.col("_s") * F.col(value)).alias("area"))


def cost_per_page(seconds: Column, price_per_hour: Column, pages: Column) -> Column:
    return F.try_divide(seconds * price_per_hour / 3600, pages)


def met(value: Column, target: float) -> Column:
    """met or missed; null misses."""
    return F.when(value <= target, "met").otherwise("missed")


def level(flags: Column) -> Column:
    """yes, partial or no (an aggregate): all, any or none of the flags."""
    return F.when(F.bool_and(flags), "yes").when(F.bool_or(flags), "partial").otherwise("no")


def matrix(rows: DataFrame, capability: str, model: str, flags: str, models: list[str]) -> DataFrame:
    """(capability, one column a model): levels; a model without rows for a capability has no."""
    per = rows.groupBy(capability).pivot(model, models).agg(level(F.col(flags)))
    return per.na.fill("no", models)


def looped(tokens: Column, most: int) -> Column:
    return F.size(tokens) >= most


def parity(pairs: DataFrame, keys: list[str], a: str, b: str, tolerance: float = 0.01) -> DataFrame:
    """(keys, n, max_diff, comparable): two scores of each row agree within a tolerance."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.max(F.abs(F.col(a) - F.col(b))), 6).alias("max_diff")).withColumn("comparable", (F.col("n") > 0) & (F.col("max_diff") <= tolerance))


def slo(cold_p95: Column, page_p50: Column, page_p95: Column, targets: tuple[float, float, float]) -> Column:
    """met if all three are within their targets; missed if any isn't, or isn't known."""
    ok = (cold_p95 <= targets[0]) & (page_p50 <= targets[1]) & (page_p95 <= targets[2])
    return F.when(F.coalesce(ok, F.lit(False)), "met").otherwise("missed")


def cold_starts(runs: DataFrame, keys: list[str], seconds: str, failures: str) -> DataFrame:
    """(keys, n, p50, p95) of starts without failures, to a tenth of a second; keys without any have n 0 and nulls."""
    good = F.when(F.coalesce(F.size(failures), F.lit(0)) <= 0, F.col(seconds))
    return runs.groupBy(*keys).agg(F.count(good).alias("n"), *(F.bround(F.percentile(good, F.lit(q)), 1).alias(f"p{round(q * 100)}") for q in (0.5, 0.95)))


def page_latency(pages: DataFrame, keys: list[str], error: str, tokens: str, latency_ms: str, most: int, digits: int | None = 2) -> DataFrame:
    """(keys, pages, errors, loop_pages, loop_max_s, page_p50_s, page_p95_s, all_p50_s, all_p95_s): seconds of pages without
    an error, those that ran into the token limit apart. Percentiles have so many digits; None leaves them as they are, for
    callers that round themselves, as rounding twice can end on another figure."""
    ok, loop, s = F.col(error).isNull(), looped(F.col(tokens), most), F.col(latency_ms) / 1000
    rounded = lambda c: c if digits is None else F.bround(c, digits)
    q = lambda on, share, name: rounded(F.percentile(F.when(on, s), F.lit(share))).alias(name)
    return pages.groupBy(*keys).agg(
        F.count("*").alias("pages"), F.count(error).alias("errors"), F.count_if(ok & loop).alias("loop_pages"), F.bround(F.max(F.when(ok & loop, s)), 1).alias("loop_max_s"),
        q(ok & ~loop, 0.5, "page_p50_s"), q(ok & ~loop, 0.95, "page_p95_s"), q(ok, 0.5, "all_p50_s"), q(ok, 0.95, "all_p95_s"),
    )


def throughput(pages: DataFrame, keys: list[str], seconds: str, concurrency: str, rate: float | None = None) -> DataFrame:
    """(keys, n, p50, p95, p99, pages_per_hour, gpu_hours_per_1000, cost_per_1000) of one GPU that serves `concurrency`
    pages at once; without a rate there is no cost."""
    per = latency(pages, [*keys, concurrency], seconds, 0.5, 0.95, 0.99)
    hourly = F.try_divide(F.lit(3600) * F.col(concurrency), F.col("mean"))
    hours = F.try_divide(F.lit(1000.0), hourly)
    cost = F.lit(None).cast("double") if rate is None else hours * rate
    return per.select(*keys, concurrency, "n", "p50", "p95", "p99", hourly.alias("pages_per_hour"), hours.alias("gpu_hours_per_1000"), cost.alias("cost_per_1000"))


def billed_workers(counts: Column, cap: int | None = None) -> Column:
    """Running and initializing workers of a map of counts by state, at most cap."""
    n = F.coalesce(counts["running"], F.lit(0)) + F.coalesce(counts["initializing"], F.lit(0))
    return n if cap is None else F.least(n, F.lit(cap))


def top_price(gpus: DataFrame, pools: list[str], excluded: list[str], price: str = "price") -> DataFrame:
    """(price): the highest among the GPUs (pool, id) of the pools that aren't excluded."""
    return gpus.where(F.col("pool").isin(*pools) & ~F.col("id").isin(*excluded)).agg(F.max(price).alias(price))


def serving_parity(rows: DataFrame, tolerance: tuple[float, float, float, float] = (0.02, 0.01, 0.05, 0.01)) -> DataFrame:
    """One row: whether two servings of a model read alike. rows: cer (of one text against the other), a_error, b_error,
    a_score, b_score. Limits: share of errors on either side (none alone by more than one row), median and 95th percentile
    of cer, and difference of mean scores."""
    e, median, tail, mean = tolerance
    a, b = F.col("a_error").isNotNull(), F.col("b_error").isNotNull()
    r = rows.agg(
        F.count("*").alias("n"), F.avg(a.cast("double")).alias("a_errors"), F.avg(b.cast("double")).alias("b_errors"), F.count_if(a & ~b).alias("a_alone"), F.count_if(b & ~a).alias("b_alone"),
        F.percentile(F.when(~a & ~b, F.col("cer")), F.lit(0.5)).alias("cer_median"), F.percentile(F.when(~a & ~b, F.col("cer")), F.lit(0.95)).alias("cer_p95"),
        F.abs(F.avg("a_score") - F.avg("b_score")).alias("score_gap"),
    )
    ok = (F.greatest("a_errors", "b_errors") <= e) & (F.greatest("a_alone", "b_alone") <= 1) & (F.col("cer_median") <= median) & (F.col("cer_p95") <= tail) & (F.col("score_gap") <= mean)
    return r.withColumn("passed", F.coalesce(ok, F.lit(False)))


def vote(readings: DataFrame, keys: list[str], reader: str, text: str) -> DataFrame:
    """(keys, readers, text, state): agree, majority (two of three or more), single_source or disputed; the
    alphabetically first reader's text stands where they dispute."""
    counts = readings.groupBy(*keys, text).agg(F.count("*").alias("_n"), F.min(reader).alias("_r"))
    per = counts.groupBy(*keys).agg(F.sum("_n").alias("readers"), F.count("*").alias("_kinds"), F.max(F.struct("_n", F.col(text).alias("t"))).alias("_top"), F.min(F.struct("_r", F.col(text).alias("t"))).alias("_first"))
    many = F.col("_top._n") * 2 > F.col("readers")
    state = F.when(F.col("readers") == 1, "single_source").when(F.col("_kinds") == 1, "agree").when(many, "majority").otherwise("disputed")
    return per.select(*keys, "readers", F.when(many, F.col("_top.t")).otherwise(F.col("_first.t")).alias("text"), state.alias("state"))
