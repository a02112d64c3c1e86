"""Confidence: reliability, calibration error, bands, thresholds and logistic calibration."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import free_name
from .slices import bootstrap_numpy

# Bands of confidence, the last one closed.
BANDS = {5: (0.98, 1.0), 4: (0.90, 0.98), 3: (0.75, 0.90), 2: (0.50, 0.75), 1: (0.0, 0.50)}


def bin_of(conf: Column, bins: int = 10) -> Column:
    """The bin whose edges hold conf, by comparison with the edges themselves; 1.0 falls in the last."""
    out = F.lit(None).cast("int")
    for i in range(bins):
        upper = conf < (i + 1) / bins if i < bins - 1 else F.lit(True)
        out = F.when((conf >= i / bins) & upper, i).otherwise(out)
    return out


def reliability(df: DataFrame, conf: str, label: str, keys: list[str], bins: int = 10) -> DataFrame:
    """(keys, bin, n, accuracy, confidence), also for empty bins (n 0 and nulls)."""
    got = df.groupBy(*keys, bin_of(F.col(conf), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("accuracy"), F.avg(conf).alias("confidence"))
    every = got.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_error(bins: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ece): mean gap of accuracy and confidence, weighted by rows."""
    gap = F.col("n") * F.abs(F.coalesce(F.col("accuracy") - F.col("confidence"), F.lit(0.0)))
    return bins.groupBy(*keys).agg(F.coalesce(F.try_divide(F.sum(gap), F.sum("n")), F.lit(0.0)).alias("ece"))


def band_of(conf: Column) -> Column:
    """The number of the band that holds conf."""
    out = F.lit(1)
    for n in sorted(BANDS)[1:]:
        out = F.when(conf >= BANDS[n][0], n).otherwise(out)
    return F.when(conf.isNotNull(), out)


def bands(df: DataFrame, conf: str, label: str, cluster: str, keys: list[str], resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, band, lo, hi, n, accuracy, ci_low, ci_high): accuracy by band, with intervals that resample whole clusters;
    empty bands have n 0 and nulls."""
    cells = df.groupBy(*keys, band_of(F.col(conf)).alias("band"), F.col(cluster).alias("cluster")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").alias("n"))
    found = bootstrap_numpy(cells, [*keys, "band"], resamples, seed).select(*keys, "band", F.col("n").alias("_n"), F.col("mean").alias("accuracy"), F.col("lo").alias("ci_low"), F.col("hi").alias("ci_high"))
    edges = F.array(*(F.struct(F.lit(n).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for n, (lo, hi) in BANDS.items()))
    every = df.select(*keys).distinct().select(*keys, F.explode(edges).alias("e")).select(*keys, "e.*")
    return every.join(found, [*keys, "band"], "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def thresholds(df: DataFrame, conf: str, label: str, keys: list[str], target: float = 0.98, reject: float = 0.5) -> DataFrame:
    """(keys, t_accept, t_reject): the smallest confidence from which on accuracy reaches the target, and the largest
    one, at most t_accept (or 1), below which it is at most `reject`. Null if there is none.

    Rows are counted by distinct confidence first, so the ordered sums run over those alone."""
    per = df.groupBy(*keys, F.col(conf).alias("c")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("good"))
    w = Window.partitionBy(*keys).orderBy("c")
    up, down = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    acc = per.withColumns({"above": F.sum("good").over(up) / F.sum("n").over(up), "below": F.sum("good").over(down) / F.sum("n").over(down)})
    accept = acc.groupBy(*keys).agg(F.min(F.when(F.col("above") >= target, F.col("c"))).alias("t_accept"))
    both = acc.join(accept, keys)
    return both.groupBy(*keys, "t_accept").agg(F.max(F.when((F.col("below") <= reject) & (F.col("c") <= F.coalesce("t_accept", F.lit(1.0))), F.col("c"))).alias("t_reject"))


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """How many of `count` groups of one size each fold takes, each going to the lightest fold, the first of such."""
    level = lambda at: [max(0, -(-(at - x) // size)) for x in loads]  # groups that start below a level
    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(level(mid)) <= count else (low, mid)
    out = level(low)
    for _ in range(count - sum(out)):
        out[min(range(len(loads)), key=lambda j: (loads[j] + out[j] * size, j))] += 1
    return out


def folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Adds fold: rows of one group share it. Large groups first, each goes to the lightest fold.

    Groups of one size are as good as each other, so only how many of each size a fold takes is settled on the driver,
    from one row per size (N rows have at most sqrt(2 N) sizes). The groups of a size are ranked in buckets by hash."""
    n, b, rank, at, ends, name = (free_name(df, x) for x in ("n", "bucket", "rank", "at", "ends", "fold_group"))
    sizes = df.groupBy(F.col(group).alias(name)).agg(F.count("*").alias(n)).withColumn(b, F.pmod(F.xxhash64(name), F.lit(1024)))
    classes = sorted(((r[n], r["count"]) for r in sizes.groupBy(n).count().collect()), reverse=True)
    loads, plan = [0] * k, []
    for size, count in classes:
        take = deal(loads, size, count)
        loads = [x + size * t for x, t in zip(loads, take, strict=True)]
        plan.append((size, [sum(take[: j + 1]) for j in range(k)]))
    spark = df.sparkSession
    plan_df = spark.createDataFrame(plan, f"{n} long, {ends} array<long>")
    before = sizes.groupBy(n, b).agg(F.count("*").alias(at)).withColumn(at, F.coalesce(F.sum(at).over(Window.partitionBy(n).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = sizes.withColumn(rank, F.row_number().over(Window.partitionBy(n, b).orderBy(name)) - 1)
    dealt = ranked.join(F.broadcast(before), [n, b]).join(F.broadcast(plan_df), n).select(name, F.size(F.filter(ends, lambda e: e <= F.col(rank) + F.col(at))).alias("fold"))
    return df.join(dealt, df[group].eqNullSafe(dealt[name])).drop(name)


def enough(rows: int, groups: int, classes: int) -> bool:
    """Whether a calibration can be fitted."""
    return rows >= 50 and groups >= 5 and classes >= 2


def span_features(logprobs: Column, start: Column, length: Column) -> Column:
    """struct(mean, min) of the log probabilities of a token span; of all tokens where there is no span."""
    part = F.when(length > 0, F.slice(logprobs, start, length)).otherwise(logprobs)
    total = F.aggregate(part, F.lit(0.0), lambda a, x: a + x)
    return F.struct(F.try_divide(total, F.size(part)).alias("mean"), F.array_min(part).alias("min"))


def fit_logistic(df: DataFrame, features: list[str], label: str, fold: str, k: int = 5, c: float = 1.0, passes: int = 40) -> list[dict]:
    """k + 1 ridge logistic regressions on standardised features, by Newton's method over the cluster: the j-th learns from
    all rows outside fold j, the last from all. Each pass brings a gradient and a Hessian a model to the driver.

    Each is a dict of mean, scale, coef and intercept; a feature that doesn't vary has scale 1."""
    d, models = len(features), range(k + 1)
    x = [F.col(f).cast("double") for f in features]
    sums = {r["_f"]: r for r in df.groupBy(F.col(fold).alias("_f")).agg(F.count("*").alias("n"), *(F.sum(v).alias(f"s{i}") for i, v in enumerate(x)), *(F.sum(v * v).alias(f"q{i}") for i, v in enumerate(x))).collect()}
    stat = lambda m, name: sum(r[name] for f, r in sums.items() if f != m)
    fits = []
    for m in models:
        n = max(stat(m, "n"), 1)
        mean = [stat(m, f"s{i}") / n for i in range(d)]
        var = [max(stat(m, f"q{i}") / n - mean[i] ** 2, 0.0) for i in range(d)]
        fits.append({"mean": mean, "scale": [math.sqrt(v) if v > 1e-14 * (1 + mean[i] ** 2) else 1.0 for i, v in enumerate(var)], "coef": [0.0] * d, "intercept": 0.0})
    ridge = np.r_[np.full(d, 1 / c), 1e-12]
    long = df.select(*(v.alias(f"x{i}") for i, v in enumerate(x)), F.col(label).cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(k))).alias("m"), F.col(fold).alias("f")).where("m <> f")
    for _ in range(passes):
        pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), F.col("m") + 1)
        z = [(F.col(f"x{i}") - pick([f["mean"][i] for f in fits])) / pick([f["scale"][i] for f in fits]) for i in range(d)]
        score = pick([f["intercept"] for f in fits])
        for i in range(d):
            score = score + z[i] * pick([f["coef"][i] for f in fits])
        zs = long.select("m", "y", *(v.alias(f"z{i}") for i, v in enumerate(z)), F.lit(1.0).alias(f"z{d}"), (1 / (1 + F.exp(-score))).alias("p"))
        cols = [F.col(f"z{i}") for i in range(d + 1)]
        grad = [F.sum((F.col("p") - F.col("y")) * v).alias(f"g{i}") for i, v in enumerate(cols)]
        hess = [F.sum(F.col("p") * (1 - F.col("p")) * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
        step = 0.0
        for r in zs.groupBy("m").agg(*grad, *hess).collect():
            fit = fits[r["m"]]
            w = np.r_[fit["coef"], fit["intercept"]]
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + np.diag(ridge)
            move = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(d + 1)]) + ridge * w * np.r_[np.ones(d), 0])
            w = w - move
            fit["coef"], fit["intercept"], step = w[:-1].tolist(), float(w[-1]), max(step, float(np.abs(move).max()))
        if step < 1e-9:
            break
    return fits


def confidence(features: list[str], fits: list[dict], model: Column) -> Column:
    """The probability that the fit of number `model` gives."""
    pick = lambda values: F.element_at(F.array(*(F.lit(float(v)) for v in values)), model + 1)
    z = pick([f["intercept"] for f in fits])
    for i, name in enumerate(features):
        z = z + (F.col(name) - pick([f["mean"][i] for f in fits])) / pick([f["scale"][i] for f in fits]) * pick([f["coef"][i] for f in fits])
    return 1 / (1 + F.exp(-z))


def buckets(df: DataFrame, found: DataFrame, conf: str, label: str, keys: list[str]) -> DataFrame:
    """(keys, t_accept, t_reject, and the share and accuracy of rows that are accepted, rejected, or left to review) of
    rows and their thresholds(). A bucket without rows has share 0 and no accuracy."""
    rows = df.join(F.broadcast(found), keys)  # one row a key
    c = F.col(conf)
    taken = F.coalesce(c >= F.col("t_accept"), F.lit(False))
    thrown = F.coalesce(c < F.col("t_reject"), F.lit(False))
    parts = {"accept": taken, "reject": thrown, "review": ~taken & ~thrown}
    out = [F.avg(p.cast("double")).alias(f"{n}_share") for n, p in parts.items()] + [F.avg(F.when(p, F.col(label).cast("double"))).alias(f"{n}_accuracy") for n, p in parts.items()]
    return rows.groupBy(*keys, "t_accept", "t_reject").agg(*out)
