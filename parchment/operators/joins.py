"""Join patterns of a run: latest rows, pending and stray keys, missing predictions, key-wise full joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by the order columns; Spark cuts each partition to one row a key before it shuffles."""
    w, rank = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)), free_name(df, "rank")
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank)


def pending(wanted: DataFrame, done: DataFrame, keys: list[str], error: str | None = None) -> DataFrame:
    """Rows of `wanted` without a row of `done`, or with one that has an error."""
    good = done.where(F.col(error).isNull()) if error else done
    return wanted.join(good.select(*keys).distinct(), keys, "left_anti")


def stray(done: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    return done.join(wanted.select(*keys).distinct(), keys, "left_anti")


def every_model(manifest: DataFrame, models: list[str]) -> DataFrame:
    """One row per manifest row and model; the models are a short list of literals, so nothing is shuffled."""
    return manifest.withColumn("model", F.explode(F.array(*map(F.lit, models))))


def with_predictions(manifest: DataFrame, predictions: DataFrame, keys: list[str], models: list[str]) -> DataFrame:
    """Each manifest row and model with its prediction, or nulls and missing = true. Of repeated predictions of a key one
    stays; where a log tells which is the last, use latest() first."""
    found = free_name(predictions, "found")
    # One row a key by its rank: dropDuplicates() would copy each row's tables and texts as they are aggregated.
    rank, w = free_name(predictions, "rank"), Window.partitionBy(*keys, "model").orderBy(F.lit(1))
    marked = predictions.withColumn(rank, F.row_number().over(w)).where(F.col(rank) == 1).drop(rank).withColumn(found, F.lit(True))
    out = every_model(manifest, models).join(marked, [*keys, "model"], "left")
    return out.withColumn("missing", F.col(found).isNull()).drop(found)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions of the session by its keys, whatever its size: for rows that take long each, which
    a small file, or adaptive coalescing by bytes, would leave to few tasks. Rows go by a hash of the keys, as Spark would
    leave out a shuffle by keys that rows are dealt by already."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


PARTIAL = r"^\d+ of \d+ blocks failed$"


def is_partial(error: Column, output: Column) -> Column:
    """An error that tells how many blocks failed, with some output."""
    return F.coalesce(F.trim(error).rlike(PARTIAL) & (F.trim(output) != ""), F.lit(False))


def is_full_miss(missing: Column, error: Column, output: Column) -> Column:
    return missing | (error.isNotNull() & ~is_partial(error, output))


#: Metrics of a page that was missed, and the worst value of each.
WORST = {"text": {"cer": 1.0, "wer": 1.0, "anls": 0.0}, "html": {"teds": 0.0, "cer": 1.0}, "json": {"field_exact": 0.0, "f1": 0.0}, "text_layer": {"cer": 1.0, "row_f1": 0.0}}


def worst_values(kind: Column) -> Column:
    """A map of metric to worst value by the kind of ground truth; empty for unknown kinds."""
    out = F.create_map().cast("map<string,double>")
    for k, values in WORST.items():
        out = F.when(kind == k, F.create_map(*(F.lit(x) for item in values.items() for x in item))).otherwise(out)
    return out


def field_pairs(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of both sides (columns keys, field, value) side by side: pred, gt, in_pred, in_gt. Null keys are equal; of
    a field that a side repeats, its greatest value counts. Both sides meet in one grouping instead of a full join."""
    side = lambda df, p: df.select(*keys, "field", *(F.when(F.lit(p == k), F.col("value")).alias(k) for k in ("pred", "gt")), *(F.lit(p == k).alias(f"in_{k}") for k in ("pred", "gt")))
    both = side(pred, "pred").unionByName(side(truth, "gt"))
    return both.groupBy(*keys, "field").agg(F.max("pred").alias("pred"), F.max("gt").alias("gt"), F.max("in_pred").alias("in_pred"), F.max("in_gt").alias("in_gt"))


def bag_matches(a: DataFrame, b: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """(group, n_a, n_b, tp): sizes of two bags of keys per group, and of their bag intersection. Nulls are equal.

    Both bags are counted by key before they meet, in one shuffle of counts."""
    tagged = a.select(*group, *key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(b.select(*group, *key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    counts = tagged.groupBy(*group, *key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return counts.groupBy(*group).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.least("a", "b")).alias("tp"))


def prf(tp: Column, n_pred: Column, n_true: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; an empty side is right only if the other is empty too."""
    p = F.when(n_pred > 0, tp / n_pred).otherwise((n_true == 0).cast("double"))
    r = F.when(n_true > 0, tp / n_true).otherwise((n_pred == 0).cast("double"))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def interval_match(points: DataFrame, bands: list[tuple], low: str, high: str, band: str) -> DataFrame:
    """Each point's band (name, start, end) of largest overlap (over 0; the first band wins ties). The bands are a short
    list of configuration, which goes into the expression; use range_match() for a table of them."""
    over = F.array(*(F.struct((F.least(F.col(high), F.lit(e)) - F.greatest(F.col(low), F.lit(s))).alias("over"), F.lit(-i).alias("first"), F.lit(b).alias("band")) for i, (b, s, e) in enumerate(bands)))
    best = F.array_max(F.filter(over, lambda x: x["over"] > 0))
    return points.withColumn(band, best["band"])


def range_match(points: DataFrame, bands: DataFrame, low: str, high: str, band: str, start: str, end: str, width: float, id: str) -> DataFrame:
    """interval_match() against a table of bands of any size: both sides are cut into cells of `width`, and meet by
    cell, so a point only sees bands near it. id tells points apart; `width` is best near the common band's length."""
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    p = points.select(F.col(id).alias("_id"), F.col(low).alias("_l"), F.col(high).alias("_h"), cells(low, high).alias("_cell"))
    b = bands.select(F.col(band).alias("_b"), F.col(start).alias("_s"), F.col(end).alias("_e"), cells(start, end).alias("_cell"))
    over = F.least("_h", "_e") - F.greatest("_l", "_s")
    best = p.join(b, "_cell").withColumn("_o", over).where("_o > 0").groupBy("_id").agg(F.min(F.struct((-F.col("_o")).alias("o"), F.col("_b").alias("b"))).alias("_m"))
    return points.join(best.select(F.col("_id").alias(id), F.col("_m.b").alias(band)), id, "left")
