"""Confidence of extracted fields: where a value stands among a model's tokens, what other models and the arithmetic say,
and a calibrated probability from that."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import calibration
from .run import FILE, KEYS

# Features of both variants, and the two models that check each other first.
FEATURES = {"full": ["mean_logprob", "min_logprob", "agree_1", "agree_null", "arith_1", "arith_null"], "logprob_only": ["mean_logprob", "min_logprob"]}
PAIR = ("dots.ocr", "teleocr")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def locate_span(tokens: list[str], value: str | None) -> tuple[int, int] | None:
    """The tokens [start, end) that hold the last occurrence of a value, or else of its digits among all digits."""
    if not tokens or not value:
        return None
    text, ends = "".join(tokens), np.cumsum([len(t) for t in tokens])
    at = text.rfind(value)
    places = (at, at + len(value) - 1)
    if at < 0:
        where = [i for i, ch in enumerate(text) if ch.isdigit()]
        digits = "".join(filter(str.isdigit, value))
        at = "".join(text[i] for i in where).rfind(digits) if digits else -1
        if at < 0:
            return None
        places = (where[at], where[at + len(digits) - 1])
    first, last = np.searchsorted(ends, places, "right")
    return int(first), int(last) + 1


@F.arrow_udf(SPAN)
def span_of(tokens: pa.Array, value: pa.Array) -> pa.Array:
    found = [locate_span(t or [], v) for t, v in zip(tokens.to_pylist(), value.to_pylist(), strict=True)]
    return pa.array([None if f is None else {"start": f[0], "end": f[1]} for f in found], to_arrow_type(SPAN))


def partner_value(model: Column, others: Column, pair: tuple[str, str] = PAIR) -> Column:
    """The value (null if none) that another model has, of an array of (model, value): of a model of the pair the other
    one's, if it has a row, else the first by name's."""
    mine = F.when(model == pair[0], pair[1]).when(model == pair[1], pair[0])
    rest = F.array_sort(F.filter(others, lambda o: o.model != model))
    first = F.try_element_at(F.filter(rest, lambda o: o.model == mine), F.lit(1))
    return F.coalesce(first, F.try_element_at(rest, F.lit(1)))["value"]


def field_records(fields: DataFrame, predictions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Rows of run.score_run()'s fields with features: mean_logprob and min_logprob of the value's tokens (of all where it
    isn't found; 0 without any), agree (1, 0, or null if no other model has a value) and arith (of a closing balance, whether
    the file's chain ends at it), and these as numbers with flags for null. predictions: keys, tokens, token_logprobs."""
    seen = Window.partitionBy("sample_id", "condition", "field")
    f = fields.withColumn("_others", F.collect_list(F.struct("model", F.col("pred").alias("value"))).over(seen))  # one a model
    other = partner_value(F.col("model"), F.col("_others"))
    f = f.withColumn("agree", F.when(other.isNotNull(), F.col("pred").eqNullSafe(other).cast("int"))).drop("_others")
    f = f.join(predictions.select(*KEYS, "tokens", "token_logprobs"), KEYS, "left")
    f = f.withColumn("span", span_of("tokens", "pred_raw"))
    stats = calibration.span_features(F.coalesce("token_logprobs", F.array().cast("array<double>")), F.col("span.start") + 1, F.col("span.end") - F.col("span.start"))
    f = f.withColumns({"_s": stats, "span_found": F.col("span").isNotNull() & (F.size("token_logprobs") > 0), "logprobs_missing": F.coalesce(F.size("token_logprobs"), F.lit(0)) <= 0})
    f = f.withColumns({"mean_logprob": F.coalesce("_s.mean", F.lit(0.0)), "min_logprob": F.coalesce("_s.min", F.lit(0.0))})
    arith = F.lit(None).cast("int")
    if files is not None:
        closes = files.select(*FILE, (~F.col("closing_mismatch")).cast("int").alias("_closes"))
        f = f.withColumn("file_id", F.regexp_replace("sample_id", r"-p\d+$", "")).join(closes, FILE, "left")
        arith = F.when((F.col("task") == "statement") & (F.col("field") == "closing_balance"), F.col("_closes"))
    f = f.withColumn("arith", arith)
    one = lambda c: F.coalesce((F.col(c) == 1).cast("double"), F.lit(0.0))
    flags = {f"{c}_1": one(c) for c in ("agree", "arith")} | {f"{c}_null": F.col(c).isNull().cast("double") for c in ("agree", "arith")}
    out = f.withColumns(flags).withColumn("label", F.col("field_exact"))
    return out.select(*KEYS, "field", "is_critical", "label", "span_found", "logprobs_missing", "agree", "arith", *FEATURES["full"])


@dataclass(frozen=True)
class Calibration:
    """confidences: the records with variant and conf, out of fold; bands, reliability, thresholds: tables by model and
    variant; weights: the final fit of each model and variant, None where there is too little to learn from."""

    confidences: DataFrame
    bands: DataFrame
    reliability: DataFrame
    thresholds: DataFrame
    weights: dict[tuple[str, str], dict | None]


def calibrate(records: DataFrame, target: float = 0.98, k: int = 5, resamples: int = 1000, seed: int = 42) -> Calibration:
    """Confidences of each model and variant from fits that never saw the record's sample, and what they are worth.

    Models and variants with fewer than 50 records, 5 samples or 2 labels have none. Bands and calibration errors are of all
    records and of critical fields."""
    enough = records.groupBy("model").agg(F.count("*").alias("n"), F.count_distinct("sample_id").alias("samples"), F.count_distinct("label").alias("labels")).collect()  # one row a model
    weights, parts = {}, []
    for r in sorted(enough, key=lambda r: r.model):
        mine = calibration.folds(records.where(F.col("model") == r.model), "sample_id", k) if calibration.enough(r.n, r.samples, r.labels) else None
        for variant, features in FEATURES.items():
            fits = calibration.fit_logistic(mine, features, "label", "fold", k) if mine is not None else None
            weights[r.model, variant] = fits and {"features": features, **fits[-1]}
            if fits:
                parts.append(mine.select(*records.columns, F.lit(variant).alias("variant"), calibration.confidence(features, fits, F.col("fold")).alias("conf")))
    empty = records.withColumns({"variant": F.lit(""), "conf": F.lit(None).cast("double")}).where(F.lit(False))
    conf = empty
    for p in parts:
        conf = conf.unionByName(p)
    by = ["model", "variant"]
    tables = conf.withColumn("table", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("is_critical"), "critical")))))
    bins = calibration.reliability(tables, "conf", "label", [*by, "table"])
    bands = calibration.bands(tables, "conf", "label", "sample_id", [*by, "table"], resamples, seed).join(calibration.calibration_error(bins, [*by, "table"]), [*by, "table"], "left")
    found = calibration.thresholds(conf, "conf", "label", by, target)
    return Calibration(conf, bands, bins.where("table = 'all'").drop("table"), calibration.buckets(conf, found, "conf", "label", by), weights)
