"""Scores of predicted fields and texts against the truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_text, fuzzy, lenient, null_if_blank
from ..functions.values import values
from .joins import prf


def score_fields(pairs: DataFrame, miss: Column | None = None) -> DataFrame:
    """pairs (field, pred, gt, in_gt, ...) with pred and gt normalized by the field's type, and field_exact, field_fuzzy,
    field_lenient (0 or 1), false_accept and false_reject.

    Blank values are null. Two nulls agree in all three; one null is wrong. A prediction where the truth is null is a
    false accept; none where it isn't is a false reject. Near matches are told on the texts, not on the typed values.
    miss: true for rows of failed requests, which get no credit and accept nothing."""
    raw = pairs.withColumns({"_p": canonical_text(null_if_blank(F.col("pred"))), "_g": canonical_text(null_if_blank(F.col("gt")))})
    raw = raw.withColumns({"pred": values(F.col("field"), F.col("_p")), "gt": values(F.col("field"), F.col("_g"))})
    no_p, no_g, live = F.col("_p").isNull(), F.col("_g").isNull(), ~miss if miss is not None else F.lit(True)
    exact = (no_p & no_g) | (~no_p & ~no_g & F.coalesce(F.col("pred") == F.col("gt"), F.lit(False)))
    both = ~no_p & ~no_g
    one = lambda c: (live & F.coalesce(c, F.lit(False))).cast("int")
    return raw.withColumns({
        "field_exact": one(exact), "field_fuzzy": one(exact | (both & fuzzy(F.col("_p"), F.col("_g")))), "field_lenient": one(exact | (both & lenient(F.col("_p"), F.col("_g")))),
        "false_accept": live & no_g & ~no_p, "false_reject": ~no_g & no_p,
    }).drop("_p", "_g")


def field_f1(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Micro precision, recall and F1 of each key: a true positive has a prediction, is exact, and its field is in the truth."""
    tp = F.count_if((F.col("field_exact") == 1) & F.col("pred").isNotNull() & F.col("in_gt"))
    counts = scored.groupBy(*keys).agg(tp.alias("tp"), F.count_if(F.col("pred").isNotNull()).alias("n_pred"), F.count_if(F.col("gt").isNotNull() & F.col("in_gt")).alias("n_gt"))
    p, r, f = prf(F.col("tp"), F.col("n_pred"), F.col("n_gt"))
    return counts.select(*keys, "tp", "n_pred", "n_gt", p.alias("precision"), r.alias("recall"), f.alias("f1"))
