"""Typed values of whole columns: what fields.parse_date() and fields.normalize_field() tell, worked out in Arrow batches, once
for each distinct text.

The expressions of fields are for use inside other expressions; over a column they repeat their parsers in every branch, and
Spark interprets them value by value. Columns of dates and fields hold few distinct texts by comparison.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .fields import ACCOUNT_KEY, ACCOUNT_SHAPE, AMOUNT_KEY, AMOUNT_SHAPE, DATE_KEY, NAME_KEY
from .statement import amount_of, plain_date

_KEYS = tuple((re.compile(p), kind) for p, kind in ((DATE_KEY, "date"), (AMOUNT_KEY, "amount"), (NAME_KEY, "name"), (ACCOUNT_KEY, "account")))
#: Digits enough for what is rounded to 14 behind the point.
_WIDE = Context(prec=80)
_ACCOUNT, _DIGITS, _AMOUNT = re.compile(ACCOUNT_SHAPE, re.A), re.compile(r"^[\d\- ]+$", re.A), re.compile(AMOUNT_SHAPE, re.A)


def key_type(key: str | None) -> str | None:
    """The type that a key tells."""
    return None if key is None else next((kind for p, kind in _KEYS if p.search(key)), None)


def shape_type(text: str) -> str:
    """The type that a canonical text tells."""
    if plain_date(text):
        return "date"
    if _ACCOUNT.search(text) or "-" in text and _DIGITS.search(text) and len(re.sub(r"\D", "", text, flags=re.A)) >= 10:
        return "account"
    return "amount" if _AMOUNT.search(text) else "other"


def plain_amount(text: str) -> str | None:
    """fields.parse_amount()."""
    n = amount_of(text)
    if n is None or n.is_nan() or n and n.adjusted() > 24:
        return None
    n = n.quantize(Decimal(1).scaleb(-14), ROUND_HALF_UP, _WIDE) if n.adjusted() > -16 else Decimal(0)
    if n.adjusted() > 23:
        return None
    return "0" if n == 0 else format(n, "f").rstrip("0").rstrip(".")


def normal_value(key: str | None, text: str) -> str:
    """The value of fields.normalize_field() of a key and canonical text."""
    kind = key_type(key) or shape_type(text)
    if kind == "date":
        return plain_date(text) or text
    if kind == "amount":
        return plain_amount(text) or text
    return (re.sub(r"\D", "", text) or text) if kind == "account" else text


def _each(texts: pa.Array, f: Callable[[str], str | None]) -> pa.Array:
    """f of each text, worked out once for each distinct one; null stays null."""
    coded = texts.cast(pa.string()).dictionary_encode()
    return pa.array([f(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


@F.arrow_udf(StringType())
def _dates(texts: pa.Array) -> pa.Array:
    return _each(texts, plain_date)


@F.arrow_udf(StringType())
def _values(keys: pa.Array, texts: pa.Array) -> pa.Array:
    coded = keys.cast(pa.string()).dictionary_encode()
    of = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    out = pa.nulls(len(texts), pa.string())
    for i, key in enumerate([*coded.dictionary.to_pylist(), None]):
        here = pa.array(of == i)
        if not np.any(of == i):
            continue
        found = _each(pc.filter(texts, here), lambda t, key=key: normal_value(key, t))
        out = pc.replace_with_mask(out, here, found)
    return out


def dates(c: Column) -> Column:
    """fields.parse_date() of a column of canonical text."""
    return _dates(c)


def values(key: Column, text: Column) -> Column:
    """The value of fields.normalize_field() of a column of canonical text."""
    return _values(key, text)
