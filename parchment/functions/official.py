"""Official scores of benchmark answers by task: whole texts, short answers, tables, documents and key-value replies.

The answers hold Python or JSON literals of any depth, so these run in Arrow batches.
"""

from __future__ import annotations

import ast
import json
import re
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .distance import edit_distance
from .tables import FIELDS, document_similarity, entries, table_similarity, text_similarity
from .text import each

# Names of the tasks that have an official score.
TEXT_TASKS = ("Full-page OCR", "Fine-grained text recognition", "Handwritten content extraction")
ANSWER_TASKS = ("Text recognition", "Document classification")
FIELD_TASKS = ("Key information extraction", "Key information mapping")
TASKS = (*TEXT_TASKS, *ANSWER_TASKS, "Table parsing", "Document parsing", *FIELD_TASKS)


def _plain(x) -> str:
    return str(x).strip().lower().replace("\n", "").replace(" ", "")


def _literal(text: str):
    """The Python or JSON value that a text holds, or None."""
    for read in (ast.literal_eval, json.loads):
        try:
            return read(text)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
    return None


def _likeness(a: str, b: str) -> float:
    """Normalised edit similarity, 0 under one half; two empty texts agree."""
    like = 1 - edit_distance(a, b) / max(len(a), len(b), 1)
    return like if like >= 0.5 else 0.0


def short_answer(pred: str, truth: str) -> float:
    """1 if the reply holds the truth, else their likeness. A list literal holds accepted answers, of which those with
    four parts between commas or more are compared by likeness alone, and the others by containment alone."""
    p = _plain(pred)
    choices = _literal(truth) if truth.startswith("[") and truth.endswith("]") else None
    if isinstance(choices, list):
        long = lambda a: a.count(",") >= 3
        return max((_likeness(p, a) if long(a) else float(a in p) for a in map(_plain, choices)), default=0.0)
    answer = _plain(truth)
    return 1.0 if answer in p else _likeness(p, answer)


def reply_dict(text: str) -> dict[str, str]:
    """Keys and values of a reply: of a fenced block if there is one, as JSON or a Python dict, else by pairs of a word
    and a value around a colon or an equals sign. Values are text."""
    fence = re.search(r"```(?:python|json)?\n(.*?)\n```", text, re.S | re.I)
    body = fence[1] if fence else text.strip()
    got = None
    try:
        got = json.loads(body)
    except ValueError:
        try:
            got = ast.literal_eval(body)
            got = got if isinstance(got, dict) else None
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            pass
        if got is None:
            got = {}
            for part in re.split(r"[\n,{}]", body):
                pair = re.match(r"\W*([\w\s]+?)[\"']?\s*[:=]\s*(.*)", part, re.S)
                if pair and pair[2].strip(" \"'"):
                    got[pair[1]] = pair[2].strip(" \"'")
    if not isinstance(got, dict) or not all(isinstance(k, str) for k in got):
        return {}
    return {k.strip(): str(v).strip() for k, v in got.items()}


def _field(value, literal: bool) -> str | None:
    """A value as it is compared: dicts (on request, also as literals in text) as JSON in the order of their keys."""
    if literal and isinstance(value, str) and value.lstrip().startswith("{"):
        try:
            held = ast.literal_eval(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            held = None
        value = held if isinstance(held, dict) else value
    if isinstance(value, dict):
        value = json.dumps(value, sort_keys=True, ensure_ascii=False)
    return None if value is None else _plain(value)


def dict_f1(pred: dict, truth: dict) -> float:
    """Share of keys of either side with equal values; keys without a value on both sides don't count."""
    pairs = [(_field(pred.get(k), True), _field(truth.get(k), False)) for k in {**truth, **pred}]
    known = [p == t for p, t in pairs if p is not None or t is not None]
    return sum(known) / len(known) if known else 0.0


def alternatives(truth: dict) -> list[dict]:
    """One dict for each choice of one value from every key's list."""
    lists = [v if isinstance(v, list) else [v] for v in truth.values()]
    return [dict(zip(truth, values, strict=True)) for values in product(*lists)]


def field_score(pred: str, truth: str) -> float:
    """The best F1 over the alternatives of the truth. Keys are independent, so each takes its best value: the product
    is never listed."""
    answers = _literal(truth)
    if not isinstance(answers, dict):
        return 0.0
    got, best = reply_dict(pred), {}
    for k, v in answers.items():
        choices = v if isinstance(v, list) else [v]
        if not choices:
            return 0.0
        p = _field(got.get(k), True)
        # An equal value is best; else a missing one drops out of the count if the reply has none either.
        best[k] = next((c for c in choices if _field(c, False) == p), choices[0])
    return dict_f1(got, best)


def table_score(pred: str, truth: str) -> float:
    """Similarity of the first tables as they stand, header cells and wrappers of rows included."""
    text = pred.replace("\n", "")
    at = text.find("<body") if "<body" in text else text.find("<table")
    return table_similarity(text[at:], truth if "<table" in truth else f"<table>{truth}</table>") if at >= 0 else 0.0


def official_score(task: str, answer: str | None, truth: str | None) -> float | None:
    """The score of a task, 0 for a request that failed (a null answer); null for tasks without one."""
    if task not in TASKS:
        return None
    if answer is None:
        return 0.0
    truth = truth or ""
    if task in TEXT_TASKS:
        return text_similarity(answer, truth) if answer else 0.0
    if task in ANSWER_TASKS:
        return short_answer(answer, truth)
    if task in FIELD_TASKS:
        return field_score(answer, truth)
    return table_score(answer, truth) if task == "Table parsing" else document_similarity(answer, truth)


@F.arrow_udf(T.DoubleType())
def official(task: pa.Array, answer: pa.Array, truth: pa.Array) -> pa.Array:
    return each(official_score, pa.float64(), task, answer, truth, nulls=True)


@F.arrow_udf(T.DoubleType())
def short_answer_udf(answer: pa.Array, truth: pa.Array) -> pa.Array:
    return each(lambda a, g: short_answer(a or "", g or ""), pa.float64(), answer, truth, nulls=True)


@F.arrow_udf(T.DoubleType())
def field_score_udf(answer: pa.Array, truth: pa.Array) -> pa.Array:
    return each(lambda a, g: field_score(a or "", g or ""), pa.float64(), answer, truth, nulls=True)


def answer_fields(text: str) -> dict[str, str | None] | None:
    """Flat fields of a benchmark's JSON answer, which may be fenced and have commas too many; None if it is no JSON."""
    from .tables import _FENCE, _load

    return _load(_FENCE.sub("", text.strip()))


@F.arrow_udf(FIELDS)
def answer_fields_udf(text: pa.Array) -> pa.Array:
    return each(lambda x: entries(answer_fields(x)), to_arrow_type(FIELDS), text)


def parity(rows: DataFrame, most: float = 0.01) -> DataFrame:
    """(task, n, max_abs_diff, comparable) of rows (task, answer, truth, published)."""
    gap = F.abs(official("task", "answer", "truth") - F.col("published"))
    found = rows.where(F.col("task").isin(*TASKS)).groupBy("task").agg(F.count("*").alias("n"), F.round(F.max(gap), 6).alias("max_abs_diff"))
    every = rows.sparkSession.createDataFrame([(t,) for t in TASKS], "task string")
    out = every.join(found, "task", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("comparable", F.coalesce((F.col("n") > 0) & (F.col("max_abs_diff") <= most), F.lit(False)))
