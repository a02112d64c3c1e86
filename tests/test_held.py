"""What Python workers hold: slices of a batch, in few workers a task."""

import html

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parchment.functions import official, tables, text


class Batch:
    """A column that tells how many of its rows become Python objects at once."""

    def __init__(self, rows):
        self.rows, self.most = pa.array(rows, pa.string()), 0

    def __len__(self):
        return len(self.rows)

    def slice(self, i, n):
        self.most = max(self.most, len(got := self.rows.slice(i, n)))
        return got


def test_batches_are_taken_in_slices():
    rows = [None if i % 7 == 0 else f"x{i}" for i in range(3 * text.HELD + 5)]
    a, b = Batch(rows), Batch(rows[::-1])
    got = text.each(lambda x, y: x + y, pa.string(), a, b).to_pylist()
    assert got == [None if x is None or y is None else x + y for x, y in zip(rows, rows[::-1], strict=True)]
    assert a.most == b.most == text.HELD and text.each(str, pa.string(), Batch([])).to_pylist() == []
    assert text.each(lambda x: x or "", pa.string(), Batch([None, "a"]), nulls=True).to_pylist() == ["", "a"]


@pytest.mark.parametrize("f", [text._unescape, text._composed, text._nfc, tables.teds_udf, tables.json_fields_udf, official.official])
def test_functions_of_a_run_are_of_one_kind(f):
    """Spark runs functions of unlike kinds in workers of their own."""
    assert f.evalType == text._edits.evalType


def test_workers_of_task_tables(spark, sf):
    plan = __spark_entry__.queries()["task_tables"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 20


def test_maps_and_nulls_pass(spark):
    df = spark.createDataFrame([('{"a": "1", "b": null}',), ("no json",), (None,)], "x string").coalesce(1)
    got = df.select(tables.json_fields_udf("x").alias("f"), official.official(F.lit("Text recognition"), F.col("x"), F.lit(None).cast("string")).alias("o"), official.answer_fields_udf("x").alias("a")).collect()
    assert [r.f for r in got] == [{"a": "1", "b": None}, {}, None] and [r.a for r in got] == [{"a": "1", "b": None}, None, None] and got[2].o == 0.0


def test_only_references_of_pages_travel(spark, sf):
    """What reaches Python from a page are its character references, whatever the size of a batch's pages."""
    plan = __spark_entry__.queries()["plain_pages"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "_unescape(regexp_extract_all(" in plan and plan.count("ArrowEvalPython") == 2
    assert text._unescape.func(pa.array([["&amp;", "&#65", "&notit;"], [], None])).to_pylist() == [["&", "A", "¬it;"], [], None]


def test_references_are_those_of_html(spark):
    odd = ["", "&", "&&amp;&", "a&amp;lt;b", "&copy", "&copyright;", "&notin;&notit;", "&#0;&#128;&#xD800;&#99999999999;&#xFDD0;&#13;", "&#x1F600;&#X41&#65z", "&#;&#x;", "&" + "B" * 33 + ";", "&am\np;", "&𝐀;&amp", "&amp;", "x&quot;\n&middot;y&", None]
    df = spark.createDataFrame(list(enumerate(odd)), "i int, x string").coalesce(1)
    got = {r.i: r.x for r in df.select("i", text.unescape(F.col("x")).alias("x")).collect()}
    assert got == {i: None if x is None else html.unescape(x) for i, x in enumerate(odd)}


def test_signs_of_lines(spark):
    """Rules, bars, stars, double dollars and underscores, in the order in which they go."""
    odd = {"|-|:-|\n--\n | \na": "\n\n   \na", "$*$ $$ *|*": "$$    ", "_a_ b_c __d__": "a b_c d", "𝐀_ _é_|_": "𝐀 é ", "no sign": "no sign", "## _": ""}
    rows = spark.createDataFrame([(x,) for x in odd], "x string").select("x", text.strip_markup(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == odd
