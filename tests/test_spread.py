"""Rows that take long are spread over all tasks, and worked out once."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from parchment.operators import run
from parchment.plans import runs


def _run(spark, count=None):
    @F.udf("string")
    def text(x):
        if count is not None:
            count.add(1)
        return x

    ids = spark.range(6).select(F.format_string("BS-%d-p1", "id").alias("sample_id"))
    none = F.lit(None).cast("string")
    manifest = ids.select("sample_id", F.lit("clean").alias("condition"), F.lit("bankstmt").alias("source"), F.lit("statement").alias("task"), *(none.alias(c) for c in ("subtask", "domain", "bank", "doc_type")), F.lit(1).alias("page_no"))
    grid = F.array(F.array(F.array(*map(F.lit, ("Date", "Withdrawal", "Deposit", "Balance"))), F.array(*map(F.lit, ("1/2/2024", "", "5.00", "5.00")))))
    p = ids.crossJoin(spark.createDataFrame([("a",), ("b",)], "model string")).select("sample_id", F.lit("clean").alias("condition"), "model", F.lit("page-1").alias("prompt_version"), none.alias("error"), F.lit("").alias("raw_text"), text(F.lit("x")).alias("text") if count is None else text("sample_id").alias("text"), grid.alias("tables"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("blocks"), F.lit(None).cast("map<string,string>").alias("fields"), none.alias("label"))
    return manifest, p


def test_statement_checks_read_predictions_once(spark):
    count = spark.sparkContext.accumulator(0)
    manifest, p = _run(spark, count)
    pages = run.map_pages(*_run(spark)).where("model = 'a'").select("sample_id", "page")
    scores, _ = run.statement_checks(manifest, p, manual=pages)
    assert scores.where("metric = 'file_reconciles'").count() == 12 and scores.count() == 48
    assert count.value == 12


def test_pages_are_spread(spark):
    assert run.map_pages(*_run(spark)).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["line_segments", "table_similarity", "text_layer_rows", "statement_pages"])
def test_small_files_are_spread(spark, sf, name):
    assert __spark_entry__.queries()[name](spark, sf).rdd.getNumPartitions() == 4


@pytest.mark.parametrize("name", ["text_layer_rows", "statement_pages"])
def test_pages_are_read_once(spark, sf, name):
    """A filter on a page's rows, which Spark infers from their expansion, would have each page read before the shuffle too."""
    plan = __spark_entry__.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_grids_of_both_models_take_one_pass(spark, sf):
    _, p, _ = runs._statement_run(spark, sf)
    assert "Window" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_row_scores_work_keys_out_once(spark):
    count = spark.sparkContext.accumulator(0)

    @F.udf("array<struct<d:string,a:int>>")
    def keys(n):
        count.add(1)
        return [("x", i % 3) for i in range(n)]

    df = spark.createDataFrame([(4, 2), (0, 0), (3, 0), (0, 2), (2, 5)], "a int, b int")
    got = [tuple(r[0]) for r in df.select(run.row_scores(keys("a"), keys("b"))).collect()]
    assert got == [(0.5, 1.0, 2 / 3), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.4, 2 * 0.4 / 1.4)]
    assert count.value == 10
