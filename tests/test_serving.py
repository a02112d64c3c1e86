"""Serving figures."""

from parchment.operators import serving


def test_page_latency_leaves_rounding_to_the_caller(spark):
    """0.149 s is 0.1, not 0.15 and then 0.2."""
    pages = spark.createDataFrame([("k", None, ["a"], 149.0)], "k string, error string, tokens array<string>, ms double")
    row = serving.page_latency(pages, ["k"], "error", "tokens", "ms", 3, digits=None).selectExpr("round(page_p50_s, 1) AS p", "page_p95_s AS q").first()
    assert tuple(row) == (0.1, 0.149)
    assert serving.page_latency(pages, ["k"], "error", "tokens", "ms", 3).first().page_p50_s == 0.15
