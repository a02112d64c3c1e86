"""Percentiles by refining histograms against percentile()."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import percentiles

SHARES = [0.0, 0.1, 0.5, 0.95, 0.99, 1.0]


def test_bits_keep_the_order():
    x = np.array([-math.inf, -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1e-9, 1.0, np.nextafter(1.0, 2), 2.5, 1e300, math.inf])
    b = percentiles.ordered_bits(x).view(np.uint64)
    assert (np.diff(b.astype(object)) > 0).all() and percentiles.doubles(b.view(np.int64)).tolist() == x.tolist()
    assert percentiles.ordered_bits(np.array([-0.0])) == percentiles.ordered_bits(np.array([0.0])) and percentiles.ordered_bits(np.array([math.nan])).view(np.uint64)[0] > b[-1]


@pytest.mark.parametrize(("bits", "few"), [(12, 10_000), (12, 3), (7, 50), (16, 0)])
def test_equal_to_percentile(spark, bits, few):
    """One large group, small ones, a null key, ties, a value that most rows share, all magnitudes and signs."""
    rng, rows = random.Random(bits), []
    for g, n in (("hot", 3000), ("ties", 500), ("one", 1), ("two", 2), (None, 60), ("wide", 400)):
        for _ in range(n):
            v = rng.choice([7.25] * 3 + [rng.random()]) if g == "ties" else rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) if g == "wide" else rng.gauss(100, 20)
            rows.append((g, v))
    rows += [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {(r.g, s): v for r in df.where("v is not null").groupBy("g").agg(*(F.percentile("v", F.lit(s)).alias(str(s)) for s in SHARES)).collect() for s, v in zip(SHARES, r[1:], strict=True)}
    got = percentiles.percentiles(df.repartition(5), ["g"], "v", SHARES, bits, few).collect()
    assert {(r.g, r.share): r.value for r in got} == want and len(got) == len(want)
    assert {r.g: r.n for r in got} == {"hot": 3000, "ties": 500, "one": 1, "two": 2, None: 60, "wide": 400}
    assert percentiles.percentiles(df.where("false"), ["g"], "v", SHARES, bits, few).count() == 0
