"""Edit distances of many pairs at once, and how often the work before a bootstrap is done."""

import random
import time

from pyspark.sql import functions as F

from parchment.functions import text
from parchment.functions.distance import edit_distance, edit_distances
from parchment.operators import slices


def _changed(rng, x, share, letters):
    return "".join(rng.choice(("", c + rng.choice(letters), rng.choice(letters))) if rng.random() < share else c for c in x)


def test_many_pairs_equal_one_by_one(spark):
    rng, letters = random.Random(3), "abcdefgh ก\U0001f600é"
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice(letters) for _ in range(rng.choice((0, 1, 5, 63, 64, 65, 127, 128, 129, 300))))
        pairs.append((a, _changed(rng, a, rng.choice((0.0, 0.1, 0.6, 1.0)), letters)))
    want = [edit_distance(a, b) for a, b in pairs]
    assert edit_distances(pairs).tolist() == want
    df = spark.createDataFrame([(i, *p) for i, p in enumerate([*pairs, (None, "x" * 99), ("x" * 99, None)])], "i int, a string, b string")
    assert [r.e for r in df.select("i", text.edits(F.col("a"), F.col("b")).alias("e")).orderBy("i").collect()] == [*want, None, None]


def test_long_texts_take_less_than_cell_by_cell(spark):
    """400 pairs of 2,000 letters: 1.6 billion cells."""
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(2000)) for _ in range(400)]
    df = spark.createDataFrame([(x, x.replace("e", "a")) for x in base], "a string, b string").coalesce(1).cache()
    df.count()
    took = []
    for c in (text.edits(F.col("a"), F.col("b")), F.levenshtein("a", "b")):
        began = time.time()
        total = df.agg(F.sum(c).alias("n")).first().n
        took.append((time.time() - began, total))
    assert took[0][1] == took[1][1] and took[0][0] < took[1][0]


def test_bootstrap_and_slices_work_values_out_once(spark):
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        count.add(1)
        return float(x) if x != 7 else None

    rows = spark.range(20).select(F.lit("m").alias("metric"), F.col("id").alias("sample_id"), F.lit("k").alias("k"), value("id").alias("value"))
    got = slices.bootstrap(slices.sliced(rows, [slices.Slice("t", ("k",))]), ["k"], 20).first()
    assert (got.mean, got.n) == ((190 - 7) / 19, 19) and got.lo <= got.mean <= got.hi
    assert count.value == 20
