"""Draws by number against Python's generator, and samples against one pass over sorted rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import draws


def test_polynomial():
    p = draws.polynomial()
    assert p.bit_length() == draws.DEGREE + 1 and p & 1 and draws.power(0) == 1 and draws.power(1) == 2 and draws.power(5) == 32


@pytest.mark.parametrize("seed", [0, 42, "42|task|stratum"])
def test_draws_from_any_place(seed):
    r = random.Random(seed)
    want = [r.random() for _ in range(3000)]
    for first in (0, 1, 311, 312, 313, 2500):
        assert draws.draws(seed, first, 500).tolist() == want[first : first + 500]
    # A jump of jumps: far places by two ways.
    far = 10**9
    state = np.random.RandomState(0)
    state.set_state(("MT19937", draws.state_after(seed, 2 * (far - 700)), draws.WORDS))
    assert state.random_sample(710)[700:].tolist() == draws.draws(seed, far, 10).tolist()


def test_queue_draws_as_one_pass(spark):
    """A draw for each agreeing cell in order, over several parts; nulls everywhere take none."""
    rng, cells = random.Random(3), []
    for s in range(60):
        for c in range(10):
            kind = rng.choice(["same"] * 5 + ["differ", "one", "none"])
            a = f"v{c}"
            cells += [(f"s{s:03d}", c, "m", None if kind == "none" else a), (f"s{s:03d}", c, "n", {"same": a, "differ": "x", "one": None, "none": None}[kind])]
    df = spark.createDataFrame(cells, "sample string, cell int, model string, value string").repartition(7)
    r, want, by = random.Random(9), set(), defaultdict(dict)
    for s, c, m, v in cells:
        by[s, c][m] = v
    for key in sorted(by):
        values = set(by[key].values())
        if values == {None} or len(values) == 1 and r.random() >= 0.3:
            continue
        want.add((*key, len(values) > 1))
    got = draws.review_queue(df, ["sample", "cell"], ["sample", "cell"], 0.3, 9, parts=5)
    assert {(r.sample, r.cell, r.differs) for r in got.collect()} == want and 0 < sum(not d for *_, d in want) < 300


@pytest.mark.parametrize("cap", [7, 50, 199, 200, 500])
def test_strata_draw_as_sample_does(spark, cap):
    rng = random.Random(cap)
    rows = [(f"id{i:04d}", rng.choice(["a"] * 6 + ["b", "c", None, ""])) for i in range(200)]
    df = spark.createDataFrame(rows, "id string, stratum string")
    strata = defaultdict(list)
    for i, s in rows:
        strata[s or ""].append(i)
    exact = {s: cap * len(x) / 200 for s, x in strata.items()}
    quota = {s: math.floor(v) for s, v in exact.items()}
    for s in sorted(strata, key=lambda s: (math.floor(exact[s]) - exact[s], s))[: cap - sum(quota.values())]:
        quota[s] += 1
    if cap >= 200:
        quota = {s: len(x) for s, x in strata.items()}
    want = {(s, k, i) for s, x in strata.items() for k, i in enumerate(random.Random(f"42|task|{s}").sample(sorted(x), quota[s]))}
    got = draws.stratified(df.withColumn("draw2", F.lit(1)), "stratum", "id", cap, "task", parts=5)
    assert {(r.stratum, r.draw, r.id) for r in got.collect()} == want
