"""Learning from odd labels and repeated ids, and blocks of queries one at a time."""

import random

import numpy as np
from pyspark import SparkContext
from pyspark.sql import functions as F

from parchment.llm import quality, topk, toxicity


def test_repeated_ids_learn_the_same(spark):
    """Whatever order rows come in, the least text of a repeated id counts; labels beyond 0 and 1 do no harm."""
    rng = random.Random(1)
    docs = [(i, rng.choice(["!!! BUY $$$ now now", "A calm sentence, well written. Another one."]) + f" {i}") for i in range(120)]
    labels = [(i, 1 if "calm" in t else rng.choice([0, -1]), 0 if "calm" in t else rng.choice([1, 3])) for i, t in docs]
    docs += [(i, "zzz later text") for i in range(0, 120, 2)] + [(500, None)]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, (500, 1, 0)], "doc_id long, quality int, toxic int")
    forests = [quality.learn(x, lab) for x in (d, d.orderBy(F.desc("text")), d.repartition(5))]
    x = np.random.default_rng(0).random((50, len(quality.FEATURES)))
    assert all((f.predict(x) == forests[0].predict(x)).all() for f in forests)
    lexicons = [toxicity.learn(x, lab) for x in (d, d.repartition(3))]
    assert lexicons[0] == lexicons[1] and lexicons[0].weights
    scores = {r.doc_id: r.score for r in toxicity.score(d.where("doc_id < 120 and text not like 'zzz%'"), lexicons[0]).collect()}
    assert all((scores[i] >= 0.5) == (tox > 0) for i, _, tox in labels if i in scores)


def test_one_block_of_queries_at_a_time(spark, monkeypatch):
    """Of three blocks one has broadcasts that are alive, and the plan doesn't grow with blocks."""
    alive, most, add = set(), [], SparkContext.broadcast

    def broadcast(self, value):
        b = add(self, value)
        alive.add(id(b))
        most.append(len(alive))
        destroy = b.destroy
        b.destroy = lambda *a: (alive.discard(id(b)), destroy(*a))[1]
        return b

    monkeypatch.setattr(SparkContext, "broadcast", broadcast)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8)).round(2)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = topk.top_k(df, k=3, every=10, chunk=64, block=14)
    q = np.floor(v * 256).astype(np.int64)
    want = set()
    for i in range(0, 400, 10):
        order = sorted((-int(q[i] @ q[j]), j) for j in range(400) if j != i)[:3]
        want |= {(i, r, j, -s) for r, (s, j) in enumerate(order, 1)}
    assert {tuple(r) for r in got.collect()} == want
    assert max(most) == 2 and len(most) >= 6 and not alive
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 500
