"""Cuts by a dictionary against all cuts, and word error rates over them."""

import random

import pytest
from pyspark.sql import functions as F

from parchment.functions import text, words


def all_cuts(run):
    if not run:
        yield ()
    for j in range(1, len(run) + 1):
        for rest in all_cuts(run[j:]):
            yield (run[:j], *rest)


def best_cut(run, known):
    """Of all cuts into known words and single unknown letters: fewest unknown letters, fewest pieces, longest first."""
    some = [c for c in all_cuts(run) if all(w in known or len(w) == 1 for w in c)]
    cut = min(some, key=lambda c: (sum(w not in known for w in c), len(c), [-len(w) for w in c]))
    out = []
    for k, w in enumerate(cut):
        if k and w not in known and cut[k - 1] not in known:
            out[-1] += w
        else:
            out.append(w)
    return tuple(out)


def test_cuts_by_brute_force():
    rng = random.Random(4)
    letters = "กขคง"
    for _ in range(60):
        known = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(0, 12))}
        cutter = words.Cutter(known)
        for _ in range(12):
            run = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 10)))
            assert cutter.cut(run) == best_cut(run, known), (run, known)


def test_words_of_texts(spark):
    dictionary = spark.createDataFrame([("ยอด",), ("ยอดคง",), ("คงเหลือ",), ("เหลือ",), ("บาท",), ("",), (None,)], "word string")
    tokens = words.tokenizer(dictionary)
    df = spark.createDataFrame([("ยอดคงเหลือ 5 บาท", "ยอดเหลือ 5บาท"), ("", None), ("ฮฮยอด", "plain words")], "a string, b string")
    got = df.select(tokens(F.col("a")).alias("a"), tokens(F.col("b")).alias("b"))
    assert [tuple(r) for r in got.collect()] == [(["ยอดคง", "เหลือ", "5", "บาท"], ["ยอด", "เหลือ", "5", "บาท"]), ([], None), (["ฮฮ", "ยอด"], ["plain", "words"])]
    assert df.where("a <> '' and b like 'ย%'").select(text.wer(tokens(F.col("b")), tokens(F.col("a")))).first()[0] == 0.25
    with pytest.raises(ValueError, match="letters"):
        words.tokenizer(spark.range(3).select(F.repeat(F.lit("ก"), 2_000_000).alias("word")).withColumn("word", F.concat("word", F.monotonically_increasing_id().cast("string"))))
