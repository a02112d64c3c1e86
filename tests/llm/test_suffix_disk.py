import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import suffix_tree
from parchment.llm.common import Scratch


def test_asks_and_replies_go_pass_by_pass(spark, monkeypatch):
    """Of what parts are asked, and of what blocks are told, only that of later passes is still on disk."""
    left, add = {}, Scratch.add

    def spy(self, df, name, *by):
        size = lambda folder: sum(f.stat().st_size for f in Path(self.at.removeprefix("file:"), folder).rglob("*.parquet"))
        if name in ("answers2", "level2"):
            left.setdefault(name, []).append(size("level1/kind=counts") + size("level1/kind=values") if name == "answers2" else size("answers2"))
        add(self, df, name, *by)

    monkeypatch.setattr(Scratch, "add", spy)
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(60)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_tree.lm_score(docs, F.lit(True), support=2, block_bytes=2000, part_keys=300)
    assert got.count() == len(texts)
    for name in ("answers2", "level2"):
        sizes = left[name]
        assert len(sizes) == suffix_tree.PASSES and sizes[-1] > 0 and all(x > y for x, y in zip(sizes, sizes[1:], strict=False))


def test_rows_of_asks_stay_few():
    """A row each of 768 blocks and the parts of 1.6 billion tokens, which is 6 GB of text: under 300,000."""
    assert 768 * suffix_tree.parts_for(1_600_000_000) < 300_000
    assert [suffix_tree.parts_for(n) for n in (0, 1, 10**6, 10**8)] == [1, 1, 15, 64]


@pytest.mark.parametrize("x", [[], [0], [5, 3, 5, 0, 3, 5], [2**62, 1, 2**62, 2**61], [*range(50, 0, -1), *range(30)]])
def test_distinct_numbers(x):
    x = np.array(x, np.int64)
    for got, want in zip(suffix_tree.distinct(x), np.unique(x, return_index=True, return_inverse=True), strict=True):
        assert got.tolist() == want.tolist()
