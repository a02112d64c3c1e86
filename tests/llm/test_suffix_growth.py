import collections
import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import suffix_tree as st
from parchment.llm.common import Scratch


def test_states_and_asks_do_not_grow_with_levels(spark, monkeypatch):
    """All pairs and triples are frequent: states of longer levels still hold the text's words once, and only contexts, not
    entries, are asked for values."""
    size, add = {}, Scratch.add

    def spy(self, df, name, *by):
        add(self, df, name, *by)
        for kind in ("state", "values"):
            size[name, kind] = sum(f.stat().st_size for f in Path(self.at.removeprefix("file:"), f"{name}/kind={kind}").rglob("*.parquet"))
        if name == "level1":
            values = self.read("level1/kind=values", df.schema).select("keys").collect()
            size["asked"] = sum(len(st.unpack_keys(bytes(r.keys))) for r in values)

    monkeypatch.setattr(Scratch, "add", spy)
    rnd = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcdefghijkl") for _ in range(300))) for i in range(200)], "doc_id long, text string").repartition(1)
    assert st.lm_score(docs, F.lit(True)).count() == 200
    assert size["level2", "state"] < 1.5 * size["level1", "state"] and size["level3", "state"] < 1.5 * size["level1", "state"]
    assert size["asked"] == 13  # twelve words and the end; pairs of them aren't asked for


def test_states_go_as_blocks_are_scored(spark, monkeypatch):
    """Of the last level's states, only those of later passes are still on disk, and none at the end."""
    left, add = [], Scratch.add
    size = lambda at: sum(f.stat().st_size for f in Path(at.removeprefix("file:"), "level1/kind=state").rglob("*.parquet"))

    def spy(self, df, name, *by):
        if name == "scores":
            left.append((size(self.at), self.at))
        add(self, df, name, *by)

    monkeypatch.setattr(Scratch, "add", spy)
    rnd = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice("abcd") for _ in range(60))) for i in range(80)], "doc_id long, text string").repartition(2)
    assert st.lm_score(docs, F.lit(True), depth=1, block_bytes=2000).count() == 80
    sizes = [x for x, _ in left]
    assert len(sizes) == st.PASSES and all(x > y for x, y in zip(sizes, sizes[1:], strict=False)) and size(left[0][1]) == 0


def test_only_pairs_whose_shorter_pair_is_an_entry_are_asked():
    """Three words can't be frequent if the last two aren't."""
    rnd = np.random.default_rng(4)
    word, sizes = rnd.zipf(1.3, 3000).clip(1, 60).astype(np.int32) - 1, np.full(60, 50, np.int32)
    words = rnd.integers(1, 2**63, 60).astype(np.uint64)
    level = st.Level.first(word, np.ones(60, np.uint8), np.bincount(word, minlength=60), words, sizes, 9000)
    on, pair, keys, n, _ = level.pairs()
    at = np.flatnonzero(n >= 8)
    longer = level.next(level.entry(on, pair, at, len(keys)), keys[at], n[at].astype(np.int64), level.p)
    asked = longer.pairs()[3]
    texts = word.reshape(60, 50).tolist()
    twos = collections.Counter(t for s in texts for t in zip(s, s[1:], strict=False))
    threes = collections.Counter(t for s in texts for t in zip(s, s[1:], s[2:], strict=False))
    want = [k for t, k in threes.items() if twos[t[:2]] >= 8 and twos[t[1:]] >= 8]
    assert sorted(asked.tolist()) == sorted(want) and sum(k >= 8 for k in want) == sum(k >= 8 for k in threes.values()) > 0
    assert len(want) < sum(twos[t[:2]] >= 8 for t in threes)
