import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from parchment.llm import jaccard
from parchment.llm.common import text_bytes
from parchment.llm.graph import local_components

SHAPES = "doc_id long, text string"


def grams(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def copies():
    """Texts in groups of similarity from about 0.5 to 1 to each other, in chains, and short and empty ones."""
    rnd = random.Random(8)
    out = [None, "", " ", "one two", "One two", "one two three"]
    for g in range(30):
        base = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(40, 400))]
        for k in range(6):
            w = list(base) if k != 3 else out[-1].split()
            for _ in range(int(len(w) * rnd.choice([0, 0.004, 0.012, 0.02, 0.03, 0.08]))):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
            out.append(" ".join(w))
    return out


def test_pipeline_drops_copies_of_similarity_08(spark, sf):
    texts = copies()
    sets = [grams(t) for t in texts]
    similar = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j]) for i, j in pairs) > 20
    label = local_components(len(texts), *np.array(pairs).T)
    df = spark.createDataFrame(list(enumerate(texts)), SHAPES).repartition(3)
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()} == dict(enumerate(label.tolist()))
    kept = corpus_pipeline.drop_near_duplicates(spark, df, sf)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label.tolist()))


def test_shingle_sets_and_buckets():
    texts = ["a b c d e f a b c d e f", "a b c d e f a b c d  E F", "", "x", *copies()[6:30]]
    data, offsets = text_bytes(pa.array(texts))
    hashes, starts, fp = jaccard.sets_of(data, offsets)
    assert np.diff(starts).tolist() == [len(grams(t)) for t in texts] and fp[0] == fp[1] and fp[2] == 0
    full = np.flatnonzero(np.diff(starts))
    keys = jaccard.bands_of(hashes, np.append(starts[full], len(hashes)))
    assert keys.shape == (len(texts) - 1, jaccard.BANDS) and (keys[0] == keys[1]).all() and len(np.unique(keys[0])) == jaccard.BANDS
