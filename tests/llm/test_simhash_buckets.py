import itertools
import math
import random

import numpy as np
import pytest

from parchment.llm import jaccard
from parchment.llm.common import Scratch
from parchment.llm.graph import local_components

ROWS = "fp long, sim binary, brief array<int>"


def prints(spark, groups=40, each=6, seed=3):
    """Rows of links(), of groups whose fingerprints differ by up to about 100 bits, and of sets that are alike or not."""
    rnd, out = random.Random(seed), []
    for g in range(groups):
        base = [rnd.getrandbits(jaccard.BITS), list(range(1000 * g, 1000 * g + 50))]
        for _ in range(each):
            sim = base[0]
            for bit in rnd.sample(range(jaccard.BITS), rnd.choice([0, 5, 30, 45, 100])):
                sim ^= 1 << bit
            brief = base[1][rnd.choice([0, 0, 1, 2, 20]) :]
            out.append((rnd.getrandbits(62), sim.to_bytes(jaccard.BITS // 8, "little"), brief))
    return out


def wanted(rows):
    sets, sims = [set(r[2]) for r in rows], [int.from_bytes(r[1], "little") for r in rows]
    pairs = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if (sims[i] ^ sims[j]).bit_count() <= jaccard.RADIUS and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    return pairs, local_components(len(rows), *np.array(pairs).T)


@pytest.mark.parametrize(("tile", "bucket"), [(2048, 1024), (16, 1024), (2048, 20), (7, 20)])
def test_sets_meet_by_their_fingerprints_alone(spark, tile, bucket):
    """Whole buckets, buckets in tiles, and sampled bits: components are those of all pairs within the radius."""
    rows = prints(spark)
    _, label = wanted(rows)
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    at = {r[0]: i for i, r in enumerate(rows)}
    edges = [(at[r.a], at[r.b]) for r in jaccard.links(df, Scratch(spark, "test"), tile, bucket).collect()]
    assert local_components(len(rows), *np.array(edges).T).tolist() == label.tolist()


def test_buckets_are_sampled_bits():
    rnd = np.random.default_rng(4)
    sim = rnd.integers(0, 2**64, (50, jaccard.BITS // 64), dtype=np.uint64)
    chosen = jaccard.samples(9, 5)
    keys = jaccard.keys_of(sim, chosen, 3)
    value = [int.from_bytes(s.tobytes(), "little") for s in sim]
    assert keys.tolist() == [[int(f"{3 + t}", 10) << 9 | int("".join(str(v >> int(b) & 1) for b in chosen[t]), 2) for t in range(5)] for v in value]


def test_tables_leave_few_pairs_apart():
    assert jaccard.tables_for(jaccard.BUCKET) == (0, 1)  # all with all
    rnd, share = np.random.default_rng(5), math.acos(8 / 9) / math.pi
    bits, tables = jaccard.tables_for(200_000)
    x = rnd.integers(0, 2**64, (20_000, jaccard.BITS // 64), dtype=np.uint64)
    flip = np.packbits(rnd.random((len(x), jaccard.BITS)) < share, axis=1, bitorder="little").view(np.uint64)
    chosen = jaccard.samples(bits, tables)
    met = (jaccard.keys_of(x, chosen) == jaccard.keys_of(x ^ flip, chosen)).any(1)
    assert (~met).sum() <= 3 and (np.bitwise_count(flip).sum(1) <= jaccard.RADIUS).all()
