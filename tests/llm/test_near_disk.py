import random

from parchment.llm import jaccard
from parchment.llm.common import Scratch

ROWS = "fp long, sim binary, brief array<int>"


class Counted(Scratch):
    """Counts the rows of each table."""

    def put(self, df, name):
        out = super().put(df, name)
        self.rows = getattr(self, "rows", {}) | {name: out.count()}
        return out


def test_only_sets_that_nothing_links_meet_by_their_whole_sets(spark):
    """Groups of linked sets in one bucket, and two sets within the radius that are unlike: only these two go on."""
    rnd, rows = random.Random(2), []
    for g in range(12):
        sim, brief = rnd.getrandbits(jaccard.BITS), list(range(1000 * g, 1000 * g + 50))
        for _ in range(4):
            rows.append((rnd.getrandbits(62), sim.to_bytes(jaccard.BITS // 8, "little"), brief))
    sim = rnd.getrandbits(jaccard.BITS).to_bytes(jaccard.BITS // 8, "little")
    unlike = [(rnd.getrandbits(62), sim, list(range(10**6 * k, 10**6 * k + 50))) for k in (1, 2)]
    scratch = Counted(spark, "test")
    edges = jaccard.links(spark.createDataFrame([*rows, *unlike], ROWS), scratch).collect()
    assert len({r.a for r in edges} | {r.b for r in edges}) == len(rows)
    assert scratch.rows["placed"] == 2


def test_marks_keep_all_wanted_and_few_others(spark):
    rnd = random.Random(3)
    fps = sorted({rnd.getrandbits(64) - 2**63 for _ in range(4000)})
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    wanted = fps[::20]
    for name, some in (("many", wanted), ("none", [])):
        kept = [r.fp for r in jaccard._marked(rows, spark.createDataFrame([(f,) for f in some], "fp long"), Scratch(spark, "test"), name).collect()]
        assert set(some) <= set(kept) and len(kept) <= len(some) * 1.5
