"""Grouping, turns and balls against plain versions, on odd tables, and in pieces."""

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import balls, grouping, turns
from parchment.llm.common import Scratch

# --- grouping ----------------------------------------------------------------------------------------------------


def plain_ids(texts):
    import public_tokenizers
    import tokenizers

    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in texts]


def test_best_fit_takes_the_least_room():
    rng = random.Random(3)
    for _ in range(200):
        cap, sizes, room = 20, [rng.randrange(1, 20) for _ in range(12)], [rng.randrange(0, 20) for _ in range(5)]
        open_ = [b for b, r in enumerate(room) if r]
        where, left = grouping.best_fit(sizes, open_, [room[b] for b in open_], 5, cap)
        now = dict(enumerate(room))
        for s, b in zip(sizes, where, strict=True):
            fits = [r for r in now.values() if r >= s]
            assert (now[b] if b in now else None) == (min(fits) if fits else None)
            now[b] = now.get(b, cap) - s
        assert {b: r for b, r in now.items() if b in left} == left


def test_breeding_keeps_items_and_finds_the_least():
    """Every child holds each item once and no sequence too full; small shards reach the least number of sequences."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        sizes = rng.integers(1, 100, n)
        population = grouping.founders(sizes, 100, 4, rng)
        for _ in range(3):
            population = grouping.breed(population, sizes, 100, 40, 4, rng)
            for p in population:
                assert (p.room == 100 - np.bincount(p.where, sizes)).all() and p.room.min() >= 0 and len(p.where) == n
        assert population[0].cost == min(p.cost for p in population)
    # Three pairs that only fit as pairs: best fit by size does it, and so does what is bred from a bad packing.
    sizes = np.array([60, 60, 60, 40, 40, 40])
    bad = grouping.Packing.of(np.array([0, 1, 2, 3, 3, 4]), sizes, 100)
    assert grouping.breed([bad], sizes, 100, 60, 4, rng)[0].ideal(sizes, 100)


def least_sequences(sizes, cap):
    """By all ways to group, of few items."""
    best = [len(sizes)]

    def go(i, room):
        if len(room) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(room)
            return
        for b in range(len(room)):
            if room[b] >= sizes[i]:
                go(i + 1, [*room[:b], room[b] - sizes[i], *room[b + 1 :]])
        go(i + 1, [*room, cap - sizes[i]])

    go(0, [])
    return best[0]


def test_few_items_by_brute_force(spark):
    rng = random.Random(5)
    for k in range(3):
        sizes = [rng.randrange(5, 60) for _ in range(9)]
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "uid long, length long")
        rows = grouping.group(df, Scratch(spark, "test"), 100).collect()
        assert len({r.sequence_id for r in rows}) == least_sequences(sizes, 100), sizes


def check_pieces(rows, length):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for rs in by.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == [0, *itertools.accumulate(r.length for r in rs)][:-1] and sum(r.length for r in rs) <= length
    return by


def test_whole_documents(spark):
    """Null, empty and long texts, repeated rows and null ids, clashing columns; several shards, so several levels."""
    rng = random.Random(9)
    texts = [None, "", "one", "word " * 100, "x" * 400, *("lorem ipsum " * rng.randrange(1, 9) for _ in range(300))]
    docs = [(i if i != 2 else None, t, "s", 1, 2) for i, t in enumerate(texts)] + [(5, texts[5], "s", 1, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string, shard string, uid int, length int")
    rows = grouping.pack_whole(df, length=64, shard=40).collect()
    by = check_pieces(rows, 64)
    want = sorted((str(d), x.tobytes()) for d, x in zip([d[0] for d in docs], plain_ids([d[1] for d in docs]), strict=True))
    pieces = defaultdict(list)
    for r in rows:
        pieces[str(r.doc_id)].append(r)
    for d, group in itertools.groupby(want, key=lambda x: x[0]):
        told = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces.pop(d))
        all_ = []
        for _, b in group:
            x = np.frombuffer(b, "<u4")
            cut = list(range((len(x) - 1) % 64 + 1, len(x) + 1, 64))
            all_ += [(k, a, e - a, zlib.crc32(x[a:e].tobytes())) for k, (a, e) in enumerate(zip([0, *cut], cut))]
        assert told == sorted(all_), d
    assert not pieces
    assert len(by) <= -(-sum(r.length for r in rows) // 64) + 2
    assert grouping.pack_whole(df.where("false")).count() == 0


# --- turns -------------------------------------------------------------------------------------------------------


def plain_plan(rows, longest=12):
    """Cheapest, then ASCII-least edits of (initial, fault) rows, by Dijkstra over (place, state) with whole audits."""
    import heapq

    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        state = "" if not roles else "s" if roles == "s" else roles[-1]
        if i == len(rows) and state in ("", "a"):
            return cost, audit
        if (i, state) in seen:
            continue
        seen.add((i, state))
        due = "u" if state in ("", "s", "a") else "a"
        heapq.heappush(heap, (cost + 5, audit + "I", i, roles + due))
        if i < len(rows):
            kind, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, roles))
            if fault not in (turns.BLANK, turns.DUPLICATE):
                stays = 5 * (fault == turns.TRUNCATED)
                heapq.heappush(heap, (cost + 1 + stays, audit + "R", i + 1, roles + due))
                if kind == due or kind == "s" and roles == "":
                    heapq.heappush(heap, (cost + stays, audit + "K", i + 1, roles + kind))


def test_plans_by_brute_force():
    rng = random.Random(6)
    for _ in range(3000):
        rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 9))]
        codes = bytes(turns.CLASSES.get(k, 3) | f << 2 for k, f in rows)
        assert turns.plan(codes) == plain_plan(rows), rows


def plain_repair(rows):
    """All facts of one conversation's (turn, role, text) rows."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, marks, told = set(), [], []
    for _, role, text in rows:
        end = text.strip(turns.SPACES)[-1:]
        f = turns.BLANK if not end else turns.DUPLICATE if (role, text) in seen else turns.TRUNCATED if end not in ".!?" else 0
        seen.add((role, text))
        marks.append((role[:1], f))
    known = [t for t, _, _ in rows if t is not None]
    cost, audit = plain_plan([(k if k in "sua" and k else "x", f) for k, f in marks])
    state, i = 0, 0
    for e in audit:
        role = ["user", "user", "assistant", "user"][state]
        if e == "I":
            told.append(f"{role}:")
        elif e == "R":
            told.append(f"{role}:{rows[i][2]}")
        elif e == "K":
            told.append(f"{rows[i][1]}:{rows[i][2]}")
            role = rows[i][1]
        i += e != "I"
        state = state if e == "D" else {"s": 1, "u": 2, "a": 3}[role[0]]
    count = lambda f: sum(m[1] == f for m in marks)
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, count(1), count(2), count(3), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())


def test_repair_by_brute_force(spark):
    """Whole conversations and, with small chunks, long ones in pieces; null turns, ties, repeats, odd roles and texts."""
    rng, rows = random.Random(12), []
    texts = ["Hello there.", "no end", "", " \t", "What?", "Yes!\n", "é…", "a\nb.", "x" * 300 + "."]
    for conv in [None, *range(60)]:
        for _ in range(rng.randrange(1, 40 if conv == 7 else 9)):
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 5, 9, -4]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "u"]), rng.choice(texts), rng.random() < 0.1))
    rows.append((99, 1, "user", "gone.", True))
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, gone boolean")
    want = {c: plain_repair([r[1:4] for r in rows if r[0] == c and not r[4]]) for c in {r[0] for r in rows}}
    for chunk in ((1 << 20, 1000), (200, 3)):
        repaired = turns.repair(df, *chunk)
        assert {r.conv: tuple(r)[1:] for r in turns.digests(repaired).collect()} == want
        if chunk[1] == 3:
            assert repaired.where("chunk > 0").count() > 5
    assert want[99] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert turns.digests(turns.repair(df.where("false"))).count() == 0


def test_damage(spark):
    """Null columns count as one space; kinds by the crc32; extra columns with clashing names."""
    rows = [(i, j, r, t) for i in [None, *range(30)] for j in [None, 0, 1] for r, t in ((None, "A.b!"), ("user", None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("k"), "gone": F.lit(1), "_": F.lit(0)})
    want = []
    for i, j, r, t in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if j is None else j}".encode()) % 20
        r, t = " " if r is None else r, " " if t is None else t
        t = "" if kind == 1 else t.translate({ord(c): None for c in ".!?"}) if kind == 2 else t
        want += [(i, j, "user" if kind == 4 else r, t, kind == 0)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, turns.damaged(df).collect()))) == sorted(map(repr, want))


def test_hot_keys_are_dealt(spark, monkeypatch):
    """A key of very many rows is met by broadcast, with the same flags."""
    rows = [(1, i, "user", "again." if i % 3 else f"t{i}.", False) for i in range(200)] + [(None, i, "user", "again.", False) for i in range(9)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, gone boolean")
    plain = sorted(map(repr, map(tuple, turns.flagged(df).collect())))
    monkeypatch.setattr(turns, "often_from", lambda n: 5)
    assert sorted(map(repr, map(tuple, turns.flagged(df).collect()))) == plain
    assert sum("later" in x or x.endswith("True)") for x in plain) == 133 - 1 + 8


# --- balls -------------------------------------------------------------------------------------------------------


def plain_means(rows, k, rounds, scale=1024, seed=3):
    """k-means in Python's whole numbers, every vector against every centroid."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        by = defaultdict(list)
        for _, v in kept:
            by[near(v)[1]].append(v)
        centroids = [[sum(x) // len(by[j]) for x in zip(*by[j])] if by[j] else c for j, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], near(v)[0]) for i, v in kept), key=repr), centroids


@pytest.mark.parametrize("k", [1, 3, 8])
def test_balls_are_exact(spark, k):
    """Clumped vectors on a small grid, with many ties, repeats and empty clusters; null, short and odd vectors left out."""
    rng = random.Random(k)
    rows = [(rng.choice([None, *range(400)]), [rng.choice([0.0, 0.001, 0.002, 0.5]) * rng.choice([1, 1, -1]) for _ in range(4)]) for _ in range(300)]
    rows += rows[:40]
    odd = [(900, None), (901, [1.0, 2.0, 3.0]), (902, [1.0, None, 3.0, 4.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf"), 1.0, 1.0, 1.0]), (905, [1e30, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"id": F.lit("x"), "v": F.lit(1), "cluster": F.lit(7)})
    found, facts = balls.cluster(df.repartition(5), clusters=k, rounds=4, width=4)
    want, centroids = plain_means(rows, k, 4)
    got = sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=repr)
    assert got == want and [f["centroid"] for f in facts] == centroids
    for j, f in enumerate(facts):
        assert (f["count"], f["inertia"]) == (sum(x[1] == j for x in want), sum(x[2] for x in want if x[1] == j))


def test_balls_skip_what_cannot_win():
    """Far clusters are never compared: nearly one distance a vector instead of one a centroid."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-100_000, 100_000, (12, 8))
    x = np.concatenate([c + rng.integers(-50, 50, (200, 8)) for c in centres])
    old = np.repeat(np.arange(12), 200)
    new, distance, work = balls.Balls(centres).nearest(x, old)
    assert (new == old).all() and work == len(x) and (distance == ((x - centres[old]) ** 2).sum(1)).all()
    wrong = rng.integers(0, 12, len(x))
    assert (balls.Balls(centres).nearest(x, wrong)[0] == old).all()


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert balls.cluster(spark.createDataFrame([], schema), width=2)[1] == [] and balls.cluster(spark.createDataFrame([], schema), width=2)[0].count() == 0
    found, facts = balls.cluster(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], schema), width=2)
    assert len(facts) == 2 and sorted((r.id, r.cluster, r.distance) for r in found.collect()) == [(1, 0, 0), (2, 0, 0)]
