"""Order inside groups of any size, and ledgers scanned in parts, against windows and the fold over a file."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parchment.operators import ledger, ledger_scan, ordered

ROWS = "k string, page_no int, pos int, date string, debit decimal(20,4), credit decimal(20,4), amount decimal(20,4), balance decimal(20,4)"
PAGES = "k string, page_no int, opening_balance decimal(20,4), closing_balance decimal(20,4), total_debit decimal(20,4), total_credit decimal(20,4)"


def test_rank_and_neighbours_split_a_group(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.randrange(1000)) for i in range(600)] + [("one", 900, 1)]
    df = spark.createDataFrame(rows, "g string, id int, v int")
    w = Window.partitionBy("g").orderBy("v", "id")
    got = {r.id: r.rank for r in ordered.rank(df, ["g"], ["v", "id"], parts=7).collect()}
    assert got == {r.id: r.rank for r in df.withColumn("rank", F.row_number().over(w)).collect()}
    near = {r.id: (r.before and r.before.id, r.after and r.after.id) for r in ordered.neighbours(df, ["g"], ["v", "id"], ["id"], parts=7).collect()}
    assert near == {r.id: (r.a, r.b) for r in df.select("id", F.lag("id").over(w).alias("a"), F.lead("id").over(w).alias("b")).collect()}
    whole = Window.partitionBy("g")
    ring = {r.id: (r.before.id, r.after.id) for r in ordered.neighbours(df, ["g"], ["v", "id"], ["id"], circular=True, parts=7).collect()}
    first, last = F.min(F.struct("v", "id")).over(whole)["id"], F.max(F.struct("v", "id")).over(whole)["id"]
    assert ring == {r.id: (r.a, r.b) for r in df.select("id", F.coalesce(F.lag("id").over(w), last).alias("a"), F.coalesce(F.lead("id").over(w), first).alias("b")).collect()}
    parts = ordered.ranged(df, ["g"], ["v", "id"], 7).where("g = 'hot'").select("_part").distinct().count()
    assert parts > 3  # the large group lies in several parts
    assert ordered.rank(df.where("false"), ["g"], ["v"]).count() == 0


def test_maps_compose(spark):
    """Any sequence of maps: the running value in front of each row is what a loop gives."""
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        running = start = rng.choice([None, Decimal(5)])
        for i in range(rng.randrange(1, 60)):
            kind = rng.choice(["set", "add", "add", "add", "reset"])
            value = None if kind == "set" and rng.random() < 0.4 else Decimal(rng.randrange(-9, 10))
            rows.append((g, i, kind, value, start))
            want[g, i] = running
            running = value if kind == "set" else None if running is None else running + value if kind == "add" else value
    df = spark.createDataFrame(rows, "g int, i int, kind string, value decimal(20,4), start decimal(20,4)")
    t = ordered.ranged(df, ["g"], ["i"], 9).withColumn("m", ordered.mapped(F.col("kind"), F.col("value")))
    got = ordered.running_before(t, "m", "i", "_part", "start").collect()
    assert {(r.g, r.i): r.running for r in got} == want


def random_file(rng, k):
    """Rows and pages of a file with misprints, missing balances, unsigned amounts, declared balances and either order."""
    rows, pages, running = [], [], Decimal(rng.randrange(50, 200))
    opening = running
    for p in range(1, rng.randrange(2, 6)):
        said = rng.choice([None, None, running, running + 1])
        pages.append((k, p, opening if p == 1 and rng.random() < 0.5 else said, running if rng.random() < 0.3 else None, rng.choice([None, Decimal(3)]), None))
        for pos in range(rng.randrange(0, 7)):
            amount = Decimal(rng.randrange(1, 40))
            side = rng.choice(["debit", "credit", "amount", "none", "both"])
            running += amount if side == "credit" or side == "amount" and rng.random() < 0.5 else -amount if side in ("debit", "amount") else 0
            printed = None if rng.random() < 0.25 else running + (rng.random() < 0.1)
            rows.append((k, p, pos, rng.choice([None, "", f"2024-0{p}-{pos + 10}"]), amount if side in ("debit", "both") else None, amount if side in ("credit", "both") else None, amount if side in ("amount", "both") and rng.random() < 0.9 else None, printed))
    if rng.random() < 0.4:  # newest first
        n = {}
        flipped = []
        for r in rows[::-1]:
            page = 6 - r[1]
            n[page] = n.get(page, -1) + 1
            flipped.append((k, page, n[page], *r[3:]))
        rows, pages = flipped, [(k, 6 - p[1], *p[2:]) for p in pages]
    return rows, pages


COLUMNS = "newest_first opening_balance n_rows sum_debit sum_credit first_break_row row_consistency_rate total_mismatch closing_mismatch flags file_reconciles".split()


@pytest.mark.parametrize("parts", [1, 9])
def test_ledger_scan_equals_the_fold(spark, parts):
    rng = random.Random(parts)
    rows, pages = [], []
    for k in range(150):
        r, p = random_file(rng, f"f{k}" if k else None)
        rows, pages = rows + r, pages + p
    pages.append(("f3", 2, Decimal(7), None, None, None))  # a page given twice
    r, p = spark.createDataFrame(rows, ROWS), spark.createDataFrame(pages, PAGES)
    want = {x.k: x for x in ledger.check_files(r, p, ["k"]).where("k is not null").collect()}
    checks, files = ledger_scan.scan_files(r, p, ["k"], parts)
    faults = {x.k: x for x in ledger_scan.fault_lists(checks, ["k"]).collect()}
    by_file = {}
    for c in checks.orderBy("row_index").collect():
        by_file.setdefault(c.k, []).append(c)
    got = {x.k: x for x in files.collect()}
    assert set(got) == {*want, None} and got[None].n_rows == sum(x[0] is None for x in rows)
    for k, w in want.items():
        assert [got[k][c] for c in COLUMNS] == [w[c] for c in COLUMNS], k
        same = lambda c: (c.row_index, c.page_no, c.page_row_index, c.expected, c.actual, c.consistent, c.inferred, c.gap)
        assert [same(c) for c in by_file.get(k, [])] == [same(c) for c in w.checks], k
        assert (faults[k].balance_mismatch_rows if k in faults else []) == w.balance_mismatch_rows
        assert (faults[k].page_gap_pages if k in faults else []) == w.page_gap_pages


def test_one_long_ledger(spark):
    """One file of 200,000 rows over many parts, every 1,000th balance misprinted, most balances missing."""
    n = spark.range(1, 200_001)
    none = F.lit(None).cast("decimal(20,4)")
    printed = F.when(F.col("id") % 10 == 0, F.col("id") + (F.col("id") % 1000 == 0).cast("int")).cast("decimal(20,4)")
    rows = n.select(F.lit("long").alias("k"), (F.col("id") / 500).cast("int").alias("page_no"), (F.col("id") % 500).cast("int").alias("pos"), F.lit(None).cast("string").alias("date"), none.alias("debit"), F.lit(1).cast("decimal(20,4)").alias("credit"), none.alias("amount"), printed.alias("balance"))
    pages = spark.createDataFrame([("long", 0, Decimal(0), None, None, Decimal(200_000))], PAGES)
    checks, files = ledger_scan.scan_files(rows, pages, ["k"], 16)
    (f,) = files.collect()
    # A misprint breaks its own row, and the next printed one, ten rows on.
    assert (f.n_rows, f.n_judged, f.n_mismatches, f.first_break_row, f.total_mismatch) == (200_000, 20_000, 399, 1000, False)
    assert f.row_consistency_rate == pytest.approx(1 - 399 / 20_000) and f.flags == ["balance_mismatch", "page_gap"]
    assert checks.where("expected is null").count() == 0
