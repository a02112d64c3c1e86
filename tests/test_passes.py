"""Scans and queues work their rows out once."""

import random

from pyspark.sql import functions as F

from parchment.operators import draws, ledger_scan, ordered
from parchment.operators.ledger import MONEY


def _counted(spark):
    count = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def told(x):
        count.add(1)
        return x

    return count, told.asNondeterministic()


def test_running_rows_are_worked_out_once(spark):
    rows = [(k, i, (i * 37 + k) % 11 - 5) for k in range(3) for i in range(40)]
    dealt = ordered.ranged(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], 5)
    count, told = _counted(spark)
    x = dealt.withColumn("w", told("v")).withColumns({"m": ordered.mapped(F.lit(ordered.ADD), F.col("w")), "start": F.lit(0)})
    got = ordered.running_before(x, "m", "i", ordered.PART, "start").collect()
    assert {(r.k, r.i): int(r.running) for r in got} == {(k, i): sum(v for j, n, v in rows if j == k and n < i) for k, i, _ in rows}
    assert count.value == len(rows)


def test_places_and_sums_in_one_pass(spark):
    rows = [(random.Random(i).choice(["a", "a", "a", "b", None]), i, i * i % 7 if i % 9 else None) for i in range(90)]
    dealt = ordered.ranged(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], 6)
    got = {r.i: (r.n, r.s) for r in ordered.with_running(dealt, ["i"], "v", "n", "s").collect()}
    same = {i: [v for j, n, v in rows if j == k and n < i] for k, i, _ in rows}
    assert got == {i: (len(x) + 1, sum(v or 0 for v in x)) for i, x in same.items()}


def test_files_alone_are_those_with_checks(spark):
    rows = [(f"f{i % 3}", i // 20, i, f"2024-01-{i % 28 + 1:02d}", None, i % 13, None, i * 3 if i % 4 else None) for i in range(120)]
    r = spark.createDataFrame(rows, "k string, page_no int, pos int, date string, debit int, credit int, amount int, balance int")
    null = F.lit(None).cast(MONEY)
    pages = r.select("k", "page_no").distinct().select("*", F.when(F.col("page_no") == 0, F.lit(0)).cast(MONEY).alias("opening_balance"), *(null.alias(c) for c in ("closing_balance", "total_debit", "total_credit")))
    key = lambda df: sorted(map(str, df.collect()))
    both, alone = ledger_scan.scan_files(r, pages, ["k"], 5), ledger_scan.scan_files(r, pages, ["k"], 5, only_files=True)
    assert key(both[1]) == key(alone[1]) and key(both[0]) == key(alone[0]) and len(key(alone[1])) == 3


def test_cells_are_compared_once(spark):
    cells = [(s, m, s % 5 if m == "a" or s % 7 else 9) for s in range(200) for m in ("a", "b")]
    count, told = _counted(spark)
    df = spark.createDataFrame(cells, "s int, model string, v int").select("s", "model", told("v").alias("value"))
    got = draws.review_queue(df, ["s"], ["s"], 0.3, 9, parts=5)
    r, want = random.Random(9), set()
    for s in range(200):
        differs = s % 7 == 0 and s % 5 != 9
        if differs or r.random() < 0.3:
            want.add((s, differs))
    assert {(x.s, x.differs) for x in got.collect()} == want
    assert count.value == len(cells)


def test_blocks_in_order_take_one_jump(monkeypatch):
    jumps, jump = [], draws.state_after
    monkeypatch.setattr(draws, "state_after", lambda *at: (jumps.append(at), jump(*at))[1])
    got = [draws._block("once", n) for n in (2, 3, 4, 1, 3, 2, 5)]
    assert len(jumps) == 3  # 2, 1 and 5: blocks 3 and 2 are held, and 5 doesn't follow block 1
    for n, x in zip((2, 3, 4, 1, 3, 2, 5), got, strict=True):
        assert x.tolist() == draws.draws("once", n * draws.BLOCK, draws.BLOCK).tolist()
