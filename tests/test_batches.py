"""Statement pages, ledgers and pairs of pages by whole batches, against plain versions that take one at a time."""

import random
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from parchment.functions import decimals, statement
from parchment.operators import joins, ledger, run

HEADS = [
    [["Date", "Particulars", "Withdrawal", "Deposit", "Balance"]], [["วันที่", "รายการ", "ถอน", "ฝาก", "ยอดคงเหลือ"], ["Date", "Particulars", "Withdrawal", "Deposit", "Balance"]],
    [["Date", "Withdrawal/Deposit", "Balance", "Channel"]], [["Date", "Description", "Amount", "Balance"]], [["Date", "Date", "Amount", "Withdrawal/Deposit", "Balance"]], [["no", "header"]], [["x"]],
]
CELLS = [
    "", "", "1/2/2024", "3/4/2024", "5 Mar 24", "B/F", "opening balance", "order 1", " two  words ", "5.00", "-5.00", "-0.00", "1,234.5", "(7.25)", "5.00 CR", "6 dr", "+3", "-", "๑๒.๕๐", "1.5,0", ",5", "-,5", "5.", "0.00005",
    "99999999999999", "999999999999999.99", "12345678901234567890", "1.23456", "1e3", "Account No. 123-4-56789", "ถอน", None,
]


def _page(rng):
    table = lambda: [[rng.choice(CELLS) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(2))] + rng.choice(HEADS) + [[rng.choice(["1/2/2024", rng.choice(CELLS)]), *(rng.choice(CELLS) for _ in range(rng.randrange(6)))] for _ in range(rng.randrange(12))]
    blocks = [{"type": "text", "text": rng.choice(["Account Name\nSomchai Jaidee", "opening balance 12.50", "Account No. 123-4-56789", None])} for _ in range(rng.randrange(3))]
    return [table() for _ in range(rng.randrange(3))], blocks, rng.choice(["", None, "period 1/2/2024 - 3/4/2024"])


def test_batches_of_pages_are_those_read_one_by_one():
    rng = random.Random(5)
    pages = [_page(rng) for _ in range(3 * statement.HELD + 7)]
    tables = pa.array([None, *(p[0] for p in pages)], pa.list_(pa.list_(pa.list_(pa.string()))))[1:]
    blocks = pa.array([p[1] for p in pages], pa.list_(pa.struct({"type": pa.string(), "text": pa.string()})))
    n = len(pages)
    got = statement._map_pages.func(tables, blocks, pa.array([p[2] for p in pages], pa.string()), pa.nulls(n, pa.string()), pa.array([i % 2 == 0 for i in range(n)])).to_pylist()
    text = lambda t: [[[c or "" for c in r] for r in rows] for rows in t]
    want = [statement._stored(statement.map_page(text(t), b, x)) for t, b, x in pages]
    assert pa.array(got, to_arrow_type(statement.PAGE)) == pa.array(want, to_arrow_type(statement.PAGE))
    assert sum(len(p["rows"]) for p in got) > 1000


def test_plain_tables_are_read_as_columns(monkeypatch):
    called = []
    monkeypatch.setattr(statement, "transaction", lambda *a: called.append(a))
    rows = [["Date", "Withdrawal", "Deposit", "Balance"], ["", "", "", "1.00"], ["1/2/2024", "", "5.00", "6.00"], ["", "2.00", "", "4.00"]]
    got = statement._map_pages.func(pa.array([[rows]] * 3), pa.nulls(3, pa.list_(pa.struct({"type": pa.string(), "text": pa.string()}))), pa.nulls(3, pa.string()), pa.nulls(3, pa.string()), pa.array([False] * 3)).to_pylist()
    assert [(r["date"], r["debit"], r["credit"], r["balance"]) for r in got[2]["rows"]] == [("2024-02-01", None, Decimal(5), Decimal(6)), ("2024-02-01", Decimal(2), None, Decimal(4))]
    assert not called


def test_decimals_of_any_size():
    values = [None, Decimal("-0.0001"), Decimal("9999999999999999.9999"), Decimal("-9999999999999999.9999"), Decimal(0), None, Decimal("922337203685477.5808")]
    a = pa.array(values, decimals.KIND)
    for part, held in ((a, values), (a[1:2], values[1:2]), (a[3:], values[3:]), (a[:1], [None])):
        assert decimals.whole(part) == [None if v is None else int(v * 10000) for v in held]
        assert decimals.of_whole(decimals.whole(part)).to_pylist() == held


def _checks(rows, opening, derived, declared):
    """The fold in decimals, a row at a time."""
    running, page, seen, zero = opening, None, False, Decimal(0)
    checks, debit, credit = [], zero, zero
    for i, r in enumerate(rows, 1):
        net, actual, starts = r["net"], r["balance"], seen and r["page_no"] != page
        said = declared.get(r["page_no"]) if starts else None
        gap = said is not None and running is not None and said != running
        running = said if gap else running
        side = verdict = None
        judged = True
        if net is None and r["amount"] is not None and running is not None and actual is not None:
            delta, judged = actual - running, False
            net, side, verdict = (delta, "credit" if delta > 0 else "debit", None) if delta and abs(delta) == r["amount"] else (None, None, False)
        expected = None if running is None or net is None else running + net
        if judged and expected is not None and actual is not None and not (i == 1 and derived):
            verdict = actual == expected
        checks.append({"row_index": i, "page_no": r["page_no"], "page_row_index": r["pos"], "expected": expected, "actual": actual, "consistent": verdict, "inferred": side, "gap": gap or (verdict is False and starts)})
        debit, credit = debit + max(-(net or zero), zero), credit + max(net or zero, zero)
        running, page, seen = expected if actual is None else actual, r["page_no"], True
    return {"checks": checks, "debit": debit, "credit": credit, "running": running}


def test_ledgers_of_a_batch():
    rng, some = random.Random(3), lambda *v: rng.choice([None, *map(Decimal, v)])
    files = [[{"page_no": 1 + i // 3, "pos": i % 3, "date": None, "net": some(1, -1, 2), "amount": some(1, 2), "balance": some(0, 1, 2, 3, "900000000000000.5")} for i in range(rng.randrange(9))] for _ in range(300)]
    heads = [[{"page_no": p, "opening_balance": some(0, 1, 2)} for p in (1, 2, 2, 3)][: rng.randrange(5)] for _ in files]
    opening, derived = [some(0, 1) for _ in files], [rng.random() < 0.5 for _ in files]
    money = pa.decimal128(20, 4)
    row = pa.struct({"page_no": pa.int32(), "pos": pa.int32(), "date": pa.string(), "net": money, "amount": money, "balance": money})
    rows, pages = pa.array([files[0], *files], pa.list_(row))[1:], pa.array([heads[0], *heads], pa.list_(pa.struct({"page_no": pa.int32(), "opening_balance": money})))[1:]
    got = ledger._check_rows.func(rows, pa.array(opening, money), pa.array(derived), pages)
    want = [_checks(r, o, d, {p["page_no"]: p["opening_balance"] for p in h}) for r, o, d, h in zip(files, opening, derived, heads, strict=True)]
    assert got.to_pylist() == want


def _random_page(rng):
    some = lambda *v: rng.choice([None, *map(Decimal, v)])
    rows = [{"date": rng.choice(["2024-01-01", "2024-01-02", None]), "description": None, "debit": some(1), "credit": some(2), "amount": some(3), "balance": some(1, 2), "channel": None} for _ in range(rng.randrange(5))]
    head = {"account_no": rng.choice([None, "1-2", "12", "3"]), "account_name": rng.choice([None, "a"]), "period_start": None, "period_end": None, "opening_balance": some(1, 2), "closing_balance": some(1), "total_debit": None, "total_credit": None, "has_header": True}
    return head | {"rows": rows}


def test_pairs_of_pages(spark):
    rng = random.Random(8)
    pages = [[_random_page(rng) for _ in range(3)] for _ in range(200)]
    for p in pages[::2]:
        p[1]["rows"] = [dict(r, balance=rng.choice([Decimal(1), None])) for r in p[0]["rows"]]
    page = statement.PAGE.simpleString()
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], f"i int, a {page}, b {page}, z {page}")
    got = df.select("i", run.verdicts(F.col("a"), F.col("b")).alias("v"), run.flags(F.col("a"), F.col("b"), F.col("z")).alias("f")).orderBy("i").collect()
    heads = lambda p: [(f, None, "".join(filter(str.isdigit, p[f])) if f == "account_no" and p[f] else p[f]) for f in statement.SCORED]
    cells = lambda p: {(f, i): v for f, i, v in heads(p)} | {(c, i): r[c] for i, r in enumerate(p["rows"]) for c in statement.CELLS}
    key = lambda r: (r["date"], next((abs(v) for v in (r["debit"], r["credit"], r["amount"]) if v is not None), None))
    for (a, b, z), r in zip(pages, got, strict=True):
        want = [None if x[2] is None or y[2] is None else x[2] == y[2] for x, y in zip(heads(a), heads(b), strict=True)]
        for k in {key(x) for x in a["rows"] + b["rows"]}:
            x, y = ([r["balance"] for r in p["rows"] if key(r) == k] for p in (a, b))
            want += [None if u is None or v is None else u == v for u, v in zip(x, y, strict=False)] + [False] * abs(len(x) - len(y))
        assert sorted(map(str, r.v)) == sorted(map(str, want))
        a, b, z = cells(a), cells(b), cells(z)
        assert sorted(r.f) == sorted(a.get(k) != z.get(k) or b.get(k) != z.get(k) for k in a.keys() | b.keys() if a.get(k) != b.get(k))


def test_pairs_are_read_once_for_both_scores(spark):
    one = spark.createDataFrame([("a",), ("b",)], "model string").select(F.lit("s").alias("sample_id"), F.lit("c").alias("condition"), "model", *(F.lit(None).cast("string").alias(c) for c in run.SLICES), F.lit(None).cast(statement.PAGE).alias("page"))
    got = run.pair_scores(run.page_pairs(one), spark.createDataFrame([("s", None)], f"sample_id string, page {statement.PAGE.simpleString()}"))
    assert sorted(r.metric for r in got.collect()) == ["agreement_flag_precision", "agreement_rate"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("collect_list(struct(model") == 1


def test_repeated_predictions_stay_once_without_aggregates(spark):
    m = spark.createDataFrame([("s", "c")], "sample_id string, condition string")
    p = spark.createDataFrame([("s", "c", "a", ["x"], 1), ("s", "c", "a", ["y"], 2)], "sample_id string, condition string, model string, tables array<string>, rank int")
    out = joins.with_predictions(m, p, ["sample_id", "condition"], ["a", "b"])
    assert sorted((r.model, r.missing, r.tables is None) for r in out.collect()) == [("a", False, False), ("b", True, True)] and "rank" in out.columns
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()
