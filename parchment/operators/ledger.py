"""Ledger reconciliation: balance chains, totals and page boundaries of statement files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import decimals

MONEY = "decimal(20,4)"


def net(debit: Column, credit: Column) -> Column:
    return F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, F.lit(0).cast(MONEY)) - F.coalesce(debit, F.lit(0).cast(MONEY)))


def _chain(rows: Column) -> Column:
    """How many rows of an array hold the balance equation against the row before."""
    n = F.size(rows)
    pairs = F.arrays_zip(F.slice(rows, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(rows, 2, F.greatest(n, F.lit(1))).alias("b"))
    return F.size(F.filter(pairs, lambda x: F.coalesce(x.b.balance == x.a.balance + x.b.net, F.lit(False))))


CHECK = T.StructType([
    T.StructField("row_index", T.IntegerType()), T.StructField("page_no", T.IntegerType()), T.StructField("page_row_index", T.IntegerType()), T.StructField("expected", T.DecimalType(20, 4)),
    T.StructField("actual", T.DecimalType(20, 4)), T.StructField("consistent", T.BooleanType()), T.StructField("inferred", T.StringType()), T.StructField("gap", T.BooleanType()),
])
CHECKED = T.StructType([T.StructField("checks", T.ArrayType(CHECK)), *(T.StructField(c, T.DecimalType(20, 4)) for c in ("debit", "credit", "running"))])


def check_rows(page_no: list, net: list, amount: list, balance: list, opening: int | None, derived: bool, declared: dict) -> tuple[list, list, list, list, int, int, int | None]:
    """The fold over one file's rows in order, in one pass: what is expected of each balance, from the printed one before it
    or else the expected one, verdicts, sides and gaps of the rows, the sums of both sides and the last balance. Columns and
    balances are whole ten-thousandths.

    A row without side takes the one that its balance tells; where neither does, it is inconsistent. The opening balance
    that a page declares replaces one that differs. A row whose side was inferred isn't judged, nor is the first row if
    the opening balance was derived from it."""
    running, page, seen, debit, credit = opening, None, False, 0, 0
    expect, verdicts, sides, gaps = [], [], [], []
    for on, moved, unsigned, actual in zip(page_no, net, amount, balance, strict=True):
        starts = seen and on != page
        said = declared.get(on) if starts else None
        gap = said is not None and running is not None and said != running
        running = said if gap else running
        side = verdict = None
        judged = True
        if moved is None and unsigned is not None and running is not None and actual is not None:
            delta, judged = actual - running, False
            if delta and abs(delta) == unsigned:
                moved, side = delta, "credit" if delta > 0 else "debit"
            else:
                verdict = False
        expected = None if running is None or moved is None else running + moved
        if judged and expected is not None and actual is not None and (seen or not derived):
            verdict = actual == expected
        expect.append(expected)
        verdicts.append(verdict)
        sides.append(side)
        gaps.append(gap or (verdict is False and starts))
        if moved:
            debit, credit = (debit - moved, credit) if moved < 0 else (debit, credit + moved)
        running, page, seen = expected if actual is None else actual, on, True
    return expect, verdicts, sides, gaps, debit, credit, running


def _ends(a: pa.Array) -> list[int]:
    return [0, *np.cumsum(pc.list_value_length(a).fill_null(0).to_numpy(zero_copy_only=False)).tolist()]


def _whole_numbers(a: pa.Array) -> list[int | None]:
    return a.to_pylist() if a.null_count else a.to_numpy(zero_copy_only=False).tolist()  # to_pylist() takes many times as long


@F.arrow_udf(CHECKED)
def _check_rows(rows: pa.Array, opening: pa.Array, derived: pa.Array, pages: pa.Array) -> pa.Array:
    kind = to_arrow_type(CHECKED)
    ends, flat = _ends(rows), rows.flatten()
    of = dict(zip([f.name for f in flat.type], flat.flatten(), strict=True))
    page_no, net, amount, balance = _whole_numbers(of["page_no"]), *(decimals.whole(of[c]) for c in ("net", "amount", "balance"))
    page_ends, page = _ends(pages), pages.flatten()
    heads = dict(zip([f.name for f in page.type], page.flatten(), strict=True))
    declared = list(zip(_whole_numbers(heads["page_no"]), decimals.whole(heads["opening_balance"]), strict=True))
    columns, sums = ([], [], [], []), ([], [], [])
    for i, j, start, first, p, q in zip(ends, ends[1:], decimals.whole(opening), derived.to_pylist(), page_ends, page_ends[1:], strict=False):
        got = check_rows(page_no[i:j], net[i:j], amount[i:j], balance[i:j], start, first, dict(declared[p:q]))
        for out, more in zip(columns, got[:4], strict=True):
            out += more
        for out, value in zip(sums, got[4:], strict=True):
            out.append(value)
    expect, verdicts, sides, gaps = columns
    number = np.arange(1, ends[-1] + 1) - np.repeat(np.array(ends[:-1], np.int64), np.diff(ends))
    checks = kind.field("checks").type
    made = {
        "row_index": pa.array(number, pa.int32()), "page_no": of["page_no"].cast(pa.int32()), "page_row_index": of["pos"].cast(pa.int32()), "expected": decimals.of_whole(expect), "actual": of["balance"],
        "consistent": pa.array(verdicts, pa.bool_()), "inferred": pa.array(sides, pa.string()), "gap": pa.array(gaps, pa.bool_()),
    }
    rows = pa.StructArray.from_arrays([made[f.name] for f in checks.value_type], fields=list(checks.value_type))
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=checks), *map(decimals.of_whole, sums)], fields=list(kind))


def check_files(rows: DataFrame, pages: DataFrame, key: list[str]) -> DataFrame:
    """One row per file: its checks by row, mismatching rows, totals and flags.

    rows: key, page_no, pos, date, debit, credit, amount, balance. pages: key, page_no, opening_balance,
    closing_balance, total_debit, total_credit; of a page given twice the last opening balance counts. The chain is read
    newest first where dates, or else the equations, say so. The fold of check_rows() is Python, as Spark's own copies
    what it has gathered at every row. A file's rows are held as one array."""
    row = file_row(F.col("page_no"), F.col("pos"), F.struct("date", "debit", "credit", "amount", "balance"))
    files = rows.groupBy(*key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    heads = pages.groupBy(*key).agg(F.sort_array(F.collect_list(file_page(F.col("page_no"), F.struct(*BALANCES)))).alias("pages"))
    f = heads.join(files, key, "left").withColumn("rows", F.coalesce("rows", F.array().cast(files.schema["rows"].dataType)))
    return checked(f)


BALANCES = ("opening_balance", "closing_balance", "total_debit", "total_credit")


def file_row(page_no: Column, pos: Column, r: Column) -> Column:
    """A row (date, debit, credit, amount, balance) as checked() takes it."""
    return F.struct(page_no.cast("int").alias("page_no"), pos.cast("int").alias("pos"), r.date.alias("date"), net(r.debit, r.credit).cast(MONEY).alias("net"), r.amount.cast(MONEY).alias("amount"), r.balance.cast(MONEY).alias("balance"))


def file_page(page_no: Column, page: Column) -> Column:
    """A page's balances as checked() takes them."""
    return F.struct(page_no.cast("int").alias("page_no"), *(page[c].cast(MONEY).alias(c) for c in BALANCES))


def checked(f: DataFrame) -> DataFrame:
    """check_files() of files whose rows and pages are gathered: rows (sorted array of file_row()) and pages (sorted array of
    file_page()). Other columns stay."""
    dates = F.filter(F.transform("rows", lambda r: r.date), lambda d: d.isNotNull() & (d != ""))
    first, last = F.try_element_at(dates, F.lit(1)), F.try_element_at(dates, F.lit(-1))
    f = f.withColumn("newest_first", F.when((F.size(dates) >= 2) & (first != last), last < first).otherwise(_chain(F.reverse("rows")) > _chain(F.col("rows"))))
    f = f.withColumn("rows", F.when(F.col("newest_first"), F.reverse("rows")).otherwise(F.col("rows")))
    pick = lambda c, k: F.try_element_at(F.filter(F.transform("pages", lambda p: p[c]), lambda v: v.isNotNull()), F.lit(k))
    head = F.try_element_at("rows", F.lit(1))
    printed = pick("opening_balance", 1)
    f = f.withColumns({"opening_balance": F.coalesce(printed, (head.balance - head.net).cast(MONEY), head.balance), "derived": printed.isNull(), "total_debit": pick("total_debit", 1), "total_credit": pick("total_credit", 1), "closing_balance": pick("closing_balance", -1)})
    f = f.withColumn("end", _check_rows("rows", "opening_balance", "derived", F.transform("pages", lambda p: F.struct(p.page_no.alias("page_no"), p.opening_balance.alias("opening_balance")))))
    checks = F.col("end.checks")
    bad = F.transform(F.filter(checks, lambda c: c.consistent == F.lit(False)), lambda c: c.row_index)
    judged = F.filter(checks, lambda c: c.consistent.isNotNull())
    f = f.withColumns({
        "n_rows": F.size("rows"), "sum_debit": F.col("end.debit"), "sum_credit": F.col("end.credit"), "checks": checks, "balance_mismatch_rows": bad, "first_break_row": F.array_min(bad),
        "page_gap_pages": F.array_distinct(F.transform(F.filter(checks, lambda c: c.gap), lambda c: c.page_no)),
        "row_consistency_rate": F.when(F.size(judged) > 0, F.size(F.filter(judged, lambda c: c.consistent)) / F.size(judged)),
        "total_mismatch": F.coalesce(F.col("total_debit") != F.col("end.debit"), F.lit(False)) | F.coalesce(F.col("total_credit") != F.col("end.credit"), F.lit(False)),
        "closing_mismatch": F.coalesce(F.col("closing_balance") != F.col("end.running"), F.lit(False)),
    })
    flags = F.array_compact(F.array(F.when(F.size("balance_mismatch_rows") > 0, "balance_mismatch"), F.when(F.col("total_mismatch") | F.col("closing_mismatch"), "total_mismatch"), F.when(F.size("page_gap_pages") > 0, "page_gap")))
    f = f.withColumn("flags", flags).withColumn("file_reconciles", F.size("flags") == 0)
    return f.drop("rows", "pages", "derived", "end", "total_debit", "total_credit", "closing_balance")


def chain_consistency(rows: DataFrame, key: list[str], order: list[str], balance: str, change: str) -> DataFrame:
    """(key, checked, consistent): rows whose printed balance is the one before plus their change. Window functions
    only, for ledgers that print every balance and may be of any length."""
    before = F.lag(balance).over(Window.partitionBy(*key).orderBy(*order))
    ok = rows.withColumn("ok", F.col(balance) == before + F.col(change))
    return ok.groupBy(*key).agg(F.count("ok").alias("checked"), F.count_if("ok").alias("consistent"))


def agreement(a: DataFrame, b: DataFrame, page: list[str], key: list[str], order: str, balance: str) -> DataFrame:
    """Rows of two models' pages, aligned by key and place within it: present, balance_agrees (null: not comparable)."""
    place = F.row_number().over(Window.partitionBy(*page, *key).orderBy(order))
    x = a.withColumn("_k", place).select(*page, *key, "_k", F.col(balance).alias("left"), F.lit(True).alias("_a"))
    y = b.withColumn("_k", place).select(*page, *key, "_k", F.col(balance).alias("right"), F.lit(True).alias("_b"))
    both = x.join(y, [*page, *key, "_k"], "full")
    present = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return both.select(*page, *key, F.col("_k").alias("place"), present.alias("present"), F.when(present, F.col("left") == F.col("right")).alias("balance_agrees"))


def agreement_rate(present: Column, agrees: Column) -> Column:
    """Share of comparable keys that agree (an aggregate): absence on one side disagrees."""
    return F.avg(F.when(~present, 0.0).otherwise(agrees.cast("double")))
