"""Ledger files of any length: the rules of ledger.check_rows() as prefix scans over parts of files.

What a row does to the running balance depends on the row alone: a printed balance sets it, a sum without one adds to it, a
page's declared opening balance resets it. So each part of a file boils down to one such map, the maps of a file's parts are
composed in order, and every row gets the balance in front of it without its file ever lying in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import keep
from . import ordered
from .ledger import MONEY, net
from .ordered import ADD, KEY, PART, RESET, SET

ORDER = ["page_no", "pos", "date", "net", "amount", "balance"]


def _heads(pages: DataFrame, key: list[str]) -> DataFrame:
    """One row per file: the first opening balance and totals that a page prints, the last closing balance."""
    page = F.struct("page_no", *(F.col(c).cast(MONEY).alias(c) for c in ("opening_balance", "closing_balance", "total_debit", "total_credit")))
    pick = lambda c, f: f(F.when(F.col(c).isNotNull(), page))[c].alias(c)
    return pages.withColumn(KEY, F.struct(*key)).groupBy(KEY).agg(pick("opening_balance", F.min), pick("total_debit", F.min), pick("total_credit", F.min), pick("closing_balance", F.max))


def _facts(t: DataFrame) -> DataFrame:
    """(_key, _part, newest_first, n, before, head): of each file and part, in which order the file is read, how many rows it
    has and lie in earlier parts, and the row that it begins with. t has before and after."""
    dated = F.when(F.col("date").isNotNull() & (F.col("date") != ""), F.struct(*ORDER))
    holds = lambda other: F.count_if(F.coalesce(F.col("balance") == F.col(f"{other}.balance") + F.col("net"), F.lit(False)))
    row = F.struct(*ORDER)
    part = t.groupBy(KEY, PART).agg(F.count("*").alias("n"), F.min(dated).alias("first"), F.max(dated).alias("last"), F.count(dated).alias("dates"), holds("before").alias("down"), holds("after").alias("up"), F.min(row).alias("lo"), F.max(row).alias("hi"))
    file = part.groupBy(KEY).agg(F.sum("n").alias("total"), F.min("first")["date"].alias("first"), F.max("last")["date"].alias("last"), F.sum("dates").alias("dates"), F.sum("down").alias("down"), F.sum("up").alias("up"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    newest = F.when((F.col("dates") >= 2) & (F.col("first") != F.col("last")), F.col("last") < F.col("first")).otherwise(F.col("up") > F.col("down"))
    file = file.select(KEY, "total", newest.alias("newest_first"), F.when(newest, F.col("hi")).otherwise(F.col("lo")).alias("head"))
    before = part.select(KEY, PART, F.coalesce(F.sum("n").over(ordered.earlier()), F.lit(0)).alias("earlier"))
    return before.join(file, KEY)


def scan_files(rows: DataFrame, pages: DataFrame, key: list[str], parts: int | None = None, only_files: bool = False) -> tuple[DataFrame, DataFrame]:
    """(checks, files) of ledger.check_files(), without an array of a file's rows.

    checks has a row for each one of rows: key, row_index in reading order, page_no, page_row_index, expected, actual,
    consistent, inferred, gap. files has a row for each file that pages name: newest_first, opening_balance, n_rows, sums,
    n_judged, n_mismatches, first_break_row, n_gaps, row_consistency_rate, total_mismatch, closing_mismatch, flags,
    file_reconciles. Null keys are keys. Rows of files without pages are left out, as there. With only_files, checks aren't
    written: files are summed as rows are checked, and checks would be worked out anew."""
    r = rows.select(*key, F.col("page_no").cast("int").alias("page_no"), F.col("pos").cast("int").alias("pos"), "date", net(F.col("debit"), F.col("credit")).cast(MONEY).alias("net"), F.col("amount").cast(MONEY).alias("amount"), F.col("balance").cast(MONEY).alias("balance"))
    heads = _heads(pages, key)
    dealt = ordered.ranged(r, key, ORDER, parts)
    t = keep(ordered.with_neighbours(dealt, ORDER, ["page_no", "balance"], place_in_part="_at").drop("group_size"), "ledger")
    facts = _facts(t).join(heads.select(KEY, F.col("opening_balance").alias("printed")), KEY)
    head = F.col("head")
    facts = facts.select(KEY, PART, "newest_first", "total", "earlier", F.col("printed").isNull().alias("derived"), F.coalesce("printed", (head.balance - head.net).cast(MONEY), head.balance).alias("opening"))
    facts = keep(facts, "facts")  # of known size: few are broadcast
    x = t.join(facts, [KEY, PART]).withColumn("n", F.col("_at") + F.col("earlier"))
    newest = F.col("newest_first")
    x = x.withColumns({"seq": F.when(newest, -F.col("n")).otherwise(F.col("n")), "part_seq": F.when(newest, -F.col(PART)).otherwise(F.col(PART)), "row_index": F.when(newest, F.col("total") - F.col("n") + 1).otherwise(F.col("n"))})
    previous = F.when(newest, F.col("after")).otherwise(F.col("before"))
    x = x.withColumn("starts", previous.isNotNull() & ~previous["page_no"].eqNullSafe(F.col("page_no")))
    # Only a page's first row asks for what the page declares; the others are dealt by their places and meet nothing.
    declared = pages.withColumn(KEY, F.struct(*key)).groupBy(KEY, F.struct(F.col("page_no").cast("int").alias("page_no")).alias("_page")).agg(F.max(F.col("opening_balance").cast(MONEY)).alias("said")).withColumns({"starts": F.lit(True), "_at": F.lit(0).cast("long")})
    x = x.withColumns({"_page": F.struct("page_no"), "_at": F.when(F.col("starts"), F.lit(0).cast("long")).otherwise(F.col("n"))}).join(declared, [KEY, "_page", "starts", "_at"], "left")
    said, change, actual = F.col("said"), F.col("net"), F.col("balance")
    kind = F.when(actual.isNotNull() | change.isNull(), SET).when(said.isNotNull(), RESET).otherwise(ADD)
    value = F.when(actual.isNotNull(), actual).when(change.isNull(), F.lit(None)).when(said.isNotNull(), said + change).otherwise(change)
    x = x.withColumn("_m", ordered.mapped(kind, value))
    x = x.select(KEY, PART, "seq", "part_seq", "opening", "_m", "newest_first", "derived", "row_index", "page_no", "pos", "starts", "said", "net", "amount", "balance")
    x = ordered.running_before(x, "_m", "seq", "part_seq", "opening")
    running = F.col("running")
    x = x.withColumns({"_gap": F.coalesce(said != running, F.lit(False)), "running": F.when(said.isNotNull() & running.isNotNull(), said).otherwise(running)})
    asked = change.isNull() & F.col("amount").isNotNull() & running.isNotNull() & actual.isNotNull()
    delta = actual - running
    told = asked & (delta != 0) & (F.abs(delta) == F.col("amount"))
    x = x.withColumns({"_asked": asked, "inferred": F.when(told, F.when(delta > 0, "credit").otherwise("debit")), "net": F.when(told, delta).otherwise(change).cast(MONEY)})
    x = x.withColumn("expected", (running + F.col("net")).cast(MONEY))
    open_ = F.col("_asked") | ((F.col("row_index") == 1) & F.col("derived"))
    x = x.withColumn("consistent", F.when(F.col("_asked") & F.col("inferred").isNull(), F.lit(False)).when(~open_, actual == F.col("expected")))
    x = x.withColumn("gap", F.col("_gap") | (F.coalesce(~F.col("consistent"), F.lit(False)) & F.col("starts")))
    checks = x.select(KEY, "newest_first", "opening", F.col("row_index").cast("int").alias("row_index"), "page_no", F.col("pos").alias("page_row_index"), "expected", actual.alias("actual"), "consistent", "inferred", "gap", "net")
    checks = checks if only_files else keep(checks, "checks")
    zero = F.lit(0).cast(MONEY)
    wrong = F.col("consistent") == F.lit(False)
    file = checks.groupBy(KEY).agg(
        F.first("newest_first").alias("newest_first"), F.first("opening").alias("opening"), F.count("*").cast("int").alias("n_rows"),
        F.sum(F.greatest(-F.coalesce("net", zero), zero)).alias("sum_debit"), F.sum(F.greatest(F.coalesce("net", zero), zero)).alias("sum_credit"),
        F.count("consistent").alias("n_judged"), F.count_if(wrong).alias("n_mismatches"), F.min(F.when(wrong, F.col("row_index"))).alias("first_break_row"), F.count_if("gap").alias("n_gaps"),
        F.max(F.struct("row_index", F.coalesce("actual", "expected").alias("running")))["running"].alias("end"),
    )
    f = heads.join(file, KEY, "left")
    empty = F.col("n_rows").isNull()
    none = F.lit(0).cast("long")
    f = f.withColumns({"opening_balance": F.when(empty, F.col("opening_balance")).otherwise(F.col("opening")), "end": F.when(empty, F.col("opening_balance")).otherwise(F.col("end"))})
    f = f.withColumns({"newest_first": F.coalesce("newest_first", F.lit(False)), "n_rows": F.coalesce("n_rows", F.lit(0)), **{c: F.coalesce(c, none) for c in ("n_judged", "n_mismatches", "n_gaps")}, **{c: F.coalesce(c, zero) for c in ("sum_debit", "sum_credit")}})
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    f = f.withColumns({
        "row_consistency_rate": F.when(F.col("n_judged") > 0, (F.col("n_judged") - F.col("n_mismatches")) / F.col("n_judged")),
        "total_mismatch": differs("total_debit", "sum_debit") | differs("total_credit", "sum_credit"), "closing_mismatch": differs("closing_balance", "end"),
    })
    f = f.withColumn("flags", F.array_compact(F.array(F.when(F.col("n_mismatches") > 0, "balance_mismatch"), F.when(F.col("total_mismatch") | F.col("closing_mismatch"), "total_mismatch"), F.when(F.col("n_gaps") > 0, "page_gap"))))
    f = f.withColumn("file_reconciles", F.size("flags") == 0).drop("total_debit", "total_credit", "closing_balance", "end", "opening")
    named = lambda df: df.select(F.col(f"{KEY}.*"), *(c for c in df.columns if c != KEY))
    return named(checks.drop("newest_first", "opening", "net")), named(f)


def fault_lists(checks: DataFrame, key: list[str]) -> DataFrame:
    """(key, balance_mismatch_rows, page_gap_pages): the faults of each file that has any, in reading order. Only faults are
    gathered; a gap page counts once, where it is met first."""
    bad = checks.where("consistent = false").groupBy(*key).agg(F.sort_array(F.collect_list("row_index")).alias("balance_mismatch_rows"))
    first = checks.where("gap").groupBy(*key, "page_no").agg(F.min("row_index").alias("at"))
    gaps = first.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "page_no"))), lambda p: p.page_no).alias("page_gap_pages"))
    empty = F.array().cast("array<int>")
    both = bad.withColumn("_k", F.struct(*key)).drop(*key).join(gaps.withColumn("_k", F.struct(*key)).drop(*key), "_k", "full")
    return both.select("_k.*", F.coalesce("balance_mismatch_rows", empty).alias("balance_mismatch_rows"), F.coalesce("page_gap_pages", empty).alias("page_gap_pages"))
