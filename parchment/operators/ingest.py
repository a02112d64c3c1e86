"""From raw benchmark rows and labels to manifests and truth: typed samples, critical fields, conditions, coverage,
parity sets, and review labels read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import fields as typed
from ..functions import official, pages, statement
from ..functions.text import canonical_text, each, nfc
from .run import FIELD_TASKS, TEXT_TASKS

# What makes a field critical, by key or else by value, and words that every readable statement holds.
CRITICAL_KEY = (
    r"(?iu)ราคา|ยอดรวม|ยอดชำระ|ยอดเงิน|ยอดคงเหลือ|รวมเงิน|รวมทั้งสิ้น|จำนวนเงิน|บาท|วันที่|เลขที่|หมายเลข|รหัส|บัญชี|ชื่อ|"
    r"price|total|amount|date|number|\bno\b|\bid\b|name|account"
)
NUMERIC_DATE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
ID_NUMBER = r"\d[\d\- ]{5,}\d"
STATEMENT_WORDS = r"(?iu)ยอด|บัญชี|วันที่|รายการ|คงเหลือ|ถอน|ฝาก|balance|account|date|statement|deposit|withdraw|page"
STATEMENT_CRITICAL = ("account_no", "opening_balance", "closing_balance", "period_start", "period_end")
CONDITIONS = ("clean", "scan_low", "photo")
#: Samples of each task that a parity set has at least.
PARITY_MINIMUMS = {"ocr_fullpage": 20, "ocr_line": 10, "table": 10, "handwriting": 10, "kie": 10}


def is_critical(key: Column, value: Column) -> Column:
    """True for a field whose key names an amount, date, number or name, or whose value is an amount, a date or an id."""
    months = F.lit(False)
    for m in typed.THAI_MONTHS:
        months = months | F.contains(value, F.lit(m))
    by_value = value.rlike(typed.AMOUNT_SHAPE) | value.rlike(NUMERIC_DATE) | months | value.rlike(ID_NUMBER)
    return F.coalesce(key.rlike(CRITICAL_KEY) | by_value, key.rlike(CRITICAL_KEY), F.lit(False))


def critical_fields(fields: Column) -> Column:
    """The keys of a map of fields that are critical, in its order."""
    return F.transform(F.filter(F.map_entries(fields), lambda e: is_critical(e.key, e.value)), lambda e: e.key)


@F.arrow_udf(StringType())
def _table_html(texts: pa.Array) -> pa.Array:
    return each(pages.answer_table_html, pa.string(), texts)


def to_samples(rows: DataFrame, code: Column, task: Column, subtask: Column, domain: Column | None = None, source: str = "thaiocrbench") -> DataFrame:
    """Typed samples of raw rows (Id, question, answer): sample_id, task, the truth's columns (gt_kind, text, html, raw,
    label, fields), critical_fields. An answer of a field task that is no JSON fails, naming its sample."""
    sample = F.concat(F.lit("TOB-"), code, F.lit("-"), F.col("Id").cast("string"))
    a = F.col("answer")
    kie = task.isin(*FIELD_TASKS)
    parsed = official.answer_fields_udf(F.when(kie, a))
    r = rows.withColumns({"_id": sample, "_task": task, "_sub": subtask, "_dom": F.lit(None).cast("string") if domain is None else domain, "_f": parsed, "_html": _table_html(F.when(task == "table", a))})
    t = F.col("_task")
    text = t.isin(*TEXT_TASKS, "docparse")
    kie = t.isin(*FIELD_TASKS)
    fields = F.when(kie & F.col("_f").isNull(), F.raise_error(F.concat(F.col("_id"), F.lit(": could not parse answer as JSON"))).cast("map<string,string>")).when(kie, F.col("_f"))
    kind = F.when(text, "text").when(t == "table", "html").when(kie | (t == "classify"), "json")
    kind = F.coalesce(kind, F.raise_error(F.concat(F.col("_id"), F.lit(": unsupported task "), F.coalesce(t, F.lit("null")))))
    out = r.select(
        F.col("_id").alias("sample_id"), F.lit(source).alias("source"), t.alias("task"), F.col("_sub").alias("subtask"), F.col("_dom").alias("domain"), F.lit(None).cast("string").alias("bank"),
        F.lit(None).cast("string").alias("doc_type"), F.lit(1).alias("page_no"), F.lit(1).alias("n_pages"), "question", kind.alias("gt_kind"), F.when(text, a).alias("text"), F.col("_html").alias("html"),
        F.when(~text, a).alias("raw"), F.when(t == "classify", F.trim(a)).alias("label"), fields.alias("fields"),
    )
    return out.withColumn("critical_fields", F.coalesce(critical_fields(F.col("fields")), F.array().cast("array<string>")))


def stratum(domain: Column) -> Column:
    """The stratum of a domain; null and blank ones are one."""
    return F.coalesce(F.trim(domain), F.lit(""))


def expand_conditions(samples: DataFrame, conditions: tuple[str, ...] = CONDITIONS) -> DataFrame:
    """One manifest row per sample and condition, with paths of its image and truth (a photo's text layer has its own)."""
    chosen = [c for c in CONDITIONS if c in conditions]
    m = samples.withColumn("condition", F.explode(F.array(*map(F.lit, chosen))))
    suffix = F.when(F.col("condition") == "clean", "").otherwise(F.concat(F.lit("_"), "condition"))
    image = F.concat(F.lit("img/"), "sample_id", suffix, F.when(F.col("condition") == "scan_low", ".jpg").otherwise(".png"))
    own = F.when((F.col("gt_kind") == "text_layer") & (F.col("condition") == "photo"), "_photo").otherwise("")
    gt = F.when(F.coalesce(F.col("gt_kind"), F.lit("none")) != "none", F.concat(F.lit("gt/"), "sample_id", own, F.lit(".json")))
    return m.withColumns({"image_path": image, "gt_path": gt})


def ordered_manifest(manifest: DataFrame) -> DataFrame:
    """Rows by source, sample and condition, from clean to photo."""
    return manifest.orderBy("source", "sample_id", F.array_position(F.array(*map(F.lit, CONDITIONS)), F.col("condition")))


def text_layer_usable(text: Column) -> Column:
    """True for a readable text layer, not glyph codes: it holds a word that every statement does."""
    return F.coalesce(nfc(text).rlike(STATEMENT_WORDS), F.lit(False))


def selection_counts(samples: DataFrame) -> DataFrame:
    """(what, name, n): samples by task and by domain, pages by doc_type, the number of banks and of files with more than
    one page, and text layers that can't be used."""
    files = samples.withColumn("file_id", F.regexp_replace("sample_id", r"-p\d+$", ""))
    statement_ = F.col("task") == "statement"
    per = lambda what, c, on: F.when(on, F.struct(F.lit(what).alias("what"), F.coalesce(F.col(c), F.lit("")).alias("name")))
    unusable = F.when((F.col("gt_kind") == "text_layer") & ~text_layer_usable(F.col("text")), F.struct(F.lit("text_layer_unusable").alias("what"), F.lit("").alias("name")))
    entries = F.array_compact(F.array(per("task", "task", F.lit(True)), per("domain", "domain", ~statement_), per("doc_type", "doc_type", statement_), unusable))
    counts = files.select(F.explode(entries).alias("e")).groupBy("e.what", "e.name").agg(F.count("*").alias("n"))
    banks = files.where(statement_).agg(F.count_distinct("bank").alias("n")).select(F.lit("banks").alias("what"), F.lit("").alias("name"), "n")
    many = files.where(statement_).groupBy("file_id").agg(F.count_distinct("sample_id").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("multipage_files").alias("what"), F.lit("").alias("name"), "n")
    return counts.unionByName(banks).unionByName(many)


def coverage_warnings(digital: Column, scanned: Column, banks: Column, multipage: Column, least: tuple[int, int, int, int]) -> Column:
    """array of what a corpus lacks: usable digital pages, scanned or photographed pages, banks, files of several pages."""
    said = (" digital pages with a usable text layer", " scanned/photo pages", " banks", " multi-page statements")
    end = ("; Check A is weakened", "", "", "")
    lines = [F.when(c < n, F.concat(F.lit("only "), c.cast("string"), F.lit(f"{text} (< {n}){tail}"))) for c, n, text, tail in zip((digital, scanned, banks, multipage), least, said, end, strict=True)]
    return F.array_compact(F.array(*lines))


def unpromoted(rows: DataFrame, promoted: list[str], endpoint: str = "endpoint", source: str = "bankstmt") -> DataFrame:
    """Rows of clients' data that would go to an endpoint that isn't promoted for them."""
    return rows.where((F.col("source") == source) & F.col(endpoint).isNotNull() & ~F.col(endpoint).isin(*promoted))


def parity_problems(listed: DataFrame, manifest: DataFrame, minimums: dict[str, int] | None = None) -> DataFrame:
    """(sample_id, task, problem) of a parity list (task, sample_id): listed twice, not in the manifest, a client's page, no
    clean row, another task, or a task with too few. Empty if the list can be used."""
    have = manifest.groupBy("sample_id").agg(F.bool_or(F.col("source") == "bankstmt").alias("client"), F.bool_or(F.col("condition") == "clean").alias("clean"), F.collect_set("task").alias("tasks"))
    times = F.count("*").over(Window.partitionBy("task", "sample_id"))
    j = listed.withColumn("times", times).join(have, "sample_id", "left")
    problem = (
        F.when(F.col("times") > 1, "listed twice").when(F.col("client").isNull(), "not in the manifest").when(F.col("client"), "a client's page").when(~F.col("clean"), "no clean row")
        .when(~F.col("tasks").eqNullSafe(F.array("task")), "another task in the manifest")
    )
    bad = j.select("sample_id", "task", problem.alias("problem")).where("problem is not null").distinct()
    least = F.explode(F.array(*(F.struct(F.lit(t).alias("task"), F.lit(n).alias("least")) for t, n in (minimums or PARITY_MINIMUMS).items())))
    counts = listed.groupBy("task").agg(F.count("*").alias("n"))
    need = listed.sparkSession.range(1).select(least.alias("m")).select("m.*").join(counts, "task", "left").where(F.coalesce("n", F.lit(0)) < F.col("least"))
    few = need.select(F.lit(None).cast("string").alias("sample_id"), "task", F.concat(F.lit("has "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" samples, needs "), F.col("least").cast("string")).alias("problem"))
    return bad.unionByName(few)


def parity_rows(manifest: DataFrame, listed: DataFrame) -> DataFrame:
    """The clean manifest rows of a parity list."""
    return manifest.where("condition = 'clean'").join(listed.select("sample_id").distinct(), "sample_id", "left_semi")


# --- review labels ----------------------------------------------------------------------------------------------------

DATES = ("date", "period_start", "period_end")
AMOUNTS = ("debit", "credit", "amount", "balance", "opening_balance", "closing_balance")


def checked_labels(queue: DataFrame) -> DataFrame:
    """Rows of a filled queue (line, sample_id, page_no, field, row_index, label, all text) that have a label, typed: value,
    row, page, and error, what is wrong with the line, or null."""
    q = queue.select("line", *(F.trim(F.coalesce(c, F.lit(""))).alias(c) for c in ("sample_id", "page_no", "field", "row_index", "label"))).where("label <> ''")
    f, label = F.col("field"), F.col("label")
    head, cell = f.isin(*statement.SCORED), f.isin(*statement.CELLS)
    value = F.when(f.isin(*DATES), typed.parse_cell_date(label)).when(f.isin(*AMOUNTS), typed.parse_decimal(label).cast("string")).otherwise(canonical_text(label))
    q = q.withColumns({"value": value, "row": F.col("row_index").try_cast("int"), "page": F.col("page_no").try_cast("int")})
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    whole = lambda c: c.rlike(r"^\d+$")
    error = (
        F.when(F.col("sample_id") == "", "sample_id is empty").when((F.col("page_no") != "") & ~(whole(F.col("page_no")) & (F.coalesce("page", F.lit(0)) >= 1)), F.concat(F.lit("page_no "), quoted(F.col("page_no")), F.lit(" is not a page number")))
        .when(~head & ~cell, F.concat(F.lit("unknown field "), quoted(f))).when(head & (F.col("row_index") != ""), F.concat(F.lit("header field "), quoted(f), F.lit(" must have an empty row_index")))
        .when(cell & ~whole(F.col("row_index")), F.concat(F.lit("field "), quoted(f), F.lit(" needs a non-negative row_index, got "), quoted(F.col("row_index"))))
        .when(F.col("value").isNull(), F.concat(F.lit("field "), quoted(f), F.lit(": "), quoted(label), F.when(f.isin(*DATES), " is not a date").otherwise(" is not an amount")))
    )
    return q.withColumn("error", error)


def load_labels(queue: DataFrame, name: str = "labels") -> DataFrame:
    """(sample_id, page_no, page): statement pages of a filled queue. The first bad line fails all, named by its number. Rows
    that nobody labelled are there and empty, so that places don't shift; of a cell labelled twice the last line counts."""
    labels = checked_labels(queue)
    bad = labels.where("error is not null").orderBy("line").first()
    if bad:
        raise ValueError(f"{name}: line {bad.line}: {bad.error}")
    last = lambda on, c: F.max(F.when(on, F.struct("line", F.col(c).alias("v"))))["v"]
    heads = [last((F.col("field") == f) & F.col("row").isNull(), "value").alias(f) for f in statement.SCORED]
    head = labels.groupBy("sample_id").agg(*heads, F.coalesce(last(F.col("page").isNotNull(), "page"), F.lit(1)).alias("page_no"))
    cells = labels.where(F.col("row").isNotNull()).groupBy("sample_id", "row").agg(*(last(F.col("field") == c, "value").alias(c) for c in statement.CELLS))
    kind = statement.ROW.simpleString()
    row = F.struct(F.col("date"), F.lit(None).cast("string").alias("description"), *(F.col(c).cast("decimal(20,4)").alias(c) for c in ("debit", "credit", "amount", "balance")), F.lit(None).cast("string").alias("channel"))
    held = cells.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("row", row.alias("r")))).alias("rows"), F.max("row").alias("last"))  # rows of one page
    blank = F.struct(*(F.lit(None).cast(x.dataType).alias(x.name) for x in statement.ROW)).cast(kind)
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.col("rows")[i], blank))
    both = head.join(held, "sample_id", "left").withColumn("dense", F.when(F.col("last").isNotNull(), dense).otherwise(F.array().cast(f"array<{kind}>")))
    number = lambda c: F.col(c).cast("decimal(20,4)").alias(c)
    none = lambda c: F.lit(None).cast("decimal(20,4)").alias(c)
    page = F.struct(*(F.col(c) for c in ("account_no", "account_name", "period_start", "period_end")), number("opening_balance"), number("closing_balance"), none("total_debit"), none("total_credit"), F.col("dense").alias("rows"), (F.size("dense") > 0).alias("has_header"))
    return both.select("sample_id", "page_no", page.cast(statement.PAGE).alias("page"))
