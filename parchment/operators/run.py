"""Scoring of a whole run: every manifest row and model by its task and kind of truth, and statement files by their
arithmetic, agreement and labels.

Tables are DataFrames of these columns; further ones are ignored.

manifest: sample_id, condition, source, task, subtask, domain, bank, doc_type, page_no, critical_fields (array).
predictions, the last of each key: sample_id, condition, model, prompt_version, error, raw_text, text, tables (rows of
cells), blocks (type, text), fields (map of raw values), label.
truth: sample_id, gt_kind (text, html, json, text_layer, none), text, html, raw, label, fields (map), words, homography,
statement (statement.PAGE). A text layer's text is in `text`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields as typed
from ..functions import official, statement, tables
from ..functions.text import anls, canonical_text, cer, let, null_if_blank, plain_text, tokens, wer
from ..sources.scratch import keep
from . import ledger, scoring
from .joins import is_full_miss, is_partial, prf, spread, with_predictions

# Tasks by how they are scored, metrics of each way, and those whose worst value is 1.
TEXT_TASKS, FIELD_TASKS = ("ocr_fullpage", "handwriting", "ocr_line"), ("kie", "kie_map")
METRICS = {"text": ("cer", "wer", "bmfl"), "table": ("ted", "cer"), "docparse": ("ted", "cer"), "kie": ("kie_precision", "kie_recall", "kie_f1"), "classify": ("anls",), "statement": ("row_precision", "row_recall", "row_f1")}
ERRORS = ("cer", "wer")
BENCHMARK = "thaiocrbench"

KEYS = ["sample_id", "condition", "model"]
SLICES = ["task", "subtask", "domain", "bank", "doc_type"]


def answer_text(prompt_version: Column, raw: Column, text: Column) -> Column:
    """What a model answered: a question's reply as it stands, else the page text."""
    return F.when(F.startswith(prompt_version, F.lit("question-")), raw).otherwise(text)


def truth_answer(kind: Column) -> Column:
    """The benchmark's answer of a truth row, as text."""
    json_ = F.coalesce("raw", "label", F.to_json(F.coalesce("gt_fields", F.create_map().cast("map<string,string>")), {"ignoreNullFields": "false"}))
    return F.when(kind.isin("text", "text_layer"), F.col("gt_text")).when(kind == "html", F.coalesce("raw", "html")).when(kind == "json", json_).otherwise("")


def way_of(task: Column, kind: Column, stated: Column) -> Column:
    """How a row is scored, by its task and kind of truth; stated: the truth holds a statement page."""
    return (
        F.when(kind.isNull() | (kind == "none"), "no_gt").when(task.isin(*TEXT_TASKS) & (kind == "text"), "text").when((task == "table") & (kind == "html"), "table")
        .when((task == "docparse") & (kind == "text"), "docparse").when(task.isin(*FIELD_TASKS) & (kind == "json"), "kie").when((task == "classify") & (kind == "json"), "classify")
        .when((task == "statement") & ((kind == "text_layer") | (stated & (kind == "json"))), "statement").otherwise("not_applicable")
    )


def official_task(source: Column, subtask: Column) -> Column:
    """The benchmark's name of a task that has an official score, else null."""
    return F.when((source == BENCHMARK) & subtask.isin(*official.TASKS), subtask)


def worst_metrics(way: Column, layer: Column, header: Column, scored: Column) -> Column:
    """array of (metric, value, reason): the metrics that a scored page would get, at their worst; layer: the truth is a
    text layer, header: it has a column header, scored: it has an official score."""
    entry = lambda m, v, r=None: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), F.lit(r).cast("string").alias("reason"))
    worst = lambda m: entry(m, F.lit(1.0 if m in ERRORS else 0.0))
    out = F.array(F.struct(way.alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("reason")))
    for name, metrics in METRICS.items():
        rows = [worst(m) for m in metrics]
        if name == "statement":
            headless = F.array(*(entry(m, F.lit(None), "no_header") for m in metrics))
            made = F.concat(F.when(header, F.array(*rows)).otherwise(headless), F.when(layer, F.array(worst("cer"))).otherwise(F.array().cast(METRIC)))
        else:
            made = F.array(*rows)
        out = F.when(way == name, F.concat(made, F.when(scored, F.array(worst("tob_score"))).otherwise(F.array().cast(METRIC)))).otherwise(out)
    return out


METRIC = "array<struct<metric:string,value:double,reason:string>>"


def row_keys(rows: Column) -> Column:
    """What identifies each row of a statement: date and absolute amount."""
    return F.transform(rows, lambda r: typed.row_key(r.date, r.debit, r.credit, r.amount))


def row_scores(pred: Column, truth: Column) -> Column:
    """array of precision, recall and F1 of one-to-one matches of two pages' row keys, which are worked out once."""
    same = lambda rows, k: F.size(F.filter(rows, lambda x: x.eqNullSafe(k)))

    def counts(s: Column) -> Column:
        hits = F.transform(F.array_distinct(s.p), lambda k: F.least(same(s.p, k), same(s.t, k)))
        return F.struct(F.aggregate(hits, F.lit(0), lambda a, x: a + x).alias("tp"), F.size(s.p).alias("p"), F.size(s.t).alias("t"))

    return let(let(F.struct(pred.alias("p"), truth.alias("t")), counts), lambda c: F.array(*prf(c.tp, c.p, c.t)))


def bank_rules(bank: Column, rules: dict[str, statement.Bank] | None) -> tuple[Column, Column]:
    """(date_format, amount_column_split) of a bank, from a short table of configuration."""
    fmt, split = F.lit(None).cast("string"), F.lit(False)
    for name, r in (rules or {}).items():
        fmt = F.when(bank == name, F.lit(r.date_format)).otherwise(fmt)
        split = F.when(bank == name, F.lit(r.amount_column_split)).otherwise(split)
    return fmt, split


def table_html(text: Column, grids: Column) -> Column:
    """A prediction's text if it holds a table that is closed, or no table was parsed; else its first parsed table."""
    rows = F.transform(F.try_element_at(grids, F.lit(1)), lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))), ""), F.lit("</tr>")))
    whole = text.rlike(r"(?is)<table\b.*?</table\s*>") | (F.coalesce(F.size(grids), F.lit(0)) <= 0)
    return F.when(whole, text).otherwise(F.concat(F.lit("<table>"), F.array_join(rows, ""), F.lit("</table>")))


def answer_fields(fields: Column, prompt_version: Column, raw: Column) -> Column:
    """Fields of a prediction; a question's reply that was stored without any is read again."""
    again = F.startswith(prompt_version, F.lit("question-")) & (F.trim(raw) != "") & (F.coalesce(F.size(fields), F.lit(0)) <= 0)
    return F.coalesce(F.when(again, tables.json_fields_udf(F.when(again, raw))), fields)


def _map_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.create_map().cast("map<string,string>"))


def with_truth(manifest: DataFrame, truth: DataFrame, rules: dict[str, statement.Bank] | None = None, manual: DataFrame | None = None) -> DataFrame:
    """manifest rows with their truth, gt_page and has_header. A manual label (sample_id, page) goes before the stored
    truth and is one of kind json. Text layers without a stored page are read here, once per row."""
    t = truth.select("sample_id", "gt_kind", F.col("text").alias("gt_text"), "html", "raw", F.col("label").alias("gt_label"), F.col("fields").alias("gt_fields"), "words", "homography", "statement")
    m = manifest.join(t, "sample_id", "left")
    if manual is not None:
        m = m.join(manual.select("sample_id", F.col("page").alias("manual")), "sample_id", "left")
        m = m.withColumns({"gt_kind": F.when(F.col("manual").isNotNull(), "json").otherwise(F.col("gt_kind")), "statement": F.coalesce("manual", "statement")}).drop("manual")
    m = m.withColumn("way", way_of(F.col("task"), F.col("gt_kind"), F.col("statement").isNotNull()))
    layer = (F.col("way") == "statement") & F.col("statement").isNull()
    read = statement.text_layer_page(F.when(layer, F.col("words")), F.col("homography"), *bank_rules(F.col("bank"), rules))
    m = m.withColumn("gt_page", F.when(layer, read).otherwise(F.col("statement")))
    return m.withColumn("has_header", F.when(layer, F.col("gt_page.has_header")).otherwise(F.col("statement").isNotNull())).drop("words", "homography", "statement")


def _joined(manifest, predictions, truth, rules, manual) -> DataFrame:
    """Each manifest row and model with its prediction, truth, miss and partial."""
    models = sorted(r.model for r in predictions.select("model").distinct().collect())  # names of models only
    p = predictions.select(*KEYS, "prompt_version", "error", "raw_text", "text", "tables", "blocks", "fields", "label")
    r = spread(with_predictions(with_truth(manifest, truth, rules, manual), p, KEYS[:2], models), *KEYS)  # pages take long each
    output = F.concat(F.coalesce("raw_text", F.lit("")), F.coalesce("text", F.lit("")))
    miss = is_full_miss(F.col("missing"), F.col("error"), output)
    r = r.withColumns({"miss": miss, "partial": ~miss & F.col("error").isNotNull() & is_partial(F.col("error"), output), "official": official_task(F.col("source"), F.col("subtask"))})
    asked = (F.col("way") == "statement") & ~F.col("miss")
    page = statement.mapped_page(F.when(asked, F.col("tables")), F.when(asked, F.col("blocks")), F.when(asked, F.col("text")), *bank_rules(F.col("bank"), rules))
    return r.withColumn("page", F.when(asked, page))


def _field_rows(rows: DataFrame) -> DataFrame:
    """(keys, slices, field, is_critical and the columns of scoring.score_fields) of all scored fields, misses included."""
    of_page = F.col("way") == "statement"
    gt = F.when(of_page, statement.field_map(F.col("gt_page"))).otherwise(_map_or_empty(F.col("gt_fields")))
    got = F.when(of_page, statement.field_map(F.col("page"))).otherwise(_map_or_empty(answer_fields(F.col("fields"), F.col("prompt_version"), F.col("raw_text"))))
    f = rows.where(F.col("way").isin("kie", "statement")).withColumns({"_gt": gt, "_pred": F.when(~F.col("miss"), got)})
    extra = F.when(~F.col("miss"), F.array_except(F.map_keys("_pred"), F.map_keys("_gt"))).otherwise(F.array().cast("array<string>"))
    f = f.select(*KEYS, *SLICES, "critical_fields", "miss", "_gt", "_pred", F.explode(F.concat(F.map_keys("_gt"), F.array_sort(extra))).alias("field"))
    f = f.select(
        *KEYS, *SLICES, "field", F.coalesce(F.array_contains("critical_fields", F.col("field")), F.lit(False)).alias("is_critical"), "miss",
        F.col("_pred")[F.col("field")].alias("pred"), F.col("_pred")[F.col("field")].alias("pred_raw"), F.col("_gt")[F.col("field")].alias("gt"), F.array_contains(F.map_keys("_gt"), F.col("field")).alias("in_gt"),
    )
    return scoring.score_fields(f, F.col("miss"))


def score_run(manifest: DataFrame, predictions: DataFrame, truth: DataFrame, rules: dict[str, statement.Bank] | None = None, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, fields) of every manifest row and model of the predictions.

    scores: keys, slices, metric, value, is_critical (null), extra (full_miss, missing_prediction, partial, error,
    reason). A missing prediction is a full miss. Python metrics get null, and do no work, where they don't apply."""
    rows = _joined(manifest, predictions, truth, rules, manual)
    way, hit = F.col("way"), ~F.col("miss")
    at = lambda *names: hit & way.isin(*names)
    empty = F.lit("")
    text, answer = F.coalesce("text", empty), F.coalesce(answer_text(F.col("prompt_version"), F.col("raw_text"), F.col("text")), empty)
    read = F.when(way == "table", F.col("html")).otherwise(F.col("gt_text"))
    layer = F.col("gt_kind") == "text_layer"
    by_text = at("text", "table", "docparse") | (at("statement") & layer)
    rows = rows.withColumns({
        "_answer": F.when(hit, answer), "_plain": plain_text(F.when(by_text, text)), "_read": plain_text(F.when(by_text, read)),
        "_said": canonical_text(F.when(at("classify"), F.trim(F.coalesce("label", "raw_text", empty)))), "_label": canonical_text(F.when(at("classify"), F.coalesce("gt_label", empty))),
        "_html": F.when(at("table"), table_html(text, F.col("tables"))),
    })
    named = F.when(hit & ~way.isin("text", "no_gt", "not_applicable"), F.col("official"))
    rows = rows.withColumns({
        "_bmfl": F.when(F.col("_answer") == "", 0.0).otherwise(tables.text_similarity_udf(F.when(at("text"), F.col("_answer")), F.when(at("text"), F.col("gt_text")))),
        "_teds": tables.teds_udf(F.col("_html"), F.when(at("table"), F.col("html"))),
        "_tree": tables.document_similarity_udf(F.when(at("docparse"), F.col("_answer")), F.when(at("docparse"), F.col("gt_text"))),
        "_official": official.official(named, F.col("_answer"), F.when(named.isNotNull(), truth_answer(F.col("gt_kind")))),
        "_cer": cer(F.col("_plain"), F.col("_read")), "_prf": F.when(at("statement"), row_scores(row_keys(F.col("page.rows")), row_keys(F.col("gt_page.rows")))),
    })
    entry = lambda m, v, r=F.lit(None): F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"), r.cast("string").alias("reason"))
    none = F.array().cast(METRIC)
    on = F.when(F.col("has_header"), F.lit(True))
    prfs = [F.col("_prf")[i] for i in range(3)]
    why = F.when(~F.col("has_header"), "no_header")
    made = (
        F.when(way == "text", F.array(entry("cer", F.col("_cer")), entry("wer", wer(tokens(F.col("_plain")), tokens(F.col("_read")))), entry("bmfl", F.col("_bmfl"))))
        .when(way == "table", F.array(entry("ted", F.col("_teds")), entry("cer", F.col("_cer")))).when(way == "docparse", F.array(entry("ted", F.col("_tree")), entry("cer", F.col("_cer"))))
        .when(way == "classify", F.array(entry("anls", anls(F.col("_said"), F.col("_label"))))).when(way == "kie", none)
        .when(way == "statement", F.concat(F.array(*(entry(m, F.when(on, v), why) for m, v in zip(METRICS["statement"], prfs, strict=True))), F.when(layer, F.array(entry("cer", F.col("_cer")))).otherwise(none)))
        .otherwise(F.array(F.struct(way.alias("metric"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("reason"))))
    )
    scored = F.col("official").isNotNull() & ~way.isin("no_gt", "not_applicable")
    made = F.concat(made, F.when(scored, F.array(entry("tob_score", F.when(way == "text", F.col("_bmfl")).otherwise(F.col("_official"))))).otherwise(none))
    made = F.when(F.col("miss"), worst_metrics(way, layer, F.col("has_header"), scored)).otherwise(made)
    extra = F.struct(
        F.when(F.col("miss"), True).alias("full_miss"), F.when(F.col("missing"), True).alias("missing_prediction"), F.when(F.col("partial"), True).alias("partial"), F.col("error"),
    )
    long = rows.select(*KEYS, *SLICES, extra.alias("_x"), F.explode(made).alias("_m"))
    out = lambda df: df.select(*KEYS, *SLICES, "_m.metric", "_m.value", F.lit(None).cast("boolean").alias("is_critical"), F.struct("_x.*", "_m.reason").alias("extra"))
    fields = _field_rows(rows)
    # Key-value scores come from the fields; a page without any field on either side has all right.
    counts = scoring.field_f1(fields.where(~F.col("miss")), KEYS).select(*KEYS, "precision", "recall", "f1")
    kie = rows.where(at("kie")).select(*KEYS, *SLICES, extra.alias("_x")).join(counts, KEYS, "left")
    values = [entry(m, F.coalesce(v, F.lit(1.0))) for m, v in zip(METRICS["kie"], ("precision", "recall", "f1"), strict=True)]
    return out(long).unionByName(out(kie.select(*KEYS, *SLICES, "_x", F.explode(F.array(*values)).alias("_m")))), fields.drop("miss")


def ordered(scores: DataFrame, *last: str) -> DataFrame:
    """Scores (or fields) in the order of their keys. They are written first, as ordering samples its rows in a pass of its
    own, which would work them out a second time."""
    return keep(scores, "ordered").orderBy(*KEYS, *last)


# --- statement files --------------------------------------------------------------------------------------------------


def map_pages(manifest: DataFrame, predictions: DataFrame, rules: dict[str, statement.Bank] | None = None) -> DataFrame:
    """Every statement page of every model: keys, slices, page_no, file_id, page, which is empty where the prediction is
    missing or failed, so that no file loses a page."""
    rows = manifest.where(F.col("task") == "statement")
    models = sorted(r.model for r in predictions.select("model").distinct().collect())  # names of models only
    p = predictions.select(*KEYS, "error", "raw_text", "text", "tables", "blocks")
    r = spread(with_predictions(rows, p, KEYS[:2], models), *KEYS)  # pages take long each
    miss = is_full_miss(F.col("missing"), F.col("error"), F.concat(F.coalesce("raw_text", F.lit("")), F.coalesce("text", F.lit(""))))
    good = lambda c: F.when(~miss, F.col(c))
    page = statement.mapped_page(good("tables"), good("blocks"), good("text"), *bank_rules(F.col("bank"), rules))
    return r.select(*KEYS, *SLICES, "page_no", F.regexp_replace("sample_id", r"-p\d+$", "").alias("file_id"), page.alias("page"))


FILE = ["file_id", "condition", "model"]


def file_checks(pages: DataFrame) -> DataFrame:
    """ledger.check_files() of mapped pages: one row per file, condition and model, with the sample_id and slices of its
    first page, on which its scores stand."""
    row = F.transform("page.rows", lambda r, i: ledger.file_row(F.col("page_no"), i, r))
    own = pages.select(*FILE, F.struct("page_no", "sample_id", *SLICES).alias("first"), F.coalesce(row, F.array()).alias("rows"), ledger.file_page(F.col("page_no"), F.col("page")).alias("page"))
    files = own.groupBy(*FILE).agg(F.min("first").alias("first"), F.flatten(F.collect_list("rows")).alias("rows"), F.collect_list("page").alias("pages"))
    files = files.select(*FILE, "first.sample_id", *(f"first.{c}" for c in SLICES), F.sort_array("rows").alias("rows"), F.sort_array("pages").alias("pages"))
    return ledger.checked(files)


def file_scores(files: DataFrame) -> DataFrame:
    """Scores of files: row_consistency_rate and file_reconciles, once per file."""
    metric = lambda m, v: F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
    both = F.array(metric("row_consistency_rate", F.col("row_consistency_rate")), metric("file_reconciles", F.col("file_reconciles").cast("int")))
    return files.select(*KEYS, *SLICES, F.explode(both).alias("m")).select(*KEYS, *SLICES, "m.*")


def _precision(flags: Column) -> Column:
    """Share of flags that were true errors; null without any."""
    return F.try_divide(F.size(F.filter(flags, lambda v: v)), F.size(flags))


def file_flag_precision(pages: DataFrame, files: DataFrame, manual: DataFrame) -> DataFrame:
    """(keys, slices, metric, value, n_flags): of each labelled page's rows that break the balance, the share that
    differs from the label in any cell."""
    bad = files.select(*FILE, F.explode(F.filter("checks", lambda c: c.consistent == F.lit(False))).alias("c")).select(*FILE, "c.page_no", F.col("c.page_row_index").alias("at"))
    flagged = bad.groupBy(*FILE, "page_no").agg(F.collect_list("at").alias("at"))  # rows of one page
    both = pages.join(manual.select("sample_id", F.col("page").alias("label")), "sample_id").join(flagged, [*FILE, "page_no"], "left")
    cells = lambda r: F.struct(*(r[c] for c in statement.CELLS))
    pick = lambda page, i: F.try_element_at(F.transform(F.col(page)["rows"], cells), (i + 1).cast("int"))
    blank = F.struct(*(F.lit(None).cast("string" if c == "date" else "decimal(20,4)").alias(c) for c in statement.CELLS))
    wrong = F.transform(F.coalesce("at", F.array().cast("array<int>")), lambda i: ~F.coalesce(pick("page", i), blank).eqNullSafe(F.coalesce(pick("label", i), blank)))
    return both.select(*KEYS, *SLICES, F.lit("arith_flag_precision").alias("metric"), _precision(wrong).alias("value"), F.size(wrong).alias("n_flags"))


def page_pairs(pages: DataFrame) -> DataFrame:
    """Every two models of a page, by name: sample_id, condition, slices, left, right, a, b. Models per page are few."""
    sides = pages.groupBy("sample_id", "condition", *SLICES).agg(F.array_sort(F.collect_list(F.struct("model", "page"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda a, i: F.transform(F.slice("m", i + 2, F.greatest(F.size("m") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sides.select("sample_id", "condition", *SLICES, F.explode(pairs).alias("p")).select("sample_id", "condition", *SLICES, F.col("p.a.model").alias("left"), F.col("p.b.model").alias("right"), F.col("p.a.page").alias("a"), F.col("p.b.page").alias("b"))


def _head(page: Column, field: str) -> Column:
    """A scored header field, so that equal values are equal."""
    return typed.parse_account(page[field]) if field == "account_no" else page[field]


def verdicts(a: Column, b: Column) -> Column:
    """array of booleans of two pages, null where nothing can be compared: of each scored header field, and of the balances
    of rows aligned by date, amount and place among equals, where a row of one side alone disagrees. Pages whose keys are in
    the same order, as most are, align row by row."""
    heads = F.array(*(_head(a, f) == _head(b, f) for f in statement.SCORED))
    entry = lambda r: F.struct(typed.row_key(r.date, r.debit, r.credit, r.amount).alias("k"), r.balance.alias("balance"))
    ks = lambda rows: F.transform(rows, lambda x: x.k)
    same = lambda x, y: F.when(x.isNull() | y.isNull(), False).otherwise(x.balance == y.balance)

    def aligned(s: Column) -> Column:
        of = lambda rows, k: F.filter(rows, lambda x: x.k.eqNullSafe(k))
        keys = F.array_distinct(F.concat(ks(s.a), ks(s.b)))
        apart = F.flatten(F.transform(keys, lambda k: F.zip_with(of(s.a, k), of(s.b, k), same)))
        return F.when(ks(s.a).eqNullSafe(ks(s.b)), F.zip_with(s.a, s.b, same)).otherwise(apart)

    return F.concat(heads, let(F.struct(F.transform(a["rows"], entry).alias("a"), F.transform(b["rows"], entry).alias("b")), aligned))


def flags(a: Column, b: Column, label: Column) -> Column:
    """array of booleans: of each cell on which two pages differ, a value of one side alone included, whether the label
    differs from either."""
    verdict = lambda x, y, z: F.when(~x.eqNullSafe(y), ~x.eqNullSafe(z) | ~y.eqNullSafe(z))
    heads = F.array(*(verdict(*(_head(p, f) for p in (a, b, label))) for f in statement.SCORED))
    rows = lambda p: F.coalesce(p["rows"], F.array().cast(statement.PAGE["rows"].dataType))
    lines = F.arrays_zip(rows(a).alias("a"), rows(b).alias("b"), rows(label).alias("z"))
    cells = F.transform(lines, lambda r: F.when(~r.a.eqNullSafe(r.b), F.array(*(verdict(r.a[c], r.b[c], r.z[c]) for c in statement.CELLS))).otherwise(F.array().cast("array<boolean>")))
    return F.filter(F.concat(heads, F.flatten(cells)), lambda v: v.isNotNull())


def pair_scores(pairs: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """(keys, slices, metric, value, n) of pairs of models: agreement_rate, the share of n comparable keys that agree, and
    agreement_flag_precision, of each labelled page's n cells on which they differ the share where the label differs from
    either. Pairs are read once for both; each label (sample_id, page) of a page counts."""
    metric = lambda m, v: F.struct(F.lit(m).alias("metric"), v.alias("v"))
    both = F.array(metric("agreement_rate", F.filter(verdicts(F.col("a"), F.col("b")), lambda v: v.isNotNull())))
    if manual is not None:
        pairs = pairs.join(manual.groupBy("sample_id").agg(F.collect_list(F.struct("page")).alias("labels")), "sample_id", "left")
        labels = F.coalesce("labels", F.array().cast(T.ArrayType(T.StructType([T.StructField("page", statement.PAGE)]))))
        both = F.concat(both, F.transform(labels, lambda x: metric("agreement_flag_precision", flags(F.col("a"), F.col("b"), x.page))))
    m = pairs.select("sample_id", "condition", F.concat_ws("|", "left", "right").alias("model"), *SLICES, F.explode(both).alias("m"))
    return m.select(*KEYS, *SLICES, "m.metric", _precision(F.col("m.v")).alias("value"), F.size("m.v").alias("n"))


def statement_checks(manifest: DataFrame, predictions: DataFrame, rules: dict[str, statement.Bank] | None = None, manual: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(scores, files): arithmetic of each file, agreement of each two models, and, with manual labels (sample_id, page),
    how often their flags were right. Pages, files and labels are read by several of the scores, so each is worked out once
    and written."""
    pages = keep(map_pages(manifest, predictions, rules), "pages")
    files, pairs = keep(file_checks(pages), "files"), page_pairs(pages)
    manual = None if manual is None else keep(manual.select("sample_id", "page"), "labels")
    parts = [file_scores(files), pair_scores(pairs, manual).drop("n")]
    if manual is not None:
        parts.append(file_flag_precision(pages, files, manual).drop("n_flags"))
    return reduce(DataFrame.unionByName, parts), files


def queue_cells(pages: DataFrame) -> DataFrame:
    """(sample_id, page_no, file_id, field, row_index, model, value, normal): cells of pages as a review queue lists them."""
    c = pages.select("sample_id", "page_no", "file_id", "model", F.explode(statement.cell_map(F.col("page"))).alias("c"))
    normal = F.when(F.col("c.field") == "account_no", typed.parse_account(F.col("c.value"))).otherwise(F.col("c.value"))
    return c.select("sample_id", "page_no", "file_id", "c.field", "c.row_index", "model", null_if_blank(F.col("c.value")).alias("value"), normal.alias("normal"))
