"""Queries over whole runs: scoring, statements, ingest, readers and reports, on tables made of the driver's own, and the SQL
that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import official, pages, statement
from ..operators import assess, calibration, confidence, ingest, joins, readers, run, sampling, serving, slices
from ..sources import io, registry
from ..sources.scratch import keep
from .catalogue import query, r6, t

S = F.lit


def long(df: DataFrame, keep: list[str], *structs) -> DataFrame:
    return df.select(*keep, F.explode(F.array(*structs)).alias("_s")).select(*keep, "_s.*")


def chosen(c, *values):
    """The value at place c, from 0."""
    return F.element_at(F.array(*(S(v) for v in values)), (c + 1).cast("int"))


# --- a scored run: each customer is a sample, whose task and truth follow from its number -----------------------------


def _run(spark: SparkSession, d: str):
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", F.col("c_custkey").cast("string").alias("sample_id"), (F.col("c_custkey") % 8).cast("int").alias("w"))
    none = F.lit(None).cast("string")
    task = chosen(F.col("w"), "ocr_line", "table", "docparse", "kie", "classify", "ocr_fullpage", "kie", "statement")
    sub = chosen(F.col("w"), "Fine-grained text recognition", "Table parsing", "Document parsing", "Key information extraction", "Document classification", "other", "other", "other")
    manifest = c.select("sample_id", S("clean").alias("condition"), S("thaiocrbench").alias("source"), task.alias("task"), sub.alias("subtask"), none.alias("domain"), none.alias("bank"), none.alias("doc_type"), S(1).alias("page_no"), F.array(S("name")).alias("critical_fields"))
    line = F.concat("c_name", S(" "), "c_mktsegment", S(" alpha beta"))
    html = lambda x: F.concat(S("<table><tr><td>"), x, S("</td><td>k</td></tr></table>"))
    doc = F.concat(S("# "), "c_name", S("\nbody"))
    maps = F.create_map(S("name"), F.col("c_name"), S("segment"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).otherwise(""))
    kind = chosen(F.col("w"), "text", "html", "text", "json", "json", "none", "text", "json")
    truth = c.select(
        "sample_id", kind.alias("gt_kind"), F.when(F.col("w") == 0, line).when(F.col("w") == 2, doc).when(F.col("w") == 6, "x").alias("text"), F.when(F.col("w") == 1, html(F.col("c_name"))).alias("html"),
        F.when(F.col("w") == 3, F.to_json(maps)).alias("raw"), F.when(F.col("w") == 4, F.col("c_mktsegment")).alias("label"), F.when(F.col("w") == 3, maps).alias("fields"),
        F.lit(None).cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>").alias("words"), F.lit(None).cast("array<array<double>>").alias("homography"), F.lit(None).cast(statement.PAGE).alias("statement"),
    )
    odd = F.col("c_custkey") % 5 == 0
    said = F.when(F.col("w") == 0, F.when(odd, F.concat("c_name", S(" "), "c_mktsegment", S(" alpha gamma"))).otherwise(line)).when(F.col("w") == 1, F.when(odd, html(F.lower("c_name"))).otherwise(html(F.col("c_name")))).when(F.col("w") == 2, doc).when(F.col("w") == 4, F.when(odd, F.concat("c_mktsegment", S("s"))).otherwise(F.lower("c_mktsegment"))).otherwise("y")
    got = F.create_map(S("name"), F.when(odd, "nobody").otherwise(F.col("c_name")), S("segment"), F.col("c_mktsegment"), S("more"), F.when(odd, "z").otherwise(""))
    partial = F.col("c_custkey") % 13 == 0
    error = F.when(partial, "1 of 3 blocks failed").when(F.col("c_custkey") % 17 == 0, "timeout")
    p = c.where("c_custkey % 11 <> 0").select(
        "sample_id", S("clean").alias("condition"), S("m").alias("model"), S("question-1").alias("prompt_version"), error.alias("error"), F.when(F.col("w") == 3, F.to_json(got)).otherwise(said).alias("raw_text"), said.alias("text"),
        F.lit(None).cast("array<array<array<string>>>").alias("tables"), F.lit(None).cast("array<struct<type:string,text:string>>").alias("blocks"), F.when(F.col("w") == 3, got).alias("fields"), F.when(F.col("w") == 4, said).alias("label"),
    )
    return manifest, p, truth


_RUN_SQL = """c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey % 8 AS w, c_name AS nm, c_mktsegment AS sg, c_custkey % 5 = 0 AS odd, c_custkey % 11 = 0 AS missing, c_custkey % 13 = 0 AS part FROM customer),
b AS (SELECT *, missing OR (k % 17 = 0 AND NOT part) AS miss, nm || ' ' || sg || ' alpha beta' AS line, nm || ' ' || sg || ' alpha gamma' AS line2 FROM c),
f AS (SELECT b.*, u.field, u.gt, u.in_gt, CASE WHEN miss THEN NULL ELSE u.pred END AS pred FROM b, LATERAL (VALUES ('name', nm, true, CASE WHEN odd THEN 'nobody' ELSE nm END), ('segment', CASE WHEN k % 3 <> 0 THEN sg END, true, sg), ('more', NULL, false, CASE WHEN odd THEN 'z' END)) u(field, gt, in_gt, pred) WHERE w = 3 AND (u.in_gt OR NOT miss)),
fs AS (SELECT *, NOT miss AND coalesce(pred = gt, pred IS NULL AND gt IS NULL) AS ex FROM f),
fc AS (SELECT sample_id, sum((ex AND pred IS NOT NULL AND in_gt)::INT) AS tp, count(pred) AS np, count(gt) AS ng FROM fs GROUP BY sample_id),
fp AS (SELECT sample_id, CASE WHEN np > 0 THEN tp / np ELSE (ng = 0)::INT END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE (np = 0)::INT END AS r FROM fc),
lev AS (SELECT *, levenshtein(CASE WHEN odd THEN line2 ELSE line END, line) AS dist FROM b),
bm AS (SELECT *, CASE WHEN odd THEN (0.75 * (1 - 0.5 / 27) + 0.75 + 1 - dist / greatest(length(line), length(line2))::DOUBLE) / 4 ELSE (3 + 1 - 0.5 / 64) / 4 END AS bmfl FROM lev),
v AS (SELECT bm.*, u.metric, u.good, u.worst FROM bm LEFT JOIN fp USING (sample_id), LATERAL (VALUES
 (0, 'cer', least(1.0, dist / length(line)::DOUBLE), 1.0), (0, 'wer', CASE WHEN odd THEN 0.25 ELSE 0.0 END, 1.0), (0, 'bmfl', bmfl, 0.0), (0, 'tob_score', bmfl, 0.0),
 (1, 'ted', CASE WHEN odd THEN 1 - 1 / length(nm)::DOUBLE / 3 ELSE 1.0 END, 0.0), (1, 'cer', CASE WHEN odd THEN 1 / (length(nm) + 2)::DOUBLE ELSE 0.0 END, 1.0), (1, 'tob_score', CASE WHEN odd THEN 1 - 1 / length(nm)::DOUBLE / 3 ELSE 1.0 END, 0.0),
 (2, 'ted', 1.0, 0.0), (2, 'cer', 0.0, 1.0), (2, 'tob_score', 1.0, 0.0), (3, 'kie_precision', fp.p, 0.0), (3, 'kie_recall', fp.r, 0.0), (3, 'kie_f1', CASE WHEN fp.p + fp.r > 0 THEN 2 * fp.p * fp.r / (fp.p + fp.r) ELSE 0 END, 0.0),
 (4, 'anls', CASE WHEN odd THEN 1 - 1 / (length(sg) + 1)::DOUBLE ELSE 1.0 END, 0.0), (4, 'tob_score', 1.0, 0.0), (5, 'no_gt', NULL, NULL), (6, 'not_applicable', NULL, NULL), (7, 'not_applicable', NULL, NULL)) u(w2, metric, good, worst) WHERE u.w2 = bm.w)"""


@query("WITH " + _RUN_SQL + """ SELECT sample_id, metric, round(CAST(CASE WHEN miss THEN worst ELSE good END AS DOUBLE), 6) AS value, miss AS full_miss, missing AS missing_prediction, part AND NOT missing AS partial FROM v""")
def score_run(spark, d):
    """Every way of scoring, misses and partial pages included; key-value scores of the benchmark have a query of their own."""
    scores, _ = run.score_run(*_run(spark, d))
    s = scores.where("NOT (metric = 'tob_score' AND task = 'kie')")
    return s.select("sample_id", "metric", r6("value").alias("value"), *(F.coalesce(f"extra.{c}", S(False)).alias(c) for c in ("full_miss", "missing_prediction", "partial")))


@query("WITH " + _RUN_SQL + """ SELECT sample_id, field, coalesce(pred, '') AS pred, coalesce(gt, '') AS gt, ex::INT AS field_exact, NOT miss AND gt IS NULL AND pred IS NOT NULL AS false_accept, gt IS NOT NULL AND pred IS NULL AS false_reject, field = 'name' AS is_critical FROM fs""")
def run_fields(spark, d):
    _, f = run.score_run(*_run(spark, d))
    e = lambda c: F.coalesce(c, S("")).alias(c)
    return f.select("sample_id", "field", e("pred"), e("gt"), "field_exact", "false_accept", "false_reject", "is_critical")


@query("WITH " + _RUN_SQL + """, r AS (SELECT *, CASE w WHEN 0 THEN 'ocr_line' WHEN 1 THEN 'table' WHEN 2 THEN 'docparse' WHEN 3 THEN 'kie' WHEN 4 THEN 'classify' END AS task, CASE WHEN miss THEN worst ELSE good END AS value FROM v WHERE w < 5)
SELECT task, metric, round(CAST(avg(value) AS DOUBLE), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM r WHERE NOT (w = 3 AND metric = 'tob_score') GROUP BY task, metric""")
def task_tables(spark, d):
    """The standard tables by task and model, without intervals."""
    scores, _ = run.score_run(*_run(spark, d))
    rows, cut = slices.standard_slices(scores.where("NOT (metric = 'tob_score' AND task = 'kie')"))
    m = slices.means(slices.sliced(rows, cut), ["table", "task", "metric"])
    return m.where("table = 'task_model'").select("task", "metric", r6("mean").alias("mean"), "n")


# --- statements: each customer's orders are a file of one page, read by two models ------------------------------------


def _orders(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.date_format("o_orderdate", "d/M/yyyy").alias("printed"), F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    w = Window.partitionBy("o_custkey").orderBy("date", "o_orderkey")
    out = F.col("o_orderkey") % 3 == 0
    net = F.when(out, -F.col("price")).otherwise(F.col("price"))
    bal = F.sum(net).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(20,2)")
    return o.withColumns({"pos": F.row_number().over(w), "out": out, "balance": bal, "wrong": F.col("o_orderkey") % 7 == 0})


def _lines(o, **balances):
    """Cells of each customer's orders, in order, with the balance printed in each way."""
    cell = lambda on: F.when(on, F.format_number("price", 2)).otherwise("")
    row = F.struct(F.array("printed", F.concat(S("order "), "o_orderkey"), cell(F.col("out")), cell(~F.col("out"))).alias("r"), *(F.format_number(b, 2).alias(m) for m, b in balances.items()))
    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("r")))).alias("rows"))


def _grid(rows, *balances, keep=()):
    """Table cells of each customer's lines, a column for each way to print the balance: a header of two rows, an opening
    row, and one row an order."""
    head = F.array(F.array(*map(S, ("วันที่", "รายการ", "ถอน", "ฝาก", "ยอดคงเหลือ"))), F.array(*map(S, ("Date", "Particulars", "Withdrawal", "Deposit", "Balance"))), F.array(*map(S, ("", "B/F", "", "", "0.00"))))
    blocks = F.array(F.struct(S("text").alias("type"), F.concat(S("Account No. 123-4-"), F.lpad("o_custkey", 7, "0"), S("\nAccount Name\nSomchai Jaidee")).alias("text")))
    grid = lambda m: F.array(F.concat(head, F.transform("rows", lambda x: F.concat(x.r.r, F.array(x.r[m])))))
    return rows.select("o_custkey", *keep, *(grid(m).alias(m) for m in balances), blocks.alias("blocks"))


_ORDERS_SQL = """o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(o_totalprice AS DECIMAL(20,2)) AS price, o_orderkey % 3 = 0 AS out, o_orderkey % 7 = 0 AS wrong FROM orders),
l AS (SELECT *, row_number() OVER w AS pos, sum(CASE WHEN out THEN -price ELSE price END) OVER (w ROWS UNBOUNDED PRECEDING) AS balance FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY date, o_orderkey))"""


@query("WITH " + _ORDERS_SQL + " SELECT o_custkey, CAST(pos - 1 AS INTEGER) AS pos, date, CASE WHEN out THEN price::DOUBLE END AS debit, CASE WHEN NOT out THEN price::DOUBLE END AS credit, balance::DOUBLE AS balance, 'Somchai Jaidee' AS account_name, '123-4-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') AS account_no, 0.0::DOUBLE AS opening FROM l")
def statement_pages(spark, d):
    """Orders printed as tables with stacked headers and labelled blocks, and mapped back."""
    p = joins.spread(_grid(_lines(_orders(spark, d), tables=F.col("balance")), "tables"), "o_custkey").select("o_custkey", statement.mapped_page(F.col("tables"), F.col("blocks"), S("")).alias("p"))
    x = p.select("o_custkey", "p.account_name", "p.account_no", F.col("p.opening_balance").cast("double").alias("opening"), F.posexplode_outer("p.rows").alias("pos", "r")).where("pos is not null")
    return x.select("o_custkey", "pos", "r.date", *(F.col(f"r.{c}").cast("double").alias(c) for c in ("debit", "credit", "balance")), "account_name", "account_no", "opening")


@query("WITH " + _ORDERS_SQL + " SELECT o_custkey, CAST(pos - 1 AS INTEGER) AS pos, date, CASE WHEN out THEN price::DOUBLE END AS debit, CASE WHEN NOT out THEN price::DOUBLE END AS credit, balance::DOUBLE AS balance FROM l")
def text_layer_rows(spark, d):
    """Orders as positioned words with one money column for both sides, told apart by their places."""
    o = _orders(spark, d)
    wide = lambda s: F.length(s) * 6.0
    at = lambda s, x0, x1, y: F.struct(s.cast("string").alias("text"), x0.cast("double").alias("x0"), y.cast("double").alias("y0"), x1.cast("double").alias("x1"), (y + 10).cast("double").alias("y1"))
    left = lambda s, x, y: at(s, S(x), S(x) + wide(s), y)
    right = lambda s, x, y: at(s, x - wide(s), x, y)
    y = F.col("pos") * 20 + 40
    money = F.format_number("price", 2)
    words = F.array(left(F.col("printed"), 0, y), left(F.concat(S("ref"), "o_orderkey"), 90, y), right(money, F.when(F.col("out"), 300).otherwise(420), y), right(F.format_number("balance", 2), S(600), y))
    head = F.array(*(left(S(w), x, S(20)) for w, x in (("Date", 0), ("Particulars", 90), ("Withdrawal", 250), ("/", 312), ("Deposit", 320), ("Balance", 560))))
    page = joins.spread(o.groupBy("o_custkey").agg(F.concat(head, F.flatten(F.collect_list(words))).alias("words")), "o_custkey").select("o_custkey", statement.text_layer_page(F.col("words"), split=S(True)).alias("p"))
    # One side alone has no gap to tell sides by: the printed sign between the header's words decides there.
    x = page.select("o_custkey", F.posexplode_outer("p.rows").alias("pos", "r")).where("pos is not null")
    return x.select("o_custkey", "pos", "r.date", *(F.col(f"r.{c}").cast("double").alias(c) for c in ("debit", "credit", "balance")))


def _statement_run(spark, d):
    # The lines of both models' grids come from one pass over the orders, which is written with the condition, so that pages
    # are dealt by all of their keys wherever they meet.
    lines = keep(_lines(_orders(spark, d), a=F.col("balance"), b=F.when(F.col("wrong"), F.col("balance") + 1).otherwise(F.col("balance"))).withColumn("condition", S("clean")), "grids")
    grids = {m: _grid(lines, m, keep=["condition"]).withColumnRenamed(m, "tables") for m in ("a", "b")}
    sample = F.concat(S("BS-"), F.lpad("o_custkey", 7, "0"), S("-p1"))
    none = F.lit(None).cast("string")
    manifest = lines.select(sample.alias("sample_id"), "condition", S("bankstmt").alias("source"), S("statement").alias("task"), *(none.alias(c) for c in ("subtask", "domain", "bank", "doc_type")), S(1).alias("page_no"), F.array(S("account_no")).alias("critical_fields"))
    preds = [g.select(sample.alias("sample_id"), "condition", S(m).alias("model"), S("page-1").alias("prompt_version"), none.alias("error"), S("").alias("raw_text"), S("").alias("text"), "tables", "blocks", F.lit(None).cast("map<string,string>").alias("fields"), none.alias("label")) for m, g in grids.items()]
    manual = joins.spread(grids["a"].where("o_custkey % 2 = 0"), "o_custkey").select(sample.alias("sample_id"), statement.mapped_page(F.col("tables"), F.col("blocks"), S("")).alias("page"))
    return manifest, preds[0].unionByName(preds[1]), manual


_CHECKS_SQL = _ORDERS_SQL + """, m AS (SELECT l.*, v.model, CASE WHEN v.model = 'b' AND wrong THEN balance + 1 ELSE balance END AS printed FROM l, (VALUES ('a'), ('b')) v(model)),
k AS (SELECT *, printed = coalesce(lag(printed) OVER (PARTITION BY o_custkey, model ORDER BY pos), 0) + CASE WHEN out THEN -price ELSE price END AS ok, 'BS-' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') || '-p1' AS sample_id FROM m)"""


@query("WITH " + _CHECKS_SQL + """ SELECT sample_id, model, 'row_consistency_rate' AS metric, round(avg(ok::INT), 6) AS value FROM k GROUP BY sample_id, model UNION ALL SELECT sample_id, model, 'file_reconciles', bool_and(ok)::INT::DOUBLE FROM k GROUP BY sample_id, model
UNION ALL SELECT sample_id, model, 'arith_flag_precision', round(avg((model = 'b' AND wrong)::INT) FILTER (NOT ok), 6) FROM k WHERE o_custkey % 2 = 0 GROUP BY sample_id, model
UNION ALL SELECT sample_id, 'a|b', 'agreement_rate', round((3 + count(*) FILTER (NOT wrong)) / (3 + count(*))::DOUBLE, 6) FROM k WHERE model = 'a' GROUP BY sample_id
UNION ALL SELECT sample_id, 'a|b', 'agreement_flag_precision', CASE WHEN count(*) FILTER (wrong) > 0 THEN 1.0 END FROM k WHERE model = 'a' AND o_custkey % 2 = 0 GROUP BY sample_id""")
def statement_checks(spark, d):
    """Arithmetic, agreement, and how often the flags of both were right against labels."""
    manifest, preds, manual = _statement_run(spark, d)
    scores, _ = run.statement_checks(manifest, preds, manual=manual)
    return scores.select("sample_id", "model", "metric", r6("value").alias("value"))


@query("WITH " + _CHECKS_SQL + """ SELECT sample_id, model, 'row_f1' AS metric, 1.0::DOUBLE AS value FROM k WHERE o_custkey % 2 = 0 GROUP BY ALL UNION ALL SELECT sample_id, model, 'row_precision', 1.0 FROM k WHERE o_custkey % 2 = 0 GROUP BY ALL UNION ALL SELECT sample_id, model, 'row_recall', 1.0 FROM k WHERE o_custkey % 2 = 0 GROUP BY ALL
UNION ALL SELECT sample_id, model, 'no_gt', NULL FROM k WHERE o_custkey % 2 = 1 GROUP BY ALL""")
def statement_scores(spark, d):
    """Pages with a manual label against it; the others have no truth."""
    manifest, preds, manual = _statement_run(spark, d)
    none = lambda kind: F.lit(None).cast(kind)
    truth = manifest.select("sample_id", S("none").alias("gt_kind"), *(none("string").alias(c) for c in ("text", "html", "raw", "label")), none("map<string,string>").alias("fields"), none("array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>").alias("words"), none("array<array<double>>").alias("homography"), none(statement.PAGE).alias("statement"))
    scores, _ = run.score_run(manifest, preds, truth, manual=manual)
    return scores.select("sample_id", "model", "metric", r6("value").alias("value"))


@query("WITH " + _CHECKS_SQL + " SELECT a.sample_id, 'balance' AS field, CAST(a.pos - 1 AS INTEGER) AS row_index, true AS differs FROM k a WHERE model = 'a' AND wrong")
def disagreement_queue(spark, d):
    """Cells on which two models differ, for review."""
    manifest, preds, _ = _statement_run(spark, d)
    cells = run.queue_cells(run.map_pages(manifest, preds))
    return sampling.review_queue(cells, ["sample_id", "field", "row_index"], share=0.0).drop("values")


def _queue(spark, d):
    o = _orders(spark, d)
    cells = long(
        o.where("o_custkey % 2 = 0"), ["o_custkey", "o_orderkey"], F.struct(S("date").alias("field"), (F.col("pos") * 2 - 2).cast("string").alias("row_index"), F.col("printed").alias("label")),
        F.struct(S("balance").alias("field"), (F.col("pos") * 2 - 2).cast("string").alias("row_index"), F.format_number("balance", 2).alias("label")),
        F.struct(S("credit").alias("field"), (F.col("pos") * 2 - 1).cast("string").alias("row_index"), S("").alias("label")), F.struct(S("account_name").alias("field"), S("").alias("row_index"), S("  A  B ").alias("label")),
    )
    return cells.select((F.col("o_orderkey") * 10 + F.length("field")).alias("line"), F.concat(S("s"), "o_custkey").alias("sample_id"), S("2").alias("page_no"), "field", "row_index", "label")


@query("WITH " + _ORDERS_SQL + ", g AS (SELECT o_custkey, max(pos) AS n FROM l WHERE o_custkey % 2 = 0 GROUP BY o_custkey), i AS (SELECT o_custkey, unnest(range(2 * n - 1)) AS place FROM g) SELECT 's' || i.o_custkey AS sample_id, CAST(2 AS INTEGER) AS page_no, 'A B' AS account_name, CAST(place AS INTEGER) AS row_index, date, balance::DOUBLE AS balance FROM i LEFT JOIN l ON l.o_custkey = i.o_custkey AND 2 * l.pos - 2 = place")
def loaded_labels(spark, d):
    """A filled queue that labels every other row, read back as pages without gaps."""
    p = ingest.load_labels(_queue(spark, d))
    x = p.select("sample_id", "page_no", "page.account_name", F.posexplode("page.rows").alias("row_index", "r"))
    return x.select("sample_id", "page_no", "account_name", "row_index", "r.date", F.col("r.balance").cast("double").alias("balance"))


@query("""SELECT c_custkey AS line, CASE c_custkey % 7 WHEN 0 THEN 'sample_id is empty' WHEN 1 THEN 'page_no ''x'' is not a page number' WHEN 2 THEN 'unknown field ''color''' WHEN 3 THEN 'header field ''account_no'' must have an empty row_index' WHEN 4 THEN 'field ''debit'' needs a non-negative row_index, got ''-1''' WHEN 5 THEN 'field ''date'': ''' || c_name || ''' is not a date' END AS error FROM customer""")
def label_errors(spark, d):
    k = F.col("c_custkey") % 7
    c = t(spark, d, "customer").select(
        F.col("c_custkey").alias("line"), F.when(k == 0, "").otherwise("s").alias("sample_id"), F.when(k == 1, "x").otherwise("1").alias("page_no"),
        chosen(k, "date", "date", "color", "account_no", "debit", "date", "balance").alias("field"), chosen(k, "0", "0", "0", "1", "-1", "0", "0").alias("row_index"), F.when(k == 5, F.col("c_name")).when(k == 6, "1,000.50").otherwise("1/1/2024").alias("label"),
    )
    return ingest.checked_labels(c).select("line", "error")


# --- answers, pages, fields -------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1 - 1 / length(c_mktsegment)::DOUBLE ELSE 0.0 END AS short, CASE c_custkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1 / 3.0::DOUBLE END AS field FROM customer""")
def official_scores(spark, d):
    """Short answers by containment and likeness, and key-value replies with alternatives."""
    c, k = t(spark, d, "customer"), F.col("c_custkey") % 4
    seg = F.col("c_mktsegment")
    pred = F.when(k == 0, F.concat(S("it is "), seg)).when(k == 1, F.concat(S("The "), F.lower(seg), S("!\n"))).when(k == 2, F.concat(F.left(seg, F.length(seg) - 1), S("?"))).otherwise("-")
    truth = F.when(k == 1, F.concat(S("['none of these', '"), seg, S("']"))).otherwise(seg)
    j = F.col("c_custkey") % 3
    reply = F.when(j == 0, F.concat(S('```json\n{"name": "'), "c_name", S('", "seg": "B"}\n```'))).when(j == 1, F.concat(S("name: "), "c_name", S("\nseg: C"))).otherwise(F.concat(S("{'name': '"), "c_name", S("', 'seg': 'C', 'more': 1}")))
    want = F.concat(S('{"name": "'), "c_name", S('", "seg": ["A", "B"]}'))
    return c.select("c_custkey", official.short_answer_udf(pred, truth).alias("short"), official.field_score_udf(reply, want).alias("field"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 <> 1 THEN p_name ELSE '' END AS text, CAST(CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 2 END AS INTEGER) AS blocks, (CASE p_partkey % 3 WHEN 1 THEN p_size * 2 ELSE p_size * 4 END)::DOUBLE AS x1, CASE p_partkey % 3 WHEN 0 THEN 'truncated JSON: salvaged 2 complete blocks' END AS parse_error, CAST((p_partkey % 3 = 2)::INT AS INTEGER) AS tables FROM part""")
def layout_replies(spark, d):
    """Layout JSON that was cut off, layout lines, and a pipeline's result, with boxes in pixels of the original."""
    p, k = t(spark, d, "part"), F.col("p_partkey") % 3
    box = F.concat(S("[0, 0, "), F.col("p_size") * 2, S(", 9]"))
    a = F.concat(S('[{"bbox": '), box, S(', "category": "Text", "text": "'), "p_name", S('"}, {"bbox": [1], "category": "Picture", "text": "no"}, {"bbo'))
    b = F.concat(S("<box:0 0 "), F.col("p_size"), S(" 1><label:text><up>\n<box:1 2><label:text><up>"))
    c = F.concat(S('{"prunedResult": {"parsing_res_list": [{"block_label": "text", "block_content": "'), "p_name", S('", "block_bbox": '), box, S('}, {"block_label": "table", "block_content": "<table><tr><td>1</td></tr></table>"}]}}'))
    raw, name = F.when(k == 0, a).when(k == 1, b).otherwise(c), chosen(k, "dots_layout_json", "teleocr_layout", "paddle_layout")
    size = lambda w, h: F.array(S(w), S(h))
    page = p.select("p_partkey", "p_name", pages.parse_page(name, raw, original=size(2000, 2000), sent=size(1000, 1000)).alias("g"))
    return page.select("p_partkey", F.split("g.text", "\n")[0].alias("text"), F.size("g.blocks").alias("blocks"), F.col("g.blocks")[0]["box"]["x1"].alias("x1"), "g.parse_error", F.size("g.tables").alias("tables"))


@query("""SELECT p_partkey, CAST(p_size AS INTEGER) AS x1, CAST(least(greatest(round_even(p_size * 640 / 1000, 0), 0), 639) AS BIGINT) AS px1, CAST(CASE WHEN h * w > 11289600 THEN floor(p_size * 100 / sqrt(p_size * 100 * p_size * 90 / 11289600.0) / 28) * 28 ELSE h END AS BIGINT) AS height FROM (SELECT *, greatest(28, round_even(p_size * 100 / 28.0, 0) * 28) AS h, greatest(28, round_even(p_size * 90 / 28.0, 0) * 28) AS w FROM part)""")
def image_regions(spark, d):
    p = t(spark, d, "part")
    r = pages.region(F.concat(S("Read [9, 9, 9, 9] not; read ["), F.col("p_size"), S(", 10, 900, 1000].")))
    x = p.select("p_partkey", "p_size", r.alias("r"))
    return x.select("p_partkey", "r.x1", readers.region_pixels(F.col("r"), S(640), S(480)).x1.alias("px1"), readers.resized(F.col("p_size") * 100, F.col("p_size") * 90).height.alias("height"))


@query("""SELECT 'TOB-KIE-' || c_custkey AS sample_id, 'json' AS gt_kind, CAST(4 AS INTEGER) AS n_fields, CASE WHEN c_custkey % 2 = 0 THEN 'total,who,when' ELSE 'total,when' END AS critical FROM customer""")
def ingested_samples(spark, d):
    """Benchmark rows with fenced JSON answers to typed samples, their fields flat and the critical ones found."""
    c = t(spark, d, "customer")
    who = F.when(F.col("c_custkey") % 2 == 0, "0812-345 678").otherwise(F.col("c_mktsegment"))
    answer = F.concat(S('```json\n{"total": 5, "who": "'), who, S('", "when": "x 1/2/2024", "note": {"a": null},}\n```'))
    rows = c.select(F.col("c_custkey").alias("Id"), S("q").alias("question"), answer.alias("answer"))
    s = ingest.to_samples(rows, S("KIE"), S("kie"), S("Key information extraction"))
    return s.select("sample_id", "gt_kind", F.size("fields").alias("n_fields"), F.array_join("critical_fields", ",").alias("critical"))


@query("""SELECT c_custkey, v.condition, 'img/' || c_custkey || CASE v.condition WHEN 'clean' THEN '.png' WHEN 'photo' THEN '_photo.png' ELSE '_scan_low.jpg' END AS image_path, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 AND v.condition = 'photo' THEN 'gt/' || c_custkey || '_photo.json' ELSE 'gt/' || c_custkey || '.json' END AS gt_path FROM customer, (VALUES ('clean'), ('scan_low'), ('photo')) v(condition)""")
def manifest_conditions(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.col("c_custkey").cast("string").alias("sample_id"), S("x").alias("source"), chosen(F.col("c_custkey") % 3, "none", "text_layer", "text").alias("gt_kind"))
    return ingest.ordered_manifest(ingest.expand_conditions(c)).select("c_custkey", "condition", "image_path", "gt_path")


@query("""SELECT what, name, CAST(n AS BIGINT) AS n FROM (SELECT 'task' AS what, CASE WHEN c_custkey % 2 = 0 THEN 'statement' ELSE 'kie' END AS name, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'domain', CASE WHEN c_nationkey < 5 THEN '' ELSE c_mktsegment END, count(*) FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL
UNION ALL SELECT 'doc_type', 'digital', count(*) FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT 'text_layer_unusable', '', count(*) FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'banks', '', count(DISTINCT c_nationkey) FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT 'multipage_files', '', count(*) FROM (SELECT c_custkey // 10 AS f FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1 HAVING count(*) > 1)) WHERE n > 0 OR what = 'multipage_files'""")
def selection_counts(spark, d):
    c = t(spark, d, "customer")
    even = F.col("c_custkey") % 2 == 0
    s = c.select(F.concat(F.floor(F.col("c_custkey") / 10).cast("string"), S("-p"), F.col("c_custkey") % 10).alias("sample_id"), F.when(even, "statement").otherwise("kie").alias("task"), F.when(F.col("c_nationkey") >= 5, F.col("c_mktsegment")).alias("domain"), F.when(even, "digital").alias("doc_type"), F.col("c_nationkey").cast("string").alias("bank"), F.when(even, "text_layer").otherwise("text").alias("gt_kind"), F.when(F.col("c_custkey") % 10 == 0, "zzz").otherwise("Balance").alias("text"))
    return ingest.selection_counts(s)


@query("""WITH l AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, 'kie' AS task FROM customer WHERE c_custkey <= 50 UNION ALL SELECT '1', 'kie' UNION ALL SELECT 'zz', 'kie'), m AS (SELECT CAST(c_custkey AS VARCHAR) AS sample_id, c_custkey AS k FROM customer)
SELECT DISTINCT l.sample_id, task, CASE WHEN l.sample_id = '1' THEN 'listed twice' WHEN m.k IS NULL THEN 'not in the manifest' WHEN k % 5 = 0 THEN 'a client''s page' WHEN k % 7 = 0 THEN 'no clean row' ELSE 'another task in the manifest' END AS problem FROM l LEFT JOIN m USING (sample_id) WHERE l.sample_id = '1' OR k IS NULL OR k % 5 = 0 OR k % 7 = 0 OR k % 11 = 0
UNION ALL SELECT NULL, t, 'has 0 samples, needs ' || n FROM (VALUES ('ocr_fullpage', 20), ('ocr_line', 10), ('table', 10), ('handwriting', 10)) v(t, n)""")
def parity_problems(spark, d):
    c = t(spark, d, "customer")
    k = F.col("c_custkey")
    m = c.select(k.cast("string").alias("sample_id"), F.when(k % 5 == 0, "bankstmt").otherwise("bench").alias("source"), F.when(k % 7 == 0, "photo").otherwise("clean").alias("condition"), F.when(k % 11 == 0, "table").otherwise("kie").alias("task"))
    listed = m.where(F.col("sample_id").cast("int") <= 50).select("sample_id", S("kie").alias("task")).unionByName(spark.createDataFrame([("1", "kie"), ("zz", "kie")], "sample_id string, task string"))
    return ingest.parity_problems(listed, m)


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 'F@1-URGENT' WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS plan, CASE WHEN o_orderkey % 4 = 0 THEN 'q' WHEN o_orderkey % 4 = 1 THEN 'first' ELSE 'any' END AS bank FROM orders")
def plans_and_routes(spark, d):
    o = t(spark, d, "orders")
    path = F.concat(chosen(F.col("o_orderkey") % 4, "Q/X.pdf", "in/Ab-1.PDF", "z", "y"), S(""))
    return o.select("o_orderkey", registry.plan_of(F.col("o_orderstatus"), F.col("o_orderpriority"), {"F": {}, "O": {}, "F@1-URGENT": {}}).alias("plan"), io.route(path, [("q/*.pdf", "q"), ("*ab-?.pdf", "first"), ("*", "any")]).alias("bank"))


@query("""SELECT c_custkey, c_custkey % 3 <> 0 AS closing_required, c_custkey % 4 <> 0 AS amount_valid, c_custkey % 2 = 0 AS bank_valid, false AS extra FROM customer""")
def class_fields(spark, d):
    """A document class's rules: which fields a bank needs, and whether values pass."""
    f = (registry.Field("closing", "amount", validators=("amount", "non_empty"), required=("bank_not_in", ("b0",))), registry.Field("bank", "text", validators=("known_bank",), required=("bank_in", ("b1", "b2"))))
    doc = registry.DocumentClass("statement", "", f, banks=("b0", "b1", "b2", "HOUSEHOLD"))
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    bank = F.concat(S("b"), k % 3)
    amount = F.when(k % 4 == 0, "none").otherwise("(1,000.50)")
    named = F.when(k % 2 == 0, "b1").otherwise("B1")
    return c.select("c_custkey", doc.check(S("closing"), amount, bank).required.alias("closing_required"), doc.check(S("closing"), amount, bank).valid.alias("amount_valid"), doc.check(S("bank"), named, bank).valid.alias("bank_valid"), doc.check(S("nothing"), named, bank).isNotNull().alias("extra"))


# --- confidence -------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, CAST(CASE c_custkey % 4 WHEN 3 THEN NULL ELSE 4 END AS INTEGER) AS start, CASE c_custkey % 4 WHEN 3 THEN (-(c_custkey % 10) - 1) / 7.0::DOUBLE ELSE -(c_custkey % 10)::DOUBLE / 2 - 0.5 END AS mean_logprob, CASE WHEN c_custkey % 4 = 2 THEN NULL WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS agree FROM customer""")
def field_features(spark, d):
    """Where values stand among tokens, what their probabilities are, and whether another model agrees."""
    c, k = t(spark, d, "customer"), F.col("c_custkey")
    base = c.select("c_custkey", k.cast("string").alias("sample_id"), S("clean").alias("condition"), F.lpad(k.cast("string"), 9, "0").alias("v"))
    field = lambda m, pred, raw: base.select("c_custkey", "sample_id", "condition", S(m).alias("model"), S("no").alias("field"), S("kie").alias("task"), S(False).alias("is_critical"), pred.alias("pred"), raw.alias("pred_raw"), S(1).alias("field_exact"))
    raw = F.when(F.col("c_custkey") % 4 == 1, F.concat(F.left("v", S(3)), S(","), F.right("v", S(6)))).when(F.col("c_custkey") % 4 == 3, "none").otherwise(F.col("v"))
    mine, other = field("m", F.col("v"), raw), field("n", F.when(F.col("c_custkey") % 4 != 2, F.when(F.col("c_custkey") % 5 == 0, "x").otherwise(F.col("v"))), F.col("v"))
    lp = -(F.col("c_custkey") % 10).cast("double")
    p = base.select("sample_id", "condition", S("m").alias("model"), F.array(S("{"), S('"no":'), S(" "), S('"'), F.left("v", S(5)), F.right("v", S(4)), S('"}')).alias("tokens"), F.array(S(0.0), S(0.0), S(0.0), S(0.0), lp, S(-1.0), S(0.0)).alias("token_logprobs"))
    r = confidence.field_records(mine.unionByName(other).drop("c_custkey"), p).where("model = 'm'")
    # The records keep no span; it is looked at here.
    s = mine.join(p, ["sample_id", "condition", "model"]).select("sample_id", "c_custkey", confidence.span_of("tokens", "pred_raw").start.alias("start"), "token_logprobs")
    return r.join(s, "sample_id").select("c_custkey", "start", "mean_logprob", "agree")


def _confs(spark, d):
    return t(spark, d, "labels").select("doc_id", "quality", ((F.col("doc_id") * 37 % 97) / 100.0).alias("conf"), (F.col("doc_id") % 2).alias("model"))


@query("""WITH c AS (SELECT quality, (doc_id * 37 % 97) / 100.0::DOUBLE AS conf, doc_id % 2 AS model FROM labels), e AS (SELECT * FROM (VALUES (5, 0.98, 1.0), (4, 0.90, 0.98), (3, 0.75, 0.90), (2, 0.50, 0.75), (1, 0.0, 0.50)) v(band, lo, hi)), m AS (SELECT DISTINCT model FROM c)
SELECT m.model, CAST(band AS INTEGER) AS band, lo::DOUBLE AS lo, hi::DOUBLE AS hi, CAST(count(c.conf) AS BIGINT) AS n, round(avg(c.quality), 6) AS accuracy FROM m CROSS JOIN e LEFT JOIN c ON c.model = m.model AND c.conf >= lo AND c.conf < hi GROUP BY ALL""")
def confidence_tables(spark, d):
    """Accuracy by band, empty ones included, with intervals (not compared)."""
    b = calibration.bands(_confs(spark, d), "conf", "quality", "doc_id", ["model"], resamples=50)
    return b.select("model", "band", "lo", "hi", "n", r6("accuracy").alias("accuracy"))


@query("""WITH c AS (SELECT quality, (doc_id * 37 % 97) / 100.0::DOUBLE AS conf, doc_id % 2 AS model FROM labels), g AS (SELECT model, conf, count(*) AS n, sum(quality) AS s FROM c GROUP BY ALL), a AS (SELECT model, conf, sum(s) OVER u / sum(n) OVER u AS above, sum(s) OVER w / sum(n) OVER w AS below FROM g WINDOW u AS (PARTITION BY model ORDER BY conf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), w AS (PARTITION BY model ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT model, min(conf) FILTER (above >= 0.8) AS t_accept FROM a GROUP BY model), y AS (SELECT a.model, t_accept, max(conf) FILTER (below <= 0.75 AND conf <= coalesce(t_accept, 1.0)) AS t_reject FROM a JOIN x USING (model) GROUP BY ALL),
z AS (SELECT c.*, t_accept, t_reject, coalesce(conf >= t_accept, false) AS ac, coalesce(conf < t_reject, false) AS re FROM c JOIN y USING (model))
SELECT model, t_accept, t_reject, round(avg(ac::INT), 6) AS accept_share, round(avg(re::INT), 6) AS reject_share, round(avg((NOT ac AND NOT re)::INT), 6) AS review_share, round(avg(quality) FILTER (ac), 6) AS accept_accuracy, round(avg(quality) FILTER (re), 6) AS reject_accuracy FROM z GROUP BY model, t_accept, t_reject""")
def confidence_buckets(spark, d):
    c = _confs(spark, d)
    found = calibration.thresholds(c, "conf", "quality", ["model"], 0.8, 0.75)
    b = calibration.buckets(c, found, "conf", "quality", ["model"])
    return b.select("model", "t_accept", "t_reject", *(r6(x).alias(x) for x in ("accept_share", "reject_share", "review_share", "accept_accuracy", "reject_accuracy")))


# --- readers and serving ----------------------------------------------------------------------------------------------


def _readings(spark, d):
    p = t(spark, d, "part")
    lines = p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 2 == 0, "statement").otherwise("tob").alias("source"), F.col("p_brand").alias("bank"), S("clean").alias("condition"), F.when(F.col("p_partkey") % 4 == 0, F.col("p_retailprice").cast("decimal(12,2)").cast("string")).otherwise(F.col("p_name")).alias("gt"), F.col("p_size").alias("crop_width"), S(10).alias("crop_height"))
    a = lines.select(S("a").alias("reader"), "id", S(1).alias("seq"), F.replace("gt", S("e"), S("")).alias("text"), F.lit(None).cast("string").alias("error"))
    b = lines.where("id % 7 <> 0").select(S("b").alias("reader"), "id", S(1).alias("seq"), F.concat("gt", S("x")).alias("text"), F.lit(None).cast("string").alias("error"))
    retry = b.where("id % 3 = 0").withColumns({"seq": S(2), "text": S("zz"), "error": S("timeout")})
    return lines, readers.latest_readings(a.union(b).union(retry))


_READ_SQL = """l AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'statement' ELSE 'tob' END AS source, p_brand AS bank, CASE WHEN p_partkey % 4 = 0 THEN CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) ELSE p_name END AS gt, p_size / 10.0 AS a FROM part WHERE p_partkey % 7 <> 0),
r AS (SELECT 'a' AS reader, id, replace(gt, 'e', '') AS p FROM l UNION ALL SELECT 'b', id, gt || 'x' FROM l), j AS (SELECT r.reader, l.*, trim(regexp_replace(p, ' +', ' ', 'g')) AS p FROM r JOIN l USING (id)),
s AS (SELECT *, levenshtein(p, gt) AS e, levenshtein(replace(p, ' ', ''), replace(gt, ' ', '')) AS en, replace(gt, ' ', '') AS gn FROM j)"""


@query("WITH " + _READ_SQL + """, g AS (SELECT s.*, u."group" FROM s, LATERAL (VALUES ('all'), (source), (CASE WHEN source = 'statement' THEN 'statement_' || CASE WHEN regexp_full_match(gt, '[0-9,.\\-+/: ]*[0-9][0-9,.\\-+/: ]*') THEN 'numeric' ELSE 'text' END END), (CASE WHEN source = 'statement' THEN 'statement_aspect_' || CASE WHEN a < 2 THEN 'lt2' WHEN a < 4 THEN '2to4' WHEN a <= 6.05 THEN '4to6' ELSE 'gt6' END END), (CASE WHEN source = 'statement' THEN 'statement_bank_' || bank END)) u("group") WHERE u."group" IS NOT NULL)
SELECT reader, "group", CAST(count(*) AS BIGINT) AS n, round(avg(least(1.0, e / greatest(1, length(gt))::DOUBLE)), 6) AS cer_mean, round(sum(e) / greatest(1, sum(length(gt)))::DOUBLE, 6) AS cer_micro, round(avg(least(1.0, en / greatest(1, length(gn))::DOUBLE)), 6) AS cer_nospace_mean, round(avg((e = 0)::INT), 6) AS exact FROM g GROUP BY ALL""")
def reader_report(spark, d):
    """Readers compared on the lines that all have read, by overlapping groups."""
    r = readers.report(*_readings(spark, d), digits=9)
    return r.select("reader", "group", "n", *(r6(c).alias(c) for c in ("cer_mean", "cer_micro", "cer_nospace_mean", "exact")))


@query("WITH " + _READ_SQL + ", w AS (SELECT a.id, a.gt, least(1.0, a.e / greatest(1, length(a.gt))::DOUBLE) AS ca, least(1.0, b.e / greatest(1, length(b.gt))::DOUBLE) AS cb FROM s a JOIN s b USING (id) WHERE a.reader = 'a' AND b.reader = 'b') SELECT CAST(count(*) AS BIGINT) AS lines_differ, CAST(count(*) FILTER (ca < cb) AS BIGINT) AS a_better, CAST(count(*) FILTER (cb < ca) AS BIGINT) AS b_better, CAST(count(*) FILTER (regexp_full_match(gt, '[0-9.]+')) AS BIGINT) AS numeric_lines_differ FROM w")
def head_to_head(spark, d):
    return readers.head_to_head(*_readings(spark, d), "a", "b")


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (event_id % 9 = 0) AS BIGINT) AS errors, CAST(count(*) FILTER (event_id % 9 <> 0 AND event_id % 4 = 0) AS BIGINT) AS loop_pages, round(quantile_cont(value / 1000, 0.5) FILTER (event_id % 9 <> 0 AND event_id % 4 <> 0), 1) AS p50, round(quantile_cont(value / 1000, 0.95) FILTER (event_id % 9 <> 0), 1) AS all_p95 FROM events GROUP BY event_type""")
def page_latencies(spark, d):
    e = t(spark, d, "events").select("event_type", F.when(F.col("event_id") % 9 == 0, "x").alias("error"), F.when(F.col("event_id") % 4 == 0, F.array(S("a"), S("b"), S("c"))).otherwise(F.array(S("a"))).alias("tokens"), "value")
    r = serving.page_latency(e, ["event_type"], "error", "tokens", "value", 3, digits=None)
    return r.select("event_type", "pages", "errors", "loop_pages", F.round("page_p50_s", 1).alias("p50"), F.round("all_p95_s", 1).alias("all_p95"))


@query("""SELECT event_type, CAST(count(*) FILTER (event_id % 5 <> 0) AS BIGINT) AS n, round_even(quantile_cont(value, 0.5) FILTER (event_id % 5 <> 0), 1) AS p50, round_even(quantile_cont(value, 0.95) FILTER (event_id % 5 <> 0), 1) AS p95 FROM events GROUP BY event_type""")
def cold_starts(spark, d):
    e = t(spark, d, "events").select("event_type", "value", F.when(F.col("event_id") % 5 == 0, F.array(S("x"))).otherwise(F.array().cast("array<string>")).alias("failures"))
    return serving.cold_starts(e, ["event_type"], "value", "failures")


@query("""SELECT event_type, CAST(4 AS INTEGER) AS concurrency, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(value, 0.99), 6) AS p99, round(3600 * 4 / avg(value), 6) AS pages_per_hour, round(1000 / (3600 * 4 / avg(value)) * 0.69, 6) AS cost_per_1000 FROM events GROUP BY event_type""")
def throughput_table(spark, d):
    e = t(spark, d, "events").withColumn("concurrency", S(4))
    r = serving.throughput(e, ["event_type"], "value", "concurrency", 0.69)
    return r.select("event_type", "concurrency", "n", *(r6(c).alias(c) for c in ("p99", "pages_per_hour", "cost_per_1000")))


@query("""SELECT CAST(count(*) AS BIGINT) AS n, round(median(0.02 * (l_linenumber - 1)), 6) AS cer_median, median(0.02 * (l_linenumber - 1)) <= 0.01 AND quantile_cont(0.02 * (l_linenumber - 1), 0.95) <= 0.05 AND abs(avg(l_discount) - avg(l_tax)) <= 0.01 AS passed FROM lineitem""")
def serving_gate(spark, d):
    x = t(spark, d, "lineitem").select((0.02 * (F.col("l_linenumber") - 1)).alias("cer"), *(F.lit(None).cast("string").alias(c) for c in ("a_error", "b_error")), F.col("l_discount").alias("a_score"), F.col("l_tax").alias("b_score"))
    return serving.serving_parity(x).select("n", r6("cer_median").alias("cer_median"), "passed")


# --- reconciling, verifying, asking, laying out -----------------------------------------------------------------------


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'abc' WHEN 1 THEN '12,500.00' WHEN 2 THEN 'def' WHEN 3 THEN 'xyz' WHEN 4 THEN 'line' ELSE 'line' END AS text, c_custkey % 6 = 5 AS disputed, c_custkey % 6 = 4 AS single_source, CASE WHEN c_custkey % 6 = 5 THEN 'lay,third' ELSE '' END AS alt FROM customer""")
def reconciled_segments(spark, d):
    k = F.col("c_custkey") % 6
    s = t(spark, d, "customer").select(
        "c_custkey", S("d").alias("doc_id"), F.col("c_custkey").alias("segment_id"), chosen(k, "abc", "12,500.00", "def", "q", "lay", "lay").alias("layout"), chosen(k, "abc", "12,5O0.00", "deg", "xyz", "line", "line").alias("line"),
        F.when(k == 2, "def").when(k == 3, "xyz").when(k == 5, "third").alias("third"), F.when(k == 1, "amount").otherwise("other").alias("kind"), (k == 4).alias("truncated"),
    )
    r = assess.reconcile(s)
    return r.select(F.col("segment_id").alias("c_custkey"), "text", "disputed", "single_source", F.array_join(F.array_sort("alt"), ",").alias("alt"))


@query("""SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'found' WHEN 1 THEN 'recovered' WHEN 2 THEN 'unverified' WHEN 3 THEN 'absent' WHEN 4 THEN 'not_required' ELSE 'unverified' END AS state, CASE c_custkey % 6 WHEN 0 THEN 'v' WHEN 1 THEN '45,210.00' END AS value, CASE WHEN c_custkey % 6 = 5 THEN 'max_vlm_calls' END AS stop FROM customer""")
def field_states(spark, d):
    k = F.col("c_custkey") % 6
    c = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), k.alias("k"))
    f = c.select("doc_id", S("closing_balance").alias("name"), S(2).alias("position"), S("amount").alias("kind"), (F.col("k") != 4).alias("required"), F.when(F.col("k") == 0, "v").alias("value"), F.when(F.col("k") == 0, True).alias("valid"))
    try_ = lambda region, text_, model, line, ok: F.struct(S(region).alias("region"), text_.alias("has_text"), model.alias("model"), line.alias("line"), S(ok).alias("valid"), S(True).alias("consistent"))
    kk = F.col("k")
    good, odd = F.when(kk.isin(1, 5), "45210").otherwise("45,21O.00"), S("45,210.00")
    a = long(c.where("k <> 0"), ["doc_id", "k"], try_("page", kk != 3, odd, good, True), try_("region_hint", kk == 5, S("1"), S("2"), True), try_("label_block", S(False), S("1"), S("1"), True))
    a = a.withColumn("name", S("closing_balance"))
    return assess.field_states(f, a.drop("k"), 3, 1).select(F.col("doc_id").cast("long").alias("c_custkey"), "state", "value", "stop")


@query("WITH " + _ORDERS_SQL + """ SELECT o_custkey, coalesce(sum(price) FILTER (NOT out AND date >= '1995-01-01' AND date < '1996-01-01'), 0)::DOUBLE AS deposits, CAST(count(*) FILTER (NOT out AND date >= '1995-01-01' AND date < '1996-01-01') AS BIGINT) AS n, arg_max(balance, pos) FILTER (date <= '1995-06-30')::DOUBLE AS midyear FROM l GROUP BY o_custkey""")
def statement_questions(spark, d):
    """Total deposits of a year with the rows they rest on, and the balance on a day."""
    r = _orders(spark, d).select("o_custkey", "date", "pos", "balance", F.col("o_orderkey").alias("row_id"), F.when(~F.col("out"), F.col("price")).alias("credit"))
    total = assess.table_query(r, ["o_custkey"], F.col("credit").isNotNull() & F.col("date").between("1995-01-01", "1995-12-31"), "credit")
    day = assess.balance_on(r, ["o_custkey"], S("1995-06-30"))
    return total.join(day, "o_custkey").select("o_custkey", F.col("answer").cast("double").alias("deposits"), "n", F.col("balance").cast("double").alias("midyear"))


def _blocks(spark, d, shift):
    x = t(spark, d, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")).alias("n"))
    y = F.col("n") * 20.0
    at = F.when((F.col("n") <= 2) & S(shift > 0), 3 - F.col("n")).otherwise(F.col("n"))
    wide = F.when((F.col("l_orderkey") + F.col("n")) % 5 == 0, S(10.0 - shift)).otherwise(S(10.0))
    return x.select("l_orderkey", at.cast("int").alias("at"), S("text").alias("category"), F.struct(S(0.0).alias("x0"), y.alias("y0"), wide.alias("x1"), (y + 10).alias("y1")).alias("box"))


@query("""WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem), b AS (SELECT *, (l_orderkey + n) % 5 <> 0 AS hit FROM r), g AS (SELECT l_orderkey, sum(hit::INT) AS tp, count(*) AS n, coalesce(bool_and(hit) FILTER (n <= 2) AND count(*) FILTER (n <= 2) = 2, false) AS swapped FROM b GROUP BY l_orderkey)
SELECT l_orderkey, round(tp / n::DOUBLE, 6) AS f1, CASE WHEN tp = 0 THEN NULL WHEN tp < 2 THEN 1.0 ELSE round(1 - 2.0 * swapped::INT / (tp * (tp - 1)), 6) END AS tau FROM g""")
def layout_scores(spark, d):
    """Blocks of which some are too narrow to match, the first two read in the wrong order."""
    pred, gt = _blocks(spark, d, 7.0), _blocks(spark, d, 0.0)
    f1 = assess.layout_f1(pred, gt, ["l_orderkey"])
    tau = assess.reading_order(assess.layout_matches(pred, gt, ["l_orderkey"]), ["l_orderkey"])
    return f1.join(tau, "l_orderkey", "left").select("l_orderkey", r6("f1").alias("f1"), r6("tau").alias("tau"))


@query("""WITH a AS (SELECT event_type AS metric, avg(value) FILTER (event_id % 2 = 0) AS x, avg(value) FILTER (event_id % 2 = 1) AS y FROM events GROUP BY event_type) SELECT q.question, q.metric, CASE WHEN there THEN round(x, 6) END AS x, CASE WHEN there THEN round(y, 6) END AS y, CASE WHEN NOT there THEN 'not benchmarked - no latency' WHEN x IS NULL AND y IS NULL THEN 'not benchmarked - no rows' ELSE '' END AS note FROM (VALUES ('Q1', 'click', true), ('Q2', 'view', true), ('Q8', 'purchase', false), ('Q9', 'nothing', true)) q(question, metric, there) LEFT JOIN a USING (metric)""")
def scorecard(spark, d):
    e = t(spark, d, "events").select(S("model").alias("table"), F.col("event_type").alias("metric"), F.when(F.col("event_id") % 2 == 0, "x").otherwise("y").alias("model"), "value")
    agg = e.groupBy("table", "metric", "model").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
    lines = [("Q1", "click", "model", "scores"), ("Q2", "view", "model", "scores"), ("Q8", "purchase", "model", "latency"), ("Q9", "nothing", "model", "scores")]
    s = assess.scorecard(lines, agg, ["x", "y"], {"scores"})
    return s.select("question", "metric", r6("x").alias("x"), r6("y").alias("y"), F.coalesce("note", S("")).alias("note"))


@query("""SELECT c_custkey, '[NAME]' AS name, repeat('*', greatest(length(regexp_replace(c_phone, '[^0-9]', '', 'g')) - 4, 0)) || right(regexp_replace(c_phone, '[^0-9]', '', 'g'), 4) AS account, c_mktsegment AS other, c_custkey % 100 < 50 AS low FROM (SELECT *, CAST(c_custkey AS VARCHAR) || '-99-1234' AS c_phone FROM customer)""")
def masked_samples(spark, d):
    c = t(spark, d, "customer").withColumn("acct", F.concat(F.col("c_custkey").cast("string"), S("-99-1234")))
    x = c.select("c_custkey", assess.masked(S("account_name"), F.col("c_name")).alias("name"), assess.masked(S("account_no"), F.col("acct")).alias("account"), assess.masked(S("segment"), F.col("c_mktsegment")).alias("other"), "acct")
    f = x.select("*", S("account_no").alias("field"), F.col("acct").alias("value"), F.col("acct").alias("raw"), S(1).alias("box"), ((F.col("c_custkey") % 100) / 100.0).alias("confidence"), F.lit(None).cast("array<string>").alias("error_flags"))
    s = assess.samples(f, 0.5)
    return s.select("c_custkey", "name", "account", "other", F.coalesce(F.array_contains("error_flags", "low_confidence"), S(False)).alias("low"))


@query("""SELECT p_partkey, CAST(2 + (p_size > 6)::INT AS INTEGER) AS kept, CAST(CASE WHEN p_size > 8 THEN 2 ELSE 1 END AS INTEGER) AS segments FROM part""")
def line_segments(spark, d):
    """Words without those in vertical columns, cut where gaps are wide."""
    p = joins.spread(t(spark, d, "part"), "p_partkey")
    w = lambda s, x0, y0, x1, y1: F.struct(S(s).alias("text"), *(F.lit(v).cast("double").alias(n) if not hasattr(v, "cast") else v.cast("double").alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))))
    far = 24 + F.col("p_size")
    words = F.array(w("aa", 0, 0, 10, 10), w("bb", 14, 0, 24, 10), w("vert", 500, 0, 504, 60), w("x", 500, 70, 504, 72))
    words = F.when(F.col("p_size") > 6, F.concat(words, F.array(w("cc", far, 0, far + 10, 10)))).otherwise(words)
    k = p.select("p_partkey", readers.outside_vertical(words).alias("ws"))
    # Gaps of up to 0.8 line heights don't cut.
    return k.select("p_partkey", F.size("ws").alias("kept"), F.size(readers.segments_udf("ws")).alias("segments"))


@query("""SELECT o_custkey, CAST(sum(length(o_orderpriority) + 3) AS BIGINT) AS prompt_tokens, CAST(count(*) * 2 AS INTEGER) AS n_tokens, CAST(count(*) AS INTEGER) AS n_requests, (max(o_orderkey) - min(o_orderkey) + 1) * 1000.0::DOUBLE AS latency_ms FROM orders GROUP BY o_custkey""")
def call_totals(spark, d):
    o = t(spark, d, "orders")
    call = F.struct("o_orderkey", F.array(S("a"), S("b")).alias("tokens"), F.array(S(-1.0), S(0.0)).alias("token_logprobs"), F.col("o_orderkey").cast("double").alias("started"), (F.col("o_orderkey") + 1).cast("double").alias("ended"), (F.length("o_orderpriority") + 3).alias("prompt_tokens"), S(1).alias("completion_tokens"))
    c = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(call)).alias("calls")).select("o_custkey", readers.call_totals(F.col("calls")).alias("t"))
    return c.select("o_custkey", "t.prompt_tokens", F.size("t.tokens").alias("n_tokens"), "t.n_requests", "t.latency_ms")


@query("SELECT c_custkey FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 2 = 0)")
def stale_artifacts(spark, d):
    """Documents whose artifact is missing, or was made from other input."""
    c = t(spark, d, "customer").select("c_custkey", io.content_hash(F.col("c_name")).alias("h"))
    made = c.where("c_custkey % 3 = 0").withColumn("h", F.when(F.col("c_custkey") % 2 == 0, F.col("h")).otherwise("old"))
    return io.stale(c, made, ["c_custkey"], "h").select("c_custkey")


@query("""WITH s AS (SELECT source, CASE WHEN quality = 0 THEN 'zero' ELSE 'one' END AS bin, count(*) AS size FROM labels JOIN documents USING (doc_id) GROUP BY ALL), p AS (SELECT *, sum(size) OVER (PARTITION BY source) AS total, count(*) OVER (PARTITION BY source) AS kinds FROM s), e AS (SELECT *, least(24, total) AS n, least(24, total) * size // total AS whole, least(24, total) * size % total AS rest FROM p),
q AS (SELECT *, greatest(1, whole) AS q0 FROM e), r AS (SELECT *, n - sum(q0) OVER (PARTITION BY source) AS lack, row_number() OVER (PARTITION BY source ORDER BY rest DESC, bin) AS rk, row_number() OVER (PARTITION BY source ORDER BY q0 DESC, bin DESC) AS top FROM q)
SELECT source, bin, CAST(size AS BIGINT) AS size, CAST(q0 + CASE WHEN lack > 0 AND rk <= lack THEN 1 WHEN lack < 0 AND top <= -lack THEN -1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def fixture_quotas(spark, d):
    rows = t(spark, d, "labels").join(t(spark, d, "documents"), "doc_id").select("source", F.col("quality").cast("double").alias("score"))
    return sampling.bin_quotas(rows, "score", ["source"], 24)


@query("""SELECT p_partkey, p_name || ' ' || p_brand AS grounding, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p_name || ' | ' || p_brand || ' |' AS markdown FROM part""")
def reply_texts(spark, d):
    p = t(spark, d, "part")
    g = F.concat(S('[{"bbox": [], "text": "'), "p_name", S('"}, {"text": "'), "p_brand")
    blocks = F.array(F.struct(S("table").alias("type"), F.concat(S("<table><tr><th>a</th><th>b</th></tr><tr><td>"), "p_name", S("</td><td>"), "p_brand", S("</td></tr></table>")).alias("text")), F.struct(S("footer").alias("type"), S("9").alias("text")))
    return p.select("p_partkey", pages.grounding_text_udf(g).alias("grounding"), pages.page_markdown_udf(blocks).alias("markdown"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal + 0.5 <= -500 OR c_acctbal >= 9000 THEN NULL WHEN least(c_acctbal + 0.5, 3000.0) - greatest(c_acctbal, -500.0) >= least(c_acctbal + 0.5, 9000.0) - greatest(c_acctbal, 3000.0) THEN 'low' ELSE 'mid' END AS band FROM customer""")
def balance_ranges(spark, d):
    """Rows matched to a table of ranges by cells, not by comparing all pairs."""
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_acctbal") + 0.5).alias("high"))
    bands = spark.range(1).select(F.explode(F.array(*(F.struct(S(b).alias("band"), S(lo).alias("s"), S(hi).alias("e")) for b, lo, hi in (("low", -500.0, 3000.0), ("mid", 3000.0, 9000.0))))).alias("b")).select("b.*")
    return joins.range_match(rows, bands, "c_acctbal", "high", "band", "s", "e", 1000.0, "c_custkey").select("c_custkey", "band")


@query("""SELECT l_returnflag, max(CASE WHEN l_linestatus = 'F' THEN lv END) AS "F", coalesce(max(CASE WHEN l_linestatus = 'O' THEN lv END), 'no') AS "O" FROM (SELECT l_returnflag, l_linestatus, CASE WHEN bool_and(l_quantity > 25) THEN 'yes' WHEN bool_or(l_quantity > 25) THEN 'partial' ELSE 'no' END AS lv FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def probe_matrix(spark, d):
    rows = t(spark, d, "lineitem").withColumn("ok", F.col("l_quantity") > 25)
    return serving.matrix(rows, "l_returnflag", "l_linestatus", "ok", ["F", "O"])


@query("""SELECT o_orderkey, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR) || '|clean'), 1, 8) AS BIGINT) AS seed, strftime(o_orderdate + INTERVAL 12 MONTH, '%Y-%m-%d') AS expires, least((o_custkey % 100) * 2.0 + 5, 150.0)::DOUBLE AS x1, least((o_custkey % 100)::DOUBLE, 60.0) AS cut, (o_custkey % 100) * 200 / 72.0::DOUBLE AS scaled, CASE WHEN (o_custkey % 100) / 10.0 < 2 THEN 'lt2' WHEN (o_custkey % 100) / 10.0 < 4 THEN '2to4' WHEN (o_custkey % 100) / 10.0 <= 6.05 THEN '4to6' ELSE 'gt6' END AS aspect FROM orders""")
def page_geometry(spark, d):
    """Seeds by sample and condition, ends of reviews, boxes mapped by a homography and cut to the page, words in pixels."""
    o, x = t(spark, d, "orders"), (F.col("o_custkey") % 100).cast("double")
    box = F.struct(S(0.0).alias("x0"), S(0.0).alias("y0"), x.alias("x1"), S(9.0).alias("y1"))
    h = F.array(*(F.array(*map(S, row)) for row in ((2.0, 0.0, 5.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))))
    words = F.array(F.struct(S("w").alias("text"), *(c.alias(n) for n, c in (("x0", S(0.0)), ("y0", S(0.0)), ("x1", x), ("y1", S(1.0))))))
    return o.select(
        "o_orderkey", sampling.seed_of("o_orderkey", F.lit("clean")).alias("seed"), F.date_format(readers.expires_on(F.col("o_orderdate")), "yyyy-MM-dd").alias("expires"), readers.warped(box, h, S(150), S(100)).x1.alias("x1"),
        readers.clipped(box, S(60), S(100)).x1.alias("cut"), pages.scale_words(words, S(200))[0].x1.alias("scaled"), readers.aspect_bucket(x, S(10)).alias("aspect"),
    )
