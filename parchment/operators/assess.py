"""What a run amounts to: reconciled segments, field states, questions over transactions, layout scores, scorecards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fields as typed


def reconcile(segments: DataFrame, kinds: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, segment_id, text, sources, disputed, alt, single_source) of segments with texts layout, line and third (a
    reading that was asked for, or null), kind and truncated.

    Equal texts agree. Else, of two candidates of which one alone passes the kind's validator, that one wins; else two of
    three; else the line reader's text stays, disputed, with the others as alternatives. Truncated layout text has no vote."""
    checks = kinds or {"amount": "amount", "date": "date", "account": "account_number"}

    def passes(c: str) -> Column:
        out = F.lit(None).cast("boolean")
        for kind, rule in checks.items():
            out = F.when(F.col("kind") == kind, typed.valid(F.col(c), rule)).otherwise(out)
        return out

    s = segments.withColumns({"_a": F.col("layout"), "_b": F.col("line"), "_c": F.col("third"), "_va": passes("layout"), "_vb": passes("line")})
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    alone = F.coalesce(F.col("truncated"), F.lit(False)) | a.isNull()
    only_a, only_b = F.col("_va") & ~F.col("_vb"), F.col("_vb") & ~F.col("_va")
    how = (
        F.when(alone, "single_source").when(a == b, "agree").when(F.coalesce(only_a, F.lit(False)), "layout").when(F.coalesce(only_b, F.lit(False)), "line")
        .when(c == a, "layout_third").when(c == b, "line_third").otherwise("disputed")
    )
    s = s.withColumn("_how", how)
    text = F.when(F.col("_how").isin("layout", "layout_third"), a).otherwise(b)
    named = {"single_source": ("line",), "agree": ("layout", "line"), "layout": ("layout",), "line": ("line",), "layout_third": ("layout", "third"), "line_third": ("line", "third"), "disputed": ("line",)}
    sources = F.lit(None).cast("array<string>")
    for k, names in named.items():
        sources = F.when(F.col("_how") == k, F.array(*map(F.lit, names))).otherwise(sources)
    others = F.array_except(F.array_compact(F.array(a, c)), F.array(b))
    disputed = F.col("_how") == "disputed"
    return s.select("doc_id", "segment_id", text.alias("text"), sources.alias("sources"), disputed.alias("disputed"), F.when(disputed, others).otherwise(F.array().cast("array<string>")).alias("alt"), (F.col("_how") == "single_source").alias("single_source"))


#: Where a field is looked for, one region a retry.
LADDER = ("region_hint", "label_block", "page")


def field_states(fields: DataFrame, attempts: DataFrame, max_retries: int = 3, max_calls: int = 12) -> DataFrame:
    """(doc_id, name, state, value, stop) of a class's fields.

    fields: doc_id, name, position, kind, required, value, valid. attempts: doc_id, name, region, has_text, model, line
    (readings of the crop), valid, consistent (the cross-field rules hold with the value). A required field without a valid
    value takes its attempts in the ladder's order, at most max_retries; those of a document, in the order of its fields,
    stop before the call that would be one too many. A crop without text costs no call. A value is recovered if both readings
    agree as typed values and all rules hold; one reader's alone, or one that breaks a rule, leaves the field unverified;
    a field whose every region was empty is absent. stop names the limit that ended a field's search, or null."""
    todo = fields.where(F.col("required") & ~F.coalesce(F.col("valid"), F.lit(False)))
    rank = F.array_position(F.array(*map(F.lit, LADDER)), F.col("region"))
    a = attempts.withColumnRenamed("valid", "ok").join(todo.select("doc_id", "name", "position", "kind"), ["doc_id", "name"])
    a = a.withColumn("at", F.row_number().over(Window.partitionBy("doc_id", "name").orderBy(rank)))
    same = typed.normalize_field(F.col("kind"), F.col("model")).value == typed.normalize_field(F.col("kind"), F.col("line")).value
    a = a.withColumn("good", F.col("has_text") & F.coalesce(same & F.col("ok") & F.col("consistent"), F.lit(False)))
    mine = Window.partitionBy("doc_id", "name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    a = a.withColumn("before", F.coalesce(F.max(F.col("good").cast("int")).over(mine), F.lit(0)) == 0)
    a = a.withColumn("within", F.col("at") <= max_retries).withColumn("live", F.col("before") & F.col("within"))
    used = F.sum((F.col("live") & F.col("has_text")).cast("int")).over(Window.partitionBy("doc_id").orderBy("position", "at"))
    a = a.withColumn("paid", ~F.col("has_text") | (used <= max_calls)).withColumn("run", F.col("live") & F.col("paid"))
    per = a.groupBy("doc_id", "name").agg(
        F.max(F.when(F.col("run") & F.col("good"), F.col("model"))).alias("won"), F.count_if(F.col("run") & F.col("has_text")).alias("seen"), F.count_if("run").alias("tries"),
        F.bool_or(F.col("live") & ~F.col("paid")).alias("broke"), F.bool_or(F.col("before") & ~F.col("within")).alias("tired"),
    )
    j = fields.join(per, ["doc_id", "name"], "left")
    lost = F.col("won").isNull()
    state = (
        F.when(~F.col("required"), "not_required").when(F.coalesce(F.col("valid"), F.lit(False)), "found").when(~lost, "recovered")
        .when((F.coalesce("tries", F.lit(0)) > 0) & (F.col("seen") == 0) & ~F.coalesce("broke", F.lit(False)) & F.col("value").isNull(), "absent").otherwise("unverified")
    )
    value = F.when(state == "found", F.col("value")).when(state == "recovered", F.col("won"))
    stop = F.when(lost & F.col("broke"), "max_vlm_calls").when(lost & F.col("tired"), "max_retries")
    return j.select("doc_id", "name", state.alias("state"), value.alias("value"), stop.alias("stop"))


# --- questions over transactions --------------------------------------------------------------------------------------


def table_query(rows: DataFrame, keys: list[str], where: Column, measure: str, how: str = "sum") -> DataFrame:
    """(keys, answer, n, row_ids): sum, count, min, max or avg of a typed column over the transactions that a condition
    takes, in exact decimals, with the rows it rests on (row_id). Keys whose rows none fits have n 0."""
    m = F.when(where, F.col(measure).cast("decimal(20,4)"))
    made = {"sum": F.coalesce(F.sum(m), F.lit(0).cast("decimal(20,4)")), "count": F.count_if(where), "min": F.min(m), "max": F.max(m), "avg": F.avg(m)}[how]
    return rows.groupBy(*keys).agg(made.alias("answer"), F.count_if(where).alias("n"), F.sort_array(F.collect_list(F.when(where & m.isNotNull() if how != "count" else where, F.col("row_id")))).alias("row_ids"))


def balance_on(rows: DataFrame, keys: list[str], day: Column) -> DataFrame:
    """(keys, balance, row_id): the printed balance of the last transaction on or before a day (ISO text)."""
    known = F.when((F.col("date") <= day) & F.col("balance").isNotNull(), F.struct("date", "pos", "balance", "row_id"))
    return rows.groupBy(*keys).agg(F.max(known).alias("m")).select(*keys, F.col("m.balance").alias("balance"), F.col("m.row_id").alias("row_id"))


def compute(op: str, a: Column, b: Column) -> Column:
    """Exact decimal arithmetic over two cited values: add, subtract, multiply, divide; null for division by zero, and an
    error for anything else."""
    x, y = a.cast("decimal(20,4)"), b.cast("decimal(20,4)")
    made = {"add": x + y, "subtract": x - y, "multiply": x * y, "divide": F.try_divide(x, y)}
    if op not in made:
        raise ValueError(f"no such operation: {op}")
    return made[op]


# --- layout -----------------------------------------------------------------------------------------------------------


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 for empty ones."""
    width = F.greatest(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.lit(0.0))
    height = F.greatest(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0), F.lit(0.0))
    area = lambda r: (r.x1 - r.x0) * (r.y1 - r.y0)
    return F.coalesce(F.try_divide(width * height, area(a) + area(b) - width * height), F.lit(0.0))


def layout_matches(pred: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, pred_at, gt_at, iou) of blocks (keys, at, category, box) of one page and category with an overlap of at least
    `least`, each block in one pair at most: a pair stays if it is the best of both its blocks, ties by place."""
    p = pred.select(*keys, F.col("at").alias("pred_at"), "category", F.col("box").alias("_p"))
    g = truth.select(*keys, F.col("at").alias("gt_at"), "category", F.col("box").alias("_g"))
    j = p.join(g, [*keys, "category"]).withColumn("iou", overlap(F.col("_p"), F.col("_g"))).where(F.col("iou") >= least)
    best = lambda side, other: F.row_number().over(Window.partitionBy(*keys, side).orderBy(F.desc("iou"), other)) == 1
    return j.withColumns({"_a": best("pred_at", "gt_at"), "_b": best("gt_at", "pred_at")}).where("_a and _b").select(*keys, "pred_at", "gt_at", "iou")


def layout_f1(pred: DataFrame, truth: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """(keys, tp, n_pred, n_gt, f1): micro F1 of matched blocks; pages without blocks on either side have 1."""
    m = layout_matches(pred, truth, keys, least).select(*keys, F.lit(0).alias("p"), F.lit(0).alias("g"), F.lit(1).alias("t"))
    tag = lambda df, p, g: df.select(*keys, F.lit(p).alias("p"), F.lit(g).alias("g"), F.lit(0).alias("t"))
    c = m.unionByName(tag(pred, 1, 0)).unionByName(tag(truth, 0, 1)).groupBy(*keys).agg(F.sum("t").alias("tp"), F.sum("p").alias("n_pred"), F.sum("g").alias("n_gt"))
    return c.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_pred") + F.col("n_gt")), F.lit(1.0)))


def reading_order(matches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, tau): Kendall's tau, scaled to 0 to 1, of the order of a page's matched blocks; 1 for fewer than two."""
    order = F.array_sort(F.collect_list(F.struct("gt_at", "pred_at")))  # blocks of one page
    per = matches.groupBy(*keys).agg(F.transform(order, lambda m: m.pred_at).alias("o"))
    swaps = F.aggregate(F.transform("o", lambda x, i: F.size(F.filter(F.slice("o", i + 2, F.size("o")), lambda y: y < x))), F.lit(0), lambda a, x: a + x)
    n = F.size("o")
    return per.select(*keys, n.alias("n"), F.when(n < 2, 1.0).otherwise(1 - F.try_divide(2.0 * swaps, n * (n - 1))).alias("tau"))


# --- reports ----------------------------------------------------------------------------------------------------------


def flag_counts(files: DataFrame, keys: list[str], flags: tuple[str, ...] = ("missing_required", "page_gap")) -> DataFrame:
    """(keys, one count a flag) of rows with an array of flags."""
    return files.groupBy(*keys).agg(*(F.count_if(F.array_contains("flags", f)).alias(f) for f in flags))


def scorecard(lines: list[tuple[str, str, str, str]], aggregates: DataFrame, models: list[str], inputs: set[str]) -> DataFrame:
    """One row per question line (question, metric, table, input): a column a model with the mean, n, data (capability or
    domain proxy) and note. Lines whose input wasn't made say so and stay. aggregates: table, metric, model, mean, n."""
    spark = aggregates.sparkSession
    asked = spark.createDataFrame([(i, *line, line[3] in inputs) for i, line in enumerate(lines)], "line int, question string, metric string, table string, input string, there boolean")
    got = aggregates.where(F.col("model").isin(*models)).groupBy("table", "metric").pivot("model", models).agg(F.first("mean"))
    n = aggregates.groupBy("table", "metric").agg(F.max("n").alias("n"))
    j = asked.join(got, ["table", "metric"], "left").join(n, ["table", "metric"], "left")
    note = F.when(~F.col("there"), F.concat(F.lit("not benchmarked - no "), "input")).when(F.col("n").isNull(), "not benchmarked - no rows")
    hide = lambda c: F.when(F.col("there"), F.col(c)).alias(c)
    data = F.when(F.col("table").rlike("^bank"), "domain proxy").otherwise("capability proxy")
    return j.orderBy("line").select("question", "metric", *map(hide, models), hide("n"), data.alias("data"), note.alias("note"))


def masked(field: Column, value: Column) -> Column:
    """A value as clients see it: names hidden, of account numbers the last four digits."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    hidden = F.concat(F.repeat(F.lit("*"), F.greatest(F.length(digits) - 4, F.lit(0))), F.right(digits, F.lit(4)))
    return F.when(field.rlike("(?i)name|ชื่อ"), "[NAME]").when(field.rlike("(?i)account|บัญชี"), hidden).otherwise(value)


def samples(fields: DataFrame, t_accept: float | None) -> DataFrame:
    """Field rows for clients: masked values, no boxes of what was masked, and low_confidence among the flags where the
    confidence is under the threshold. fields: field, value, raw, box, confidence, error_flags and others, which stay."""
    f = F.col("field")
    hidden = f.rlike("(?i)name|ชื่อ|account|บัญชี")
    low = F.lit(False) if t_accept is None else F.coalesce(F.col("confidence") < t_accept, F.lit(False))
    flags = F.when(low, F.array_union(F.coalesce("error_flags", F.array().cast("array<string>")), F.array(F.lit("low_confidence")))).otherwise(F.col("error_flags"))
    return fields.withColumns({"value": masked(f, F.col("value")), "raw": masked(f, F.col("raw")), "box": F.when(~hidden, F.col("box")), "error_flags": flags})


FLAGS = ("balance_mismatch", "total_mismatch", "model_disagreement", "low_confidence", "missing_required", "page_gap")


def unknown_flags(flags: Column) -> Column:
    """The flags that the contract doesn't have."""
    return F.array_except(flags, F.array(*map(F.lit, FLAGS)))


def union_scores(*parts: DataFrame) -> DataFrame:
    """Scores of several checks as one table; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def register(spark) -> list[str]:
    """Registers the Python functions of the library for SQL text; their names. Column functions have no SQL name, as
    they are expressions of built-in ones."""
    from ..functions import official, pages, statement, tables

    made = {
        "table_similarity": tables.teds_udf, "document_similarity": tables.document_similarity_udf, "text_similarity": tables.text_similarity_udf, "html_tables": tables.html_tables_udf,
        "pipe_tables": tables.pipe_tables_udf, "otsl_html": tables.otsl_udf, "json_fields": tables.json_fields_udf, "official_score": official.official, "answer_fields": official.answer_fields_udf,
        "parse_page": pages._parse, "map_statement": statement._map_pages, "grounding_text": pages.grounding_text_udf, "page_markdown": pages.page_markdown_udf,
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("reply_fields", F.udtf(ReplyFields, returnType="field string, value string"))
    return sorted([*made, "reply_fields"])


class ReplyFields:
    """A table function for SQL: the fields of a JSON reply as rows."""

    def eval(self, reply: str):
        from ..functions.tables import json_fields

        yield from json_fields(reply)[0].items()

