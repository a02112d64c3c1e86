"""Queries over guards, reports, samples and SQL functions, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cmaps, fields, official, words
from ..operators import assess, ingest, run, sampling, serving, slices
from ..sources import registry
from ..sources.scratch import keep
from .catalogue import _SCORES_SQL, _scores, query, r6, t
from .scans import _LONG_SQL, _scan

S = F.lit


@query("SELECT c_custkey, 'ep' || c_custkey % 4 AS endpoint FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 5 <> 0 AND c_custkey % 4 NOT IN (1, 3)")
def unpromoted_rows(spark, d):
    """Clients' rows that would go to an endpoint that isn't promoted; rows without an endpoint don't count."""
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.concat(S("ep"), F.col("c_custkey") % 4)).alias("endpoint"), F.col("c_mktsegment").alias("source"))
    return ingest.unpromoted(c, ["ep1", "ep3"], source="BUILDING").select("c_custkey", "endpoint")


@query("SELECT o_orderpriority, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS missing_required, CAST(count(*) FILTER (o_orderkey % 7 = 0) AS BIGINT) AS page_gap FROM orders GROUP BY o_orderpriority")
def flagged_orders(spark, d):
    o = t(spark, d, "orders")
    flags = F.array_compact(F.array(F.when(F.col("o_orderkey") % 3 == 0, "missing_required"), F.when(F.col("o_orderkey") % 7 == 0, "page_gap"), F.when(F.col("o_orderkey") % 2 == 0, "other")))
    return assess.flag_counts(o.withColumn("flags", flags), ["o_orderpriority"])


@query("""SELECT event_type, round(sum(value) * 0.69 / 3600 / nullif(count(*) FILTER (event_id % 4 <> 0), 0), 6) AS cost, CASE WHEN quantile_cont(value, 0.95) <= 300 AND quantile_cont(value, 0.5) <= 60 AND quantile_cont(value, 0.99) <= 1000 THEN 'met' ELSE 'missed' END AS slo, CASE WHEN quantile_cont(value, 0.5) <= 60 THEN 'met' ELSE 'missed' END AS typical FROM events GROUP BY event_type""")
def costs_and_targets(spark, d):
    """What a page costs by type of event, and whether latencies are within their targets."""
    e = t(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("s"), F.count_if(F.col("event_id") % 4 != 0).alias("n"), *(F.percentile("value", S(p)).alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)))
    return e.select("event_type", r6(serving.cost_per_page(F.col("s"), S(0.69), F.col("n"))).alias("cost"), serving.slo(F.col("p95"), F.col("p50"), F.col("p99"), (300.0, 60.0, 1000.0)).alias("slo"), serving.met(F.col("p50"), 60.0).alias("typical"))


@query("""WITH f AS (SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 = 1 GROUP BY o_orderpriority)
SELECT o_orderkey, f.o_orderkey IS NOT NULL AS chosen FROM orders o LEFT JOIN f USING (o_orderkey) ORDER BY chosen DESC, o_orderkey LIMIT 9""")
def probed_orders(spark, d):
    """A first page of each priority, then more in order: nine in all."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 3).alias("page"))
    return sampling.probe_pages(o, "o_orderpriority", "page", "o_orderkey", 9).select("o_orderkey", "chosen")


@query("WITH " + _SCORES_SQL + " SELECT doc_id AS sample_id, 'clean' AS condition, model, 'cer' AS metric, round(cer, 6) AS value, role AS task, CAST(NULL AS VARCHAR) AS is_critical FROM scores UNION ALL SELECT doc_id, 'clean', model, 'missing', missing::INT, NULL, CAST(part = 'first' AS VARCHAR) FROM scores")
def united_scores(spark, d):
    """Scores of two checks, of which each lacks a column, as one table in the order of their keys."""
    s = _scores(spark, d).select(F.col("doc_id").alias("sample_id"), S("clean").alias("condition"), "model", "role", "part", "cer", "missing")
    key = ["sample_id", "condition", "model"]
    a = s.select(*key, S("cer").alias("metric"), r6("cer").alias("value"), F.col("role").alias("task"))
    b = s.select(*key, S("missing").alias("metric"), F.col("missing").cast("double").alias("value"), (F.col("part") == "first").cast("string").alias("is_critical"))
    return run.ordered(assess.union_scores(a, b), "metric")


@query("SELECT CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS stratum, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1")
def strata(spark, d):
    p = t(spark, d, "part")
    domain = F.when(F.col("p_partkey") % 10 == 0, None).when(F.col("p_partkey") % 5 == 0, "  ").otherwise(F.concat(S(" "), "p_brand"))
    return p.groupBy(ingest.stratum(domain).alias("stratum")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT 'Text recognition' AS task, CASE WHEN c_custkey % 4 = 0 THEN 0.9 ELSE 1.0 END AS published FROM customer UNION ALL SELECT 'Document classification', 1.0 FROM customer),
a AS (SELECT task, CAST(count(*) AS BIGINT) AS n, round(max(1.0 - published), 6)::DOUBLE AS max_abs_diff FROM x GROUP BY task)
SELECT t.task, coalesce(n, 0) AS n, max_abs_diff, coalesce(n > 0 AND max_abs_diff <= 0.01, false) AS comparable FROM (VALUES ('Full-page OCR'), ('Fine-grained text recognition'), ('Handwritten content extraction'), ('Text recognition'), ('Document classification'), ('Table parsing'), ('Document parsing'), ('Key information extraction'), ('Key information mapping')) t(task) LEFT JOIN a USING (task)""")
def official_parity(spark, d):
    """Our scores of answers beside published ones, by task; tasks without rows aren't comparable."""
    c = t(spark, d, "customer")
    a = c.select(S("Text recognition").alias("task"), F.concat(S("It reads "), F.lower("c_name"), S(".")).alias("answer"), F.col("c_name").alias("truth"), F.when(F.col("c_custkey") % 4 == 0, 0.9).otherwise(1.0).alias("published"))
    b = c.select(S("Document classification").alias("task"), F.col("c_mktsegment").alias("answer"), F.col("c_mktsegment").alias("truth"), S(1.0).alias("published"))
    return official.parity(a.union(b))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND lang = 'en'")
def listed_rows(spark, d):
    """The rows of one condition that a list names."""
    m = t(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.when(F.col("lang") == "en", "clean").otherwise("photo").alias("condition"), "n_chars")
    listed = t(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("sample_id"))
    return ingest.parity_rows(m, listed).select(F.col("sample_id").alias("doc_id"), "n_chars")


@query("WITH " + _LONG_SQL + " SELECT k, count_if(NOT ok) = 0 AS valid, true AS nothing_asked FROM x GROUP BY k")
def cross_checked_files(spark, d):
    """A document class's rules over whole files."""
    _, files = _scan(spark, d, only_files=True)
    return files.select("k", registry.cross_valid(("running_balance",)).alias("valid"), registry.cross_valid(()).alias("nothing_asked"))


@query("WITH " + _SCORES_SQL + """, s AS (SELECT *, CASE WHEN role = 'user' THEN 'statement' ELSE 'text' END AS task, CASE WHEN part = 'first' THEN 'Finance' ELSE 'Other' END AS domain FROM scores),
a AS (SELECT 'task_model' AS "table", task, NULL AS subtask, model, NULL AS condition, NULL AS bank, NULL AS domain, cer FROM s UNION ALL SELECT 'task_subtask_model', task, role, model, NULL, NULL, NULL, cer FROM s WHERE task = 'text'
UNION ALL SELECT 'condition_model', NULL, NULL, model, 'clean', NULL, NULL, cer FROM s UNION ALL SELECT 'task_condition_model', task, NULL, model, 'clean', NULL, NULL, cer FROM s UNION ALL SELECT 'bank_doctype_model', NULL, NULL, model, NULL, 'b', NULL, cer FROM s WHERE task = 'statement'
UNION ALL SELECT 'domain_model', NULL, NULL, model, NULL, NULL, domain, cer FROM s WHERE task <> 'statement' AND domain = 'Finance')
SELECT "table", task, subtask, model, condition, bank, domain, round(avg(cer), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY ALL""")
def aggregate_tables(spark, d):
    """The six standard tables of a run's scores."""
    s = _scores(spark, d)
    rows = s.select(F.col("doc_id").alias("sample_id"), S("clean").alias("condition"), "model", S("cer").alias("metric"), F.col("cer").alias("value"), F.when(F.col("role") == "user", "statement").otherwise("text").alias("task"), F.col("role").alias("subtask"), S("b").alias("bank"), S("d").alias("doc_type"), F.when(F.col("part") == "first", "Finance").otherwise("Other").alias("domain"))
    return slices.aggregates(rows, resamples=20).select("table", "task", "subtask", "model", "condition", "bank", "domain", r6("mean").alias("mean"), "n")


@query("""WITH g AS (SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b, count(DISTINCT o_orderpriority) AS c, count(*) AS m FROM orders GROUP BY o_custkey)
SELECT o_custkey, concat_ws('; ', CASE WHEN a < 3 THEN 'only ' || a || ' digital pages with a usable text layer (< 3); Check A is weakened' END, CASE WHEN b < 4 THEN 'only ' || b || ' scanned/photo pages (< 4)' END, CASE WHEN c < 5 THEN 'only ' || c || ' banks (< 5)' END, CASE WHEN m < 8 THEN 'only ' || m || ' multi-page statements (< 8)' END) AS said FROM g""")
def corpus_warnings(spark, d):
    g = t(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b"), F.count_distinct("o_orderpriority").alias("c"), F.count("*").alias("m"))
    return g.select("o_custkey", F.array_join(ingest.coverage_warnings(F.col("a"), F.col("b"), F.col("c"), F.col("m"), (3, 4, 5, 8)), "; ").alias("said"))


@query("""SELECT s_suppkey, CAST(least(s_suppkey % 5 + CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey % 3 END, 4) AS BIGINT) AS billed, (SELECT max(s_acctbal) FROM supplier WHERE s_nationkey IN (1, 2, 3) AND s_suppkey % 10 <> 0) AS top FROM supplier""")
def billed(spark, d):
    """Workers that are paid for, and the highest price of a pool."""
    s = t(spark, d, "supplier")
    known = F.map_filter(F.create_map(S("running"), F.col("s_suppkey") % 5, S("initializing"), F.col("s_suppkey") % 3, S("idle"), S(9).cast("long")), lambda k, v: (k != "initializing") | (v > 0))
    gpus = s.select(F.col("s_nationkey").cast("string").alias("pool"), (F.col("s_suppkey") % 10).cast("string").alias("id"), F.col("s_acctbal").alias("price"))
    top = serving.top_price(gpus, ["1", "2", "3"], ["0"]).select(F.col("price").alias("top"))
    return s.select("s_suppkey", serving.billed_workers(known, 4).alias("billed")).crossJoin(F.broadcast(top))  # one row


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS opening FROM orders")
def opening_lines(spark, d):
    o = t(spark, d, "orders")
    said = F.element_at(F.array(S(" b / F "), S("Brought  Forward to "), S("ยอดยกมา "), S("brought ")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", fields.is_opening_text(F.concat(said, "o_orderstatus")).alias("opening"))


@query("WITH m AS (SELECT o_custkey, max(o_orderkey % 40) AS m FROM orders GROUP BY o_custkey), e AS (SELECT o_custkey, unnest(range(0, m + 1)) AS i FROM m), f AS (SELECT o_custkey, o_orderkey % 40 AS i, max(o_orderkey) AS o FROM orders GROUP BY 1, 2) SELECT o_custkey, CAST(i AS BIGINT) AS i, o FROM e LEFT JOIN f USING (o_custkey, i)")
def dense_rows(spark, d):
    """Every row number up to the largest of a customer; missing ones hold nothing."""
    o = t(spark, d, "orders").groupBy("o_custkey", (F.col("o_orderkey") % 40).alias("i")).agg(F.max("o_orderkey").alias("o"))
    return sampling.dense(o, ["o_custkey"], "i")


@query("SELECT p_partkey, field, CASE field WHEN 'name' THEN p_name WHEN 'brand' THEN p_brand END AS value, 1.0::DOUBLE AS same FROM part, (VALUES ('name'), ('brand')) v(field)")
def sql_functions(spark, d):
    """Functions of the library in SQL text: a table function's rows, and a similarity."""
    assess.register(spark)
    t(spark, d, "part").select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))).alias("reply"), F.concat(S("<table><tr><td>"), "p_name", S("</td></tr></table>")).alias("html")).createOrReplaceTempView("parchment_replies")
    return spark.sql("SELECT p_partkey, f.field, f.value, table_similarity(html, html) AS same FROM parchment_replies, LATERAL reply_fields(reply) f")


@query("WITH " + _SCORES_SQL + " SELECT model, round(avg(cer), 6) AS mean, true AS equal FROM scores GROUP BY model")
def sql_bootstrap(spark, d):
    """The interval as an aggregate of SQL text, which is that of bootstrap_numpy()."""
    c = keep(slices.sliced(_scores(spark, d).withColumns({"metric": S("cer"), "sample_id": F.col("doc_id")}), [slices.Slice("model", ("model",))], value="cer"), "clusters")
    spark.udf.register("bootstrap_interval", slices.interval)
    c.createOrReplaceTempView("parchment_clusters")
    told = spark.sql("SELECT model, bootstrap_interval(cluster, total, n) AS i FROM parchment_clusters GROUP BY model")
    want = slices.bootstrap_numpy(c, ["model"])
    return told.join(want, "model").select("model", r6("mean").alias("mean"), (F.col("i") == F.array("mean", "lo", "hi")).alias("equal"))


@query("""WITH c AS (SELECT DISTINCT lang, unnest(list_transform(range(1, length(text) + 1), lambda i: substr(text, i, 1))) AS ch FROM documents WHERE text <> '')
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY ch) - 1 AS BIGINT) AS code, ch AS text FROM c""")
def code_maps(spark, d):
    """All characters of the documents of a language, as a code map that is written and read back."""
    docs = t(spark, d, "documents").where("text <> ''")
    chars = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", S("(?s)."), S(0)))).alias("text")).distinct()
    rows = chars.withColumn("code", (F.row_number().over(Window.partitionBy("lang").orderBy("text")) - 1).cast("long"))
    return cmaps.entries(cmaps.written(rows, "lang"), "cmap", "lang").select("lang", "code", "text")


@query("SELECT p_partkey, true AS whole, true AS known, true AS few FROM part")
def word_cuts(spark, d):
    """Names of parts without their spaces, cut by a dictionary of their words: nothing is lost, all pieces are words, and
    there are no more of them than the name has."""
    p = t(spark, d, "part").select("p_partkey", F.split(F.lower("p_name"), "[^a-z]+").alias("own"))
    known = p.select(F.explode("own").alias("word")).where("word <> ''").distinct()
    cut = p.select("p_partkey", F.filter("own", lambda w: w != "").alias("own")).withColumn("cut", words.tokenizer(known, letters="a-z")(F.array_join("own", "")))
    pieces = cut.select("p_partkey", F.explode("cut").alias("word")).join(known.withColumn("is", S(True)), "word", "left").groupBy("p_partkey").agg(F.every(F.coalesce("is", S(False))).alias("known"))
    return cut.join(pieces, "p_partkey").select("p_partkey", (F.array_join("cut", "") == F.array_join("own", "")).alias("whole"), "known", (F.size("cut") <= F.size("own")).alias("few"))
