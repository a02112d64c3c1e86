"""Queries over order, lines, percentiles and logs of any size, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators import ledger_scan as scan_of_ledgers
from ..operators import draws, ordered, percentiles
from ..operators.ledger import MONEY
from ..sources import commits, lines
from ..sources.scratch import keep, shared_dir
from ..streaming import state
from .catalogue import query, r6, t

# --- ledgers: all orders of a priority are one ledger; some balances are missing or wrong, some sums have no side ---

_LONG_SQL = """o AS (SELECT o_orderpriority AS k, o_orderkey AS id, o_orderdate AS day, strftime(o_orderdate, '%Y-%m-%d') AS date, year(o_orderdate) * 12 + month(o_orderdate) AS page_no, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,4)) AS net, o_orderkey % 5 = 0 AS unsigned FROM orders),
b AS (SELECT *, row_number() OVER w AS n, sum(net) OVER (w ROWS UNBOUNDED PRECEDING) + CASE WHEN id % 37 = 0 THEN 1 ELSE 0 END AS told FROM o WINDOW w AS (PARTITION BY k ORDER BY day, id)),
c AS (SELECT *, CASE WHEN unsigned OR id % 4 <> 0 THEN told END AS balance FROM b),
p AS (SELECT *, last_value(balance IGNORE NULLS) OVER e AS printed, count(balance) OVER e AS g, page_no <> lag(page_no) OVER (PARTITION BY k ORDER BY n) AS starts FROM c WINDOW e AS (PARTITION BY k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, coalesce(printed, 0) + sum(net) OVER (PARTITION BY k, g ORDER BY n ROWS UNBOUNDED PRECEDING) - net AS running FROM p),
v AS (SELECT *, CASE WHEN NOT unsigned THEN net WHEN balance <> running AND abs(balance - running) = abs(net) THEN balance - running END AS side FROM r),
x AS (SELECT *, CASE WHEN unsigned THEN CASE WHEN side IS NULL THEN false END ELSE balance = running + side END AS ok FROM v)"""


def _long(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").cast(MONEY).alias("price"))
    net = F.when(F.col("id") % 3 == 0, -F.col("price")).otherwise(F.col("price"))
    o = o.withColumns({"page_no": F.year("at") * 12 + F.month("at"), "net": net})
    told = ordered.with_running(ordered.ranged(o, ["k"], ["at", "id"]), ["at", "id"], "net", "pos").withColumn("told", F.col("running") + F.col("net") + F.when(F.col("id") % 37 == 0, 1).otherwise(0))
    unsigned = F.col("id") % 5 == 0
    side = lambda c: F.when(~unsigned & c, F.col("price"))
    return told.select("k", "id", "page_no", "pos", "date", side(F.col("net") < 0).alias("debit"), side(F.col("net") >= 0).alias("credit"), F.when(unsigned, F.col("price")).alias("amount"), F.when(unsigned | (F.col("id") % 4 != 0), F.col("told")).cast(MONEY).alias("balance"))


def _scan(spark, d, only_files=False):
    rows = keep(_long(spark, d), "ledgers")
    pages = rows.select("k", "page_no").distinct()
    first = pages.groupBy("k").agg(F.min("page_no").alias("first"))
    null = F.lit(None).cast(MONEY)
    pages = pages.join(first, "k").select("k", "page_no", F.when(F.col("page_no") == F.col("first"), F.lit(0).cast(MONEY)).alias("opening_balance"), null.alias("closing_balance"), null.alias("total_debit"), null.alias("total_credit"))
    return scan_of_ledgers.scan_files(rows, pages, ["k"], only_files=only_files)


@query("WITH " + _LONG_SQL + """ SELECT k, CAST(count(*) AS INTEGER) AS n_rows, CAST(count(ok) AS BIGINT) AS judged, CAST(count_if(NOT ok) AS BIGINT) AS mismatches, CAST(min(n) FILTER (NOT ok) AS INTEGER) AS first_break, CAST(count_if(NOT ok AND starts) AS BIGINT) AS gaps,
round(avg(ok::INT), 6) AS rate, CAST(sum(greatest(coalesce(side, 0), 0)) AS DOUBLE) AS credit, CAST(sum(greatest(-coalesce(side, 0), 0)) AS DOUBLE) AS debit, count_if(NOT ok) = 0 AS reconciles FROM x GROUP BY k""")
def ledger_scan_files(spark, d):
    """Five ledgers of a fifth of all orders each, scanned in parts."""
    _, f = _scan(spark, d, only_files=True)
    return f.select("k", "n_rows", F.col("n_judged").alias("judged"), F.col("n_mismatches").alias("mismatches"), F.col("first_break_row").alias("first_break"), F.col("n_gaps").alias("gaps"), r6("row_consistency_rate").alias("rate"), F.col("sum_credit").cast("double").alias("credit"), F.col("sum_debit").cast("double").alias("debit"), F.col("file_reconciles").alias("reconciles"))


@query("WITH " + _LONG_SQL + " SELECT k, CAST(n AS INTEGER) AS row_index, page_no, CAST(running + side AS DOUBLE) AS expected, CAST(balance AS DOUBLE) AS actual, CAST(ok AS VARCHAR) AS consistent, CASE WHEN unsigned AND side IS NOT NULL THEN CASE WHEN side > 0 THEN 'credit' ELSE 'debit' END END AS inferred, coalesce(NOT ok AND starts, false) AS gap FROM x")
def ledger_scan(spark, d):
    """What is expected of every balance of these ledgers."""
    checks, _ = _scan(spark, d)
    return checks.select("k", "row_index", F.col("page_no").cast("long").alias("page_no"), F.col("expected").cast("double").alias("expected"), F.col("actual").cast("double").alias("actual"), F.col("consistent").cast("string").alias("consistent"), "inferred", "gap")


@query("SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS place, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS previous, lead(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS next FROM events")
def event_order(spark, d):
    """Places and neighbours of events among those of their few types."""
    order = ["ts", "event_id"]
    dealt = ordered.ranged(t(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], order)
    near = ordered.with_neighbours(ordered.with_rank(dealt, order, "place"), order, ["event_id"])
    return near.select("event_id", "place", F.col("before.event_id").alias("previous"), F.col("after.event_id").alias("next"))


# --- lines, commits and state of logs -----------------------------------------------------------------------------


def _folder(spark, what):
    return f"{shared_dir(spark)}/parchment-{what}-{uuid.uuid4().hex}"


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, true AS in_order FROM events")
def event_lines(spark, d):
    """Events as JSON Lines, an ordered file a type, read back with their numbers: does a line's number tell its event's
    place in the file?"""
    e = t(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    path = _folder(spark, "lines")
    e.repartition("event_type").sortWithinPartitions("event_type", "event_id").withColumn("type", F.col("event_type")).write.partitionBy("type").option("maxRecordsPerFile", 20_000).json(path)
    rows = lines.typed_rows(spark, f"{path}/*", StructType([StructField("event_id", LongType(), False), StructField("event_type", StringType(), False), StructField("k", LongType())]))
    return ordered.rank(rows, ["file"], ["event_id"], "place").select("event_id", "event_type", "k", (F.col("place") == F.col("number")).alias("in_order"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def committed_events(spark, d):
    """A table to which a write of each type is one commit, one of them twice under one name."""
    e = t(spark, d, "events").select("event_id", "event_type", "value")
    path = _folder(spark, "commits")
    types = [r.event_type for r in e.select("event_type").distinct().orderBy("event_type").collect()]  # few types
    for name in [*types, *types[:1]]:
        commits.append(e.where(F.col("event_type") == name), path, name)
    rows = commits.read(spark, path, e.schema)
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_state(spark, d):
    """The last event of each user, kept as state of a stream over the log."""
    e = t(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    stream = spark.readStream.schema(e.schema).parquet(f"{d}/events.parquet*")  # a glob, as it may be one file
    at = _folder(spark, "state")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        state.keep_latest(stream, ["user_id"], "event_id", f"{at}/out", f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return state.read_state(spark, f"{at}/checkpoint", ["user_id"]).select("user_id", "event_id", "event_type", "value")


@query("""SELECT event_type, n, CAST(share AS DOUBLE) AS share, round(value, 6) AS value FROM (SELECT event_type, CAST(count(value) AS BIGINT) AS n, unnest([0.5, 0.95, 0.99]) AS share, unnest([quantile_cont(value, 0.5), quantile_cont(value, 0.95), quantile_cont(value, 0.99)]) AS value FROM events GROUP BY event_type)""")
def exact_percentiles(spark, d):
    """Percentiles of latencies by refining histograms."""
    found = percentiles.percentiles(t(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99])
    return found.select("event_type", "n", "share", r6("value").alias("value"))


@query()
def drawn_sample(spark, d):
    """Up to 500 documents, by language, as Python's generator draws them."""
    return draws.stratified(t(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 500, "documents").select("lang", "draw", "doc_id")


@query()
def drawn_queue(spark, d):
    """Order lines on which two readers differ, and a tenth of all others, a draw each in their order."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("string").alias("q"))
    other = F.when(F.col("l_orderkey") % 11 != 0, F.col("q"))
    cells = x.select("l_orderkey", "l_linenumber", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("q").alias("value")), F.struct(F.lit("b").alias("model"), other.alias("value")))).alias("m")).select("l_orderkey", "l_linenumber", "m.*")
    return draws.review_queue(cells, ["l_orderkey", "l_linenumber"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "differs")
