"""Queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fields, pages, tables, text, values
from ..operators import calibration, duplicates, joins, ledger, sampling, scoring, serving, slices
from ..sources.scratch import keep

FLAGSHIP = "score_slices"
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


ASCII = r"[^\x00-\x7F]"

# --- scoring a run: synthetic predictions are conversation turns, whole, with letters changed -------------------------


def _pages(spark, d):
    """Turns of conversations as pages, with their whole ASCII text as the truth."""
    turns = t(spark, d, "conversations")
    truth = F.trim(F.regexp_replace(F.regexp_replace("text", ASCII, ""), r"[ \t\r\n\f\x0b]+", " "))
    return turns.select(F.concat_ws("-p", "conv_id", "turn").alias("doc_id"), "role", F.when(F.col("turn") == 0, "first").otherwise("later").alias("part"), truth.alias("truth"))


_PAGES_SQL = r"""pages_ AS (SELECT concat_ws('-p', conv_id, turn) AS doc_id, role, CASE WHEN turn = 0 THEN 'first' ELSE 'later' END AS part, trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '[ \t\r\n\f\v]+', ' ', 'g')) AS truth FROM conversations)"""


def _scores(spark, d):
    pages = _pages(spark, d)
    pred = pages.where("NOT contains(truth, 'q')").select("doc_id", F.lit("m1").alias("model"), F.translate("truth", "e", "a").alias("pred")).union(pages.where("NOT contains(truth, 'z')").select("doc_id", F.lit("m2").alias("model"), F.replace("truth", F.lit("the"), F.lit("th")).alias("pred")))
    rows = joins.spread(joins.with_predictions(pages, pred, ["doc_id"], ["m1", "m2"]), "doc_id", "model")
    return rows.withColumn("cer", F.when(F.col("missing"), 1.0).otherwise(text.cer(F.col("pred"), F.col("truth"))))


_SCORES_SQL = _PAGES_SQL + """, preds AS (SELECT doc_id, 'm1' AS model, replace(truth, 'e', 'a') AS pred FROM pages_ WHERE NOT contains(truth, 'q') UNION ALL SELECT doc_id, 'm2', replace(truth, 'the', 'th') FROM pages_ WHERE NOT contains(truth, 'z')),
scores AS (SELECT p.*, m.model, pred, pred IS NULL AS missing, CASE WHEN pred IS NULL THEN 1.0 ELSE least(1.0, levenshtein(pred, truth) / CAST(greatest(1, length(truth)) AS DOUBLE)) END AS cer FROM pages_ p CROSS JOIN (VALUES ('m1'), ('m2')) m(model) LEFT JOIN preds USING (doc_id, model))"""


@query("WITH " + _SCORES_SQL + """ SELECT "table", role, part, model, round(sum(cer) / count(*), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT 'role_model' AS "table", role, NULL AS part, model, cer FROM scores UNION ALL SELECT 'part_model', NULL, part, model, cer FROM scores UNION ALL SELECT 'model', NULL, NULL, model, cer FROM scores) GROUP BY ALL""")
def score_slices(spark, d):
    """Character error rates of two models by slices; missing predictions count as 1."""
    long = _scores(spark, d).withColumns({"metric": F.lit("cer"), "sample_id": F.col("doc_id")})
    cells = slices.sliced(long, [slices.Slice("role_model", ("role", "model")), slices.Slice("part_model", ("part", "model")), slices.Slice("model", ("model",))], value="cer")
    return slices.means(cells, ["table", "role", "part", "model"]).select("table", "role", "part", "model", r6("mean").alias("mean"), "n")


@query("WITH " + _SCORES_SQL + " SELECT model, CAST(count(*) FILTER (missing) AS BIGINT) AS missing, round(avg(cer), 6) AS cer, CAST(count(*) AS BIGINT) AS n FROM scores GROUP BY model")
def missing_predictions(spark, d):
    return _scores(spark, d).groupBy("model").agg(F.count_if("missing").alias("missing"), r6(F.avg("cer")).alias("cer"), F.count("*").alias("n"))


@query("WITH " + _SCORES_SQL + """ SELECT doc_id, model, round(CASE WHEN greatest(length(pred), length(truth)) = 0 THEN 1.0 WHEN 1 - levenshtein(lower(pred), lower(truth)) / CAST(greatest(length(pred), length(truth)) AS DOUBLE) >= 0.5 THEN 1 - levenshtein(lower(pred), lower(truth)) / CAST(greatest(length(pred), length(truth)) AS DOUBLE) ELSE 0.0 END, 6) AS anls,
 levenshtein(pred, truth) / CAST(greatest(1, length(truth)) AS DOUBLE) <= 0.1 AS fuzzy FROM scores WHERE NOT missing""")
def text_similarity(spark, d):
    s = _scores(spark, d).where("not missing")
    return s.select("doc_id", "model", r6(text.anls(F.col("pred"), F.col("truth"))).alias("anls"), text.fuzzy(F.col("pred"), F.col("truth")).alias("fuzzy"))


@query("WITH " + _SCORES_SQL + " SELECT role, model, round(sum(levenshtein(pred, truth)) / greatest(1, sum(length(truth))), 6) AS pooled FROM scores WHERE NOT missing GROUP BY role, model")
def pooled_error(spark, d):
    s = _scores(spark, d).where("not missing")
    return s.groupBy("role", "model").agg(r6(text.pooled(text.edits(F.col("pred"), F.col("truth")), F.length("truth"))).alias("pooled"))


@query()
def word_error(spark, d):
    s = _scores(spark, d).where("not missing")
    return s.select("doc_id", "model", r6(text.wer(text.tokens(F.col("pred")), text.tokens(F.col("truth")))).alias("wer"))


@query("WITH " + _SCORES_SQL + " SELECT role, model, round(avg(cer), 6) AS mean, CAST(count(*) AS BIGINT) AS n, true AS inside FROM scores GROUP BY role, model")
def bootstrap_slices(spark, d):
    """Means with intervals by numpy's generator, which hold the mean."""
    long = _scores(spark, d).withColumns({"metric": F.lit("cer"), "sample_id": F.col("doc_id")})
    b = slices.bootstrap_numpy(slices.sliced(long, [slices.Slice("role_model", ("role", "model"))], value="cer"), ["table", "role", "model", "metric"])
    return b.select("role", "model", r6("mean").alias("mean"), "n", ((F.col("lo") <= F.col("mean")) & (F.col("mean") <= F.col("hi"))).alias("inside"))


#: Intervals of cells c (keys, cluster, total, n) by the weights of slices.digest_uniform(); keys and name of a table q.
_RESAMPLED = 40
_POISSON_SQL = """r AS (SELECT *, unnest(range(1, {n} + 1)) AS r FROM c),
u AS (SELECT *, list_reduce(list_transform(string_split(substr(md5(concat_ws(':', cluster, r)), 1, 8), ''), lambda x: CAST(strpos('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, x: a * 16 + x) / 4294967296.0::DOUBLE AS u FROM r),
w AS (SELECT *, list_sum(list_transform([{cuts}], lambda x: (u >= x)::INT)) AS w FROM u),
m AS (SELECT {keys}, r, sum(total * w) / nullif(sum(n * w), 0) AS m FROM w GROUP BY {keys}, r),
q AS (SELECT {keys}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY {keys}), b AS (SELECT {keys}, sum(total) / sum(n) AS mean, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY {keys})"""


def _poisson_sql(keys):
    return _POISSON_SQL.format(n=_RESAMPLED, cuts=", ".join(f"{x!r}::DOUBLE" for x in slices.POISSON), keys=keys)


@query("WITH " + _SCORES_SQL + ", c AS (SELECT role, model, doc_id AS cluster, sum(cer) AS total, count(*) AS n FROM scores GROUP BY role, model, doc_id), " + _poisson_sql("role, model") + " SELECT role, model, round(mean, 6) AS mean, n, round(least(lo, mean), 6) AS lo, round(greatest(hi, mean), 6) AS hi FROM b JOIN q USING (role, model)")
def bootstrap_poisson(spark, d):
    long = _scores(spark, d).withColumns({"metric": F.lit("cer"), "sample_id": F.col("doc_id")})
    b = slices.bootstrap(slices.sliced(long, [slices.Slice("role_model", ("role", "model"))], value="cer"), ["table", "role", "model", "metric"], _RESAMPLED, uniform=slices.digest_uniform)
    return b.select("role", "model", r6("mean").alias("mean"), "n", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("WITH " + _SCORES_SQL + ", c AS (SELECT a.role, a.doc_id AS cluster, a.cer - b.cer AS total, 1 AS n FROM scores a JOIN scores b ON a.doc_id = b.doc_id WHERE a.model = 'm1' AND b.model = 'm2'), " + _poisson_sql("role") + ", e AS (SELECT role, mean, n, least(lo, mean) AS lo, greatest(hi, mean) AS hi FROM b JOIN q USING (role)) SELECT role, round(mean, 6) AS mean, n, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN lo > 0 THEN 'better' WHEN hi < 0 THEN 'worse' ELSE 'same' END AS verdict FROM e")
def paired_difference(spark, d):
    long = _scores(spark, d).withColumns({"metric": F.lit("cer"), "sample_id": F.col("doc_id")})
    c = keep(slices.sliced(long, [slices.Slice("role_model", ("role", "model"))], value="cer"), "clusters")  # two runs of one table
    p = slices.paired_difference(c.where("model = 'm1'"), c.where("model = 'm2'"), ["role", "metric"], _RESAMPLED, uniform=slices.digest_uniform)
    return p.select("role", r6("mean").alias("mean"), "n", r6("lo").alias("lo"), r6("hi").alias("hi"), "verdict")


# --- joins over logs ---------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, ts, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_events(spark, d):
    return joins.latest(t(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "ts", "value")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def pending_documents(spark, d):
    done = t(spark, d, "labels").withColumn("error", F.when(F.col("quality") != 1, "low"))
    return joins.pending(t(spark, d, "documents").select("doc_id"), done, ["doc_id"], "error")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def stray_labels(spark, d):
    return joins.stray(t(spark, d, "labels").select("doc_id"), t(spark, d, "documents").where("lang = 'en'"), ["doc_id"])


@query("""WITH k AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'html' WHEN 2 THEN 'json' ELSE 'text_layer' END AS kind FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
w AS (SELECT * FROM (VALUES ('text', 'cer', 1.0), ('text', 'wer', 1.0), ('text', 'anls', 0.0), ('html', 'teds', 0.0), ('html', 'cer', 1.0), ('json', 'field_exact', 0.0), ('json', 'f1', 0.0), ('text_layer', 'cer', 1.0), ('text_layer', 'row_f1', 0.0)) v(kind, metric, value))
SELECT doc_id, metric, CAST(value AS DOUBLE) AS value FROM k JOIN w USING (kind)""")
def worst_case_scores(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("text", "html", "json", "text_layer"))), (F.col("doc_id") % 4 + 1).cast("int"))
    lost = t(spark, d, "documents").join(t(spark, d, "labels"), "doc_id", "left_anti")
    return lost.select("doc_id", F.explode(joins.worst_values(kind)).alias("metric", "value"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN trim(text) = '' ELSE false END AS full_miss FROM documents")
def error_classes(spark, d):
    error = F.when(F.col("doc_id") % 3 == 0, "timeout").when(F.col("doc_id") % 3 == 1, "1 of 3 blocks failed")
    return t(spark, d, "documents").select("doc_id", joins.is_full_miss(F.lit(False), error, F.col("text")).alias("full_miss"))


@query("""WITH a AS (SELECT l_shipdate AS k, l_extendedprice AS p, l_linenumber AS g FROM lineitem WHERE l_returnflag <> 'R'), b AS (SELECT l_shipdate AS k, l_extendedprice AS p, l_linenumber AS g FROM lineitem WHERE l_linestatus = 'F'),
c AS (SELECT g, k, p, sum(x) AS x, sum(y) AS y FROM (SELECT *, 1 AS x, 0 AS y FROM a UNION ALL SELECT *, 0, 1 FROM b) GROUP BY g, k, p)
SELECT g AS line, CAST(sum(least(x, y)) AS BIGINT) AS tp, round(sum(least(x, y)) / sum(x), 6) AS precision, round(sum(least(x, y)) / sum(y), 6) AS recall FROM c GROUP BY g""")
def row_matches(spark, d):
    """Bag intersection of two sets of ledger rows."""
    rows = t(spark, d, "lineitem").select(F.col("l_linenumber").alias("line"), "l_shipdate", "l_extendedprice", "l_orderkey")
    m = joins.bag_matches(rows.where("l_returnflag <> 'R'"), rows.where("l_linestatus = 'F'"), ["line"], ["l_shipdate", "l_extendedprice"])
    p, r, _ = joins.prf(F.col("tp"), F.col("n_a"), F.col("n_b"))
    return m.select("line", "tp", r6(p).alias("precision"), r6(r).alias("recall"))


def _fields(spark, d):
    c = t(spark, d, "customer")
    long = lambda df, *cols: df.select("c_custkey", F.explode(F.array(*(F.struct(F.lit(n).alias("field"), v.cast("string").alias("value")) for n, v in cols))).alias("f")).select("c_custkey", "f.*")
    gt = long(c, ("name", F.col("c_name")), ("segment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))), ("nation", F.col("c_nationkey")))
    pred = long(c.where("c_acctbal >= -500"), ("name", F.when(F.col("c_custkey") % 3 == 0, F.replace("c_name", F.lit("0"), F.lit("O"))).otherwise(F.col("c_name"))), ("segment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))), ("extra", F.lit("x")))
    return scoring.score_fields(joins.field_pairs(pred, gt, ["c_custkey"]))


_FIELDS_SQL = """gt AS (SELECT c_custkey, 'name' AS field, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END FROM customer UNION ALL SELECT c_custkey, 'nation', CAST(c_nationkey AS VARCHAR) FROM customer),
pr AS (SELECT c_custkey, 'name' AS field, CASE WHEN c_custkey % 3 = 0 THEN replace(c_name, '0', 'O') ELSE c_name END AS v FROM customer WHERE c_acctbal >= -500 UNION ALL SELECT c_custkey, 'segment', CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END FROM customer WHERE c_acctbal >= -500 UNION ALL SELECT c_custkey, 'extra', 'x' FROM customer WHERE c_acctbal >= -500),
fp AS (SELECT coalesce(g.c_custkey, p.c_custkey) AS c_custkey, coalesce(g.field, p.field) AS field, p.v AS pred, g.v AS gt, g.field IS NOT NULL AS in_gt FROM gt g FULL JOIN pr p ON g.c_custkey = p.c_custkey AND g.field = p.field),
sc AS (SELECT *, coalesce((pred IS NULL AND gt IS NULL) OR pred = gt, false) AS ex, pred IS NOT NULL AND gt IS NULL AS fa FROM fp)"""


@query("WITH " + _FIELDS_SQL + " SELECT field, CAST(sum(ex::INT) AS BIGINT) AS exact, CAST(sum((ex OR coalesce(levenshtein(pred, gt) / CAST(greatest(1, length(gt)) AS DOUBLE) <= 0.1, false))::INT) AS BIGINT) AS fuzzy, CAST(sum(fa::INT) AS BIGINT) AS false_accepts, CAST(sum((gt IS NOT NULL AND pred IS NULL)::INT) AS BIGINT) AS false_rejects, CAST(count(*) AS BIGINT) AS n FROM sc GROUP BY field")
def field_scores(spark, d):
    s = _fields(spark, d)
    return s.groupBy("field").agg(F.sum("field_exact").cast("long").alias("exact"), F.sum("field_fuzzy").cast("long").alias("fuzzy"), F.count_if("false_accept").alias("false_accepts"), F.count_if("false_reject").alias("false_rejects"), F.count("*").alias("n"))


@query("WITH " + _FIELDS_SQL + ", c AS (SELECT c_custkey, sum((ex AND pred IS NOT NULL AND in_gt)::INT) AS tp, count(pred) AS np, count(gt) FILTER (in_gt) AS ng FROM sc GROUP BY c_custkey), q AS (SELECT *, CASE WHEN np > 0 THEN tp / np ELSE (ng = 0)::INT END AS p, CASE WHEN ng > 0 THEN tp / ng ELSE (np = 0)::INT END AS r FROM c) SELECT c_custkey, CAST(tp AS BIGINT) AS tp, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM q")
def field_f1(spark, d):
    return scoring.field_f1(_fields(spark, d), ["c_custkey"]).select("c_custkey", "tp", r6("f1").alias("f1"))


@query("WITH " + _FIELDS_SQL + """ , m AS (SELECT field, 'field_exact' AS metric, ex::INT AS v FROM sc UNION ALL SELECT field, 'field_fuzzy', (ex OR coalesce(levenshtein(pred, gt) / CAST(greatest(1, length(gt)) AS DOUBLE) <= 0.1, false))::INT FROM sc UNION ALL SELECT field, 'fa_rate', fa::INT FROM sc WHERE gt IS NULL UNION ALL SELECT field, 'fr_rate', (pred IS NULL)::INT FROM sc WHERE gt IS NOT NULL) SELECT field, metric, round(avg(v), 6) AS mean, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY field, metric""")
def field_rate_slices(spark, d):
    long = slices.field_rates(_fields(spark, d).withColumn("sample_id", F.col("c_custkey")))
    m = slices.means(slices.sliced(long, [slices.Slice("field", ("field",))]), ["table", "field", "metric"])
    return m.where("metric <> 'field_lenient'").select("field", "metric", r6("mean").alias("mean"), "n")


@query("SELECT p_partkey, CASE WHEN p_retailprice < 1000 THEN 1 WHEN p_retailprice < 1500 THEN 2 ELSE 3 END AS band FROM part WHERE p_retailprice >= 0 AND p_retailprice < 1000000")
def price_bands(spark, d):
    bands = [(1, 0.0, 1000.0), (2, 1000.0, 1500.0), (3, 1500.0, 1e7)]
    parts = t(spark, d, "part").withColumn("hi", F.col("p_retailprice") + 1e-9)
    return joins.interval_match(parts, bands, "p_retailprice", "hi", "band").select("p_partkey", "band")


# --- canonical text and typed fields -----------------------------------------------------------------------------


@query(r"SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g'))) AS h FROM documents")
def canonical_documents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(text.canonical_text(F.col("text"))).alias("h"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<figure\b[^>]*>.*?</figure\s*>', ' ', 'g'), '(?i)<(br\s*/?|/p\s*/?|/tr\s*/?|/td\s*/?|/th\s*/?|page_number\s*/?|/page_number\s*/?)>', ' ', 'g'), '<[^>]+>', '', 'g'), '&quot;?', '"', 'g'), '&middot;', '·'), '&copy;', '©'), '&amp;?', '&', 'g') AS x FROM pages),
b AS (SELECT page_id, array_to_string(list_transform(string_split(x, chr(10)), lambda l: CASE WHEN translate(l, ' ' || chr(9) || '|:-', '') = '' AND contains(l, '-') THEN '' WHEN ltrim(l, ' ' || chr(9)) LIKE '#%' THEN ltrim(ltrim(l, ' ' || chr(9)), '# ' || chr(9)) ELSE l END), chr(10)) AS x FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(replace(translate(replace(x, '$$', ' '), '|', ' '), '*', ''), '(^|[^\p{L}\p{N}_])_+', '\1', 'g'), '_+([^\p{L}\p{N}_]|$)', '\1', 'g') AS x FROM b)
SELECT page_id, trim(regexp_replace(nfc_normalize(x), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS plain FROM c""")
def plain_pages(spark, d):
    return t(spark, d, "pages").select("page_id", text.plain_text(F.col("html")).alias("plain"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS thai, strftime(o_orderdate, '%Y-%m-%d') AS named, strftime(o_orderdate, '%Y-%m-%d') AS english FROM orders")
def parse_dates(spark, d):
    """Dates written with Buddhist years, and with month names, read back."""
    o = t(spark, d, "orders")
    day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
    name = F.element_at(F.array(*map(F.lit, fields.THAI_MONTHS)), month)
    return o.select("o_orderkey", values.dates(F.format_string("%d/%d/%d", day, month, year + 543)).alias("thai"), values.dates(F.concat_ws(" ", day, name, year + 543)).alias("named"), values.dates(F.date_format("o_orderdate", "MMMM d, yyyy")).alias("english"))


@query("SELECT c_custkey, round(CAST(c_acctbal AS DECIMAL(20,2)), 2)::DOUBLE AS value, CASE WHEN c_acctbal < 0 THEN 'debit' WHEN c_custkey % 2 = 0 THEN 'credit' END AS side FROM customer")
def parse_amounts(spark, d):
    c = t(spark, d, "customer")
    text_ = F.concat(F.when(F.col("c_acctbal") < 0, "(").otherwise(F.when(F.col("c_custkey") % 2 == 0, "+").otherwise("")), F.lit("฿"), F.format_number(F.abs("c_acctbal"), 2), F.when(F.col("c_acctbal") < 0, ")").otherwise(""))
    m = fields.parse_money(text_)
    return c.select("c_custkey", F.when(m.side == "debit", -m.amount).otherwise(m.amount).cast("double").alias("value"), m.side.alias("side"))


@query("SELECT s_suppkey, 'account' AS kind, regexp_replace(s_name || s_suppkey, '[^0-9]', '', 'g') AS value FROM supplier")
def account_fields(spark, d):
    s = t(spark, d, "supplier")
    f = fields.normalize_field(F.lit("account no"), F.concat("s_name", F.col("s_suppkey").cast("string")))
    return s.select("s_suppkey", fields.field_type(F.lit("account no"), F.col("s_name")).alias("kind"), f.value.alias("value"))


@query("SELECT c_custkey, trim(c_name) <> '' AS named, true AS amount, length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 10 AS account FROM customer")
def validators(spark, d):
    c = t(spark, d, "customer")
    return c.select("c_custkey", fields.valid(F.col("c_name"), "non_empty").alias("named"), fields.valid(F.format_number("c_acctbal", 2), "amount", "non_empty").alias("amount"), fields.valid(F.col("c_name"), "account_number").alias("account"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


# --- ledgers: each customer's orders are a ledger whose every 37th printed balance is off by one ------------------


def _ledger(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_totalprice").cast(ledger.MONEY).alias("price"))
    signed = o.withColumn("net", F.when(F.col("o_orderkey") % 3 == 0, -F.col("price")).otherwise(F.col("price")))
    w = Window.partitionBy("o_custkey").orderBy("date", "o_orderkey")
    running = F.sum("net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return signed.withColumn("pos", F.row_number().over(w)).withColumn("balance", (running + F.when(F.col("o_orderkey") % 37 == 0, 1).otherwise(0)).cast(ledger.MONEY))


_LEDGER_SQL = """o AS (SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,4)) AS net FROM orders),
l AS (SELECT *, row_number() OVER w AS pos, sum(net) OVER (w ROWS UNBOUNDED PRECEDING) + CASE WHEN o_orderkey % 37 = 0 THEN 1 ELSE 0 END AS balance FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY date, o_orderkey)),
c AS (SELECT *, balance = lag(balance) OVER (PARTITION BY o_custkey ORDER BY pos) + net AS ok FROM l)"""


@query("WITH " + _LEDGER_SQL + " SELECT o_custkey, CAST(count(ok) AS BIGINT) AS checked, CAST(count(*) FILTER (ok) AS BIGINT) AS consistent FROM c GROUP BY o_custkey")
def ledger_chain(spark, d):
    return ledger.chain_consistency(_ledger(spark, d), ["o_custkey"], ["pos"], "balance", "net")


@query("WITH " + _LEDGER_SQL + """, z AS (SELECT o_custkey, pos, CASE WHEN pos = 1 THEN balance = net ELSE ok END AS ok, net FROM c)
SELECT o_custkey, CAST(count(*) AS INTEGER) AS n_rows, round(avg(ok::INT), 6) AS rate, CAST(min(pos) FILTER (NOT ok) AS INTEGER) AS first_break, CAST(sum(greatest(net, 0)) AS DOUBLE) AS credit, CAST(sum(greatest(-net, 0)) AS DOUBLE) AS debit, bool_and(ok) AS reconciles FROM z GROUP BY o_custkey""")
def ledger_files(spark, d):
    """The full fold over files with an opening balance of 0."""
    rows = _ledger(spark, d).select("o_custkey", F.lit(1).alias("page_no"), "pos", F.format_string("2000-%06d", "pos").alias("date"), F.when(F.col("net") < 0, -F.col("net")).alias("debit"), F.when(F.col("net") >= 0, F.col("net")).alias("credit"), F.lit(None).alias("amount"), "balance")
    null = F.lit(None).cast(ledger.MONEY)
    pages = rows.select("o_custkey", "page_no").distinct().select("*", F.lit(0).cast(ledger.MONEY).alias("opening_balance"), null.alias("closing_balance"), null.alias("total_debit"), null.alias("total_credit"))
    f = ledger.check_files(rows, pages, ["o_custkey"])
    return f.select("o_custkey", "n_rows", r6("row_consistency_rate").alias("rate"), F.col("first_break_row").alias("first_break"), F.col("sum_credit").cast("double").alias("credit"), F.col("sum_debit").cast("double").alias("debit"), F.col("file_reconciles").alias("reconciles"))


@query("""WITH a AS (SELECT o_custkey, o_orderdate AS k, o_orderkey, o_totalprice AS bal FROM orders WHERE o_orderpriority <> '1-URGENT'), b AS (SELECT o_custkey, o_orderdate AS k, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS bal FROM orders WHERE o_orderpriority <> '5-LOW'),
x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY o_orderkey) AS n FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, k ORDER BY o_orderkey) AS n FROM b),
j AS (SELECT coalesce(x.o_custkey, y.o_custkey) AS o_custkey, CASE WHEN x.n IS NULL OR y.n IS NULL THEN 0.0 WHEN x.bal = y.bal THEN 1.0 ELSE 0.0 END AS v FROM x FULL JOIN y ON x.o_custkey = y.o_custkey AND x.k = y.k AND x.n = y.n)
SELECT o_custkey, round(avg(v), 6) AS rate FROM j GROUP BY o_custkey""")
def model_agreement(spark, d):
    o = t(spark, d, "orders")
    b = o.where("o_orderpriority <> '5-LOW'").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    rows = ledger.agreement(o.where("o_orderpriority <> '1-URGENT'"), b, ["o_custkey"], ["o_orderdate"], "o_orderkey", "o_totalprice")
    return rows.groupBy("o_custkey").agg(r6(ledger.agreement_rate(F.col("present"), F.col("balance_agrees"))).alias("rate"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS merged, CAST(count(*) AS BIGINT) AS n FROM conversations GROUP BY conv_id")
def merge_pages(spark, d):
    c = t(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("t")))).alias("ts"), F.count("*").alias("n"))
    return c.select("conv_id", F.array_join(F.transform("ts", lambda x: x.t), "\n").alias("merged"), "n")


# --- calibration -------------------------------------------------------------------------------------------------


def _confidences(spark, d):
    return t(spark, d, "labels").select("doc_id", "quality", ((F.col("doc_id") * 37 % 101) / 100.0).alias("conf"), (F.col("doc_id") % 2).alias("model"))


_CONF_SQL = "c AS (SELECT doc_id, quality, (doc_id * 37 % 101) / 100.0::DOUBLE AS conf, doc_id % 2 AS model FROM labels), b AS (SELECT *, CASE WHEN conf < 1/10::DOUBLE THEN 0 WHEN conf < 2/10::DOUBLE THEN 1 WHEN conf < 3/10::DOUBLE THEN 2 WHEN conf < 4/10::DOUBLE THEN 3 WHEN conf < 5/10::DOUBLE THEN 4 WHEN conf < 6/10::DOUBLE THEN 5 WHEN conf < 7/10::DOUBLE THEN 6 WHEN conf < 8/10::DOUBLE THEN 7 WHEN conf < 9/10::DOUBLE THEN 8 ELSE 9 END AS bin FROM c)"


@query("WITH " + _CONF_SQL + " SELECT model, bin, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS accuracy, round(avg(conf), 6) AS confidence FROM b GROUP BY model, bin")
def reliability_bins(spark, d):
    r = calibration.reliability(_confidences(spark, d), "conf", "quality", ["model"])
    return r.where("n > 0").select("model", "bin", "n", r6("accuracy").alias("accuracy"), r6("confidence").alias("confidence"))


@query("WITH " + _CONF_SQL + ", g AS (SELECT model, bin, count(*) AS n, avg(quality) AS a, avg(conf) AS f FROM b GROUP BY model, bin) SELECT model, round(sum(n * abs(a - f)) / sum(n), 6) AS ece FROM g GROUP BY model")
def calibration_error(spark, d):
    e = calibration.calibration_error(calibration.reliability(_confidences(spark, d), "conf", "quality", ["model"]), ["model"])
    return e.select("model", r6("ece").alias("ece"))


@query("WITH " + _CONF_SQL + " SELECT model, CAST(CASE WHEN conf < 0.5 THEN 1 WHEN conf < 0.75 THEN 2 WHEN conf < 0.9 THEN 3 WHEN conf < 0.98 THEN 4 ELSE 5 END AS INTEGER) AS band, CAST(count(*) AS BIGINT) AS n, round(avg(quality), 6) AS accuracy FROM c GROUP BY ALL")
def confidence_bands(spark, d):
    return _confidences(spark, d).groupBy("model", calibration.band_of(F.col("conf")).alias("band")).agg(F.count("*").alias("n"), r6(F.avg("quality")).alias("accuracy"))


@query("WITH " + _CONF_SQL + """, g AS (SELECT model, conf, count(*) AS n, sum(quality) AS s FROM c GROUP BY model, conf), a AS (SELECT model, conf, sum(s) OVER u / sum(n) OVER u AS above, sum(s) OVER w / sum(n) OVER w AS below FROM g WINDOW u AS (PARTITION BY model ORDER BY conf ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), w AS (PARTITION BY model ORDER BY conf ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT model, min(conf) FILTER (above >= 0.9) AS t_accept FROM a GROUP BY model) SELECT model, t_accept, max(conf) FILTER (below <= 0.85 AND conf <= coalesce(t_accept, 1.0)) AS t_reject FROM a JOIN x USING (model) GROUP BY model, t_accept""")
def confidence_thresholds(spark, d):
    return calibration.thresholds(_confidences(spark, d), "conf", "quality", ["model"], target=0.9, reject=0.85)


@query("""WITH RECURSIVE s AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source) AS i FROM documents GROUP BY source), r AS (SELECT 0 AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, 0::BIGINT AS f, 0::BIGINT AS n UNION ALL SELECT s.i, list_transform(range(1, 6), lambda j: r.loads[j] + CASE WHEN j = list_position(r.loads, list_min(r.loads)) THEN s.n ELSE 0 END), list_position(r.loads, list_min(r.loads)), s.n FROM r JOIN s ON s.i = r.i + 1)
SELECT CAST(f - 1 AS INTEGER) AS fold, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS groups FROM r WHERE i > 0 GROUP BY f""")
def grouped_folds(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    return calibration.folds(docs, "source").groupBy("fold").agg(F.count("*").alias("n"), F.count_distinct("source").alias("groups"))


# --- duplicates, sampling, serving -------------------------------------------------------------------------------


@query("SELECT sha256(text) AS h, min(doc_id) AS first, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")


def _pairs(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "text")
    pairs = duplicates.circular_neighbours(docs, "source", "doc_id")
    side = lambda n, a: docs.select(F.col("doc_id").alias(n), F.array_distinct(F.split("text", " ")).alias(f"w{a}"), F.sha2("text", 256).alias(f"h{a}"))
    both = pairs.join(side("original", "1"), "original").join(side("candidate", "2"), "candidate")
    return both.select("original", "candidate", duplicates.jaccard(F.col("w1"), F.col("w2")).alias("jaccard"), (F.col("h1") == F.col("h2")).alias("same_sha"), F.when(F.col("original") % 2 == 0, "variant").otherwise("negative").alias("kind"))


_PAIRS_SQL = """n AS (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS k, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), min(doc_id) OVER (PARTITION BY source)) AS nxt FROM documents),
w AS (SELECT doc_id, list_distinct(string_split(text, ' ')) AS ws, text FROM documents), p AS (SELECT n.doc_id AS original, nxt AS candidate, len(list_intersect(a.ws, b.ws)) / CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS DOUBLE) AS jaccard, a.text = b.text AS same_sha, CASE WHEN n.doc_id % 2 = 0 THEN 'variant' ELSE 'negative' END AS kind FROM n JOIN w a ON a.doc_id = n.doc_id JOIN w b ON b.doc_id = n.nxt WHERE k > 1)"""


@query("WITH " + _PAIRS_SQL + " SELECT original, candidate, round(jaccard, 6) AS jaccard FROM p")
def row_set_overlap(spark, d):
    return _pairs(spark, d).select("original", "candidate", r6("jaccard").alias("jaccard"))


@query("WITH " + _PAIRS_SQL + " SELECT threshold::DOUBLE AS threshold, round(avg((same_sha OR jaccard >= threshold)::INT) FILTER (kind = 'variant'), 6) AS recall, round(avg((same_sha OR jaccard >= threshold)::INT) FILTER (kind = 'negative'), 6) AS fpr FROM p, (VALUES (0.05), (0.1), (0.2)) v(threshold) GROUP BY threshold")
def duplicate_sweep(spark, d):
    return duplicates.sweep(_pairs(spark, d), (0.05, 0.1, 0.2)).select("threshold", r6("recall").alias("recall"), r6("false_positive_rate").alias("fpr"))


@query("SELECT a.vec_id, CAST(len(list_filter(range(1, 65), lambda i: (a.embedding[i] > 0) <> (b.embedding[i] > 0))) AS INTEGER) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def hash_distances(spark, d):
    """Hamming distances of the sign bits of neighbouring vectors."""
    e = t(spark, d, "embeddings").select("vec_id", duplicates.sign_bits(F.col("embedding")).alias("bits"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", duplicates.hamming(F.col("bits"), F.col("other")).cast("int").alias("distance"))


@query("""WITH s AS (SELECT source, count(*) AS size FROM documents GROUP BY source), q AS (SELECT *, sum(size) OVER () AS total FROM s), f AS (SELECT source, size, total, 33 * size // total AS w, (33 * size) % total AS r FROM q), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, source) AS rk, sum(w) OVER () AS given FROM f)
SELECT source, CAST(size AS BIGINT) AS size, CAST(CASE WHEN total <= 33 THEN size ELSE w + (rk <= 33 - given)::INT END AS BIGINT) AS quota FROM k""")
def sampling_quotas(spark, d):
    return sampling.quotas(t(spark, d, "documents"), "source", 33)


@query("""WITH s AS (SELECT lang, count(*) AS size FROM documents GROUP BY lang), q AS (SELECT *, sum(size) OVER () AS total FROM s), f AS (SELECT lang, size, total, 50 * size // total AS w, (50 * size) % total AS r FROM q), k AS (SELECT *, row_number() OVER (ORDER BY r DESC, lang) AS rk, sum(w) OVER () AS given FROM f),
n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents) SELECT doc_id, lang FROM n JOIN k USING (lang) WHERE i <= w + (rk <= 50 - given)::INT""")
def stratified_sample(spark, d):
    return sampling.stratified(t(spark, d, "documents"), "lang", 50, F.col("doc_id")).select("doc_id", "lang")


@query("SELECT s_suppkey, s_nationkey, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 20")
def round_robin(spark, d):
    return sampling.round_robin(t(spark, d, "supplier"), "s_nationkey", F.col("s_suppkey"), 20).select("s_suppkey", "s_nationkey", "turn")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    r = serving.latency(t(spark, d, "events"), ["event_type"], "value", 0.5, 0.95)
    return r.select("event_type", "n", *(r6(c).alias(c) for c in ("mean", "p50", "p95")))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (event_id % 9 = 0) AS BIGINT) AS errors, round(quantile_cont(value, 0.95) FILTER (event_id % 9 <> 0), 6) AS p95 FROM events GROUP BY event_type")
def inference_summary(spark, d):
    e = t(spark, d, "events").withColumn("error", F.when(F.col("event_id") % 9 == 0, "x"))
    return serving.summary(e, ["event_type"], "error", "value").select("event_type", "pages", "errors", r6("p95").alias("p95"))


@query("SELECT user_id, round(sum(s * value), 1) AS area FROM (SELECT user_id, value, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 - epoch_us(ts) / 1e6 AS s FROM events) GROUP BY user_id")
def worker_integral(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return serving.integral(e, ["user_id"], "ts", "value").select("user_id", F.round("area", 1).alias("area"))


@query("SELECT l_returnflag, CASE WHEN bool_and(l_quantity > 25) THEN 'yes' WHEN bool_or(l_quantity > 25) THEN 'partial' ELSE 'no' END AS level FROM lineitem GROUP BY l_returnflag")
def capability_levels(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag").agg(serving.level(F.col("l_quantity") > 25).alias("level"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(max(abs(l_discount - l_tax)), 6) AS max_diff, round(max(abs(l_discount - l_tax)), 6) <= 0.01 AS comparable FROM lineitem GROUP BY l_returnflag")
def score_parity(spark, d):
    return serving.parity(t(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_tax")


@query("""SELECT c_custkey, CAST(3 AS BIGINT) AS readers, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 = 0 THEN c_name ELSE c_name END AS text, CASE WHEN c_custkey % 15 = 0 THEN 'disputed' WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 THEN 'majority' ELSE 'agree' END AS state FROM customer""")
def reader_votes(spark, d):
    c = t(spark, d, "customer")
    three = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("a").alias("reader"), F.col("c_name").alias("t")), F.struct(F.lit("b").alias("reader"), F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_name")).alias("t")), F.struct(F.lit("c").alias("reader"), F.when(F.col("c_custkey") % 5 == 0, "y").otherwise(F.col("c_name")).alias("t")))).alias("r"))
    return serving.vote(three.select("c_custkey", "r.*"), ["c_custkey"], "reader", "t")


@query("SELECT c_custkey, true AS differs FROM customer WHERE c_custkey % 7 = 0")
def review_queue(spark, d):
    """Cells on which two models differ; a share of agreements, by a hash, is tested apart."""
    c = t(spark, d, "customer")
    cells = c.select("c_custkey", F.explode(F.array(F.struct(F.lit("a").alias("model"), F.col("c_name").alias("value")), F.struct(F.lit("b").alias("model"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")).alias("value")))).alias("m")).select("c_custkey", "m.*")
    return sampling.review_queue(cells, ["c_custkey"], share=0.0).drop("values")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def ledger_totals(spark, d):
    """Filtered sums by group: the plain aggregate that statement totals are."""
    x = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


# --- replies and structure ---------------------------------------------------------------------------------------


@query("""SELECT p_partkey, CAST((p_partkey % 4 <> 3)::INT AS INTEGER) AS tables, CAST(CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 0 END AS INTEGER) AS fields, p_name AS name, '' AS parse_error FROM part""")
def parse_replies(spark, d):
    """Tables made of order lines, as HTML, pipes and cell tokens, read back by dialect."""
    p = t(spark, d, "part")
    kind = F.element_at(F.array(*map(F.lit, ("html_table", "markdown", "otsl", "json_fields"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    raw = F.when(kind == "html_table", F.concat(F.lit("<table><tr><td>"), "p_name", F.lit("</td><td>"), "p_brand", F.lit("</td></tr>"))).when(kind == "markdown", F.concat(F.lit("| "), "p_name", F.lit(" | "), "p_brand", F.lit(" |\n|---|---|\n"))).when(kind == "otsl", F.concat(F.lit("<fcel>"), "p_name", F.lit("<fcel>"), "p_brand", F.lit("<nl>"))).otherwise(F.to_json(F.struct("p_name", "p_brand")))
    page = pages.parse_page(kind, raw)
    return p.select("p_partkey", page.alias("page")).select("p_partkey", F.size("page.tables").alias("tables"), F.size("page.fields").alias("fields"), F.coalesce(F.try_element_at(F.try_element_at(F.try_element_at("page.tables", F.lit(1)), F.lit(1)), F.lit(1)), F.col("page.fields")["p_name"]).alias("name"), F.coalesce("page.parse_error", F.lit("")).alias("parse_error"))


@query("""SELECT p_partkey, round(1 - levenshtein(lower(p_brand), p_brand) / length(p_brand)::DOUBLE / 3, 6) AS teds FROM part""")
def table_similarity(spark, d):
    p = joins.spread(t(spark, d, "part"), "p_partkey")
    cell = lambda *c: F.concat(F.lit("<table><tr>"), *(F.concat(F.lit("<td>"), x, F.lit("</td>")) for x in c), F.lit("</tr></table>"))
    return p.select("p_partkey", r6(tables.teds_udf(cell(F.col("p_name"), F.lower("p_brand")), cell(F.col("p_name"), F.col("p_brand")))).alias("teds"))


@query()
def document_similarity(spark, d):
    c = t(spark, d, "conversations")
    return c.select("conv_id", "turn", r6(tables.text_similarity_udf("text", F.lower("text"))).alias("similarity"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'date' WHEN 1 THEN 'time' WHEN 2 THEN 'withdrawal' WHEN 3 THEN 'withdrawal_deposit' WHEN 4 THEN 'balance' END AS role FROM orders""")
def column_roles(spark, d):
    """Headers of each order, with its own words around them."""
    head = F.element_at(F.array(*map(F.lit, ("Date", "Time/ Eff.Date", "รายการถอน", "Withdrawal / Deposit", "Outstanding Balance", "foo"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return t(spark, d, "orders").select("o_orderkey", tables.column_role(F.concat(head, F.lit(" "), F.translate("o_orderpriority", "0123456789-", ""), F.lit(" x"))).alias("role"))