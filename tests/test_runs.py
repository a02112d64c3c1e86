import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.operators import assess, calibration, confidence, ingest, run, serving, slices
from parchment.sources import registry


def test_spans():
    tokens = ["{", '"total":', ' "', "1", "00", ".50", '"', "}"]
    assert confidence.locate_span(tokens, "100.50") == (3, 6) and confidence.locate_span(tokens, "1,00.50") == (3, 6) and confidence.locate_span(tokens, "x") is None
    assert confidence.locate_span(["a", "a"], "a") == (1, 2) and confidence.locate_span([], "a") is None and confidence.locate_span(tokens, "") is None


def plain_fit(x, y, c=1.0):
    """Ridge logistic regression by gradient descent on standardised features."""
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / np.where(sd == 0, 1, sd)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(60_000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w -= 0.5 * (z.T @ (p - y) + w / c) / len(y)
        b -= 0.5 * (p - y).mean()
    return w, b


def test_fit_is_out_of_fold(spark):
    rng = np.random.default_rng(1)
    x = np.c_[rng.normal(size=300), rng.normal(size=300) * 5 + 2, np.ones(300)]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] * 2 - 0.3)))).astype(int)
    rows = [(float(a), float(b), float(c), int(v), i % 5, i) for i, (a, b, c, v) in enumerate(zip(*x.T, y, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y int, fold int, id int")
    fits = calibration.fit_logistic(df, ["a", "b", "c"], "y", "fold")
    assert len(fits) == 6
    for m in (0, 5):
        on = np.arange(300) % 5 != m
        w, b = plain_fit(x[on], y[on])
        assert fits[m]["coef"] == pytest.approx(w, abs=1e-4) and fits[m]["intercept"] == pytest.approx(b, abs=1e-4)
    conf = {r.id: r.c2 for r in df.select("id", calibration.confidence(["a", "b", "c"], fits, F.col("fold")).alias("c2")).collect()}
    f = fits[3]
    z = ((x[3] - f["mean"]) / f["scale"]) @ np.array(f["coef"]) + f["intercept"]
    assert conf[3] == pytest.approx(1 / (1 + np.exp(-z)))


def test_folds_go_to_the_lightest(spark):
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 9, 60).tolist()
    df = spark.createDataFrame([(f"g{i:02d}", k) for i, n in enumerate(sizes) for k in range(n)] + [(None, 0)], "g string, k int")
    got = calibration.folds(df, "g").collect()
    assert len(got) == sum(sizes) + 1 and len({(r.g, r.fold) for r in got}) == 61
    loads = [0] * 5
    for n in sorted([*sizes, 1], reverse=True):
        loads[loads.index(min(loads))] += n
    assert sorted(np.bincount([r.fold for r in got]).tolist()) == sorted(loads)
    for size, count, at in ((3, 10, [0] * 5), (1, 1000, [7, 0, 3, 0, 999]), (5, 2, [1, 0, 0, 0, 0])):
        want, plan = list(at), [0] * 5
        for _ in range(count):
            j = want.index(min(want))
            want[j], plan[j] = want[j] + size, plan[j] + 1
        assert calibration.deal(at, size, count) == plan


def test_calibrate(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(120):
        good = int(rng.random() < 0.7)
        rows.append((f"s{i % 30}", "clean", "dots.ocr", f"f{i}", i % 3 == 0, good, True, False, 1, None, float(-0.1 - (1 - good) * rng.random()), -1.0, 1.0, 0.0, 0.0, 1.0))
    rows.append(("s", "clean", "other", "f", False, 1, True, False, None, None, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "sample_id string, condition string, model string, field string, is_critical boolean, label int, span_found boolean, logprobs_missing boolean, agree int, arith int, mean_logprob double, min_logprob double, agree_1 double, agree_null double, arith_1 double, arith_null double")
    c = confidence.calibrate(df, resamples=50)
    assert c.weights["other", "full"] is None and set(c.weights["dots.ocr", "full"]) == {"features", "mean", "scale", "coef", "intercept"}
    bands = c.bands.collect()
    assert len(bands) == 2 * 2 * 5 and sum(r.n for r in bands if r["table"] == "all") == 240 and sum(r.n for r in bands if r["table"] == "critical") == 80
    assert c.confidences.count() == 240 and c.thresholds.count() == 2 and c.reliability.count() == 20


def test_bootstrap_in_blocks_draws_the_same(spark):
    """Resamples drawn in blocks are those of one draw."""
    n = 3000
    cells = spark.createDataFrame([("m", f"{i:05d}", float(i % 7), 1 + i % 3) for i in range(n)], "model string, cluster string, total double, n long")
    got = slices.bootstrap_numpy(cells, ["model"], resamples=500).first()
    total, k = np.array([i % 7 for i in range(n)], float), np.array([1 + i % 3 for i in range(n)])
    pick = np.random.default_rng(42).integers(0, n, (500, n))
    lo, hi = np.percentile(total[pick].sum(1) / k[pick].sum(1), [2.5, 97.5])
    assert (got.lo, got.hi) == pytest.approx((lo, hi))


def test_misses_and_worst_cases(spark):
    way = lambda w: F.lit(w)
    df = spark.range(1).select(*(run.worst_metrics(way(w), F.lit(layer), F.lit(header), F.lit(scored)).alias(n) for n, w, layer, header, scored in (("a", "text", False, False, True), ("b", "statement", True, False, False), ("c", "statement", False, True, False), ("d", "no_gt", False, False, True))))
    r = df.first()
    assert [(m.metric, m.value) for m in r.a] == [("cer", 1.0), ("wer", 1.0), ("bmfl", 0.0), ("tob_score", 0.0)]
    assert [(m.metric, m.value, m.reason) for m in r.b] == [*((x, None, "no_header") for x in run.METRICS["statement"]), ("cer", 1.0, None)]
    assert [m.value for m in r.c] == [0.0] * 3 and [(m.metric, m.value) for m in r.d] == [("no_gt", None)]


def test_worst_case_fields_get_no_credit(spark):
    """Of a failed request a null field is no right answer, either (both sides null)."""
    from parchment.operators import scoring

    df = spark.createDataFrame([("a", None, None, True, True), ("b", None, "x", True, True), ("c", None, None, True, False)], "field string, pred string, gt string, in_gt boolean, miss boolean")
    got = {r.field: (r.field_exact, r.false_accept, r.false_reject) for r in scoring.score_fields(df, F.col("miss")).collect()}
    assert got == {"a": (0, False, False), "b": (0, False, True), "c": (1, False, False)}


def test_standard_tables(spark):
    rows = [("s1", "kie", "x", "m", "clean", "Government", None, None, "f1", 1.0), ("s2", "kie", "y", "m", "clean", "Other", None, None, "f1", 0.0), ("s3", "table", "t", "m", "photo", "Finance", None, None, "ted", 0.5), ("s4", "statement", None, "m", "clean", "Finance", "b", "digital", "cer", 0.2), ("s5", "kie", "x", "m", "clean", None, None, None, "f1", None)]
    df = spark.createDataFrame(rows, "sample_id string, task string, subtask string, model string, condition string, domain string, bank string, doc_type string, metric string, value double")
    got = {(r["table"], r.task, r.subtask, r.condition, r.bank, r.domain, r.metric): (r["mean"], r.n) for r in slices.aggregates(df, resamples=20).collect()}
    assert got["task_model", "kie", None, None, None, None, "f1"] == (0.5, 2) and got["task_subtask_model", "kie", "x", None, None, None, "f1"] == (1.0, 1)
    assert {k[0] for k in got} == {"task_model", "task_subtask_model", "condition_model", "task_condition_model", "bank_doctype_model", "domain_model"}
    assert not [k for k in got if k[0] == "task_subtask_model" and k[1] == "table"] and [k[5] for k in got if k[0] == "domain_model"].count("Other") == 0
    assert got["bank_doctype_model", None, None, None, "b", None, "cer"] == (0.2, 1)


def test_registry(spark, tmp_path):
    (tmp_path / "banks.yaml").write_text("banks: [kbank, ttb]\noverrides:\n  kbank: {amount_column_split: true}\n")
    good = "id: statement\ndescription: d\nbanks_from: banks.yaml\ncross_validators: [running_balance]\nfields:\n- {name: no, type: text, aliases: [acct], aliases_from: 'header:account_no', validators: [account_number], required_when: {bank_in: [kbank]}}\n- {name: rows, type: table, columns: {day: 'column:date'}}\n"
    (tmp_path / "c").mkdir()
    path = tmp_path / "c" / "statement.yaml"

    def load(text):
        path.write_text(text.replace("banks_from: banks.yaml", "banks_from: ../banks.yaml"))
        return registry.load_registry(str(tmp_path / "c"))["statement"]

    c = load(good)
    assert c.banks == ("kbank", "ttb") and c.rules["kbank"].amount_column_split and c.fields[0].aliases[0] == "acct" and "account no" in c.fields[0].aliases and c.fields[1].columns["day"][0] == "date"
    assert registry.dimension(spark, {"statement": c}).count() == 2
    for old, new, said in (("account_number", "nope", "unknown validators"), ("header:account_no", "header:x", "aliases_from"), ("column:date", "column:x", "known role"), ("[kbank]}}", "[zz]}}", "unknown"), ("id: statement", "id: other", "file name"), ("running_balance", "x", "cross_validators"), ("name: rows", "name: no", "duplicate"), ("type: text", "type: text, foo: 1", "unknown keys")):
        with pytest.raises(registry.ConfigError, match=said):
            load(good.replace(old, new))
    files = tmp_path / "eval_files.v2.yaml"
    files.write_text("version: 2\ntext_layer: [{file: a-1, harness_id: BS-kbank-0001, bank: kbank}]\nanchor: [{file: a-1, harness_id: BS-kbank-0001, bank: kbank}, {file: b, harness_id: BS-ttb-0002, bank: ttb}]\n")
    assert [r.file for r in registry.load_eval_files(spark, str(files)).orderBy("position").collect()] == ["a-1", "b"]
    files.write_text(files.read_text().replace("version: 2", "version: 3"))
    with pytest.raises(registry.ConfigError, match="filename says version 2"):
        registry.load_eval_files(spark, str(files))
    registry.check_plans("p", {"kie": {}, "kie@map": {"kind": "two_stage", "block": "b"}}, ["kie"])
    for plans in ({}, {"kie": {}, "x": {}}, {"kie": {"kind": "two_stage"}}):
        with pytest.raises(registry.ConfigError):
            registry.check_plans("p", plans, ["kie"])


def test_labels_fail_as_a_whole(spark):
    q = spark.createDataFrame([(2, "s", "1", "balance", "0", "1.00"), (5, "s", "1", "date", "0", "soon"), (7, "s", "1", "zzz", "0", "x")], "line int, sample_id string, page_no string, field string, row_index string, label string")
    with pytest.raises(ValueError, match="q.csv: line 5: field 'date': 'soon' is not a date"):
        ingest.load_labels(q, "q.csv")
    page = ingest.load_labels(q.where("line = 2")).first()
    assert len(page.page.rows) == 1 and float(page.page.rows[0].balance) == 1.0 and ingest.load_labels(q.where("line < 0")).count() == 0


def test_bad_answers_name_their_sample(spark):
    rows = spark.createDataFrame([(7, "q", "{broken")], "Id int, question string, answer string")
    with pytest.raises(Exception, match="TOB-KIE-7: could not parse answer"):
        ingest.to_samples(rows, F.lit("KIE"), F.lit("kie"), F.lit("x")).collect()


def test_small_reports(spark):
    one = lambda *c: tuple(spark.range(1).select(*(x.alias(str(i)) for i, x in enumerate(c))).first())
    assert one(serving.slo(F.lit(1.0), F.lit(2.0), F.lit(3.0), (1, 2, 3)), serving.slo(F.lit(None).cast("double"), F.lit(2.0), F.lit(3.0), (1, 2, 3)), serving.slo(F.lit(1.1), F.lit(2.0), F.lit(3.0), (1, 2, 3))) == ("met", "missed", "missed")
    assert one(serving.billed_workers(F.create_map(F.lit("running"), F.lit(2), F.lit("initializing"), F.lit(3)), 4), serving.billed_workers(F.create_map(F.lit("idle"), F.lit(2)))) == (4, 0)
    gpus = spark.createDataFrame([("a", "p", 1.0), ("b", "p", 2.0), ("c", "q", 9.0)], "id string, pool string, price double")
    assert serving.top_price(gpus, ["p"], ["b"]).first().price == 1.0
    assert one(F.array_join(ingest.coverage_warnings(F.lit(1), F.lit(9), F.lit(0), F.lit(1), (2, 3, 2, 2)), ";")) == ("only 1 digital pages with a usable text layer (< 2); Check A is weakened;only 0 banks (< 2);only 1 multi-page statements (< 2)",)
    with pytest.raises(ValueError, match="no such operation"):
        assess.compute("power", F.lit(1), F.lit(2))
    assert one(assess.compute("divide", F.lit(1), F.lit(0)), assess.compute("add", F.lit("0.10"), F.lit("0.20")).cast("string"))[0] is None
    assert one(assess.unknown_flags(F.array(F.lit("page_gap"), F.lit("x")))) == (["x"],)
    assert "json_fields" in assess.register(spark) and spark.sql("SELECT json_fields('{\"a\": 1}')['a']").first()[0] == "1"
    assert [tuple(r) for r in spark.sql("SELECT * FROM reply_fields('{\"a\": [1]}')").collect()] == [("a[0]", "1")]


def test_review_sample_is_a_share(spark):
    cells = spark.range(4000).select("id", F.explode(F.array(F.lit("m"), F.lit("n"))).alias("model"), F.lit("x").alias("value"))
    from parchment.operators import sampling

    n = sampling.review_queue(cells, ["id"], 0.1).count()
    assert 300 < n < 500 and n == sampling.review_queue(cells, ["id"], 0.1).count() and sampling.review_queue(cells, ["id"], 0.0).count() == 0
