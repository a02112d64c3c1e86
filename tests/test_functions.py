import pytest
from pyspark.sql import functions as F

from parchment.functions import fields, official, pages, tables, text
from parchment.operators import calibration, duplicates, joins, ledger, sampling, scoring, serving, slices
from parchment.sources import io


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_canonical_and_plain_text(spark):
    got = one(spark, text.canonical_text(F.lit("  ๑๒​ é\n x ")), text.plain_text(F.lit("# A\n|b|c|\n|---|---|\n<b>d</b>&amp;<br>**e** f_g $$x$$<figure>z</figure>")), text.canonical_text(F.lit("")))
    assert got == ("12 é x", "A b c d& e f_g x", "่")


def test_error_rates(spark):
    L = F.lit
    w = lambda a, b: text.wer(text.tokens(L(a)), text.tokens(L(b)))
    assert one(spark, text.cer(L("abd"), L("abc")), text.cer(L("xxxx"), L("")), w("a b c", "a x c"), w("", "a"), text.anls(L("ABC"), L("abc")), text.anls(L(""), L("")), text.anls(L("a"), L("xyz"))) == (pytest.approx(1 / 3), 1.0, pytest.approx(1 / 3), 1.0, 1.0, 1.0, 0.0)


def test_lenient_is_a_whole_token(spark):
    L = F.lit
    assert one(spark, text.lenient(L("Price: 5 บาท"), L("5")), text.lenient(L("25"), L("5")), text.lenient(L("5.5"), L("5")), text.lenient(L("a" * 50 + " 5"), L("5")), text.lenient(L("5"), L(""))) == (True, False, False, False, False)


def test_small_text_functions(spark):
    L = F.lit
    loop = "x" * 8000 + "abc" * 100
    got = one(spark, text.answer_text(L(" A b\nC ")), text.file_id(L("TTB-1-p12")), text.fix_equation(L(r"\[ x \]")), text.fix_equation(L("$x$")), text.cut_repeated_tail(L(loop)), text.null_if_blank(L("  ")), text.cut_repeated_tail(L("short")))
    assert got == ("abc", "TTB-1", "$$\nx\n$$", "$x$", "x" * 8000 + "abc", None, "short")


@pytest.mark.parametrize(
    ("raw", "want"),
    [("31/12/2567", "2024-12-31"), ("1-2-58", "2015-02-01"), ("1.2.24", "2024-02-01"), ("2024-02-30", None), ("5 มกราคม 2567", "2024-01-05"), ("5 ม.ค. 67", "2024-01-05"), ("Sept 3, 2021", "2021-09-03"), ("x", None), ("", None)],
)
def test_dates(spark, raw, want):
    assert one(spark, fields.parse_date(F.lit(raw)))[0] == want


@pytest.mark.parametrize(("raw", "want"), [("1,000.00 บาท", "1000"), ("฿12.50", "12.5"), ("5.-", "5"), ("1e3", "1000"), ("abc", None), ("NaN", None), ("-0.0", "0"), ("12-", "12")])
def test_amounts(spark, raw, want):
    assert one(spark, fields.parse_amount(F.lit(raw)))[0] == want


def test_money_and_types(spark):
    L = F.lit
    m = lambda x: fields.parse_money(L(x))
    got = one(spark, m("(1,200.50)"), m("300 CR"), m("300 DR"), m("+5"), m("5"), m("-"), m("x"))
    assert [(None if g[0] is None else float(g[0]), g[1]) for g in got] == [(1200.5, "debit"), (300.0, "credit"), (300.0, "debit"), (5.0, "credit"), (5.0, None), (None, None), (None, None)]
    t = lambda k, v: fields.field_type(L(k), L(v))
    assert one(spark, t("วันที่", "x"), t("ยอดเงินในบัญชี", "x"), t("ชื่อบัญชี", "x"), t("บัญชี", "x"), t("k", "123-4-56789-0"), t("k", "1,234.50"), t("k", "1/1/2020"), t("k", "z")) == ("date", "amount", "name", "account", "account", "amount", "date", "other")
    n = one(spark, fields.normalize_field(L("date"), L("soon")), fields.normalize_field(L("date"), F.lit(None).cast("string")))
    assert n[0].value == "soon" and n[0].flags == ["unparsed_date"] and n[1].value is None and n[1].flags == []
    assert one(spark, fields.is_opening_text(L("ยอดยกมา B/F")), fields.is_opening_text(F.lit(None).cast("string"))) == (True, False)


def test_field_scores(spark):
    df = spark.createDataFrame([("a", None, None, True), ("b", "x", None, True), ("c", None, "x", True), ("d", "1000", "1000", True), ("e", "z", None, False), ("f", "Price: 5 Baht", "5", True)], "field string, pred string, gt string, in_gt boolean")
    got = {r.field: (r.field_exact, r.field_fuzzy, r.field_lenient, r.false_accept, r.false_reject) for r in scoring.score_fields(df).collect()}
    assert got == {"a": (1, 1, 1, False, False), "b": (0, 0, 0, True, False), "c": (0, 0, 0, False, True), "d": (1, 1, 1, False, False), "e": (0, 0, 0, True, False), "f": (0, 0, 1, False, False)}


def ledger_of(spark, rows, opening=None, closing=None):
    r = spark.createDataFrame([("f", p, i, d, *m) for i, (p, d, *m) in enumerate(rows)], "k string, page_no int, pos int, date string, debit double, credit double, amount double, balance double")
    pages = spark.createDataFrame([("f", 1, opening, closing, None, None)], "k string, page_no int, opening_balance double, closing_balance double, total_debit double, total_credit double")
    return ledger.check_files(r, pages, ["k"]).first()


def test_ledger_folds(spark):
    chain = [(1, "2024-01-01", None, 10.0, None, 110.0), (1, "2024-01-02", 20.0, None, None, 90.0), (2, "2024-01-03", None, 5.0, None, 95.0)]
    good = ledger_of(spark, chain, 100.0, 95.0)
    assert good.file_reconciles and good.row_consistency_rate == 1.0 and float(good.sum_credit) == 15.0 and not good.newest_first
    back = ledger_of(spark, [(1, *c[1:]) for c in chain[::-1]], 100.0, 95.0)
    assert back.newest_first and back.file_reconciles
    wrong = ledger_of(spark, [chain[0], (*chain[1][:5], 91.0), chain[2]], 100.0, 96.0)
    assert wrong.balance_mismatch_rows == [2, 3] and wrong.first_break_row == 2 and wrong.flags == ["balance_mismatch", "total_mismatch", "page_gap"]
    side = ledger_of(spark, [(1, "2024-01-01", None, None, 10.0, 110.0), (1, "2024-01-02", None, None, 7.0, 90.0)], 100.0)
    assert side.checks[0].inferred and side.checks[0].consistent is None and side.balance_mismatch_rows == [2]
    derived = ledger_of(spark, chain[:2])
    assert derived.checks[0].consistent is None and derived.row_consistency_rate == 1.0
    empty = ledger_of(spark, [], 5.0)
    assert empty.n_rows == 0 and empty.row_consistency_rate is None and empty.file_reconciles


def test_joins(spark):
    log = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, None)], "k string, seq int, error string")
    assert sorted((r.k, r.seq) for r in joins.latest(log, ["k"], "seq").collect()) == [("a", 2), ("b", 1)]
    want = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert sorted(r.k for r in joins.pending(want, joins.latest(log, ["k"], "seq"), ["k"], "error").collect()) == ["a", "c"]
    assert one(spark, joins.is_partial(F.lit("1 of 3 blocks failed"), F.lit("x")), joins.is_full_miss(F.lit(False), F.lit("1 of 3 blocks failed"), F.lit(" ")), joins.is_full_miss(F.lit(False), F.lit(None).cast("string"), F.lit(""))) == (True, True, False)
    assert one(spark, *joins.prf(F.lit(0), F.lit(0), F.lit(0))) == (1.0, 1.0, 1.0)


def test_bootstraps(spark):
    cells = spark.createDataFrame([("m", str(i), float(i % 2), 1) for i in range(60)], "model string, cluster string, total double, n long")
    a, b = slices.bootstrap_numpy(cells, ["model"]).first(), slices.bootstrap(cells, ["model"]).first()
    for r in (a, b):
        assert r["mean"] == 0.5 and r.n == 60 and 0.3 < r.lo < 0.5 < r.hi < 0.7


def test_calibration(spark):
    df = spark.createDataFrame([(0.1, 0), (0.3, 0), (0.9, 1), (1.0, 1)], "conf double, label int").withColumn("m", F.lit("x"))
    bins = calibration.reliability(df, "conf", "label", ["m"])
    assert bins.count() == 10 and {r.bin: r.n for r in bins.collect()}[9] == 2
    assert calibration.calibration_error(bins, ["m"]).first().ece == pytest.approx((0.1 + 0.3 + 0.1) / 4)
    t = calibration.thresholds(df, "conf", "label", ["m"]).first()
    assert (t.t_accept, t.t_reject) == (0.9, 0.9)
    assert calibration.enough(50, 5, 2) and not calibration.enough(49, 5, 2)
    assert one(spark, calibration.span_features(F.array(*map(F.lit, (-1.0, -3.0, -2.0))), F.lit(2), F.lit(2)))[0] == (-2.5, -3.0)


def test_duplicates_and_votes(spark):
    L = F.lit
    assert one(spark, duplicates.jaccard(F.array(L(1), L(2)), F.array(L(2), L(3))), duplicates.jaccard(F.array().cast("array<int>"), F.array(L(1))), duplicates.hamming(L(5), L(6))) == (pytest.approx(1 / 3), 0.0, 2)
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "x"), (1, "c", "y"), (2, "a", "p"), (2, "b", "q"), (3, "a", "z")], "k int, r string, t string")
    assert {r.k: (r.text, r.state) for r in serving.vote(df, ["k"], "r", "t").collect()} == {1: ("x", "majority"), 2: ("p", "disputed"), 3: ("z", "single_source")}
    dense = sampling.dense(spark.createDataFrame([("a", 2, "x")], "k string, i int, v string"), ["k"], "i")
    assert sorted((r.i, r.v) for r in dense.collect()) == [(0, None), (1, None), (2, "x")]


def test_edit_distance():
    def plain(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(plain(a[1:], b) + 1, plain(a, b[1:]) + 1, plain(a[1:], b[1:]) + (a[0] != b[0]))

    words = ["", "a", "ab", "ba", "abcab", "acbba", "bbbbb", "cabac"]
    assert all(tables.edit_distance(a, b) == plain(a, b) for a in words for b in words)
    assert tables.edit_distance("x" * 50_000 + "ab", "y" + "x" * 50_000) == 3


def test_tables():
    assert tables.html_tables("<table><tr><td>a<td>b</tr><tr><th>c") == [[["a", "b"], ["c"]]]
    assert tables.pipe_tables("x\n|a|b|\n|---|---|\n|c|d|\ny") == [[["a", "b"], ["c", "d"]]] and tables.pipe_tables("|---|---|") == [] and tables.pipe_tables("|a|b|\n|c|d|") == []
    assert tables.otsl_html("<fcel>a<lcel><nl><ucel><fcel>b<nl>") == '<table><tr><td colspan="2" rowspan="2">a</td></tr><tr><td>b</td></tr></table>'
    assert tables.json_fields('```json\n{"a": {"b": [1, true]}, "c": "x",}\n```') == ({"a.b[0]": "1", "a.b[1]": "true", "c": "x"}, None)
    assert tables.json_fields('{"p": 1,000.00}') == ({"p": "1,000.00"}, "quoted bare numbers")
    assert tables.json_fields('{"p": "x", "q": "y')[0] == {"p": "x"}
    assert pages.whole_items('[{"a": 1}, {"b"') == ([{"a": 1}], "truncated JSON: salvaged 1 complete blocks")
    one_, two = "<table><tr><td>a</td><td>b</td></tr></table>", "<table><tr><td>a</td></tr></table>"
    assert tables.teds(one_, one_) == 1.0 and tables.teds(two, one_) == pytest.approx(1 - 1 / 3) and tables.teds("", one_) == 0.0
    assert tables.document_similarity("# a\nb", "# a\nb") == 1.0
    assert tables.bleu("a b c d e".split(), "a b c d e".split()) == pytest.approx(1.0)


@pytest.mark.parametrize("kind", [*pages.PARSERS, "other"])
@pytest.mark.parametrize("raw", ["", "{", "<table><tr><td>x", "<box:1 2", "```json\n[{", "[1, null]", '{"prunedResult": 3}', None])
def test_malformed_replies_never_raise(kind, raw):
    assert pages.parse(kind, raw).keys() == set(pages.PAGE.names)


def test_dialects():
    p = pages.parse("typhoon_markdown", "# T\n<figure>f</figure>\n<page_number>3</page_number>\n<table><tr><td>1</td></tr></table>")
    assert p["tables"] == [[["1"]]] and [b["type"] for b in p["blocks"]] == ["table", "figure", "footer"] and "<page_number>" not in p["text"] and "3" in p["text"]
    p = pages.parse("ovis_markdown", '<img src="images/bbox_0_0_500_500.jpg" />\n\nhello', pages.Sizes(original=(200, 100)))
    assert p["text"] == "hello" and p["blocks"][0]["box"] == {"x0": 0, "y0": 0, "x1": 100, "y1": 50}
    p = pages.parse("teleocr_layout", "<box:0 0 10 10><label:text><up>\n<box:0 0 10 10><label:list><up>\n<box:0 0 2000 1><label:text><up>\nx", pages.Sizes(original=(100, 100)))
    assert [b["box"]["x1"] for b in p["blocks"]] == [1.0] and p["parse_error"] is None and len(pages.layout_lines("x\n<box:0 0 10><label:text><up>")[1]) == 2
    p = pages.parse("json_fields", "a label", pages.Sizes("classify"))
    assert p["label"] == "a label" and pages.parse("json_fields", "{}")["fields"] == {}
    assert pages.parse("markdown", "|a|b|\n|---|---|\n|1|<2|")["blocks"][0]["text"].count("&lt;") == 1
    assert pages.answer_table_html(" <tr><td>1</td></tr>") == "<table><tr><td>1</td></tr></table>" and pages.answer_table_html("|a|\n|---|\n|b|") == "<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>b</td></tr></tbody></table>"
    assert pages.grounding_text('[{"text": "a"}, {"text": "b') == "a b" and pages.grounding_text("x") == "x"
    assert pages.table_markdown([["a|", "b"], ["c"]]) == "| a\\| | b |\n| --- | --- |\n| c |  |"


def test_table_trees():
    """Elements are counted with wrappers where those matter, and cells compared by characters and inner tags."""
    a, b = "<table><thead><tr><th>x</th></tr></thead><tbody><tr><td>ab</td></tr></tbody></table>", "<table><tr><td>x</td></tr><tr><td>ab</td></tr></table>"
    assert tables.teds(a, b) == 1.0 and tables.table_similarity(a, b) < 1.0
    bold = "<table><tr><td><b>ab</b></td></tr></table>"
    plain = "<table><tr><td>ab</td></tr></table>"
    assert tables.table_similarity(bold, plain) == pytest.approx(1 - (2 / 4) / 3)
    assert tables.table_similarity(bold, plain, structure_only=True) == 1.0
    assert tables.teds("<table><tr><td>x", plain) == 0.0 and tables.table_similarity('<table><tr><td colspan="2">ab</td></tr></table>', plain) == pytest.approx(1 - 1 / 2)
    assert tables.pre_clean("<bos>**a** _b_ \\begin {x }") == "  a    b  \\begin{x}"


def test_long_tails_and_answers(spark):
    body = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(3000))[:8000]
    unit = "0123456789abcdefXYZ"
    assert text.cut_tail(body + unit * 5 + unit[:6]) == body + unit + unit[:6]
    assert text.cut_tail(body + unit * 4 + unit[:6]) == body + unit * 4 + unit[:6] and text.cut_tail(unit * 10) == unit * 10
    assert text.cut_tail("x" * 9000) == "x"
    assert one(spark, text.answer_text(F.lit("\tAb c\n d\u00a0"))) == ("abcd",)
    kinds = {"1,234.50 บาท": "amount", "฿5": "amount", "5.-": "amount", "-5": "other", "$ 3": "amount", "5 THB": "amount", "5-": "amount", "123-4-56789-0": "account", "x": "other"}
    assert one(spark, *(fields.field_type(F.lit("k"), F.lit(v)) for v in kinds)) == tuple(kinds.values())


def test_official_scores():
    assert official.short_answer("It is Paris.", "paris") == 1.0 and official.short_answer("parix", "paris") == 0.8 and official.short_answer("q", "paris") == 0.0
    assert official.short_answer("b", "['a', 'b']") == 1.0 and official.short_answer("x", "a,b,c,d") == 0.0 and official.short_answer("a,b,c,e", "['a,b,c,d']") == pytest.approx(1 - 1 / 7)
    assert official.reply_dict('```json\n{"a": 1}\n```') == {"a": "1"} and official.reply_dict("{'a': None}") == {"a": "None"} and official.reply_dict("a: 1\nb = 'x y'") == {"a": "1", "b": "x y"} and official.reply_dict("[1]") == {}
    assert official.dict_f1({"a": "X ", "b": "1"}, {"a": "x", "c": None}) == 0.5 and official.dict_f1({}, {}) == 0.0
    assert official.field_score('{"a": "2", "b": "y"}', '{"a": ["1", "2"], "b": ["x", "y"]}') == 1.0 and len(official.alternatives({"a": ["1", "2"], "b": ["x", "y"], "c": 3})) == 4
    assert official.field_score("{}", "not a dict") == 0.0 and official.official_score("Table parsing", "no table", "<table></table>") == 0.0 and official.official_score("x", "a", "a") is None and official.official_score("Text recognition", None, "a") == 0.0
    best = max(official.dict_f1({"a": "2"}, x) for x in official.alternatives({"a": ["1", "2"], "b": ["x", None]}))
    assert official.field_score('{"a": "2"}', '{"a": ["1", "2"], "b": ["x", null]}') == best


def test_word_error_by_brute_force(spark):
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, before = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(before[j] + 1, d[-1] + 1, before[j - 1] + (x != y)))
        return d[-1]

    pairs = [("a b c", "a c"), ("", "x"), ("x y", ""), ("the cat sat", "the cat sat on the mat"), ("b a", "a b"), ("q", "q")]
    df = spark.createDataFrame(pairs, "p string, t string")
    got = [r[0] for r in df.select(text.wer(text.tokens(F.col("p")), text.tokens(F.col("t")))).collect()]
    assert got == pytest.approx([min(1.0, plain(p.split(), t.split()) / max(1, len(t.split()))) for p, t in pairs])


def test_roles(spark):
    assert one(spark, tables.column_role(F.lit("รายการถอน")), tables.column_role(F.lit("Time/ Eff.Date")), tables.column_role(F.lit("Withdrawal / Deposit")), tables.column_role(F.lit("x"))) == ("withdrawal", "time", "withdrawal_deposit", None)


def test_sources(spark, tmp_path):
    schema = spark.range(0).select("id", F.lit("").alias("v")).schema
    path = str(tmp_path / "rows")
    io.append_rows(spark.createDataFrame([(1, "a")], schema), path)
    io.append_rows(spark.createDataFrame([(2, "b")], schema), path)
    assert io.read_rows(spark, path, schema).count() == 2
    io.overwrite_rows(spark.createDataFrame([(3, "c"), (1, "d")], schema), path, "id")
    assert [r.id for r in io.read_rows(spark, path, schema).collect()] == [1, 3]
    (tmp_path / "bad.json").write_text('{"id": "x"}\n\n{"id": 1}\n')
    (tmp_path / "bad.json").write_text('{"id": 1}\n\n{"id": "x"}\n{"id": 2, "more": 1}\n')
    assert sorted((r.number, r.line) for r in io.bad_rows(spark, str(tmp_path / "bad.json"), schema).collect()) == [(3, '{"id": "x"}'), (4, '{"id": 2, "more": 1}')]
    with pytest.raises(ValueError, match=r"bad.json:3: "):
        io.check_rows(spark, str(tmp_path / "bad.json"), schema)
    with pytest.raises(Exception):  # noqa: B017
        io.read_rows(spark, str(tmp_path / "bad.json"), schema).collect()
    assert io.config_hash({"b": 1, "a": "é"}) == io.config_hash({"a": "é", "b": 1}) and len(io.config_hash({})) == 16
    got = one(spark, io.route(F.lit("X/KTB-1.pdf"), [("*ktb*", "ktb"), ("*", "other")]), io.route(F.lit("a"), [("b*", "b")]))
    assert got == ("ktb", None)
    queue = spark.createDataFrame([("s", "m1", "1"), ("s", "m2", "2")], "sample_id string, model string, value string")
    io.write_queue(queue, str(tmp_path / "q"), ["sample_id"], ["m1", "m2"])
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).columns == ["sample_id", "m1_value", "m2_value", "label"]
    assert io.read_labels(spark, str(tmp_path / "q"), ["sample_id"]).count() == 0


def test_streams(spark, tmp_path):
    from parchment.streaming import log

    schema = "k string, seq int"
    for i, rows in enumerate(([("a", 1), ("b", 1)], [("a", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        log.latest_view(stream, ["k"], "seq", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert sorted((r.k, r.seq) for r in log.read_view(spark, str(tmp_path / "out")).collect()) == [[("a", 1), ("b", 1)], [("a", 2), ("b", 1)]][i]
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    done = spark.createDataFrame([("a", None), ("b", "failed")], "k string, error string")
    log.resume(stream, done, ["k"]).writeStream.format("memory").queryName("todo").trigger(availableNow=True).start().awaitTermination()
    assert [r.k for r in spark.table("todo").collect()] == ["b"]


def test_stores_and_documents(spark, tmp_path):
    for name in ("b/x.PDF", "a.pdf", "c.txt"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_bytes(b"1")
    assert [r.path.rsplit("/", 1)[1] for r in io.read_documents(spark, str(tmp_path / "docs"), ".pdf").collect()] == ["a.pdf", "x.PDF"]
    store, calls = io.ArtifactStore(spark, str(tmp_path / "store")), []

    def compute(df):
        calls.append(sorted(r.doc_id for r in df.collect()))
        return df.select("doc_id", F.upper("payload").alias("payload"))

    df = spark.createDataFrame([("d1", "a"), ("d2", "b")], "doc_id string, payload string")
    read = lambda x, c: sorted(tuple(r) for r in store.run("s", x, c, compute).collect())
    assert read(df, {"v": 1}) == [("d1", "A"), ("d2", "B")] == read(df, {"v": 1})
    changed = spark.createDataFrame([("d1", "z"), ("d2", "b")], df.schema)
    assert read(changed, {"v": 1}) == [("d1", "Z"), ("d2", "B")] and read(changed, {"v": 2}) == [("d1", "Z"), ("d2", "B")]
    assert calls == [["d1", "d2"], [], ["d1"], ["d1", "d2"]]
    assert io.write_documents(df, str(tmp_path / "doc"), "doc_id") == 2
    with pytest.raises(Exception, match="secret"):
        io.refuse_secrets(df, "^a$").collect()
    assert io.refuse_secrets(df, "nothing").count() == 2 and io.done_ids(spark.createDataFrame([("1", None), ("2", "x")], "id string, error string")).count() == 1
    assert one(spark, io.pdf_route(F.lit("name\n----\nArial")), io.pdf_route(F.lit("name\n----\n"))) == ("digital", "scanned")


def test_ledgers_on_odd_pages(spark):
    rows = spark.createDataFrame([("f", 1, 0, "2024-01-01", None, 5.0, None, 15.0), ("f", None, 0, "2024-01-02", 1.0, None, None, 14.0), ("f", 2, 0, None, None, 1.0, None, None), ("f", 2, 1, None, None, 1.0, None, 17.0)], "k string, page_no int, pos int, date string, debit double, credit double, amount double, balance double")
    pages_ = spark.createDataFrame([("f", 1, 10.0), ("f", 1, 10.0), ("f", None, 3.0), ("f", 2, None)], "k string, page_no int, opening_balance double").withColumns({c: F.lit(None).cast("double") for c in ("closing_balance", "total_debit", "total_credit")})
    got = ledger.check_files(rows, pages_, ["k"]).first()
    assert got.n_rows == 4 and sorted(c.page_row_index for c in got.checks if c.page_no == 2) == [0, 1]


def test_joins_keep_users_columns(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, rank int, _rank string")
    assert joins.latest(log, ["k"], "rank").first().asDict() == {"k": "a", "rank": 2, "_rank": "y"}
    m = spark.createDataFrame([("a",), ("b",)], "k string")
    p = spark.createDataFrame([("a", "m", 1), ("a", "m", 1)], "k string, model string, found int")
    got = joins.with_predictions(m, p, ["k"], ["m"]).collect()
    assert sorted((r.k, r.found, r.missing) for r in got) == [("a", 1, False), ("b", None, True)]
    side = lambda v: spark.createDataFrame([(None, "f", v)], "k string, field string, value string")
    assert [tuple(r) for r in joins.field_pairs(side("x"), side("y"), ["k"]).collect()] == [(None, "f", "x", "y", True, True)]
    twice = spark.createDataFrame([("a", "m", "1"), ("a", "m", "2"), ("a", "n", "2")], "k string, model string, value string")
    assert sampling.review_queue(twice, ["k"], share=1.0).first()["values"] == {"m": "2", "n": "2"}
