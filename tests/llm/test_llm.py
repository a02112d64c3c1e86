import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from parchment.llm import chat, decontamination, packing, quality, queries, simhash, substrings, suffix_tree, topk, toxicity, warc
from parchment.llm.common import RollingHash, Scratch
from parchment.llm.graph import components, local_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, score double, fp long, words string, spans int, row int"
SHAPES = "doc_id long, text string, lang string, source string, n_chars long"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and extra columns with names that operators use."""
    rnd = random.Random(3)
    passage = " ".join(rnd.choice(["the", "of", "straße", "ör", "x1", "Abc"]) + str(rnd.randrange(99)) for _ in range(60))
    texts = [None, "", "  \n", "one two", "One  TWO", passage, passage, f"a {passage} b", f"{passage}\n{passage}", "é" * 700, "long " * 40000, "you idiot1 trash", *(" ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rnd.randrange(1, 90))) for _ in range(40))]
    rows = [(i, t, 1.5, 7, "w", 3, 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], (None, "lost", None, None, None, None, None), (None, None, 0.0, 0, "", 0, 0)], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    plain = lambda v: None if v is None or str(v) in ("<NA>", "nan") else str(int(v)) if isinstance(v, float) or hasattr(v, "dtype") else str(v)
    rows = lambda p: sorted(repr([plain(v) for v in r]) for r in p[sorted(p.columns)].itertuples(index=False))
    for name, sql in queries.ORACLE_SQL.items():
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(sql).fetchdf()), name


def test_toxicity_folds_and_matches():
    assert toxicity.fold("Іdi0t! 1d1ot ＩＤＩＯＴ st@p 100") == " idiot idiot idiot stap "
    lex = toxicity.Lexicon({"idio": 2.0, "ass": 1.0}, frozenset({"assessment", "kick ass"}))
    a = lex.automaton()
    w = lambda t: toxicity.weigh(toxicity.fold(t), a)
    assert w("you id1ot") == (2.0, 2) and w("assessment") == (0.0, 1) and w("kick ass now") == (0.0, 3) and w("class") == (0.0, 1) and w("ass") == (1.0, 1) and w("") == (0.0, 0)


def test_toxicity_operator(spark, odd, none, sf):
    lex = toxicity.Lexicon({"idio": 5.0, "tras": 5.0})
    got = {r.doc_id: r.score for r in toxicity.score(odd, lex).collect()}
    assert got[11] > 0.5 and all(s < 0.5 for i, s in got.items() if i != 11)
    assert toxicity.score(none, lex).count() == 0
    empty = toxicity.learn(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert not empty.weights
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.learn(docs, labels)).join(labels, "doc_id").select("doc_id", "score", "toxic").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == r.toxic for r in held) / len(held) > 0.9


def test_quality(spark, odd, none, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    forest = quality.learn(docs, labels)
    found = quality.score(docs, forest).join(labels, "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == r.quality for r in held) / len(held) > 0.9
    assert quality.score(odd, forest).count() == odd.count() and quality.score(none, forest).count() == 0
    flat = quality.boost(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert flat.predict(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    x = np.random.default_rng(0).random((500, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    f = quality.boost(x, y)
    assert ((f.predict(x) > 0.5) == y).mean() > 0.97


def plain_tree(texts, learn, support, depth, divergence, discount):
    """log10 probability of each text by a suffix tree of dicts: contexts are tuples of words."""
    seqs = [[*words(t), "\n"] for t in texts]
    c = collections.Counter(w for s, on in zip(seqs, learn, strict=True) if on for w in s)
    whole = sum(c.values()) + len(c) + 1
    root = lambda w: (c[w] + 1) / whole
    history = lambda s, i, k: tuple(s[i - k : i]) if i >= k else ("\n", *s[:i]) if i == k - 1 else None
    grams = [None, *(collections.Counter(h + (s[i],) for s, on in zip(seqs, learn, strict=True) if on for i in range(len(s)) if (h := history(s, i, k))) for k in range(1, depth + 1))]
    often = lambda g: c[g[0]] >= support if len(g) == 1 else grams[len(g) - 1][g] >= support
    states: dict = {}

    def p(h, w):
        if not h:
            return root(w)
        short = p(h[1:], w)
        return states[h][1].get(w, 0.0) + states[h][0] * short if h in states else short

    for k in range(1, depth + 1):
        held = collections.defaultdict(dict)
        for g, n in grams[k].items():
            if n >= support and often(g[:-1]) and c[g[-1]] >= support:
                held[g[:-1]][g[-1]] = n
        for h, ws in held.items():
            # How often a context occurs is how often its words do; one that opens a text is the end's, or an entry's.
            of = c[h[0]] if k == 1 else grams[k - 1][h]
            add = {w: (n - discount) / of for w, n in ws.items()}
            keep = max(1 - sum(add.values()), 1e-9)
            gain = sum(n * math.log((add[w] + keep * p(h[1:], w)) / p(h[1:], w)) for w, n in ws.items()) + (of - sum(ws.values())) * math.log(keep)
            if gain >= divergence:
                states[h] = (keep, add)
    out = []
    for s in seqs:
        total = 0.0
        for i, w in enumerate(s):
            h = next((h for k in range(depth, 0, -1) if (h := history(s, i, k)) and all(often(h[: j + 1]) for j in range(len(h)))), ())
            total += math.log10(p(h, w))
        out.append(total)
    return out, len(states)


@pytest.mark.parametrize(("support", "depth", "block"), [(2, 3, 3000), (3, 2, 1 << 20), (2, 0, 500)])
def test_suffix_tree(spark, odd, none, support, depth, block):
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(False))
    got = suffix_tree.lm_score(odd, learn, support=support, depth=depth, divergence=1.0, block_bytes=block, part_keys=300).collect()
    rows = odd.select("doc_id", "text").collect()
    on = [r.doc_id is not None and r.doc_id % 3 != 0 for r in rows]
    c = collections.Counter(w for r, x in zip(rows, on, strict=True) if x for w in [*words(r.text), "\n"])
    n, v = sum(c.values()), len(c)
    scores, states = plain_tree([r.text for r in rows], on, support, depth, 1.0, suffix_tree.DISCOUNT)
    assert states > 20 or not depth
    want = sorted((str(r.doc_id), len(words(r.text)) + 1, sum(c[w] > 0 for w in [*words(r.text), "\n"]), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(r.text), "\n"]), 6)) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    near = lambda x: sorted(x, key=lambda t: (t[0], t[1]))
    for (a, s, k), (b, t) in zip(near((str(r.doc_id), r.score, r.n_tokens) for r in got), near((str(r.doc_id), s) for r, s in zip(rows, scores, strict=True)), strict=True):
        assert a == b and s == pytest.approx(t, abs=1e-5 + 1e-7 * k)  # between steps probabilities have 24 bits
    assert {r.train_tokens for r in got} == {n} and sum(r.score for r in got) >= sum(r.base_score for r in got) - 1e-6


def test_suffix_tree_without_text(spark, odd, none):
    assert suffix_tree.lm_score(none, F.lit(True)).count() == 0
    untaught = suffix_tree.lm_score(odd, F.lit(False)).collect()
    assert {(r.train_tokens, r.base_score, r.score) for r in untaught} == {(0, 0.0, 0.0)}


def test_chat_folds_events(spark):
    ev = [("a", 1, "message", 1, "user", "hi"), ("a", 2, "delta", 2, "assistant", "he"), ("a", 3, "delta", 2, None, "llo"), ("a", 4, "message", 3, "user", "more"), ("a", 5, "edit", 1, None, "hi!"), ("a", 6, "regenerate", 2, "assistant", "bye"), ("a", 7, "delta", 2, None, None), ("a", 8, "message", 3, "user", "x"), ("a", 9, "delete", 3, None, None), (None, 1, "message", 1, None, None)]
    df = spark.createDataFrame(ev, "conv_id string, seq long, op string, msg long, role string, text string")
    got = sorted((str(r.conv_id), r.msg, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [("None", 1, "", ""), ("a", 1, "user", "hi!"), ("a", 2, "assistant", "bye")]
    with pytest.raises(Exception, match="unknown op"):
        chat.fold(spark.createDataFrame([("a", 1, "zap", 1, "u", "t")], df.schema)).collect()


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user\n", "\\", "\\<|", "<\\|end|>", "a\\n\nb", "", None, "<<SYS>>", "[[INST]]", "<", "é€😀"]
    rows = [(i % 3, i, r, t) for i, t in enumerate(texts) for r in ("user", "assi\nst\\nant", "assistant", None)]
    df = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string")
    back = chat.parse(chat.render(chat.fold(chat.rows_as_events(df)))).collect()
    key = lambda x: (x[1], x[2] or "", x[3] or "")
    for r in back:
        want = [(a or "", b or "") for _, _, a, b in sorted((x for x in [*rows, rows[0]] if x[0] == r.conv_id), key=key)]
        assert [(t.role, t.text) for t in r.turns] == want
        assert "[INST]" not in r.formatted and "</s>" not in r.formatted
    assert chat.parse(chat.render(chat.fold(chat.rows_as_events(df.limit(0))))).count() == 0


def fingerprint(t):
    w = words(t)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("tile", [4096, 4])
def test_simhash(spark, odd, none, tile):
    rows = odd.select("doc_id", "text").collect()
    fps = np.array([fingerprint(r.text) for r in rows], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    ids = np.array([1 << 60 if r.doc_id is None else r.doc_id for r in rows])
    while True:
        low = np.array([ids[near[i]].min() for i in range(len(rows))])
        if (low == ids).all():
            break
        ids = low
    want = sorted((str(r.doc_id), int(f), None if c == 1 << 60 else int(c)) for r, f, c in zip(rows, fps, ids, strict=True))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(odd, tile=tile).collect())
    assert got == want
    kept = simhash.one_of_each(odd, tile=tile)
    assert kept.columns == odd.columns and kept.count() == len({(str(c)) for _, _, c in want if c is not None}) + len({f for i, f, c in want if c is None})
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()}
    label = local_components(260, *np.array(edges).T)
    assert got == {n: int(label[n]) for e in edges if e[0] != e[1] for n in e}


def test_tiles_skip_only_far_pairs():
    v = np.random.default_rng(2).integers(0, 2**63, 300, np.int64)
    v = np.concatenate([v, v ^ 1, v[:50] ^ 3])
    near = {(min(i, j), max(i, j)) for i in range(len(v)) for j in range(len(v)) if i != j and bin(int(v[i]) ^ int(v[j])).count("1") <= 2}
    a, b = simhash.tile_links(v, None, 2, tile=16)
    assert {(min(i, j), max(i, j)) for i, j in zip(a.tolist(), b.tolist(), strict=True) if i != j} == near


@pytest.mark.parametrize(("chunk", "block", "lead"), [(4096, 65536, 16), (16, 3, 2)])
def test_top_k(spark, chunk, block, lead):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * (1 + i % 5) for _ in range(6)]) for i in range(120)]
    rows += [(200, rows[50][1]), (201, rows[50][1]), (50, rows[3][1]), (202, None), (203, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6), (250, [0.5, 0.5]), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, chunk=chunk, block=block, lead=lead).collect()
    q = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for i, v in {(i, tuple(v)) for i, v in q if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in q if j != i)[:5]
        want += [(i, k, j, -x) for k, (x, j) in enumerate(s, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def repeats(texts, n):
    seen = collections.Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if seen[t[p : p + n]] > 1:
                hit[p : p + n] = b"\1" * n
        out.append((len(t), bytes(c for c, h in zip(t, hit, strict=True) if not h), sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))))
    return out


@pytest.mark.parametrize("hot", [6000, 2])
def test_substrings(spark, odd, none, hot):
    df = odd.where("doc_id is null or doc_id <> 10")
    want = sorted(repeats([(r.text or "").encode() for r in df.select("text").collect()], 200))
    got = substrings.remove_repeats(df, hot=hot).collect()
    assert sorted((r.n_bytes, bytes(r.kept), len(r.spans)) for r in got) == want
    assert substrings.remove_repeats(none).count() == 0
    assert all(isinstance(r.kept, str) for r in substrings.remove_repeats(df, characters=True).collect())


def test_long_rows_have_all_windows():
    x = np.frombuffer(("é" * 300 + "the cat sat on the mat " * 90).encode() * 5, np.uint8)
    windows = lambda c: sorted((int(p), s) for p, b, e in zip(c[0], c[2], c[3], strict=True) for s in range(int(p - b), int(p + 32 + e - 199)))
    whole, parts = (next(substrings.row_anchors(x, np.array([0, len(x)]), RollingHash(11), 200, 32, c))[1] for c in (1 << 22, 700))
    assert windows(whole) == windows(parts) and len(windows(whole)) == len(x) - 199


def test_long_prefixes():
    rnd = random.Random(6)
    for _ in range(20):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 60))) for _ in range(6)]
        s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
        s[s == 1] = 0
        sa, same = substrings.long_prefixes(s, substrings.suffix_array(s, 400), 8)
        grams = [tuple(s[p : p + 8]) for p in sa]
        assert same.tolist() == [i > 0 and len(g) == 8 and 0 not in g and g == grams[i - 1] for i, g in enumerate(grams)]


def test_packing(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["", "  a  b ", " x", "a\n b", "\x1c \x1d a", "a <|endoftext|> b", "é  b", "it's  don't\t\t x ", "日本 語", " \n", "a 　c"]
    ids = packing.Ids(most=3)
    assert all(np.frombuffer(ids.of(x), np.uint16).tolist() == t.encode(x, add_special_tokens=False).ids for x in texts)
    got = packing.pack(odd, shard_tokens=5000).collect()
    want = collections.Counter()
    for r in odd.select("doc_id", "text").collect():
        want[(r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids) + (0,))] += 1
    for (doc, x), n in want.items():
        mine = [p for p in got if p.doc_id == doc and p.doc_tokens == len(x)]
        assert sum(p.length for p in mine) % len(x) == 0 and sum(p.length for p in mine) >= n * len(x)
        assert any(p.start == 0 and p.ids_crc32 == zlib.crc32(np.array(x[: p.length], "<u4").tobytes()) for p in mine)
    assert sum(p.length for p in got) == sum(len(x) * n for (_, x), n in want.items())
    by = collections.defaultdict(list)
    for p in got:
        by[p.sequence_id].append((p.offset, p.length))
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(none).count() == 0


def test_packing_retrieves_neighbours():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3], [7, 8, 9], [1, 2, 4], [7, 8, 5], [6, 6, 6])]
    order = packing.arrange(docs, np.ones(1 << 16), 3.0, 6)
    assert order == [0, 2, 1, 3, 4]


def test_decontamination(spark, odd, none):
    items = [(1, "alpha beta gamma delta alpha beta gamma delta alpha"), (2, "One two"), (3, None), (4, " ".join(words(odd.where("doc_id = 5").first().text)[4:20])), (None, "lost"), (4, "x"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    want = []
    for r in odd.select("doc_id", "text").collect():
        w, hit, got = cut(r.text), set(), set()
        grams = {n: collections.defaultdict(list) for n in {min(len(cut(t)), 8) for _, t in items} - {0}}
        for n, g in grams.items():
            for j in range(len(w) - n + 1):
                g[tuple(w[j : j + n])].append(j)
        for item, t in items:
            b = cut(t)
            n = min(len(b), 8)
            for i in range(len(b) - n + 1 if n else 0):
                for j in grams[n].get(tuple(b[i : i + n]), ()):
                    hit |= set(range(j, j + n))
                    got |= {str(item)} if item is not None else set()
        want.append((str(r.doc_id), len(w), len(hit), sorted(got)))
    for block in (1 << 25, 40):
        found = decontamination.decontaminate(odd, bench, block_bytes=block).collect()
        assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.hit_items) for r in found) == sorted(want)
    clash = odd.select("doc_id", "text", *(F.lit("mine").alias(c) for c in ("_n", "_hits", "t", "rest", "_id", "none")))
    got = decontamination.decontaminate(clash, bench)
    assert got.columns == [*clash.columns, "n_words", "n_hit", "hit_items"] and {r._n for r in got.collect()} == {"mine"}
    assert simhash.one_of_each(clash.where("doc_id is not null").dropDuplicates(["doc_id"])).columns == clash.columns
    assert substrings.remove_repeats(clash).first()["none"] == "mine"
    assert decontamination.decontaminate(odd.select("text"), bench).count() == len(want)
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(odd, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ b", "x"), (1, "http://b", "x"), (2, None, None), (5, "c", ""), (None, "d", "x"), (9, "e", "WARC/1.1\r\n\r\né"), (1, "http://b", "x"), (-4, "f", "y\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("of", F.lit(1))
    for least in (0, 1):
        path = str(tmp_path / f"w{least}")
        warc.archive_pages(df, path, least=least)
        got = warc.read_archives(spark, path).collect()
        first = {h: min(i for i, _, x in rows if (x or "") == h and i is not None) for h in {x or "" for _, _, x in rows}}
        want = []
        for i, _, x in rows:
            b = (x or "").encode()
            of = first[x or ""] if len(b) >= least else i
            want.append((str(i), len(b), warc.base32_sha1(b), "response" if of == i else "revisit", None if of == i else of))
        assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda x: (x[0], x[1]))
    assert warc.archive_pages(df.limit(0), str(tmp_path / "none")) == 0
    (tmp_path / "none").mkdir(exist_ok=True)
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0
    many = spark.range(300).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.sha2(F.col("id").cast("string"), 256).alias("html")).repartition(2)
    warc.archive_pages(many, str(tmp_path / "many"), file_bytes=5000)
    files = sorted((tmp_path / "many").iterdir())
    assert len(files) > 4 and all(f.name.endswith(".warc.gz") for f in files) and warc.read_archives(spark, str(tmp_path / "many")).count() == 300
    heads = [h for h, _ in warc.read_warc(files[0].read_bytes())]
    assert heads[0]["WARC-Type"] == "warcinfo" and heads[0]["WARC-Filename"] == files[0].name and len(list(warc.members(files[0].read_bytes()))) == len(heads)


def test_warc_of_several_members():
    """A file as others write it: a member a record, two records in a member, and padding between."""
    import gzip

    records = [warc.to_warc(warc.ArcRecord(f"http://{i}", "-", "2001", "text/plain", b"x" * i), str(i)) for i in range(4)]
    data = gzip.compress(records[0]) + gzip.compress(records[1] + records[2]) + b"\0\0" + gzip.compress(records[3])
    assert [len(b) for _, b in warc.read_warc(data)] == [0, 1, 2, 3] == [len(b) for _, b in warc.read_warc(b"".join(records))]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_warc(data[:-5]))


@pytest.mark.parametrize("version", [1, 2])
def test_arc(version):
    records = [warc.ArcRecord("http://a/x y", "1.2.3.4", "19970102030405", "text/html", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\n"), warc.ArcRecord("dns:a", "-", "1997", "text/dns", b"")]
    data = warc.write_arc(records, version)
    back = list(warc.parse_arc(data.replace(b"body\n\n\n", b"body\n\n\n\n\n")))
    assert [(r.url, r.date, r.block) for r in back] == [("http://a/x%20y", "19970102030405", records[0].block), ("dns:a", "1997", b"")]
    (head, block), (head2, _) = (next(warc.parse_warc(warc.to_warc(r))) for r in back)
    assert head["WARC-Type"] == "response" and head["WARC-Date"] == "1997-01-02T03:04:05Z" and block == records[0].block
    assert head["WARC-Payload-Digest"] == "sha1:" + warc.base32_sha1(b"body\n\n")
    assert head2["WARC-Type"] == "resource" and head2["WARC-Date"] == "1997-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-5]))


def test_pipeline(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert 0 < docs.count() <= before.count()
    assert corpus_pipeline.run(spark, sf).agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


def test_pipeline_on_odd_tables(spark, sf):
    rows = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0)]
    df = spark.createDataFrame(rows, SHAPES).withColumn("score", F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, df, sf).columns == df.columns
        assert stage(spark, df.limit(0), sf).count() == 0
    assert corpus_pipeline.drop_near_duplicates(spark, df, sf).count() == 2  # blank texts are one group


