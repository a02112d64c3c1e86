"""Operators against plain versions of the same rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchment.llm import packing, quality, toxicity
from parchment.llm.common import RollingHash, text_bytes


def plain_statistics(text: str) -> list[float]:
    b = (text or "").encode()
    if not b:
        return [0.0] * len(quality.FEATURES)
    kinds = [next((k for k, held in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), b" \t", b"\n\r", range(0x80, 0x100), b".!?", b",;:", b"#$%&*+/<=>@[\\]^_`{|}~"), 1) if x in held), 0) for x in b]
    out = {f"share_{k}": kinds.count(k) / len(b) for k in range(quality.CLASSES)}
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
    low = [b[s:e].lower() for s, e in words]
    n, size = max(len(words), 1), [e - s for s, e in words]
    mean = sum(size) / n
    letters = [[kinds[i] for i in range(s, e) if kinds[i] in (1, 2, 6)] for s, e in words]
    lines = [m[0] for m in re.finditer(rb"[^\n]+", b)]
    out |= {
        "bangs": b.count(b"!") / len(b), "pipes": b.count(b"|") / len(b), "log_bytes": math.log1p(len(b)), "log_words": math.log1p(len(words)), "word_mean": mean,
        "word_sd": math.sqrt(max(0.0, sum(x * x for x in size) / n - mean**2)), "distinct_words": len(set(low)) / n, "repeats": sum(x == y for x, y in zip(low, low[1:], strict=False)) / n,
        "top_word": max(Counter(low).values(), default=0) / n, "log_lines": math.log1p(len(lines)), "distinct_lines": len({x.lower() for x in lines}) / max(len(lines), 1), "line_mean": sum(map(len, lines)) / max(len(lines), 1),
        "no_letter_words": sum(not x for x in letters) / n, "capital_words": sum(kinds[s] == 2 for s, _ in words) / n, "caps_words": sum(len(x) > 1 and set(x) == {2} for x in letters) / n,
        "sign_ends": sum(kinds[e - 1] == 9 for _, e in words) / n, "words_a_stop": n / (kinds.count(7) + 1), "distinct_pairs": len(set(zip(low, low[1:], strict=False))) / max(len(words) - 1, 1),
    }
    return [out[f] for f in quality.FEATURES]


def test_quality_statistics():
    rnd = random.Random(5)
    alphabet = ["a", "B", "7", " ", "  ", "\n", ".", "!", ",", "|", "#", "é", "THE", "the ", "\t", "-", "\r\n", "x y x y "]
    texts = [None, "", " ", "\n\n", "!", "A", "AB ab AB", "one\none\nOne", *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 200))) for _ in range(60))]
    data, offsets = text_bytes(pa.array(texts))
    got = quality.statistics(data, offsets, RollingHash(3))
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t)
        assert row.tolist() == pytest.approx(want, abs=1e-9) or not (t or "").strip() and row[:14].tolist() == pytest.approx(want[:14]), (t, [f for f, x, y in zip(quality.FEATURES, row, want, strict=True) if abs(x - y) > 1e-9])


def test_forest_walks_as_its_nodes_say():
    rng = np.random.default_rng(3)
    x = rng.random((400, 4))
    f = quality.boost(x, ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float))

    def plain(row):
        total = f.bias
        for at in f.roots.tolist():
            while f.left[at] != at:
                at = int(f.left[at]) + (0 if row[f.feature[at]] <= f.cut[at] else 1)
            total += f.value[at]
        return 1 / (1 + math.exp(-total))

    assert f.predict(x).tolist() == pytest.approx([plain(r) for r in x])


def test_toxic_words_by_brute_force():
    rnd = random.Random(6)
    weights = {"idio": 2.0, "idiot": 3.0, "tras": 1.5, "mor": 0.5}
    exceptions = frozenset({"idiom", "mor or less", "trash can"})
    a = toxicity.Lexicon(weights, exceptions).automaton()
    vocabulary = ["idiot", "idiom", "idiotic", "trash", "can", "more", "mor", "or", "less", "xmor", "the"]
    for _ in range(300):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 12))]
        total = 0.0
        for i, w in enumerate(words):
            stems = [s for s in weights if w.startswith(s)]
            free = any(tuple(words[j : j + len(e)]) == e for e in (tuple(x.split()) for x in exceptions) for j in range(max(0, i - len(e) + 1), i + 1))
            if stems and not free:
                total += weights[max(stems, key=len)]
        got, n = toxicity.weigh(toxicity.fold(" ".join(words)), a)
        assert (got, n) == (pytest.approx(total), len(words))


def test_every_piece_holds_its_ids(spark, sf):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    import sys

    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    ids = {d: [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    covered: dict = {}
    ends: dict = {}
    for r in packing.pack(docs).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, parts in covered.items():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at == len(ids[d])
    assert covered.keys() == ids.keys()
    for parts in ends.values():
        at = 0
        for s, n in sorted(parts):
            assert s == at
            at += n
        assert at <= 1024
    assert docs.select(F.count("*")).first()[0] == len(ids)


def test_wide_vectors_and_clashing_names(spark):
    from parchment.llm import topk

    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 3000))
    rows = [(i, v.tolist(), 1, 2) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, (60, [1.0, None], 1, 2), (61, [float("nan")], 1, 2), (62, [], 1, 2)], "vec_id long, embedding array<double>, score int, query_id int")
    q = np.floor(256 * np.vstack([x, np.zeros((1, 3000))])).astype(np.int64)
    ids = np.array([*range(60), 62])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, k=3, every=50, block=1).collect()}
    for i in (0, 50):
        s = q @ q[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:3]
        assert [got[i, k + 1] for k in range(3)] == [(int(ids[j]), int(s[j])) for j in order]
    assert len(got) == 6


def test_long_conversations(spark):
    from parchment.llm import chat

    text = "</s>[INST] x [/INST] \\ <|end|>\n" * 20_000
    rows = [(1, 0, "user", text), *((2, i, "user" if i % 2 else "assistant", f"[INST]{i}") for i in range(2000)), (None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in chat.parse(chat.render(chat.fold(chat.rows_as_events(df)))).collect()}
    assert back[1].turns[0].text == text and [t.text for t in back[2].turns] == [f"[INST]{i}" for i in range(2000)] and back[None].turns[0].text == "lost"
