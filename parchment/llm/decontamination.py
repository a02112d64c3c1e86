"""Benchmark decontamination by winnowing.

Each window of WINDOW words of a benchmark item keeps the smallest hash of its K-word grams; so does each window
of a document. A shared window therefore shares a fingerprint, wherever it stands. Fingerprints of documents are
joined with those of the benchmark, and each hit is extended: the windows that hold it are compared word by word.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, RollingHash, Scratch, mix, slices, table, text_bytes, word_spans

#: Words of a window, of a gram, and grams of a window.
WINDOW, K = 8, 4
#: Bytes of benchmark text that one pass holds in memory; a larger benchmark takes more passes, in one stage.
BLOCK_BYTES = 32 << 20
WORD = np.ones(256, bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False
WORD_RE = re.compile(rb"[0-9a-z\x80-\xff]+")
STEP = np.uint64(0x9E3779B97F4A7C15)


def _grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for t in range(1, k):
        out = out * STEP + words[t : t + n]
    return mix(out)


def _least(grams: np.ndarray, w: int) -> np.ndarray:
    out = grams[: max(0, len(grams) - w + 1)].copy()
    for t in range(1, w):
        np.minimum(out, grams[t : t + len(out)], out=out)
    return out


class Fingerprints:
    """The fingerprints and windows of one block of a benchmark: sorted hashes, and where each window stands in the items'
    words, so that hits are compared byte by byte. Holds about five bytes a byte of text."""

    def __init__(self, items: list[tuple], window: int = WINDOW, k: int = K):
        self.window, self.k, self.hash = window, min(k, window), RollingHash(9)
        self.items = [item for item, _ in items]
        prints, short, rows, texts, at = [], defaultdict(list), defaultdict(list), [], 0
        for i, (_, text) in enumerate(items):
            words = WORD_RE.findall((text or "").encode().translate(bytes(LOWER)))
            n = min(len(words), window)
            if not n:
                continue
            hashes, size = self.words(words), np.array([len(w) for w in words])
            ends = at + np.cumsum(size + 1) - 1
            texts.append(b" ".join(words) + b" ")
            at += len(texts[-1])
            grams = _grams(hashes, n)
            rows[n].append((grams, np.full(len(grams), i, np.int32), (ends - size)[: len(grams)], ends[n - 1 :]))
            if n < window:
                short[n].append(grams)
            else:
                prints.append(_least(_grams(hashes, self.k), window - self.k + 1))
        self.text = b"".join(texts)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.short = {n: np.unique(np.concatenate(x)) for n, x in sorted(short.items())}
        self.windows = {}
        for n, parts in rows.items():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            order = np.argsort(columns[0], kind="stable")
            self.windows[n] = [c[order] for c in columns]

    def items_of(self, n: int, gram: int, words: bytes) -> set:
        """The items that hold a window of n words, joined by spaces, with this hash."""
        hashes, item, start, end = self.windows[n]
        low, high = np.searchsorted(hashes, gram), np.searchsorted(hashes, gram, "right")
        return {self.items[item[j]] for j in range(low, high) if self.text[start[j] : end[j]] == words}

    def words(self, words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([len(w) for w in words])
        sums = self.hash.sums(np.frombuffer(b"".join(words), np.uint8))
        return self.hash.spans(sums, ends - [len(w) for w in words], ends)

    def candidates(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(first word of a window, its length) where a fingerprint is the benchmark's; windows inside one row."""
        last = np.repeat(np.cumsum(counts), counts)  # where the row of each word ends
        found = []
        for n, w, known in [(self.window, self.window - self.k + 1, self.prints), *((n, 1, x) for n, x in self.short.items())]:
            if not len(known) or len(hashes) < n:
                continue
            least = _least(_grams(hashes, self.k if n == self.window else n), w)
            at = np.searchsorted(known, least)
            at[at == len(known)] = 0
            hit = np.flatnonzero((known[at] == least) & (np.arange(len(least)) + n <= last[: len(least)]))
            found.append(np.stack([hit, np.full(len(hit), n)], 1))
        return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _match(batches, bench, text: str):
    """Adds to each row: n_words, a bit for each hit word, and the items with occurring windows."""
    prints = bench.value
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        n_words, n_hit, hits, items = [], [], [], []
        old_hits, old_items = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
        for i, j in slices(offsets, 1 << 20):
            off = offsets[i : j + 1] - offsets[i]
            low = LOWER[data[offsets[i] : offsets[j]]]
            starts, ends, counts = word_spans(WORD[low], off)
            sums = prints.hash.sums(low)
            hashes = prints.hash.spans(sums, starts, ends)
            found = prints.candidates(hashes, counts)
            grams = {n: _grams(hashes, n) for n in set(found[:, 1].tolist())}
            first = np.concatenate([[0], np.cumsum(counts)])
            by_row = defaultdict(list)
            for row, (at, n) in zip(np.searchsorted(first, found[:, 0], "right") - 1, found.tolist(), strict=True):
                by_row[row].append((at, n))
            raw = low.tobytes()
            for r in range(j - i):
                mask = np.zeros(int(counts[r]), bool)
                if old_hits[i + r]:
                    mask |= np.unpackbits(np.frombuffer(old_hits[i + r], np.uint8), count=len(mask)).astype(bool)
                got = set(old_items[i + r] or [])
                any_hit = bool(old_hits[i + r])
                for at, n in by_row.get(r, ()):
                    if hit := prints.items_of(n, grams[n][at], b" ".join(raw[starts[x] : ends[x]] for x in range(at, at + n))):
                        got |= hit
                        mask[at - first[r] : at - first[r] + n] = any_hit = True
                n_words.append(int(counts[r]))
                n_hit.append(int(mask.sum()))
                hits.append(np.packbits(mask).tobytes() if any_hit else None)
                items.append(sorted(x for x in got if x is not None))
        out = {"_n": pa.array(n_words, pa.int64()), "_nh": pa.array(n_hit, pa.int64()), "_hits": pa.array(hits, pa.binary()), "_items": pa.array(items, pa.list_(pa.string()))}
        yield pa.RecordBatch.from_arrays([out.get(n, batch.column(k)) for k, n in enumerate(batch.schema.names)], names=batch.schema.names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with columns n_words, n_hit, hit_items (sorted array of item ids as strings).

    A word is hit if it lies in any occurrence of a window of a benchmark item; an item of fewer words than a
    window is one window. Null and empty texts have no words; items without words match nothing; items whose id is
    null hit words but aren't listed; repeated items count once; an empty benchmark hits nothing. Columns of docs
    of the added names are replaced. The benchmark is read in blocks of at most about block_bytes.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks, scratch = max(1, -(-total // block_bytes)), Scratch(spark, "decontamination")
    keep = [c for c in docs.columns if c not in ("n_words", "n_hit", "hit_items")]
    rest = [F.col(c) for c in keep if c != text] or [F.lit(0).alias("none")]  # as one, so that no name can clash
    df = docs.select(F.struct(*rest).alias("rest"), F.col(text).alias("t"), *(F.lit(0).cast("long").alias(c) for c in ("_n", "_nh")), F.lit(None).cast("binary").alias("_hits"), F.lit(None).cast("array<string>").alias("_items"))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        bench = spark.sparkContext.broadcast(Fingerprints([(r.i, r.t) for r in rows], window, k))
        df = df.mapInArrow(lambda x, bench=bench: _match(x, bench, "t"), df.schema)
        if blocks > 1:  # one block is held at a time
            df = scratch.put(df, f"block{b}")
            scratch.drop(f"block{b - 1}")
            bench.destroy()
    columns = [F.col("t").alias(c) if c == text else F.col("rest")[c].alias(c) for c in keep]
    return df.select(*columns, F.col("_n").alias("n_words"), F.col("_nh").alias("n_hit"), F.col("_items").alias("hit_items"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_decontamination: the contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_items") >= 2).alias("contaminated"),
    )


OP9_SQL = r"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bi AS (SELECT item, ws, least(len(ws), 8) AS n, unnest(range(1, greatest(len(ws) - 8, 0) + 2)) AS i FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM bi),
ns AS (SELECT DISTINCT n FROM bw),
di AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, ns WHERE len(ws) >= n),
dw AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS g FROM di),
h AS (SELECT r, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN words USING (r) LEFT JOIN its USING (r)
"""
