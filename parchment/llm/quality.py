"""Quality by histogram gradient-boosted trees over statistics of a document.

Trees are grown on binned features of a bounded sample of labelled rows, flattened into arrays, and walked by all
rows of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, RollingHash, crc_mod, slices, table, text_bytes, word_spans
from .labels import FIT_ROWS, labelled_sample

#: Byte classes whose shares are features: other, lower case, upper case, digits, spaces, line ends, letters beyond
#: ASCII, sentence ends, commas, and signs of markup and decoration.
CLASSES = 10
CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), (0x20, 0x09), (0x0A, 0x0D), range(0x80, 0x100), b".!?", b",;:", b"#$%&*+/<=>@[\\]^_`{|}~"), 1):
    CLASS[list(_bytes)] = _k
FEATURES = [*(f"share_{k}" for k in range(CLASSES)), "bangs", "pipes", "log_bytes", "log_words", "word_mean", "word_sd", "distinct_words", "repeats", "top_word", "log_lines", "distinct_lines", "line_mean", "no_letter_words", "capital_words", "caps_words", "sign_ends", "words_a_stop", "distinct_pairs"]


def statistics(data: np.ndarray, offsets: np.ndarray, hashes: RollingHash) -> np.ndarray:
    """One row of FEATURES for each row of UTF-8 bytes; zeros for an empty one."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, len(FEATURES)))
    if not len(data):
        return out
    row = np.repeat(np.arange(n), size)
    kind = CLASS[data]
    counts = np.bincount(row * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    total = np.maximum(size, 1)
    out[:, :CLASSES] = counts / total[:, None]
    out[:, 10] = np.bincount(row[data == 0x21], minlength=n) / total
    out[:, 11] = np.bincount(row[data == 0x7C], minlength=n) / total
    low = LOWER[data]
    sums = hashes.sums(low)

    def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of each row, and the count of its most frequent one."""
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])])) if len(k) else np.zeros(0, np.int64)
        most = np.zeros(n, np.int64)
        np.maximum.at(most, r[first], np.diff(np.append(first, len(k))))
        return np.bincount(r[first], minlength=n), most

    s, e, w = word_spans(~SPACES[data], offsets)
    wr, length, words = np.repeat(np.arange(n), w), e - s, np.maximum(w, 1)
    keys = hashes.spans(sums, s, e)
    out[:, 12], out[:, 13] = np.log1p(size), np.log1p(w)
    mean = np.bincount(wr, length, n) / words
    out[:, 14] = mean
    out[:, 15] = np.sqrt(np.maximum(0, np.bincount(wr, length.astype(float) ** 2, n) / words - mean**2))
    kinds, most = distinct(keys, wr)
    out[:, 16], out[:, 18] = kinds / words, most / words
    again = (keys[1:] == keys[:-1]) & (wr[1:] == wr[:-1])
    out[:, 17] = np.bincount(wr[1:][again], minlength=n) / words
    pairs, same = keys[1:] * np.uint64(3) + keys[:-1], wr[1:] == wr[:-1]
    out[:, 27] = distinct(pairs[same], wr[1:][same])[0] / np.maximum(w - 1, 1)
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2) | (kind == 6))])
    uppers = np.concatenate([[0], np.cumsum(kind == 2)])
    inside, up = letters[e] - letters[s], uppers[e] - uppers[s]
    out[:, 22] = np.bincount(wr[inside == 0], minlength=n) / words
    out[:, 23] = np.bincount(wr[kind[s] == 2], minlength=n) / words
    out[:, 24] = np.bincount(wr[(up == inside) & (inside > 1)], minlength=n) / words
    out[:, 25] = np.bincount(wr[kind[e - 1] == 9], minlength=n) / words
    out[:, 26] = words / (counts[:, 7] + 1)
    s, e, w = word_spans(data != 0x0A, offsets)
    lr, lines = np.repeat(np.arange(n), w), np.maximum(w, 1)
    out[:, 19], out[:, 20] = np.log1p(w), distinct(hashes.spans(sums, s, e), lr)[0] / lines
    out[:, 21] = np.bincount(lr, e - s, n) / lines
    return out


@dataclass(frozen=True)
class Forest:
    """Trees in arrays: node i of a tree asks feature[i] <= cut[i], goes to left[i] or left[i] + 1; leaves ask
    nothing (left is the node itself) and hold value[i]. roots: each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.left[at] == at
                right = x[rows, self.feature[at]] > self.cut[at]
                at = np.where(leaf, at, self.left[at] + right)
            total += self.value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, l2: float = 1.0) -> Forest:
    """Gradient boosting of the logistic loss with histograms of at most `bins` bins a feature.

    With labels of one kind only, or no rows, the forest has no trees and tells the share of ones (0.5 for no rows).
    """
    p = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(p / (1 - p)))
    feature, cut, left, value, roots = [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        raw = np.full(len(y), bias)
        width = bins + 1
        offset = np.arange(x.shape[1]) * width
        for _ in range(trees):
            prob = 1 / (1 + np.exp(-raw))
            g, h = prob - y, prob * (1 - prob)
            roots.append(len(feature))
            todo = [(len(feature), np.arange(len(y)), 0)]
            feature.append(0), cut.append(0.0), left.append(len(left)), value.append(0.0)
            while todo:
                node, rows, level = todo.pop()
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -rate * gs / (hs + l2)
                best = (1e-6, 0, 0)
                if level < depth and len(rows) >= 2 * least:
                    cells = (binned[rows] + offset).ravel()
                    rep = x.shape[1]
                    size = width * rep
                    gh, hh, nh = (np.cumsum(np.bincount(cells, wts, size).reshape(rep, width), 1) for wts in (np.repeat(g[rows], rep), np.repeat(h[rows], rep), None))
                    gain = gh**2 / (hh + l2) + (gs - gh) ** 2 / (hs - hh + l2) - gs**2 / (hs + l2)
                    gain[(nh < least) | (len(rows) - nh < least)] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    best = max(best, (float(gain[f, b]), int(f), int(b)))
                if best[0] <= 1e-6 or best[2] >= len(cuts[best[1]]):
                    raw[rows] += value[node]
                    continue
                _, f, b = best
                feature[node], cut[node], left[node] = f, float(cuts[f][b]), len(feature)
                goes = binned[rows, f] > b
                for part in (rows[~goes], rows[goes]):
                    todo.append((len(feature), part, level + 1))
                    feature.append(0), cut.append(0.0), left.append(len(left)), value.append(0.0)
    return Forest(np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value), np.array(roots, np.int64), depth, bias)


def _features(docs: DataFrame, text: str, schema: str, finish) -> DataFrame:
    keep = [c for c in docs.columns if c != text]

    def run(batches):
        hashes = RollingHash(7)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            rows = [statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashes) for i, j in slices(offsets, 2 << 20)]
            x = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), finish(x)], names=[*keep, schema.split()[0]])

    return docs.select(*keep, text).mapInArrow(run, docs.select(*keep, F.lit(None).cast(schema.split()[1]).alias(schema.split()[0])).schema)


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without `text`, with x, an array of FEATURES."""
    return _features(docs.drop("x"), text, "x array<double>", lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(FEATURES)), pa.int32()), pa.array(x.ravel())))


def score(docs: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """docs without `text`, with score (0 to 1); a column of that name is replaced. Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # bounded: trees * 2 ** (depth + 1) nodes
    return _features(docs.drop("score"), text, "score double", lambda x: pa.array(shared.value.predict(x)))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS, folds: int = 5) -> Forest:
    """A forest from at most `rows` labelled documents outside the held-out fold; of a repeated id the least text counts, once
    (null as empty). A label over 0 is 1, any other 0."""
    sample = F.broadcast(labelled_sample(labels, label, folds, rows))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(sample, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max((F.col("label") > 0).cast("int")).alias("label"))
    known = features(texts).orderBy("doc_id").select("label", "x").toArrow()
    x = np.array(known.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return boost(x, np.array(known.column("label").to_pylist(), float))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7_quality: the contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
