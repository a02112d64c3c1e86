"""Toxicity by a weighted lexicon.

The lexicon holds word stems with weights, learned from labelled rows as log odds. Texts are folded (case,
homoglyphs, full-width forms, digits and signs that stand for letters), then one pass of an Aho-Corasick automaton
finds the stems; exception words and phrases cancel the hits inside them. The sum of weights, and that sum by the
text's length, go through a logistic curve that is fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard
from .common import crc_mod, table
from .graph import local_components
from .labels import FIT_ROWS, labelled_sample

#: Letters of other scripts that look like Latin ones, and signs and digits that stand for letters inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g", "ո": "n", "ⅼ": "l",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
WIDE = {0xFF01 + i: 0x21 + i for i in range(94)}
_FOLD = str.maketrans({**HOMOGLYPHS, **{chr(k): chr(v) for k, v in WIDE.items()}, "​": "", "‌": "", "‍": "", "﻿": "", "­": ""})
#: Runs of signs before a letter, or else behind one.
_SUB = re.compile(r"([0134578@$!]+)(?=[^\W\d_])|(?<=[^\W\d_])[0134578@$!]+")
_LETTERS = str.maketrans(SUBSTITUTES)
_REST = re.compile(r"[\W\d_]+")
#: Stems: letters of a stem at least and at most, and documents of the sample that must hold one.
SHORTEST, LONGEST, LEAST = 4, 10, 5
#: Of jaccard.BANDS buckets, those that near copies share: all but 2 % of the pairs of similarity 0.85 share as many.
SHARED = 8


def _letters(m: re.Match) -> str:
    run = m[0] if m[1] else m[0].rstrip("!")
    return run.translate(_LETTERS) + m[0][len(run) :]


def fold(text: str) -> str:
    """Lower case, homoglyphs as letters, whole runs of signs before or behind letters as letters, but exclamation
    marks at the end of a word as none; one space at each end and between words, which are runs of letters."""
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    low = _SUB.sub(_letters, low)
    return f" {_REST.sub(' ', low).strip()} "


@dataclass(frozen=True)
class Lexicon:
    """Weights of stems (each matches at a word's start), exceptions (whole words or phrases, folded), and the
    curve: bias, weight of log(1 + sum), weight of the sum per 100 words."""

    weights: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, float, float] = (-3.0, 3.0, 0.5)

    def automaton(self):
        a = ahocorasick.Automaton()
        for stem, w in self.weights.items():
            a.add_word(f" {stem}", (len(stem) + 1, w, False))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, True))
        if len(a):
            a.make_automaton()
        return a

    def score(self, total: float, words: int) -> float:
        b, w, d = self.curve
        x = b + w * math.log1p(total) + d * 100 * total / max(words, 1)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


def weigh(text: str, automaton) -> tuple[float, int]:
    """Sum of the weights of the longest stem at each word that no exception covers, and the number of words."""
    words = text.count(" ") - 1 if text.strip() else 0
    if not len(automaton) or not words:
        return 0.0, words
    at: dict[int, tuple[int, float]] = {}
    free: list[tuple[int, int]] = []
    for end, (n, w, exception) in automaton.iter(text):
        start = end - n + 1
        if exception:
            free.append((start, end))
        elif start not in at or at[start][0] < n:
            at[start] = (n, w)
    total, k, reach = 0.0, 0, -1
    free.sort()
    for s in sorted(at):  # both lists by place: each exception is looked at once
        while k < len(free) and free[k][0] <= s:
            reach, k = max(reach, free[k][1]), k + 1
        total += at[s][1] if s >= reach else 0.0
    return total, words


def _stems(folded: str) -> set[str]:
    out = set()
    for w in set(folded.split()):
        out.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
        if len(w) >= 3:
            out.add(w + " ")
    return out


def _count(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        n: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            n[label].update(_stems(fold(text or "")))
        stems = list(n[1])  # what no toxic row holds can't be a stem
        yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([n[1][s] for s in stems], pa.int64()), pa.array([n[0][s] for s in stems], pa.int64())], names=["stem", "toxic", "clean"])


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    """Newton's method; the first column of x is the bias."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) / len(y) + l2 * np.r_[0, w[1:]] / len(y) * 10
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + l2 * np.eye(x.shape[1]) / len(y) * 10 + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _distinct(ids: pa.Array, labels: pa.Array, fp: pa.Array, keys: pa.Array) -> list[tuple]:
    """(id, label) of one row of each group of near copies, that of the smallest id. Bounded: `rows` of learn()."""
    fps, first, of = np.unique(fp.to_numpy(), return_index=True, return_inverse=True)
    cells = keys.take(pa.array(first)).to_pylist()
    full = np.array([i for i, c in enumerate(cells) if c], np.int64)
    m = np.array([cells[i] for i in full], np.int64).reshape(len(full), jaccard.BANDS)
    a, b = [], []
    for i in range(len(m)):
        near = np.flatnonzero((m[i + 1 :] == m[i]).sum(1) >= SHARED)
        a.append(np.full(len(near), full[i]))
        b.append(full[i + 1 + near])
    none = [np.zeros(0, np.int64)]
    group = local_components(len(fps), np.concatenate(a + none), np.concatenate(b + none))[of]
    best: dict[int, tuple] = {}
    for g, row in zip(group.tolist(), zip(ids.to_pylist(), labels.to_pylist(), strict=True), strict=True):
        best[g] = min(best.get(g, row), row)
    return sorted(set(best.values()))


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS, folds: int = 5, exceptions: Iterable[str] = ()) -> Lexicon:
    """A lexicon from at most `rows` labelled documents outside the held-out fold.

    Near copies would make chance words look telling: of rows that share SHARED of the
    buckets of five-word shingles (jaccard.bands_of), and of rows linked by such, one is used. A stem
    is kept if LEAST toxic rows hold it and its log odds, smoothed, are over log(8); of stems that stand for the
    same rows the shortest stays. Words that start with a stem but are as common in clean rows become exceptions.
    Without toxic rows the lexicon is empty. A label over 0 is toxic, any other isn't. `rows` alone bounds the lexicon.
    """
    sample = F.broadcast(labelled_sample(labels, label, folds, rows).withColumn("label", (F.col("label") > 0).cast("int")))
    texts = docs.select("doc_id", "text").join(sample, "doc_id")
    keyed = jaccard.shingled(texts.select("doc_id", "label", "text"), keys=True).toArrow()
    chosen = _distinct(*(keyed.column(c) for c in ("doc_id", "label", "fp", "keys")))
    n1 = sum(label for _, label in chosen)
    n0 = len(chosen) - n1
    curve = Lexicon({}).curve
    given = frozenset(fold(x).strip() for x in exceptions)
    if not n1 or not n0:
        return Lexicon({}, given, curve)
    spark = docs.sparkSession
    few = spark.createDataFrame(chosen, sample.schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # of a repeated id the first text
    counts = texts.select("text", "label").mapInArrow(_count, "stem string, toxic long, clean long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # At most `rows` texts are counted, and of their stems only telling ones, or whole words of stems that may be, come here.
    counts = counts.where(f"toxic >= {LEAST}").collect()
    odds = lambda t, c: math.log((t + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1))
    all_odds = {r.stem: (odds(r.toxic, r.clean), r.toxic) for r in counts}
    telling = {s: o for s, (o, _) in all_odds.items() if o > math.log(8) and not s.endswith(" ")}
    weights: dict[str, float] = {}
    for s in sorted(telling, key=lambda s: (len(s), s)):
        inner = [s[:n] for n in range(SHORTEST, len(s)) if s[:n] in weights]
        if all(telling[s] > weights[p] + 0.7 for p in inner):
            weights[s] = telling[s]
    for s, (o, _) in all_odds.items():  # whole short words that are no stem
        if s.endswith(" ") and o > math.log(8) and len(s) <= SHORTEST:
            weights[s] = o
    weights = dict(sorted(weights.items(), key=lambda x: (-x[1], x[0])))
    learned = {s.strip() for s, (o, _) in all_odds.items() if s.endswith(" ") and o < math.log(2) and any(s.startswith(w) for w in (s[:n] for n in range(SHORTEST, LONGEST + 1)) if w in weights)}
    lexicon = Lexicon(weights, given | frozenset(learned), curve)
    fitted = score(texts, lexicon).select("label", "total", "words").collect()
    x = np.array([(1, math.log1p(r.total), 100 * r.total / max(r.words, 1)) for r in fitted])
    return Lexicon(weights, lexicon.exceptions, tuple(_logistic(x, np.array([r.label for r in fitted], float))))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs, without `text` unless keep_text, with columns total, words (long) and score (0 to 1); columns of these names are replaced.

    Null and empty texts have no words and get the curve's lowest score.
    """
    keep = [c for c in docs.columns if c not in ("total", "words", "score") and (keep_text or c != text)]
    schema = docs.select(*keep, F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("words"), F.lit(0.0).alias("score")).schema
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded: stems of at most `rows` texts of learn()

    def run(batches):
        automaton = shared.value.automaton()
        for batch in batches:
            found = [weigh(fold(t), automaton) if t else (0.0, 0) for t in (x.as_py() for x in batch.column(text))]
            cols = [pa.array([t for t, _ in found], pa.float64()), pa.array([w for _, w in found], pa.int64()), pa.array([shared.value.score(t, w) for t, w in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *cols], names=[*keep, "total", "words", "score"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1_toxicity: the contract's columns for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
