"""Words of scripts without spaces, by a dictionary.

A run of letters is cut where the fewest of its letters are unknown, then into the fewest words, then with the longest word
first. The dictionary is a table; its words go to tasks as one trie, so their letters have a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Letters of Thai, and how many letters a dictionary may have in all: some 100 bytes each in a task.
THAI, LETTERS = "ก-ฺเ-๎", 4_000_000
_END = ""


class Cutter:
    """Cuts runs of letters by the words of a trie."""

    def __init__(self, words: Iterable[str], letters: str = THAI):
        self.runs, self.trie = re.compile(f"[{letters}]+"), {}
        for w in words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            if w:
                node[_END] = {}
        self.cut = lru_cache(maxsize=100_000)(self._cut)

    def ends(self, run: str, i: int) -> Iterable[int]:
        """Where dictionary words that begin at a letter end, from the nearest."""
        node = self.trie
        for j in range(i, len(run)):
            node = node.get(run[j])
            if node is None:
                return
            if _END in node:
                yield j + 1

    def _cut(self, run: str) -> tuple[str, ...]:
        """The words of a run; unknown letters that stand together are one."""
        n = len(run)
        cost, to = [(0, 0)] * (n + 1), [0] * n  # of what is left from each letter: unknown letters and words; where the next ends
        known = [True] * n
        for i in range(n - 1, -1, -1):
            u, w = cost[i + 1]
            cost[i], to[i], known[i] = (u + 1, w + 1), i + 1, False
            for j in self.ends(run, i):
                u, w = cost[j]
                if (u, w + 1) <= cost[i]:  # later ends are longer: of equal ones the last stays
                    cost[i], to[i], known[i] = (u, w + 1), j, True
        out, i, before = [], 0, True
        while i < n:
            if known[i] or before:
                out.append(run[i : to[i]])
            else:
                out[-1] += run[i : to[i]]
            before, i = known[i], to[i]
        return tuple(out)

    def tokens(self, text: str) -> list[str]:
        """The words of a text: runs of letters are cut, all else is parted by white space."""
        out, at = [], 0
        for m in self.runs.finditer(text):
            out += text[at : m.start()].split()
            out += self.cut(m[0])
            at = m.end()
        return out + text[at:].split()


def tokenizer(dictionary: DataFrame, word: str = "word", letters: str = THAI):
    """A function of a text column to its words (array of string, null for null), for text.wer(). The dictionary's words are
    read once, and refused beyond LETTERS letters in all."""
    words = dictionary.select(F.col(word).alias("w")).where("w <> ''").distinct()
    size = words.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    if size > LETTERS:
        raise ValueError(f"a dictionary of {size} letters; {LETTERS} at most")
    shared = dictionary.sparkSession.sparkContext.broadcast(sorted(r.w for r in words.collect()))  # bounded by LETTERS
    made: list[Cutter] = []

    @F.arrow_udf(ArrayType(StringType()))
    def of(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Cutter(shared.value, letters))
        return pa.array([None if t is None else made[0].tokens(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    def tokens(c: Column) -> Column:
        return of(c)

    return tokens
