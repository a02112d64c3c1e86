"""Where positioned words stand: lines, a header's columns and their sides, for all pages of a batch at once.

Words are columns of numpy arrays, sorted by page. Pages go through the same steps together: lines by a scan that takes the
next word of every page at each step, columns by running maxima of right edges, sides by differences of sorted edges.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Share of the smaller height that a word and a line must have in common.
OVERLAP = 0.4


def _starts(page: np.ndarray, n: int) -> np.ndarray:
    """Where each of n pages begins in a sorted column of pages, and the end."""
    return np.searchsorted(page, np.arange(n + 1))


class Words:
    """Words of n pages: page, text, left, top, right, bottom, and after lines() the line of each, numbered through the batch."""

    def __init__(self, counts: Sequence[int], text: np.ndarray, box: Sequence[np.ndarray]):
        """How many words each page has, and the texts and (left, top, right, bottom) of all words, page by page."""
        self.n = len(counts)
        self.page = np.repeat(np.arange(self.n), counts)
        self.text = text
        self.left, self.top, self.right, self.bottom = box
        self._lines()

    @classmethod
    def of(cls, pages: Sequence[Sequence[tuple]]) -> Words:
        """Words (text, x0, y0, x1, y1) of pages."""
        flat = [w for p in pages for w in p]
        box = np.array([w[1:5] for w in flat], float).reshape(-1, 4)
        return cls([len(p) for p in pages], np.array([w[0] for w in flat] + [None], object)[:-1], box.T)

    def _take(self, order: np.ndarray) -> None:
        for c in ("page", "text", "left", "top", "right", "bottom"):
            setattr(self, c, getattr(self, c)[order])

    def _lines(self) -> None:
        """Sorts words by page, line and left edge. Each step gives every page its next word from the top: it goes to the
        page's open line if what they share is more than OVERLAP of the smaller of their heights, or opens the next."""
        self._take(np.lexsort((self.left, self.top, self.page)))
        first = _starts(self.page, self.n)
        count = np.diff(first)
        place = np.zeros(len(self.page), np.int64)
        line, upper, lower = np.full(self.n, -1), np.zeros(self.n), np.full(self.n, -np.inf)
        by_count = np.argsort(-count, kind="stable")
        for k in range(int(count.max(initial=0))):
            pages = by_count[: np.searchsorted(-count[by_count], -k, "left")]
            w = first[pages] + k
            top, bottom = self.top[w], self.bottom[w]
            least = np.minimum(lower[pages] - upper[pages], bottom - top)
            least[(least == 0) | ~np.isfinite(least)] = 1.0
            # Tops come in order, so what a word shares with the line begins at the word's own top.
            joins = np.minimum(lower[pages], bottom) - top > OVERLAP * least
            line[pages] += ~joins
            upper[pages] = np.where(joins, upper[pages], top)
            lower[pages] = np.where(joins, np.maximum(lower[pages], bottom), bottom)
            place[w] = line[pages]
        #: The first line of each page, and the end; page, top and bottom of each line, and its first word, and the end.
        self.line_at = np.concatenate([[0], np.cumsum(line + 1)])
        self.line = place + self.line_at[self.page]
        order = np.lexsort((self.left, self.line))
        self._take(order)
        self.line = self.line[order]
        self.line_page = np.repeat(np.arange(self.n), np.diff(self.line_at))
        self.word_at = np.searchsorted(self.line, np.arange(len(self.line_page) + 1))
        cut = self.word_at[:-1]
        self.line_top = np.minimum.reduceat(self.top, cut) if len(cut) else np.zeros(0)
        self.line_bottom = np.maximum.reduceat(self.bottom, cut) if len(cut) else np.zeros(0)

    def texts(self, line: int) -> list[str]:
        return self.text[self.word_at[line] : self.word_at[line + 1]].tolist()

    def heights(self, lines: np.ndarray | None = None) -> np.ndarray:
        """Of each page, the upper median of the heights of its lines, or of those chosen; 1 where there is none, or it is 0."""
        lines = np.arange(len(self.line_page)) if lines is None else lines
        page, height = self.line_page[lines], (self.line_bottom - self.line_top)[lines]
        height = height[np.lexsort((height, page))]
        first = _starts(page, self.n)
        count = np.diff(first)
        out = np.ones(self.n)
        some = count > 0
        out[some] = height[(first[:-1] + count // 2)[some]]
        out[out == 0] = 1.0
        return out


class Columns:
    """Columns of the pages' headers (first and last line of each page, or -1): words that overlap or stand within a line's
    height make one, which owns the page's width up to half way to its neighbours."""

    def __init__(self, words: Words, header: np.ndarray):
        self.words, n = words, words.n
        inside = (words.line >= header[words.page, 0]) & (words.line <= header[words.page, 1]) & (header[words.page, 0] >= 0)
        w = np.flatnonzero(inside)
        near = words.heights(np.unique(words.line[w]))
        w = w[np.lexsort((words.line[w], words.left[w], words.page[w]))]
        page, left, right = words.page[w], words.left[w], words.right[w]
        # The farthest right edge so far, page by page: a running maximum over the places of edges in sorted order, lifted
        # apart by page.
        by_edge = np.argsort(right, kind="stable")
        rank = np.empty(len(w), np.int64)
        rank[by_edge] = np.arange(len(w))
        far = np.maximum.accumulate(page * max(1, len(w)) + rank) % max(1, len(w))
        reach = right[by_edge][far]
        new = np.ones(len(w), bool)
        new[1:] = (page[1:] != page[:-1]) | (left[1:] > reach[:-1] + near[page[1:]])
        group, at = np.cumsum(new) - 1, np.flatnonzero(new)
        self.page = page[at]
        self.left = left[at]
        self.right = np.maximum.reduceat(right, at) if len(at) else right
        self.first = _starts(self.page, n)
        # Words of a column from the left, and by line, then from the left.
        self.across = [w[i:j] for i, j in zip(at, [*at[1:], len(w)])]
        self.members = [w[i:j][np.lexsort((left[i:j], words.line[w[i:j]]))] for i, j in zip(at, [*at[1:], len(w)])]
        self.widest = int(np.diff(self.first).max(initial=0))
        self.low, self.high = np.full((n, self.widest), np.inf), np.full((n, self.widest), -np.inf)
        number = np.arange(len(at)) - self.first[self.page]
        edge = (self.right[:-1] + self.left[1:]) / 2
        neighbours = self.page[:-1] == self.page[1:]
        self.low[self.page, number], self.high[self.page, number] = -np.inf, np.inf
        self.high[self.page[:-1][neighbours], number[:-1][neighbours]] = edge[neighbours]
        self.low[self.page[1:][neighbours], number[1:][neighbours]] = edge[neighbours]

    def title(self, column: int) -> str:
        return " ".join(self.words.text[self.members[column]].tolist())

    def stroke(self, column: int) -> float:
        """Where a column of two sides parts by its header: at the middle of its first stroke, or of the column."""
        for i in self.across[column]:
            if self.words.text[i].strip() == "/":
                return (self.words.left[i] + self.words.right[i]) / 2
        return (self.left[column] + self.right[column]) / 2

    def owners(self) -> np.ndarray:
        """The column of its page that each word overlaps most, the first of such; -1 if none."""
        w = self.words
        if not self.widest:
            return np.full(len(w.page), -1)
        shared = np.minimum(w.right[:, None], self.high[w.page]) - np.maximum(w.left[:, None], self.low[w.page])
        best = shared.argmax(1) if len(w.page) else np.zeros(0, np.int64)
        return np.where(shared[np.arange(len(best)), best] > 0, best, -1)


def widest_gaps(page: np.ndarray, edge: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of n pages, the widest gap between two sorted edges that follow each other, and its middle; of equal gaps the
    last. -1 where a page has fewer than two."""
    order = np.lexsort((edge, page))
    page, edge = page[order], edge[order]
    gap, middle = edge[1:] - edge[:-1], (edge[1:] + edge[:-1]) / 2
    one = np.flatnonzero(page[1:] == page[:-1])
    one = one[np.lexsort((one, gap[one], page[one]))]
    last = np.searchsorted(page[one], np.arange(n), "right") - 1
    has = (last >= 0) & (np.append(page[one], -1)[last] == np.arange(n))
    width, at = np.full(n, -1.0), np.zeros(n)
    width[has], at[has] = gap[one[last[has]]], middle[one[last[has]]]
    return width, at


def lines_of(words: Sequence[tuple]) -> Iterator[list[tuple]]:
    """The lines of one page's words (text, x0, y0, x1, y1), from the top, each from the left."""
    w = Words.of([words])
    rows = list(zip(w.text.tolist(), w.left.tolist(), w.top.tolist(), w.right.tolist(), w.bottom.tolist(), strict=True))
    for i, j in zip(w.word_at, w.word_at[1:]):
        yield rows[i:j]
