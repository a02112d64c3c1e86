"""Edit distance of any two sequences, and of many pairs of texts at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Levenshtein distance, a column of the matrix at a time as the bits of two integers (where it rises, where it falls)."""
    if not a:
        return len(b)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = every, 0, len(a)
    for y in b:
        same = at.get(y, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        right, left = down | ~(diagonal | up) & every, up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & every, left << 1 & every
        up, down = left | ~(diagonal | right) & every, right & diagonal
    return score


#: Cells of a batch's bit columns (words by pairs), bytes of its table of letters, and pairs under which one by one is faster.
CELLS, TABLE, FEW = 1 << 13, 1 << 25, 12


def edit_distances(pairs: Sequence[tuple[str, str]]) -> np.ndarray:
    """edit_distance() of many pairs of texts. Pairs of like length go together: a step takes a column of each, whose 64-row
    words follow each other by one column (Hyyrö's blocks), so that all words of all pairs are one array."""
    out = np.zeros(len(pairs), np.int64)
    sized = sorted((max(len(a), len(b)), i) for i, (a, b) in enumerate(pairs) if a != b)
    start = 0
    while start < len(sized):
        shortest, end = sized[start][0], start
        while end < len(sized) and sized[end][0] <= shortest + shortest // 8 + 8 and (end - start) * (sized[end][0] // 64 + 1) < CELLS:
            end += 1
        end = max(end, start + 1)
        _together(pairs, [i for _, i in sized[start:end]], out)
        start = end
    return out


def _codes(x: str) -> np.ndarray:
    return np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)


def _together(pairs: Sequence[tuple[str, str]], which: list[int], out: np.ndarray) -> None:
    """Distances of pairs of like length. Texts are brought to one length by letters before both sides that occur nowhere
    else, which changes no distance."""
    if len(which) < FEW:
        for i in which:
            out[i] = edit_distance(*sorted(pairs[i], key=len))
        return
    sides = [sorted(pairs[i], key=len) for i in which]
    n, lanes = max(len(long) for _, long in sides), len(which)
    rows = np.array([len(short) + n - len(long) for short, long in sides])
    words = -(-int(rows.max()) // 64)
    short, long = np.zeros((lanes, words * 64), np.int64), np.zeros((lanes, n), np.int64)
    for k, (a, b) in enumerate(sides):
        short[k, n - len(b) : rows[k]] = _codes(a)
        long[k, n - len(b) :] = _codes(b)
        short[k, : n - len(b)] = long[k, : n - len(b)] = 0x110000
        short[k, rows[k] :] = 0x110001
    seen = np.zeros(0x110002, bool)
    seen[short.ravel()] = seen[long.ravel()] = True
    number, wide = np.cumsum(seen) - 1, words * lanes
    if int(seen.sum()) * wide * 8 > TABLE and lanes >= 2 * FEW:
        _together(pairs, which[: lanes // 2], out)
        _together(pairs, which[lanes // 2 :], out)
        return
    place = np.arange(wide).reshape(words, lanes)
    same = np.zeros(int(seen.sum()) * wide, np.uint64)
    letters = number[short].reshape(lanes, words, 64)
    for bit in range(64):
        same[letters[:, :, bit].T * wide + place] |= np.uint64(1 << bit)
    columns = np.ascontiguousarray(number[long].T) * wide
    one, top = np.uint64(1), np.uint64(63)
    rise, fall = np.full((words, lanes), ~np.uint64(0)), np.zeros((words, lanes), np.uint64)
    # What a word hands to the next one: whether its last row rises or falls along the row. The first row always rises.
    more, less = np.zeros((words + 1, lanes), np.uint64), np.zeros((words + 1, lanes), np.uint64)
    more[0] = one
    for t in range(n + words - 1):
        lo, hi = max(0, t - n + 1), min(words, t + 1)
        up, down, more_in, less_in = rise[lo:hi], fall[lo:hi], more[lo:hi], less[lo:hi]
        eq = same.take(columns[t - hi + 1 : t - lo + 1][::-1] + place[lo:hi])
        level = eq | down
        eq |= less_in
        diagonal = eq & up
        diagonal += up
        diagonal ^= up
        diagonal |= eq
        left = up & diagonal
        diagonal |= up
        right = ~diagonal
        right |= down
        next_more, next_less = right >> top, left >> top
        right <<= one
        right |= more_in
        left <<= one
        left |= less_in
        np.bitwise_and(right, level, out=down)
        level |= right
        np.bitwise_or(left, ~level, out=up)
        more[lo + 1 : hi + 1], less[lo + 1 : hi + 1] = next_more, next_less
    left_over = rows[None, :] - 64 * np.arange(words)[:, None]
    mask = np.where(left_over >= 64, ~np.uint64(0), (one << np.clip(left_over, 0, 63).astype(np.uint64)) - one)
    out[which] = n + np.bitwise_count(rise & mask).sum(0, dtype=np.int64) - np.bitwise_count(fall & mask).sum(0, dtype=np.int64)
