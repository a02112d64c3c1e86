"""Draws of Python's generator (Mersenne Twister) by their number, from any place of the sequence.

A pass over rows in order takes one draw a row. Here each task works out the draws of its own rows: the state after n
outputs is the state at the start times x**n modulo the generator's characteristic polynomial, over the field of two
elements. That polynomial is found from the generator's own output (Berlekamp and Massey).
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import keep
from . import ordered, sampling

#: Words of the state, bits of the polynomial, draws that are worked out together.
WORDS, DEGREE, BLOCK = 624, 19937, 1 << 16


def _words(r: random.Random, n: int) -> np.ndarray:
    """The next n words of the recurrence, those of the state first."""
    out = [r.getstate()[1][:WORDS]]
    while len(out) * WORDS < n:
        r.getrandbits(32 * WORDS)
        out.append(r.getstate()[1][:WORDS])
    return np.concatenate([np.array(x, np.uint32) for x in out])[:n]


@lru_cache(maxsize=1)
def polynomial() -> int:
    """The characteristic polynomial: the shortest recurrence of one bit of the words."""
    bits = (_words(random.Random(1), 2 * DEGREE + 64 + WORDS)[WORDS:] & 1).tolist()
    now, before, length, since, window = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        window = window << 1 | bit
        if not (now & window).bit_count() & 1:
            since += 1
        elif 2 * length <= n:
            now, before, length, since = now ^ before << since, now, n + 1 - length, 1
        else:
            now, since = now ^ before << since, since + 1
    # The recurrence has the newest word first; the polynomial has it as the highest power.
    return int(bin(now)[2:].zfill(length + 1)[::-1], 2)


def power(n: int) -> int:
    """x**n modulo polynomial(); bits are coefficients."""
    p = polynomial()
    degree = p.bit_length() - 1
    low = [i for i in range(degree) if p >> i & 1]
    out = 1
    for bit in bin(n)[2:]:
        out = int(bin(out)[2:], 4)  # squaring puts a zero between coefficients
        while high := out >> degree:
            out &= (1 << degree) - 1
            for i in low:
                out ^= high << i
        if bit == "1":
            out <<= 1
            out ^= p if out >> degree else 0
    return out


def state_after(seed: int | str, outputs: int) -> np.ndarray:
    """The words of the state after so many 32-bit outputs of a generator that was just seeded."""
    r = random.Random(seed)
    terms = power(outputs)
    words = _words(r, DEGREE + WORDS)
    at = np.flatnonzero(np.frombuffer(bin(terms)[2:].encode()[::-1], np.uint8) == ord("1"))
    out = np.zeros(WORDS, np.uint32)
    for i in range(0, len(at), 1024):
        out ^= np.bitwise_xor.reduce(np.lib.stride_tricks.sliding_window_view(words, WORDS)[at[i : i + 1024]], axis=0)
    return out


def draws(seed: int | str, first: int, n: int) -> np.ndarray:
    """What random() gives from its call number `first` (from 0) on, n times, after random.Random(seed)."""
    state = np.random.RandomState(0)
    state.set_state(("MT19937", state_after(seed, 2 * first), WORDS))
    return state.random_sample(n)


#: The generator where the last block that was worked out ends, by seed and the block that follows.
_next: dict[tuple[int | str, int], np.random.RandomState] = {}


@lru_cache(maxsize=32)
def _block(seed: int | str, number: int) -> np.ndarray:
    """A block's draws. Only a block that doesn't follow the one before it takes a jump."""
    state = _next.pop((seed, number), None)
    if state is None:
        state = np.random.RandomState(0)
        state.set_state(("MT19937", state_after(seed, 2 * number * BLOCK), WORDS))
    _next.clear()
    _next[seed, number + 1] = state
    return state.random_sample(BLOCK)


def draw(seed: int | str, number: Column) -> Column:
    """The draw of a number, from 0. Rows whose numbers lie close together should lie in one task."""

    @F.arrow_udf(DoubleType())
    def of(numbers: pa.Array) -> pa.Array:
        n = numbers.fill_null(0).to_numpy(zero_copy_only=False)
        out = np.zeros(len(n))
        for b in np.unique(n // BLOCK).tolist():
            here = n // BLOCK == b
            out[here] = _block(seed, b)[n[here] % BLOCK]
        return pa.array(out, mask=np.asarray(numbers.is_null()))

    return of(number)


def review_queue(cells: DataFrame, keys: list[str], order: list[str | Column], share: float = 0.1, seed: int = 42, parts: int | None = None) -> DataFrame:
    """sampling.review_queue(), whose share of agreeing cells is what one pass over the cells by `order` (columns of keys)
    draws, a draw for each agreeing one: their numbers come from an order over all parts. Cells are compared once and
    written, as their ranges, their order and the differing ones are read from them."""
    per = keep(sampling.compared(cells, keys).where("known > 0").drop("known"), "compared")
    agreeing = ordered.rank(per.where("not differs").withColumn("_all", F.lit(0)), ["_all"], order, "_n", parts)
    drawn = agreeing.where(draw(seed, F.col("_n") - 1) < share)
    return per.where("differs").select(*keys, "differs", "values").unionByName(drawn.select(*keys, "differs", "values"))


def quotas(df: DataFrame, stratum: str, cap: int) -> DataFrame:
    """sampling.quotas() in doubles, whose rounding decides between remainders that are equal in whole numbers. Works on one
    row a stratum."""
    sizes = df.groupBy(F.coalesce(F.col(stratum), F.lit("")).alias(stratum)).agg(F.count("*").alias("size"))
    whole = Window.partitionBy()
    exact = F.lit(cap) * F.col("size") / F.sum("size").over(whole)
    shared = sizes.withColumns({"_exact": exact, "_total": F.sum("size").over(whole)}).withColumn("_base", F.floor("_exact"))
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_base")).desc(), stratum))
    ranked = shared.withColumns({"_rank": rank, "_given": F.sum("_base").over(whole)})
    quota = F.when(F.col("_total") <= cap, F.col("size")).otherwise(F.col("_base") + (F.col("_rank") <= cap - F.col("_given")).cast("long"))
    return ranked.select(stratum, "size", quota.cast("long").alias("quota"))


def stratified(df: DataFrame, stratum: str, id: str, cap: int, name: str, seed: int = 42, parts: int | None = None) -> DataFrame:
    """df's rows that random.Random(f"{seed}|{name}|{stratum}").sample() takes of each stratum's ids in order, as many as its
    quota; with `draw`, the place of each among its stratum's. Ids are distinct. A task draws places, as many as the quota."""

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s, n, k in zip(f[stratum], f["size"].tolist(), f["quota"].tolist(), strict=True):
                taken = random.Random(f"{seed}|{name}|{s}").sample(range(n), k)
                yield pd.DataFrame({stratum: s, "_place": [p + 1 for p in taken], "draw": range(k)})

    drawn = quotas(df, stratum, cap).mapInPandas(places, f"`{stratum}` string, _place long, draw long")
    named = df.withColumn(stratum, F.coalesce(F.col(stratum), F.lit("")))
    return ordered.rank(named, [stratum], [id], "_place", parts).join(drawn, [stratum, "_place"]).drop("_place")
