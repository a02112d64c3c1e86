"""Decimals of four places as whole ten-thousandths, for whole columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa

KIND = pa.decimal128(20, 4)


def known(a: pa.Array) -> np.ndarray:
    return a.is_valid().to_numpy(zero_copy_only=False)


def whole(a: pa.Array) -> list[int | None]:
    """The ten-thousandths of decimals of four places; nulls are None."""
    if not len(a) or a.null_count == len(a):
        return [None] * len(a)
    low, high = np.frombuffer(a.buffers()[1], np.int64).reshape(-1, 2)[a.offset : a.offset + len(a)].T
    out = low.tolist() if np.array_equal(low >> 63, high) else [(h << 64) | (v & ((1 << 64) - 1)) for v, h in zip(low.tolist(), high.tolist(), strict=True)]
    return [v if k else None for v, k in zip(out, known(a).tolist(), strict=True)] if a.null_count else out


def of_words(value: np.ndarray, there: np.ndarray) -> pa.Array:
    """Decimals of ten-thousandths that fit a machine word; null where not there."""
    limbs = np.ascontiguousarray(np.stack([value, value >> 63], 1))
    return pa.Array.from_buffers(KIND, len(value), [pa.py_buffer(np.packbits(there, bitorder="little").tobytes()), pa.py_buffer(limbs)])


def of_whole(values: Sequence[int | None]) -> pa.Array:
    """Decimals of ten-thousandths; None is null."""
    try:
        return of_words(np.array([v or 0 for v in values], np.int64), np.array([v is not None for v in values], bool))
    except OverflowError:
        return pa.array([None if v is None else Decimal(v).scaleb(-4) for v in values], KIND)
