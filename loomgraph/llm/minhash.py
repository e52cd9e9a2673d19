"""MinHash kernels: word shingles and minima under universal hash permutations, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from loomgraph.llm import kernel as K

SHINGLE = 5


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k-word shingles, A-Z lower-cased; offsets by row).

    A text with 1 to k - 1 words is one shingle; one without words has none.  Repeats stay.
    """
    data, offs = K.text_bytes(column)
    start, end, at = K.words(data, offs)
    (h,) = K.range_hashes(K.LOWER[data], start, end, 0)
    n = np.diff(at)
    grams = K.rolled(h, k)
    row = np.repeat(np.arange(len(n)), n)
    whole = np.flatnonzero(at[1:][row[: len(grams)]] - np.arange(len(grams)) >= k)
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return grams[whole], np.concatenate([[0], np.cumsum(np.maximum(n - k + 1, 0))])
    single = np.zeros(len(short), K.U64)
    for j in range(k - 1):  # few words each
        some = n[short] > j
        single[some] = K.mix(single[some] * K.U64(0x9E3779B97F4A7C15) + h[at[short[some]] + j] + K.U64(j + 1))
    rows = np.concatenate([row[whole], short])
    order = np.argsort(rows, kind="stable")
    count = np.maximum(n - k + 1, 0)
    count[short] = 1
    return np.concatenate([grams[whole], single])[order], np.concatenate([[0], np.cumsum(count)])


def distinct(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = K.group_starts(row, values)
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(offs) - 1))])


def permutations(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends of n multiply-shift hashes."""
    x = K.mix(np.arange(1, 2 * n + 1, dtype=K.U64) + K.U64(seed << 32))
    return x[:n] | K.U64(1), x[n:]


def minima(values: np.ndarray, offs: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """(rows, n) uint32 minima; a row without values has all bits set."""
    out = np.full((len(offs) - 1, n), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(offs))
    if len(some):
        at = offs[:-1][some]
        for i, (a, b) in enumerate(zip(*permutations(n, seed), strict=True)):
            out[some, i] = np.minimum.reduceat(((values * a + b) >> K.U64(32)).astype(np.uint32), at)
    return out
