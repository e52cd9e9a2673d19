"""Vectorised numpy kernels over Arrow string columns.

All kernels work on the UTF-8 bytes of a whole slice of rows at once: words, lines and windows are
index ranges into one byte array, and hashes of ranges come from prefix sums, so no Python object is
made for a word or a line.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: White space of the contracts: [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text handled at once; temporaries are about 60 times as large.
SLICE_BYTES = 1 << 19
_ODD = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor, shift and multiply rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def symbol_values(seed: int = 0) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=U64) * U64(_ODD[1 - seed]) + U64(seed + 1))


_place_keys: dict[int, np.ndarray] = {}


def _keys_of_places(seed: int, n: int) -> np.ndarray:
    have = _place_keys.get(seed)
    if have is None or len(have) < n:
        have = _place_keys[seed] = mix(mix(np.arange(1, max(n, 1 << 16) + 1, dtype=U64)) + U64(_ODD[seed]))
    return have


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, *seeds: int) -> list[np.ndarray]:
    """A hash for each seed of byte ranges that lie in order and do not overlap.

    Multilinear: each place in a range has a random 64-bit key, each byte a random value, and the sum
    of their products modulo 2**64 is finished with the length.  Two different ranges of a length
    agree where a sum of random multiples vanishes, whatever their structure; a polynomial modulo
    2**64 has texts that agree under every base.  With two seeds a collision needs 128 equal bits.
    """
    if not len(start):
        return [np.zeros(0, U64) for _ in seeds]
    size = end - start
    most = int(size.max(initial=0))
    gap = np.diff(np.append(start, len(data)))
    place = np.arange(start[0], len(data))
    place -= np.repeat(start, gap)
    if int(gap.max()) > most:
        np.minimum(place, most, out=place)  # what lies between ranges
    body, out = data[start[0] :], []
    lo, hi = start - start[0], end - start[0]
    for seed in seeds:
        sums = np.zeros(len(body) + 1, U64)
        np.cumsum(symbol_values(seed)[body] * _keys_of_places(seed, most + 1)[place], out=sums[1:])
        out.append(mix(sums[hi] - sums[lo] + size.astype(U64) * U64(_ODD[0])))
    return out


def rolled(h: np.ndarray, k: int, factor: int = 0xA24BAED4963EE407) -> np.ndarray:
    """Hashes of all windows of k consecutive hashes (length len(h) - k + 1 or 0), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    f, done, out, part, width = factor | 1, 0, np.zeros(n, U64), h, 1
    rest = k
    while rest:
        if rest & 1:  # out covers ``done`` values so far; append ``width`` more
            out = out * U64(pow(f, width, 1 << 64)) + part[done : done + n]
            done += width
        rest >>= 1
        if rest:
            part = part[: len(part) - width] * U64(pow(f, width, 1 << 64)) + part[width:]
            width *= 2
    return mix(out + U64(k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    part, width = x, 1
    while width * 2 <= w:
        part = np.minimum(part[:-width], part[width:])
        width *= 2
    return np.minimum(part[: len(x) - w + 1], part[w - width : w - width + len(x) - w + 1])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    n, at = len(column), column.offset
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[at : at + n + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each part hold about ``limit`` bytes (a longer text stands alone)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total, at = np.cumsum(size), 0
        while at < len(size):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each position."""
    return np.searchsorted(offsets, at, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets by row): maximal runs without white space inside a row."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    ink = ~WHITE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, line offsets by row): what \\n splits; every row has at least one line."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    # A break at a row's last byte starts an empty line at the next row's offset; stable order keeps it before.
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    count = np.diff(np.searchsorted(breaks, offsets)) + 1
    return start, end, np.concatenate([[0], np.cumsum(count)])


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of code points."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges without white space at both ends."""
    ink = np.flatnonzero(~WHITE[data])
    if not len(ink):
        return start, start.copy()
    lo, hi = np.searchsorted(ink, start), np.searchsorted(ink, end) - 1
    some = hi >= lo
    return np.where(some, ink[np.minimum(lo, len(ink) - 1)], start), np.where(some, ink[np.maximum(hi, 0)] + 1, start)


def doc_hash(x: np.ndarray) -> np.ndarray:
    """Spread of ids over buckets."""
    return mix(np.asarray(x).astype(np.int64).view(U64) + U64(_ODD[1]))


def group_starts(*keys: np.ndarray) -> np.ndarray:
    """True where a row of sorted keys differs from the one before."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return new


def within(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, joined."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
