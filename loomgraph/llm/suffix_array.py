"""Repeats of bytes by an enhanced suffix array and its common-prefix interval tree.

``suffix_array`` and ``common_prefixes`` build the array over many segments at once; ``intervals``
scans it with a stack and gives the nodes of the interval tree; ``maximal_repeats`` keeps nodes whose
occurrences differ in what stands to their left, with all their occurrences.  Segments reach a task
by anchor (see ``repeats``): any two equal strings of ``length`` bytes share an anchor, so they are
in the same array.  Segments that agree as a whole, and anchors with very many different segments,
are settled by hashes before (``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm import repeats
from loomgraph.llm.line_dedup import arrow_schema, with_ids

LENGTH, ANCHOR = 100, 20
#: Bytes of segments in one suffix array.
ARRAY_BYTES = 512 << 10


def suffix_array(data: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(array, ranks by 2**i first symbols) of segments data[cut[i]:cut[i+1]]; nothing matches across an end."""
    n, parts = len(data), len(cut) - 1
    # One end mark after each segment, all different and less than any byte.
    at = np.arange(n) + np.repeat(np.arange(parts), np.diff(cut))
    rank = np.zeros(n + parts, np.int64)
    rank[at] = data.astype(np.int64) + parts
    rank[cut[1:] + np.arange(parts)] = np.arange(parts)
    def doubled(level: np.ndarray, width: int, limit: int) -> np.ndarray:
        """Keys of twice as many symbols; values of ``level`` are below ``limit``."""
        follow = np.zeros(len(level), np.int64)
        follow[: len(level) - width] = level[width:] + 1
        return level * (limit + 1) + follow

    # Two and four symbols fit into one key as they are; only then is there something to sort.
    limit, longest = parts + 256, int(np.diff(cut).max(initial=0)) + 1
    levels, width = [rank], 1
    while width < 4 and (limit + 1) ** 2 < 1 << 62:
        rank, limit, width = doubled(rank, width, limit), (limit + 1) ** 2, 2 * width
        levels.append(rank)
    while True:
        order = np.argsort(rank)  # equal keys in any order: their ranks are equal
        new = K.group_starts(rank[order])
        if width >= longest or new.all():
            break
        rank = np.empty(len(new), np.int64)
        rank[order] = np.cumsum(new) - 1
        levels[-1] = rank
        rank = doubled(rank, width, len(rank))
        levels.append(rank)
        width *= 2
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Length of the common prefix of each suffix in the array with the one before (0 for the first)."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(max(0, n - 1), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        pad = np.append(levels[i], [-1])
        while True:
            same = (a < n) & (b < n)
            same &= pad[np.minimum(a, n)] == pad[np.minimum(b, n)]
            if not same.any():
                break
            step = np.where(same, 1 << i, 0)
            out += step
            a += step
            b += step
            if i < len(levels) - 1:
                break
    return np.concatenate([[0], out])[:n]


def intervals(prefix: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(depth, first, last) of the interval tree's nodes with depth >= least, by one scan with a stack."""
    out, stack = [], []
    hot = np.flatnonzero(prefix >= least)
    before = -2
    for i in hot.tolist():
        depth = int(prefix[i])
        if i != before + 1:
            out += [(d, lo, before) for d, lo in reversed(stack)]
            stack = []
        lo = i - 1
        while stack and stack[-1][0] > depth:
            d, lo = stack.pop()
            out.append((d, lo, i - 1))
        if not stack or stack[-1][0] < depth:
            stack.append((depth, lo))
        before = i
    out += [(d, lo, before) for d, lo in reversed(stack)]
    return out


def maximal_repeats(segments: list[bytes], least: int, left: list[int] | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(length, [(segment, start), ...])] of strings that repeat and can't be made longer on either side.

    left: the byte before each segment, -1 where there is none; unlike all others where it is not given.
    """
    cut = np.concatenate([[0], np.cumsum([len(s) for s in segments])]).astype(np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    order, levels = suffix_array(data, cut)
    prefix = common_prefixes(order, levels)
    starts = cut[:-1] + np.arange(len(segments))
    owner = np.searchsorted(starts, order, "right") - 1
    place = order - starts[owner]
    before = np.array([segments[s][p - 1] if p else (left[s] if left and left[s] >= 0 else -1 - i) for i, (s, p) in enumerate(zip(owner.tolist(), place.tolist(), strict=True))])
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    return [(d, sorted(zip(owner[lo : hi + 1].tolist(), place[lo : hi + 1].tolist(), strict=True))) for d, lo, hi in intervals(prefix, least) if change[hi] != change[lo]]


def _later_repeats(segs: list[pa.RecordBatch], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, windows) of the later occurrences of maximal repeats, among the segments of one shard.

    Equal windows have one anchor, so the shard is done in groups of whole anchors: a suffix array
    holds about ``ARRAY_BYTES``, or the segments of one anchor, of which there are few.
    """
    t = pa.Table.from_batches(segs)
    a = t.column("a").to_numpy()
    order = np.argsort(a, kind="stable")
    a = a[order]
    heads = np.flatnonzero(K.group_starts(a))
    size = np.cumsum(t.column("n").to_numpy().astype(np.int64)[order] + length)
    found, at = [], 0
    while at < len(heads):
        base = size[heads[at] - 1] if heads[at] else 0
        to = max(at + 1, int(np.searchsorted(size[np.append(heads[1:], len(a)) - 1], base + ARRAY_BYTES, "right")))
        end = heads[to] if to < len(heads) else len(a)
        found.append(_later_in_array(t.take(pa.array(order[heads[at] : end])).combine_chunks(), length))
        at = to
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))  # type: ignore[return-value]


def _left_of(order: np.ndarray, owner: np.ndarray, place: np.ndarray, data: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The byte before each suffix; where a segment begins, a value unlike all others."""
    return np.where(place > 0, data[np.maximum(cut[owner] + place - 1, 0)].astype(np.int64), -1 - np.arange(len(order)))


def _later_in_array(t: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of the interval tree, and all their occurrences but the earliest.

    A window that starts twice lies in a maximal repeat that has both occurrences, as the match can
    be made longer on both sides until it ends; so these cover what the windows cover.
    """
    doc, start = (t.column(c).to_numpy().astype(np.int64) for c in ("doc", "start"))
    data, cut = K.text_bytes(t.column("seg"))
    order, levels = suffix_array(data, cut)
    prefix = common_prefixes(order, levels)
    del levels
    starts = cut[:-1] + np.arange(len(doc))
    owner = np.searchsorted(starts, order, "right") - 1
    place = order - starts[owner]
    nodes = np.array(intervals(prefix, length), np.int64).reshape(-1, 3)
    left = _left_of(order, owner, place, data, cut)
    change = np.concatenate([[0], np.cumsum(left[1:] != left[:-1])])
    depth, lo, hi = nodes[change[nodes[:, 1]] != change[nodes[:, 2]]].T if len(nodes) else np.zeros((3, 0), np.int64)
    found = [(np.zeros(0, np.int64),) * 3]
    for i in range(0, len(depth), 4096):
        size = hi[i : i + 4096] - lo[i : i + 4096] + 1
        at = np.repeat(lo[i : i + 4096], size) + K.within(size)
        group = np.repeat(np.arange(len(size)), size)
        d, s = doc[owner[at]], start[owner[at]] + place[at]
        by = np.lexsort((s, d, group))
        d, s, group = d[by], s[by], group[by]
        late = repeats._later(d, s, K.group_starts(group))
        found.append((d[late], s[late], depth[i : i + 4096][group[late]] - length + 1))
    d, s, windows = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(d):
        return d, s, windows
    by = np.lexsort((-windows, s, d))  # of the repeats that start at one place the longest is enough
    once = by[K.group_starts(d[by], s[by])]
    return d[once], s[once], windows[once]


def dedup_bytes(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, spread: tuple[int, int] = (repeats.BLOCK_CONTENTS, repeats.SHARD_CONTENTS)) -> DataFrame:
    """Removes every byte covered by a ``length``-byte string that also starts earlier.

    Texts are UTF-8 bytes (null: empty) and matches never cross documents.  Returns doc_id, kept
    (binary: a cut may fall inside a character), n_bytes, n_removed and n_spans (maximal removed
    runs).  Rows without doc_id are left out; rows that repeat a doc_id stand at the same place, so
    none of them is earlier than the other.
    """
    src = with_ids(docs)
    schema, ddl = arrow_schema(src, (), [("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])

    def cut(part: pa.RecordBatch, marks: dict) -> pa.RecordBatch:
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        data, offs = K.text_bytes(part.column("text"))
        gone = repeats.covered(marks, ids, offs, length)
        open_ = gone.copy()
        open_[1:] &= ~gone[:-1]
        heads = offs[:-1][offs[:-1] < len(data)]
        open_[heads] = gone[heads]
        left = np.concatenate([[0], np.cumsum(~gone)])[offs]
        kept = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(left.astype(np.int32)), pa.py_buffer(data[~gone])])
        spans = np.diff(np.concatenate([[0], np.cumsum(open_)])[offs])
        return pa.record_batch([pa.array(ids, pa.int64()), kept, pa.array(np.diff(offs)), pa.array(np.diff(offs) - np.diff(left)), pa.array(spans)], schema=schema)

    return repeats.remove(src, (), repeats.byte_symbols, length, anchor, cut, (schema, ddl), _later_repeats, spread)
