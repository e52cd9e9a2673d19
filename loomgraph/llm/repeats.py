"""Finding windows of symbols that also start earlier, without pairs.

A window of ``length`` symbols is anchored at the least hash among its k-grams (winnowing), so equal
windows have equal anchors at equal places.  Consecutive windows of one document with the same
anchor form a run.  Runs meet by anchor:

* runs with equal content are settled at once: all but the first are covered;
* the first run of each content, where an anchor has several contents, sends its symbols to the
  anchor's shard, where the operator finds the repeats among them (``on_segments``); where an anchor
  has very many contents, its windows are spread over all tasks by window instead, so that no
  anchor's runs need meet in one task.

Map tasks settle equal runs within a block of documents before anything is sent, so frequent
passages and copies reach a shard once a block.  A place is (doc_id, start); smaller is earlier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K

_RUN, _COVER, _OPEN, _HOT, _SEG, _WIN, _TEXT = 0, 1, 2, 3, 4, 5, 9
_BLOCK = 500_000
#: Contents of one anchor, in a block or a shard, beyond which its windows are spread by window.
BLOCK_CONTENTS, SHARD_CONTENTS = 16, 2000
_F1, _F2, _F3 = 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC3A5C85C97CB3127

#: A slice's symbols: (64-bit values, offsets by row).
Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.text_bytes(column)
    return K.symbol_values()[data], offs


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = K.text_bytes(column)
    start, end, at = K.words(data, offs)
    return K.range_hashes(data, start, end, 0)[0], at


def _runs(values: np.ndarray, offs: np.ndarray, length: int, k: int) -> tuple:
    """(row, start in the row, windows, anchor hash, content hash) of each run."""
    n = len(values)
    if n < length:
        z = np.zeros(0, np.int64)
        return z, z, z, z.view(K.U64), z.view(K.U64)
    grams = K.rolled(values, k)
    key = (grams & K.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=K.U64)
    anchor = (K.sliding_min(key, length - k + 1) & K.U64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offs)
    room = np.repeat(offs[1:], size)[: n - length + 1] - np.arange(n - length + 1)
    at = np.flatnonzero(room >= length)
    new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(anchor[at], prepend=-1) != 0))
    start, count = at[new], np.diff(np.append(new, len(at)))
    # A run's first and last window overlap or touch, as it has fewer windows than ``length``.
    window = K.rolled(values, length, _F2)
    content = K.mix(window[start] + K.mix(window[start + count - 1] + count.astype(K.U64)))
    row = K.owners(offs, start)
    return row, start - offs[row], count, grams[anchor[start]], content


def _later(doc: np.ndarray, start: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows, sorted by place within groups, that are later than the first of their group."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc != doc[first]) | (start != start[first])


def _marks(out: X.Sender, tag: int, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from out.add(tag, K.doc_hash(doc), {"doc": doc, "start": start.astype(np.int32), "n": n.astype(np.int32)})


def _collect(n: int, symbols: Symbols, length: int, k: int, contents: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = X.Sender(n), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            a, c, doc, start, count = (np.concatenate([h[i] for h in held]) for i in range(5))
            order = np.lexsort((start, doc, c, a))
            a, c, doc, start, count = a[order], c[order], doc[order], start[order], count[order]
            new = K.group_starts(a, c)
            late = _later(doc, start, new) if len(a) else new
            yield from _marks(out, _COVER, doc[late], start[late], count[late])
            a, c, doc, start, count = a[new], c[new], doc[new], start[new], count[new]
            first = K.group_starts(a)
            hot = (np.bincount(np.cumsum(first) - 1) > contents)[np.cumsum(first) - 1] if len(a) else first
            yield from _marks(out, _HOT, doc[hot], start[hot], count[hot])
            sign = hot & first  # tells the shard that the anchor is spread; it has no windows
            send = ~hot | sign
            yield from out.add(_RUN, a[send], {"a": a[send], "c": c[send], "doc": doc[send], "start": start[send].astype(np.int32), "n": np.where(sign, 0, count)[send].astype(np.int32)})

        for part in K.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            row, start, count, a, c = _runs(*symbols(part.column("text")), length, k)
            held.append((a, c, ids[row], start, count))
            size += len(a)
            if size > _BLOCK:
                yield from settle()
                held, size = [], 0
        if held:
            yield from settle()
        yield from out.flush()

    return run


def _meet(n: int, most: int):
    """Shard side: runs by anchor and content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b, tag, frame in X.frames(batches):
            if tag == _RUN:
                parts.append(X.unpack(frame))
            else:
                yield X.row(b, tag, frame)
        if not parts:
            return
        r = X.joined(parts)
        del parts
        order = np.lexsort((r["start"], r["doc"], r["n"] == 0, r["c"], r["a"]))
        a, c, doc, start, count = (r[x][order] for x in ("a", "c", "doc", "start", "n"))
        del r, order
        real = count > 0
        group = np.cumsum(K.group_starts(a)) - 1
        spread = np.bincount(group, ~real) > 0
        a, c, doc, start, count, group = a[real], c[real], doc[real], start[real], count[real], group[real]
        if not len(a):
            return
        new = K.group_starts(a, c)
        late = _later(doc, start, new)
        contents = np.bincount(group, new, len(spread))
        spread |= contents > most
        out = X.Sender(n)
        yield from _marks(out, _COVER, doc[late], start[late], count[late])
        many = new & ((contents > 1) | spread)[group]
        for tag, pick in ((_OPEN, many & ~spread[group]), (_HOT, many & spread[group])):
            yield from _marks(out, tag, doc[pick], start[pick], count[pick])
        yield from out.flush()

    return run


def _by_doc(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    if not parts:
        return {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}
    r = X.joined(parts)
    order = np.lexsort((r["start"], r["doc"]))
    return {"doc": r["doc"][order], "start": r["start"][order].astype(np.int64), "n": r["n"][order].astype(np.int64)}


def _of_rows(marks: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, n) of the marks of these rows."""
    lo, hi = np.searchsorted(marks["doc"], ids), np.searchsorted(marks["doc"], ids, "right")
    row = np.repeat(np.arange(len(ids)), hi - lo)
    at = np.repeat(lo, hi - lo) + K.within(hi - lo)
    return row, marks["start"][at], marks["n"][at]


def _extend(n: int, symbols: Symbols, length: int, k: int, raw: bool):
    """Document side: segments of open runs by anchor, windows of hot ones; ``raw`` segments are bytes, others symbols."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: dict[int, list] = {_OPEN: [], _HOT: []}
        ready, out, held, size = None, X.Sender(n), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            w1, w2, doc, start = (np.concatenate([h[i] for h in held]) for i in range(4))
            order = np.lexsort((start, doc, w2, w1))
            w1, w2, doc, start = w1[order], w2[order], doc[order], start[order]
            new = K.group_starts(w1, w2)
            late = _later(doc, start, new) if len(w1) else new
            yield from _marks(out, _COVER, doc[late], start[late], np.ones(late.sum(), np.int32))
            yield from out.add(_WIN, w1[new], {"w1": w1[new], "w2": w2[new], "doc": doc[new], "start": start[new].astype(np.int32)})

        for _, tag, frame in X.frames(batches):
            if tag != _TEXT:
                marks[tag].append(X.unpack(frame))
                continue
            if ready is None:
                ready = {t: _by_doc(m) for t, m in marks.items()}
            batch = X.unpack(frame)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            some = np.isin(ids, ready[_OPEN]["doc"]) | np.isin(ids, ready[_HOT]["doc"])
            for part in K.slices([batch.filter(pa.array(some))]):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                values, offs = symbols(part.column("text"))
                row, start, count = _of_rows(ready[_HOT], ids)
                if len(row):
                    w1, w2 = (K.rolled(values, length, f) for f in (_F2, _F3))
                    first = np.repeat(start, count) + K.within(count)
                    row = np.repeat(row, count)
                    at = first + offs[row]
                    held.append((w1[at], w2[at], ids[row], first))
                    size += len(at)
                row, start, count = _of_rows(ready[_OPEN], ids)
                if len(row):
                    data, at = K.text_bytes(part.column("text")) if raw else (values, offs)
                    lo = at[row] + start
                    hi = lo + count - 1 + length
                    cut = np.concatenate([[0], np.cumsum(hi - lo)])
                    body = data[np.repeat(lo - cut[:-1], hi - lo) + np.arange(cut[-1])]
                    seg = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer((cut * body.itemsize).astype(np.int64)), pa.py_buffer(body)])
                    # The anchor again, as the bucket: the least k-gram of the run's first window.
                    grams = K.rolled(values, k)
                    key = (grams & K.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=K.U64)
                    anchor = (K.sliding_min(key, length - k + 1)[lo] & K.U64(0xFFFFFFFF)).astype(np.int64)
                    yield from out.add(_SEG, grams[anchor], {"a": grams[anchor], "doc": ids[row], "start": start.astype(np.int32), "n": count.astype(np.int32), "at": (anchor - lo).astype(np.int32), "seg": seg})
                if size > 2 * _BLOCK:
                    yield from settle()
                    held, size = [], 0
        if held:
            yield from settle()
        yield from out.flush()

    return run


def _windows(n: int, length: int, on_segments: Callable):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, segs, out = [], [], X.Sender(n)
        for b, tag, frame in X.frames(batches):
            if tag == _WIN:
                parts.append(X.unpack(frame))
            elif tag == _SEG:
                segs.append(X.unpack(frame))
            else:
                yield X.row(b, tag, frame)
        if parts:
            r = X.joined(parts)
            order = np.lexsort((r["start"], r["doc"], r["w2"], r["w1"]))
            doc, start = r["doc"][order], r["start"][order]
            late = _later(doc, start, K.group_starts(r["w1"][order], r["w2"][order]))
            yield from _marks(out, _COVER, doc[late], start[late], np.ones(late.sum(), np.int32))
        if segs:
            yield from _marks(out, _COVER, *on_segments(segs, length))
        yield from out.flush()

    return run


def covered(marks: dict[str, np.ndarray], ids: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """True for each symbol of a slice that a marked window covers."""
    row, start, count = _of_rows(marks, ids)
    lo = offs[row] + start
    edge = np.zeros(int(offs[-1]) + 1, np.int64)
    np.add.at(edge, lo, 1)
    np.add.at(edge, lo + count - 1 + length, -1)
    return np.cumsum(edge)[:-1] > 0


def remove(src: DataFrame, keep: tuple[str, ...], symbols: Symbols, length: int, k: int, cut: Callable, out: tuple[pa.Schema, str], on_segments: Callable, spread: tuple[int, int] = (BLOCK_CONTENTS, SHARD_CONTENTS)) -> DataFrame:
    """``cut(part, marks)`` makes the result rows of a slice, given the marks of its documents.

    ``on_segments(frames, length)`` gets rows (a: anchor, doc, start, n: windows, at: place of the
    anchor in the segment, seg) of whole anchors and gives (doc, start, windows) of later repeats.

    src: doc_id long (not null), text string, further columns.
    """
    spark = src.sparkSession
    n = X.bucket_count(spark)
    two = src.select("doc_id", "text")
    met = X.stored(X.shuffled(two.mapInArrow(_collect(n, symbols, length, k, spread[0]), X.FRAMES), n).mapInArrow(_meet(n, spread[1]), X.FRAMES), "repeats")
    opened = X.shuffled(met.where(met.tag != _COVER).union(X.text_frames(two, n, tag=_TEXT)), n).mapInArrow(_extend(n, symbols, length, k, symbols is byte_symbols), X.FRAMES)
    late = X.shuffled(opened, n).mapInArrow(_windows(n, length, on_segments), X.FRAMES)

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list | dict = []
        for _, tag, frame in X.frames(batches):
            if tag != _TEXT:
                marks.append(X.unpack(frame))
                continue
            if isinstance(marks, list):
                marks = _by_doc(marks)
            for part in K.slices([X.unpack(frame)]):
                yield cut(part, marks)

    whole = X.text_frames(src, n, extra=keep, tag=_TEXT)
    return X.shuffled(met.where(met.tag == _COVER).union(late).union(whole), n).mapInArrow(final, out[1])
