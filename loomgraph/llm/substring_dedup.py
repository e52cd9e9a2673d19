"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the 8-word grams of each 20-word window, the one with the least hash.
Documents are joined on seeds (see ``repeats``).  Seeds whose whole neighbourhood agrees are one
match already; segments around other seeds are joined where they agree, each with the earliest, and
matches are extended both ways word by word.  Matches of at least ``window`` words count.  Seeds with
very many different segments are settled by window hashes instead (``repeats``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import kernel as K
from loomgraph.llm import repeats
from loomgraph.llm.line_dedup import arrow_schema, check_names, with_ids

WINDOW, SEED = 20, 8


def _stretch(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """How many symbols from the starts on (``step`` 1) or back (-1) agree, at most ``room``."""
    out, on = np.zeros(len(room), np.int64), room > 0
    while on.any():
        i = np.flatnonzero(on)
        same = a[start_a[i] + step * out[i]] == b[start_b[i] + step * out[i]]
        out[i[same]] += 1
        on[i] = same & (out[i] < room[i])
    return out


def extended(segs: list[pa.RecordBatch], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, windows) of later matches among segments that share a seed.

    The segments of a seed are joined by what stands to its left and right: for each way in which a
    window can lie around the seed, a segment meets the earliest one that agrees there.  Each such
    pair is extended both ways as far as it agrees, and the match counts if it is long enough.
    """
    t = pa.Table.from_batches(segs).combine_chunks()
    a, doc, start, at = (t.column(c).to_numpy() for c in ("a", "doc", "start", "at"))
    raw, cut = K.text_bytes(t.column("seg"))
    words, cut = np.ascontiguousarray(raw).view(K.U64), cut // 8
    count, at = t.column("n").to_numpy().astype(np.int64), at.astype(np.int64)
    window = K.rolled(words, length)
    pairs = []
    for back in range(int(at.max(initial=-1)) + 1):  # the seed stands ``back`` words inside the window
        first = at - back
        some = np.flatnonzero((first >= 0) & (first < count))
        place = start[some] + first[some]
        order = np.lexsort((place, doc[some], window[cut[some] + first[some]], a[some]))
        some, place = some[order], place[order]
        if not len(some):
            continue
        new = K.group_starts(a[some], window[cut[some] + first[some]])
        head = some[np.flatnonzero(new)[np.cumsum(new) - 1]]
        late = repeats._later(doc[some], place, new)
        pairs.append(np.stack([some[late], head[late]]))
    if not pairs:
        return (np.zeros(0, np.int64),) * 3
    x, y = np.unique(np.concatenate(pairs, axis=1), axis=1)
    seed_x, seed_y = cut[x] + at[x], cut[y] + at[y]
    left = _stretch(words, words, seed_x - 1, seed_y - 1, np.minimum(at[x], at[y]), -1)
    right = _stretch(words, words, seed_x, seed_y, np.minimum(cut[x + 1] - seed_x, cut[y + 1] - seed_y), 1)
    long = left + right >= length
    x, left, right = x[long], left[long], right[long]
    return doc[x], (start[x] + at[x] - left).astype(np.int64), left + right - length + 1


def join_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> pa.Array:
    """Strings of each row's ranges joined by one space; at: range offsets by row."""
    size = end - start + 1
    out = np.concatenate([[0], np.cumsum(size)])
    body = np.repeat(start - out[:-1], size)
    body += np.arange(out[-1])
    text = np.append(data, np.uint8(32))[np.minimum(body, len(data))]
    text[out[1:] - 1] = 32
    lo, hi = out[at[:-1]], out[at[1:]]
    raw, hi = text.tobytes(), np.where(at[1:] > at[:-1], hi - 1, hi)
    return pa.array([raw[a:b] for a, b in zip(lo, hi, strict=True)], pa.binary()).cast(pa.string())


def dedup_substrings(docs: DataFrame, window: int = WINDOW, seed: int = SEED, keep: tuple[str, ...] = (), spread: tuple[int, int] = (repeats.BLOCK_CONTENTS, repeats.SHARD_CONTENTS)) -> DataFrame:
    """Removes every word covered by a ``window``-word sequence that also starts earlier.

    Earlier: a smaller doc_id, or the same document and an earlier start.  Windows are judged on
    the input.  Returns doc_id, text (kept words joined by one space), n_words, n_removed and the
    columns in ``keep``.  Null, empty and shorter texts have no window and lose nothing.  Rows
    without doc_id are left out; rows that repeat a doc_id stand at the same place, so none of them
    is earlier than the other.
    """
    names = [("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    check_names(keep, names)
    src = with_ids(docs, *keep)
    schema, ddl = arrow_schema(src, keep, names)

    def cut(part: pa.RecordBatch, marks: dict) -> pa.RecordBatch:
        ids = part.column("doc_id").to_numpy(zero_copy_only=False)
        data, offs = K.text_bytes(part.column("text"))
        start, end, at = K.words(data, offs)
        gone = repeats.covered(marks, ids, at, window)
        left = np.concatenate([[0], np.cumsum(~gone)])[at]
        text = join_ranges(data, start[~gone], end[~gone], left)
        made = {"doc_id": pa.array(ids, pa.int64()), "text": text, "n_words": pa.array(np.diff(at)), "n_removed": pa.array(np.diff(at) - np.diff(left))}
        return pa.record_batch([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)

    return repeats.remove(src, keep, repeats.word_symbols, window, seed, cut, (schema, ddl), extended, spread)
