"""Quality rules: word and line statistics of a document, and line frequency across documents.

A line (stripped, A-Z lower-cased, hashed) that many documents of one host hold is that host's
furniture: it is taken out of all but the first of them, and documents that keep too little are
rejected.  Counts run over all documents.  Map tasks work in blocks of documents: a block sends a
line once to the line's shard, however frequent it is, and hears once whether it is over the limit;
which of its documents hold the line stays with the block.

A line is over the limit when it is in at least ``min_docs`` documents of its host and in more than
``share`` of all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm.line_dedup import _mark, arrow_schema, check_names, with_ids

MIN_DOCS, SHARE, MIN_WORDS, MIN_LEFT, MAX_REPEAT = 5, 0.02, 10, 0.2, 0.2
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LINE, _OFTEN, _HELD, _DROP, _TEXT = 0, 1, 2, 3, 9
_BLOCK = 400_000


def _host_hash(column: pa.Array) -> np.ndarray:
    """64-bit hash of each host; null is a host of its own."""
    data, offs = K.text_bytes(column)
    (h,) = K.range_hashes(data, offs[:-1], offs[1:], 1)
    if column.null_count:
        h[column.is_null().to_numpy(zero_copy_only=False)] = K.U64(7)
    return h


def _lines(part: pa.RecordBatch, host: str) -> tuple:
    """(row, words, key) of the lines that have a word, and where they are; the key tells host and line."""
    data, offs = K.text_bytes(part.column("text"))
    start, end, at = K.lines(data, offs)
    lo, hi = K.stripped(data, start, end)
    pick = np.flatnonzero(hi > lo)
    first, _, _ = K.words(data, offs)
    n_words = np.searchsorted(first, hi[pick]) - np.searchsorted(first, lo[pick])
    row = K.owners(at, pick)
    low = K.LOWER[data]
    k1, k2 = K.range_hashes(low, lo[pick], hi[pick], 0, 1)
    hosts = _host_hash(part.column(host))
    return row, n_words, K.mix(k1 + hosts[row]), k2, hosts, (data, start, end, at, pick)


def features(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, offs = K.text_bytes(column)
    start, end, at = K.words(data, offs)
    points, rows = K.code_points(data), len(offs) - 1
    count = lambda marks: np.diff(np.concatenate([[0], np.cumsum(marks)])[offs])
    out = {"n_words": np.diff(at), "word_chars": np.diff(points[offs]) - count(WHITE_AT[data]), "n_symbols": count(_SYMBOLS[data])}
    lo, hi, cut = K.lines(data, offs)
    inked = np.searchsorted(start, hi) > np.searchsorted(start, lo)
    row = np.repeat(np.arange(rows), np.diff(cut))[inked]
    h1, h2 = K.range_hashes(data, lo[inked], hi[inked], 0, 1)
    order = np.lexsort((h2, h1, row))
    again = ~K.group_starts(row[order], h1[order], h2[order])
    out["n_dup_lines"] = np.bincount(row[order][again], minlength=rows)
    grams = K.rolled(K.range_hashes(data, start, end, 0)[0], 5)
    word_row = np.repeat(np.arange(rows), np.diff(at))
    whole = np.flatnonzero(at[1:][word_row[: len(grams)]] - np.arange(len(grams)) >= 5)
    order = whole[np.lexsort((grams[whole], word_row[whole]))]
    new = K.group_starts(word_row[order], grams[order])
    size = np.bincount(np.cumsum(new) - 1) if len(order) else np.zeros(0, np.int64)
    twice = order[(size > 1)[np.cumsum(new) - 1]] if len(order) else order
    edge = np.zeros(len(start) + 6, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 5, -1)
    covered = np.cumsum(edge)[: len(start)] > 0
    out["n_repeat_words"] = np.diff(np.concatenate([[0], np.cumsum(covered)])[at])
    return {k: v.astype(np.int64) for k, v in out.items()}


WHITE_AT = K.WHITE


def _count(n: int, host: str):
    """Map side: each line once a block, and the block's list of documents that hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size, block = X.Sender(n), [], 0, TaskContext.get().partitionId() << 32

        def settle() -> Iterator[pa.RecordBatch]:
            k1, k2, h, doc = (np.concatenate([x[i] for x in held]) for i in range(4))
            order = np.lexsort((doc, k2, k1))
            k1, k2, h, doc = k1[order], k2[order], h[order], doc[order]
            at = np.flatnonzero(K.group_starts(k1, k2))
            many = np.diff(np.append(at, len(k1)))
            yield from out.add(_LINE, k1[at], {"k1": k1[at], "k2": k2[at], "h": h[at], "doc": doc[at], "w": many.astype(np.int32), "f": np.full(len(at), block)})
            yield from out.add(_HELD, K.doc_hash(np.full(len(doc), block)), {"k1": k1, "k2": k2, "doc": doc, "f": np.full(len(doc), block)})

        for part in K.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            row, _, k1, k2, hosts, _ = _lines(part, host)
            order = np.lexsort((k2, k1, row))
            once = order[K.group_starts(row[order], k1[order], k2[order])]
            held.append((k1[once], k2[once], hosts[row[once]], ids[row[once]]))
            size += len(once)
            if size > _BLOCK:
                yield from settle()
                held, size, block = [], 0, block + 1
        if held:
            yield from settle()
        yield from out.flush()

    return run


def _often(least: int):
    """Shard side: a row for each line of enough documents and block that holds it; lists of blocks pass."""
    names = ("k1", "k2", "h", "first_doc", "n_docs", "f")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for b, tag, frame in X.frames(batches):
            if tag == _LINE:
                parts.append(X.unpack(frame))
            else:
                passed = X.row(b, tag, frame)
                yield pa.record_batch([*passed.columns, *(pa.nulls(1, pa.int64()) for _ in names)], names=[*passed.schema.names, *names])
        if not parts:
            return
        r = X.joined(parts)
        order = np.lexsort((r["doc"], r["k2"], r["k1"]))
        k1, k2, h, doc, w, f = (r[c][order] for c in ("k1", "k2", "h", "doc", "w", "f"))
        new = K.group_starts(k1, k2)
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        total = np.add.reduceat(w.astype(np.int64), at)
        some = np.flatnonzero(total[group] >= least)
        blank = [pa.nulls(len(some), t) for t in (pa.int32(), pa.int32(), pa.binary())]
        found = (k1.view(np.int64), k2.view(np.int64), h.view(np.int64), doc[at][group], total[group], f)
        yield pa.record_batch([*blank, *(pa.array(x[some]) for x in found)], names=["b", "tag", "frame", *names])

    return run


def _host_sizes(host: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, count = np.unique(_host_hash(batch.column(host)), return_counts=True)
            yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(count)], names=["h", "n"])

    return run


def _counted(docs: DataFrame, host: str, min_docs: int, share: float) -> tuple[DataFrame, DataFrame]:
    """(lines over the limits: a row for each block that holds one, with f; frames of what blocks hold)."""
    n = X.bucket_count(docs.sparkSession)
    src = with_ids(docs, F.col(host).cast("string").alias("_host"))
    kinds = X.FRAMES + ", k1 long, k2 long, h long, first_doc long, n_docs long, f long"
    met = X.stored(X.shuffled(src.mapInArrow(_count(n, "_host"), X.FRAMES), n).mapInArrow(_often(min_docs), kinds), "line-counts")
    sizes = src.select("_host").mapInArrow(_host_sizes("_host"), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    over = met.where("frame is null").join(sizes, "h").where(F.col("n_docs") > share * F.col("n"))
    return over.select("k1", "k2", "first_doc", "n_docs", "f"), met.where("frame is not null").select("b", "tag", "frame")


def frequent_lines(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE) -> DataFrame:
    """k1, k2, first_doc, n_docs of the lines over the limits of their host."""
    return _counted(docs, host, min_docs, share)[0].select("k1", "k2", "first_doc", "n_docs").distinct()


def _verdict(f: dict[str, np.ndarray], lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    failed = (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > round(100 * MAX_REPEAT) * f["n_words"])
    left = f["n_words"] - lost
    return failed, ~failed & (left >= MIN_WORDS) & (left >= MIN_LEFT * f["n_words"])


def quality(docs: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, share: float = SHARE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Statistics and verdict of each document.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_frequent_words
    (words in lines over the limits, where an earlier document of the host holds the line too),
    base_failed, kept and the columns in ``keep``; ``text`` there comes without those lines, the rest
    joined by \\n.  A document is kept unless it has fewer than 10
    words, more than 20 % of its words in repeated 5-word windows, or, without its frequent lines,
    fewer than 10 words or less than a fifth of its words.  A null or empty text has no words and
    fails.  A null host is a host of its own.  Rows without doc_id are left out; repeated rows count
    as documents of their own, and all rows that share a line's smallest doc_id keep the line.
    Columns in ``keep`` must not have the name of a result other than ``text``.
    """
    names = [(c, pa.int64()) for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_frequent_words")] + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    check_names(keep, names)
    n = X.bucket_count(docs.sparkSession)
    src = with_ids(docs, F.col(host).cast("string").alias("_host"), *(c for c in keep if c != "text"))
    over, held = _counted(docs, host, min_docs, share)
    schema, ddl = arrow_schema(src, keep, names)

    def judged(part: pa.RecordBatch, marks: np.ndarray) -> pa.RecordBatch:
        ids, text = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("text")
        made = features(text)
        made["n_frequent_words"] = np.zeros(len(ids), np.int64)
        if len(marks):
            row, words, k1, k2, _, where = _lines(part, "_host")
            hit = _marked(marks, _mark(ids[row], k1, k2))
            made["n_frequent_words"] = np.bincount(row[hit], words[hit], len(ids)).astype(np.int64)
            if "text" in keep:
                text = _without(text, where, hit)
        made["base_failed"], made["kept"] = _verdict(made, made["n_frequent_words"])
        made["doc_id"] = ids
        return pa.record_batch([pa.array(made[f.name]) if f.name in made else (text if f.name == "text" else part.column(f.name)).cast(f.type) for f in schema], schema=schema)

    def tell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for part in batches:
            k1, k2, first, f = (part.column(c).to_numpy() for c in ("k1", "k2", "first_doc", "f"))
            yield from out.add(_OFTEN, K.doc_hash(f), {"k1": k1.view(K.U64), "k2": k2.view(K.U64), "first": first, "f": f})
        yield from out.flush()

    def drops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: list | np.ndarray = []
        out = X.Sender(n)
        for _, tag, frame in X.frames(batches):
            if tag == _OFTEN:
                told.append(X.unpack(frame))
                continue
            if isinstance(told, list):
                if not told:
                    return
                t = X.joined(told)
                of_block = _mark(t["f"], t["k1"], t["k2"])
                order = np.argsort(of_block, kind="stable")
                told, first = of_block[order], t["first"][order]
            r = X.joined([X.unpack(frame)])
            mine = _mark(r["f"], r["k1"], r["k2"])
            at = np.minimum(np.searchsorted(told, mine), len(told) - 1)
            hit = (told[at] == mine) & (r["doc"] > first[at])
            doc = r["doc"][hit]
            yield from out.add(_DROP, K.doc_hash(doc), {"mark": _mark(doc, r["k1"][hit], r["k2"][hit])})
        yield from out.flush()

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list | np.ndarray = []
        for _, tag, frame in X.frames(batches):
            if tag == _DROP:
                marks.append(X.unpack(frame))
                continue
            if isinstance(marks, list):
                marks = np.unique(X.joined(marks)["mark"]) if marks else np.zeros(0, K.U64)
            for part in K.slices([X.unpack(frame)]):
                yield judged(part, marks)

    lost = X.shuffled(over.mapInArrow(tell, X.FRAMES).union(held), n).mapInArrow(drops, X.FRAMES)
    texts = X.text_frames(src, n, extra=("_host", *(c for c in keep if c != "text")), tag=_TEXT)
    return X.shuffled(lost.union(texts), n).mapInArrow(apply, ddl)


def _marked(marks: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.flatnonzero(marks[np.minimum(np.searchsorted(marks, m), len(marks) - 1)] == m)


def _without(text: pa.Array, where: tuple, hit: np.ndarray) -> pa.Array:
    """The texts without the lines that are hit; what is left is joined by \\n."""
    if not len(hit):
        return text
    data, start, end, at, pick = where
    drop = np.zeros(len(start), bool)
    drop[pick[hit]] = True
    lost = np.diff(np.concatenate([[0], np.cumsum(drop)])[at])
    raw, out = data.tobytes(), text.to_pylist()
    for i in np.flatnonzero(lost):
        out[i] = b"\n".join(raw[start[j] : end[j]] for j in range(at[i], at[i + 1]) if not drop[j]).decode()
    return pa.array(out, text.type)
