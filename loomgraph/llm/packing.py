"""Best-fit packing of token sequences after a dominance reduction.

Pieces of equal length are interchangeable, so the instance is a histogram of at most ``capacity``
lengths, whatever the number of documents: only the histogram comes to the driver.  ``reduce_and_fit``
first fixes sets that dominate every other use of their largest piece (Martello and Toth): a piece
that nothing fits beside; a pair that fills a sequence; a piece and the largest that fits beside it
where no two others do; and the triple of that kind.  The remainder is packed best fit, largest
first.  Both work on counts, so a set is fixed for all pieces of its lengths at once.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm.line_dedup import with_ids

CAPACITY = 2048
_FAR = regex.compile(r"[^\x00-ɏ]").search


@functools.lru_cache(2)
def _library(path: str):
    """The library's tokenizer, loaded by workers that meet a text which needs it."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


@functools.lru_cache(2)
def encoder(path: str):
    """text -> ids of a byte-level BPE file, as the tokenizers library gives them.

    The library does the far scripts, whose character classes depend on its version of Unicode; the
    rest goes through a faster implementation of the same merges.
    """
    import json

    import tiktoken

    from loomgraph.llm.bpe import byte_alphabet

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    places = {c: i for i, c in enumerate(byte_alphabet())}
    ranks = {bytes(map(places.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    # Fixed value: the split pattern of byte-level pre-tokenizers.
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding(os.path.basename(path), pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    marks = list(special)
    del spec, places, ranks

    def encode(text: str) -> list[int]:
        if _FAR(text) or any(m in text for m in marks):
            return _library(path).encode(text, add_special_tokens=False).ids
        return fast(text)

    return encode


class Packing:
    """Where the pieces of each length go: intervals of their ranks, each over a run of sequences."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """rows: (length, first rank, pieces in a sequence, first sequence, offset in it)."""
        t = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.rank, self.each, self.sequence, self.offset = np.ascontiguousarray(t.T)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        key = self.length * (1 << 45) + self.rank  # ranks stay below 2**45
        i = np.searchsorted(key, length.astype(np.int64) * (1 << 45) + rank, "right") - 1
        at = rank - self.rank[i]
        return self.sequence[i] + at // self.each[i], self.offset[i] + (at % self.each[i]) * length


def reduce_and_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[Packing, dict[str, int]]:
    """Packs {length: pieces} into sequences; also tells how many were fixed and the lower bound."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        count[size] = n
    used = np.zeros(capacity + 1, np.int64)
    groups: list[tuple[list[tuple[int, int, int, int]], int, int]] = []  # members (length, each, offset, rank), room left, sequences

    def take(members: list[tuple[int, int]], n: int) -> None:
        """n sequences of these (length, each)."""
        at, made = 0, []
        for size, each in members:
            made.append((size, each, at, int(used[size])))
            at += size * each
            used[size] += n * each
            count[size] -= n * each
        groups.append((made, capacity - at, n))

    def largest(limit: int) -> int:
        some = np.flatnonzero(count[: limit + 1]) if limit > 0 else ()
        return int(some[-1]) if len(some) else 0

    fixed = 0
    for size in range(capacity, 0, -1):
        while count[size]:
            room = capacity - size
            small = np.flatnonzero(count)
            small = np.repeat(small[:4], np.minimum(count[small[:4]], 4))
            own = np.flatnonzero(small == size)
            small = np.delete(small, own[:1])  # the least other pieces
            if not len(small) or small[0] > room:
                sets, n = [(size, 1)], int(count[size])
            else:
                count[size] -= 1  # the piece itself is no partner
                first = largest(room)
                count[size] += 1
                pair = first == room or len(small) < 2 or small[0] + small[1] > room
                if pair:
                    same = first == size
                    sets, n = ([(size, 2)] if same else [(size, 1), (first, 1)]), int(count[size] // 2 if same else min(count[size], count[first]))
                elif len(small) < 3 or small[:3].sum() > room:
                    # At most two others fit; first and second cover any two that do.
                    count[size] -= 1
                    count[first] -= 1
                    second = largest(room // 2)
                    count[size] += 1
                    count[first] += 1
                    if not second or first + second > room or len({size, first, second}) < 3:
                        break
                    sets, n = [(size, 1), (first, 1), (second, 1)], int(min(count[size], count[first], count[second]))
                else:
                    break
            if not n:
                break
            take(sets, n)
            fixed += n
        if count[size]:
            break  # smaller pieces have still more partners
    open_: list[list] = []  # groups that have room: [members, room, sequences]
    for size in np.flatnonzero(count)[::-1].tolist():
        n = int(count[size])
        for g in sorted((g for g in open_ if g[1] >= size), key=lambda g: g[1]):
            if not n:
                break
            each = g[1] // size
            full = min(g[2], n // each)
            rest: list | None = g
            if full:
                head, n = _split(open_, g, full), n - full * each
                head[0].append((size, each, capacity - head[1], int(used[size])))
                used[size] += full * each
                head[1] -= each * size
                rest = g if head is not g else None
            if rest is not None and 0 < n < each:
                g = _split(open_, rest, 1)
                g[0].append((size, n, capacity - g[1], int(used[size])))
                used[size] += n
                g[1] -= n * size
                n = 0
        each = capacity // size
        for sequences, inside in ((n // each, each), (1, n % each)):
            if sequences and inside:
                open_.append([[(size, inside, 0, int(used[size]))], capacity - inside * size, sequences])
                used[size] += sequences * inside
    rows, sequence = [], 0
    for members, _, n in [*groups, *((g[0], g[1], g[2]) for g in open_)]:
        rows += [(size, rank, each, sequence, at) for size, each, at, rank in members]
        sequence += n
    total = sum(s * n for s, n in histogram.items())
    return Packing(rows), {"sequences": sequence, "fixed": fixed, "bound": -(-total // capacity)}


def _split(open_: list[list], g: list, n: int) -> list:
    """Takes the first n sequences of a group out as a group of their own."""
    if n == g[2]:
        return g
    head = [list(g[0]), g[1], n]
    g[0] = [(size, each, at, rank + n * each) for size, each, at, rank in g[0]]
    g[2] -= n
    open_.append(head)
    return head


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Token pieces of every document, with a place (task, rank) among those of its length."""
    src = with_ids(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for part in K.slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                tokens = np.array([*encode(text or ""), end_id], "<u4")
                head = len(tokens) % capacity or capacity
                cuts = [0, *range(head, len(tokens) + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    body = tokens[a:b]
                    for column, value in zip(out, (doc, i, a, b - a, zlib.crc32(body.tobytes()), int(seen[b - a]), body.astype(np.int32) if ids else None), strict=True):
                        column.append(value)
                    seen[b - a] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=False)] + [pa.array(np.full(len(out[0]), task, np.int64))]
            columns += [pa.array(out[6], pa.list_(pa.int32()))] if ids else []
            yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "k", "task", *(["ids"] if ids else [])])

    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, k long, task long" + (", ids array<int>" if ids else ""))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, ids: bool = False) -> DataFrame:
    """Packs all documents (null text: empty) into sequences of at most ``capacity`` tokens.

    A document is its ids and ``end_id``; a longer one is cut, and its first piece takes what is
    over.  Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the ids with
    ``ids``.  Rows without doc_id are left out; repeated rows are packed as often as they come.
    """
    cut = X.stored(pieces(docs, path, capacity, end_id, ids), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    # Ranks of a length: those of earlier tasks come first.  A row a task and length, not a piece.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    base = by_task.select("task", "length", F.coalesce(before, F.lit(0).cast("long")).alias("base"))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    packing, _ = reduce_and_fit(histogram, capacity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            sequence, offset = packing.place(length, batch.column("base").to_numpy() + batch.column("k").to_numpy())
            names = [n for n in batch.schema.names if n not in ("base", "k", "task", "ids")]
            tail = [batch.column("ids")] if ids else []
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset), *tail], names=[*names, "sequence_id", "offset", *(["ids"] if ids else [])])

    placed = cut.join(base, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", "k", "task", "base", *(["ids"] if ids else []))
    return placed.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if ids else ""))
