"""Language-model scoring by deleted interpolation.

p(w | v) = l2 c(v, w) / c(v) + l1 c(w) / N + l0 / (V + 1), with one set of weights for each bucket
floor(log2 c(v)) of the context's frequency; where c(v) is 0 only the other two count, and the
probabilities of all words still sum to one.  The weights come from expectation-maximisation on
held-out counts: a tenth of the training documents is counted apart, and the weights maximise its
likelihood under the counts of the rest; the final model uses the counts of all training documents.

Text moves in frames of many documents.  A frame asks the shards for the counts of its distinct
words and bigrams, so a frequent one is one row a frame, and the answers come back in the order of
the question, without keys.  Only N, V and a histogram of bounded size come to the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm.line_dedup import with_ids

FOLDS = 10
FRAME_BYTES = 8 << 20
#: Buckets of the context's count, and steps of the binary logarithms in the histogram: at most
#: BUCKETS * (40 * STEPS) ** 2 rows, and in practice some thousands.
BUCKETS, STEPS = 24, 4
START, END = K.U64(0x0123456789ABCDEF), K.U64(0xFEDCBA9876543210)
_ASK, _TEXT, _STAT = 0, 9, 1


def fold(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 10: 0 is held out of learning, 9 learns the weights."""
    return np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids.tolist()], np.int64)


def _framed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return pa.record_batch([pa.array([(task << 32) | number], pa.int64()), pa.array([X.pack(whole)], pa.binary())], names=["f", "text"])

    for part in K.slices(batches):
        held.append(pa.record_batch([part.column("doc_id"), part.column("text").cast(pa.large_string())], names=["doc_id", "text"]))
        size += part.nbytes
        if size > FRAME_BYTES:
            yield row()
            number, held, size = number + 1, [], 0
    if held:
        yield row()


def _tokens(frame: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, token hashes with an end after each text, the tokens before them, offsets by text)."""
    batch = X.unpack(frame)
    toks, counts = [], []
    for part in K.slices([batch]):
        data, offs = K.text_bytes(part.column("text"))
        start, end, at = K.words(data, offs)
        (h,) = K.range_hashes(K.LOWER[data], start, end, 0)
        toks.append(np.insert(h, at[1:], END))
        counts.append(np.diff(at) + 1)
    tok, count = np.concatenate(toks), np.concatenate(counts)
    offs = np.concatenate([[0], np.cumsum(count)])
    before = np.concatenate([[START], tok[:-1]])
    before[offs[:-1]] = START
    return batch.column("doc_id").to_numpy(), tok, before, offs


def _distinct(tok: np.ndarray, before: np.ndarray) -> tuple:
    """Distinct words (with the start) and bigrams, and where each token has its word, context and bigram."""
    words, at = np.unique(np.concatenate([tok, [START]]), return_inverse=True)
    ctx = np.empty(len(tok), np.int64)
    ctx[0] = at[-1]
    ctx[1:] = np.where(before[1:] == START, at[-1], at[:-2])
    pairs, pair_at = np.unique(K.mix(before * K.U64(0x9E3779B97F4A7C15) + tok), return_inverse=True)
    return words, at[:-1], ctx, pairs, pair_at


def _message(*arrays: np.ndarray) -> bytes:
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    sizes = struct.pack(f"<{len(arrays)}q", *(len(a) for a in arrays))
    return sizes + pa.compress(body, codec="zstd", asbytes=True) if body else sizes


def _opened(raw: bytes, *kinds: type) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(kinds)}q", raw)
    total = sum(s * np.dtype(k).itemsize for s, k in zip(sizes, kinds, strict=True))
    body = pa.decompress(raw[8 * len(kinds) :], decompressed_size=total, codec="zstd", asbytes=True) if total else b""
    out, at = [], 0
    for s, k in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(body, k, s, at))
        at += s * np.dtype(k).itemsize
    return out


def _ask(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, frame in zip(batch.column("f").to_pylist(), batch.column("text"), strict=True):
                ids, tok, before, offs = _tokens(frame.as_py())
                words, at, ctx, pairs, pair_at = _distinct(tok, before)
                part = np.repeat(fold(ids), np.diff(offs))
                firsts = np.zeros(len(tok), bool)
                firsts[offs[:-1]] = True
                columns = []
                for role in ((part > 0) & (part < FOLDS - 1), part == FOLDS - 1):
                    c = np.bincount(at[role], minlength=len(words))
                    c[ctx[0]] += int((firsts & role).sum())  # the start counts as a context
                    columns.append((c.astype(np.int32), np.bincount(pair_at[role], minlength=len(pairs)).astype(np.int32)))
                to_w, to_p = words % K.U64(n), pairs % K.U64(n)
                order_w, order_p = np.argsort(to_w, kind="stable"), np.argsort(to_p, kind="stable")
                cut_w, cut_p = np.searchsorted(to_w[order_w], np.arange(n + 1)), np.searchsorted(to_p[order_p], np.arange(n + 1))
                for s in range(n):
                    w, p = order_w[cut_w[s] : cut_w[s + 1]], order_p[cut_p[s] : cut_p[s + 1]]
                    if len(w) or len(p):
                        yield X.row(s, _ASK, _message(np.array([f], np.int64), words[w], columns[0][0][w], columns[1][0][w], pairs[p], columns[0][1][p], columns[1][1][p]))

    return run


_ASKED = (np.int64, K.U64, np.int32, np.int32, K.U64, np.int32, np.int32)


def _summed(keys: list[np.ndarray], counts: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(place of each row's key, sums by key)."""
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    size = int(at.max(initial=-1)) + 1
    return at, [np.bincount(at, np.concatenate(c), size).astype(np.int64) for c in counts]


def _answer(n: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, shard = [], -1
        for b, _, frame in X.frames(batches):
            asked.append((b, _opened(frame, *_ASKED)))
        for shard in sorted({b for b, _ in asked}):
            own = [m for b, m in asked if b == shard]
            w_at, w_sums = _summed([m[1] for m in own], [[m[2] for m in own], [m[3] for m in own]])
            p_at, p_sums = _summed([m[4] for m in own], [[m[5] for m in own], [m[6] for m in own]])
            words = np.concatenate([m[1] for m in own])
            first = np.zeros(len(w_sums[0]), K.U64)
            first[w_at] = words
            learned = (w_sums[0] + w_sums[1]) * (first != START)
            stat = np.array([learned.sum(), (learned > 0).sum(), (w_sums[0] * (first != START)).sum()], np.int64)
            yield X.row(0, _STAT, stat.tobytes())
            i = j = 0
            for m in own:
                w, p = w_at[i : i + len(m[1])], p_at[j : j + len(m[4])]
                i, j = i + len(w), j + len(p)
                f = int(m[0][0])
                yield X.row(int(K.doc_hash(np.array([f]))[0] % K.U64(n)), _ASK, _message(m[0], np.array([shard], np.int64), *(s[w] for s in w_sums), *(s[p] for s in p_sums)))

    return run


def _join(n: int):
    """Text frames with the counts of their words and bigrams, and the held-out histogram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: dict[int, list] = {}
        for _, tag, frame in X.frames(batches):
            if tag == _ASK:
                m = _opened(frame, *[np.int64] * 6)
                answers.setdefault(int(m[0][0]), []).append(m)
                continue
            (f,) = struct.unpack_from("<q", frame)
            text = frame[8:]
            ids, tok, before, offs = _tokens(text)
            words, at, ctx, pairs, pair_at = _distinct(tok, before)
            got = [np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)]
            order_w, order_p = np.argsort(words % K.U64(n), kind="stable"), np.argsort(pairs % K.U64(n), kind="stable")
            i = j = 0
            for m in sorted(answers.pop(f, ()), key=lambda m: int(m[1][0])):
                w, p = order_w[i : i + len(m[2])], order_p[j : j + len(m[4])]
                i, j = i + len(w), j + len(p)
                got[0][w], got[1][w], got[2][p], got[3][p] = m[2:]
            assert i == len(words) and j == len(pairs), "an answer is missing"
            role = np.repeat(fold(ids) == FOLDS - 1, np.diff(offs))
            c_v, c_w, c_vw = got[0][ctx[role]], got[0][at[role]], got[2][pair_at[role]]
            bucket = bucket_of(c_v)
            h2, h1 = _step(c_vw / np.maximum(c_v, 1)), _step(c_w.astype(float))
            rows, count = np.unique(np.stack([bucket, h2, h1], axis=1), axis=0, return_counts=True) if role.any() else (np.zeros((0, 3), np.int64), np.zeros(0, np.int64))
            head = pa.array([f] + [None] * len(rows), pa.int64())
            cols = [pa.array(np.concatenate([[0], rows[:, k]]).astype(np.int32)) for k in range(3)]
            blank = [None] * len(rows)
            yield pa.record_batch([head, pa.array([text, *blank], pa.binary()), pa.array([_message(got[0] + got[1], got[2] + got[3]), *blank], pa.binary()), *cols, pa.array(np.concatenate([[0], count]))], names=["f", "text", "counts", "hb", "h2", "h1", "hc"])

    return run


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2 count), at most BUCKETS - 1."""
    return np.minimum(np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0), BUCKETS - 1).astype(np.int64)


_NONE = -10_000


def _step(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.round(np.log2(np.where(x > 0, x, 1)) * STEPS), _NONE).astype(np.int64)


def _value(step: np.ndarray) -> np.ndarray:
    return np.where(step == _NONE, 0.0, 2.0 ** (np.where(step == _NONE, 0, step) / STEPS))


def learn_weights(histogram: np.ndarray, tokens: int, distinct: int, turns: int = 60) -> np.ndarray:
    """(BUCKETS, 3) weights of bigram, unigram and uniform, by expectation-maximisation.

    histogram rows: bucket, step of p2, step of c(w), held-out count.  A bucket without held-out
    counts takes the weights of all buckets together.
    """

    def run(h: np.ndarray) -> np.ndarray:
        p = np.stack([_value(h[:, 1]), _value(h[:, 2]) / max(tokens, 1), np.full(len(h), 1 / (distinct + 1))], axis=1)
        lam = np.full(3, 1 / 3)
        for _ in range(turns):
            share = lam * p
            share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
            lam = (share * h[:, 3:4]).sum(axis=0) + 0.5  # half a count each keeps all weights positive
            lam /= lam.sum()
        return lam

    h = histogram.reshape(-1, 4)
    out = np.tile(run(h) if len(h) else np.full(3, 1 / 3), (BUCKETS, 1))
    for b in range(BUCKETS):
        own = h[h[:, 0] == b]
        if len(own):
            out[b] = run(own)
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """Scores every text (null: empty) under a unigram base and the interpolated bigram model.

    Learns from documents whose crc32(doc_id as text) modulo 10 is not 0.  Returns doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of words and end).
    Rows without doc_id are left out; repeated rows count as often as they come.
    """
    spark, src = docs.sparkSession, with_ids(docs)
    n = X.bucket_count(spark)
    frames = X.stored(src.mapInArrow(_framed, "f long, text binary"), "lm-frames")
    answers = X.stored(X.shuffled(frames.mapInArrow(_ask(n), X.FRAMES), n).mapInArrow(_answer(n), X.FRAMES), "lm-answers")
    X.drop_shuffles(spark)

    def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, frame in zip(batch.column("f").to_pylist(), batch.column("text"), strict=True):
                yield X.row(int(K.doc_hash(np.array([f]))[0] % K.U64(n)), _TEXT, struct.pack("<q", f) + frame.as_py())

    both = X.shuffled(answers.where(answers.tag == _ASK).union(frames.mapInArrow(texts, X.FRAMES)), n)
    joined = X.stored(both.mapInArrow(_join(n), "f long, text binary, counts binary, hb int, h2 int, h1 int, hc long"), "lm-counts")
    X.drop_shuffles(spark)
    # One row a shard.
    stats = [np.frombuffer(bytes(r["frame"]), np.int64) for r in answers.where(answers.tag == _STAT).select("frame").collect()]
    total, distinct, counted = (int(x) for x in np.sum(stats, axis=0)) if stats else (0, 0, 0)
    rows = joined.where("f is null").groupBy("hb", "h2", "h1").agg(F.sum("hc").alias("hc")).collect()  # bounded, see STEPS
    lam = learn_weights(np.array([tuple(r) for r in rows], np.int64).reshape(-1, 4), counted, distinct)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for frame, counts in zip(batch.column("text"), batch.column("counts"), strict=True):
                ids, tok, before, offs = _tokens(frame.as_py())
                _, at, ctx, _, pair_at = _distinct(tok, before)
                words, pairs = _opened(counts.as_py(), np.int64, np.int64)
                c_w, c_v, c_vw = words[at].astype(float), words[ctx].astype(float), pairs[pair_at].astype(float)
                weight = lam[bucket_of(c_v)].copy()
                weight[c_v == 0, 0] = 0  # an unseen context has no bigrams, so the others share the whole
                weight /= weight.sum(axis=1, keepdims=True)
                p = weight[:, 0] * c_vw / np.maximum(c_v, 1) + weight[:, 1] * c_w / max(total, 1) + weight[:, 2] / (distinct + 1)
                base = np.log10((c_w + 0.1) / (total + 0.1 * (distinct + 1)))
                cut = offs[:-1]
                yield pa.record_batch([
                    pa.array(ids), pa.array(fold(ids) == 0), pa.array(np.diff(offs)), pa.array(np.add.reduceat((c_w > 0).astype(np.int64), cut)),
                    pa.array(np.full(len(ids), total)), pa.array(np.add.reduceat(base, cut)), pa.array(np.add.reduceat(np.log10(p), cut)),
                ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined.where("f is not null").select("text", "counts").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
