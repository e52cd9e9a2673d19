"""MinHash fingerprints of documents.

A fingerprint holds the minima of a text's 5-word shingles under 64 universal hash permutations, 16
bits each, as hexadecimal digits; the share of equal places estimates the shingle sets' Jaccard
similarity.  ``with_neighbours`` adds the class of each document under all verified links of its bands, as
``near_dedup`` finds it; ``near_pairs`` gives every pair that shares a band; ``near_first`` asks the
smallest document of each band only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm import minhash as M
from loomgraph.llm import near_dedup
from loomgraph.llm.line_dedup import with_ids

PERMUTATIONS, BANDS = 64, 16
_DOC, _NEXT, _NEAR = 0, 1, 2


def signatures(texts: pa.Array) -> np.ndarray:
    values, offs = M.shingles(texts)
    return (M.minima(values, offs, PERMUTATIONS) >> np.uint32(16)).astype(">u2")


def fingerprint(signature: np.ndarray) -> list[str]:
    raw = np.ascontiguousarray(signature).tobytes().hex()
    return [raw[i : i + 4 * PERMUTATIONS] for i in range(0, len(raw), 4 * PERMUTATIONS)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint; a null or empty text has the fingerprint of all bits set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            yield pa.record_batch([part.column("doc_id"), pa.array(fingerprint(signatures(part.column("text"))))], names=["doc_id", "fingerprint"])

    return with_ids(docs).mapInArrow(run, "doc_id long, fingerprint string")


def edits(docs: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each document, and their likeness to an edited text's and the next document's.

    The next document has the next smaller doc_id; after the last comes the first (a single
    document is its own).  The edited text is the document with its last third of code points
    replaced by as many first ones (or all) of the next.  Null texts are empty.  Rows without doc_id
    are left out; rows that share a doc_id follow each other in order of their texts.

    Documents are dealt by ranges of doc_id; a range also gets the first document after it and its rows
    of ``near`` (doc_id, near_id; one a doc_id), which add a column near_id, null without one.
    """
    src, n, wanted = with_ids(docs), X.bucket_count(docs.sparkSession), near is not None
    cuts = src.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10000).alias("q")).first()["q"] or []  # at most n values
    cuts = np.unique(np.array(cuts, np.int64))

    def tops(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            b = np.searchsorted(cuts, ids)
            order = np.lexsort((ids, b))
            last = np.append(np.flatnonzero(np.diff(b[order])), len(b) - 1) if len(b) else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(b[order][last].astype(np.int32)), pa.array(ids[order][last])], names=["b", "top"])

    top = sorted((r["b"], r["top"]) for r in src.select("doc_id").mapInArrow(tops, "b int, top long").groupBy("b").agg(F.max("top").alias("top")).collect())  # at most n rows
    follows = {top[i - 1][1]: top[i][0] for i in range(len(top))}  # first document of the range below -> range

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for part in K.slices(batches):
            ids = part.column("doc_id").to_numpy()
            text = part.column("text").cast(pa.large_string()).fill_null("")
            yield from out.add(_DOC, np.searchsorted(cuts, ids), {"doc_id": ids, "text": text})
            more = np.flatnonzero(np.isin(ids, list(follows)))
            if len(more):
                yield from out.add(_NEXT, np.array([follows[i] for i in ids[more].tolist()]), {"doc_id": ids[more], "text": text.take(pa.array(more))})
        yield from out.flush()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {_DOC: [], _NEXT: [], _NEAR: []}
        for _, tag, frame in X.frames(batches):
            got[tag].append(X.unpack(frame))
        if not got[_DOC]:
            return
        own = pa.Table.from_batches(got[_DOC]).sort_by([("doc_id", "descending"), ("text", "ascending")])
        linked = X.joined(got[_NEAR]) if got[_NEAR] else {"doc_id": np.zeros(0, np.int64), "near_id": np.zeros(0, np.int64)}
        order = np.argsort(linked["doc_id"])
        linked = {c: v[order] for c, v in linked.items()}
        tail = pa.Table.from_batches(got[_NEXT]).sort_by([("doc_id", "descending"), ("text", "ascending")]).slice(0, 1)
        del got
        rows = pa.concat_tables([own, tail]).combine_chunks()
        at = 0
        for part in K.slices(rows.select(["doc_id", "text"]).to_batches()):
            m = min(part.num_rows, own.num_rows - at)
            if m <= 0:
                continue
            texts = rows.column("text").slice(at, m + 1).to_pylist()
            edited = []
            for text, after in zip(texts, texts[1:], strict=False):
                third = len(text) // 3
                edited.append(text[: len(text) - third] + after[:third])
            sig = signatures(pa.array(texts, pa.large_string()))
            new = signatures(pa.array(edited, pa.large_string()))
            ids = part.column("doc_id").slice(0, m)
            found = np.searchsorted(linked["doc_id"], ids.to_numpy())
            has = np.append(linked["doc_id"], 0)[found] == ids.to_numpy()
            has &= found < len(linked["doc_id"])
            more = [pa.array(np.append(linked["near_id"], 0)[found], pa.int64(), mask=~has)] if wanted else []
            yield pa.record_batch([
                ids, pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(fingerprint(sig[:-1])), pa.array(fingerprint(new)), pa.array(likeness(sig[:-1], new)), pa.array(likeness(sig[:-1], sig[1:])), *more,
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", *(["near_id"] if more else [])])
            at += m

    def deal_near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            yield from out.add(_NEAR, np.searchsorted(cuts, ids), {"doc_id": ids, "near_id": batch.column("near_id")})
        yield from out.flush()

    sent, kind = src.mapInArrow(deal, X.FRAMES), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if wanted:
        sent, kind = sent.union(near.mapInArrow(deal_near, X.FRAMES)), f"{kind}, near_id long"
    return X.shuffled(sent, n).mapInArrow(run, kind)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of the bands of 32-bit minima."""
    keys = sig.reshape(len(sig), BANDS, PERMUTATIONS // BANDS).astype(K.U64)
    out = np.zeros((len(sig), BANDS), K.U64)
    for j in range(keys.shape[2]):
        out = K.mix(out * K.U64(31) + keys[:, :, j] + np.arange(BANDS, dtype=K.U64))
    return out


def near_first(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, near_id of documents that are near the smallest document of one of their bands.

    Each document is verified with the smallest documents of its bands, on the full sets of shingles;
    near_id is the smallest that has at least ``percent`` hundredths of the union in common.  A
    document is no neighbour of itself, and texts without words have none.  Other links of a family
    are not sought here, so no query rests on it: ``near_pairs`` and ``with_neighbours`` do that.
    """
    src, n = with_ids(docs), X.bucket_count(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            values, offs = M.shingles(part.column("text"))
            some = np.flatnonzero(np.diff(offs))
            sig = M.minima(values, offs, PERMUTATIONS)[some]
            low = ((sig & np.uint32(1)).astype(K.U64) << np.arange(PERMUTATIONS, dtype=K.U64)).sum(axis=1, dtype=K.U64)
            values, offs = M.distinct(values, offs)
            total = lambda v: np.diff(np.concatenate([np.zeros(1, K.U64), np.cumsum(v)])[offs])[some].view(np.int64)  # noqa: B023, E731
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(sig).ravel().view(np.int64)))
            columns = (part.column("doc_id").to_numpy()[some], np.diff(offs)[some].astype(np.int32), total(values), total(K.mix(values ^ K.U64(0x5851F42D4C957F2D))), low.view(np.int64))
            yield pa.record_batch([*map(pa.array, columns), bands], names=["u", "n", "h1", "h2", "low", "bands"])

    spark = docs.sparkSession
    signed = X.stored(src.mapInArrow(run, "u long, n int, h1 long, h2 long, low long, bands array<long>"), "fingerprint-signatures")
    # Texts with one set of shingles (128 bits of it) are copies; the smallest stands for them.
    same = ["h1", "h2", "n"]
    copies = X.stored(signed.groupBy(*same).agg(F.min("u").alias("r"), F.count("*").alias("copies")), "fingerprint-copies")
    bands = signed.join(copies, same).where("u = r").dropDuplicates(["u", "h1"]).select("u", "n", "low", F.explode("bands").alias("band"))
    firsts = bands.groupBy("band").agg(F.min(F.struct("u", "n", "low")).alias("f"))
    # Sizes bound the similarity, and the lowest bits of the minima agree too seldom for pairs far below it.
    p = 0.5 + percent / 200
    least = int(PERMUTATIONS * p - 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5)
    near = (100 * F.least("n", "f.n") >= percent * F.greatest("n", "f.n")) & (F.bit_count(F.col("low").bitwiseXOR(F.col("f.low"))) <= PERMUTATIONS - least)
    edges = X.stored(bands.join(firsts, "band").where((F.col("f.u") <= F.col("u")) & near).select("u", F.col("f.u").alias("v")).distinct(), "fingerprint-edges")
    pairs = edges.where("v < u")
    ends = pairs.select(F.col("u").alias("doc")).union(pairs.select("v")).distinct()
    X.drop_shuffles(spark)
    sets = X.stored(near_dedup.shingle_sets(src, ends, M.SHINGLE, n), "fingerprint-sets")
    X.drop_shuffles(spark)
    found = near_dedup.verified(pairs, sets, percent, n).union(edges.where("v = u")).groupBy("u").agg(F.min("v").alias("v"))
    of = signed.join(copies, same).select(F.col("u").alias("doc_id"), "r").join(found, F.col("r") == found.u).where("v < doc_id")
    return of.groupBy("doc_id").agg(F.min("v").alias("near_id"))


def with_neighbours(docs: DataFrame) -> DataFrame:
    """``edits`` with near_id, the smallest document reachable by links (null where none is smaller).

    Links are those of ``near_dedup``: documents that share a band, verified on their full sets, with
    whomever of the band they are alike.  Two documents are linked by a chain where their coalesce(near_id,
    doc_id) are equal.
    """
    linked = near_dedup.near_duplicates(docs).where("component_id < doc_id").groupBy("doc_id").agg(F.min("component_id").alias("near_id"))
    near = X.stored(linked, "fingerprint-neighbours")
    X.drop_shuffles(docs.sparkSession)
    return edits(docs, near)


def near_pairs(docs: DataFrame, threshold: float = 0.75) -> DataFrame:
    """doc_id, near_id, jaccard of documents whose bands meet a smaller document's, verified on their sets.

    Documents with the same set of shingles are copies: each gives one row with the smallest of them,
    which stands for all.  Between those smallest ones every pair that shares a band is verified, so
    the rows of a large group of different near copies grow with the square of its size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            values, offs = M.shingles(part.column("text"))
            sig = M.minima(values, offs, PERMUTATIONS)
            values, offs = M.distinct(values, offs)
            band = band_keys(sig)
            some = np.diff(offs) > 0
            sets = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values.view(np.int64)))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(sig) + 1, dtype=np.int32) * BANDS), pa.array(band.ravel().view(np.int64)))
            yield pa.record_batch([part.column("doc_id"), sets, bands], names=["doc_id", "set", "bands"]).filter(pa.array(some))

    sets = X.stored(with_ids(docs).mapInArrow(run, "doc_id long, set array<long>, bands array<long>"), "fingerprint-sets")
    same = sets.select("doc_id", F.sha2(F.concat_ws(",", F.array_sort("set")), 256).alias("key"))
    first = same.groupBy("key").agg(F.min("doc_id").alias("near_id"))
    copies = same.join(first, "key").where("near_id < doc_id").select("doc_id", "near_id", F.lit(1.0).alias("jaccard")).distinct()
    bands = sets.join(first.select(F.col("near_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("band"))
    pairs = bands.join(bands.withColumnRenamed("doc_id", "near_id"), "band").where("near_id < doc_id").select("doc_id", "near_id").distinct()
    both = pairs.join(sets.select("doc_id", F.col("set").alias("a")), "doc_id").join(sets.select(F.col("doc_id").alias("near_id"), F.col("set").alias("b")), "near_id")
    inter = F.size(F.array_intersect("a", "b"))
    return both.select("doc_id", "near_id", (inter / (F.size("a") + F.size("b") - inter)).alias("jaccard")).where(F.col("jaccard") >= threshold).unionByName(copies)
