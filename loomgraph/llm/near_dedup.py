"""Near-duplicate groups by b-bit MinHash.

1. Each document gets 128 minima of its 5-word shingle set: bands of four make candidate keys, and
   the two low bits of each minimum are packed into 256 bits.  Equal sets collapse to one document.
2. In each band the documents are compared with the smallest one by bit counts: the share of equal
   2-bit places, corrected for chance collisions, estimates the similarity; the sizes of the sets
   bound it.  Bands whose documents are then in several clusters are searched whole, in blocks where
   they are large, and a spanning forest of what passes joins the clusters.  So any two documents
   that share a band and pass the estimate are in one cluster, and no pair has a row of its own.
3. Sets of clustered documents are made once.  Each document is verified with its likeliest leaders,
   and verified links are closed to components.
4. Documents outside the largest component of their cluster meet all others of the cluster, in
   blocks.  A task verifies pairs in different components only, likeliest first, joins components
   as it goes, and sends the joining links on: at most one a document and block.

With 32 bands of 4, a pair at similarity 0.75 is missed with a probability of 6e-6.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm import minhash as M
from loomgraph.llm.line_dedup import with_ids

BANDS, ROWS, BITS = 32, 4, 2
PERMUTATIONS = BANDS * ROWS
PERCENT = 75
#: Documents of a band that are compared before sending; documents of a band in one block of a search.
LOCAL_GROUP, SEARCH_GROUP, UNIT = 16, 4096, 512
#: Leaders that a document is verified with; shingles in one block of a cluster.
TRIES, BLOCK_SHINGLES = 4, 1 << 20
_BAND, _EDGE, _ASK, _SET, _TEXT = 0, 1, 2, 8, 9
_SIG = ("s0", "s1", "s2", "s3")


def packed(minima: np.ndarray) -> np.ndarray:
    """(rows, 4) uint64 of the two low bits of 128 minima."""
    low = (minima & np.uint32(3)).astype(K.U64).reshape(len(minima), 4, 32)
    return (low << (np.arange(32, dtype=K.U64) * K.U64(2))).sum(axis=2, dtype=K.U64)


def equal_places(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return PERMUTATIONS - np.bitwise_count((x | (x >> K.U64(1))) & K.U64(0x5555555555555555)).sum(axis=-1).astype(np.int64)


def similarity(equal: np.ndarray) -> np.ndarray:
    """Estimate from equal places, without those that are equal by chance."""
    chance = 1 / (1 << BITS)
    return (equal / PERMUTATIONS - chance) / (1 - chance)


def _least_equal(percent: int) -> int:
    """Equal places at five standard deviations below the expectation at the threshold."""
    p = 0.25 + 0.75 * percent / 100
    return int(PERMUTATIONS * p - 5 * (PERMUTATIONS * p * (1 - p)) ** 0.5)


def _alike(a: tuple, b: tuple, least: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(may be over the threshold, equal places) of rows (signature, set size)."""
    equal = equal_places(a[0], b[0])
    small, large = np.minimum(a[1], b[1]), np.maximum(a[1], b[1])
    return (equal >= least) & (100 * small >= percent * large), equal


def signed(docs: DataFrame, shingle: int = M.SHINGLE) -> DataFrame:
    """doc_id, n, two hashes of the shingle set, packed signature and band keys of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in K.slices(batches):
            values, offs = M.distinct(*M.shingles(part.column("text"), shingle))
            n = np.diff(offs)
            total = lambda v: np.diff(np.concatenate([np.zeros(1, K.U64), np.cumsum(v)])[offs])  # noqa: B023, E731
            minima = M.minima(values, offs, PERMUTATIONS)
            sig = packed(minima)
            keys = np.zeros((len(n), BANDS), K.U64)
            cube = minima.reshape(len(n), BANDS, ROWS).astype(K.U64)
            for j in range(ROWS):
                keys = K.mix(keys * K.U64(31) + cube[:, :, j] + np.arange(BANDS, dtype=K.U64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
            longs = [total(values), total(K.mix(values ^ K.U64(0x5851F42D4C957F2D))), *np.ascontiguousarray(sig.T)]
            yield pa.record_batch([part.column("doc_id"), pa.array(n), *(pa.array(x.view(np.int64)) for x in longs), bands], names=["doc_id", "n", "h1", "h2", *_SIG, "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, s0 long, s1 long, s2 long, s3 long, bands array<long>")


def _rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    sig = np.stack([batch.column(c).to_numpy() for c in _SIG], axis=1).view(K.U64)
    return batch.column("doc_id").to_numpy(), sig, batch.column("n").to_numpy(), batch.column("bands").values.to_numpy().view(K.U64).reshape(-1, BANDS)


def _with_hubs(key: np.ndarray, sig: np.ndarray, size: np.ndarray, least: int, percent: int) -> tuple:
    """Rows sorted by (key, doc): (alike the group's first, equal places with it, index of that first)."""
    new = K.group_starts(key)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return *_alike((sig, size), (sig[first], size[first]), least, percent), first


def _send_bands(n: int, least: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = X.Sender(n), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            doc, sig, count, keys = (np.concatenate([h[i] for h in held]) for i in range(4))
            row = np.repeat(np.arange(len(doc)), BANDS)
            key = keys.ravel()
            order = np.lexsort((doc[row], key))
            key, row = key[order], row[order]
            near, equal, first = _with_hubs(key, sig[row], count[row], least, percent)
            group = np.cumsum(K.group_starts(key)) - 1
            settled = near & (first != np.arange(len(key))) & (np.bincount(group) > LOCAL_GROUP)[group]
            u, v, e = doc[row][settled], doc[row][first[settled]], equal[settled]
            order = np.lexsort((v, -e, u))
            once = order[K.group_starts(u[order])]  # one, the likeliest, is enough
            u, v, e = u[once], v[once], e[once]
            yield from out.add(_EDGE, K.doc_hash(u), {"u": u, "v": v, "e": e.astype(np.int16)})
            row, key = row[~settled], key[~settled]
            yield from out.add(_BAND, key, {"key": key, "doc": doc[row], "n": count[row].astype(np.int32), **{c: sig[row, i] for i, c in enumerate(_SIG)}})

        for batch in batches:
            held.append(_rows_of(batch))
            size += batch.num_rows
            if size * BANDS > 300_000:
                yield from settle()
                held, size = [], 0
        if size:
            yield from settle()
        yield from out.flush()

    return run


def _likeliest(u: np.ndarray, v: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((v, -e, u))
    once = order[K.group_starts(u[order])] if len(u) else order
    return pa.record_batch([pa.array(u[once]), pa.array(v[once]), pa.array(e[once])], names=["u", "v", "e"])


def _best(found: DataFrame, most: int) -> DataFrame:
    """The ``most`` likeliest (u, v), u > v, of each first end, which has a row a band and task at most."""
    ranked = F.slice(F.sort_array(F.collect_set(F.struct("e", (-F.col("v")).alias("m"))), asc=False), 1, most)
    one = found.groupBy("u").agg(ranked.alias("x")).select("u", F.explode("x").alias("x")).select("u", (-F.col("x.m")).alias("v"))
    return one.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _band_edges(least: int, percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, us, vs, es = [], [], [], []
        for _, tag, frame in X.frames(batches):
            t = X.unpack(frame)
            if tag == _EDGE:
                us.append(t.column("u").to_numpy())
                vs.append(t.column("v").to_numpy())
                es.append(t.column("e").to_numpy().astype(np.int64))
            else:
                parts.append(t)
        if parts:
            r = X.joined(parts)
            order = np.lexsort((r["doc"], r["key"]))
            key, doc, size = r["key"][order], r["doc"][order], r["n"][order].astype(np.int64)
            sig = np.stack([r[c][order] for c in _SIG], axis=1)
            for _ in range(3):  # what is unlike the first is compared with the first of the rest
                if not len(key):
                    break
                near, equal, first = _with_hubs(key, sig, size, least, percent)
                pair = near & (doc != doc[first])
                us.append(doc[pair])
                vs.append(doc[first[pair]])
                es.append(equal[pair])
                near |= first == np.arange(len(key))
                key, doc, sig, size = key[~near], doc[~near], sig[~near], size[~near]
        if us:
            yield _likeliest(np.concatenate(us), np.concatenate(vs), np.concatenate(es))

    return run


def _forest(n: int, least: int, percent: int):
    """Links that join clusters within a band, or within two blocks of a large one."""

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for batch in batches:
            key = batch.column("band").to_numpy().view(K.U64)
            blocks = -(-batch.column("cnt").to_numpy() // SEARCH_GROUP)
            doc, cluster, size = (batch.column(c).to_numpy() for c in ("doc_id", "cluster", "n"))
            sig = [batch.column(c).to_numpy().view(K.U64) for c in _SIG]
            own = (K.doc_hash(doc) % blocks.astype(K.U64)).astype(np.int64)
            row = np.repeat(np.arange(len(doc)), blocks)
            other = K.within(blocks)
            a, b = np.minimum(own[row], other), np.maximum(own[row], other)
            unit = K.mix(key[row] + K.mix(a.astype(K.U64) * K.U64(0x10001) + b.astype(K.U64)) * (blocks[row] > 1))
            yield from out.add(_BAND, unit, {"unit": unit, "doc": doc[row], "cluster": cluster[row], "n": size[row].astype(np.int32), **{c: s[row] for c, s in zip(_SIG, sig, strict=True)}})
        yield from out.flush()

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [X.unpack(frame) for _, _, frame in X.frames(batches)]
        if not parts:
            return
        r = X.joined(parts)
        order = np.lexsort((r["doc"], r["cluster"], r["unit"]))
        unit, doc, label, size = (r[c][order] for c in ("unit", "doc", "cluster", "n"))
        sig, size = np.stack([r[c][order] for c in _SIG], axis=1), size.astype(np.int64)
        cut = np.append(np.flatnonzero(K.group_starts(unit)), len(unit))
        # Bands of two documents, the most of all, at once.
        two = cut[:-1][np.diff(cut) == 2]
        ok, _ = _alike((sig[two], size[two]), (sig[two + 1], size[two + 1]), least, percent)
        us, vs = [doc[two + 1][ok]], [doc[two][ok]]
        label = label.copy()
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if hi - lo < 3:
                continue
            here = label[lo:hi]
            for i in range(lo, hi - 1):
                at = i + 1 + np.flatnonzero(here[i + 1 - lo :] != here[i - lo])
                if not len(at):
                    continue
                ok, _ = _alike((sig[at], size[at]), (sig[i], size[i]), least, percent)
                at = at[ok]
                if len(at):
                    _, once = np.unique(label[at], return_index=True)
                    us.append(doc[at[once]])
                    vs.append(np.full(len(once), doc[i]))
                    here[np.isin(here, label[at])] = here[i - lo]
        u, v = np.concatenate(us), np.concatenate(vs)
        yield pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return send, search


def clustered(reps: DataFrame, found: DataFrame, n: int, least: int, percent: int) -> DataFrame:
    """doc, comp: clusters of documents that share a band and may be over the threshold, or are joined by such."""
    clusters = components(found)
    named = reps.join(clusters, reps.doc_id == clusters.doc, "left").select("doc_id", "n", *_SIG, "bands", F.coalesce("comp", "doc_id").alias("cluster"))
    rows = named.select("doc_id", "n", "cluster", *_SIG, F.explode("bands").alias("band"))
    mixed = rows.groupBy("band").agg(F.count("*").alias("cnt"), F.min("cluster").alias("a"), F.max("cluster").alias("b")).where("a <> b").select("band", "cnt")
    send, search = _forest(n, least, percent)
    return merged(clusters, X.shuffled(rows.join(mixed, "band").mapInArrow(send, X.FRAMES), n).mapInArrow(search, "u long, v long"))


def _asking(asks: DataFrame, n: int) -> DataFrame:
    """Rows with a column doc as frames dealt by it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for batch in batches:
            yield from out.add(_ASK, K.doc_hash(batch.column("doc").to_numpy()), {c: batch.column(c) for c in batch.schema.names})
        yield from out.flush()

    return asks.mapInArrow(run, X.FRAMES)


def shingle_sets(src: DataFrame, wanted: DataFrame, shingle: int, n: int) -> DataFrame:
    """Frames (doc, h1, set) of the wanted documents (column doc), in the buckets of their ids."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks: list | np.ndarray = []
        for b, tag, frame in X.frames(batches):
            if tag == _ASK:
                asks.append(X.unpack(frame))
                continue
            if isinstance(asks, list):
                asks = np.unique(X.joined(asks)["doc"]) if asks else np.zeros(0, np.int64)
            if not len(asks):
                return
            t = X.unpack(frame)
            for part in K.slices([t.filter(pa.array(np.isin(t.column("doc_id").to_numpy(), asks)))]):
                values, offs = M.distinct(*M.shingles(part.column("text"), shingle))
                h1 = np.diff(np.concatenate([np.zeros(1, K.U64), np.cumsum(values)])[offs])
                sets = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((offs * 8).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))])
                yield X.row(b, _SET, X.pack(pa.record_batch([part.column("doc_id"), pa.array(h1.view(np.int64)), sets], names=["doc", "h1", "set"])))

    return X.shuffled(_asking(wanted, n).union(X.text_frames(src, n, tag=_TEXT)), n).mapInArrow(run, X.FRAMES)


def _delivered(asks: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Each asked set (doc, and h1 where it is named) with the ask's columns, as frames dealt by unit."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list = []
        asked: pa.RecordBatch | None = None
        out = X.Sender(n)
        for _, tag, frame in X.frames(batches):
            if tag == _ASK:
                parts.append(X.unpack(frame))
                continue
            if not parts:
                return
            if asked is None:
                table = pa.Table.from_batches(parts)
                asked = table.take(pa.array(np.argsort(table.column("doc").to_numpy(), kind="stable"))).combine_chunks().to_batches()[0]
                doc = asked.column("doc").to_numpy()
            t = X.unpack(frame)
            ids = t.column("doc").to_numpy()
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, "right")
            row = np.repeat(np.arange(len(ids)), hi - lo)
            at = np.repeat(lo, hi - lo) + K.within(hi - lo)
            if "h1" in asked.schema.names:
                same = asked.column("h1").to_numpy()[at] == t.column("h1").to_numpy()[row]
                row, at = row[same], at[same]
            for i in range(0, len(row), 2000):
                s = asked.take(pa.array(at[i : i + 2000]))
                yield from out.add(_SET, s.column("unit").to_numpy().view(K.U64), {**{c: s.column(c) for c in s.schema.names if c != "h1"}, "set": t.column("set").take(pa.array(row[i : i + 2000]))})
        yield from out.flush()

    return X.shuffled(X.shuffled(_asking(asks, n).union(sets), n).mapInArrow(run, X.FRAMES), n)


def _in_order(batches: Iterable[pa.RecordBatch], *by: str) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray] | None:
    """Columns of a bucket's rows in order of unit and ``by``, all sets joined, and their offsets."""
    parts = [X.unpack(frame) for _, _, frame in X.frames(batches)]
    if not parts:
        return None
    t = pa.Table.from_batches(parts)
    del parts
    order = np.lexsort([t.column(c).to_numpy() for c in (*reversed(by), "unit")])
    t = t.take(pa.array(order)).combine_chunks()
    raw, offs = K.text_bytes(t.column("set"))
    return {c: t.column(c).to_numpy() for c in t.column_names if c != "set"}, np.ascontiguousarray(raw).view(K.U64), offs // 8


def _shared(values: np.ndarray, offs: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of set i with others (none is empty)."""
    own = values[offs[i] : offs[i + 1]]
    size = offs[others + 1] - offs[others]
    those = values[np.repeat(offs[others], size) + K.within(size)]
    hit = own[np.minimum(np.searchsorted(own, those), len(own) - 1)] == those
    return np.add.reduceat(hit.astype(np.int64), np.cumsum(size) - size)


def _over(values: np.ndarray, offs: np.ndarray, i: int, others: np.ndarray, percent: int) -> np.ndarray:
    both = _shared(values, offs, i, others)
    return 100 * both >= percent * (offs[i + 1] - offs[i] + offs[others + 1] - offs[others] - both)


def verified(edges: DataFrame, sets: DataFrame, percent: int, n: int) -> DataFrame:
    """The edges (u, v) whose full shingle sets are similar enough; a star is split into units."""
    sizes = edges.groupBy("v").agg(F.count("*").alias("deg"))
    spread = F.pmod(F.xxhash64("u"), F.ceil(F.col("deg") / UNIT))
    units = edges.join(sizes, "v").select("u", "v", F.xxhash64("v", spread).alias("unit"))
    asked = units.select(F.col("u").alias("doc"), "unit", "v").union(units.select(F.col("v").alias("doc"), "unit", "v").distinct())

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _in_order(batches, "v", "doc")
        if got is None:
            return
        r, values, offs = got
        doc, v = r["doc"], r["v"]
        cut = np.append(np.flatnonzero(K.group_starts(r["unit"], v)), len(doc))
        us, vs = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            rest = lo + np.flatnonzero(doc[lo:hi] != v[lo])
            for hub in lo + np.flatnonzero(doc[lo:hi] == v[lo]):  # more than one row where texts share a doc_id
                linked = doc[rest[_over(values, offs, hub, rest, percent)]] if len(rest) else rest
                us.append(linked)
                vs.append(np.full(len(linked), v[lo]))
        if us:
            yield pa.record_batch([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return _delivered(asked, sets, n).mapInArrow(judge, "u long, v long")


def joining(clusters: DataFrame, comps: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, least: int, n: int) -> DataFrame:
    """Verified links (u, v) between components of a cluster, enough to join all that are linked.

    Documents of the cluster's largest component need meet the rest only, not each other.  Rest and
    largest component are split into blocks; unit (i, j) compares rest block i with the later block
    j, and the pairs inside block i are done where j follows it.
    """
    named = clusters.withColumnRenamed("comp", "cluster").join(comps.withColumnRenamed("doc", "d"), F.col("doc") == F.col("d"), "left").select("doc", "cluster", F.coalesce("comp", "doc").alias("comp"))
    rows = named.join(reps.select(F.col("doc_id").alias("doc"), "n", "h1", *_SIG), "doc")
    per = rows.groupBy("cluster", "comp").agg(F.sum("n").alias("w"))
    tops = per.groupBy("cluster").agg(F.max(F.struct("w", "comp")).alias("top"), F.sum("w").alias("w"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda w: F.ceil(w / BLOCK_SHINGLES)
    tops = tops.select("cluster", F.col("top.comp").alias("main"), blocks(F.col("w") - F.col("top.w")).alias("kr"), blocks(F.col("top.w")).alias("km"))
    spread = F.xxhash64("doc")
    inside = F.col("comp") == F.col("main")
    dealt = rows.join(tops, "cluster").withColumn("block", F.when(inside, F.col("kr") + F.pmod(spread, F.col("km"))).otherwise(F.pmod(spread, F.col("kr"))))
    last = F.when(inside, F.col("kr") - 1).otherwise(F.col("kr") + F.col("km") - 1)
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last))).where("other <> block")
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    asked = other.select("doc", "h1", F.xxhash64("cluster", lo, hi).alias("unit"), (F.col("block") == hi).cast("int").alias("side"), (hi == lo + 1).cast("int").alias("inner"), "comp", *_SIG)

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _in_order(batches, "side", "comp", "doc")
        if got is None:
            return
        r, values, offs = got
        doc, size = r["doc"], np.diff(offs)
        sig = np.stack([r[c] for c in _SIG], axis=1).view(K.U64)
        cut = np.append(np.flatnonzero(K.group_starts(r["unit"])), len(doc))
        us, vs = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            label = np.unique(r["comp"][lo:hi], return_inverse=True)[1]
            mid = lo + int((r["side"][lo:hi] == 0).sum())
            for i in range(lo, mid):
                first = i + 1 if r["inner"][i] else mid
                at = first + np.flatnonzero(label[first - lo :] != label[i - lo])
                if not len(at):
                    continue
                ok, equal = _alike((sig[at], size[at]), (sig[i], size[i]), least, percent)
                at = at[ok][np.argsort(-equal[ok], kind="stable")]
                step = 8
                while len(at):
                    for y in at[:step][_over(values, offs, i, at[:step], percent)].tolist():
                        if label[y - lo] != label[i - lo]:
                            us.append(max(doc[i], doc[y]))
                            vs.append(min(doc[i], doc[y]))
                            label[label == label[y - lo]] = label[i - lo]
                    at = at[step:]
                    at = at[label[at - lo] != label[i - lo]]
                    step *= 2
        yield pa.record_batch([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return _delivered(asked, sets, n).mapInArrow(judge, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """doc, comp (the smallest document reachable) of all ends of edges (u, v).

    Labels go along edges and then jump to their label's label, until none changes; each turn is a
    few shuffles of the labels, written to the shared folder in a file for about 200,000 links.
    """
    tasks = 1 + edges.count() // 200_000
    put = lambda df: X.stored(df.coalesce(tasks), "labels")
    both = put(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    labels = put(both.groupBy(F.col("u").alias("doc")).agg(F.least(F.min("v"), F.min("u")).alias("comp")))
    while True:
        near = both.join(labels, both.v == labels.doc).groupBy(F.col("u").alias("d")).agg(F.min("comp").alias("c"))
        step = labels.join(near, labels.doc == near.d).select("doc", F.col("comp").alias("was"), F.least("comp", "c").alias("comp"))
        jump = labels.select(F.col("doc").alias("comp"), F.col("comp").alias("next"))
        now = put(step.join(jump, "comp", "left").select("doc", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        labels = now.select("doc", "comp")
        if now.where("was <> comp").limit(1).count() == 0:
            return labels


def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links."""
    name = comps.select(F.col("doc").alias("d"), "comp")
    over = links.join(name.withColumnsRenamed({"d": "u", "comp": "cu"}), "u", "left").join(name.withColumnsRenamed({"d": "v", "comp": "cv"}), "v", "left")
    over = X.stored(over.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")).where("u <> v").distinct(), "links")
    joined = components(over).withColumnsRenamed({"doc": "c", "comp": "final"})
    # Ends that had no component yet are their own.
    ends = comps.union(over.select("u", F.col("u").alias("c"))).union(over.select("v", F.col("v").alias("c"))).groupBy("doc").agg(F.min("comp").alias("comp"))
    return X.stored(ends.join(joined, ends.comp == joined.c, "left").select("doc", F.coalesce("final", "comp").alias("comp")), "components")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = M.SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept (it is that one).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of lower-cased
    ``shingle``-word shingles (shorter texts: the whole sequence as one).  Null, empty and blank
    texts have no shingle and are linked with nothing.  Rows without doc_id are left out; rows that
    share a doc_id are one document of the link graph, and each gives a row.
    """
    spark, src, least = docs.sparkSession, with_ids(docs), _least_equal(percent)
    n = X.bucket_count(spark)
    sigs = X.stored(signed(src, shingle), "signatures")
    some = sigs.where("n > 0")
    firsts = X.stored(some.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")), "sets")
    reps = some.join(firsts, ["h1", "h2", "n"]).where("doc_id = rep").dropDuplicates(["doc_id", "h1"]).select("doc_id", "n", "h1", *_SIG, "bands")
    reps = X.stored(reps, "representatives")
    found = X.shuffled(reps.mapInArrow(_send_bands(n, least, percent), X.FRAMES), n).mapInArrow(_band_edges(least, percent), "u long, v long, e long")
    likely = X.stored(_best(found, TRIES), "candidates")
    clusters = clustered(reps, likely, n, least, percent)
    sets = X.stored(shingle_sets(src, clusters.select("doc"), shingle, n), "cluster-sets")
    X.drop_shuffles(spark)
    comps = components(X.stored(verified(likely, sets, percent, n), "verified"))
    comps = merged(comps, X.stored(joining(clusters, comps, reps, sets, percent, least, n), "joining"))
    X.drop_shuffles(spark)
    of = firsts.join(comps, firsts.rep == comps.doc, "left").select("h1", "h2", "n", F.coalesce("comp", "rep").alias("comp"))
    out = sigs.select("doc_id", "n", "h1", "h2").join(of, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
