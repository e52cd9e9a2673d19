"""Line dedup with sharded cuckoo filters over exact reference counts.

A shard owns the line keys of one bucket: an exact table of references (key, documents, largest
document) and a cuckoo filter of the keys whose count reaches the limit.  Probes meet the filter
first and only what passes is looked up in the table, so a filter's false positives never show.

``dedup_lines`` does a whole table in one pass: map tasks pre-aggregate the references of a block
of documents (a key found often enough in a block is settled there, but for its largest document),
so a shard gets at most ``min_docs - 1`` rows a block for a line, however frequent it is.
``LineIndex`` keeps the same shards on disk between batches; references are signed rows, so a
deletion of documents takes back exactly what their insertion added.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X
from loomgraph.llm import kernel as K
from loomgraph.llm.cuckoo import CuckooFilter

MIN_DOCS, MIN_CHARS = 5, 40
_REF, _DROP, _TEXT = 0, 1, 9
#: Rows gathered before a block is settled.
_BLOCK = 400_000


def with_ids(docs: DataFrame, *extra: str) -> DataFrame:
    """doc_id as long and text as string; rows without doc_id are left out, as nothing could refer to them."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def line_keys(column: pa.Array, min_chars: int) -> tuple:
    """(data, start, end, line offsets, numbers of the eligible lines, their two hashes)."""
    data, offs = K.text_bytes(column)
    start, end, at = K.lines(data, offs)
    lo, hi = K.stripped(data, start, end)
    points = K.code_points(data)
    pick = np.flatnonzero(points[hi] - points[lo] >= min_chars)
    low = K.LOWER[data]
    k1, k2 = K.range_hashes(low, lo[pick], hi[pick], 0, 1)
    return data, start, end, at, pick, k1, k2


def _mark(ids: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    """One value for a document and a key."""
    return K.mix(K.doc_hash(ids) * K.U64(0x9FB21C651E98DF25) + K.mix(k1 + K.U64(1)) * K.U64(3) + k2)


def _settled(k1: np.ndarray, k2: np.ndarray, ids: np.ndarray, least: int) -> tuple:
    """References of a block, sorted: (rows to send, their weights, rows that lose the line here already)."""
    order = np.lexsort((ids, k2, k1))
    k1, k2, ids = k1[order], k2[order], ids[order]
    new = K.group_starts(k1, k2)
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    top = ids == ids[last][group]
    often = count[group] >= least
    ends = np.zeros(len(ids), bool)
    ends[last] = True
    send = ~often | ends
    weight = np.where(often, count[group], 1)[send]
    return (k1[send], k2[send], ids[send], weight), (k1[often & ~top], k2[often & ~top], ids[often & ~top])


def references(n: int, min_docs: int, min_chars: int):
    """Map side: references by shard, and drops that are certain within a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = X.Sender(n), [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            (k1, k2, ids, w), lost = _settled(*(np.concatenate([h[i] for h in held]) for i in range(3)), min_docs)
            yield from out.add(_REF, k1, {"k1": k1, "k2": k2, "doc": ids, "w": w.astype(np.int32)})
            yield from out.add(_DROP, K.doc_hash(lost[2]), {"to": K.doc_hash(lost[2]), "mark": _mark(lost[2], *lost[:2])})

        for part in K.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            _, _, _, at, pick, k1, k2 = line_keys(part.column("text"), min_chars)
            row = K.owners(at, pick)
            order = np.lexsort((k2, k1, row))  # a document counts once for a key
            once = order[K.group_starts(row[order], k1[order], k2[order])]
            held.append((k1[once], k2[once], ids[row[once]]))
            size += len(once)
            if size > _BLOCK:
                yield from settle()
                held, size = [], 0
        if held:
            yield from settle()
        yield from out.flush()

    return run


def _shards(n: int, min_docs: int):
    """Shard side: reference table and filter of each shard; who loses a line."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = []
        for b, tag, frame in X.frames(batches):
            if tag == _DROP:
                yield X.row(b, tag, frame)
            else:
                refs.append(X.unpack(frame))
        if not refs:
            return
        r = X.joined(refs)
        order = np.lexsort((r["doc"], r["k2"], r["k1"]))
        k1, k2, doc, w = (r[c][order] for c in ("k1", "k2", "doc", "w"))
        new = K.group_starts(k1, k2)
        at = np.flatnonzero(new)
        total = np.add.reduceat(w, at)
        last = np.append(at[1:], len(new)) - 1
        often = np.flatnonzero(total >= min_docs)
        if not len(often):
            return
        probe = k1 ^ K.mix(k2)
        hit = np.flatnonzero(CuckooFilter.of(probe[at[often]]).contains(probe))
        group = np.cumsum(new)[hit] - 1
        lost = hit[(total[group] >= min_docs) & (doc[hit] < doc[last[group]])]
        out = X.Sender(n)
        yield from out.add(_DROP, K.doc_hash(doc[lost]), {"to": K.doc_hash(doc[lost]), "mark": _mark(doc[lost], k1[lost], k2[lost])})
        yield from out.flush()

    return run


def _apply(min_chars: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks: list | np.ndarray = []
        for _, tag, frame in X.frames(batches):
            if tag == _DROP:
                marks.append(X.unpack(frame))
                continue
            if isinstance(marks, list):
                marks = np.unique(X.joined(marks)["mark"]) if marks else np.zeros(0, K.U64)
            for part in K.slices([X.unpack(frame)]):
                yield _kept(part, marks, min_chars, schema)

    return run


def _kept(part: pa.RecordBatch, marks: np.ndarray, min_chars: int, schema: pa.Schema) -> pa.RecordBatch:
    ids = part.column("doc_id").to_numpy(zero_copy_only=False)
    data, start, end, at, pick, k1, k2 = line_keys(part.column("text"), min_chars)
    row = K.owners(at, pick)
    drop = np.zeros(len(start), bool)
    if len(marks):
        m = _mark(ids[row], k1, k2)
        drop[pick] = marks[np.minimum(np.searchsorted(marks, m), len(marks) - 1)] == m
    lost = np.diff(np.concatenate([[0], np.cumsum(drop)])[at])
    raw, texts = data.tobytes(), []
    for i in range(part.num_rows):
        if lost[i]:
            texts.append(b"\n".join(raw[start[j] : end[j]] for j in range(at[i], at[i + 1]) if not drop[j]))
        else:
            texts.append(raw[start[at[i]] : end[at[i + 1] - 1]])
    made = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(np.diff(at)), "n_dropped": pa.array(lost)}
    return pa.record_batch([made[f.name] if f.name in made else part.column(f.name).cast(f.type) for f in schema], schema=schema)


def arrow_schema(df: DataFrame, names: tuple[str, ...], more: list[tuple[str, pa.DataType]]) -> tuple[pa.Schema, str]:
    """Arrow schema and DDL of the given new columns and of columns that are carried along."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: f for f in df.schema.fields}
    ddl = {pa.int64(): "bigint", pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
    schema = pa.schema([*more, *((c, to_arrow_type(kinds[c].dataType)) for c in names)])
    return schema, ", ".join([f"`{n}` {ddl[t]}" for n, t in more] + [f"`{c}` {kinds[c].dataType.simpleString()}" for c in names])


def check_names(keep: tuple[str, ...], results: list[tuple[str, pa.DataType]]) -> None:
    """Columns that are carried along can't have the name of a result; only the text goes by its own."""
    if bad := {n for n, _ in results if n != "text"} & set(keep):
        raise ValueError(f"columns to keep have names of results: {sorted(bad)}")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops lines found in at least ``min_docs`` documents from all but the one with the largest doc_id.

    Returns doc_id, text (kept lines joined by \\n), n_lines, n_dropped and the columns in ``keep``.
    A null or empty text is one empty line.  Rows without doc_id are left out.  Repeated rows count
    as documents of their own; rows that tie for the largest doc_id all keep the line.  Lines that
    repeat inside one document count once and are dropped or kept together.  An empty table gives
    an empty table; columns not named in ``keep`` are not read.
    """
    names = [("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]
    check_names(keep, names)
    src = with_ids(docs, *keep)
    n = X.bucket_count(docs.sparkSession)
    refs = src.select("doc_id", "text").mapInArrow(references(n, min_docs, min_chars), X.FRAMES)
    drops = X.shuffled(refs, n).mapInArrow(_shards(n, min_docs), X.FRAMES)
    schema, ddl = arrow_schema(src, keep, names)
    return X.shuffled(drops.union(X.text_frames(src, n, extra=keep, tag=_TEXT)), n).mapInArrow(_apply(min_chars, schema), ddl)


class LineIndex:
    """Shards on disk between batches: signed references and a filter for each shard.

    ``insert`` and ``delete`` append to the reference table and bring the filters of the shards
    concerned up to date: a key enters its filter when its count comes to 1 and is deleted from it
    when its count falls to 0.  ``seen`` tells the lines of new documents that the index holds, and
    ``kept`` gives new documents without them.  A change is done when its filters are written; an
    index that is opened again goes on from the last change that is done.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 64, min_chars: int = MIN_CHARS):
        self.spark, self.path, self.shards, self.min_chars = spark, path.rstrip("/"), shards, min_chars
        self.version = self._last()

    def _last(self) -> int:
        """The last change whose filters are whole; 0 for a new index."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/filters")
        store = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(root):
            return 0
        names = [x.getPath() for x in store.listStatus(root)]
        done = [int(p.getName()[1:]) for p in names if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(done, default=0)

    def _keys(self, docs: DataFrame) -> DataFrame:
        shards, least = self.shards, self.min_chars

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in K.slices(batches):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                _, _, _, at, pick, k1, k2 = line_keys(part.column("text"), least)
                yield pa.record_batch([pa.array((k1 % K.U64(shards)).astype(np.int32)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(ids[K.owners(at, pick)])], names=["shard", "k1", "k2", "doc_id"])

        return with_ids(docs).mapInArrow(run, "shard int, k1 long, k2 long, doc_id long").distinct()

    def _refs(self) -> DataFrame:
        # By name: references of a change that was not done do not count.
        return self.spark.read.schema("shard int, k1 long, k2 long, doc_id long, d int").parquet(*(f"{self.path}/refs/v{i + 1}" for i in range(self.version)))

    def counts(self) -> DataFrame:
        """Exact counts: shard, k1, k2, n_docs, max_doc of keys that documents hold now."""
        live = self._refs().groupBy("shard", "k1", "k2", "doc_id").agg(F.sum("d").alias("d")).where("d > 0")
        return live.groupBy("shard", "k1", "k2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))

    def filters(self) -> DataFrame:
        return self.spark.read.schema("shard int, filter binary").parquet(f"{self.path}/filters/v{self.version}")

    def _change(self, rows: DataFrame, sign: int) -> LineIndex:
        before = self.counts().select("shard", "k1", "k2", F.col("n_docs").alias("was")) if self.version else None
        rows.withColumn("d", F.lit(sign)).write.mode("overwrite").parquet(f"{self.path}/refs/v{self.version + 1}")
        old = self.filters() if self.version else None
        self.version += 1
        now = self.counts().select("shard", "k1", "k2", F.col("n_docs").alias("now"))
        if before is None:
            before = now.limit(0).withColumnRenamed("now", "was")
        change = now.join(before, ["shard", "k1", "k2"], "full").where("now is null or was is null")
        events = change.select("shard", "k1", "k2", F.col("now").isNotNull().alias("enters"), F.lit(None).cast("binary").alias("filter"))
        if old is not None:
            events = events.unionByName(old, allowMissingColumns=True)

        def run(table: pa.Table) -> pa.Table:
            old = [x for x in table.column("filter").to_pylist() if x is not None]
            t = table.filter(pc.is_null(table.column("filter"))).combine_chunks()
            probe = t.column("k1").to_numpy().view(K.U64) ^ K.mix(t.column("k2").to_numpy().view(K.U64))
            enters = t.column("enters").to_numpy(zero_copy_only=False).astype(bool)
            if old and old[0]:
                filt = CuckooFilter.from_bytes(old[0])
                filt.delete(probe[~enters])
                slots = [filt.table[filt.table != 0].size + enters.sum(), filt.table.size]
                if slots[0] > 0.85 * slots[1] or not filt.insert(probe[enters]):
                    filt = None  # too full: rebuilt from the exact table below
            else:
                filt = None if old else CuckooFilter.of(probe[enters])
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([filt.to_bytes() if filt else b""], pa.binary())})

        events.groupBy("shard").applyInArrow(run, "shard int, filter binary").write.mode("overwrite").parquet(f"{self.path}/filters/v{self.version}")
        if self.filters().where(F.octet_length("filter") == 0).limit(1).count():
            self._rebuild()
        return self

    def _rebuild(self) -> None:
        """Filters of twice the room from the exact counts."""

        def run(table: pa.Table) -> pa.Table:
            probe = table.column("k1").to_numpy().view(K.U64) ^ K.mix(table.column("k2").to_numpy().view(K.U64))
            filt = CuckooFilter(2 * len(probe))
            filt = filt if filt.insert(probe) else CuckooFilter.of(probe)
            return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "filter": pa.array([filt.to_bytes()], pa.binary())})

        keys = self.counts().select("shard", "k1", "k2")
        self.version += 1
        keys.limit(0).withColumn("d", F.lit(0)).select("shard", "k1", "k2", F.lit(0).cast("long").alias("doc_id"), "d").write.mode("overwrite").parquet(f"{self.path}/refs/v{self.version}")
        keys.groupBy("shard").applyInArrow(run, "shard int, filter binary").write.mode("overwrite").parquet(f"{self.path}/filters/v{self.version}")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(self._keys(docs), 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """Takes back documents that were inserted with these texts."""
        return self._change(self._keys(docs), -1)

    def seen(self, docs: DataFrame) -> DataFrame:
        """doc_id, k1, k2, n_docs, max_doc of the documents' lines that the index holds.

        A shard's filter goes to the tasks that hold its probes; what passes is joined with the
        exact counts.
        """
        probes = self._keys(docs).withColumn("filter", F.lit(None).cast("binary"))

        def run(table: pa.Table) -> pa.Table:
            found = [x for x in table.column("filter").to_pylist() if x is not None]
            t = table.filter(pc.is_null(table.column("filter"))).combine_chunks().drop_columns(["filter"])
            if not found:
                return t.slice(0, 0)
            if not found[0]:
                return t
            probe = t.column("k1").to_numpy().view(K.U64) ^ K.mix(t.column("k2").to_numpy().view(K.U64))
            return t.filter(pa.array(CuckooFilter.from_bytes(found[0]).contains(probe)))

        maybe = probes.unionByName(self.filters(), allowMissingColumns=True).groupBy("shard").applyInArrow(run, "shard int, k1 long, k2 long, doc_id long")
        return maybe.join(self.counts(), ["shard", "k1", "k2"]).select("doc_id", "k1", "k2", "n_docs", "max_doc")

    def kept(self, docs: DataFrame, min_docs: int = 1) -> DataFrame:
        """doc_id, text, n_lines, n_dropped of new documents without lines that ``min_docs`` documents of the index hold."""
        n, least = X.bucket_count(self.spark), self.min_chars
        src = with_ids(docs)
        hits = self.seen(docs).where(F.col("n_docs") >= min_docs).select("doc_id", "k1", "k2").distinct()

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = X.Sender(n)
            for batch in batches:
                ids, k1, k2 = (batch.column(c).to_numpy() for c in ("doc_id", "k1", "k2"))
                yield from out.add(_DROP, K.doc_hash(ids), {"to": K.doc_hash(ids), "mark": _mark(ids, k1.view(K.U64), k2.view(K.U64))})
            yield from out.flush()

        schema, ddl = arrow_schema(src, (), [("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
        return X.shuffled(hits.mapInArrow(send, X.FRAMES).union(X.text_frames(src, n, tag=_TEXT)), n).mapInArrow(_apply(least, schema), ddl)
