"""Shuffles of column frames instead of rows.

A map task packs what it sends to one bucket into compressed Arrow frames, so the JVM moves a few
large rows.  Rows are (b int, tag int, frame binary); ``shuffled`` deals them out by b.  A task gets
whole buckets, and frames come ordered by tag.  The number of buckets is the session's
``spark.sql.shuffle.partitions``, as with any shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

FRAMES = "b int, tag int, frame binary"
_SCHEMA = pa.schema([("b", pa.int32()), ("tag", pa.int32()), ("frame", pa.binary())])
_ZSTD = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))
#: Bytes that a map task gathers before it sends.
FLUSH_BYTES = 24 << 20


def pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(frame: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(frame).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)


def row(b: int, tag: int, frame: bytes) -> pa.RecordBatch:
    return pa.record_batch([pa.array([b], pa.int32()), pa.array([tag], pa.int32()), pa.array([frame], pa.binary())], schema=_SCHEMA)


class Sender:
    """Gathers columns by tag and yields frames by bucket."""

    def __init__(self, buckets: int, limit: int = FLUSH_BYTES):
        self.buckets, self.limit, self.size, self.held = buckets, limit, 0, {}

    def add(self, tag: int, to: np.ndarray, columns: dict) -> Iterator[pa.RecordBatch]:
        """to: a hash or id of the bucket of each row, taken modulo the number of buckets."""
        if len(to):
            batch = pa.record_batch([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns.values()], names=list(columns))
            self.held.setdefault(tag, []).append(((np.asarray(to).astype(np.uint64) % np.uint64(self.buckets)).astype(np.int32), batch))
            self.size += batch.nbytes
            if self.size > self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        held, self.held, self.size = self.held, {}, 0
        for tag, parts in held.items():
            to = np.concatenate([p[0] for p in parts])
            table = pa.Table.from_batches([p[1] for p in parts])
            order = np.argsort(to, kind="stable")
            table, to = table.take(pa.array(order)), to[order]
            cut = np.flatnonzero(np.diff(to, prepend=-1))
            for at, end in zip(cut, [*cut[1:], len(to)], strict=True):
                part = table.slice(at, end - at).combine_chunks().to_batches()[0]
                yield row(int(to[at]), tag, pack(part))


def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        b, tag, frame = batch.column("b"), batch.column("tag"), batch.column("frame")
        for i in range(batch.num_rows):
            yield b[i].as_py(), tag[i].as_py(), frame[i].as_py()


def joined(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    """Numeric columns of the frames put together."""
    t = pa.Table.from_batches(parts)
    return {n: t.column(n).to_numpy() for n in t.column_names}


def bucket_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shuffled(df: DataFrame, n: int) -> DataFrame:
    """Whole buckets to tasks, frames in order of tag.  A few large rows are sorted."""
    return df.repartitionById(n, df["b"]).sortWithinPartitions("tag")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; set here only where the session has none."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        where = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    return where


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of frames that are out of use.

    The cleaner works behind references that the collector has cleared, so it gets two turns.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def text_frames(docs: DataFrame, n: int, key: str = "doc_id", extra: tuple[str, ...] = (), tag: int = 9) -> DataFrame:
    """Whole documents as frames dealt by id, to be read after all smaller tags."""
    from loomgraph.llm import kernel as K

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(n)
        for part in K.slices(batches):
            ids = part.column("doc_id").to_numpy(zero_copy_only=False)
            yield from out.add(tag, K.doc_hash(ids), {"doc_id": ids, "text": part.column("text").cast(pa.large_string()), **{c: part.column(c) for c in extra}})
        yield from out.flush()

    return docs.select("doc_id", "text", *extra).mapInArrow(run, FRAMES)
