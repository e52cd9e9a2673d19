"""WARC archives of web pages and a two-level capture index.

Archives are .warc.gz files in the shared folder: runs of gzip members, one WARC record each.  They
are written and read through Arrow's file systems, so any store with such a file system will do.
The index sorts captures by reversed-host URL key into compressed blocks of lines (first level) and
keeps the first key of each block in a sparse directory (second level).  A lookup searches the heads
of the key ranges, then a range's directory, then the block by bisection, and reads only the
records' ranges of their archives.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import exchange as X

ARCHIVE_BYTES, BLOCK_LINES, DATE = 4 << 20, 1000, "2024-01-01T00:00:00Z"
ARCHIVES = "archive string, cdx string"
#: Neighbouring records that one read fetches.
READ_BYTES = 1 << 20
_BLOCK, _KEY = 0, 1
BLOCKS = "block string, first string, data binary"


def url_key(url: str) -> str:
    """Reversed host, then path and query: http://www.a.org:80/x?y -> org,a,www)/x?y."""
    try:
        u = urlsplit(url if "://" in url else f"http://{url}")
        host, port = u.hostname or "", u.port
    except ValueError:
        return ")" + url
    host = ",".join(reversed(host.split(".")))
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return f"{host}{f':{port}' if port and port not in (80, 443) else ''}){tail}"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str) -> str:
    """Header values stay on one line."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int, url: str, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """One gzip member with a response record, or a revisit record where ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def parse(member: bytes) -> dict:
    """Fields of a record: type, page_id, url, digest, size, payload (None for a revisit), refers_to."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    ident = lambda x: int(x[len("<urn:page:") : -1])
    revisit = fields["WARC-Type"] == "revisit"
    out = {"type": fields["WARC-Type"], "page_id": ident(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "size": size, "payload": None if revisit else payload, "refers_to": ident(fields["WARC-Refers-To"]) if revisit else None}
    if not revisit and (digest(payload) != out["digest"] or len(payload) != size):
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def write_archives(pages: DataFrame, min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Archives of all pages (null html: empty; null url: empty); a row (archive, cdx) for each file.

    Of equal payloads of at least ``min_bytes`` bytes the page with the smallest page_id is a
    response record and the others are revisits of it; smaller payloads are all responses.  Rows
    without page_id are left out; rows that repeat the smallest page_id are all responses.  Files go
    to ``folder``, or to a new one in the shared folder.  A task that runs again writes files of its
    own names, and the rows tell which ones count.
    """
    where = folder or X.scratch(pages.sparkSession, "warc-files")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    src = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size"))
    firsts = src.groupBy("sha1", "size").agg(F.min("page_id").alias("first"))
    revisit = (F.col("page_id") != F.col("first")) & (F.col("size") >= min_bytes)
    rows = src.hint("merge").join(firsts, ["sha1", "size"]).select("page_id", "url", "sha1", "size", F.when(~revisit, F.col("html")).alias("html"), F.when(revisit, F.col("first")).alias("refers_to"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, data, cdx = TaskContext.get().partitionId(), 0, bytearray(), []
        store, path = fs.FileSystem.from_uri(where)

        def archive() -> pa.RecordBatch:
            name = f"pages-{task:06d}-{number:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
            store.create_dir(path, recursive=True)
            with store.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(bytes(data))
            return pa.record_batch([pa.array([f"{where}/{name}"]), pa.array(["\n".join(cdx)])], names=["archive", "cdx"])

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "size", "sha1", "refers_to")]
            for i in range(batch.num_rows):
                page, url, text, size, sha1, refers = (c[i].as_py() for c in columns)
                sha1 = base64.b32encode(bytes.fromhex(sha1)).decode()
                member = record(page, url, None if text is None else text.encode(), size, sha1, refers)
                cdx.append("\t".join((_line(url_key(url)).replace("\t", "%09"), f"{page:020d}", str(len(data)), str(len(member)))))
                data += member
                if len(data) > ARCHIVE_BYTES:
                    yield archive()
                    number, data, cdx = number + 1, bytearray(), []
        if cdx:
            yield archive()

    return X.stored(rows.mapInArrow(run, ARCHIVES), "warc")


def build_index(archives: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Blocks (block, first, data) of capture lines in order of URL key, then page.

    A line: key, page, archive, offset, length.  Equal keys may run over several blocks and ranges,
    so a host or an address with very many captures does not meet in one task.
    """
    cells = F.split(F.col("line"), "\t")
    lines = archives.select("archive", F.explode(F.split("cdx", "\n")).alias("line")).select(cells[0].alias("key"), cells[1].alias("page"), "archive", cells[2].alias("offset"), cells[3].alias("length"))
    n = X.bucket_count(archives.sparkSession)
    ordered = lines.repartitionByRange(n, "key", "page").sortWithinPartitions("key", "page")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, first = TaskContext.get().partitionId(), 0, [], ""

        def block() -> pa.RecordBatch:
            data = zlib.compress("\n".join(held).encode(), 6)
            return pa.record_batch([pa.array([f"{task:06d}-{number:08d}"]), pa.array([first]), pa.array([data], pa.binary())], names=["block", "first", "data"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "page", "archive", "offset", "length")), strict=True):
                first = row[0] if not held else first
                held.append("\t".join(row))
                if len(held) == block_lines:
                    yield block()
                    number, held = number + 1, []
        if held:
            yield block()

    return X.stored(ordered.mapInArrow(run, BLOCKS), "cdx")


def captures(index: DataFrame) -> DataFrame:
    """All captures of the index: key, page_id, archive, offset, length."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows = [x.split("\t") for x in zlib.decompress(data.as_py()).decode().split("\n")]
                yield _found(rows)

    return index.select("data").mapInArrow(run, "key string, page_id long, archive string, offset long, length long")


def _found(rows: list[list[str]]) -> pa.RecordBatch:
    key, page, archive, offset, length = zip(*rows, strict=True) if rows else ((),) * 5
    return pa.record_batch([pa.array(key, pa.string()), pa.array([int(x) for x in page], pa.int64()), pa.array(archive, pa.string()), pa.array([int(x) for x in offset], pa.int64()), pa.array([int(x) for x in length], pa.int64())], names=["key", "page_id", "archive", "offset", "length"])


def _key(url: str) -> str:
    """An address as the index has it."""
    return _line(url_key(url)).replace("\t", "%09")


def lookup(index: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures (key, page_id, archive, offset, length) of the addresses in column ``url``.

    Each capture comes once, however often its address is asked; null addresses are not asked.
    """
    n = X.bucket_count(index.sparkSession)
    # The first keys of the ranges, one a task of the build, tell in which ranges a key can be.
    part = F.substring("block", 1, 6).cast("int")
    heads = sorted((r["first"], r["part"]) for r in index.groupBy(part.alias("part")).agg(F.min("first").alias("first")).collect())
    lows, parts = [h[0] for h in heads], np.array([h[1] for h in heads], np.int64)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for batch in batches:
            keys, at = [], []
            for key in {_key(u) for u in batch.column("url").to_pylist()}:
                lo, hi = max(0, bisect.bisect_left(lows, key) - 1), bisect.bisect_right(lows, key)
                keys += [key] * (hi - lo)
                at += range(lo, hi)
            to = parts[np.array(at, np.int64)]
            yield from out.add(_KEY, to, {"part": to, "key": pa.array(keys, pa.large_string())})
        yield from out.flush()

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = X.Sender(n)
        for batch in batches:
            to = batch.column("part").to_numpy().astype(np.int64)
            yield from out.add(_BLOCK, to, {"part": to, **{c: batch.column(c).cast(pa.large_string()) for c in ("block", "first")}, "data": batch.column("data").cast(pa.large_binary())})
        yield from out.flush()

    def seek(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list] = {}
        asked: dict[int, set] = {}
        for _, tag, frame in X.frames(batches):
            t = X.unpack(frame)
            if tag == _KEY:
                for p, key in zip(t.column("part").to_pylist(), t.column("key").to_pylist(), strict=True):
                    asked.setdefault(p, set()).add(key)
            else:
                for p, *row in zip(*(t.column(c).to_pylist() for c in ("part", "block", "first", "data")), strict=True):
                    blocks.setdefault(p, []).append(row)
        for p, keys in asked.items():
            own = sorted(blocks.get(p, ()))
            directory = [b[1] for b in own]
            at, lines, rows = -1, [], []
            for key in sorted(keys):
                first = max(0, bisect.bisect_left(directory, key) - 1)
                for i in range(first, bisect.bisect_right(directory, key)):
                    if i != at:
                        at, lines = i, zlib.decompress(own[i][2]).decode().split("\n")
                    j = bisect.bisect_left(lines, key + "\t")
                    while j < len(lines) and lines[j].startswith(key + "\t"):
                        rows.append(lines[j].split("\t"))
                        j += 1
                if len(rows) > 20_000:
                    yield _found(rows)
                    rows = []
            yield _found(rows)

    asks = urls.where("url is not null").select(F.col("url").cast("string").alias("url")).mapInArrow(place, X.FRAMES)
    dealt = index.select(part.alias("part"), "block", "first", "data").mapInArrow(deal, X.FRAMES)
    return X.shuffled(asks.union(dealt), n).mapInArrow(seek, "key string, page_id long, archive string, offset long, length long")


def _reads(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """(archive, offset, [(place in it, length)]) of neighbouring ranges, sorted, as single reads."""
    held: tuple[str, int, list] | None = None
    for archive, offset, length in rows:
        end = held[1] + sum(held[2][-1]) if held else 0
        if held and held[0] == archive and offset == end and offset + length - held[1] <= READ_BYTES:
            held[2].append((offset - held[1], length))
            continue
        if held:
            yield held
        held = (archive, offset, [(0, length)])
    if held:
        yield held


def read_records(found: DataFrame) -> DataFrame:
    """Reads the captures' ranges of their archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload."""
    n = X.bucket_count(found.sparkSession)
    kinds = (("page_id", pa.int64()), ("url", pa.string()), ("size", pa.int64()), ("digest", pa.string()), ("type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            got, size = [], 0
            for archive, offset, members in _reads(list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True))):
                if archive != name:
                    store, path = fs.FileSystem.from_uri(archive)
                    name, file = archive, store.open_input_file(path)
                raw = memoryview(file.read_at(sum(members[-1]), offset))
                got += [parse(raw[a : a + m]) for a, m in members]
                size += len(raw)
                if size > READ_BYTES:
                    yield _records(got, kinds)
                    got, size = [], 0
            if got:
                yield _records(got, kinds)

    ranges = found.select("archive", "offset", "length").repartition(n, "archive").sortWithinPartitions("archive", "offset")
    return ranges.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def _records(got: list[dict], kinds: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([g[k] for g in got], t) for k, t in kinds], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
