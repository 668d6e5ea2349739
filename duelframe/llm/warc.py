"""WARC archives: deduplicating writer and splittable reader (operator 2).

The writer makes one gzip member for each record.  Of records with equal payloads (equal
SHA-256 and length) the one with the smallest id is a ``response`` with the payload, the
others are ``revisit`` records that name it.  Every task attempt writes files of its own
names, and the manifest of written files is a Parquet table that Spark commits: files of
lost or repeated attempts are not in it and are never read.

The reader plans byte ranges over the manifest.  A task scans its range for the gzip magic,
takes a position as a member only if the gzip header is well formed and the member's first
bytes inflate to the start of a WARC record, and owns the records that start inside its range;
the last one may end beyond it.  From a validated member the walk goes on at that member's
exact end.  Header and body may be of any length and compress to any ratio.  A member that
starts as a record but has no valid header, or whose body is damaged, raises an error, and if
the manifest has the records of each archive, ``read`` counts them in a pass of its own before
it returns: records are never left out silently.  (A payload that itself holds an
uncompressed-stored WARC archive could be taken for records if a range happens to start inside
it; the count then differs.)

Files are opened through ``pyarrow.fs`` on the shared checkpoint folder or another folder
that all executors reach (file, hdfs, s3, gs).

Defined results: null payload is empty.  Equal rows of the smallest id are all responses; a
null id counts as larger than any other, and if all ids of equal payloads are null they are
all responses.  Null URL: no target header, read back as null.  Empty table: no rows.  Other
columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.session import materialize, scratch_path

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20        # an archive file is closed beyond this
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
PIECE_BYTES = 1 << 10         # of a member's first inflated piece; each next one may be twice as long,
MAX_PIECE_BYTES = 1 << 20     # to this
BATCH_BYTES = 8 << 20
LEVEL = 4
_PREFIX = "urn:page:"
_START = b"WARC/1."


def _open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri)


def payload_digest(payload: bytes) -> str:
    """Upper-case base 32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(value) -> str:
    return f"<{_PREFIX}{'' if value is None else value}>"


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC record (not compressed)."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        head += [f"WARC-Refers-To: {_id(refers_to)}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_URL_SAFE = "%:/?#[]@!$&'()*+,;=-._~"


def member(data: bytes, level: int = LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html", revisit_bytes: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row as a WARC record; returns the manifest (path, bytes, records).

    Payloads shorter than ``revisit_bytes`` are always responses."""
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    # only payloads that occur again need their first id; counts are pre-aggregated before the shuffle
    again = (rows.where(F.col("size") >= revisit_bytes).groupBy("key", "size")
             .agg(F.count("*").alias("n"), F.min("id").alias("head")).where("n > 1")
             .select("key", "size", F.lit(True).alias("again"), "head"))
    typed = (rows.join(again, ["key", "size"], "left")
             .select("id", "url", "payload", "head",
                     (F.coalesce("again", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("head"))).alias("revisit")))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open_fs(folder)
        store.create_dir(base, recursive=True)
        out, done = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{base}/{name}", compression=None), 0, 0
                data = member(record(r["id"], r["url"], r["payload"], r["head"], r["revisit"]))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= file_bytes:
                    out.close()
                    done.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, size, count))
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{d[0]}" for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], names=["path", "bytes", "records"])

    return materialize(typed.mapInArrow(save, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file by position, read ahead in blocks."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``pos`` (fewer at the end of the file)."""
        if pos < self.at or pos + n > self.at + len(self.data):
            want = min(max(n, READ_BYTES), self.size - pos)
            self.at, self.data = pos, self.file.read_at(want, pos) if want > 0 else b""
        return self.data[pos - self.at:pos - self.at + n]


def _candidate(w: _Window, pos: int, end: int) -> int:
    """The first magic at ``pos`` or after that starts before ``end``; -1 if none."""
    while pos < end:
        block = w.get(pos, READ_BYTES)
        k = block.find(MAGIC)
        if 0 <= k:
            return pos + k if pos + k < end else -1
        if len(block) < READ_BYTES:
            return -1
        pos += len(block) - len(MAGIC) + 1
    return -1


def _inflate(w: _Window, pos: int) -> Iterator[tuple[bytes, int]]:
    """(bytes, position after the member or 0) piece by piece; zlib.error if not a member.

    The first pieces are short: a record's start is seen before any damage that comes later."""
    z, most = zlib.decompressobj(31), PIECE_BYTES
    while not z.eof:
        block = z.unconsumed_tail
        if not block:
            block = w.get(pos, 1 << 16)
            if not block:
                raise zlib.error("the member is cut off")
            pos += len(block)
        out = z.decompress(block, most)
        most = min(2 * most, MAX_PIECE_BYTES)
        yield out, pos - len(z.unused_data) if z.eof else 0


def _header(head: bytes) -> dict[str, str] | None:
    """Fields of a WARC header block by lower-case name; None if it is not one."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(_START):
        return None
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def members(w: _Window, start: int, end: int, path: str = "") -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(position, header fields, block) of each record that starts in [start, end)."""
    pos = start
    while (pos := _candidate(w, pos, end)) >= 0:
        flags = w.get(pos, 4)
        data, fields, after, body = bytearray(), None, 0, 0
        parts: list[bytes] = []
        try:
            if len(flags) < 4 or flags[3] & 0xE0:
                raise zlib.error("reserved flags")
            for out, after in _inflate(w, pos):
                if fields is not None:
                    parts.append(out)
                    continue
                seen = max(0, len(data) - 3)
                data += out
                if not data.startswith(_START[:len(data)]):
                    raise zlib.error("not a record")
                body = data.find(b"\r\n\r\n", seen)
                if body >= 0:
                    fields = _header(bytes(data[:body]))
                    if fields is None:
                        raise zlib.error("not a record header")
                    parts.append(bytes(data[body + 4:]))
            if fields is None:
                raise zlib.error("no header")
        except zlib.error as e:
            if data.startswith(_START):
                raise ValueError(f"damaged record at {path}:{pos}") from e
            pos += 1
            continue
        block = b"".join(parts)
        n = int(fields["content-length"])
        if len(block) < n:
            raise ValueError(f"record at {path}:{pos} is shorter than its Content-Length")
        yield pos, fields, block[:n]
        pos = after


SCHEMA = ("path string, offset long, record_type string, id long, target_uri string, refers_to long, "
          "payload binary, payload_bytes long, payload_digest string")
_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("id", pa.int64()),
                    ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
                    ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _number(field: str | None) -> int | None:
    value = (field or "").strip("<>").removeprefix(_PREFIX)
    return int(value) if value else None


def _row(path: str, pos: int, f: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    declared = f.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = f["warc-type"] == "revisit"
    if revisit:                                # the payload is the response's; its length stands in the HTTP header
        size = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        payload, digest = None, declared
    else:
        size, digest = len(payload), payload_digest(payload)
        if declared and declared != digest:
            raise ValueError(f"payload of the record at {path}:{pos} does not have its digest")
    return (path, pos, f["warc-type"], _number(f.get("warc-record-id")), f.get("warc-target-uri"),
            _number(f.get("warc-refers-to")) if revisit else None, payload, size, digest)


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives of a manifest (path, bytes, and records if they are to be
    counted); see ``SCHEMA``."""
    total = manifest.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 1
    splits = (manifest.where("bytes > 0")
              .select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start"))
              .repartition(min(int(total), 10_000), "path", "start"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, dict[str, str], bytes]]:
        for batch in batches:
            for s in batch.to_pylist():
                store, name = _open_fs(s["path"])
                with store.open_input_file(name) as f:
                    for found in members(_Window(f, s["bytes"]), s["start"], min(s["start"] + split_bytes, s["bytes"]), s["path"]):
                        yield s["path"], *found

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter(path for path, *_ in walk(batches))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["path", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for path, pos, fields, block in walk(batches):
            rows.append(_row(path, pos, fields, block))
            held += len(block) + 200
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    if "records" in manifest.columns:
        zero = F.lit(0).cast("long")
        wrong = (splits.mapInArrow(count, "path string, n long").select("path", "n", zero.alias("records"))
                 .unionByName(manifest.select("path", zero.alias("n"), "records"))
                 .groupBy("path").agg(F.sum("n").alias("n"), F.sum("records").alias("records")).where("n <> records").first())
        if wrong is not None:
            raise ValueError(f"{wrong['path']} has {wrong['n']} records, the manifest {wrong['records']}")
    return splits.mapInArrow(scan, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
