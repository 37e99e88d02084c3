"""WARC archives: one gzip member per record, written and read back in streams.

An archive is a sequence of parts (archive string, part int, content binary), so that
it can lie in a table on any store that Spark reaches; parts may end anywhere, inside
a record too. ``archives`` adds a column whole, as its parts hold whole records: such
parts are read where they lie, in any order, each from its start to its end, and only
others travel to one task for each archive. ``export`` writes archives as files,
``archive_files`` reads files.

The reader takes an archive's parts in order, undoes gzip with one incremental zlib
object per member and a bounded piece at a time, frames records by Content-Length as
their bytes come and verifies block and payload digests. What is not a record, a member
longer or shorter than its record among it, raises ``ValueError``.

Pages with equal payloads of ``least`` bytes or more: the one with the smallest id is
a response, the others are revisits that refer to it and hold no payload, only the
HTTP header. An archive's name holds the number of the task that wrote it, so names are unique
whatever the ids are. Defined cases: null html is an empty payload; a page with a null id is a
response of its own, and a page repeated with the same id is a response each time;
control characters and blanks in a url are percent-encoded; a payload of any length is
one record (and, read back, one row: 2 GB at most); ids are longs or text that reads as
one; other columns, whatever their names, are left alone; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads of fewer bytes are never revisits.
LEAST = 0
#: Bytes of gzip that one part holds, and of payload that one archive holds, about.
PART_BYTES, ARCHIVE_BYTES = 1 << 20, 64 << 20
#: Bytes inflated at a time, and of a record's header at most.
PIECE, HEADER_BYTES = 1 << 20, 1 << 26
#: Records carry no clock: all have this date.
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARTS = "archive string, part int, content binary, whole boolean"
RECORDS = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")


def record(record_id: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One response, or revisit if ``refers_to``, as a gzip member."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url)), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}")]
    if refers_to:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    else:
        block += payload
    head += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(text.encode() + block + b"\r\n\r\n") + squeeze.flush()


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, url, payload, refers_to -> parts."""
    task, number, part, held, size, payloads = TaskContext.get().partitionId(), 0, 0, [], 0, 0

    def full() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f"pages-{task:06d}-{number:06d}"]), pa.array([part], pa.int32()), pa.array([b"".join(held)], pa.binary()), pa.array([True])], ["archive", "part", "content", "whole"])

    for batch in batches:
        ids, urls, refers = (batch.column(i).to_pylist() for i in (0, 1, 3))
        for i, url, payload, to in zip(ids, urls, batch.column(2), refers, strict=True):
            body = payload.as_py() or b""
            held.append(record(f"urn:page:{'' if i is None else i}", url, body, None if to is None else f"urn:page:{to}"))
            size += len(held[-1])
            payloads += len(body)
            if size >= PART_BYTES or payloads >= ARCHIVE_BYTES:
                yield full()
                part, held, size = part + 1, [], 0
            if payloads >= ARCHIVE_BYTES:
                number, part, payloads = number + 1, 0, 0
    if held:
        yield full()


def archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST) -> DataFrame:
    """The parts of the archives of all pages."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    first = pages.select(F.col(id_col).cast("long").alias("id"), F.sha1(payload).alias("first_sha1"), F.length(payload).alias("n"))
    first = first.filter(F.col("n") >= least).groupBy("first_sha1").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("first_sha1", "first")
    dealt = rows.join(first, rows["sha1"] == first["first_sha1"], "left")
    return dealt.select("id", "url", "payload", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to")).mapInArrow(_write, PARTS)


class RecordReader:
    """Records of one archive, from its bytes in pieces of any size."""

    def __init__(self):
        self._zip = None
        self._new()

    def _new(self) -> None:
        self._text, self._head, self._size = bytearray(), None, 0  # bytes of the member that are not in a finished record, its header, its length

    def feed(self, data: bytes) -> Iterator[dict]:
        while data:
            if self._zip is None:
                self._zip = zlib.decompressobj(31)
            self._take(self._zip.decompress(data, PIECE))
            data = self._zip.unconsumed_tail
            while not data and not self._zip.eof and (more := self._zip.decompress(b"", PIECE)):
                self._take(more)
            if self._zip.eof:
                data, self._zip = self._zip.unused_data, None
                yield self._record()

    def close(self) -> None:
        if self._zip is not None or self._text:
            raise ValueError("the archive ends inside a record")

    def _take(self, piece: bytes) -> None:
        """Add what was inflated; the length is known, and bounds what is held, from the header on."""
        old = len(self._text)
        self._text += piece
        if self._head is None:
            end = self._text.find(b"\r\n\r\n", max(0, old - 3))
            if end < 0:
                if len(self._text) > HEADER_BYTES:
                    raise ValueError("a member is not a WARC record")
                return
            lines = self._text[:end].decode("utf-8", "replace").split("\r\n")
            if not lines[0].startswith("WARC/1."):
                raise ValueError("a member is not a WARC record")
            self._head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = self._head.get("content-length", "")
            if not size.isdigit():
                raise ValueError(f"{self._head.get('warc-record-id')}: no length is stated")
            self._size = int(size)
            del self._text[: end + 4]
        if len(self._text) > self._size + 4:
            raise ValueError(f"{self._head.get('warc-record-id')}: the block isn't as long as stated")

    def _record(self) -> dict:
        head, size, text = self._head, self._size, self._text
        if head is None:
            raise ValueError("a member is not a WARC record")
        if len(text) != size + 4 or text[size:] != b"\r\n\r\n":
            raise ValueError(f"{head.get('warc-record-id')}: the block isn't as long as stated")
        self._new()
        block = bytes(memoryview(text)[:size])
        kind = head.get("warc-type")
        http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        digest = head.get("warc-payload-digest", "").rpartition(":")[2]
        if "warc-block-digest" in head and head["warc-block-digest"].rpartition(":")[2] != sha1_base32(block):
            raise ValueError(f"{head.get('warc-record-id')}: block digest differs")
        if kind != "revisit" and digest and digest != sha1_base32(payload):
            raise ValueError(f"{head.get('warc-record-id')}: payload digest differs")
        bare = lambda k: head[k].strip("<>") if k in head else None
        n = int(stated[1]) if kind == "revisit" and stated else len(payload)
        return {"record_id": bare("warc-record-id"), "record_type": kind, "target_uri": head.get("warc-target-uri"), "payload_digest": digest or None, "payload_bytes": n, "refers_to": bare("warc-refers-to"), "payload": payload}


_RECORD_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])


def _read(payloads: bool, whole: bool):
    """Reader of parts in order; of ``whole`` ones, each must begin and end with a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, out, size = None, None, [], 0
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if reader is None or whole or name != now:
                    if reader:
                        reader.close()
                    reader, now = RecordReader(), name
                for r in reader.feed(content.as_py()):
                    size += len(r["payload"])
                    out.append(r if payloads else r | {"payload": None})
                    if size >= PART_BYTES * 4 or len(out) >= 10_000:
                        yield pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)
                        out, size = [], 0
        if reader:
            reader.close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _RECORD_SCHEMA)

    return run


def read(parts: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives given as parts, each part or, where its column whole is missing or not true, each archive read by one task from its start to its end."""
    columns = ("archive", "part", "content")
    together = lambda t: t.select(*columns).repartition("archive").sortWithinPartitions("archive", "part").mapInArrow(_read(payloads, False), RECORDS)
    if "whole" not in parts.columns:
        return together(parts)
    alone = parts.filter("whole").select(*columns).mapInArrow(_read(payloads, True), RECORDS)
    return alone.unionByName(together(parts.filter("not coalesce(whole, false)")))


def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder or glob as archives of one part each (a file must fit in a row: 2 GB)."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.lit(0).alias("part"), "content")


def export(parts: DataFrame, folder: str) -> None:
    """Write each archive as ``<archive>.warc.gz`` into a folder that all executors mount.

    A file gets its name when it is whole; a task that is tried again starts it anew.
    """

    def save(rows) -> None:
        for name, own in groupby(rows, lambda r: r.archive):
            whole = os.path.join(folder, f"{name}.warc.gz")
            draft = f"{whole}.{uuid.uuid4().hex}.part"
            with open(draft, "wb") as f:
                for r in own:
                    f.write(r.content)
            os.replace(draft, whole)

    parts.repartition("archive").sortWithinPartitions("archive", "part").foreachPartition(save)
