"""WARC archives: written by tasks as gzip members, read back by a splittable reader.

A reader task owns a byte range of a file. It scans the range for gzip's first bytes, takes a candidate for a record only
if decoding it gives a WARC header, and reads every record that starts inside the range to its end, even beyond the range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import open_folder
from seqloom.session import cut_lineage

GZIP_MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
# Reading tasks in one job; further splits share them.
MOST_TASKS = 100_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record_bytes(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or without its payload a revisit record. The HTTP header states the full payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{record_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def with_revisits(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload and `refers_to`: of equal payloads of at least `least_bytes` bytes all rows but that with the
    largest key refer to it. Groups are counted map-side first and stored: what adaptive execution reads from a table, not
    from an aggregate, it can split, so a group of any size joins its one row in several tasks."""
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("same", F.sha2("payload", 256))
    groups = cut_lineage(
        rows.filter(F.length("payload") >= least_bytes).groupBy(F.col("same").alias("g_same"))
        .agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    joined = rows.join(groups, F.col("same") == F.col("g_same"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id"))
    return joined.select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0,
    file_bytes: int = FILE_BYTES, level: int = 6,
) -> DataFrame:
    """Write one record per row of `pages` below `folder`; the manifest: path, n_bytes, n_records.

    Null html is an empty payload, a null url leaves out its header. Rows with the same key are records of their own. A
    null key refers to the group's largest key; equal payloads without any key are all responses. Every attempt of a task
    writes files of its own, and only files in the manifest of the attempt that Spark accepts count: materialise the
    manifest before reading, as a second run writes new files. No rows give no files.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(root, recursive=True)
        out, written, records, name, done = None, 0, 0, None, []
        for batch in batches:
            for page_id, target, payload, refers in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, written, records = store.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                ids = ["" if value is None else quote(str(value), safe="") for value in (page_id, refers)]
                record = record_bytes(ids[0], target, payload, digest, None if refers is None else ids[1])
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(record) + packer.flush()
                out.write(member)
                written, records = written + len(member), records + 1
                if written >= file_bytes:
                    out.close()
                    done.append((f"{folder.rstrip('/')}/{name}", written, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name}", written, records))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
            ["path", "n_bytes", "n_records"],
        )

    rows = with_revisits(pages, key, url, html, least_bytes)
    return rows.mapInArrow(write, "path string, n_bytes long, n_records long")


class _Range:
    """Bytes of a file from a position on, read as they are needed and forgotten once they lie behind."""

    def __init__(self, stream, start: int, step: int = 1 << 20):
        self.stream, self.step, self.base, self.data, self.ended = stream, step, start, b"", False
        stream.seek(start)

    def more(self) -> bool:
        piece = b"" if self.ended else self.stream.read(self.step)
        self.ended = not piece
        self.data += piece
        return bool(piece)

    def find(self, what: bytes, at: int, before: int) -> int:
        """Position of `what` at or after `at`, starting before `before`; -1 if there is none."""
        while True:
            found = self.data.find(what, at - self.base)
            if found >= 0:
                return self.base + found if self.base + found < before else -1
            at = max(at, self.base + len(self.data) - len(what) + 1)
            if at >= before:
                return -1
            self.forget(at)
            if not self.more():
                return -1

    def forget(self, before: int) -> None:
        if before - self.base >= self.step:
            self.data, self.base = self.data[before - self.base :], before

    def member(self, at: int, piece: int = 1 << 14) -> Iterator[tuple[bytes, int]]:
        """Decoded parts of the gzip member at `at`; with the last part the position after it, else -1."""
        unpack = zlib.decompressobj(31)
        while True:
            if at >= self.base + len(self.data) and not self.more():
                raise zlib.error("the file ends inside a member")
            data = self.data[at - self.base : at - self.base + piece]
            at += len(data)
            part = unpack.decompress(data)
            yield part, at - len(unpack.unused_data) if unpack.eof else -1
            if unpack.eof:
                return


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:]) if v}


def _named(uri: str | None) -> str | None:
    """A page's key, or any other record's whole identifier."""
    return unquote(uri.removeprefix("<").removesuffix(">").removeprefix("urn:page:")) if uri else None


class DamagedArchive(ValueError):
    """An archive that does not hold what its manifest or its record headers say."""


def _starts_record(source: _Range, at: int) -> bool:
    """Whether a gzip member that begins like a WARC record starts at `at`."""
    head = b""
    try:
        for part, _ in source.member(at, 1 << 10):
            head += part
            if len(head) >= 5:
                break
    except zlib.error:
        return False
    return head.startswith(b"WARC/")


def _record(source: _Range, at: int, with_payload: bool) -> tuple[tuple, int]:
    """The record whose first bytes were found at `at`, and the position after it."""
    head, payload, end, warc, length = b"", [], -1, None, 0
    http, sha, n = None, hashlib.sha1(), 0
    try:
        for part, end in source.member(at):
            if http is None:
                head += part
                if warc is None and (cut := head.find(b"\r\n\r\n")) >= 0:
                    warc = _headers(head[:cut])
                    length, head = int(warc["content-length"]), head[cut + 4 :]
                if warc is None:
                    continue
                if "application/http" not in warc.get("content-type", ""):
                    http, part, head = {}, head, b""
                elif (cut := head.find(b"\r\n\r\n")) >= 0:
                    http, part, head = _headers(head[:cut]), head[cut + 4 :], b""
                    length -= cut + 4
                else:
                    continue
            part = part[: max(0, length - n)]
            n += len(part)
            sha.update(part)
            if with_payload:
                payload.append(part)
    except (zlib.error, KeyError, ValueError) as error:
        raise DamagedArchive(f"the record at byte {at} is damaged: {error}") from error
    if http is None or n != length:
        raise DamagedArchive(f"the record at byte {at} ends before its block does")
    kind = warc.get("warc-type")
    digest = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit":
        found = base64.b32encode(sha.digest()).decode()
        if digest and digest != found:
            raise DamagedArchive(f"payload of {warc.get('warc-record-id')} has digest {found}, its header says {digest}")
        digest = found
    else:
        n = int(http.get("content-length", 0))
    row = (
        _named(warc.get("warc-record-id")), kind, unquote(warc["warc-target-uri"]) if "warc-target-uri" in warc else None,
        _named(warc.get("warc-refers-to")), n, digest, b"".join(payload) if with_payload and kind != "revisit" else None,
    )
    return row, end


def read_archives(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the files listed in `files` (path, n_bytes): page_id (text), record_type, url, refers_to (text),
    payload_bytes, payload_digest and payload, which is null for revisits. A record without an HTTP block, such as warcinfo,
    has its whole block as payload and its record id as page_id.

    A digest is computed from what was read and must equal its header's. Records follow each other without a gap from a
    file's first byte to its last: a file of another size than stated, a member that breaks off, and bytes between records
    that are none raise DamagedArchive. A task reads about `split_bytes` and the record that crosses their end. Splits are
    dealt evenly over as many tasks, a number that adaptive execution leaves as it is.
    """
    n_splits = F.expr(f"n_bytes div {split_bytes} + 1")
    tasks = files.agg(F.coalesce(F.sum(n_splits), F.lit(1))).first()[0]
    last = F.greatest(F.col("n_bytes") - 1, F.lit(0).cast("long"))
    splits = files.select(
        "path", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(split_bytes).cast("long"))).alias("at")
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, at in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                store, name = open_folder(path)
                found = store.get_file_info(name).size
                if found != size:
                    raise DamagedArchive(f"{path} has {found} bytes, not {size}")
                with store.open_input_file(name) as stream:
                    yield from _blocks(_owned(_Range(stream, at), at, min(size, at + split_bytes), size, with_payload))

    return splits.repartition(min(max(1, tasks), MOST_TASKS)).mapInArrow(
        read, "page_id string, record_type string, url string, refers_to string, payload_bytes long, "
        "payload_digest string, payload binary",
    )


def _owned(source: _Range, at: int, end: int, size: int, with_payload: bool) -> Iterator[tuple]:
    """Records that start in at..end. Where the range before ends its last record is not known here, so bytes before the
    first record are passed over: that range sees to it that a record starts where its own last one ends."""
    joined = at == 0
    while at < size if joined else (at := source.find(GZIP_MAGIC, at, end)) >= 0:
        if not _starts_record(source, at):
            if joined:
                raise DamagedArchive(f"no record starts at byte {at}, where the one before ends")
            at += 1
            continue
        if at >= end:
            return
        row, at = _record(source, at, with_payload)
        joined = True
        yield row
        source.forget(at)


def _blocks(rows: Iterator[tuple], size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_type", "url", "refers_to", "payload_bytes", "payload_digest", "payload"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    block, weight = [], 0
    for row in rows:
        block.append(row)
        weight += 200 + len(row[-1] or b"")
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names)
            block, weight = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), types)], names)
