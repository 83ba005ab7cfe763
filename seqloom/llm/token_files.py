"""Token-id files: frequency-ranked ids in one to four bytes each, with the lengths in control bytes of their own.

A folder holds `ranks.bin`, the ids from the most to the least frequent as little-endian unsigned 32-bit numbers, and files
of segments. An id is stored as its rank, so the 256 most frequent ids take one byte. A segment holds up to SEGMENT_IDS ids:

    header        six little-endian unsigned 32-bit numbers: MAGIC, documents, ids, bytes of keys, bytes of data, open
    lengths       for each document how many of its ids the segment holds, unsigned 32-bit
    key lengths   signed 32-bit; -1 for a null key, -2 for a document that the segment before began
    keys          UTF-8
    control       two bits an id, lowest first: how many bytes its rank takes, less one
    data          the ranks' bytes, lowest first

`open` is 1 if the last document goes on in the next segment, which is in the same file. Four ids share a control byte, and a
table of 256 entries gives the lengths of the four, so a reader decodes a segment without a loop over ids.

Documents are dealt out by ranges of their key and encoded in order, first with the ids themselves as ranks. The tasks that
write these files count the ids, and a pass over them writes the files anew by frequency.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import byte_rows, open_folder, text_or_empty
from seqloom.session import cut_lineage

MAGIC = 0x53474944
SEGMENT_IDS = 1 << 16
FILE_BYTES = 16 << 20
END = 1
RANKS = "ranks.bin"
# Reading tasks in one job; further files share them.
MOST_TASKS = 100_000

_HEADER = struct.Struct("<6I")
_NULL, _GOES_ON = -1, -2
_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)

MANIFEST = "path string, part int, number int, n_bytes long, n_docs long, n_ids long"
COUNTS = "id long, count long"


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    more = (ranks > 0xFF).astype(np.uint8)
    more += ranks > 0xFFFF
    more += ranks > 0xFFFFFF
    quads = np.zeros((-(-len(ranks) // 4), 4), np.uint8)
    quads.reshape(-1)[: len(ranks)] = more
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= more[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The `count` ranks that `encode_ranks` turned into these bytes."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.frombuffer(data, np.uint8)
    ranks = padded[at].astype("<u4")
    for byte in (1, 2, 3):
        longer = np.flatnonzero(lengths > byte)
        if not len(longer):
            break
        ranks[longer] |= padded[at[longer] + byte].astype("<u4") << (8 * byte)
    return ranks


class _Writer:
    """Files of one task. `done` lists what was written: path, number, bytes, documents, ids."""

    def __init__(self, folder: str, file_bytes: int, segment_ids: int, rank_of: np.ndarray | None = None):
        self.store, self.root = open_folder(folder)
        self.store.create_dir(self.root, recursive=True)
        self.folder, self.file_bytes, self.segment_ids, self.rank_of = folder.rstrip("/"), file_bytes, segment_ids, rank_of
        self.out, self.done, self.counts = None, [], np.zeros(0, np.int64)
        self._empty()

    def _empty(self) -> None:
        self.ids, self.lengths, self.keys, self.key_lengths, self.held = [], [], [], [], 0

    def document(self, key: str | None, ids: np.ndarray) -> None:
        self.begin(key)
        self.add(ids)
        self.end()

    def begin(self, key: str | None) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.ids"
            self.out = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None)
            self.written = self.n_docs = self.n_ids = 0
        data = b"" if key is None else key.encode()
        self.keys.append(data)
        self.key_lengths.append(_NULL if key is None else len(data))
        self.lengths.append(0)

    def add(self, ids: np.ndarray) -> None:
        """Further ids of the document that was begun."""
        while len(ids):
            if self.held == self.segment_ids:
                self._segment(True)
                self.lengths.append(0)
                self.keys.append(b"")
                self.key_lengths.append(_GOES_ON)
            piece = ids[: self.segment_ids - self.held]
            self.ids.append(piece)
            self.lengths[-1] += len(piece)
            self.held += len(piece)
            ids = ids[len(piece) :]

    def end(self) -> None:
        self.n_docs += 1
        if self.held == self.segment_ids:
            self._segment(False)
        if self.written >= self.file_bytes:
            self.close()

    def _segment(self, goes_on: bool) -> None:
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.uint32)
        if self.rank_of is None:
            found = np.bincount(ids, minlength=len(self.counts))
            found[: len(self.counts)] += self.counts
            self.counts = found
        control, data = encode_ranks(ids if self.rank_of is None else self.rank_of[ids])
        keys = b"".join(self.keys)
        parts = (
            _HEADER.pack(MAGIC, len(self.lengths), len(ids), len(keys), len(data), goes_on),
            np.array(self.lengths, "<u4").tobytes(), np.array(self.key_lengths, "<i4").tobytes(), keys, control, data,
        )
        for part in parts:
            self.out.write(part)
            self.written += len(part)
        self.n_ids += len(ids)
        self._empty()

    def close(self) -> None:
        if self.out is None:
            return
        if self.lengths:
            self._segment(False)
        self.out.close()
        self.done.append((f"{self.folder}/{self.name}", len(self.done), self.written, self.n_docs, self.n_ids))
        self.out = None

    def manifest(self, part: int) -> pa.RecordBatch:
        self.close()
        rows = [(path, part, *rest) for path, *rest in self.done]
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["path", "part", "number", "n_bytes", "n_docs", "n_ids"]
        return pa.RecordBatch.from_arrays([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)], names)


def _segments(path: str, n_bytes: int, id_of: np.ndarray | None) -> Iterator[tuple[list[tuple[bool, str | None, int]], np.ndarray]]:
    """Segments of a file: for each document whether it begins here, its key and how many of the segment's ids it has; the ids."""
    store, name = open_folder(path)
    with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as stream:
        left = n_bytes
        while left:
            header = stream.read(_HEADER.size)
            if len(header) < _HEADER.size:
                raise ValueError(f"{path} ends {left} bytes early")
            magic, n_docs, n_ids, key_bytes, data_bytes, _ = _HEADER.unpack(header)
            size = 8 * n_docs + key_bytes + -(-n_ids // 4) + data_bytes
            left -= _HEADER.size + size
            body = stream.read(size) if magic == MAGIC else b""
            if magic != MAGIC or left < 0 or len(body) < size:
                raise ValueError(f"{path} has a damaged segment")
            lengths = np.frombuffer(body, "<u4", n_docs).tolist()
            key_lengths = np.frombuffer(body, "<i4", n_docs, 4 * n_docs).tolist()
            at, docs = 8 * n_docs, []
            for length, key_length in zip(lengths, key_lengths):
                key = None if key_length == _NULL else body[at : at + max(key_length, 0)].decode()
                at += max(key_length, 0)
                docs.append((key_length != _GOES_ON, key, length))
            control = at + -(-n_ids // 4)
            ranks = decode_ranks(body[at:control], body[control:], n_ids)
            yield docs, ranks if id_of is None else id_of[ranks]
        if stream.read(1):
            raise ValueError(f"{path} is longer than its manifest says")


def _dealt(files: DataFrame) -> DataFrame:
    """The files one by one over tasks of that number, which adaptive execution leaves as it is."""
    return files.repartition(max(1, min(files.count(), MOST_TASKS)))


def _ranks(folder: str) -> np.ndarray:
    store, root = open_folder(folder)
    with store.open_input_stream(f"{root}/{RANKS}", compression=None) as stream:
        return np.frombuffer(stream.read(), "<u4")


def write_plain(
    docs: DataFrame, encoder: Callable[[], Callable[[bytes], np.ndarray]], folder: str, key: str = "doc_id",
    text: str = "text", end: int = END, file_bytes: int = FILE_BYTES, segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Encode `docs` in ascending order of `key` into files whose ranks are the ids themselves; the manifest, see MANIFEST,
    and with a null path the tasks' counts of ids, see COUNTS.

    Ranges are cut by key, then by a hash of the text and a number of the row, so rows that share a key may lie in several
    files. Part numbers are in the order of the ranges.
    """
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    order = ["doc_id", "hash", "row"]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("doc_id").cast("string"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, writer = encoder(), _Writer(folder, file_bytes, segment_ids)
        for batch in batches:
            flat, offsets = byte_rows(batch.column(1))
            data = flat.tobytes()
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                writer.document(doc_id, np.append(encode(data[offsets[n] : offsets[n + 1]]), np.uint32(end)))
        manifest = writer.manifest(TaskContext.get().partitionId())
        seen = np.flatnonzero(writer.counts)
        kinds = [(name, manifest.schema.field(name).type) for name in manifest.schema.names]
        yield manifest.append_column("id", pa.nulls(manifest.num_rows, pa.int64())).append_column("count", pa.nulls(manifest.num_rows, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*[pa.nulls(len(seen), kind) for _, kind in kinds], pa.array(seen), pa.array(writer.counts[seen])],
            [*[name for name, _ in kinds], "id", "count"],
        )

    return placed.mapInArrow(write, f"{MANIFEST}, {COUNTS}")


def write_ranked(plain: DataFrame, folder: str, file_bytes: int = FILE_BYTES, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Write the files that `plain`, the stored result of `write_plain`, lists anew in `folder`, by frequency; the manifest,
    whose order is the same.

    `ranks.bin` goes through the driver: a number for each id that occurs, so at most the tokenizer's vocabulary. Equally
    frequent ids go by the id.
    """
    files = plain.filter("path is not null").drop("id", "count")
    counts = plain.filter("path is null").groupBy("id").agg(F.sum("count").alias("count"))
    counts = counts.orderBy(F.desc("count"), "id").select("id").toPandas()["id"].to_numpy(np.int64)
    store, root = open_folder(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{RANKS}", compression=None) as stream:
        stream.write(counts.astype("<u4").tobytes())

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = _ranks(folder)
        rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
        rank_of[id_of] = np.arange(len(id_of), dtype=np.uint32)
        for batch in batches:
            for path, n_bytes, part, number in zip(*[batch.column(i).to_pylist() for i in ("path", "n_bytes", "part", "number")]):
                writer, inside = _Writer(folder, 1 << 62, segment_ids, rank_of), False
                for docs, ids in _segments(path, n_bytes, None):
                    at = 0
                    for begins, key, length in docs:
                        if begins:
                            if inside:
                                writer.end()
                            writer.begin(key)
                            inside = True
                        writer.add(ids[at : at + length])
                        at += length
                if inside:
                    writer.end()
                made = writer.manifest(part)
                yield made.set_column(2, "number", pa.array([number] * made.num_rows, pa.int32()))

    return _dealt(files).mapInArrow(rewrite, MANIFEST)


def write_token_files(
    docs: DataFrame, encoder: Callable[[], Callable[[bytes], np.ndarray]], folder: str, key: str = "doc_id",
    text: str = "text", end: int = END, file_bytes: int = FILE_BYTES, segment_ids: int = SEGMENT_IDS,
) -> DataFrame:
    """Write the ids of all documents, each closed by `end`, below `folder`; the stored manifest, see MANIFEST.

    `encoder()` makes the text-to-ids function inside each task. Documents lie in ascending order of their key: by part,
    then by number, then inside the file; null keys come first, rows with equal keys go by a hash of their text. Null or
    empty text is `end` alone. Repeated rows are documents of their own. No rows give no files. A document of any length
    is cut into segments and stays in its file. Every attempt of a task writes files of its own, and only those of the
    attempt that Spark accepts are in the manifest, which is stored before it is read. Keys of any type that Spark turns into
    text and back are held as text.
    """
    folder = folder.rstrip("/")
    plain = cut_lineage(write_plain(docs, encoder, f"{folder}/plain", key, text, end, file_bytes, segment_ids))
    ranked = cut_lineage(write_ranked(plain, folder, file_bytes, segment_ids))
    store, root = open_folder(folder)
    if not ranked.isEmpty():
        store.delete_dir(f"{root}/plain")
    return ranked


def read_token_files(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files in the manifest `files`: doc_id (text), start (ids of all documents before it),
    n_tokens, ids_crc32 (unsigned, over the ids as little-endian unsigned 32-bit numbers) and, if wanted, these ids.

    A file whose size, documents or ids differ from the manifest stops the job. A task reads whole files, a segment at a
    time, and holds one document's ids only where they are wanted. Starts come from a running sum over one row per file.
    """
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_of = _ranks(folder)
        for batch in batches:
            names = ("path", "n_bytes", "n_docs", "n_ids", "start")
            for path, n_bytes, n_docs, n_ids, start in zip(*[batch.column(name).to_pylist() for name in names]):
                yield from _documents(path, n_bytes, n_docs, n_ids, start, id_of, with_ids)

    return _dealt(placed).mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def _documents(path, n_bytes, n_docs, n_ids, start, id_of, with_ids) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    rows: list[tuple] = []
    seen_docs = seen_ids = weight = count = crc = 0
    key, held, inside = None, [], False

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows), types)], names)

    def closed() -> tuple:
        return (key, start + seen_ids - count, count, crc, *[b"".join(held)] * with_ids)

    for docs, ids in _segments(path, n_bytes, id_of):
        data, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B") if len(ids) else b"", 0
        for begins, name, length in docs:
            if begins:
                if inside:
                    rows.append(closed())
                key, held, count, crc, inside = name, [], 0, 0, True
                seen_docs += 1
            piece = data[4 * at : 4 * (at + length)]
            crc = zlib.crc32(piece, crc)
            if with_ids:
                held.append(bytes(piece))
                weight += len(piece)
            count, seen_ids, at = count + length, seen_ids + length, at + length
        if len(rows) >= 4096 or weight >= 1 << 22:
            if rows:
                yield batch()
            rows, weight = [], 0
    if inside:
        rows.append(closed())
    if rows:
        yield batch()
    if (seen_docs, seen_ids) != (n_docs, n_ids):
        raise ValueError(f"{path} holds {seen_docs} documents and {seen_ids} ids; its manifest says {n_docs} and {n_ids}")
