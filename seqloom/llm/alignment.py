"""Alignment of two tokenizers by inverted pair bitmaps.

Tokens of A and B that cover a common byte are linked. For every pair of ids an inverted list says which documents link it:
a compressed bitmap (a summary word that names the 64-document words that are not empty, and these words) and, for how often a
document does, multiplicity planes: plane k has, for each document of the bitmap in order, bit k of its links less one.

Map tasks number their documents in shards of SHARD_DOCS and OR a shard's documents into one bitmap for each pair. Shards
hold different documents, so a pair's document count is the sum of its bitmaps' popcounts. The counts go back to the
postings, and every shard's postings return their scores to its documents.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import byte_rows
from seqloom.session import cut_lineage

SHARD_DOCS = 4096
# Links of one shard's documents before they are merged, and bytes of text that are aligned at once.
SHARD_LINKS = 1 << 22
BLOCK_BYTES = 1 << 18
PART_BYTES = 1 << 20

# A place to cut a long text; a space at its very end would be no text of its own for B.
_CUT = re.compile(rb"(?s)[!-~](?= .)")

_DOC = "shard long, local int, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTING = "a int, b int, n_docs int, summary long, words binary, planes binary"
_DOC_NAMES = ["shard", "local", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_POSTING_NAMES = ["a", "b", "n_docs", "summary", "words", "planes"]


class TokenPair:
    """Ids of a space and a text by a byte-level BPE file (A), and of the text by a piece model that adds the space (B).

    A text of more than `part_bytes` is encoded in parts, cut between a printable ASCII character and a space: A's pattern
    has no alternative in which a space follows anything but white space, and no piece of B holds a space after another
    character, so no token crosses such a place.
    """

    def __init__(self, byte_path: str, piece_path: str, pattern: str, part_bytes: int = PART_BYTES):
        import sentencepiece
        import tiktoken

        with open(byte_path, encoding="utf-8") as file:
            described = json.load(file)
        byte_of = {}
        hidden = 256
        for b in range(256):  # the byte-level alphabet: bytes that do not print move beyond 255
            if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
                byte_of[chr(b)] = b
            else:
                byte_of[chr(hidden)] = b
                hidden += 1
        special = {token["id"] for token in described["added_tokens"]}
        ranks = {
            bytes(byte_of[c] for c in token): number
            for token, number in described["model"]["vocab"].items() if number not in special
        }
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for data, number in ranks.items():
            self.a_bytes[number] = data
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.b.id_to_piece(n) for n in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(piece[3:5], 16)]) if self.b.is_byte(n) else piece.replace("▁", " ").encode()
            for n, piece in enumerate(pieces)
        ]
        if any(" " in data.decode("utf-8", "replace").lstrip(" ") for n, data in enumerate(self.b_bytes) if not self.b.is_byte(n)):
            raise ValueError("the piece model joins a space to what is before it, so texts cannot be parted")
        self.a_lengths = np.array([len(data) for data in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(data) for data in self.b_bytes], np.int64)
        self.size = max(len(self.a_bytes), len(self.b_bytes))
        if self.size > 1 << 16:
            raise ValueError("ids above 65535 do not fit into a pair's key")
        self.written = [b"%d%c" % (n, end) for end in b",|;" for n in range(self.size)]
        self.part_bytes = part_bytes

    def parts(self, text: bytes) -> list[tuple[list[int], list[int], int]] | None:
        """A's ids, B's ids and bytes of successive parts; None if there are none, or their bytes are not the text's."""
        if not text:
            return None
        data, found = b" " + text, []
        while data:
            cut = _CUT.search(data, self.part_bytes) if len(data) > self.part_bytes else None
            part, data = (data[: cut.start() + 1], data[cut.start() + 1 :]) if cut else (data, b"")
            shown = part.decode("utf-8", "replace")
            a, b = self.a.encode_ordinary(shown), self.b.encode(shown[1:], num_threads=1)
            if b"".join(map(self.a_bytes.__getitem__, a)) != part or b"".join(map(self.b_bytes.__getitem__, b)) != part:
                return None
            found.append((a, b, len(part)))
        return found


class _Shard:
    """Documents of one shard: their digests and counts, and links by (pair, document)."""

    def __init__(self, pair: TokenPair, number: int, block_bytes: int):
        self.pair, self.number, self.block_bytes = pair, number, block_bytes
        self.rows: list[list] = []
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.links = 0
        self._clear()

    def _clear(self) -> None:
        self.a, self.b, self.owners, self.waiting = [], [], [], 0

    def document(self, doc_id, text: bytes) -> None:
        local = len(self.rows)
        self.rows.append([doc_id, 0, 0, 0, 0, None])
        parts = self.pair.parts(text)
        if parts is None:
            return
        self.rows[local][-1] = hashlib.sha256()
        for a, b, size in parts:
            self.a.append(np.array(a, np.int64))
            self.b.append(np.array(b, np.int64))
            self.owners.append((local, size))
            self.waiting += size
            if self.waiting >= self.block_bytes:
                self.align()

    def align(self) -> None:
        """Align the gathered parts. Byte positions where a token of A, of B and of both end say all."""
        if not self.waiting:
            return
        pair = self.pair
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        end_a, end_b = np.cumsum(pair.a_lengths[a]), np.cumsum(pair.b_lengths[b])
        in_a, in_b = np.zeros(self.waiting + 1, bool), np.zeros(self.waiting + 1, bool)
        in_a[end_a] = True
        in_b[end_b] = True
        both = in_a & in_b
        ends = np.flatnonzero(in_a | in_b)
        upto_a, upto_b, upto_both = np.cumsum(in_a[ends]), np.cumsum(in_b[ends]), np.cumsum(both[ends])
        # Between two ends next to each other lies exactly one token of A and one of B: a link.
        of_a, of_b = upto_a - in_a[ends], upto_b - in_b[ends]
        bounds = np.searchsorted(ends, np.cumsum([size for _, size in self.owners]), side="right")
        counts = np.diff(np.concatenate([[0], bounds]))
        local = np.array([owner for owner, _ in self.owners])
        key = (a[of_a] << 16 | b[of_b]) << 12 | np.repeat(local, counts)
        key.sort()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.keys.append(key[starts])
        self.times.append(np.diff(np.append(starts, len(key))))
        self.links += len(key)

        common = both[ends]
        groups_a, groups_b = np.append(0, upto_a[common]), np.append(0, upto_b[common])
        closes_a, closes_b = both[end_a], both[end_b]
        group_of_a, group_of_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + groups_b[group_of_a]] = a + pair.size * closes_a
        written[np.arange(len(b)) + groups_a[group_of_b + 1]] = b + 2 * pair.size * closes_b
        texts = list(map(pair.written.__getitem__, written.tolist()))
        before = (0, 0, 0, 0)
        for (owner, _), bound in zip(self.owners, bounds.tolist()):
            now = (int(upto_a[bound - 1]), int(upto_b[bound - 1]), int(upto_both[bound - 1]), bound)
            row = self.rows[owner]
            if row[1]:
                row[-1].update(b";")
            row[-1].update(b"".join(texts[before[0] + before[1] : now[0] + now[1]])[:-1])
            for n in range(4):
                row[n + 1] += now[n] - before[n]
            before = now
        self._clear()

    def postings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pair, document and times of every posting, in order; blocks are merged."""
        if not self.keys:
            return tuple(np.empty(0, np.int64) for _ in range(3))
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        order = np.argsort(key, kind="stable")
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[starts] >> 12, key[starts] & 4095, np.add.reduceat(times, starts)

    def batches(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """The shard's documents, then its postings."""
        self.align()
        if not self.rows:
            return
        digests = ["" if row[-1] is None else row[-1].hexdigest() for row in self.rows]
        columns = list(zip(*self.rows))
        n = len(self.rows)
        docs = [
            pa.array([self.number] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(columns[0], id_type),
            *[pa.array(column, pa.int64()) for column in columns[1:5]], pa.array(digests, pa.string()),
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*docs, *[pa.nulls(n, kind) for kind in kinds]], _DOC_NAMES + _POSTING_NAMES)
        pairs, members, times = self.postings()
        if not len(pairs):
            return
        posting = encode_postings(pairs, members, times)
        n = len(posting[0])
        kinds = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        shard = [pa.array(np.full(n, self.number, np.int64)), *[pa.nulls(n, kind) for kind in kinds]]
        yield pa.RecordBatch.from_arrays([*shard, *posting], _DOC_NAMES + _POSTING_NAMES)


def encode_postings(pairs: np.ndarray, members: np.ndarray, times: np.ndarray) -> list[pa.Array]:
    """a, b, n_docs, summary, words and planes of each pair, from postings in the order of pair and document."""
    new_pair = np.concatenate([[True], pairs[1:] != pairs[:-1]])
    first = np.flatnonzero(new_pair)
    row = np.cumsum(new_pair) - 1
    n_docs = np.diff(np.append(first, len(pairs)))
    # Documents into words, words into the summary: both by OR.
    word = members >> 6
    new_word = new_pair | np.concatenate([[True], word[1:] != word[:-1]])
    word_first = np.flatnonzero(new_word)
    words = np.bitwise_or.reduceat(np.uint64(1) << (members & 63).astype(np.uint64), word_first)
    summary = np.bitwise_or.reduceat(np.uint64(1) << word[word_first].astype(np.uint64), np.flatnonzero(new_pair[word_first]))
    word_ends = np.cumsum(np.bitwise_count(summary).astype(np.int64))
    # Planes: each takes n_docs bits, filled up to whole bytes.
    more = times - 1
    most = np.maximum.reduceat(more, first)
    n_planes = np.zeros(len(first), np.int64)
    while (over := (most >> n_planes) > 0).any():
        n_planes += over
    plane_bytes = (n_docs + 7) >> 3
    plane_ends = np.cumsum(n_planes * plane_bytes)
    starts = plane_ends - n_planes * plane_bytes
    rank = np.arange(len(pairs)) - first[row]
    bits = np.zeros(8 * int(plane_ends[-1]), bool)
    for plane in range(int(n_planes.max())):
        at = np.flatnonzero(n_planes[row] > plane)
        r = row[at]
        bits[8 * (starts[r] + plane * plane_bytes[r]) + rank[at]] = (more[at] >> plane) & 1
    planes = np.packbits(bits, bitorder="little")
    which = pairs[first]
    return [
        pa.array((which >> 16).astype(np.int32)), pa.array((which & 0xFFFF).astype(np.int32)), pa.array(n_docs.astype(np.int32)),
        pa.array(summary.view(np.int64)), _binary(words.view(np.uint8), 8 * word_ends), _binary(planes, plane_ends),
    ]


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def decode_postings(n_docs: np.ndarray, summary: np.ndarray, words: np.ndarray, planes: np.ndarray, plane_starts: np.ndarray):
    """Row, document and times of every posting of the given rows; `plane_starts` has one entry more than there are rows."""
    per_row = np.bitwise_count(summary.view(np.uint64)).astype(np.int64)
    shown = np.unpackbits(summary.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word = np.nonzero(shown)[1]
    row_of_word = np.repeat(np.arange(len(summary)), per_row)
    at, bit = np.nonzero(np.unpackbits(words.reshape(-1, 8), axis=1, bitorder="little"))
    row, member = row_of_word[at], word[at] * 64 + bit
    first = np.cumsum(n_docs) - n_docs
    rank = np.arange(len(row)) - first[row]
    plane_bytes = (n_docs + 7) >> 3
    n_planes = np.diff(plane_starts) // plane_bytes
    bits = np.unpackbits(planes, bitorder="little")
    times = np.ones(len(row), np.int64)
    for plane in range(int(n_planes.max(initial=0))):
        at = np.flatnonzero(n_planes[row] > plane)
        r = row[at]
        times[at] += bits[8 * (plane_starts[r] + plane * plane_bytes[r]) + rank[at]].astype(np.int64) << plane
    return row, member, times


def pair_postings(
    docs: DataFrame, pair: Callable[[], TokenPair], key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS,
    shard_links: int = SHARD_LINKS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows of documents (columns of postings are null) and of postings (columns of documents but `shard` are null).

    A shard is `shard_docs` documents of a map task, fewer if they have more than `shard_links` links, so that a task holds a
    bounded number of them. A document of any length is aligned block by block.
    """
    if not 0 < shard_docs <= SHARD_DOCS:
        raise ValueError(f"a shard holds 1 to {SHARD_DOCS} documents")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, number, kind = pair(), TaskContext.get().partitionId() << 32, pa.int64()
        shard = _Shard(tokens, number, block_bytes)
        for batch in batches:
            kind = batch.column(0).type
            flat, offsets = byte_rows(batch.column(1))
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                shard.document(doc_id, flat[offsets[n] : offsets[n + 1]].tobytes())
                if len(shard.rows) == shard_docs or shard.links > shard_links:
                    yield from shard.batches(kind)
                    number += 1
                    shard = _Shard(tokens, number, block_bytes)
        yield from shard.batches(kind)

    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(build, f"{_DOC.format(id=id_type)}, {_POSTING}")


def pair_counts(postings: DataFrame) -> DataFrame:
    """a, b, count (documents that link the pair) and best, whether no other pair of its A id has a higher count."""
    counts = cut_lineage(postings.groupBy("a", "b").agg(F.sum("n_docs").alias("count")))
    highest = counts.groupBy(F.col("a").alias("of")).agg(F.max("count").alias("highest"))
    joined = counts.join(highest, F.col("a") == F.col("of"))
    return joined.select(F.col("a").alias("c_a"), F.col("b").alias("c_b"), "count", (F.col("count") == F.col("highest")).alias("best"))


def align(
    docs: DataFrame, pair: Callable[[], TokenPair], key: str = "doc_id", text: str = "text", **options: int
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    `pair()` makes the tokenizers inside each task. Byte positions where tokens of A and of B both end cut a document's
    tokens into groups; links are the pairs of token occurrences that share a byte. A pair of ids counts the documents, of
    the whole table, that link it. `n_best` counts links whose pair has the highest count of its A id, ties included, and
    `count_sum` adds the counts of all links. `groups_sha256` is the digest of the ids, written `a,a|b;a|b,b`.

    A text that is null or empty, or whose tokens do not give its bytes, has zeros, an empty digest and no links. Rows with
    equal or null keys are documents of their own, and repeated rows each count. Other columns are not read. A pair that all
    documents link has one short row for each shard, in tasks of its own count; no task holds more than a shard.
    """
    stored = cut_lineage(pair_postings(docs, pair, key, text, **options))
    postings = stored.filter("a is not null").select("shard", "a", "b", "n_docs")
    # Merged at any size, as the counts grow with the corpus. Only keys go through the join; bitmaps stay with their shard.
    counts = cut_lineage(pair_counts(postings)).hint("merge")
    scored = postings.join(counts, (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b"))).select(
        F.col("shard").alias("of_shard"), "c_a", "c_b", "count", "best"
    )
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def returned(left: pa.Table, right: pa.Table) -> pa.Table:
        is_doc = pc.is_null(left.column("a"))
        rows, lists = left.filter(is_doc), left.filter(pc.invert(is_doc))
        best, total = np.zeros(rows.num_rows, np.int64), np.zeros(rows.num_rows, np.int64)
        known = _pair_keys(right, "c_a", "c_b")
        order = np.argsort(known)
        known, count, is_best = (column[order] for column in (known, _numbers(right, "count"), _numbers(right, "best")))
        for part in lists.to_batches(max_chunksize=1 << 14):
            at = np.searchsorted(known, _pair_keys(part, "a", "b"))
            words, _ = byte_rows(part.column("words"))
            planes, plane_starts = byte_rows(part.column("planes"))
            row, member, times = decode_postings(
                _numbers(part, "n_docs").astype(np.int64), np.ascontiguousarray(_numbers(part, "summary")), words, planes, plane_starts
            )
            np.add.at(total, member, times * count[at][row])
            np.add.at(best, member, times * is_best[at][row])
        local = _numbers(rows, "local")
        found = {"n_best": pa.array(best[local]), "count_sum": pa.array(total[local])}
        return pa.table([found.get(name, rows.column(name) if name in rows.column_names else None) for name in names], names)

    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, " + ", ".join(
        f"{name} {'string' if name == 'groups_sha256' else 'long'}" for name in names[1:]
    )
    return stored.groupBy("shard").cogroup(scored.groupBy("of_shard")).applyInArrow(returned, schema)


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(name).to_numpy()


def _pair_keys(rows: pa.Table | pa.RecordBatch, a: str, b: str) -> np.ndarray:
    return _numbers(rows, a).astype(np.int64) << 16 | _numbers(rows, b).astype(np.int64)


@lru_cache(maxsize=1)
def _pair(byte_path: str, piece_path: str, pattern: str) -> TokenPair:
    return TokenPair(byte_path, piece_path, pattern)


def token_pair(byte_path: str, piece_path: str, pattern: str) -> Callable[[], TokenPair]:
    """A factory of token pairs for files that every node must have. A Python worker keeps its own from task to task."""
    return lambda: _pair(byte_path, piece_path, pattern)
