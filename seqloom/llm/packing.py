"""Token sequences by bounded-space online packing.

Each partition keeps a fixed number of open windows. A piece goes to the fullest window that still holds it. If none does,
a window is opened; if all are open, the fullest is emitted first. What is still open when a partition ends is merged:
level by level, tasks pack the leftovers of many partitions in the same way, until one small task packs the rest.
"""

from __future__ import annotations

import math
import os
import re
import string
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import byte_rows, text_or_empty
from seqloom.session import cut_lineage

WINDOW = 2048
OPEN_WINDOWS = 64
MAX_PADDING = 16
END = 1
# Of a worker's memory, for words and their ids; WORD_OVERHEAD is what Python takes besides the bytes of both.
CACHED_BYTES = 48 << 20
WORD_OVERHEAD = 160
MERGED_WINDOWS = 1024

_MARKS = string.punctuation.encode()
_LATIN = re.compile("[A-Za-z\u00c0-\u012f\u0131-\u024f]+")

SCHEMA = (
    "doc_id {id}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
)
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]


class WordEncoder:
    """Token ids of texts, with the ids of words remembered in at most about `cached_bytes`.

    Only for tokenizers that drop white space and never join what it parts, as word-level BPE does: a text's ids are then
    those of its words, one after the other. Words are split at ASCII white space; others stay inside for the tokenizer.

    Words of Latin letters, with ASCII punctuation after them at most, skip the tokenizer's clean-up: there it could only
    lower their case and part the punctuation, and their ids come from its model. Probes decide whether the tokenizer works
    that way.
    """

    PROBES = ("The", "quick,", "brÜn.", "é!", "x", "ñandú;", "straße:", "Ab?", "don'", "a,&&&", "b__-'\"")

    def __init__(self, path: str, cached_bytes: int = CACHED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        shown = [chr(b) for b in range(256)]
        hidden = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)]
        for number, b in enumerate(hidden):  # the byte-level alphabet: bytes that do not print move beyond 255
            shown[b] = chr(256 + number)
        spelled = {shown_as: b for b, shown_as in enumerate(shown)}
        # The model again, with a NUL for a word's end: faster, and equal for words of letters, which hold no NUL.
        ranks = {}
        for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if not token.startswith("<|"):
                ranks[bytes(spelled.get(c, 0) for c in token.removesuffix("</w>")) + b"\0" * token.endswith("</w>")] = number
        self.model = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.lower_case = self._tokenized("THE QUICK fox") == self._tokenized("the quick fox")
        # Ids of words as bytes. Once half of the allowed bytes are taken, the newer words become the older ones, which stay
        # until the newer take as much again; an older word that comes back is a newer one again.
        self.words, self.older, self.held, self.cached_bytes = {}, {}, 0, cached_bytes
        self.marks: dict[bytes, bytes] = {}
        self.direct = self.lower_case and all(self._model_ids(word.encode()) == _packed(self._tokenized(word)) for word in self.PROBES)

    def _tokenized(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _model_ids(self, word: bytes) -> bytes | None:
        """Ids of Latin letters and the punctuation after them; None for any other word."""
        letters = word.rstrip(_MARKS)
        if letters.isalpha():  # of bytes: ASCII letters
            text = letters.decode()
        elif not _LATIN.fullmatch(text := letters.decode("utf-8", "replace")) or not text.isalpha():
            return None
        mark = word[len(letters) :]
        ids = self.words.get(letters) if mark else None
        if ids is None:
            ids = _packed(self.model.encode_ordinary(text.lower() + "\0"))
        if not mark:
            return ids
        if mark not in self.marks:
            self.marks[mark] = _packed(self._tokenized(mark.decode()))
        return ids + self.marks[mark]

    def _learn(self, words: set[bytes]) -> None:
        """Take up words that are not among the newer ones."""
        if 2 * self.held > self.cached_bytes:
            self.words, self.older, self.held, self.marks = {}, self.words, 0, {}
        found, others = {}, []
        for word in words:
            ids = self.older.get(word) or (self._model_ids(word) if self.direct else None)
            if ids is None:
                others.append(word)
            else:
                found[word] = ids
        texts = [word.decode("utf-8", "replace") for word in others]
        for word, encoded in zip(others, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []):
            found[word] = _packed(encoded.ids)
        self.words |= found
        self.held += WORD_OVERHEAD * len(found) + sum(map(len, found)) + sum(map(len, found.values()))

    def encode(self, text: bytes) -> np.ndarray:
        # Special tokens keep their case, and some letters compose with a mark after them only in lower case, so what the
        # tokenizer composes before it lowers cannot be lowered here.
        if self.lower_case and text.isascii() and b"<|" not in text:
            text = text.lower()
        words = text.split()
        if new := set(words).difference(self.words):
            self._learn(new.union(words) if 2 * self.held > self.cached_bytes else new)
        return np.frombuffer(b"".join(map(self.words.__getitem__, words)), "<u4")


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class _Packer:
    """Open windows of one task. Emitted rows gather in `rows`."""

    def __init__(self, prefix: int, window: int, open_windows: int, max_padding: int):
        self.prefix, self.window, self.limit, self.max_padding = prefix, window, open_windows, max_padding
        self.pieces: list[list] = [[] for _ in range(open_windows)]
        self.free = np.full(open_windows, window, np.int64)
        self.used = 0
        self.count, self.rows = 0, []

    def _emit(self, pieces: list, still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.tobytes(), total, self.prefix + self.count, offset, still_open))
            offset += len(ids)
        self.count += 1

    def document(self, doc_id, ids: np.ndarray) -> None:
        """Whole windows leave at once, the rest is packed."""
        whole = len(ids) - len(ids) % self.window
        for start in range(0, whole, self.window):
            self._emit([(doc_id, start, ids[start : start + self.window], len(ids))])
        if whole < len(ids):
            self.piece(doc_id, whole, ids[whole:], len(ids))

    def piece(self, doc_id, start: int, ids: np.ndarray, total: int) -> None:
        while True:
            free = self.free[: self.used]
            fits = free >= len(ids)
            if fits.any():
                at = int(np.where(fits, free, self.window + 1).argmin())
                break
            if self.used < self.limit:
                at = self.used
                self.used += 1
                break
            at = int(free.argmin())
            gap = int(free[at])
            if gap > self.max_padding:
                self.pieces[at].append((doc_id, start, ids[:gap], total))
                start, ids = start + gap, ids[gap:]
            self._close(at)
        self.pieces[at].append((doc_id, start, ids, total))
        self.free[at] -= len(ids)
        if not self.free[at]:
            self._close(at)

    def _close(self, at: int) -> None:
        self._emit(self.pieces[at])
        self.pieces[at], self.free[at] = [], self.window

    def leftovers(self) -> None:
        for pieces in self.pieces[: self.used]:
            if pieces:
                self._emit(pieces, True)

    def last(self) -> None:
        """No windows follow: join what is open, cut it into whole windows and the rest into powers of two."""
        rest = [piece for pieces in self.pieces[: self.used] for piece in pieces]
        left = sum(len(piece[2]) for piece in rest)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            taken, room = [], size
            while room:
                doc_id, start, ids, total = rest[0]
                taken.append((doc_id, start, ids[:room], total))
                if len(ids) > room:
                    rest[0] = (doc_id, start + room, ids[room:], total)
                else:
                    rest.pop(0)
                room -= len(taken[-1][2])
            self._emit(taken)
            left -= size

    def batches(self, id_type: pa.DataType, least: int) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            rows, self.rows = self.rows, []
            for first in range(0, len(rows), 2048):
                part = rows[first : first + 2048]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], _NAMES)


def _prefix(level: int) -> int:
    """Sequence ids: level, task, running number."""
    from pyspark import TaskContext

    return level << 56 | TaskContext.get().partitionId() << 32


def pack(
    docs: DataFrame, encoder: Callable[[], Callable[[bytes], np.ndarray]], key: str = "doc_id", text: str = "text",
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS, max_padding: int = MAX_PADDING, end: int = END,
    merged_windows: int = MERGED_WINDOWS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its ids followed by `end`; `encoder()` makes the text-to-ids function inside each task. Documents longer
    than a window fill whole windows first. A piece that fits nowhere is cut only if the fullest window would otherwise
    be emitted with more than `max_padding` ids missing, so padding stays below max_padding / window. Of what is left in the
    end, at most one sequence for each power of two is shorter, and then has exactly that length.

    Null or empty text is `end` alone. Rows with equal or null doc_ids are documents of their own. No rows give no pieces.
    No shuffle but that of open windows, at most `open_windows` a task; a task's result is stored before leftovers are read.
    """
    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer, kind = _Packer(_prefix(0), window, open_windows, max_padding), pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            flat, offsets = byte_rows(batch.column(1))
            data = flat.tobytes()
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = encode(data[offsets[n] : offsets[n + 1]])
                packer.document(doc_id, np.append(ids, np.uint32(end)).astype("<u4"))
                yield from packer.batches(kind, 2048)
        packer.leftovers()
        yield from packer.batches(kind, 0)

    def merging(level: int, final: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packer, kind = _Packer(_prefix(level), window, open_windows, max_padding), pa.int64()
            for batch in batches:
                kind = batch.column(0).type
                columns = [batch.column(name).to_pylist() for name in ("doc_id", "start", "ids", "doc_tokens")]
                for doc_id, start, ids, total in zip(*columns):
                    packer.piece(doc_id, start, np.frombuffer(ids, "<u4"), total)
                    yield from packer.batches(kind, 2048)
            (packer.last if final else packer.leftovers)()
            yield from packer.batches(kind, 0)

        return merge

    merged_windows = max(merged_windows, 4 * open_windows)  # a level leaves a quarter of the windows at most
    schema = SCHEMA.format(id=id_type)
    stored = cut_lineage(rows.mapInArrow(first, schema))
    result, level = stored.filter("not open"), 0
    while True:
        rest = stored.filter("open")
        windows = rest.filter("offset = 0").count()
        level += 1
        groups = math.ceil(windows / merged_windows)
        # Dealt out evenly: the pieces of a window may part. Spark sorts rows first, so that a rerun deals them alike.
        dealt = rest.repartition(max(1, groups)).sortWithinPartitions("sequence_id", "offset")
        if groups <= 1:
            return result.unionByName(dealt.mapInArrow(merging(level, True), schema)).drop("open")
        stored = cut_lineage(dealt.mapInArrow(merging(level, False), schema))
        result = result.unionByName(stored.filter("not open"))


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_encoder(path: str) -> Callable[[], Callable[[bytes], np.ndarray]]:
    """A factory of encoders for the tokenizer file at `path`, which every node must have. A Python worker keeps its
    encoder from task to task, with words of CACHED_BYTES at most."""
    return lambda: _encoder(path).encode
