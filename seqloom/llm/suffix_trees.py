"""Removal of repeated word windows with suffix trees partitioned by prefixes.

The suffixes are the starts of windows that may be repeated (see repeats.py), as rows of `length` word hashes. They are
split into groups by prefixes of different lengths: a prefix that too many suffixes of a sample share is extended by a word
until its group fits in memory. A group's sorted suffixes and their common prefixes are its subtree; an internal node at
depth `length` or deeper is a window that occurs more than once. Groups that no prefix can split hold one window; they are
read in order, in blocks, so that no group needs more memory than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import repeats
from seqloom.llm.common import byte_rows, mix, word_hashes, word_spans
from seqloom.session import cut_lineage, drop_stored

LENGTH = 13
ANCHOR = 5
GROUP_ROWS = 50_000
SAMPLE_ROWS = 20_000


def word_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word of every text, and where each text's words start."""
    flat, offsets = byte_rows(column)
    starts, ends, per_row = word_spans(flat, offsets)
    return word_hashes(flat, starts, ends), np.concatenate([[0], np.cumsum(per_row)])


def prefix_hashes(words: np.ndarray) -> Iterator[np.ndarray]:
    """Hashes of the first 1, 2, ... words of each row."""
    h = np.zeros(len(words), np.uint64)
    for depth in range(words.shape[1]):
        h = mix(h, words[:, depth])
        yield h


def crowded_prefixes(sample: np.ndarray, most: int) -> list[np.ndarray]:
    """By length, hashes of the prefixes that more than `most` rows of the sample share; longer ones only below such."""
    result, rows = [], np.arange(len(sample))
    for h in prefix_hashes(sample):
        found, counts = np.unique(h[rows], return_counts=True)
        crowded = found[counts > most]
        if not len(crowded):
            break
        result.append(crowded)
        rows = rows[np.isin(h[rows], crowded)]
    return result


def groups_of(words: np.ndarray, crowded: list[np.ndarray]) -> np.ndarray:
    """Hash of each row's shortest prefix that is not crowded, or of the whole row."""
    group = np.zeros(len(words), np.uint64)
    rows = np.arange(len(words))
    for depth, h in enumerate(prefix_hashes(words)):
        group[rows] = h[rows] + np.uint64(depth)
        if depth >= len(crowded):
            break
        rows = rows[np.isin(h[rows], crowded[depth])]
    return group


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """In words, of each sorted row with the one before it; the first has none."""
    equal = words[1:] == words[:-1]
    return np.concatenate([[0], np.where(equal.all(axis=1), words.shape[1], np.argmin(equal, axis=1))])[: len(words)]


def deep_nodes(prefixes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Subtree nodes at `depth` or deeper, one for each outermost: their first row and how many rows they have. Rows that
    share their first `depth` words with no other are nodes of one row."""
    firsts = np.flatnonzero(prefixes < depth)
    return firsts, np.diff(np.append(firsts, len(prefixes)))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    flat, _ = byte_rows(column)
    return flat.view("<u8").reshape(-1, length)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, group_rows: int = GROUP_ROWS,
                   prefix_sample: int = SAMPLE_ROWS, **options) -> DataFrame:
    """Per document (`of`, `of_version`) the spans of words covered by windows that a smaller document holds, too."""
    found = repeats.sort_out(docs, word_symbols, length, anchor, by_document=True, **options)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, offsets = word_symbols(batch.column("text"))
            lists, f = repeats.list_rows(batch.column("regions"), ["start", "n"])
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists))
            fits = f["start"] + f["n"] + length - 1 <= np.diff(offsets)[row]
            row, start, n = row[fits], f["start"][fits].astype(np.int64), f["n"][fits].astype(np.int64)
            ids, versions = (batch.column(name).to_numpy() for name in ("doc", "version"))
            which = np.repeat(np.arange(len(row)), n)
            place = start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            for first in range(0, len(which), 16384):
                w, p = which[first : first + 16384], place[first : first + 16384]
                words = symbols[(offsets[row[w]] + p)[:, None] + np.arange(length)]
                data = pa.py_buffer(np.ascontiguousarray(words, "<u8").tobytes())
                sizes = pa.py_buffer((np.arange(len(w) + 1) * 8 * length).astype(np.int32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[w]]), pa.array(versions[row[w]]), pa.array(p), pa.Array.from_buffers(pa.binary(), len(w), [None, sizes, data])],
                    ["doc", "version", "a", "words"],
                )

    with_lists = docs.hint("merge").join(repeats.undecided_by_document(found), repeats.same_document())
    suffixes = with_lists.select("doc", "version", "text", "regions")
    suffixes = cut_lineage(suffixes.mapInArrow(cut, "doc long, version long, a long, words binary"))
    total = suffixes.count()
    share = min(1.0, prefix_sample / max(total, 1))
    # The driver sees a sample of bounded size; it only decides how suffixes are grouped, not what is found.
    sample = suffixes.select("words").sample(share, seed=3).limit(2 * prefix_sample).toArrow().column("words").combine_chunks()
    crowded = crowded_prefixes(_matrix(sample, length), max(2, int(group_rows * share)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = groups_of(_matrix(batch.column("words"), length), crowded)
            yield batch.append_column("prefix", pa.array(group.view(np.int64)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_least = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            words = _matrix(batch.column("words"), length)
            docs_ = np.stack([batch.column(name).to_numpy() for name in ("doc", "version")], axis=1)
            firsts, sizes = deep_nodes(common_prefixes(words), length)
            least = docs_[firsts].copy()  # rows of a node are sorted by document
            if last is not None and (words[0] == last).all():
                least[0] = last_least
            gone = (docs_ != np.repeat(least, sizes, axis=0)).any(axis=1)
            last, last_least = words[-1].copy(), least[-1].copy()
            a = batch.column("a").to_numpy()[gone]
            d, v = docs_[gone].T
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(v), pa.array(a), pa.array(a + length)], ["doc", "version", "a", "b"])

    grouped = suffixes.mapInArrow(assign, "doc long, version long, a long, words binary, prefix long")
    ordered = grouped.repartition("prefix").sortWithinPartitions("prefix", "words", "doc", "version")
    gone = ordered.mapInArrow(work, "doc long, version long, a long, b long")
    spans = cut_lineage(repeats.removed_by_document(found, gone, length=length))
    for table in (found, suffixes):
        drop_stored(table)
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, and `kept`, the words that are left, joined by spaces.

    Words are parted by ASCII white space. Every word goes that is covered by a window of `length` words which also starts
    in a document with a smaller doc_id; windows are judged on the input. Repeats inside a document alone stay. Texts of
    fewer than `length` words, empty ones and nulls lose nothing. Rows that share doc_id and text count as one document.
    Different texts that share a doc_id are documents of their own; these, and documents without doc_id, which come last,
    are in an order that depends on their texts. No rows give no rows.
    """
    rows = repeats.keyed(docs, key, text)
    spans = repeated_spans(rows, length, anchor, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in repeats.small_batches(batches):
            lists, f = repeats.list_rows(batch.column("spans"), ["a", "b"])
            flat, offsets = byte_rows(batch.column("text"))
            data = memoryview(flat)
            counts, removed, kept = [], [], []
            for row in range(batch.num_rows):
                words = bytes(data[offsets[row] : offsets[row + 1]]).split()
                counts.append(len(words))
                if lists[row] < lists[row + 1]:
                    steps = np.zeros(len(words) + 1, np.int64)
                    np.add.at(steps, np.minimum(f["a"][lists[row] : lists[row + 1]], len(words)), 1)
                    np.add.at(steps, np.minimum(f["b"][lists[row] : lists[row + 1]], len(words)), -1)
                    words = list(compress(words, (np.cumsum(steps)[:-1] == 0).tolist()))
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc", "n_words", "n_removed", "kept"],
            )

    joined = rows.hint("merge").join(spans.hint("merge"), repeats.same_document(), "left").select("doc", "text", "spans")
    result = joined.mapInArrow(apply, "doc long, n_words long, n_removed long, kept binary")
    return result.select(repeats.key_again(), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))
