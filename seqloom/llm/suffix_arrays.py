"""Removal of repeated byte strings with suffix arrays of shards.

A shard holds regions that share anchors (see repeats.py). Its suffix array is refined as Larsson and Sadakane do: ranks of
the first h bytes give those of the first 2h, and only groups that are not yet parted are sorted again. Common prefixes of
neighbours follow in text order as in Kasai's method: when both suffixes move on by one byte, the prefix shrinks by one.
Suffixes with a common prefix of `length` bytes form a group; all but its earliest start repeated windows.

An anchor with more regions than a shard holds is spread over several shards. These give, besides, one row for every
group: a digest of its bytes and its earliest place. The sorted rows of all shards are merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm import repeats
from seqloom.llm.common import byte_rows, doubled_hashes, mix, window_hashes
from seqloom.session import cut_lineage, drop_stored

LENGTH = 100
ANCHOR = 40
SHARD_BYTES = 1 << 20


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    flat, offsets = byte_rows(column)
    return _Bytes(flat), offsets


class _Bytes:
    """Bytes as symbols from 1 to 256, made 64 bits wide only in the slices that are asked for."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat

    def __getitem__(self, part: slice) -> np.ndarray:
        return self.flat[part].astype(np.uint64) + np.uint64(1)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of `text` (bytes), sorted by their first `depth` bytes at least; the end sorts first."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for k in range(7):
        words = words << np.uint64(8) | padded[k : k + n]
    # Seven bytes and how many of them the text has, so that its end differs from zero bytes.
    words = words << np.uint64(8) | np.minimum(n - np.arange(n), 7).astype(np.uint64)
    order = np.argsort(words)
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    parted = np.concatenate([[True], words[order][1:] != words[order][:-1]])
    heads = np.flatnonzero(parted)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n))) + 1
    h = 7
    open_ = np.repeat(np.diff(np.append(heads, n)) > 1, np.diff(np.append(heads, n)))
    at = np.flatnonzero(open_)
    while h < depth and len(at):
        suffixes = order[at]
        group = rank[suffixes]
        key = group << 32 | rank[np.minimum(suffixes + h, n)]
        by = np.argsort(key)
        key, suffixes = key[by], suffixes[by]
        order[at] = suffixes
        new = np.concatenate([[True], key[1:] != key[:-1]])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(at)))
        rank[suffixes] = np.repeat(at[heads], sizes) + 1
        at = at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, enough: int) -> np.ndarray:
    """Length of the common prefix of each suffix in `order` with the one before it; if it is at least `enough`, some
    number of at least `enough`.

    Where suffix i follows p in the order, i - 1 follows p - 1 and these two begin with the same byte, the prefix is one
    shorter than that of i - 1. Only the other suffixes, and every `enough`-th in a run of such, are compared byte by byte,
    eight at a time.
    """
    n = len(text)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    chained = np.zeros(n, bool)
    chained[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (text[:-1] == text[before[:-1]])
    chained[::enough] = False
    heads = np.flatnonzero(~chained & (before >= 0))
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)
    lengths = np.zeros(len(heads), np.int64)
    left, right = heads.copy(), before[heads]
    active = np.arange(len(heads))
    for compared in range(0, 2 * enough, 8):
        if not len(active):
            break
        differ = words[left].copy().view("<u8").ravel() ^ words[right].copy().view("<u8").ravel()
        low = differ & (~differ + np.uint64(1))
        equal = np.where(differ == 0, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
        room = n - np.maximum(left, right)
        lengths[active] += np.minimum(equal, room)
        more = (equal == 8) & (room > 8)
        active, left, right = active[more], left[more] + 8, right[more] + 8
    by_text = np.zeros(n, np.int64)
    start = np.full(n, -1, np.int64)
    by_text[heads], start[heads] = lengths, heads
    start = np.maximum.accumulate(np.where(before >= 0, start, np.arange(n)))
    by_text = np.maximum(by_text[start] - (np.arange(n) - start), 0)
    by_text[before < 0] = 0
    return by_text[order]


def repeated_windows(
    text: np.ndarray, window_of: np.ndarray, earliest: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal windows: for each window its group's number, whether it is the group's earliest, and its start.

    `window_of` marks the suffixes that are windows, and `earliest` orders them.
    """
    order = suffix_array(text, length)
    group = np.cumsum(common_prefixes(text, order, length) < length)
    kept = window_of[order]
    order, group = order[kept], group[kept]
    if not len(order):
        return group, np.zeros(0, bool), order
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    key = earliest[order]
    least = np.minimum.reduceat(key, starts)
    sizes = np.diff(np.append(starts, len(order)))
    return group, key == np.repeat(least, sizes), order


def _shard(docs, versions, starts, ns, texts: list[bytes], hot: bool, length: int) -> pa.RecordBatch:
    text = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(texts)), sizes)
    inside = np.arange(len(text)) - begins[row]
    window = inside < ns[row]
    place = starts[row] + inside
    by = np.lexsort((versions, docs))
    doc_rank = np.empty(len(docs), np.int64)
    doc_rank[by] = np.cumsum(np.concatenate([[False], (docs[by][1:] != docs[by][:-1]) | (versions[by][1:] != versions[by][:-1])]))
    _, first, order = repeated_windows(text, window, doc_rank[row] << 32 | place, length)
    # A window at the same place of a document as its group's earliest is the earliest itself.
    gone = np.zeros(len(text), bool)
    gone[order[~first]] = True
    edges = gone & ~np.concatenate([[False], gone[:-1] & (row[1:] == row[:-1])])
    ends = gone & ~np.concatenate([gone[1:] & (row[1:] == row[:-1]), [False]])
    a, b = np.flatnonzero(edges), np.flatnonzero(ends)
    columns = [docs[row[a]], versions[row[a]], place[a], place[b] + length, np.zeros(len(a), np.int64), np.zeros(len(a), np.int64), np.zeros(len(a), bool)]
    if hot:
        own = np.sort(order[first])
        levels = doubled_hashes(text.astype(np.uint64) + np.uint64(1), length)
        d1 = window_hashes(levels, length)[own]
        width = 1 << (length.bit_length() - 2)
        d2 = mix(levels[width][own], levels[width][own + length // 2 - 1])
        d2 = mix(d2, levels[width][own + length - width])
        extra = [docs[row[own]], versions[row[own]], place[own], place[own] + length, d1.view(np.int64), d2.view(np.int64), np.ones(len(own), bool)]
        columns = [np.concatenate(pair) for pair in zip(columns, extra)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "version", "a", "b", "d1", "d2", "open"])


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """Per document (`of`, `of_version`) the byte spans covered by windows that also start earlier. `docs` has doc, version
    and text."""
    found = repeats.sort_out(docs, byte_symbols, length, anchor, by_document=False, **options)
    per_shard = max(2, shard_bytes // (2 * length))
    undecided = found.filter("fp is not null")
    # Anchors below the limit share shards of a quarter of it on average, so that a large one among them still fits.
    buckets = max(1, 4 * undecided.count() // per_shard)
    crowded = undecided.groupBy(F.col("fp").alias("c_fp")).count().filter(F.col("count") > per_shard)
    crowded = cut_lineage(crowded.select("c_fp", F.ceil(F.col("count") / per_shard).cast("long").alias("parts")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = byte_rows(batch.column("text"))
            data = memoryview(flat)
            lists, f = repeats.list_rows(batch.column("regions"), ["start", "n", "fp"])
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists))
            ids, versions = (batch.column(name).to_numpy() for name in ("doc", "version"))
            for first in range(0, len(row), 8192):
                part = slice(first, first + 8192)
                begins = offsets[row[part]] + f["start"][part]
                ends = np.minimum(begins + f["n"][part] + (length - 1), offsets[row[part] + 1])
                texts = [bytes(data[x:y]) for x, y in zip(begins, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row[part]]), pa.array(versions[row[part]]), pa.array(f["start"][part]), pa.array(f["n"][part]), pa.array(f["fp"][part]),
                     pa.array(texts, pa.binary())], ["doc", "version", "start", "n", "fp", "bytes"],
                )

    with_lists = docs.hint("merge").join(repeats.undecided_by_document(found), repeats.same_document())
    regions = with_lists.select("doc", "version", "text", "regions")
    regions = regions.mapInArrow(cut, "doc long, version long, start int, n int, fp long, bytes binary")
    regions = regions.join(crowded, F.col("fp") == F.col("c_fp"), "left")
    part = F.pmod(F.xxhash64("doc", "version", "start"), F.col("parts"))
    shard = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("fp"), F.lit(buckets))).otherwise(F.xxhash64("fp", part))
    regions = regions.select(F.struct(F.col("parts").isNotNull().alias("hot"), shard.alias("number")).alias("shard"),
                             "doc", "version", "start", "n", "bytes")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            shards = batch.column("shard")
            hot, number = (shards.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (hot[1:] != hot[:-1])) + 1
            for x, y in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(number)]])):
                if y <= x:
                    continue
                name = (bool(hot[x]), int(number[x]))
                if name != current and parts:
                    yield finish(current, parts)
                    parts = []
                current = name
                parts.append(batch.slice(x, y - x))
        if parts:
            yield finish(current, parts)

    def finish(name, parts) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        d, v, s, n = (rows.column(c).to_numpy() for c in ("doc", "version", "start", "n"))
        return _shard(d, v, s.astype(np.int64), n, rows.column("bytes").to_pylist(), name[0], length)

    ordered = regions.repartition("shard").sortWithinPartitions("shard")
    resolved = cut_lineage(ordered.mapInArrow(work, "doc long, version long, a long, b long, d1 long, d2 long, open boolean"))
    across = _merged_shards(resolved.filter("open").select("d1", "d2", "doc", "version", "a", "b"))
    spans = cut_lineage(repeats.removed_by_document(found, resolved.filter("not open"), across, length=length))
    for table in (found, crowded, resolved):
        drop_stored(table)
    return spans


def _merged_shards(rows: DataFrame) -> DataFrame:
    """Of equal digests from several shards all but the earliest place.

    Digests are dealt out by value and sorted, places in order within a digest. The first row with a row's digest is found
    by binary search; it is the earliest. A digest has at most one row from each shard of its anchor.
    """
    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(0, "S16")
        for batch in batches:
            # Sixteen bytes that sort like the two signed numbers.
            halves = [batch.column(name).to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for name in ("d1", "d2")]
            own = np.ascontiguousarray(np.stack(halves, axis=1), ">u8").view("S16").ravel()
            digests = np.concatenate([last, own])
            first = np.searchsorted(digests, own, side="left")
            yield batch.filter(pa.array(first < np.arange(len(own)) + len(last))).select(["doc", "version", "a", "b"])
            last = digests[-1:]

    dealt = rows.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "doc", "version", "a")
    return dealt.mapInArrow(later, "doc long, version long, a long, b long")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, anchor: int = ANCHOR,
                   shard_bytes: int = SHARD_BYTES, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, and `kept`, the bytes that are left.

    Every byte of the UTF-8 text goes that is covered by a string of `length` bytes which also starts earlier: in a document
    with a smaller doc_id, or earlier in the same one. Matches stay inside documents and are judged on the input. Texts
    shorter than `length`, empty ones and nulls stay whole. Of texts of any length all is read, in blocks.

    Rows that share doc_id and text count as one document. Different texts that share a doc_id, and documents without one,
    which come last, are in an order that depends on their texts. No rows give no rows.
    """
    rows = repeats.keyed(docs, key, text)
    spans = repeated_spans(rows, length, anchor, shard_bytes, **options)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in repeats.small_batches(batches):
            flat, offsets = byte_rows(batch.column("text"))
            lists, f = repeats.list_rows(batch.column("spans"), ["a", "b"])
            sizes = np.diff(offsets)
            removed, count, kept = [], [], []
            for row in range(batch.num_rows):
                body = flat[offsets[row] : offsets[row + 1]]
                a, b = (np.minimum(f[k][lists[row] : lists[row + 1]], len(body)) for k in ("a", "b"))
                a, b = repeats.merged(a[a < b], b[a < b])
                left = np.concatenate([body[x:y] for x, y in zip(np.append(0, b), np.append(a, len(body)))]) if len(a) else body
                removed.append(len(body) - len(left))
                count.append(len(a))
                kept.append(left.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(sizes), pa.array(removed, pa.int64()), pa.array(count, pa.int64()),
                 pa.array(kept, pa.binary())], ["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    joined = rows.hint("merge").join(spans.hint("merge"), repeats.same_document(), "left").select("doc", "text", "spans")
    result = joined.mapInArrow(apply, "doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return result.select(repeats.key_again(), "n_bytes", "n_removed", "n_spans", "kept")
