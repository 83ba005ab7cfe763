"""Helpers of the corpus operators: Arrow buffers as numpy arrays, window hashes, word boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
WHITE_SPACE_RUN = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def text_or_empty(column: str) -> Column:
    """The text itself; null counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a local path or of any URI that Arrow knows, such as hdfs, s3 and gs."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))


def byte_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offset at which each row starts, without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int):
    """Ranges of rows that hold about `size` symbols each; a longer row is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hash of pairs; not linear, so hashes of neighbouring windows are unrelated."""
    h = left * _A
    h += right * _B
    h ^= h >> np.uint64(29)
    h *= _C
    h ^= h >> np.uint64(32)
    return h


def doubled_hashes(symbols: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of all windows whose length is a power of two up to `longest`."""
    levels, width = {1: symbols}, 1
    while 2 * width <= longest:
        previous = levels[width]
        levels[2 * width] = mix(previous[: max(len(previous) - width, 0)], previous[width:])
        width *= 2
    return levels


def window_hashes(levels: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Hashes of all windows of `length` symbols, from two overlapping windows of the next smaller power of two."""
    width = 1 << (length.bit_length() - 1)
    h = levels[width]
    rest = length - width
    return h if not rest else mix(h[: max(len(h) - rest, 0)], h[rest:])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """`pick` (np.minimum or np.maximum) over every window of `width` values."""
    step, best = 1, values
    while 2 * step <= width:
        best = pick(best[: max(len(best) - step, 0)], best[step:])
        step *= 2
    rest = width - step
    return best if not rest else pick(best[: max(len(best) - rest, 0)], best[rest:])


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every row, and how many words each row has. A row's end ends its last word."""
    inside = np.empty(len(flat) + 1, bool)
    inside[:-1] = (flat != 0x20) & ((flat < 0x09) | (flat > 0x0D))
    inside[-1] = False
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts_at[begins] = inside[begins]
    starts = np.flatnonzero(starts_at)
    following = np.append(starts[1:], len(flat))
    gap = np.flatnonzero(~inside)
    ends = np.minimum(gap[np.searchsorted(gap, starts)], following) if len(starts) else starts
    per_row = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return starts, ends, per_row


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, never 0."""
    lengths = ends - starts
    values = np.empty(len(starts), np.uint64)
    if not len(starts):
        return values
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    h = lengths.astype(np.uint64) * _C
    at, left, rows = starts.copy(), lengths.copy(), np.arange(len(starts))
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    while len(rows):
        piece = eights[at].copy().view("<u8").ravel()
        short = left < 8
        piece[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[rows] = mix(h[rows], piece)
        more = left > 8
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    values[:] = h
    values[values == 0] = 1
    return values
