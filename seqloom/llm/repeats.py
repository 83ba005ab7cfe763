"""Where to look for repeated windows: what every method here that removes repeated passages needs first.

A window is `length` consecutive symbols of one document. Each window selects an anchor, the run of `anchor` symbols in it
with the smallest hash (the leftmost of equal ones). The choice depends on the window's symbols alone, so equal windows
select equal anchors at the same place. Neighbouring windows mostly select the same anchor; such a run of windows is an
occurrence of the anchor, and the symbols that it covers are its region.

A window can only be repeated if its anchor occurs twice. Of occurrences with equal anchors and equal regions only the
first is of interest: what it covers occurs in all others. Where all regions of an anchor are equal, that decides every
window. Regions that share an anchor but differ are left to the methods, which compare symbols.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import doubled_hashes, mix, sliding, text_or_empty, window_hashes
from seqloom.session import cut_lineage, drop_stored

BLOCK = 1 << 19
SAMPLE_ROWS = 1_000_000
HOT_IN_SAMPLE = 50
LAST_ID = (1 << 63) - 1 - (1 << 40)

Symbols = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def number(key: str, text: str) -> Column:
    """A document's key. Documents without one get numbers above LAST_ID, from their texts' hashes."""
    without = F.lit(LAST_ID + 1) + F.pmod(F.xxhash64(text_or_empty(text)), F.lit(1 << 40))
    return F.coalesce(F.col(key).cast("long"), without)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, the document's number, version, a hash of its text that does not depend on it, and text; null text is empty.
    Rows are one document only if they share number and version."""
    version = F.xxhash64(F.lit(1), text_or_empty(text)).alias("version")
    return docs.select(number(key, text).alias("doc"), version, text_or_empty(text).alias("text"))


def same_document() -> Column:
    """Joins documents with what is listed by document."""
    return (F.col("doc") == F.col("of")) & (F.col("version") == F.col("of_version"))


def key_again(doc: str = "doc", name: str = "doc_id") -> Column:
    """The key of a document as it was given."""
    return F.when(F.col(doc) <= LAST_ID, F.col(doc)).alias(name)


def occurrences(symbols: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, region hash, first window, number of windows and anchor's place in the region, for each occurrence.

    `symbols` are 64-bit and not 0; a 0 parts documents.
    """
    windows = len(symbols) - length + 1
    if windows <= 0:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    levels = doubled_hashes(symbols, 2 * length - anchor)
    hashes = window_hashes(levels, anchor)
    low = np.uint64((1 << 24) - 1)
    marked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    chosen = (sliding(marked, length - anchor + 1, np.minimum) & low).astype(np.int64)
    zeros = np.concatenate([[0], np.cumsum(symbols == 0)])
    valid = zeros[length:] == zeros[:-length]
    goes_on = valid[1:] & valid[:-1] & (chosen[1:] == chosen[:-1])
    first = np.flatnonzero(valid & ~np.concatenate([[False], goes_on]))
    last = np.flatnonzero(valid & ~np.concatenate([goes_on, [False]]))
    at = chosen[first] - first
    size = last - first + length
    region = np.empty(len(first), np.uint64)
    for width, level in levels.items():
        these = (size >= width) & (size < 2 * width)
        if these.any():
            region[these] = mix(level[first[these]], level[first[these] + size[these] - width])
    region = mix(region, (size << 20 | at).astype(np.uint64))
    return hashes[chosen[first]], region, first, last - first + 1, at


def _blocks(offsets: np.ndarray, length: int, size: int) -> Iterator[list[tuple[int, int, int]]]:
    """Pieces (document, first symbol, symbols) of about `size` symbols; a longer document is cut so that no window is lost."""
    block, filled = [], 0
    for row, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for first in range(0, max(end - begin - length + 1, 0), size):
            count = min(end - begin - first, size + length - 1)
            if filled and filled + count > size:
                yield block
                block, filled = [], 0
            block.append((row, first, count))
            filled += count
    if block:
        yield block


def find_occurrences(docs: DataFrame, symbols_of: Symbols, length: int, anchor: int, block: int = BLOCK) -> DataFrame:
    """Every occurrence in every document: doc, version, fp (anchor hash), region (hash), start, n (windows), at (anchor's
    place)."""
    names = ["doc", "version", "fp", "region", "start", "n", "at"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions = (batch.column(name).to_numpy() for name in ("doc", "version"))
            symbols, offsets = symbols_of(batch.column("text"))
            for pieces in _blocks(offsets, length, block):
                rows, firsts, counts = (np.array(values, np.int64) for values in zip(*pieces))
                joined = np.zeros(int(counts.sum()) + len(pieces), np.uint64)
                begins = np.cumsum(counts + 1) - counts - 1
                for row, first, count, begin in zip(rows, firsts, counts, begins):
                    at = offsets[row] + first
                    joined[begin : begin + count] = symbols[at : at + count]
                fp, region, start, n, at = occurrences(joined, length, anchor)
                piece = np.searchsorted(begins, start, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows[piece]]), pa.array(versions[rows[piece]]), pa.array(fp.view(np.int64)), pa.array(region.view(np.int64)),
                     pa.array((start - begins[piece] + firsts[piece]).astype(np.int32)),
                     pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names,
                )

    return docs.mapInArrow(find, "doc long, version long, fp long, region long, start int, n int, at int")


def sort_out(docs: DataFrame, symbols_of: Symbols, length: int, anchor: int, by_document: bool, block: int = BLOCK,
             sample_rows: int = SAMPLE_ROWS, hot_in_sample: int = HOT_IN_SAMPLE) -> DataFrame:
    """A stored table of occurrences whose anchor is repeated: doc, version, start, n, at, fp.

    Where `fp` is null, an earlier occurrence has the same region, so every window is repeated. Where it is not, the
    occurrence is the first of its region, but other regions share its anchor. Occurrences that no other row could repeat
    are left out. First means the smallest doc, version and start; with `by_document` all occurrences of a region in its
    smallest document are first.

    Anchors go through one shuffle, by hash. Anchors that a sample of at most about `sample_rows` occurrences shows
    `hot_in_sample` times go another way, aggregated map-side and joined, so no task gathers their rows; that list has at
    most sample_rows / hot_in_sample entries, which bounds its broadcast. Both ways give the same rows.
    """
    found = cut_lineage(find_occurrences(docs, symbols_of, length, anchor, block))
    total = found.count()
    sample = found.select("fp").sample(min(1.0, sample_rows / max(total, 1)), seed=11)
    hot = cut_lineage(sample.groupBy("fp").count().filter(F.col("count") >= hot_in_sample).select("fp"))

    cold = found.join(F.broadcast(hot), "fp", "left_anti")
    by_fp, by_region = Window.partitionBy("fp"), Window.partitionBy("fp", "region").orderBy("doc", "version", "start")
    cold = cold.withColumn("rows", F.count(F.lit(1)).over(by_fp)).filter("rows > 1")
    cold = cold.withColumn("differ", F.min("region").over(by_fp) != F.max("region").over(by_fp))
    for name in ("doc", "version", "start"):
        cold = cold.withColumn(f"first_{name}", F.first(name).over(by_region))

    warm = found.join(F.broadcast(hot), "fp", "left_semi")
    regions = cut_lineage(
        warm.groupBy(F.col("fp").alias("r_fp"), F.col("region").alias("r_region"))
        .agg(F.min(F.struct("doc", "version", "start")).alias("first"))
    )
    several = regions.groupBy(F.col("r_fp").alias("m_fp")).count().select("m_fp", (F.col("count") > 1).alias("differ"))
    warm = warm.join(regions, (F.col("fp") == F.col("r_fp")) & (F.col("region") == F.col("r_region")))
    warm = warm.join(F.broadcast(several), F.col("fp") == F.col("m_fp")).select(
        *found.columns, F.lit(2).alias("rows"), "differ", F.col("first.doc").alias("first_doc"),
        F.col("first.version").alias("first_version"), F.col("first.start").alias("first_start"),
    )

    first = (F.col("doc") == F.col("first_doc")) & (F.col("version") == F.col("first_version"))
    if not by_document:
        first &= F.col("start") == F.col("first_start")
    columns = [*found.columns, "differ", "first_doc", "first_version", "first_start"]
    rows = cold.select(*columns).unionByName(warm.select(*columns)).filter(~first | F.col("differ"))
    result = cut_lineage(rows.select("doc", "version", "start", "n", "at", F.when(first, F.col("fp")).alias("fp")))
    for table in (found, hot, regions):
        drop_stored(table)
    return result


def undecided_by_document(sorted_out: DataFrame) -> DataFrame:
    """Per document its undecided occurrences, as a list: at most as long as the document."""
    rows = sorted_out.filter("fp is not null").groupBy(F.col("doc").alias("of"), F.col("version").alias("of_version"))
    return rows.agg(F.collect_list(F.struct("start", "n", "at", "fp")).alias("regions")).hint("merge")


def removed_by_document(sorted_out: DataFrame, *spans: DataFrame, length: int) -> DataFrame:
    """Per document the spans (a, b) of symbols to remove."""
    whole = sorted_out.filter("fp is null").select(
        "doc", "version", F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b")
    )
    for more in spans:
        whole = whole.unionByName(more.select("doc", "version", "a", "b"))
    whole = whole.groupBy(F.col("doc").alias("of"), F.col("version").alias("of_version"))
    return whole.agg(F.collect_list(F.struct("a", "b")).alias("spans")).hint("merge")


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose results take little memory."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def list_rows(column: pa.Array, fields: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Offsets of the lists and the flat fields of a list-of-structs column; null lists are empty."""
    offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = column.flatten()
    return offsets, {name: flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False) for name in fields}


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they touch or overlap."""
    if not len(a):
        return a, b
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    starts = np.concatenate([[True], a[1:] > reach[:-1]])
    ends = np.concatenate([starts[1:], [True]])
    return a[starts], reach[ends]
