"""Ranked lexical search by pipelined term partitioning.

Documents are numbered in shards, and every term's postings are cut by shard. Terms belong to owners by their weight, the
rarest to the first. A bundle is a block of items together with a shard of documents: it carries the items' terms and a sparse
accumulator of (item, document, score), and visits the owners one after the other. Each visit is a cogroup of the bundles
with the owner's postings of the same shard, which adds integer contributions. As rare terms come first, accumulators stay
sparse on the way; the last owner's stage, where they are fullest, sends on only the best documents of each item.
"""

from __future__ import annotations

import string
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.common import byte_rows, text_or_empty
from seqloom.session import cut_lineage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 10
SHARD_DOCS = 4096
SHARD_POSTINGS = 1 << 20
BLOCK_ITEMS = 256
# Least weights of the terms of all owners but the last: of terms in fewer than about 1 / 400, 1 / 33 and 1 / 4.5 of the documents.
OWNERS = (6000, 3500, 1500)
# Below this size the items' terms are sent to the map tasks, which then leave out all other terms.
VOCABULARY_BYTES = 32 << 20

_UPPER, _LOWER = string.ascii_uppercase, string.ascii_lowercase
# Bytes of terms stay, in lower case; any other byte becomes a space.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_SHARD = "shard long, doc_ids array<{id}>, lengths binary, n_docs long, n_terms long"
_POSTING = "term string, df long, docs binary, tfs binary"
_NAMES = ["shard", "doc_ids", "lengths", "n_docs", "n_terms", "term", "df", "docs", "tfs"]


def terms(text: str | Column) -> Column:
    """All terms of a text, in order: its maximal runs of ASCII letters, digits and characters beyond ASCII, A to Z lowered."""
    column = text_or_empty(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.translate(column, _UPPER, _LOWER), F.lit(TERM), F.lit(0))


class _Shard:
    """Term frequencies of one shard's documents."""

    def __init__(self, number: int, wanted: frozenset[bytes] | None):
        self.number, self.wanted = number, wanted
        self.doc_ids, self.lengths = [], array("q")
        self.numbers: dict[bytes, int] = {}
        self.terms, self.docs, self.tfs = array("q"), array("q"), array("q")

    def document(self, doc_id, text: bytes) -> None:
        words = text.translate(_TABLE).split()
        found = Counter(words if self.wanted is None else filter(self.wanted.__contains__, words))
        numbers = self.numbers
        self.terms.extend([numbers.setdefault(term, len(numbers)) for term in found])
        self.tfs.extend(found.values())
        self.docs.extend([len(self.doc_ids)] * len(found))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))

    def batches(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row for the shard, then one row per term."""
        if not self.doc_ids:
            return
        lengths = np.frombuffer(self.lengths, np.int64)
        head = [
            pa.array([self.number]), pa.array([self.doc_ids], pa.list_(id_type)), pa.array([lengths.tobytes()]),
            pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
        ]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([*head, *[pa.nulls(1, kind) for kind in kinds]], _NAMES)
        if not self.numbers:
            return
        of, docs, tfs = (np.frombuffer(a, np.int64) for a in (self.terms, self.docs, self.tfs))
        order = np.argsort(of, kind="stable")
        df = np.bincount(of, minlength=len(self.numbers))
        ends = np.cumsum(df)
        columns = [
            pa.array([self.number] * len(df)), pa.nulls(len(df), pa.list_(id_type)), pa.nulls(len(df), pa.binary()),
            pa.nulls(len(df), pa.int64()), pa.nulls(len(df), pa.int64()),
            pa.array([term.decode("utf-8", "replace") for term in self.numbers]), pa.array(df),
            _binary(docs[order].astype("<u2"), 2 * ends), _binary(tfs[order].astype("<u4"), 4 * ends),
        ]
        whole = pa.RecordBatch.from_arrays(columns, _NAMES)
        for first in range(0, len(df), 1 << 14):
            yield whole.slice(first, 1 << 14)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def shard_postings(
    docs: DataFrame, vocabulary: DataFrame | None, key: str, text: str, shard_docs: int, shard_postings: int
) -> DataFrame:
    """A row for each shard (doc_ids, lengths, documents with a term, terms) and for each of its terms (term, df, docs, tfs).

    `vocabulary` (term) is given if it is small enough to be sent to all tasks; terms outside it then have no rows.
    """
    wanted = None
    if vocabulary is not None:
        found = frozenset(row["term"].encode() for row in vocabulary.select("term").collect())
        wanted = docs.sparkSession.sparkContext.broadcast(found)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, kind = TaskContext.get().partitionId() << 32, pa.int64()
        known = None if wanted is None else wanted.value
        shard = _Shard(number, known)
        for batch in batches:
            kind = batch.column(0).type
            flat, offsets = byte_rows(batch.column(1))
            data = flat.tobytes()
            for n, doc_id in enumerate(batch.column(0).to_pylist()):
                shard.document(doc_id, data[offsets[n] : offsets[n + 1]])
                if len(shard.doc_ids) == shard_docs or len(shard.terms) > shard_postings:
                    yield from shard.batches(kind)
                    number += 1
                    shard = _Shard(number, known)
        yield from shard.batches(kind)

    id_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(build, f"{_SHARD.format(id=id_type)}, {_POSTING}")


class _Bundle:
    """A bundle inside a stage; scores are spread out as a table of items by documents."""

    def __init__(self, row: pa.Table, n_docs: int, n_terms: int):
        self.row = row
        self.doc_ids = row.column("doc_ids").combine_chunks().flatten()
        n = np.frombuffer(row.column("lengths")[0].as_py(), "<i8")
        self.m = 25 + (75 * n * n_docs) // max(n_terms, 1)
        self.items, self.terms, self.times = (
            row.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in ("q_items", "q_terms", "q_times")
        )
        self.scores = np.zeros((len(row.column("item_ids").combine_chunks().flatten()), len(n)), np.int64)
        places = np.frombuffer(row.column("places")[0].as_py(), "<u4")
        self.scores.reshape(-1)[places] = np.frombuffer(row.column("scores")[0].as_py(), "<i8")

    def add(self, postings: pa.Table) -> None:
        """Add the contributions of an owner's postings in this shard; a term's documents are distinct."""
        lists = [postings.column(name).to_pylist() for name in ("number", "w", "docs", "tfs")]
        for number, w, docs, tfs in zip(*lists):
            first, last = np.searchsorted(self.terms, number), np.searchsorted(self.terms, number, side="right")
            if first == last:
                continue
            docs, tf = np.frombuffer(docs, "<u2"), np.frombuffer(tfs, "<u4").astype(np.int64)
            share = w * ((1_000_000_000 * tf) // (1000 * tf + 8 * self.m[docs]))
            for item, times in zip(self.items[first:last], self.times[first:last]):
                self.scores[item, docs] += share if times == 1 else times * share

    def carried(self, names: list[str]) -> pa.Table:
        """The bundle for the next stage."""
        places = np.flatnonzero(self.scores)
        new = {
            "places": pa.array([places.astype("<u4").tobytes()]),
            "scores": pa.array([self.scores.reshape(-1)[places].astype("<i8").tobytes()]),
        }
        return pa.table([new.get(name, self.row.column(name)) for name in names], names)

    def best(self, count: int) -> pa.Table:
        """item_id, doc_id and score of each item's `count` best documents in this shard, of equal ones the smallest ids."""
        place = np.empty(len(self.doc_ids), np.int64)
        place[pc.sort_indices(self.doc_ids, null_placement="at_end").to_numpy()] = np.arange(len(self.doc_ids))
        items, docs = [], []
        for item, scores in enumerate(self.scores):
            found = np.flatnonzero(scores > 0)
            if len(found) > count:
                least = np.partition(scores[found], len(found) - count)[len(found) - count]
                found = found[scores[found] >= least]
            found = found[np.lexsort((place[found], -scores[found]))][:count]
            items.append(np.full(len(found), item))
            docs.append(found)
        items = np.concatenate(items) if items else np.empty(0, np.int64)
        docs = np.concatenate(docs) if docs else np.empty(0, np.int64)
        item_ids = self.row.column("item_ids").combine_chunks().flatten()
        return pa.table([item_ids.take(pa.array(items)), self.doc_ids.take(pa.array(docs)), pa.array(self.scores[items, docs])],
                        ["item_id", "doc_id", "score"])


def item_blocks(counted: DataFrame, numbered: DataFrame, block_items: int) -> tuple[DataFrame, int]:
    """Items in blocks of about `block_items` and the number of blocks: block, item_ids, and by (item, term) the place of the
    item in item_ids, the term's number and its occurrences; terms ascend."""
    items = counted.select("item_id").distinct()
    blocks = max(1, -(-items.count() // block_items))
    in_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    placed = items.withColumn("block", in_block)
    place = (F.row_number().over(Window.partitionBy("block").orderBy("item_id")) - 1).alias("place")
    placed = cut_lineage(placed.select("block", "item_id", place))
    ids = placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "item_id"))).alias("i"))
    ids = ids.select("block", F.col("i.item_id").alias("item_ids"))
    same = F.col("item_id").eqNullSafe(F.col("of"))
    wanted = counted.join(numbered.select("term", "number"), "term").withColumnRenamed("item_id", "of").join(placed, same)
    listed = wanted.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("number", "place", "times"))).alias("q"))
    parts = [F.col("q.place").alias("q_items"), F.col("q.number").alias("q_terms"), F.col("q.times").alias("q_times")]
    return ids.join(listed.select("block", *parts), "block"), blocks


def ranked_search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", best: int = BEST,
    owners: tuple[int, ...] = OWNERS, shard_docs: int = SHARD_DOCS, shard_limit: int = SHARD_POSTINGS,
    block_items: int = BLOCK_ITEMS, vocabulary_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of each item with a score above 0, of equal scores the smallest id.

    Null texts have no terms, and items or documents without terms have no rows. Rows of `items` that share an id, or have
    none, are one item whose terms are added. Rows of `docs` that share an id or have none are documents of their own; null
    ids come last among equal scores. Other columns are not read. No rows give no rows.

    The items' terms go to the map tasks if they take at most `vocabulary_bytes`; beyond that the tasks list all terms, and a
    join picks the wanted ones. A task holds one shard's postings or one bundle, whose sizes `shard_docs`, `shard_limit` and
    `block_items` bound; a term that all documents hold has one row in each shard.
    """
    if not 0 < shard_docs <= SHARD_DOCS or not 0 < block_items:
        raise ValueError(f"a shard holds 1 to {SHARD_DOCS} documents, a block an item at least")
    counted = items.select(F.col(item).alias("item_id"), F.explode(terms(text)).alias("term"))
    counted = cut_lineage(counted.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")))
    vocabulary = counted.select("term").distinct()
    size = vocabulary.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0))).first()[0]
    stored = cut_lineage(shard_postings(docs, vocabulary if size <= vocabulary_bytes else None, key, text, shard_docs, shard_limit))
    shards = stored.filter("term is null").select("shard", "doc_ids", "lengths", "n_docs", "n_terms")
    n_docs, n_terms = shards.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_docs", "n_terms")]).first()

    postings = stored.filter("term is not null").select("shard", "term", "df", "docs", "tfs")
    frequency = postings.groupBy("term").agg(F.sum("df").alias("df")).join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.when(F.col("w") < least, 1).otherwise(0) for least in owners), F.lit(0))
    numbered = frequency.select("term", weight.cast("long").alias("w")).filter("w > 0")
    numbered = cut_lineage(numbered.select("term", "w", owner.alias("owner"), F.monotonically_increasing_id().alias("number")))
    owned = cut_lineage(
        postings.join(numbered.withColumnRenamed("term", "of"), F.col("term") == F.col("of"))
        .select("shard", "owner", "number", "w", "docs", "tfs")
    )
    queries, blocks = item_blocks(counted, numbered, block_items)
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    bundles = shards.select("shard", "doc_ids", "lengths", each_block.alias("block")).join(cut_lineage(queries), "block")
    empty = F.lit(b"").cast("binary")
    names = ["block", "shard", "doc_ids", "lengths", "item_ids", "q_items", "q_terms", "q_times", "places", "scores"]
    bundles = bundles.withColumns({"places": empty, "scores": empty}).select(*names)

    def visit(last: bool):
        def stage(left: pa.Table, right: pa.Table) -> pa.Table:
            bundle = _Bundle(left, n_docs, n_terms)
            bundle.add(right)
            return bundle.best(best) if last else bundle.carried(names)

        return stage

    schema = bundles.schema
    id_types = f"item_id {items.schema[item].dataType.simpleString()}, doc_id {docs.schema[key].dataType.simpleString()}"
    for number in range(len(owners) + 1):
        last = number == len(owners)
        visited = owned.filter(F.col("owner") == number).withColumn("block", each_block)
        grouped = bundles.groupBy("block", "shard").cogroup(visited.groupBy("block", "shard"))
        bundles = grouped.applyInArrow(visit(last), f"{id_types}, score long" if last else schema)
    # Each task keeps `best` rows of an item before the exchange.
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return bundles.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
