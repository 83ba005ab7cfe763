"""Near-duplicate classes by improved consistent weighted sampling of TF-IDF shingles.

A text's shingles are its windows of five words; a shingle weighs its count in the text times its inverse document
frequency over all documents, 1 + ln(N / df). A shingle in less than one of RARE documents weighs as one in just that many:
so the similarity of two texts depends on the shares of documents that hold their shingles, not on the number of documents,
and the frequencies can be counted by hash buckets, which add less than such a share. Consistent weighted sampling (Ioffe's
improved form) draws samples that two texts share with a probability equal to their weighted Jaccard similarity. Bands of
samples put texts into buckets, and a pair from a bucket is linked only if the similarity of the whole texts reaches the
threshold.

Buckets are not expanded into pairs. Equal texts are one member. In each round a bucket's members are compared with a few
pivots; what is linked joins a class. Members of one class need no comparison with each other, so rounds go on only in
buckets with members of several classes. Their next pivots are members outside the bucket's largest class, more in each
round, until all such members were pivots: then every pair of members of different classes was compared.

In a crowded bucket, the many texts with something in common that are no near-duplicates would make this long. Its members
are dealt anew, by shared shingles among their rarest (prefix filtering), and two of them are compared only if what both hold
from that shingle on could reach the threshold (positional filtering). Rare is what few texts of the crowd hold, however many
documents there are in all: a passage that a fixed share of them repeat comes after what is each text's own. No link is lost,
while what is common to the crowd brings nobody together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import (
    WHITE_SPACE_RUN, byte_rows, doubled_hashes, mix, slices, text_or_empty, window_hashes, word_hashes, word_spans,
)
from seqloom.llm.repeats import key_again, keyed, number
from seqloom.session import cut_lineage, drop_stored
from seqloom.sources.readers import union_all

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 3
BUCKET_BITS = 18
CROWD_BITS = 20
RARE = 100
ID_BITS = 44
TABLE_BITS = 16
BLOCK_BYTES = 1 << 21
MEMBERS_PER_TASK = 2_000
PIVOTS_FACTOR = 40
CROWDED = 64


def shingles(flat: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle and count of every distinct shingle, ordered by text and shingle. A shorter text with words
    has one shingle, all its words."""
    starts, ends, per_row = word_spans(flat, offsets)
    hashes = word_hashes(flat, starts, ends)
    row = np.repeat(np.arange(len(per_row)), per_row)
    levels = doubled_hashes(hashes, words)
    rows, found = [], []
    if len(hashes) >= words:
        inside = row[: len(row) - words + 1] == row[words - 1 :]
        rows.append(row[: len(row) - words + 1][inside])
        found.append(window_hashes(levels, words)[inside])
    first_word = np.cumsum(per_row) - per_row
    for count in range(1, words):
        short = np.flatnonzero(per_row == count)
        if len(short):
            rows.append(short)
            found.append(mix(window_hashes(levels, count)[first_word[short]], np.full(len(short), count, np.uint64)))
    if not rows:
        return (np.zeros(0, np.int64),) * 3
    shift = np.uint64(64 - ID_BITS)
    keys = np.concatenate(rows).astype(np.int64) << ID_BITS | (np.concatenate(found) >> shift).astype(np.int64)
    keys.sort()
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[firsts], np.diff(np.append(firsts, len(keys)))
    return keys >> ID_BITS, keys & ((1 << ID_BITS) - 1), counts


def weights(ids: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[ids & (len(idf) - 1)]


def inverse_frequencies(counts: np.ndarray, documents: int, rare: float = RARE) -> np.ndarray:
    """Weight of a bucket's shingles by its document frequency: 1 + ln((1 + N) / (1 + df)), from 1 for a shingle in every
    document, or a bucket that counts more than N, to 1 + ln(rare)."""
    return (1 + np.log(np.clip((1 + documents) / (1 + counts), 1, rare))).astype(np.float32)


class Sampler:
    """Random numbers of the sampling, drawn once: a shingle's for sample k are at a place of the tables given by a hash."""

    def __init__(self, samples: int, seed: int = 17):
        draw = np.random.default_rng(seed)
        size = 1 << TABLE_BITS
        self.r = draw.gamma(2, 1, size).astype(np.float32)
        self.inverse = (1 / self.r).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, size)).astype(np.float32)
        self.beta = draw.random(size).astype(np.float32)
        self.odd = draw.integers(1 << 62, (1 << 63) - 1, samples).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, ids: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """For each text (its shingles begin at `starts`) a row of sample hashes. Ties go to the smaller shingle."""
        log_w = np.log(w)
        places = np.arange(len(ids), dtype=np.int64)
        result = np.empty((len(starts), len(self.odd)), np.uint64)
        unsigned = ids.astype(np.uint64)
        for k, odd in enumerate(self.odd):
            at = ((unsigned * odd) >> np.uint64(64 - TABLE_BITS)).view(np.int64)
            beta = self.beta.take(at)
            t = self.inverse.take(at)
            t *= log_w
            t += beta
            np.floor(t, out=t)
            log_a = t - beta
            log_a += 1
            log_a *= self.r.take(at)
            np.subtract(self.log_c.take(at), log_a, out=log_a)
            bits = log_a.view(np.int32)
            bits ^= (bits >> 31) & 0x7FFFFFFF  # integers in the order of the floats
            key = bits.astype(np.int64)
            key <<= 32
            key |= places
            best = np.minimum.reduceat(key, starts) & 0xFFFFFFFF
            result[:, k] = mix(unsigned[best], t[best].astype(np.int64).view(np.uint64))
        return result


def band_hashes(samples: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.zeros((len(samples), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
    for row in range(rows):
        h = mix(h, samples[:, row * bands : (row + 1) * bands])
    return h


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    flat, offsets = byte_rows(batch.column("text"))
    for first, last in slices(offsets, BLOCK_BYTES):
        yield first, last, flat[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]


def document_frequencies(rows: DataFrame, bits: int = BUCKET_BITS) -> np.ndarray:
    """In how many documents each bucket's shingles occur, over all documents: 2^bits numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, _, flat, offsets in _blocks(batch):
                _, ids, _ = shingles(flat, offsets)
                total += np.bincount(ids & ((1 << bits) - 1), minlength=1 << bits)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])

    sums = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    result = np.zeros(1 << bits, np.int64)
    result[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return result


def digest(text: Column) -> list[Column]:
    """Two numbers from the MD5 of a text's words. Different texts may share a doc, so members are known by doc and digest."""
    md5 = F.md5(F.trim(F.regexp_replace(text, WHITE_SPACE_RUN, " ")).cast("binary"))
    # The zero is never taken; without nulls, joins need no filter that computes the digest again.
    return [F.coalesce(F.conv(F.substring(md5, first, 15), 16, 10).cast("long"), F.lit(0)) for first in (1, 17)]


def _digested(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "text", *[part.alias(name) for name, part in zip(("d1", "d2"), digest(F.col("text")))])


def _signatures(rows: DataFrame, idf, bands: int, band_rows: int) -> DataFrame:
    """doc, digest of its words, and `bands`, an array of bucket hashes; null for texts without words."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * band_rows)
        for batch in batches:
            found: list[np.ndarray | None] = [None] * batch.num_rows
            for first, _, flat, offsets in _blocks(batch):
                row, ids, counts = shingles(flat, offsets)
                if not len(row):
                    continue
                starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                hashes = band_hashes(sampler.sample(ids, weights(ids, counts, idf.value), starts), bands, band_rows)
                for number, values in zip(row[starts].tolist(), hashes.view(np.int64)):
                    found[first + number] = values
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("d1"), batch.column("d2"), pa.array(found, pa.list_(pa.int64()))],
                ["doc", "d1", "d2", "bands"],
            )

    with_digest = _digested(rows)
    return with_digest.mapInArrow(sign, "doc long, d1 long, d2 long, bands array<long>")


def _linked(texts: DataFrame, pairs: DataFrame, idf, threshold: float) -> DataFrame:
    """The pairs (doc, pivot) whose texts reach the threshold.

    Pivots with many members are copied, so that a task compares about MEMBERS_PER_TASK of them with its copy.
    """
    crowd = pairs.groupBy(F.col("pivot").alias("p")).count().select(
        "p", F.ceil(F.col("count") / MEMBERS_PER_TASK).cast("int").alias("parts")
    )
    salted = pairs.join(crowd, F.col("pivot") == F.col("p")).select(
        F.col("doc").alias("of"), "pivot", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member")
    )
    pivots = crowd.select(F.col("p").alias("of"), F.col("p").alias("pivot"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                          F.lit(0).alias("member"))
    needed = salted.unionByName(pivots).hint("merge")
    sent = texts.hint("merge").join(needed, F.col("doc") == F.col("of")).select("pivot", "part", "member", "doc", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, pivot_ids, pivot_w, pivot_sum = None, None, None, 0.0
        for batch in batches:
            pivots, parts, members, docs = (batch.column(n).to_pylist() for n in ("pivot", "part", "member", "doc"))
            found = []
            for first, last, flat, offsets in _blocks(batch):
                row, ids, counts = shingles(flat, offsets)
                w = weights(ids, counts, idf.value).astype(np.float64)
                cuts = np.searchsorted(row, np.arange(last - first + 1))
                for number in range(first, last):
                    part = slice(cuts[number - first], cuts[number - first + 1])
                    own, own_w = ids[part], w[part]
                    if not members[number]:
                        pivot, pivot_ids, pivot_w, pivot_sum = pivots[number], own.copy(), own_w.copy(), own_w.sum()
                        continue
                    if pivot != pivots[number]:
                        raise RuntimeError(f"document {pivots[number]} is compared with but has no text")
                    at = np.searchsorted(pivot_ids, own)
                    at[at == len(pivot_ids)] = 0
                    same = pivot_ids[at] == own
                    shared = np.minimum(pivot_w[at[same]], own_w[same]).sum()
                    if shared >= threshold * (pivot_sum + own_w.sum() - shared) - 1e-9:
                        found.append((docs[number], pivot))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], ["doc", "pivot"])

    ordered = sent.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "member")
    return ordered.mapInArrow(compare, "doc long, pivot long")


def _thinned(members: DataFrame, texts: DataFrame, idf, threshold: float, crowded: int) -> DataFrame:
    """`members` with the buckets of more than `crowded` members replaced by one bucket for each rare shingle they share.

    A text's rare shingles are the first, rarest first, that together weigh more than 1 - threshold of it. If all that two
    texts share came after the rare shingles of one of them, it would weigh less than the threshold asks for. `total` is the
    text's weight and `rest` what it weighs from the shingle on; both are 0 in the other buckets.

    That holds for any order that all texts have in common. Theirs is by how many texts of the crowds hold a shingle, counted in
    2^CROWD_BITS buckets. Weights would not do: they are equal below a share of documents, which may be very many.
    """
    members = members.select("bucket", "rep", F.lit(0.0).alias("total"), F.lit(0.0).alias("rest"))
    crowds = members.groupBy(F.col("bucket").alias("b")).count().filter(F.col("count") > crowded).select("b")
    crowds = cut_lineage(crowds)
    if crowds.isEmpty():
        return cut_lineage(members)
    in_crowd = F.col("bucket") == F.col("b")
    wanted = members.join(crowds, in_crowd, "left_semi").select(F.col("rep").alias("of")).distinct()
    crowd_texts = cut_lineage(texts.join(wanted, F.col("doc") == F.col("of"), "left_semi"))
    holders = members.sparkSession.sparkContext.broadcast(document_frequencies(crowd_texts, CROWD_BITS).astype(np.int32))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column("doc").to_numpy()
            for first, last, flat, offsets in _blocks(batch):
                row, ids, counts = shingles(flat, offsets)
                w = weights(ids, counts, idf.value).astype(np.float64)
                order = np.lexsort((ids, holders.value[ids & (len(holders.value) - 1)], row))
                row, ids, w = row[order], ids[order], w[order]
                sums = np.cumsum(w)
                begins = np.searchsorted(row, np.arange(last - first))
                ends = np.searchsorted(row, np.arange(last - first), side="right")
                before = np.concatenate([[0.0], sums])
                total = before[ends] - before[begins]
                # A shingle is among the rare ones if those before it weigh no more than the share.
                chosen = before[:-1] - before[begins][row] <= (1 - threshold) * total[row] * (1 + 1e-9)
                whole = total[row[chosen]]
                rest = whole - (before[:-1] - before[begins][row])[chosen]
                columns = [-1 - ids[chosen], docs[first + row[chosen]], whole, rest]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "rep", "total", "rest"])

    found = cut_lineage(crowd_texts.mapInArrow(rare, "bucket long, rep long, total double, rest double"))
    drop_stored(crowd_texts)
    shared = found.groupBy(F.col("bucket").alias("b")).count().filter("count > 1").select("b")
    dealt = found.join(shared, in_crowd, "left_semi").unionByName(members.join(crowds, in_crowd, "left_anti"))
    return cut_lineage(dealt)


def components(links: DataFrame) -> DataFrame:
    """Of the graph with edges (doc, pivot): each node and the smallest node it is connected to. Rounds of large and small
    stars; a node's neighbours are never gathered, only their minimum."""
    edges = links.filter("doc <> pivot").select(F.greatest("doc", "pivot").alias("a"), F.least("doc", "pivot").alias("b"))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut_lineage(
            both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        )
        least = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("u"))
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut_lineage(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct())
        for table in (edges, large):
            drop_stored(table)
        edges, before = new, state
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS,
    band_rows: int = ROWS, bits: int = BUCKET_BITS, crowded: int = CROWDED,
) -> DataFrame:
    """One row per row of `docs`: doc_id, class_id, copy_of, kept.

    `copy_of` is the smallest doc_id with the same words, `class_id` the smallest that is linked to it through any number of
    texts whose similarity reaches the threshold. `kept` marks that document. Rows that repeat a doc_id are in the class of
    their text; of different texts that share a doc_id and are linked, one is kept. Documents without doc_id come after all others; a class of such
    alone has no class_id and keeps one of its texts. Null text is empty; texts without words are copies of each other. No
    rows give no rows.

    Links can be missed only where no band agrees, with probability (1 - s^band_rows)^bands at similarity s: 0.0008 at 0.8
    and less above. Statistics cover all documents; the driver holds 2^bits of them.
    """
    result = _members(keyed(docs, key, text), threshold, bands, band_rows, bits, crowded)
    return result.select(key_again(), key_again("class", "class_id"), key_again("copy", "copy_of"), "kept")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS,
                    band_rows: int = ROWS, bits: int = BUCKET_BITS, crowded: int = CROWDED) -> DataFrame:
    """The rows of `docs` that are their class's smallest document, with their columns; of rows with its doc_id and words
    one."""
    classes = _members(keyed(docs, key, text), threshold, bands, band_rows, bits, crowded)
    names = ["_doc", "_d1", "_d2"]
    staying = classes.filter("kept").select(*[F.col(name[1:]).alias(f"{name}_kept") for name in names]).distinct()
    rows = docs.withColumns({"_doc": number(key, text), **dict(zip(names[1:], digest(text_or_empty(text))))})
    same = [F.col(name) == F.col(f"{name}_kept") for name in names]
    return rows.join(staying.hint("merge"), same, "left_semi").dropDuplicates(names).drop(*names)


def _members(rows: DataFrame, threshold: float, bands: int, band_rows: int, bits: int, crowded: int) -> DataFrame:
    """doc, d1, d2, copy (the smallest doc with equal words), class (the smallest doc linked to it) and kept of every row.

    Inside, texts are known by numbers that count them by their smallest doc and digest.
    """
    spark = rows.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(document_frequencies(rows, bits), rows.count()))
    signed = cut_lineage(_signatures(rows, idf, bands, band_rows))
    distinct = signed.groupBy("d1", "d2", "bands").agg(F.min("doc").alias("copy"))
    # Partitions are ranges in order, so the numbers are in the order of (copy, d1, d2).
    ordered = distinct.repartitionByRange("copy", "d1", "d2").sortWithinPartitions("copy", "d1", "d2")
    distinct = cut_lineage(ordered.withColumn("rep", F.monotonically_increasing_id()))
    members = distinct.filter("bands is not null").select("rep", F.explode("bands").alias("bucket"))
    shared = members.groupBy(F.col("bucket").alias("b")).count().filter("count > 1").select("b")
    members = cut_lineage(members.join(shared, F.col("bucket") == F.col("b")).select("bucket", "rep"))
    wanted = members.select(F.col("rep").alias("of")).distinct()
    wanted = distinct.join(wanted, F.col("rep") == F.col("of"), "left_semi")
    wanted = wanted.select("rep", "copy", F.col("d1").alias("e1"), F.col("d2").alias("e2")).hint("merge")
    same = (F.col("doc") == F.col("copy")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2"))
    texts = _digested(rows).hint("merge").join(wanted, same).dropDuplicates(["doc", "d1", "d2"])
    texts = cut_lineage(texts.select(F.col("rep").alias("doc"), "text"))

    members = _thinned(members, texts, idf, threshold, crowded)
    classes, links, used, pivots_each = None, [], [], 1
    while True:
        pairs, pivots = _next_pairs(members, classes, used, pivots_each, threshold)
        if pairs is None:
            break
        used.append(pivots)
        pivots_each *= PIVOTS_FACTOR
        links.append(cut_lineage(_linked(texts, pairs, idf, threshold)))
        # Few new links would spare the next round few comparisons, so classes wait for them.
        current = classes is not None and 10 * links[-1].count() < pairs.count()
        drop_stored(pairs)
        if not current:
            classes = components(union_all(links))
    if links and current:
        classes = components(union_all(links))
    named = distinct.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "copy", "rep")
    if classes is None:
        named = named.withColumn("class", F.col("copy")).withColumn("first", F.lit(True))
    else:
        roots = distinct.select(F.col("rep").alias("r"), F.col("copy").alias("root_doc"))
        roots = roots.join(classes.select("root").distinct(), F.col("r") == F.col("root"), "left_semi")
        classes = classes.join(roots, F.col("root") == F.col("r"))
        named = named.join(classes, F.col("rep") == F.col("node"), "left")
        named = named.withColumn("class", F.coalesce("root_doc", "copy")).withColumn("first", F.coalesce("root", "rep") == F.col("rep"))
    result = signed.select("doc", "d1", "d2").join(named, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")))
    kept = (F.col("first") & (F.col("doc") == F.col("copy"))).alias("kept")
    return result.select("doc", "d1", "d2", "copy", "class", kept)


def _next_pairs(members: DataFrame, classes: DataFrame | None, used: list[DataFrame], pivots_each: int, threshold: float):
    """Pairs to compare in this round and the pivots (bucket, pivot) they come from; None if nothing is left to compare.

    First every bucket's smallest member is its pivot. Later a bucket with several classes offers up to `pivots_each` members
    that are not in its largest class and were no pivots of it yet, to the members of other classes.
    """
    same = F.col("bucket") == F.col("b")
    # Texts of weights v and w reach the threshold t only if they share t / (1 + t) of v + w.
    possible = F.least("rest", "r") * (1 + threshold) >= (F.col("total") + F.col("t")) * threshold - 1e-6
    place = [F.col("least.rep").alias("pivot"), F.col("least.total").alias("t"), F.col("least.rest").alias("r")]
    if classes is None:
        least = members.groupBy(F.col("bucket").alias("b")).agg(F.min(F.struct("rep", "total", "rest")).alias("least"))
        pivots = cut_lineage(least.select("b", *place))
        joined = members.join(pivots, same & (F.col("rep") != F.col("pivot")) & possible)
    else:
        labelled = cut_lineage(members.join(classes, F.col("rep") == F.col("node"), "left").select(
            *members.columns, F.coalesce("root", "rep").alias("class")
        ))
        sizes = labelled.groupBy("bucket", "class").count().groupBy(F.col("bucket").alias("b"))
        mixed = sizes.agg(F.max(F.struct("count", "class")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        mixed = mixed.select("b", F.col("top.class").alias("largest"))
        outside = labelled.join(mixed, same & (F.col("class") != F.col("largest"))).select(*labelled.columns)
        earlier = union_all(used).select(F.col("bucket").alias("ub"), F.col("pivot").alias("up"))
        unused = outside.join(earlier, (F.col("bucket") == F.col("ub")) & (F.col("rep") == F.col("up")), "left_anti")
        turn = F.pmod(F.xxhash64("rep"), F.lit(pivots_each))
        least = unused.groupBy(F.col("bucket").alias("b"), turn.alias("turn")).agg(
            F.min(F.struct("rep", "total", "rest", "class")).alias("least")
        )
        pivots = cut_lineage(least.select("b", *place, F.col("least.class").alias("c")))
        if pivots.isEmpty():
            return None, None
        joined = labelled.join(pivots, same & (F.col("class") != F.col("c")) & possible)
    pairs = cut_lineage(joined.select(F.col("rep").alias("doc"), "pivot").distinct())
    return pairs, pivots.select(F.col("b").alias("bucket"), "pivot")
