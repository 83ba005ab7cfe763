"""Exact deduplication by composable polynomial fingerprints and chunkwise comparison.

The fingerprint of a byte string s is the sum of s[i] * B^(len(s)-1-i), modulo two primes. It composes: for s = a + b it
is F(a) * B^len(b) + F(b). Long texts are cut into chunks that different tasks hash; each chunk's hash is shifted by the
bytes that follow it, and the shifted hashes are summed, which Spark does map-side first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WHITE_SPACE_RUN, byte_rows, text_or_empty
from seqloom.session import cut_lineage, drop_stored

PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_812_433_253)
CHUNK_BYTES = 1 << 16


def normalised(text: str = "text") -> Column:
    """The text with every run of ASCII white space replaced by one space; null counts as empty."""
    return F.regexp_replace(text_or_empty(text), WHITE_SPACE_RUN, " ")


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """base^0 .. base^(count-1) modulo prime, by doubling."""
    values = np.ones(1, np.int64)
    while len(values) < count:
        values = np.concatenate([values, values * pow(base, len(values), prime) % prime])
    return values[:count]


def chunk_hashes(flat: np.ndarray, offsets: np.ndarray, primes=PRIMES, bases=BASES) -> list[np.ndarray]:
    """Per prime, the fingerprint of every row of bytes. Rows are at most a few MB long, so the sums stay below 2^63."""
    lengths = np.diff(offsets)
    from_end = np.repeat(offsets[1:], lengths) - 1 - np.arange(len(flat))
    filled = lengths > 0
    result = []
    for prime, base in zip(primes, bases):
        terms = powers(base, prime, int(lengths.max(initial=0)))[from_end] * flat
        sums = np.zeros(len(lengths), np.int64)
        if filled.any():
            sums[filled] = np.add.reduceat(terms, offsets[:-1][filled])
        result.append(sums % prime)
    return result


def _shift(after: np.ndarray, hashes: np.ndarray, prime: int, base: int) -> np.ndarray:
    """Each hash times base^after: the factor that appending `after` bytes puts on it."""
    distinct, which = np.unique(after, return_inverse=True)
    factors = np.array([pow(base, int(count), prime) for count in distinct], np.int64)
    return hashes * factors[which] % prime


def _hasher(primes, bases, kept: list[str]):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = byte_rows(batch.column("chunk"))
            after = batch.column("after").to_numpy(zero_copy_only=False)
            # a few MB at a time: the terms take eight bytes for each byte
            step, found = 1 << 22, [[] for _ in primes]
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, side="right")) - 1)
                piece = flat[offsets[first] : offsets[last]]
                for n, h in enumerate(chunk_hashes(piece, offsets[first : last + 1] - offsets[first], primes, bases)):
                    found[n].append(_shift(after[first:last], h, primes[n], bases[n]))
                first = last
            arrays = [batch.column(name) for name in kept]
            arrays += [pa.array(np.concatenate(h) if h else np.empty(0, np.int64)) for h in found]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, *(f"f{n}" for n in range(len(primes)))])

    return hashed


def _chunked(rows: DataFrame, chunk_bytes: int) -> DataFrame:
    """One row per chunk of `bytes`, with its number and the bytes that follow it; an empty text has one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.col("n_bytes") - 1) / chunk_bytes)).cast("int")
    at = (F.col("number") * chunk_bytes).cast("int")
    return rows.withColumn("number", F.explode(F.sequence(F.lit(0), last))).withColumn(
        "chunk", F.col("bytes").substr(at + 1, F.lit(chunk_bytes))
    ).withColumn("after", F.greatest(F.lit(0), F.col("n_bytes") - at - chunk_bytes).cast("long")).drop("bytes")


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, primes=PRIMES, bases=BASES
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, text_sha256 and the fingerprint f0, f1 of the normalised text.

    Texts of one chunk are hashed where they are. Chunks of longer texts are dealt out evenly over the tasks.
    """
    rows = docs.select(F.col(key).alias("doc_id"), normalised(text).cast("binary").alias("bytes"))
    rows = rows.withColumn("n_bytes", F.length("bytes").cast("long"))
    kept = ["doc_id", "n_bytes", "text_sha256"]
    names = [f"f{n}" for n in range(len(primes))]
    id_type = docs.schema[key].dataType.simpleString()
    hashes = ", ".join(f"{name} long" for name in names)

    short = rows.filter(F.col("n_bytes") <= chunk_bytes).select(
        "doc_id", "n_bytes", F.sha2("bytes", 256).alias("text_sha256"), F.col("bytes").alias("chunk"),
        F.lit(0).cast("long").alias("after"),
    )
    short = short.mapInArrow(
        _hasher(primes, bases, kept), f"doc_id {id_type}, n_bytes long, text_sha256 string, {hashes}"
    )
    long = rows.filter(F.col("n_bytes") > chunk_bytes).withColumn("text_sha256", F.sha2("bytes", 256))
    pieces = _chunked(long, chunk_bytes).repartition(F.xxhash64("text_sha256", "number"))
    hashed = pieces.mapInArrow(
        _hasher(primes, bases, [*kept, "number"]),
        f"doc_id {id_type}, n_bytes long, text_sha256 string, number int, {hashes}",
    )
    # A row that occurs m times adds every chunk m times: the sums over m are those of one row, and it comes back m times.
    copies = F.sum(F.when(F.col("number") == 0, 1).otherwise(0))
    sums = hashed.groupBy(*kept).agg(copies.alias("m"), *[F.sum(name).alias(name) for name in names])
    combined = sums.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("m").cast("int")))).select(
        *kept, *[F.pmod(F.expr(f"{name} div m"), F.lit(prime)).cast("long").alias(name)
                 for name, prime in zip(names, primes)]
    )
    return short.unionByName(combined)


def exact_dedup(
    docs: DataFrame, key: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK_BYTES, primes=PRIMES, bases=BASES
) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after replacing runs of ASCII white space by a space; null counts as empty. Of equal
    texts the smallest doc_id stays. Rows with equal fingerprints and lengths are a group only after a comparison: the
    chunks of each text are joined to those of the group's first text. Texts that differ from it form the next round.
    Groups are counted map-side first and stored, and the joins on a group's key carry narrow rows or one chunk each. What
    it reads from a table, not from an aggregate, adaptive execution can split, so a group may have any size.

    Rows that repeat a doc_id each count in `group_size`; all that equal the staying one in doc_id are kept. A null doc_id
    stays only where a group has no other, and its text is compared by fingerprint, length and SHA-256 alone.
    """
    names = [f"f{n}" for n in range(len(primes))]
    prints = cut_lineage(fingerprints(docs, key, text, chunk_bytes, primes, bases))
    same = [*names, "n_bytes"]
    classes = _classes(docs, prints, same, key, text, chunk_bytes)
    groups = prints if classes is None else prints.join(
        classes, [*(prints[c] == classes["c_" + c] for c in same), prints["text_sha256"] == classes["c_sha256"]], "left"
    ).select(*[prints[c] for c in prints.columns], F.coalesce(F.col("c_class"), F.lit(0)).alias("class"))
    if classes is not None:
        same = [*same, "class"]
    sizes = cut_lineage(groups.groupBy(*[F.col(c).alias("g_" + c) for c in same]).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    ).filter("group_size > 1"))
    joined = groups.join(sizes, [F.col(c) == F.col("g_" + c) for c in same], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `docs` that stay, with their columns: of equal texts that with the smallest doc_id, once if repeated."""
    staying = exact_dedup(docs, key, text, **options).filter("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_of"))
    rows = docs.withColumn("_sha256", F.sha2(normalised(text).cast("binary"), 256))
    same = F.col(key).eqNullSafe(F.col("_id")) & (F.col("_sha256") == F.col("_of"))
    joined = rows.join(staying.distinct().hint("merge"), same, "left_semi")
    return joined.dropDuplicates([key, "_sha256"]).drop("_sha256")


def _classes(docs, prints, same, key, text, chunk_bytes) -> DataFrame | None:
    """None if all texts with equal fingerprints are equal. Else, for fingerprints shared by different texts, the class
    of every such text but those of class 0."""
    members = prints.filter(F.col("doc_id").isNotNull())
    firsts = cut_lineage(members.groupBy(*[F.col(c).alias("g_" + c) for c in same]).agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("rows")
    ).filter("rows > 1"))
    pending = cut_lineage(
        members.join(firsts, [F.col(c) == F.col("g_" + c) for c in same])
        .select("doc_id", "first_id", "text_sha256", *same)
    )
    found, number = None, 0
    texts = docs.select(F.col(key).alias("doc_id"), normalised(text).cast("binary").alias("bytes"))
    texts = texts.withColumn("n_bytes", F.length("bytes").cast("long"))
    while True:
        unequal = cut_lineage(_unequal(texts, pending, chunk_bytes).join(
            pending.select("doc_id", "text_sha256", *same).distinct(), ["doc_id", "text_sha256"]
        ))
        drop_stored(pending)
        if unequal.isEmpty():
            drop_stored(unequal)
            return found
        number += 1
        rows = unequal.select(*[F.col(c).alias("c_" + c) for c in same], F.col("text_sha256").alias("c_sha256")).distinct()
        # A later round's class overwrites the earlier one: what differs from each round's first text moves on.
        rows = rows.withColumn("c_class", F.lit(number))
        if found is not None:
            keys = [c for c in rows.columns if c != "c_class"]
            rows = found.unionByName(rows).groupBy(*keys).agg(F.max("c_class").alias("c_class"))
        found = cut_lineage(rows)
        firsts = unequal.groupBy(*[F.col(c).alias("g_" + c) for c in same]).agg(F.min("doc_id").alias("first_id"))
        pending = cut_lineage(
            unequal.join(firsts, [F.col(c) == F.col("g_" + c) for c in same])
            .select("doc_id", "first_id", "text_sha256", *same)
        )
        drop_stored(unequal)


def _unequal(texts: DataFrame, pending: DataFrame, chunk_bytes: int) -> DataFrame:
    """doc_id and digest of the pending texts that differ from their group's first text in any chunk."""
    # Always by a shuffle: the list of members grows with the corpus.
    wanted = pending.select("doc_id", "first_id").distinct().hint("merge")
    members = texts.join(wanted, "doc_id").withColumn("text_sha256", F.sha2("bytes", 256))
    chunks = cut_lineage(_chunked(members, chunk_bytes).drop("n_bytes", "after"))
    first = chunks.filter("doc_id = first_id").select(
        F.col("first_id").alias("of"), F.col("number").alias("at"), F.col("chunk").alias("expected")
    ).dropDuplicates(["of", "at"])
    others = chunks.filter("doc_id <> first_id")
    compared = others.join(first, (F.col("first_id") == F.col("of")) & (F.col("number") == F.col("at")), "left")
    differs = ~F.col("chunk").eqNullSafe(F.col("expected"))
    unequal = cut_lineage(compared.filter(differs).select("doc_id", "text_sha256").distinct())
    drop_stored(chunks)
    return unequal
