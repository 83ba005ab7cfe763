"""One query per operator or report, each over the whole provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from registry import tables as t
from seqloom.functions.columns import model_text, price_number
from seqloom.operators import clean as cl
from seqloom.operators import enrich as en
from seqloom.operators import evaluate as ev
from seqloom.operators import kcore as kc
from seqloom.operators import quantize as rq
from seqloom.operators import semantic_ids as si
from seqloom.operators import sequences as sq
from seqloom.operators import skew as sk
from seqloom.operators import tokens as tk
from seqloom.operators.itemtext import text_corpus
from seqloom.operators.prefixes import allowed_next as next_tokens
from seqloom.operators.prefixes import allowed_next_by_trie
from seqloom.operators.prefixes import prefix_table as build_prefix_table
from seqloom.operators.ranking import ranked
from seqloom.operators.vectors import embed, embed_by_worker, hashed_ngrams, vector_stats, standardize as standardize_vectors
from seqloom.plans.inspect import exchange_count, join_nodes, partition_filters, schema_listing
from seqloom.plans.reports import adaptive_comparison, enrich_strategies, kcore_strategies, repeat_cost
from seqloom.schemas import EOS, PAD
from seqloom.session import cut_lineage, scratch_path
from seqloom.sources.keyed import KeyedTable, join_by_key, store_by_key
from seqloom.sources.readers import (
    quarantine_report, read_interactions_checked, read_parquet, read_sequences, read_token_examples, read_valid_ids, union_all,
    user_sample,
)
from seqloom.sources.readers import row_hash_sample as sample_by_hash
from seqloom.sources.writers import write_json, write_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
HASH_PARTITIONS = 16
FIT_K, FIT_LEVELS = 32, 2
COPIED = 1_000_000
KS = (5, 10)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column: str, separator: str = " ") -> Column:
    """An array as text, in its order."""
    return F.array_join(F.col(column).cast("array<string>"), separator).alias(column)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six decimals, which both engines compute alike."""
    return df.select(*[F.round(n, 6).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


# Ingest


@query
def ingest_clean(spark, sf_dir):
    return t.clean(spark, sf_dir)


@query
def ingest_report(spark, sf_dir):
    return rounded(cl.ingest_report(t.raw_interactions(spark, sf_dir)))


@query
def ingest_by_category(spark, sf_dir):
    return cl.rows_by(t.clean(spark, sf_dir), "category")


@query
def ts_digits(spark, sf_dir):
    return cl.timestamp_digits(t.event_interactions(spark, sf_dir).unionByName(
        t.clean(spark, sf_dir).select("user_id", "parent_asin", "ts_ms", "category")
    ))


@query
def category_union(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem")

    def one(flag: str) -> DataFrame:
        rows = lines.filter(F.col("l_returnflag") == flag).select("l_orderkey", "l_linenumber", "l_quantity")
        return rows.withColumn("category", F.lit(flag))

    return union_all([one(flag) for flag in ("A", "N", "R")])


@query
def predicate_mix(spark, sf_dir):
    rows = t.clean(spark, sf_dir)
    liked = rows.filter(F.col("category") == "N").filter(F.col("rating") >= 4.0).filter(F.col("verified_purchase"))
    active = sq.users_with_rows(liked, 6, 10)
    return active.selectExpr(
        "count(1) as users",
        "sum(count) as rows",
        "percentile_approx(count, 0.5, 10000) as p50",
        "count(distinct count) as levels",
    )


@query
def scalar_filter(spark, sf_dir):
    t.clean(spark, sf_dir).createOrReplaceTempView("reviews")
    last_user = "user_id = (select max(user_id) from reviews where rating >= 5.0)"
    return spark.table("reviews").filter(last_user).select("user_id", "parent_asin", "ts_ms", "rating")


@query
def user_hash_sample(spark, sf_dir):
    return user_sample(t.clean(spark, sf_dir), kept=20, buckets=100).select("user_id", "parent_asin", "ts_ms")


@query
def row_hash_sample(spark, sf_dir):
    lines = t.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return sample_by_hash(lines, 0.1, ["l_orderkey", "l_linenumber"])


def checked_interactions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as JSON files, one folder per category. The sixth line of an order has a rating in words, and the seventh
    breaks off, so readers put both in quarantine."""
    raw = t.raw_interactions(spark, sf_dir)
    line = F.to_json(F.struct(*[name for name in raw.columns if name != "category"]))
    line = F.when(F.col("helpful_vote") == 6, F.regexp_replace(line, '"rating":[0-9.]+', '"rating":"high"')).otherwise(
        F.when(F.col("helpful_vote") == 7, F.substring(line, 1, 40)).otherwise(line)
    )
    folder = scratch_path(spark, "lines")
    for flag in ("A", "N", "R"):
        raw.filter(F.col("category") == flag).select(line).write.text(f"{folder}/{flag}")
    schema = "rating DOUBLE, asin BIGINT, parent_asin BIGINT, user_id BIGINT, timestamp BIGINT, helpful_vote BIGINT, verified_purchase BOOLEAN"
    return read_interactions_checked(spark, {flag: f"{folder}/{flag}" for flag in ("A", "N", "R")}, schema)


@query
def json_checked_rows(spark, sf_dir):
    return checked_interactions(spark, sf_dir)[0]


@query
def json_quarantine_report(spark, sf_dir):
    return rounded(quarantine_report(*checked_interactions(spark, sf_dir)))


# Layouts


def partitioned(spark: SparkSession, sf_dir: str) -> str:
    """A folder of the clean rows with one directory per category."""
    path = scratch_path(spark, "by-category")
    write_parquet(t.clean(spark, sf_dir).drop("event_ts"), path, partition_by="category")
    return path


@query
def partition_pruned_read(spark, sf_dir):
    """Reads one of the directories."""
    rows = read_parquet(spark, partitioned(spark, sf_dir), "category = 'N'")
    if "category" not in partition_filters(rows):
        raise AssertionError("directories are not skipped")
    return rows


@query
def partition_pruned_join(spark, sf_dir):
    """Reads the directories that a filter on the other side of a join leaves."""
    path = partitioned(spark, sf_dir)
    kinds = cut_lineage(
        read_parquet(spark, path).groupBy(F.col("category").alias("kind")).agg(F.count_if("verified_purchase").alias("verified"))
    )
    rows = read_parquet(spark, path).join(kinds.filter("verified = 0"), F.col("category") == F.col("kind")).drop("kind")
    if "dynamicpruning" not in partition_filters(rows):
        raise AssertionError("directories are not skipped")
    return rows


def by_user(spark: SparkSession, sf_dir: str, **options: int) -> KeyedTable:
    return store_by_key(t.clean(spark, sf_dir), "user_id", HASH_PARTITIONS, **options)


def without_exchange(df: DataFrame) -> DataFrame:
    if exchange_count(df):
        raise AssertionError("rows laid out by user are exchanged")
    return df


@query
def loo_split_bucketed(spark, sf_dir):
    """The split of rows that already lie by user."""
    placed = by_user(spark, sf_dir).ranked(["ts_ms", "parent_asin"], "pos", "seq_len")
    return without_exchange(sq.loo_labels(placed)).drop("event_ts")


@query
def loo_split_bucketed_hot(spark, sf_dir):
    """Users with more than 40 rows lie outside the buckets and are ranked in slices."""
    placed = by_user(spark, sf_dir, hot_rows=40).ranked(["ts_ms", "parent_asin"], "pos", "seq_len")
    return sq.loo_labels(placed).drop("event_ts")


@query
def user_totals_bucketed(spark, sf_dir):
    """An aggregate by user and its join with the rows."""
    table = by_user(spark, sf_dir)
    totals = table.totals(F.count(F.lit(1)).alias("user_rows"), F.max("ts_ms").alias("last_ts_ms"))
    return without_exchange(join_by_key(table, totals)).select("user_id", "parent_asin", "ts_ms", "user_rows", "last_ts_ms")


# k-core

CORE_COLUMNS = ("user_id", "parent_asin", "ts_ms", "rating", "category")


@query
def kcore_dense_k20(spark, sf_dir):
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 20).rows


@query
def kcore_losses(spark, sf_dir):
    """Losses are followed inside parts, and exchanged when no part can lose more by itself."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 23, strategy="peel").rows


@query
def kcore_losses_by_round(spark, sf_dir):
    """Losses are followed through several rounds."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 23, strategy="delta").rows


@query
def kcore_peel_hot_keys(spark, sf_dir):
    """Most users are dealt out over several parts."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 23, strategy="peel", hot_rows=25).rows


@query
def kcore_hot_keys(spark, sf_dir):
    """Most keys are hot, so they stay where they are."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 23, strategy="table", hot_rows=25).rows


@query
def kcore_dissolves_k24(spark, sf_dir):
    """Nothing is left, or little."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 24, strategy="peel").rows


@query
def kcore_dissolves_by_round(spark, sf_dir):
    """Rounds until nothing is left, or little; the edge table is rewritten on the way."""
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 24).rows


@query
def kcore_own_columns(spark, sf_dir):
    """Orders under their own column names: customers and the five order priorities."""
    orders = t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return kc.kcore(orders, 10, user="o_custkey", item="o_orderpriority").rows


@query
def kcore_empty_k30(spark, sf_dir):
    return kc.kcore(t.clean(spark, sf_dir).select(*CORE_COLUMNS), 30).rows


@query
def kcore_rounds(spark, sf_dir):
    return kc.kcore(t.clean(spark, sf_dir).select(kc.USER, kc.ITEM), 23).rounds.select("round", "rows")


@query
def kcore_report(spark, sf_dir):
    rows = t.clean(spark, sf_dir).select(kc.USER, kc.ITEM)
    return rounded(kc.kcore_report(rows, kc.kcore(rows, 23)))


@query
def kcore_strategy_report(spark, sf_dir):
    return kcore_strategies(t.clean(spark, sf_dir), 23, kc.STRATEGIES).drop("seconds")


# Sequences and split


@query
def sessionize(spark, sf_dir):
    return sq.sessionize(t.clean(spark, sf_dir).select("user_id", "parent_asin", "ts_ms"))


@query
def sessionize_events(spark, sf_dir):
    return sq.sessionize(t.event_interactions(spark, sf_dir))


@query
def sessionize_sliced(spark, sf_dir):
    """Every user with more than 20 rows is ranked in slices."""
    return sq.sessionize(t.clean(spark, sf_dir).select("user_id", "parent_asin", "ts_ms"), hot_rows=20)


@query
def user_sequences_chunked(spark, sf_dir):
    return sq.user_sequences(t.clean(spark, sf_dir), chunk_items=10).withColumn("items", joined("items"))


@query
def loo_split_own_columns(spark, sf_dir):
    orders = t.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return sq.loo_split(orders, "o_custkey", "o_orderkey", "o_orderdate").drop("o_orderdate")


@query
def dedup_items_own_column(spark, sf_dir):
    parts = t.items_with_copies(spark, sf_dir).withColumnRenamed("parent_asin", "sku").select("sku", "title", "store")
    return cl.dedup_items(parts, "sku")


@query
def user_sequences(spark, sf_dir):
    return sq.user_sequences(t.clean(spark, sf_dir)).withColumn("items", joined("items"))


@query
def loo_split(spark, sf_dir):
    return sq.loo_split(t.clean(spark, sf_dir)).drop("event_ts")


@query
def loo_report(spark, sf_dir):
    return sq.loo_report(sq.loo_split(t.clean(spark, sf_dir)))


@query
def example_user(spark, sf_dir):
    history = sq.example_history(sq.loo_split(t.event_interactions(spark, sf_dir)), 1, 200)
    return history.select("user_id", "parent_asin", "pos", "rev_pos", "split")


# Enrichment


def enriched(interactions: DataFrame, items: DataFrame, strategy: str) -> DataFrame:
    rows = en.enrich(interactions.select("user_id", "parent_asin", "ts_ms"), items, strategy)
    return rows.withColumn("description", joined("description", "|")).withColumn("categories", joined("categories", "|"))


@query
def enrich_merge(spark, sf_dir):
    return enriched(t.clean(spark, sf_dir), cl.dedup_items(t.items_with_copies(spark, sf_dir)), "merge")


@query
def enrich_broadcast(spark, sf_dir):
    return enriched(t.clean(spark, sf_dir), cl.dedup_items(t.items_with_copies(spark, sf_dir)), "broadcast")


@query
def enrich_reduced(spark, sf_dir):
    items = cl.dedup_items(t.items_with_copies(spark, sf_dir))
    return enriched(t.event_interactions(spark, sf_dir), items, "reduced_broadcast")


@query
def enrich_auto(spark, sf_dir):
    return enriched(t.event_interactions(spark, sf_dir), cl.dedup_items(t.items_with_copies(spark, sf_dir)), "auto")


@query
def enrich_over_limit(spark, sf_dir):
    """Metadata above the limit is merged, although a broadcast was asked for."""
    items = cl.dedup_items(t.items_with_copies(spark, sf_dir))
    rows = t.clean(spark, sf_dir).select("user_id", "parent_asin", "ts_ms")
    joined_rows = en.enrich(rows, items, "broadcast", broadcast_limit=1)
    if "SortMergeJoin" not in join_nodes(joined_rows):
        raise AssertionError("a join side above the limit was broadcast")
    return joined_rows.select("user_id", "parent_asin", "ts_ms", "title", "store")


@query
def interactions_from_json(spark, sf_dir):
    """Interactions written as JSON lines and parsed with the explicit schema, as the readers do."""
    raw = t.raw_interactions(spark, sf_dir)
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("line"), "category")
    schema = "rating DOUBLE, asin BIGINT, parent_asin BIGINT, user_id BIGINT, timestamp BIGINT, helpful_vote BIGINT, verified_purchase BOOLEAN"
    parsed = lines.select(F.from_json("line", schema).alias("r"), "category").select("r.*", "category")
    return cl.ingest(parsed)


@query
def used_items(spark, sf_dir):
    items = cl.dedup_items(t.items_with_copies(spark, sf_dir))
    used = en.used_items(items, t.event_interactions(spark, sf_dir))
    used = used.withColumn("description", joined("description", "|")).withColumn("categories", joined("categories", "|"))
    return used.withColumn("price_number", price_number())


@query
def used_items_reduced(spark, sf_dir):
    """Most unused items are left out before the exchange."""
    items = cl.dedup_items(t.items_with_copies(spark, sf_dir))
    used = en.reduced_items(items, t.event_interactions(spark, sf_dir))
    used = used.withColumn("description", joined("description", "|")).withColumn("categories", joined("categories", "|"))
    return used.withColumn("price_number", price_number())


@query
def join_plan_report(spark, sf_dir):
    items = cl.dedup_items(t.items_with_copies(spark, sf_dir))
    return enrich_strategies(t.clean(spark, sf_dir), items).select("strategy", "join_node", "rows", "matched")


@query
def aqe_report(spark, sf_dir):
    return adaptive_comparison(t.clean(spark, sf_dir)).drop("seconds")


@query
def repeat_cost_report(spark, sf_dir):
    liked = t.clean(spark, sf_dir).filter(F.col("verified_purchase")).groupBy("user_id").count()
    return repeat_cost(liked).drop("seconds")


@query
def clean_schema(spark, sf_dir):
    """Each column's name and type, and how many rows have it."""
    rows = t.clean(spark, sf_dir)
    filled = rows.agg(*[F.count(name).alias(name) for name in rows.columns])
    counts = filled.select(F.explode(F.create_map(*[x for n in rows.columns for x in (F.lit(n), F.col(n))])).alias("name", "filled"))
    return schema_listing(rows).join(counts, "name")


# Skew


@query
def user_skew(spark, sf_dir):
    return rounded(sk.key_skew(t.clean(spark, sf_dir), "user_id"))


@query
def item_skew(spark, sf_dir):
    return rounded(sk.key_skew(t.clean(spark, sf_dir), "parent_asin"))


@query
def hot_items(spark, sf_dir):
    return sk.hot_keys(t.clean(spark, sf_dir), "parent_asin", 5)


@query
def partition_skew(spark, sf_dir):
    rows = t.clean(spark, sf_dir)
    reports = [
        sk.partition_skew(rows, key, HASH_PARTITIONS).withColumn("key", F.lit(key)) for key in ("user_id", "parent_asin")
    ]
    return rounded(union_all(reports))


@query
def partition_layout(spark, sf_dir):
    """Rows per partition after a real shuffle by item."""
    layout = sk.partition_rows(t.clean(spark, sf_dir), "parent_asin", HASH_PARTITIONS, shuffle=True)
    return layout.select("pid", F.col("count").alias("rows"))


@query
def partition_skew_all(spark, sf_dir):
    regions = t.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"))
    return rounded(sk.partition_skew(regions, "nation", HASH_PARTITIONS, include_empty=True))


# Files between stages


@query
def sequences_read_back(spark, sf_dir):
    """Sequences written as JSON lines by the sequence stage and read by those after it."""
    path = scratch_path(spark, "sequences")
    write_json(sq.user_sequences(t.clean(spark, sf_dir)), path)
    read = read_sequences(spark, path).select(F.col("user_id").cast("bigint").alias("user_id"), "chunk", "items", "n", "n_train")
    return read.withColumn("items", joined("items"))


@query
def examples_read_back(spark, sf_dir):
    """Token examples written with one directory per split; one split is read. An example repeats most of the one before it, so
    the files are compressed."""
    path = scratch_path(spark, "examples")
    steps = tk.token_steps(t.clean(spark, sf_dir), t.tokens_by_item(spark, sf_dir))
    write_json(tk.examples(steps), path, partition_by="split", compression="gzip")
    read = read_token_examples(spark, path, "valid")
    return as_text(read.withColumn("user_id", F.col("user_id").cast("bigint")))


@query
def valid_ids_read_back(spark, sf_dir):
    path = scratch_path(spark, "ids")
    write_json(t.tokens_by_item(spark, sf_dir), path)
    return read_valid_ids(spark, path).select(F.col("parent_asin").cast("bigint").alias("parent_asin"), joined("tokens"))


@query
def layout_read_back(spark, sf_dir):
    """Labelled rows written with one directory per split, and item texts in a stated number of files."""
    rows, texts = scratch_path(spark, "split"), scratch_path(spark, "texts")
    write_parquet(sq.loo_split(t.clean(spark, sf_dir)).drop("event_ts"), rows, partition_by="split")
    write_parquet(text_corpus(t.items(spark, sf_dir)), texts, files=3)
    labelled = read_parquet(spark, rows, "split = 'test'").select("user_id", "parent_asin", "pos", "split")
    return labelled.join(read_parquet(spark, texts), "parent_asin")


# Item text, vectors and semantic IDs


@query
def item_text(spark, sf_dir):
    return text_corpus(cl.dedup_items(t.items_with_copies(spark, sf_dir)))


@query
def model_text_limited(spark, sf_dir):
    """The input of an encoder that states a limit of twenty characters."""
    return text_corpus(t.items(spark, sf_dir)).select("parent_asin", model_text("text", 20).alias("text"))


@query
def embed_items(spark, sf_dir):
    vectors = embed(text_corpus(t.items(spark, sf_dir)))
    return vectors.select("parent_asin", F.posexplode("embedding").alias("bucket", "ngrams")).filter("ngrams > 0").select(
        "parent_asin", "bucket", F.col("ngrams").cast("double").alias("ngrams")
    )


@query
def standardize(spark, sf_dir):
    vectors = standardize_vectors(t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rounded(vectors.select("vec_id", F.posexplode("embedding").alias("dim", "z")))


def started_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; those with the first FIT_K numbers are the starting rows of the fit."""
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.withColumn("start", F.when(F.col("vec_id") < FIT_K, F.col("vec_id").cast("int")))


@query
def rq_fit(spark, sf_dir):
    vectors = started_vectors(spark, sf_dir)
    books = rq.fit_codebooks(vectors, FIT_LEVELS, FIT_K, iterations=2, start="start")
    return rounded(rq.reconstruction_error(rq.quantize(vectors, books), dim=books[0].shape[1]))


@query
def rq_revive(spark, sf_dir):
    """A fit whose last eight starting rows are copies of others, so that their codes have no rows and move to spare ones."""
    vectors = t.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    twice = F.col("vec_id").between(FIT_K - 16, FIT_K - 9)
    copies = vectors.filter(twice).withColumn("vec_id", F.col("vec_id") + COPIED).withColumn("start", (F.col("vec_id") - COPIED + 8).cast("int"))
    rows = vectors.withColumn("start", F.when(F.col("vec_id") < FIT_K - 8, F.col("vec_id").cast("int"))).unionByName(copies)
    spare = F.when(F.col("vec_id").between(100, 139), (F.col("vec_id") - 100).cast("int"))
    books = rq.fit_codebooks(rows.withColumn("spare", spare), FIT_LEVELS, FIT_K, iterations=3, start="start", spare="spare")
    coded = rq.quantize(rows, books)
    errors = [F.get("sq_error", F.lit(level)).alias(f"e{level + 1}") for level in range(FIT_LEVELS)]
    return rounded(coded.select("vec_id", joined("codes"), *errors))


@query
def embed_items_by_worker(spark, sf_dir):
    vectors = embed_by_worker(text_corpus(t.items(spark, sf_dir)), hashed_ngrams())
    return vectors.select("parent_asin", F.posexplode("embedding").alias("bucket", "ngrams")).filter("ngrams > 0").select(
        "parent_asin", "bucket", F.col("ngrams").cast("double").alias("ngrams")
    )


@query
def assign_with_stored_fit(spark, sf_dir):
    """A fit and its statistics go to a table and come back before items get their codes."""
    vectors = started_vectors(spark, sf_dir)
    mean, std = vector_stats(vectors)
    fit = rq.fit_codebooks(standardize_vectors(vectors, stats=(mean, std)), FIT_LEVELS, FIT_K, iterations=2, start="start")
    stored = cut_lineage(rq.model_table(spark, fit, mean, std))
    books, mean, std = rq.model_from_table(stored)
    coded = rq.quantize(standardize_vectors(vectors, stats=(mean, std)), books)
    return coded.select("vec_id", joined("codes"))


@query
def rq_error(spark, sf_dir):
    vectors = t.item_vectors(spark, sf_dir)
    books = t.fixed_codebooks(spark, sf_dir)
    return rounded(rq.reconstruction_error(rq.quantize(vectors, books), dim=books[0].shape[1]))


@query
def rq_assign(spark, sf_dir):
    coded = t.coded_items(spark, sf_dir)
    errors = [F.get("sq_error", F.lit(level)).alias(f"e{level + 1}") for level in range(t.LEVELS)]
    return rounded(coded.select("parent_asin", joined("codes"), *errors))


@query
def semantic_ids(spark, sf_dir):
    return t.item_sids(spark, sf_dir)


@query
def sid_report(spark, sf_dir):
    return si.collision_report(t.item_sids(spark, sf_dir))


@query
def sid_utilisation(spark, sf_dir):
    return rounded(si.utilisation(t.item_sids(spark, sf_dir), t.K))


# Tokens


@query
def item_tokens(spark, sf_dir):
    return t.tokens_by_item(spark, sf_dir).select("parent_asin", joined("tokens"))


def token_examples(spark: SparkSession, sf_dir: str, split: str, shared: bool = True) -> DataFrame:
    steps = tk.token_steps(t.clean(spark, sf_dir), t.tokens_by_item(spark, sf_dir, shared))
    return tk.examples(steps, [split])


def as_text(made: DataFrame) -> DataFrame:
    return made.select("user_id", "t", "split", joined("inp"), joined("tgt"))


@query
def token_train(spark, sf_dir):
    return as_text(token_examples(spark, sf_dir, "train"))


@query
def token_valid(spark, sf_dir):
    return as_text(token_examples(spark, sf_dir, "valid"))


@query
def token_test(spark, sf_dir):
    return as_text(token_examples(spark, sf_dir, "test"))


@query
def token_test_missing_ids(spark, sf_dir):
    return as_text(token_examples(spark, sf_dir, "test", shared=False))


@query
def token_blocks(spark, sf_dir):
    """Blocks of twenty targets instead of one for most histories."""
    steps = tk.token_steps(t.clean(spark, sf_dir), t.tokens_by_item(spark, sf_dir))
    return as_text(tk.examples(steps, ["train"], block=20))


@query
def token_report(spark, sf_dir):
    rows = t.clean(spark, sf_dir)
    return tk.example_report(tk.token_steps(rows, t.tokens_by_item(spark, sf_dir, shared=False)), rows)


@query
def model_input(spark, sf_dir):
    made = tk.model_input(token_examples(spark, sf_dir, "valid", shared=False))
    return made.select("user_id", "t", "split", joined("input_ids"), joined("attention_mask", ""), joined("labels"))


@query
def token_vocabulary(spark, sf_dir):
    n_items = t.tokens_by_item(spark, sf_dir).count()
    return tk.vocabulary(spark, n_items).withColumn("layer_offsets", joined("layer_offsets"))


@query
def prefix_table(spark, sf_dir):
    table = build_prefix_table(t.tokens_by_item(spark, sf_dir))
    return table.select("depth", joined("prefix"), joined("next"))


def asked_prefixes(tokens: DataFrame) -> DataFrame:
    """Prefixes of all lengths, and some that no item has."""
    known = F.slice("tokens", 1, (F.col("parent_asin") % 5).cast("int"))
    swapped = F.reverse(F.slice("tokens", 1, 2))
    return tokens.select("parent_asin", F.when(F.col("parent_asin") % 7 == 0, swapped).otherwise(known).alias("prefix"))


@query
def allowed_next(spark, sf_dir):
    tokens = t.tokens_by_item(spark, sf_dir)
    found = next_tokens(asked_prefixes(tokens), build_prefix_table(tokens))
    return found.select("parent_asin", joined("prefix"), joined("next"))


@query
def allowed_next_trie(spark, sf_dir):
    tokens = cut_lineage(t.tokens_by_item(spark, sf_dir))
    return allowed_next_by_trie(asked_prefixes(tokens), tokens).select("parent_asin", joined("prefix"), joined("next"))


# Evaluation


@query
def popularity_topk(spark, sf_dir):
    return ev.popularity_topk(sq.loo_split(t.clean(spark, sf_dir)), 10)


def popularity_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = sq.loo_split(t.clean(spark, sf_dir))
    return ev.evaluate_shared(ev.test_targets(labelled), ev.popularity_topk(labelled, max(KS)), KS)


@query
def first_targets(spark, sf_dir):
    """The test items of the first fifty users, as a capped evaluation takes them."""
    return ev.test_targets(sq.loo_split(t.clean(spark, sf_dir)), 50)


@query
def popularity_eval(spark, sf_dir):
    return rounded(popularity_metrics(spark, sf_dir))


def repeat_candidates(labelled: DataFrame, tokens: DataFrame) -> DataFrame:
    """Each user's most frequent training items as decoded token strings, with the end and padding a decoder leaves."""
    train = labelled.filter(F.col("split") == "train")
    counts = train.groupBy("user_id", "parent_asin").agg((-F.count(F.lit(1))).alias("fewer"))
    placed = ranked(counts, ["user_id"], ["fewer", "parent_asin"]).filter(F.col("pos") <= max(KS))
    decoded = placed.join(tokens, "parent_asin")
    noisy = F.concat(F.array(F.lit(PAD)), "tokens", F.array(F.lit(EOS), F.lit(PAD)))
    return decoded.select("user_id", (F.col("pos") - 1).alias("rank"), noisy.alias("tokens"))


def repeat_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Labelled rows and item tokens, each computed once."""
    return cut_lineage(sq.loo_split(t.clean(spark, sf_dir))), cut_lineage(t.tokens_by_item(spark, sf_dir))


def repeat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled, tokens = repeat_inputs(spark, sf_dir)
    truth = ev.test_targets(labelled).join(tokens, "parent_asin").select("user_id", "tokens")
    return ev.evaluate(truth, ev.decoded(repeat_candidates(labelled, tokens)), KS, key="tokens")


@query
def ranked_eval(spark, sf_dir):
    return rounded(repeat_metrics(spark, sf_dir))


@query
def sid_to_item(spark, sf_dir):
    labelled, tokens = repeat_inputs(spark, sf_dir)
    candidates = ev.decoded(repeat_candidates(labelled, tokens))
    return ev.tokens_to_items(candidates, tokens).select("user_id", "rank", "parent_asin")


@query
def eval_compare(spark, sf_dir):
    return rounded(ev.compare(repeat_metrics(spark, sf_dir), popularity_metrics(spark, sf_dir)))
