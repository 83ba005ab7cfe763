"""Command line for the stages, each reading and writing files: `python -m seqloom.jobs STAGE --help`."""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import clean as cl
from seqloom.operators import evaluate as ev
from seqloom.operators import quantize as rq
from seqloom.operators import sequences as sq
from seqloom.operators import skew as sk
from seqloom.operators import tokens as tk
from seqloom.operators.enrich import STRATEGIES as JOIN_STRATEGIES
from seqloom.operators.enrich import enrich, used_items
from seqloom.operators.itemtext import text_corpus
from seqloom.operators.kcore import STRATEGIES as CORE_STRATEGIES
from seqloom.operators.kcore import kcore, kcore_report
from seqloom.operators.semantic_ids import collision_report, semantic_ids, utilisation
from seqloom.operators.prefixes import prefix_table
from seqloom.operators.vectors import embed, standardize, vector_stats
from seqloom.plans.inspect import join_nodes
from seqloom.plans.reports import adaptive_comparison, enrich_strategies, kcore_strategies
from seqloom.schemas import ITEM, USER
from seqloom.session import build_session, cut_lineage
from seqloom.sources import readers as rd
from seqloom.sources import writers as wr


def show(title: str, report: DataFrame) -> None:
    print(title)
    report.show(truncate=False)


def run_ingest(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = dict(entry.split("=", 1) for entry in args.input)
    if args.quarantine:
        raw, malformed = rd.read_interactions_checked(spark, paths)
        wr.write_json(malformed, args.quarantine)
        show("malformed lines", rd.quarantine_report(raw, malformed))
    else:
        raw = rd.read_interactions(spark, paths)
    raw = rd.row_hash_sample(raw, args.fraction, [USER, ITEM, "timestamp"]) if args.fraction < 1.0 else raw
    # The raw rows are counted while they are parsed, once; everything else comes from the written table.
    counted = Observation("raw")
    cleaned = cl.ingest(cl.require_keys(raw).observe(counted, F.count(F.lit(1)).alias("rows")))
    if args.out:
        wr.write_parquet(cleaned, args.out, partition_by="category")
        clean = spark.read.parquet(args.out)
    else:
        clean = cut_lineage(cleaned)
    clean.printSchema()
    show("first rows", clean.orderBy("ts_ms", USER, ITEM).limit(args.preview))
    show("ingest", cl.clean_report(clean, counted.get["rows"]))
    show("rows per category", cl.rows_by(clean, "category"))
    show("timestamp digits", cl.timestamp_digits(clean))


def run_kcore(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    if args.compare:
        show("strategies", kcore_strategies(rows, args.k, CORE_STRATEGIES, args.max_rounds))
    core = kcore(rows, args.k, args.max_rounds, args.strategy)
    show("rounds", core.rounds)
    if args.out:
        wr.write_parquet(core.rows, args.out)
        core.rows = spark.read.parquet(args.out)
    show("core", kcore_report(rows, core))


def run_sessionize(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    for key in (USER, ITEM):
        show(f"rows per {key}", sk.key_skew(rows, key))
        show(f"rows per partition by {key}", sk.partition_skew(rows, key, args.partitions))
    show("hottest items", sk.hot_keys(rows, ITEM))
    if args.out:
        wr.write_parquet(sq.sessionize(rows), args.out)


def run_enrich(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    items = cl.dedup_items(rd.read_items(spark, args.items))
    if args.compare:
        items = cut_lineage(items)
        show("strategies", enrich_strategies(rows, items))
    joined = enrich(rows, items, args.strategy)
    print("join operators:", ", ".join(join_nodes(joined)))
    if args.out:
        wr.write_parquet(joined, args.out, partition_by="category")
    else:
        wr.discard(joined)


def run_split(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    if args.compare:
        show("adaptive execution", adaptive_comparison(rows))
    labelled = sq.loo_split(rows)
    if args.out:
        wr.write_parquet(labelled, args.out, partition_by="split")
        labelled = spark.read.parquet(args.out)
    show("split", sq.loo_report(labelled))
    if args.items_out:
        items = cl.dedup_items(rd.read_items(spark, args.items))
        wr.write_parquet(used_items(items, rows), args.items_out)


def run_sequences(spark: SparkSession, args: argparse.Namespace) -> None:
    wr.write_json(sq.user_sequences(spark.read.parquet(args.input), chunk_items=args.chunk_items), args.out)


def run_text(spark: SparkSession, args: argparse.Namespace) -> None:
    wr.write_parquet(text_corpus(spark.read.parquet(args.input)), args.out, files=args.files)


def run_embed(spark: SparkSession, args: argparse.Namespace) -> None:
    texts = spark.read.parquet(args.input)
    module, _, name = args.encoder.partition(":")
    factory = getattr(importlib.import_module(module), name)
    wr.write_parquet(embed(texts, factory(), batch=args.batch, max_chars=args.max_chars), args.out)


def run_semantic_ids(spark: SparkSession, args: argparse.Namespace) -> None:
    raw = spark.read.parquet(args.input)
    if args.model_in:
        books, mean, std = rq.model_from_table(spark.read.parquet(args.model_in))
        vectors = standardize(raw, stats=(mean, std))
    else:
        mean, std = vector_stats(raw)
        vectors = cut_lineage(standardize(raw, stats=(mean, std)))
        books = rq.fit_codebooks(vectors, args.levels, args.k, args.iterations)
    if args.model_out:
        wr.write_parquet(rq.model_table(spark, books, mean, std), args.model_out, files=1)
    # Stored, because the error report and the ID table both read the codes.
    coded = cut_lineage(rq.quantize(vectors, books).drop("embedding"))
    show("reconstruction error", rq.reconstruction_error(coded, books[0].shape[1]).orderBy("level"))
    codes = tuple(f"c{level + 1}" for level in range(len(books)))
    wr.write_parquet(semantic_ids(coded, codes=codes), args.out)
    stored = spark.read.parquet(args.out)
    show("codes in use", utilisation(stored, args.k, codes).orderBy("level"))
    show("collisions", collision_report(stored, codes))


def run_tokens(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.parquet(args.input)
    tokens = tk.item_tokens(spark.read.parquet(args.ids))
    # Examples and report both read the steps.
    steps = cut_lineage(tk.token_steps(rows, tokens))
    wr.write_json(tk.examples(steps), f"{args.out}/examples", partition_by="split")
    wr.write_json(tokens, f"{args.out}/valid_ids")
    wr.write_json(prefix_table(tokens), f"{args.out}/prefixes")
    wr.write_json(tk.vocabulary(spark, tokens.count()), f"{args.out}/vocabulary")
    show("examples", tk.example_report(steps, rows))


def run_popularity(spark: SparkSession, args: argparse.Namespace) -> None:
    labelled = spark.read.parquet(args.input)
    top = ev.popularity_topk(labelled, max(args.ks))
    show("popularity", ev.evaluate_shared(ev.test_targets(labelled, args.max_users), top, args.ks))


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> None:
    truth = rd.read_token_examples(spark, f"{args.tokens}/examples", "test", args.max_users)
    candidates = ev.decoded(spark.read.parquet(args.input))
    truth = truth.select(USER, F.col("tgt").alias("tokens"))
    show("candidates", ev.evaluate(truth, candidates, args.ks, key="tokens"))


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="seqloom.jobs")
    main.add_argument("--cores", type=int, help="run locally on this many threads")
    main.add_argument("--memory", help="driver memory, for local runs")
    main.add_argument("--shuffle-partitions", type=int)
    main.add_argument("--no-adaptive", action="store_true")
    stages = main.add_subparsers(required=True, metavar="STAGE")

    def stage(name: str, run, out_required: bool = False) -> argparse.ArgumentParser:
        sub = stages.add_parser(name)
        sub.set_defaults(run=run)
        sub.add_argument("--out", required=out_required)
        return sub

    def ks(text: str) -> list[int]:
        return [int(k) for k in text.split(",")]

    sub = stage("ingest", run_ingest)
    sub.add_argument("--input", action="append", required=True, metavar="CATEGORY=PATH")
    sub.add_argument("--fraction", type=float, default=1.0, help="share of rows kept, by a hash of their key")
    sub.add_argument("--quarantine", help="folder for malformed lines, which are else read as far as they go")
    sub.add_argument("--preview", type=int, default=5)
    sub = stage("kcore", run_kcore)
    sub.add_argument("--input", required=True)
    sub.add_argument("--k", type=int, default=5)
    sub.add_argument("--max-rounds", type=int, help="fail if the core takes more rounds")
    sub.add_argument("--compare", action="store_true", help="time every strategy first")
    sub.add_argument("--strategy", choices=(*CORE_STRATEGIES, "peel"), default="delta")
    sub = stage("sessionize", run_sessionize)
    sub.add_argument("--input", required=True)
    sub.add_argument("--partitions", type=int, default=256)
    sub = stage("enrich", run_enrich)
    sub.add_argument("--input", required=True)
    sub.add_argument("--items", nargs="+", required=True)
    sub.add_argument("--strategy", choices=JOIN_STRATEGIES, default="auto")
    sub.add_argument("--compare", action="store_true", help="time every strategy first")
    sub = stage("split", run_split)
    sub.add_argument("--input", required=True)
    sub.add_argument("--items", nargs="+")
    sub.add_argument("--items-out")
    sub.add_argument("--compare", action="store_true", help="time adaptive execution off and on")
    sub = stage("sequences", run_sequences, out_required=True)
    sub.add_argument("--input", required=True)
    sub.add_argument("--chunk-items", type=int, default=sq.CHUNK_ITEMS, help="items in one row; longer histories take more rows")
    sub = stage("text", run_text, out_required=True)
    sub.add_argument("--input", required=True)
    sub.add_argument("--files", type=int)
    sub = stage("embed", run_embed, out_required=True)
    sub.add_argument("--input", required=True)
    sub.add_argument("--batch", type=int, default=256)
    sub.add_argument("--max-chars", type=int)
    sub.add_argument("--encoder", default="seqloom.operators.vectors:hashed_ngrams", metavar="MODULE:MAKER",
                     help="a function that returns the factory each task makes its encoder with")
    sub = stage("semantic-ids", run_semantic_ids, out_required=True)
    sub.add_argument("--input", required=True)
    sub.add_argument("--levels", type=int, default=3)
    sub.add_argument("--k", type=int, default=256)
    sub.add_argument("--iterations", type=int, default=10)
    sub.add_argument("--model-out", help="write codebooks, mean and deviation here")
    sub.add_argument("--model-in", help="assign with a model written before instead of fitting one")
    sub = stage("tokens", run_tokens, out_required=True)
    sub.add_argument("--input", required=True)
    sub.add_argument("--ids", required=True)
    sub = stage("popularity", run_popularity)
    sub.add_argument("--input", required=True)
    sub.add_argument("--ks", type=ks, default=[5, 10])
    sub.add_argument("--max-users", type=int)
    sub = stage("evaluate", run_evaluate)
    sub.add_argument("--input", required=True, help="Parquet of (user_id, rank, tokens)")
    sub.add_argument("--tokens", required=True, help="output folder of the tokens stage")
    sub.add_argument("--ks", type=ks, default=[5, 10])
    sub.add_argument("--max-users", type=int)
    return main


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session("seqloom", args.cores, args.memory, args.shuffle_partitions, not args.no_adaptive)
    args.run(spark, args)


if __name__ == "__main__":
    main()
