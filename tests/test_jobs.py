"""All stages in a row, from JSON lines to metrics."""

import json
import random

import pytest
from pyspark.sql import functions as F

from seqloom.jobs import main, parser


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("stages")


def test_stages_chain_through_files(spark, folder, capsys):
    rng = random.Random(0)
    for name in ("books", "toys"):
        with open(folder / f"{name}.jsonl", "w") as file:
            for _ in range(400):
                user, item = f"u{rng.randrange(30)}", f"{name[0]}{rng.randrange(20)}"
                row = {"user_id": user, "parent_asin": item, "asin": item, "rating": 5.0, "timestamp": 10**12 + rng.randrange(900)}
                file.write(json.dumps(row) + "\n")
        with open(folder / f"meta_{name}.jsonl", "w") as file:
            for i in range(25):
                row = {"parent_asin": f"{name[0]}{i}", "title": f"{name} number {i}", "categories": [name], "price": i}
                file.write(json.dumps(row) + "\n")
    at = lambda name: str(folder / name)
    metas = [at("meta_books.jsonl"), at("meta_toys.jsonl")]
    main(["ingest", "--input", f"books={at('books.jsonl')}", "--input", f"toys={at('toys.jsonl')}", "--out", at("clean")])
    main(["kcore", "--input", at("clean"), "--k", "5", "--out", at("core"), "--compare"])
    main(["sessionize", "--input", at("core"), "--partitions", "4", "--out", at("placed")])
    main(["enrich", "--input", at("core"), "--items", *metas, "--out", at("joined")])
    main(["split", "--input", at("core"), "--compare", "--out", at("split"), "--items", *metas, "--items-out", at("items")])
    main(["sequences", "--input", at("split"), "--out", at("sequences")])
    main(["text", "--input", at("items"), "--files", "2", "--out", at("text")])
    main(["embed", "--input", at("text"), "--out", at("vectors")])
    main(["semantic-ids", "--input", at("vectors"), "--k", "4", "--iterations", "2", "--out", at("ids"), "--model-out", at("model")])
    main(["semantic-ids", "--input", at("vectors"), "--model-in", at("model"), "--out", at("ids_again")])
    assert spark.read.parquet(at("ids")).exceptAll(spark.read.parquet(at("ids_again"))).isEmpty()
    main(["tokens", "--input", at("split"), "--ids", at("ids"), "--out", at("tokens")])
    main(["popularity", "--input", at("split"), "--ks", "1,40"])
    assert spark.read.json(at("tokens/prefixes")).filter("depth = 0").count() == 1
    users = spark.read.parquet(at("split")).select("user_id").distinct().count()
    steps = spark.read.json(at("tokens/examples"))
    assert steps.filter("split = 'test'").count() == users
    right = steps.filter("split = 'test'").select("user_id", F.lit(0).alias("rank"), F.col("tgt").cast("array<int>").alias("tokens"))
    right.write.parquet(at("candidates"))
    main(["evaluate", "--input", at("candidates"), "--tokens", at("tokens"), "--ks", "1"])
    out = capsys.readouterr().out
    assert f"|1  |{users}   |1.0   |1.0 |" in out and "BroadcastHashJoin" in out
    items = spark.read.parquet(at("items")).count()
    assert spark.read.parquet(at("ids")).count() == items == spark.read.json(at("tokens/valid_ids")).count()
    assert spark.read.json(at("sequences")).count() == users
    joined = spark.read.parquet(at("joined"))
    assert joined.filter("title is null").isEmpty() and joined.count() == spark.read.parquet(at("core")).count()


def test_ingest_puts_malformed_lines_aside(spark, folder, capsys):
    path = folder / "mixed.jsonl"
    good = [{"user_id": f"u{n}", "parent_asin": "i", "timestamp": n, "rating": 1.0} for n in range(60)]
    path.write_text("\n".join([*map(json.dumps, good), "broken {", '{"user_id": "u", "rating": "high"}']) + "\n")
    at = lambda name: str(folder / name)
    main(["ingest", "--input", f"x={path}", "--out", at("kept"), "--quarantine", at("aside"), "--fraction", "0.5"])
    assert spark.read.json(at("aside")).count() == 2 and "|x       |60  |2        |" in capsys.readouterr().out
    assert 15 < spark.read.parquet(at("kept")).count() < 45


def test_stage_is_required():
    with pytest.raises(SystemExit):
        parser().parse_args([])
