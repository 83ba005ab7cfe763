"""Explicit-schema reads of awkward files, and round trips through every sink."""

import json

from pyspark.sql import functions as F

from seqloom.functions.columns import item_text, price_number
from seqloom.operators import clean as cl
from seqloom.operators import sequences as sq
from seqloom.operators import tokens as tk
from seqloom.operators.enrich import enrich
from seqloom.plans.inspect import schema_listing
from seqloom.schemas import CLEAN_COLUMNS, INTERACTION_SCHEMA, ITEM_COLUMNS, ITEM_SCHEMA
from seqloom.sources import readers as rd
from seqloom.sources import writers as wr


def write_lines(folder, name, rows):
    path = folder / name
    path.write_text("\n".join(row if isinstance(row, str) else json.dumps(row) for row in rows) + "\n")
    return str(path)


def interaction(user, item, ts, **other):
    return {"user_id": user, "parent_asin": item, "timestamp": ts, "rating": 5.0, "asin": item, **other}


def test_bad_interaction_fields_become_null_and_the_rest_stays(spark, tmp_path):
    rows = [
        interaction("u1", "i1", 1_600_000_000_000, text="dropped", images=[1]),
        interaction("u2", "i2", 1_600_000_000_001, rating="five"),
        interaction("u3", "i3", "yesterday"),
        interaction("u4", "i4", 1.5),
        "not json at all",
        interaction("u5", 12345, 1_600_000_000_002),
        interaction(None, "i6", 1_600_000_000_003),
    ]
    df = rd.read_json(spark, write_lines(tmp_path, "a.jsonl", rows), INTERACTION_SCHEMA)
    assert df.columns == [
        "rating", "asin", "parent_asin", "user_id", "timestamp", "helpful_vote", "verified_purchase",
    ]
    by_user = {row["user_id"]: row for row in df.collect() if row["user_id"]}
    assert df.count() == 7
    assert by_user["u2"]["rating"] is None and by_user["u2"]["timestamp"] == 1_600_000_000_001
    assert by_user["u3"]["timestamp"] is None and by_user["u4"]["timestamp"] is None
    assert by_user["u3"]["rating"] == 5.0
    assert by_user["u5"]["parent_asin"] == "12345"
    assert {row["user_id"] for row in cl.require_keys(df).collect()} == {"u1", "u2", "u5"}


def test_bad_metadata(spark, tmp_path):
    rows = [
        '{"parent_asin": "a", "price": 12.50, "title": "A", "description": ["x", null, "y"], "categories": ["c"]}',
        {"parent_asin": "b", "price": None, "description": [], "title": None},
        {"parent_asin": "c", "price": "from 9.99", "description": "scalar", "title": "C", "store": "S"},
        {"parent_asin": None, "title": "no key"},
    ]
    items = rd.read_json(spark, write_lines(tmp_path, "m.jsonl", rows), ITEM_SCHEMA)
    found = {row["parent_asin"]: row for row in items.select("*", item_text().alias("text"), price_number().alias("p")).collect()}
    assert found["a"]["price"] == "12.50" and found["a"]["p"] == 12.5
    assert found["a"]["text"] == "A. c. . x y"
    assert found["b"]["price"] is None and found["b"]["text"] == ". . . "
    assert found["c"]["description"] is None and found["c"]["text"] == "C. . S. " and found["c"]["p"] is None
    kept = cl.dedup_items(items)
    assert kept.columns == list(ITEM_COLUMNS) and kept.count() == 3


def test_ingest_from_one_file_per_category(spark, tmp_path):
    first = [interaction("u1", "i1", 1_000, rating=2.0), interaction("u1", "i1", 1_000, rating=1.0)]
    second = [interaction("u1", "i1", 2_000), interaction("u2", "i1", 1_000)]
    raw = rd.read_interactions(
        spark,
        {"books": write_lines(tmp_path, "b.jsonl", first), "toys": write_lines(tmp_path, "t.jsonl", second)},
    )
    clean = cl.ingest(raw)
    assert clean.columns == list(CLEAN_COLUMNS)
    rows = {(r["user_id"], r["ts_ms"]): r for r in clean.collect()}
    assert len(rows) == 3 and rows["u1", 1_000]["rating"] == 1.0
    assert rows["u1", 1_000]["category"] == "books" and rows["u2", 1_000]["category"] == "toys"
    assert rows["u2", 1_000]["event_ts"].timestamp() == 1.0
    report = cl.ingest_report(raw).first()
    assert (report["raw_rows"], report["rows"], report["removed"]) == (4, 3, 1)
    assert report["removed_pct"] == 25.0 and report["rows_per_user"] == 1.5


def test_reports_on_no_rows(spark):
    none = spark.createDataFrame([], INTERACTION_SCHEMA).withColumn("category", F.lit("x"))
    report = cl.ingest_report(none).first()
    assert report["raw_rows"] == 0 and report["removed_pct"] == 0.0 and report["rows_per_user"] == 0.0
    assert cl.ingest(none).count() == 0


def test_partitioned_write_prunes_on_read(spark, tmp_path):
    rows = [(u, i, 1.0, 10 * i, "c") for u in range(5) for i in range(4)]
    clean = spark.createDataFrame(rows, "user_id BIGINT, parent_asin BIGINT, rating DOUBLE, ts_ms BIGINT, category STRING")
    labelled = sq.loo_split(clean)
    path = str(tmp_path / "split")
    wr.write_parquet(labelled, path, partition_by="split")
    test_rows = rd.read_parquet(spark, path, "split = 'test'")
    assert test_rows.count() == 5
    plan = test_rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    wr.write_parquet(clean, path, files=2)
    assert spark.read.parquet(path).rdd.getNumPartitions() <= 2 and len(list((tmp_path / "split").glob("*.parquet"))) <= 2
    wr.discard(labelled)


def test_joined_output_partitioned_by_category(spark, tmp_path):
    clean = spark.createDataFrame([("u", "i", 1, "c1"), ("u", "j", 2, "c2")], "user_id STRING, parent_asin STRING, ts_ms BIGINT, category STRING")
    items = spark.createDataFrame([("i", "title")], "parent_asin STRING, title STRING")
    path = str(tmp_path / "joined")
    wr.write_parquet(enrich(clean, items), path, partition_by="category")
    rows = {r["parent_asin"]: r for r in rd.read_parquet(spark, path).collect()}
    assert rows["i"]["title"] == "title" and rows["j"]["title"] is None and rows["j"]["category"] == "c2"


def test_json_hand_off_files(spark, tmp_path):
    clean = spark.createDataFrame(
        [(f"u{u}", f"i{i}", 10 * i) for u in range(3) for i in range(5)],
        "user_id STRING, parent_asin STRING, ts_ms BIGINT",
    )
    sequences = sq.user_sequences(clean)
    wr.write_json(sequences, str(tmp_path / "seq"))
    back = {r["user_id"]: r for r in rd.read_sequences(spark, str(tmp_path / "seq")).collect()}
    assert back["u1"]["items"] == [f"i{i}" for i in range(5)] and back["u1"]["n"] == 5 and back["u1"]["n_train"] == 3

    tokens = spark.createDataFrame(
        [(f"i{i}", [i, 256 + i, 512, 768]) for i in range(5)], "parent_asin STRING, tokens ARRAY<INT>"
    )
    made = tk.examples(tk.token_steps(clean, tokens))
    wr.write_json(made, str(tmp_path / "tok"), partition_by="split")
    train = rd.read_token_examples(spark, str(tmp_path / "tok"), "train")
    assert train.count() == 3 * 2
    first = rd.read_token_examples(spark, str(tmp_path / "tok"), "train", max_examples=1).collect()
    assert len(first) == 1 and first[0]["user_id"] == "u0" and first[0]["t"] == 1
    assert first[0]["inp"] == [1025, 0, 256, 512, 768] and first[0]["tgt"] == [1, 257, 512, 768]
    wr.write_json(tokens, str(tmp_path / "ids"))
    assert rd.read_valid_ids(spark, str(tmp_path / "ids")).count() == 5


def test_samples(spark):
    df = spark.range(10_000).select((F.col("id") % 500).alias("user_id"))
    assert rd.bernoulli_sample(df, 1.0) is df
    assert 700 < rd.bernoulli_sample(df, 0.1).count() < 1300
    kept = rd.user_sample(df, 20, 100)
    assert kept.groupBy("user_id").count().filter("count <> 20").isEmpty()
    assert 60 < kept.select("user_id").distinct().count() < 140
    again = rd.user_sample(df.repartition(7), 20, 100)
    assert kept.exceptAll(again).isEmpty() and again.exceptAll(kept).isEmpty()


def test_union_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, "x")], "a INT, b STRING")
    b = spark.createDataFrame([("y", 2)], "b STRING, a INT")
    assert sorted(map(tuple, rd.union_all([a, b]).collect())) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in schema_listing(a).orderBy("position").collect()] == [(0, "a", "int"), (1, "b", "string")]


def test_partitioned_writes_make_few_files(spark, tmp_path):
    """Sixty tasks hold rows of every value; each directory still gets few files."""
    rows = spark.range(0, 6_000, 1, 60).selectExpr("id", "concat('v', id % 3) AS split")
    for write, name in ((wr.write_parquet, "p"), (wr.write_json, "j")):
        write(rows, str(tmp_path / name), partition_by="split")
        for value in ("v0", "v1", "v2"):
            files = [f for f in (tmp_path / name / f"split={value}").iterdir() if f.name.startswith("part-")]
            assert 1 <= len(files) <= 8


def test_compressed_examples_take_little_disk_and_read_back_the_same(spark, tmp_path):
    clean = spark.createDataFrame(
        [(f"u{u}", f"i{u * 7 % 11 + i}", 10 * i) for u in range(40) for i in range(30)], "user_id STRING, parent_asin STRING, ts_ms BIGINT"
    )
    tokens = spark.createDataFrame([(f"i{i}", [i, 256 + i, 512, 768]) for i in range(50)], "parent_asin STRING, tokens ARRAY<INT>")
    made = tk.examples(tk.token_steps(clean, tokens))
    sizes = {}
    for name, codec in (("plain", None), ("small", "gzip")):
        wr.write_json(made, str(tmp_path / name), partition_by="split", compression=codec)
        files = [f for f in (tmp_path / name).rglob("part-*")]
        sizes[name] = sum(f.stat().st_size for f in files)
        assert all(f.name.endswith(".json.gz") == bool(codec) for f in files)
    assert sizes["small"] < sizes["plain"] / 4
    for split in tk.SPLITS:
        plain, small = (rd.read_token_examples(spark, str(tmp_path / name), split) for name in ("plain", "small"))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, small.collect())) and plain.count() == 40 * (27 if split == "train" else 1)


def test_the_query_keeps_its_examples_compressed(spark, monkeypatch):
    from registry import queries

    written = []
    monkeypatch.setattr(queries, "write_json", lambda df, path, **how: (written.append(how), wr.write_json(df, path, **how)))
    monkeypatch.setattr(queries.t, "clean", lambda *_: spark.createDataFrame([(1, n, n) for n in range(5)], "user_id BIGINT, parent_asin BIGINT, ts_ms BIGINT"))
    monkeypatch.setattr(queries.t, "tokens_by_item", lambda *_: spark.createDataFrame([(n, [n, 256, 512, 768]) for n in range(5)], "parent_asin BIGINT, tokens ARRAY<INT>"))
    rows = queries.examples_read_back(spark, "").collect()
    assert written == [{"partition_by": "split", "compression": "gzip"}]
    assert [(r["user_id"], r["t"], r["split"], r["tgt"]) for r in rows] == [(1, 3, "valid", "3 256 512 768")]
