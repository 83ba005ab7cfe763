"""Bucketed tables, pruned reads, frequent-group summaries, and what plans did."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.operators import ranking
from seqloom.operators.enrich import reduced_items, used_items
from seqloom.operators.ranking import find_hot, rank_whole, store_with_hot
from seqloom.plans.inspect import exchange_count, exchange_report, executed_nodes, partition_filters
from seqloom.session import StoredTables, cut_lineage
from seqloom.sources.keyed import join_by_key, store_by_key
from seqloom.sources.readers import quarantine_report, read_interactions_checked, read_parquet, row_hash_sample
from seqloom.sources.writers import discard, write_parquet


def rows(spark, n=600, users=40):
    """User 0 has a third of all rows; some rows have no user."""
    return spark.createDataFrame(
        [(None if i % 50 == 7 else 0 if i % 3 == 0 else i % users, i, i * 7 % 100) for i in range(n)], "user_id INT, item INT, ts INT"
    ).repartition(3)


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_windows_and_joins_by_the_key_of_a_bucketed_table(spark, hot_rows):
    df = rows(spark)
    table = store_by_key(df, "user_id", buckets=5, hot_rows=hot_rows)
    assert (table.hot is None) == (hot_rows > 600)
    placed = table.ranked(["ts", "item"], "pos", "n")
    expected = rank_whole(df, ["user_id"], ["ts", "item"], "pos", "n")
    assert Counter(map(tuple, placed.collect())) == Counter(map(tuple, expected.collect()))
    joined = join_by_key(table, table.totals(F.count(F.lit(1)).alias("rows")))
    sizes = Counter(r["user_id"] for r in df.collect())
    found = joined.collect()
    assert len(found) == sum(n for key, n in sizes.items() if key is not None) and all(r["rows"] == sizes[r["user_id"]] for r in found)
    if table.hot is None:
        assert exchange_count(placed) == exchange_count(joined) == 0
    else:
        assert exchange_count(rank_whole(table.ordinary, ["user_id"], ["ts"], "pos", None)) == 0
        assert {r["user_id"] for r in table.hot.select("user_id").distinct().collect()} == {0}
    table.release()
    assert not spark.catalog.tableExists(table.name)


def test_a_bucket_is_one_file(spark):
    table = store_by_key(rows(spark), "user_id", buckets=4)
    assert len({r[0] for r in table.ordinary.select(F.input_file_name()).distinct().collect()}) <= 4
    table.release()


def test_summaries_find_the_hot_groups_in_the_storing_pass(spark, monkeypatch):
    df = rows(spark)
    stored, (users, items) = store_with_hot(df, [["user_id"], ["item", "ts"]], hot_rows=100)
    assert items is None and stored.count() == 600
    assert users.collect() == df.filter("user_id = 0").select(F.xxhash64("user_id")).distinct().collect()
    assert find_hot(df, ["user_id"], 1000) is None
    # A summary that may miss a group is not relied upon.
    monkeypatch.setattr(ranking, "SKETCH_ITEMS", 16)
    assert not ranking._summarised(600, 100)
    _, (users,) = store_with_hot(df, [["user_id"]], hot_rows=100)
    assert users.count() == 1


def test_pruned_directories(spark, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(rows(spark).withColumn("kind", F.col("item") % 4), path, partition_by="kind")
    static = read_parquet(spark, path, "kind = 2")
    assert "kind" in partition_filters(static) and static.count() == 150
    assert partition_filters(read_parquet(spark, path)).strip() == ""
    kinds = cut_lineage(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "k INT, name STRING"))
    joined = read_parquet(spark, path).join(F.broadcast(kinds.filter("name = 'b'")), F.col("kind") == F.col("k"))
    assert "dynamicpruning" in partition_filters(joined) and joined.count() == 150


def test_exchange_report_shows_a_single_reading_task(spark):
    df = spark.range(40).repartition(F.col("id"))
    discarded = df.withColumn("x", F.col("id") + 1)
    assert discarded.collect()
    (row,) = exchange_report(discarded).collect()
    assert row["tasks"] == 1 and row["partitions"] > 1 and row["bytes"] > 0 and row["skew"] >= 1
    fixed = spark.range(40).repartition(7).withColumn("x", F.col("id") + 1)
    assert fixed.collect()
    (row,) = exchange_report(fixed).collect()
    assert row["tasks"] == row["partitions"] == 7
    assert "Exchange" in executed_nodes(fixed)
    assert exchange_report(spark.range(3)).isEmpty()


def test_the_bitmap_keeps_unused_items_out_of_the_exchange(spark):
    items = cut_lineage(spark.range(20_000).select(F.col("id").alias("parent_asin"), F.sha2(F.col("id").cast("string"), 512).alias("title")))
    seen = cut_lineage(spark.createDataFrame([(i % 50,) for i in range(1000)] + [(None,)], "parent_asin BIGINT"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain, reduced = used_items(items, seen), reduced_items(items, seen)
        assert Counter(plain.collect()) == Counter(reduced.collect()) and len(reduced.collect()) == 50
        # The bitmap is moved too, 4 KB for each 32,768 numbers that a task has seen one of.
        moved = [sum(r["bytes"] for r in exchange_report(df).collect()) for df in (plain, reduced)]
        assert moved[1] < moved[0] / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Fewer bits than items: nothing is lost.
    assert reduced_items(items, seen, bits=8).count() == 50
    assert reduced_items(items, seen.limit(0)).isEmpty() and reduced_items(items.limit(0), seen).isEmpty()


def test_malformed_lines_go_to_quarantine(spark, tmp_path):
    good = ['{"a": 1, "b": "x", "more": [1]}', '{"a": null}', "{}"]
    bad = ['{"a": 1, "b": ', "no json", '{"a": "high", "b": "y"}', '{"a": 1.5}']
    (tmp_path / "one").mkdir()
    (tmp_path / "two").mkdir()
    (tmp_path / "one" / "f.jsonl").write_text("\n".join(good + bad) + "\n")
    (tmp_path / "two" / "f.jsonl").write_text("\n".join(good) + "\n")
    kept, malformed = read_interactions_checked(spark, {"one": str(tmp_path / "one"), "two": str(tmp_path / "two")}, "a BIGINT, b STRING")
    assert Counter(map(tuple, kept.collect())) == Counter([(1, "x", c) for c in ("one", "two")] + [(None, None, c) for c in ("one", "two")] * 2)
    assert sorted(r["record"] for r in malformed.collect()) == sorted(bad) and all("/one/" in r["file"] for r in malformed.collect())
    report = {r["category"]: (r["rows"], r["malformed"], round(r["malformed_pct"], 3)) for r in quarantine_report(kept, malformed).collect()}
    assert report == {"one": (3, 4, 57.143), "two": (3, 0, 0.0)}


def test_row_hash_samples_do_not_depend_on_the_layout(spark):
    df = rows(spark)
    one, two = (row_hash_sample(df.repartition(n), 0.3, ["user_id", "item"]) for n in (1, 7))
    assert Counter(one.collect()) == Counter(two.collect()) and 120 < one.count() < 240
    assert row_hash_sample(df, 0.0, ["item"]).isEmpty() and row_hash_sample(df, 1.0, ["item"]).count() == 600


def test_scratch_files_go_with_their_scope(spark):
    with StoredTables(spark) as tables:
        table = store_by_key(rows(spark), "user_id", buckets=2)
        discard(table.rows())
        assert tables.paths
    table.release()
    tables.release()
    assert not tables.paths


def test_partitioned_writes_in_a_stated_number_of_tasks(spark, tmp_path):
    path = tmp_path / "t"
    write_parquet(rows(spark).withColumn("kind", F.col("item") % 3), str(path), partition_by="kind", files=2)
    assert all(len(list(folder.glob("*.parquet"))) <= 2 for folder in path.glob("kind=*")) and spark.read.parquet(str(path)).count() == 600
