"""Join strategies, plan inspection, scoped settings and skew reports."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from seqloom.functions.columns import value_bytes
from seqloom.operators import enrich as en
from seqloom.operators import skew as sk
from seqloom.operators.clean import dedup_items, one_per_key
from seqloom.operators.kcore import _full_round, kcore
from seqloom.operators.ranking import hot_groups
from seqloom.plans import inspect as pi
from seqloom.plans import reports as rp
from seqloom.session import build_session, conf_scope, cut_lineage, drop_stored, shared_folder


@pytest.fixture(scope="module")
def tables(spark):
    """Item 0 takes a third of the rows; items 40..49 are never used, and item 7 has no metadata."""
    rows = spark.range(3_000).select(
        (F.col("id") % 50).alias("user_id"),
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("parent_asin"),
        F.col("id").alias("ts_ms"),
    )
    items = spark.range(50).filter("id <> 7").select(
        F.col("id").alias("parent_asin"),
        F.concat(F.lit("title "), F.col("id").cast("string")).alias("title"),
        F.array(F.lit("x"), F.lit(None).cast("string")).alias("categories"),
    )
    return cut_lineage(rows), cut_lineage(items)


def test_strategies_give_the_same_rows(tables):
    rows, items = tables
    joined = {s: en.enrich(rows, items, s) for s in en.STRATEGIES}
    first = joined["merge"]
    assert first.count() == 3_000 and first.filter("title is null").select("parent_asin").distinct().count() == 1
    assert first.columns == ["user_id", "parent_asin", "ts_ms", "title", "categories"]
    for other in joined.values():
        assert first.exceptAll(other).isEmpty() and other.exceptAll(first).isEmpty()


def test_join_operator_follows_strategy_and_size(spark, tables):
    rows, items = tables
    with conf_scope(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        assert pi.join_nodes(en.enrich(rows, items, "merge")) == ["SortMergeJoin"]
        assert pi.join_nodes(en.enrich(rows, items, "auto")) == ["BroadcastHashJoin"]
        assert pi.join_nodes(en.enrich(rows, items, "broadcast", broadcast_limit=100)) == ["SortMergeJoin"]
        assert pi.join_nodes(en.enrich(rows, items, "auto", broadcast_limit=100)) == ["SortMergeJoin"]
        between = en.payload_bytes(items) - 1
        assert pi.join_nodes(en.enrich(rows, items, "auto", broadcast_limit=between)) == ["BroadcastHashJoin"]
    with pytest.raises(ValueError):
        en.enrich(rows, items, "nested loops")


def test_used_items(tables):
    rows, items = tables
    used = en.used_items(items, rows)
    assert used.count() == 39 and used.columns == items.columns


def test_payload_bytes_follow_the_data(spark):
    df = spark.createDataFrame([("ab", ["x", "yz"], 1.0), (None, None, None)], "s STRING, a ARRAY<STRING>, d DOUBLE")
    assert [r[0] for r in df.select(value_bytes(df)).collect()] == [10 + 43 + 8, 8 + 24 + 8]
    assert en.payload_bytes(df.limit(0)) == 0


def test_reports_name_the_join_and_survive_failure(spark, tables, monkeypatch):
    rows, items = tables
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    report = {r["strategy"]: r for r in rp.enrich_strategies(rows, items).collect()}
    assert report["merge"]["join_node"] == "SortMergeJoin" and report["merge"]["seconds"] > 0
    assert report["reduced_broadcast"]["join_node"] == "BroadcastHashJoin"

    def fail(df):
        raise RuntimeError("too large")

    monkeypatch.setattr(rp, "discard", fail)
    failed = rp.enrich_strategies(rows, items, ["merge"]).first()
    assert failed["seconds"] is None and failed["error"] == "too large"
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_adaptive_comparison_and_repeat_cost(spark, tables):
    rows = tables[0].withColumn("category", F.lit("c"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    report = rp.adaptive_comparison(rows).collect()
    assert [r["adaptive"] for r in report] == [False, True] and report[0]["train"] == report[1]["train"] == 2_900
    assert spark.conf.get("spark.sql.adaptive.enabled") == before
    cost = rp.repeat_cost(rows.groupBy("user_id").count())
    assert [(r["mode"], r["action"]) for r in cost.collect()] == [
        ("plan", 0), ("recompute", 1), ("recompute", 2), ("cached", 1), ("cached", 2),
    ]


def test_reports_compute_their_input_once_an_action(spark, tables):
    """Repeated runs compute the input once each and the cache once more; joins read stored interactions."""
    seen = spark.sparkContext.accumulator(0)

    def watched(df):
        def run(frames):
            for frame in frames:
                seen.add(len(frame))
                yield frame

        return df.mapInPandas(run, df.schema)

    rows = spark.range(100).selectExpr("id AS n")
    assert {r["rows"] for r in rp.repeat_cost(watched(rows)).filter("mode != 'plan'").collect()} == {100}
    assert seen.value == 300
    seen.value = 0
    interactions, items = tables
    exchanged = watched(interactions.repartition(3, "user_id"))
    report = rp.enrich_strategies(exchanged, items).collect()
    assert {r["rows"] for r in report} == {interactions.count()} and {r["error"] for r in report} == {None}
    assert seen.value == interactions.count()


def test_adaptive_execution_splits_hot_keys(spark, tmp_path):
    """One item and one user each hold a third of the rows; every shuffled join that meets them is split."""
    n = 60_000
    rows = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 1, -1).otherwise(F.col("id") % 999).alias("user_id"),
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 998).alias("parent_asin"),
        F.col("id").alias("ts_ms"),
    )
    rows = cut_lineage(rows)
    keys = rows.select("parent_asin").distinct()
    items = cut_lineage(keys.withColumn("title", F.lit("t")))
    tokens = cut_lineage(keys.select("parent_asin", F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("tokens")))
    eager = {
        "spark__sql__autoBroadcastJoinThreshold": -1,
        "spark__sql__adaptive__autoBroadcastJoinThreshold": -1,
        "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": 20_000,
        "spark__sql__adaptive__skewJoin__skewedPartitionFactor": 1.5,
        "spark__sql__adaptive__advisoryPartitionSizeInBytes": 20_000,
        "spark__sql__shuffle__partitions": 8,
    }
    with conf_scope(spark, **eager):
        core = kcore(rows, 3, max_rounds=1, hot_rows=10**9, partial=True)
        for df, joins in (
            (en.enrich(rows, one_per_key(items, ["parent_asin"]), "merge"), 1),
            (rows.join(tokens.hint("merge"), "parent_asin"), 1),
            (core.rows, 2),
        ):
            df.collect()
            final = pi.physical_plan(df).split("Initial Plan")[0]
            assert final.count("SortMergeJoin(skew=true)") == joins, final
        hot = {key: hot_groups(rows, [key], 5_000) for key in ("user_id", "parent_asin")}
        assert [found.count() for found in hot.values()] == [1, 1]
        edges = rows.select("user_id", "parent_asin")
        kept = _full_round(edges, 3, hot)
        assert pi.join_nodes(kept).count("BroadcastHashJoin") >= 2
        plain = _full_round(edges, 3, {key: None for key in hot})
        assert kept.count() == plain.count() == core.rows.count() == n


def test_narrow_plans_have_no_exchange(tables):
    rows, _ = tables
    assert pi.exchange_count(rows.filter("user_id = 1").select("ts_ms")) == 0
    assert pi.exchange_count(rows.groupBy("user_id").count()) == 1
    assert pi.partition_count(rows.repartition(3)) == 3


def test_dedup_collapses_copies_before_the_shuffle(spark):
    """A third of all rows are copies of one key; each map task sends one row for them."""
    rows = spark.range(0, 9_000, 1, 4).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), (F.col("id") % 7).alias("v")
    )
    kept = one_per_key(rows, ["k"], copies="n")
    assert kept.count() == 6_001
    assert tuple(kept.filter("k = -1").first()) == (-1, 0, 3_000)
    plan = pi.physical_plan(kept)
    assert "partial_min" in plan and pi.exchange_count(kept) == 1


def test_one_row_per_item(spark):
    items = spark.createDataFrame(
        [("a", "2", ["z"]), ("a", "1", ["y"]), ("a", "1", None), (None, "1", None)],
        "parent_asin STRING, title STRING, categories ARRAY<STRING>",
    )
    assert [tuple(r) for r in dedup_items(items).collect()] == [("a", "1", None)]


@pytest.mark.parametrize("key", ["user_id", "parent_asin"])
def test_counted_partition_skew_is_the_shuffled_one(tables, key):
    rows, _ = tables
    counted, shuffled = (sk.partition_rows(rows, key, 8, shuffle) for shuffle in (False, True))
    assert counted.exceptAll(shuffled).isEmpty() and shuffled.exceptAll(counted).isEmpty()
    report = sk.partition_skew(rows, key, 8).first()
    assert report["imbalance"] == pytest.approx(report["max"] / report["avg"])


def test_empty_partitions_count_on_request(spark):
    one_key = spark.range(10).select(F.lit(1).alias("k"))
    assert sk.partition_skew(one_key, "k", 5).first()["min"] == 10
    every = sk.partition_skew(one_key, "k", 5, include_empty=True).first()
    assert (every["min"], every["max"], every["avg"], every["imbalance"]) == (0, 10, 2.0, 5.0)


def test_key_skew_and_hot_keys(tables):
    rows, _ = tables
    skew = sk.key_skew(rows, "parent_asin").first()
    assert skew["max"] == 1_050 and skew["p50"] == 50
    top = sk.hot_keys(rows, "parent_asin", 3).collect()
    assert [tuple(r) for r in top] == [(0, 1_050), (1, 50), (2, 50)]


def test_conf_scope_restores_after_an_error(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(KeyError), conf_scope(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise KeyError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    with conf_scope(spark, seqloom__test=1):
        assert spark.conf.get("seqloom.test") == "1"
    assert spark.conf.get("seqloom.test", None) is None


def test_cut_lineage_reads_what_was_written_to_the_shared_folder(spark):
    df = spark.range(10).withColumn("a", F.array("id"))
    cut = cut_lineage(df)
    assert cut.dtypes == df.dtypes and cut.count() == 10
    folder = shared_folder(spark).removeprefix("file:")
    assert folder in cut.inputFiles()[0]
    files = [Path(name.removeprefix("file://")) for name in cut.inputFiles()]
    assert all(file.exists() for file in files)
    drop_stored(df)
    drop_stored(cut)
    assert not any(file.exists() for file in files)


def test_session_settings(spark):
    session = build_session("again", shuffle_partitions=4)
    assert session.conf.get("spark.sql.session.timeZone") == "UTC"
    assert session.conf.get("spark.sql.shuffle.partitions") == "4"
