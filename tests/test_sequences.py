"""Positions, splits and sequences, with and without groups that must be sliced."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import sequences as sq
from seqloom.operators.ranking import hot_groups, ranked
from seqloom.plans.inspect import exchange_count
from seqloom.session import conf_scope

SCHEMA = "user_id INT, parent_asin INT, ts_ms BIGINT, category STRING"


def history(spark, lengths, seed=0, ties=3):
    rng = random.Random(seed)
    rows = [(user, item, item // ties * 10, "c") for user, n in lengths.items() for item in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def expected_positions(rows):
    by_user = {}
    for user, item, ts, _ in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        by_user.setdefault(user, []).append(item)
    return {(u, i): (p + 1, len(items)) for u, items in by_user.items() for p, i in enumerate(items)}, by_user


def test_split_of_short_histories(spark):
    df, _ = history(spark, {1: 1, 2: 2, 3: 3, 4: 4})
    labels = {}
    for row in sq.loo_split(df).orderBy("user_id", "pos").collect():
        labels.setdefault(row["user_id"], []).append(row["split"])
    assert labels == {
        1: ["test"], 2: ["valid", "test"], 3: ["train", "valid", "test"], 4: ["train", "train", "valid", "test"],
    }
    report = sq.loo_report(sq.loo_split(df)).first()
    assert (report["train"], report["valid"], report["test"], report["users"]) == (3, 3, 4, 4)
    assert report["test_is_users"] and not report["valid_is_users"]


def test_ties_go_by_item_and_reverse_is_exact(spark):
    df, rows = history(spark, {1: 20, 2: 7}, ties=5)
    expected, _ = expected_positions(rows)
    for row in sq.loo_split(df).collect():
        pos, n = expected[row["user_id"], row["parent_asin"]]
        assert (row["pos"], row["rev_pos"]) == (pos, n - pos + 1)


@pytest.mark.parametrize("ties", [1, 7, 10_000])
def test_hot_users_are_sliced_with_the_same_result(spark, ties):
    """One user holds over half of all rows; with the largest `ties` all of that user's rows share one timestamp."""
    df, rows = history(spark, {0: 900, 1: 260, **{u: 5 for u in range(2, 60)}}, ties=ties)
    expected, _ = expected_positions(rows)
    with conf_scope(spark, spark__sql__shuffle__partitions=8):
        assert hot_groups(df, ["user_id"], hot_rows=200).count() == 2
        sliced = sq.sessionize(df, hot_rows=200)
    found = {(r["user_id"], r["parent_asin"]): (r["pos"], r["seq_len"]) for r in sliced.collect()}
    assert found == expected and sliced.count() == len(rows)
    whole = sq.sessionize(df, hot_rows=None)
    assert whole.exceptAll(sliced).isEmpty() and whole.dtypes == sliced.dtypes


def test_slices_of_a_hot_user_are_spread(spark):
    df, _ = history(spark, {0: 4_000, 1: 3})
    sliced = df.repartitionByRange(8, "user_id", "ts_ms", "parent_asin").groupBy(F.spark_partition_id()).count()
    assert sliced.agg(F.max("count")).first()[0] < 1_000


def test_hot_groups_of_several_columns_with_nulls(spark):
    rows = [(None, 1, i) for i in range(300)] + [(2, None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "a INT, b INT, v INT").repartition(3)
    found = ranked(df, ["a", "b"], ["v"], size="n", hot_rows=50)
    assert {(r["v"] + 1, 300) for r in df.filter("a is null").collect()} == {
        (r["pos"], r["n"]) for r in found.filter("a is null").collect()
    }
    assert found.count() == 303


def test_no_group_is_hot_below_the_limit(spark):
    df, _ = history(spark, {1: 5, 2: 6})
    assert hot_groups(df, ["user_id"]).isEmpty()
    assert hot_groups(df, ["user_id"], hot_rows=5).count() == 1


def test_split_keeps_renamed_keys(spark):
    df, _ = history(spark, {1: 3, 2: 2})
    renamed = df.select(F.col("user_id").alias("u"), F.col("parent_asin").alias("i"), F.col("ts_ms").alias("t"))
    assert sq.loo_split(renamed, "u", "i", "t").columns == ["u", "i", "t", "pos", "rev_pos", "split"]


def test_sequences_and_chunks(spark):
    df, rows = history(spark, {1: 25, 2: 3, 3: 1})
    _, by_user = expected_positions(rows)
    whole = {r["user_id"]: r for r in sq.user_sequences(df).collect()}
    assert {u: r["items"] for u, r in whole.items()} == by_user
    assert whole[3]["n_train"] == -1 and whole[1]["n_train"] == 23 and {r["chunk"] for r in whole.values()} == {0}
    chunks = sq.user_sequences(df, chunk_items=10, hot_rows=5).orderBy("user_id", "chunk").collect()
    assert [(r["user_id"], r["chunk"], len(r["items"]), r["n"]) for r in chunks][:3] == [
        (1, 0, 10, 25), (1, 1, 10, 25), (1, 2, 5, 25),
    ]
    assert sum((r["items"] for r in chunks if r["user_id"] == 1), []) == by_user[1]


def test_example_history_is_the_lowest_user_in_range(spark):
    df, _ = history(spark, {1: 5, 4: 7, 9: 8})
    rows = sq.example_history(sq.loo_split(df)).collect()
    assert {r["user_id"] for r in rows} == {4} and [r["pos"] for r in rows] == list(range(1, 8))


def test_one_shuffle_and_one_sort(spark):
    df, _ = history(spark, {1: 5})
    plan = sq.loo_split(df)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Sort [") == 1 and exchange_count(plan) == 1
    sequences = sq.user_sequences(df)
    assert exchange_count(sequences) == 1


def test_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert sq.loo_split(none).isEmpty() and sq.user_sequences(none).isEmpty()
    report = sq.loo_report(sq.loo_split(none)).first()
    assert (report["train"], report["users"]) == (0, 0)
