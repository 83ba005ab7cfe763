"""k-core: agreement of all strategies with a plain loop, and the properties of a core."""

import random
from collections import Counter
from pathlib import Path

import pytest

from seqloom.operators import kcore as kcore_module
from seqloom.operators import peel
from seqloom.operators.kcore import STRATEGIES, NotConverged, kcore, kcore_report
from seqloom.plans.inspect import physical_plan
from seqloom.plans.reports import kcore_strategies
from seqloom.session import shared_folder


def plain_kcore(rows, k, max_rounds=15):
    trace = []
    for _ in range(max_rounds):
        users = Counter(u for u, _ in rows)
        rows = [r for r in rows if users[r[0]] >= k]
        items = Counter(i for _, i in rows)
        rows = [r for r in rows if items[r[1]] >= k]
        trace.append(len(rows))
        if len(trace) > 1 and trace[-1] == trace[-2]:
            return rows, trace, True
    return rows, trace, False


def random_rows(seed, n=600, users=120, items=90):
    rng = random.Random(seed)
    return [(int(users * rng.random() ** 2), int(items * rng.random() ** 2)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "user_id INT, parent_asin INT").repartition(3)


def as_counter(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_strategies_match_a_plain_loop(spark, strategy):
    rows, k, rounds = random_rows(1), 3, 3
    kept, trace, converged = plain_kcore(rows, k, rounds)
    core = kcore(frame(spark, rows), k, rounds, strategy, partial=True)
    assert [entry[1] for entry in core.trace] == trace and core.converged == converged
    assert as_counter(core.rows) == Counter(kept)
    core.release()


@pytest.mark.parametrize("seed", range(2))
def test_delta_rounds_to_the_fixpoint(spark, seed):
    """A chain of users and items unravels one link per round, below a dense block that keeps late rounds small."""
    rng = random.Random(seed)
    block = [(u, i) for u in range(30) for i in range(30)]
    chain = [(100 + j, 200 + j) for j in range(6)] + [(101 + j, 200 + j) for j in range(6)] + [(106, 0)]
    extra = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    rows = block + chain + extra
    kept, trace, converged = plain_kcore(rows, 2)
    core = kcore(frame(spark, rows), 2)
    assert [entry[1] for entry in core.trace] == trace and core.converged == converged
    assert len(trace) >= 4
    assert as_counter(core.rows) == Counter(kept)


def test_hot_keys_that_fall_below_k_still_go(spark):
    """User 0 and item 0 hold most rows, but only with partners that go, so both go with them."""
    rows = [(0, i) for i in range(1, 60)] + [(u, 0) for u in range(1, 60)] + [(u, i) for u in range(70, 75) for i in range(70, 75)]
    kept, trace, _ = plain_kcore(rows, 3)
    for strategy in ("delta", "table"):
        core = kcore(frame(spark, rows), 3, strategy=strategy, hot_rows=20)
        assert [entry[1] for entry in core.trace] == trace and as_counter(core.rows) == Counter(kept)
    assert len(kept) == 25


def test_delta_rewrites_a_table_that_has_shrunk(spark):
    """A bare chain loses both its ends every round until nothing is left."""
    chain = [(j, 200 + j) for j in range(7)] + [(1 + j, 200 + j) for j in range(7)]
    _, trace, converged = plain_kcore(chain, 2)
    core = kcore(frame(spark, chain), 2)
    assert [entry[1] for entry in core.trace] == trace and core.converged == converged
    assert trace[-1] == 0 and len(trace) >= 5 and core.rows.isEmpty()


def test_core_is_a_fixpoint_and_shrinks_with_k(spark):
    rows = random_rows(7)
    three, four = (kcore(frame(spark, rows), k).rows for k in (3, 4))
    again = kcore(three, 3)
    assert [entry[1] for entry in again.trace] == [three.count()] * 2
    assert not (as_counter(four) - as_counter(three))
    for key in ("user_id", "parent_asin"):
        assert three.groupBy(key).count().filter("count < 3").isEmpty()


def test_counts_rows_not_partners_and_drops_null_keys(spark):
    rows = [(1, 1)] * 3 + [(None, 1)] * 5 + [(2, None)] * 5
    core = kcore(frame(spark, rows), 3)
    assert as_counter(core.rows) == Counter({(1, 1): 3})


def test_stops_at_max_rounds_and_says_so(spark):
    rows = random_rows(3)
    core = kcore(frame(spark, rows), 4, max_rounds=1, partial=True)
    assert len(core.trace) == 1 and not core.converged
    with pytest.raises(NotConverged):
        kcore(frame(spark, rows), 4, max_rounds=1)


def test_a_long_chain_takes_as_many_rounds_as_it_needs(spark):
    chain = [(j, 200 + j) for j in range(32)] + [(1 + j, 200 + j) for j in range(32)]
    _, trace, _ = plain_kcore(chain, 2, 100)
    core = kcore(frame(spark, chain), 2)
    assert [entry[1] for entry in core.trace] == trace and len(trace) > 15


@pytest.mark.parametrize("strategy", ["delta", "table"])
def test_release_leaves_no_files(spark, strategy):
    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    core = kcore(frame(spark, random_rows(1)).groupBy("user_id", "parent_asin").count(), 3, strategy=strategy)
    assert core.rows.count() and set(folder.iterdir()) - before
    core.release()
    assert not {p for p in set(folder.iterdir()) - before if p.name.startswith("seqloom-")}


def test_empty_results(spark):
    core = kcore(frame(spark, random_rows(5)), 500)
    assert core.rows.isEmpty() and core.converged and [e[1] for e in core.trace] == [0, 0]
    none = kcore(frame(spark, []), 2)
    assert none.rows.isEmpty() and none.converged
    report = kcore_report(frame(spark, []), none).first()
    assert report["kept_pct"] == 0.0 and report["rows_per_user"] == 0.0


def test_strategy_report(spark):
    report = kcore_strategies(frame(spark, random_rows(1)), 3, ("table", "persist"), max_rounds=2)
    rows = {(r["strategy"], r["round"]): r["rows"] for r in report.collect()}
    assert {r for (s, r) in rows if s == "table"} == {r for (s, r) in rows if s == "persist"}
    assert all(rows["table", r] == rows["persist", r] for (s, r) in rows if s == "table")


@pytest.mark.parametrize("part_pairs", [1 << 18, 60])
@pytest.mark.parametrize("hot_rows", [1_000_000, 12])
def test_peeling_gives_the_core(spark, monkeypatch, part_pairs, hot_rows):
    """Cascades inside parts and across them, users that several parts hold, repeated edges and a chain."""
    monkeypatch.setattr(kcore_module, "peeled", lambda *args: peel.peeled(*args, part_pairs=part_pairs))
    block = [(u, i) for u in range(15) for i in range(15)]
    chain = [(100 + j, 200 + j) for j in range(12)] + [(101 + j, 200 + j) for j in range(12)] + [(112, 0)]
    rows = random_rows(4, 500) + random_rows(4, 80) + block + chain
    for k in (2, 4, 7):
        kept, _, _ = plain_kcore(rows, k, 200)
        core = kcore(frame(spark, rows), k, strategy="peel", hot_rows=hot_rows)
        assert as_counter(core.rows) == Counter(kept) and core.converged
        assert core.trace[-1][1] == len(kept)
        core.release()


def test_peeling_follows_a_chain_inside_a_part_without_exchanges(spark):
    chain = [(j, 200 + j) for j in range(40)] + [(1 + j, 200 + j) for j in range(40)]
    core = kcore(frame(spark, chain), 2, strategy="peel")
    assert core.rows.isEmpty() and len(core.trace) <= 3


@pytest.mark.parametrize("hot_rows", [1_000_000, 12])
def test_peeling_exchanges_messages_and_leaves_the_parts(spark, monkeypatch, hot_rows):
    """Losses and the nodes that go are exchanged; the parts are stored once, and a node's holders are told once."""
    plans, stored = [], peel._stored
    monkeypatch.setattr(peel, "_stored", lambda df: (plans.append(physical_plan(df)), stored(df))[1])
    monkeypatch.setattr(kcore_module, "peeled", lambda *args: peel.peeled(*args, part_pairs=30))
    rows = random_rows(4, 500)
    kept, _, _ = plain_kcore(rows, 4, 200)
    core = kcore(frame(spark, rows), 4, strategy="peel", hot_rows=hot_rows)
    assert as_counter(core.rows) == Counter(kept) and len(plans) == len(core.trace) > 2
    assert all("hashpartitioning(to" in plan and "hashpartitioning(part" not in plan for plan in plans)
    core.release()


def test_peeling_keeps_texts_nulls_and_other_columns(spark):
    rows = [("ä", "x", 1.5)] * 3 + [("b", "x", None)] * 3 + [(None, "x", 0.0)] * 9 + [("b", None, 0.0)] * 9 + [("c", "y", 2.0)]
    df = spark.createDataFrame(rows, "user_id STRING, parent_asin STRING, part DOUBLE")
    core = kcore(df, 3, strategy="peel")
    assert as_counter(core.rows) == Counter({("ä", "x", 1.5): 3, ("b", "x", None): 3}) and core.rows.columns == df.columns
    with pytest.raises(ValueError, match="rounds"):
        kcore(df, 3, max_rounds=2, strategy="peel")
    none = kcore(df.limit(0), 2, strategy="peel")
    assert none.rows.isEmpty() and none.converged


def test_rounds_on_top_of_each_other_read_the_edges_once(spark):
    """Rounds that are only planned, as `recompute` and `persist` do, must not double the plan."""
    edges = frame(spark, random_rows(2)).select("user_id", "parent_asin")
    for _ in range(6):
        edges = kcore_module._full_round(edges, 2, {"user_id": None, "parent_asin": None})
    assert physical_plan(edges).count("Exchange hashpartitioning") == 12 and "Join" not in physical_plan(edges)


@pytest.mark.parametrize("strategy", ["persist", "recompute"])
def test_planned_rounds_with_hot_keys(spark, strategy):
    rows = [(0, i) for i in range(1, 60)] + [(u, 0) for u in range(1, 60)] + [(u, i) for u in range(70, 75) for i in range(70, 75)]
    kept, trace, _ = plain_kcore(rows, 3)
    core = kcore(frame(spark, rows), 3, strategy=strategy, hot_rows=20)
    assert [entry[1] for entry in core.trace] == trace and as_counter(core.rows) == Counter(kept)


def test_rounds_with_hot_keys_leave_the_rows_where_they_are(spark, monkeypatch):
    """A round scans the edges and writes what is left; it neither exchanges the edges nor broadcasts the keys that stay."""
    plans, stored = [], kcore_module.cut_lineage
    monkeypatch.setattr(kcore_module, "cut_lineage", lambda df: (plans.append((set(df.columns), physical_plan(df))), stored(df))[1])
    rows = random_rows(1)
    kept, trace, _ = plain_kcore(rows, 4, 50)
    core = kcore(frame(spark, rows), 4, strategy="table", hot_rows=5)
    assert [entry[1] for entry in core.trace] == trace and as_counter(core.rows) == Counter(kept) and len(trace) > 2
    edges = [plan for columns, plan in plans if columns == {"user_id", "parent_asin"}]
    assert len(edges) == len(trace) - 1
    assert not any("Exchange hashpartitioning" in plan or "Union" in plan or "LeftSemi" in plan for plan in edges)
    assert "Exchange hashpartitioning" not in physical_plan(core.rows) and "LeftSemi" not in physical_plan(core.rows)
    core.release()


@pytest.mark.parametrize("limit", [100, 0])
@pytest.mark.parametrize("strategy", ["table", "delta", "peel"])
def test_hot_keys_with_any_number_of_keys_to_remove(spark, monkeypatch, strategy, limit):
    """Only the hot ones of many keys are broadcast, or none."""
    monkeypatch.setattr(kcore_module, "KEYS_LIMIT_BYTES", limit)
    block = [(u, i) for u in range(300, 312) for i in range(300, 312)]
    rows = random_rows(6) + block + [(0, i) for i in range(400, 460)] + [(u, 0) for u in range(400, 460)]
    kept, trace, _ = plain_kcore(rows, 4, 50)
    core = kcore(frame(spark, rows + [(None, 300)] * 30 + [(300, None)] * 30), 4, strategy=strategy, hot_rows=25)
    assert as_counter(core.rows) == Counter(kept) and core.rows.columns == ["user_id", "parent_asin"]
    assert strategy == "peel" or [entry[1] for entry in core.trace] == trace
    core.release()


def test_items_that_are_too_weak_at_the_start_go_in_the_first_round(spark):
    rows = [(u, i) for u in range(6) for i in range(6)] + [(0, 50), (1, 51)]
    kept, trace, _ = plain_kcore(rows, 3)
    core = kcore(frame(spark, rows), 3, strategy="table", hot_rows=6)
    assert [entry[1] for entry in core.trace] == trace == [36, 36] and as_counter(core.rows) == Counter(kept)


@pytest.mark.parametrize("strategy", ["table", "persist", "recompute"])
def test_rounds_leave_the_rows_where_they_are_without_hot_keys(spark, monkeypatch, strategy):
    """Only keys and counts are exchanged and stored, apart from the edges that `table` writes; `recompute` runs all rounds again."""
    plans, rounds, stored, advance = [], [], kcore_module.cut_lineage, kcore_module._Losses.advance
    monkeypatch.setattr(kcore_module, "cut_lineage", lambda df: (plans.append((set(df.columns), physical_plan(df))), stored(df))[1])
    monkeypatch.setattr(kcore_module._Losses, "advance", lambda losses: (rounds.append(1), advance(losses))[1])
    rows = random_rows(1)
    kept, trace, _ = plain_kcore(rows, 4, 50)
    core = kcore(frame(spark, rows + [(None, 3)] * 9 + [(3, None)] * 9).sortWithinPartitions("user_id"), 4, strategy=strategy)
    assert [entry[1] for entry in core.trace] == trace and as_counter(core.rows) == Counter(kept) and len(trace) > 2
    assert not any("Window" in plan for _, plan in plans)
    edges = [plan for columns, plan in plans if columns == {"user_id", "parent_asin"} and "Exchange hashpartitioning" in plan]
    assert len(edges) == 0 and len(rounds) == (len(trace) * (len(trace) + 1) // 2 if strategy == "recompute" else len(trace))
    core.release()


def test_unknown_strategy(spark):
    with pytest.raises(ValueError):
        kcore(frame(spark, []), 2, strategy="magic")
