"""Vectors, quantiser, semantic IDs, token examples, prefixes and metrics against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from seqloom.operators import evaluate as ev
from seqloom.operators import quantize as rq
from seqloom.operators import semantic_ids as si
from seqloom.operators import tokens as tk
from seqloom.operators.prefixes import allowed_next, prefix_table
from seqloom.operators.vectors import embed, hashed_ngrams, standardize
from seqloom.plans.inspect import exchange_count, physical_plan

IDS = "parent_asin STRING, c1 INT, c2 INT, c3 INT, c_collision INT"


def vectors(spark, n=200, dim=6, seed=0):
    data = np.random.default_rng(seed).normal(size=(n, dim))
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(data)]
    return spark.createDataFrame(rows, "parent_asin INT, embedding ARRAY<DOUBLE>").repartition(3), data


def test_embedding_keeps_keys_and_whole_texts(spark):
    texts = [("a", "some text"), ("b", None), ("c", "x" * 5_000 + "tail"), ("d", "some text")]
    df = spark.createDataFrame(texts, "parent_asin STRING, text STRING").repartition(2)
    found = {r["parent_asin"]: r["embedding"] for r in embed(df, batch=1).collect()}
    encode = hashed_ngrams()()
    for key, text in texts:
        assert found[key] == encode([text or ""])[0].tolist()
    assert found["a"] == found["d"] and sum(found["c"]) == 5_002
    cut = {r["parent_asin"]: r["embedding"] for r in embed(df, max_chars=1_000).collect()}
    assert cut["c"] == encode(["x" * 1_000])[0].tolist()


def test_encoder_is_made_once_per_task_and_may_be_any_callable(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([("a", "xyz")], "parent_asin STRING, text STRING")
    assert embed(df, factory).first()["embedding"] == [3.0, 1.0]


def test_standardize_with_a_constant_dimension(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0]), (2, [3.0, 5.0])], "id INT, embedding ARRAY<FLOAT>")
    found = {r["id"]: r["embedding"] for r in standardize(df).collect()}
    assert found[2] == pytest.approx([1 / (math.sqrt(2) + 1e-6), 0.0])


def test_quantize_matches_a_plain_loop(spark):
    df, data = vectors(spark)
    rng = np.random.default_rng(1)
    books = [rng.normal(size=(8, 6)) / (level + 1) for level in range(3)]
    books[0][5] = books[0][2]  # equally near: the lower code wins
    left, codes = data.copy(), []
    for centres in books:
        nearest = ((left[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        left = left - centres[nearest]
        codes.append(nearest)
    found = {r["parent_asin"]: r for r in rq.quantize(df, books, residual="left").collect()}
    for i in range(len(data)):
        assert found[i]["codes"] == [int(c[i]) for c in codes] and found[i]["codes"][0] != 5
        assert found[i]["left"] == pytest.approx(left[i].tolist())
        assert found[i]["sq_error"][2] == pytest.approx((left[i] ** 2).sum())
    back = rq.codebooks_from_table(rq.codebook_table(spark, books))
    assert all(np.array_equal(a, b) for a, b in zip(back, books))
    assert rq.quantize(df.limit(0), books).isEmpty()


def test_fit_reduces_error_and_uses_codes(spark):
    df, _ = vectors(spark, n=300)
    books = rq.fit_codebooks(df, levels=2, k=8, iterations=5)
    assert [b.shape for b in books] == [(8, 6), (8, 6)]
    coded = rq.quantize(df, books)
    errors = [r["mse"] for r in rq.reconstruction_error(coded, 6).orderBy("level").collect()]
    assert errors[1] < errors[0] < 1.0
    sids = si.semantic_ids(coded, codes=("c1", "c2"))
    assert {r["level"]: r["used_share"] for r in si.utilisation(sids, 8, ("c1", "c2")).collect()} == {0: 1.0, 1: 1.0}


def test_dead_codes_move_to_distinct_points(spark):
    """Two thirds of the rows are one vector; three distinct points cannot feed eight random starts."""
    rows = [([0.0, 0.0],)] * 200 + [([float(i), 1.0],) for i in range(20)]
    left = spark.createDataFrame(rows, "_left ARRAY<DOUBLE>")
    moved = rq._revived(left, np.array([[0.0, 0.0]]), 3)
    # The points farthest from the centre, each its own code.
    assert {tuple(row) for row in moved} == {(0.0, 0.0), (19.0, 1.0), (18.0, 1.0)}
    few = spark.createDataFrame([([5.0, 5.0],)] * 3 + [([6.0, 6.0],)] * 2, "_left ARRAY<DOUBLE>")
    assert {tuple(row) for row in rq._revived(few, np.array([[5.0, 5.0]]), 4)} == {(5.0, 5.0), (6.0, 6.0)}
    assert rq._lloyd_step(left, np.array([[0.0, 0.0], [900.0, 900.0]]))[1].tolist() == [900.0, 900.0]


def test_fit_with_mostly_equal_vectors(spark):
    """Nearly every starting row is the same vector, so k-means begins with too few centres."""
    rows = [([0.0, 0.0],)] * 400 + [([float(i), 1.0 + i],) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "embedding ARRAY<DOUBLE>").repartition(4)
    books = rq.fit_codebooks(df, levels=2, k=6, iterations=3)
    assert all(1 < b.shape[0] <= 6 and b.shape[1] == 2 for b in books)
    assert all(len({tuple(row) for row in b}) == len(b) for b in books)
    coded = rq.quantize(df, books)
    assert coded.select(F.get("codes", F.lit(0))).distinct().count() >= 4


def test_null_vectors_get_null_codes(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [4.0, 4.0])], "id INT, embedding ARRAY<DOUBLE>")
    rows = {r["id"]: r for r in rq.quantize(df, [np.array([[0.0, 0.0], [4.0, 4.0]])], residual="left").collect()}
    assert rows[2]["codes"] is None and rows[2]["left"] is None and rows[2]["sq_error"] is None
    assert (rows[1]["codes"], rows[3]["codes"]) == ([0], [1])
    assert rq.fit_codebooks(df, levels=1, k=2, iterations=1)[0].shape[1] == 2


@pytest.mark.parametrize("hot_rows", [None, 100])
def test_collision_ordinals(spark, hot_rows):
    rows = [(f"i{i:04d}", [1, 2, 3 if i % 3 else i]) for i in range(600)]
    df = spark.createDataFrame(rows, "parent_asin STRING, codes ARRAY<INT>").repartition(4)
    sids = si.semantic_ids(df, hot_rows=hot_rows)
    seen, expected = {}, {}
    for key, codes in rows:
        expected[key] = seen.get(tuple(codes), 0)
        seen[tuple(codes)] = expected[key] + 1
    assert {r["parent_asin"]: r["c_collision"] for r in sids.collect()} == expected
    report = si.collision_report(sids).first()
    assert report["combos"] + report["colliding"] == report["items"] == 600
    assert report["max_per_combo"] == max(seen.values())


def test_tokens_refuse_a_code_out_of_range(spark):
    good = spark.createDataFrame([("a", 0, 1, 2, 255)], IDS)
    assert tk.item_tokens(good).first()["tokens"] == [0, 257, 514, 1023]
    with pytest.raises(PySparkException, match="0,1,2,256"):
        tk.item_tokens(spark.createDataFrame([("a", 0, 1, 2, 256)], IDS)).collect()


def test_more_items_of_equal_codes_than_a_level_has_tokens(spark):
    """Queries take every ordinal. The fourth tokens that have the numbers of PAD, BOS and EOS read back and lead to their items."""
    coded = spark.range(300).select(F.col("id").alias("parent_asin"), F.expr("array(0, 1, 2)").alias("codes"))
    tokens = tk.item_tokens(si.semantic_ids(coded), ordinals=None)
    assert {r["parent_asin"]: r["tokens"] for r in tokens.collect()} == {n: [0, 257, 514, 768 + n] for n in range(300)}
    noisy = F.expr("concat(array(1024), tokens, array(1026, 1024))").alias("tokens")
    candidates = ev.decoded(tokens.select(F.col("parent_asin").alias("user_id"), F.lit(0).alias("rank"), noisy))
    found = ev.tokens_to_items(candidates, tokens).collect()
    assert len(found) == 300 and all(r["user_id"] == r["parent_asin"] for r in found)
    cut = spark.createDataFrame([([1, 2, 3, 1026, 1024],), ([1, 1024, 2, 3, 4, 1026],), ([],), (None,)], "tokens ARRAY<INT>")
    assert [r["tokens"] for r in ev.decoded(cut).collect()] == [[1, 2, 3], [1, 2, 3, 4], [], None]
    with pytest.raises(PySparkException, match="0,256,2,0"):
        tk.item_tokens(spark.createDataFrame([("a", 0, 256, 2, 0)], IDS), ordinals=None).collect()


def brute_examples(by_user, tokens, history=20):
    out = set()
    for user, items in by_user.items():
        toks = [tokens[i] for i in items if i in tokens]
        n = len(toks)
        if n < 3:
            continue
        targets = [(n - 1, "test"), (n - 2, "valid")] + [(t, "train") for t in range(1, n - 2)]
        for t, split in targets:
            past = tuple(x for tok in toks[max(0, t - history) : t] for x in tok)
            out.add((user, t, split, (1025, *past), tuple(toks[t])))
    return out


@pytest.mark.parametrize("block,hot_rows", [(1024, None), (20, 40), (25, None)])
def test_examples_match_a_plain_loop(spark, block, hot_rows):
    """Histories of 1 to 130 items, some items without an ID, blocks far shorter than the longest history."""
    rng = random.Random(3)
    lengths = {u: u for u in range(1, 8)} | {50: 25, 60: 130, 61: 41}
    by_user = {u: [f"i{rng.randrange(80):02d}" for _ in range(n)] for u, n in lengths.items()}
    tokens = {f"i{i:02d}": [i, 256 + i, 512, 768] for i in range(80) if i % 5}
    rows = [(u, item, p) for u, items in by_user.items() for p, item in enumerate(items)]
    rng.shuffle(rows)
    inter = spark.createDataFrame(rows, "user_id INT, parent_asin STRING, ts_ms INT").repartition(3)
    ids = spark.createDataFrame(list(tokens.items()), "parent_asin STRING, tokens ARRAY<INT>")
    steps = tk.token_steps(inter, ids, hot_rows=hot_rows)
    expected = brute_examples(by_user, tokens)

    def as_set(df):
        rows = [(r["user_id"], r["t"], r["split"], tuple(r["inp"]), tuple(r["tgt"])) for r in df.collect()]
        assert len(rows) == len(set(rows))
        return set(rows)

    assert as_set(tk.examples(steps, block=block)) == expected
    assert as_set(tk.examples(steps, ["train"], block=block)) == {e for e in expected if e[2] == "train"}
    assert as_set(tk.examples(steps, ["valid", "test"])) == {e for e in expected if e[2] != "train"}
    report = tk.example_report(steps, inter).first()
    for split in tk.SPLITS:
        assert report[split] == sum(e[2] == split for e in expected)
    assert report["users"] + report["skipped"] == len(by_user)


def test_blocks_are_at_least_as_long_as_the_history(spark):
    steps = spark.createDataFrame([], "user_id INT, pos BIGINT, n BIGINT, tokens ARRAY<INT>")
    with pytest.raises(ValueError):
        tk.examples(steps, block=19)


def test_blocks_need_no_shuffle_of_their_own(spark):
    inter = spark.createDataFrame([(1, "a", 1)], "user_id INT, parent_asin STRING, ts_ms INT")
    ids = spark.createDataFrame([("a", [1, 2, 3, 4])], "parent_asin STRING, tokens ARRAY<INT>")
    steps = tk.token_steps(inter, ids.hint("broadcast"))
    made = tk.examples(steps)
    assert exchange_count(made) == 1 and "Python" not in physical_plan(made)


def test_model_input(spark):
    made = spark.createDataFrame(
        [(1, list(range(100, 181)) + [7], [1, 2, 3, 4]), (2, [1025, 5], [1, 2, 3, 4])],
        "user_id INT, inp ARRAY<INT>, tgt ARRAY<INT>",
    )
    rows = {r["user_id"]: r for r in tk.model_input(made).collect()}
    assert rows[1]["input_ids"] == list(range(100, 181)) and sum(rows[1]["attention_mask"]) == 81
    assert rows[2]["input_ids"] == [1025, 5] + [1024] * 79 and sum(rows[2]["attention_mask"]) == 2
    assert rows[1]["labels"] == [1, 2, 3, 4, 1026]


def test_vocabulary(spark):
    row = tk.vocabulary(spark, 9).first()
    assert (row["vocab_size"], row["PAD"], row["n_items"]) == (1027, 1024, 9)
    assert row["layer_offsets"] == [0, 256, 512, 768] and row["max_hist_items"] == 20


def test_prefixes_spell_exactly_the_known_ids(spark):
    rng = random.Random(1)
    ids = {tuple(rng.randrange(3) + 256 * level for level in range(4)) for _ in range(30)}
    df = spark.createDataFrame([(list(i),) for i in ids], "tokens ARRAY<INT>")
    table = prefix_table(df)
    allowed = {tuple(r["prefix"]): r["next"] for r in table.collect()}
    paths = {()}
    for _ in range(4):
        paths = {p + (t,) for p in paths for t in allowed[p]}
    assert paths == ids and all(allowed[p] == [1026] for p in ids)
    asked = spark.createDataFrame([([],), (list(min(ids))[:2],), ([9, 9],)], "prefix ARRAY<INT>")
    found = {tuple(r["prefix"]): r["next"] for r in allowed_next(asked, table).collect()}
    assert found[9, 9] == [1026] and found[()] == allowed[()] and found[min(ids)[:2]] == allowed[min(ids)[:2]]


def test_ranked_metrics(spark):
    truth = spark.createDataFrame([(u, "t") for u in range(5)], "user_id INT, parent_asin STRING")
    ranked = [(0, "t", 0), (1, "t", 4), (2, "t", 9), (3, "x", 0), (0, "t", 3), (1, "x", 0), (9, "t", 0)]
    candidates = spark.createDataFrame(ranked, "user_id INT, parent_asin STRING, rank INT")
    rows = {r["k"]: r for r in ev.evaluate(truth, candidates, [5, 10]).collect()}
    assert rows[5]["users"] == 5 and rows[5]["recall"] == pytest.approx(2 / 5)
    assert rows[5]["ndcg"] == pytest.approx((1 + 1 / math.log2(6)) / 5)
    assert rows[10]["recall"] == pytest.approx(3 / 5) and rows[10]["ndcg"] <= rows[10]["recall"]
    nobody = ev.evaluate(truth.limit(0), candidates, [5]).first()
    assert nobody["users"] == 0 and nobody["recall"] is None and nobody["ndcg"] is None
    ratio = ev.compare(ev.evaluate(truth, candidates, [5]), ev.evaluate(truth, candidates.limit(0), [5])).first()
    assert ratio["model_recall"] == pytest.approx(0.4) and ratio["recall_ratio"] is None


def test_popularity(spark):
    rows = [
        (1, "a", 1, "train"), (1, "b", 2, "valid"), (1, "a", 3, "test"), (2, "b", 1, "train"), (2, "a", 2, "train"),
        (2, "c", 3, "valid"), (2, "d", 4, "test"), (3, "a", 1, "valid"), (3, "a", 2, "test"),
    ]
    labelled = spark.createDataFrame(rows, "user_id INT, parent_asin STRING, pos INT, split STRING")
    top = ev.popularity_topk(labelled, 2)
    assert [tuple(r) for r in top.orderBy("rank").collect()] == [("a", 2, 0), ("b", 1, 1)]
    targets = ev.test_targets(labelled)
    assert sorted(map(tuple, targets.collect())) == [(1, "a"), (2, "d")]
    assert [tuple(r) for r in ev.test_targets(labelled, max_users=1).collect()] == [(1, "a")]
    assert ev.evaluate_shared(targets, top, [1]).first()["recall"] == 0.5


def test_decoded_candidates_and_reverse_lookup(spark):
    rows = [(1, 0, [1024, 1, 2, 3, 4, 1026, 1024]), (1, 1, [9, 9, 1026])]
    candidates = ev.decoded(spark.createDataFrame(rows, "user_id INT, rank INT, tokens ARRAY<INT>"))
    assert {r["rank"]: r["tokens"] for r in candidates.collect()} == {0: [1, 2, 3, 4], 1: [9, 9]}
    ids = spark.createDataFrame([("a", [1, 2, 3, 4])], "parent_asin STRING, tokens ARRAY<INT>")
    assert {r["rank"]: r["parent_asin"] for r in ev.tokens_to_items(candidates, ids).collect()} == {0: "a", 1: None}


def test_a_worker_loads_its_model_once(spark, tmp_path):
    import os

    from seqloom.operators.vectors import embed, embed_by_worker, hashed_ngrams

    folder, plain = str(tmp_path), hashed_ngrams()

    def factory():
        name = f"{folder}/{os.getpid()}"
        with open(name, "a") as file:
            file.write("x")
        encode = plain()

        def counted(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 60
            return encode(texts)

        return counted

    texts = spark.createDataFrame([(n, "some text " * (n % 30)) for n in range(200)] + [(200, None)], "parent_asin INT, text STRING")
    found = embed_by_worker(texts.repartition(40), factory, batch=16, batch_chars=60)
    left, right = ({r[0]: r[1] for r in df.collect()} for df in (found, embed(texts.fillna(""), plain)))
    assert left == right
    loads = [os.path.getsize(path) for path in tmp_path.iterdir()]
    assert len(loads) <= 8 and set(loads) == {1}


def test_codes_without_rows_move_to_spare_rows(spark):
    from seqloom.operators.quantize import fit_codebooks

    points = [0.0, 0.0, 0.0, 10.0, 10.2, 20.0, 30.0]
    rows = [([x], n if n < 3 else None, {5: 0, 6: 1}.get(n)) for n, x in enumerate(points)]
    df = spark.createDataFrame(rows, "embedding ARRAY<DOUBLE>, start INT, spare INT")
    (book,) = fit_codebooks(df, levels=1, k=3, iterations=3, start="start", spare="spare")
    (stuck,) = fit_codebooks(df, levels=1, k=3, iterations=3, start="start")
    assert len({round(x[0], 6) for x in book}) == 3 and len({round(x[0], 6) for x in stuck}) < 3
