import random

import numpy as np
from pyspark.sql import functions as F

from seqloom.llm import toxicity as tx

BAD = ("zorkel", "grimfup", "dräkzz")


def corpus(n=600, seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    rows, labels = [], []
    for key in range(n):
        words = [word() for _ in range(r.randint(20, 80))]
        toxic = int(key % 4 == 0)
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", ",", "ish"]))
        rows.append((key, " ".join(words)))
        labels.append((key, toxic))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, documents):
    rows, labels = corpus()
    odd = [(1000, None), (1001, ""), (None, "zorkel " * 30), (1002, "zorkel grimfup " * 30_000), (7, rows[7][1])]
    known = spark.createDataFrame([(k, None, t) for k, t in labels] + [(1001, 1, None), (None, 1, 1), (3, 0, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    model = tx.train(documents(rows + odd), known, usable=F.col("doc_id") % 3 != 1)
    got = tx.score(documents(rows + odd), model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in got)
    truth = dict(labels)
    held = [(truth[r["doc_id"]], r["score"] >= 0.7) for r in got if r["doc_id"] in truth and r["doc_id"] % 3 == 1]
    assert np.mean([y == p for y, p in held]) > 0.97
    by_key = {r["doc_id"]: r["score"] for r in got}
    assert by_key[1002] > 0.7 and by_key[None] > 0.7 and by_key[1001] < 0.7 and by_key[1000] == by_key[1001]


def test_one_class_or_no_rows_give_a_constant(spark, documents):
    rows, _ = corpus(20)
    schema = "doc_id long, toxic int"
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        model = tx.train(documents(rows), spark.createDataFrame(labels, schema))
        assert len({r["score"] for r in tx.score(documents(rows), model).collect()}) == 1
    assert tx.score(documents([]), model).count() == 0


def test_ratios_are_log_counts():
    import pandas as pd

    counts = pd.DataFrame({"feature": [1, 2, 3], "toxic": [9, 0, 2], "other": [0, 30, 1]})
    r = tx.log_count_ratios(counts, 10, 40, 5)
    assert r[1] == np.log(10 / 12) - np.log(1 / 42) and r[2] == np.log(1 / 12) - np.log(31 / 42) and r[3] == 0


def test_the_sample_holds_one_row_for_each_key_however_many_the_table_has(spark, documents, monkeypatch):
    rows, labels = corpus(200)
    seen = []
    fit = tx.fit_logistic
    monkeypatch.setattr(tx, "fit_logistic", lambda r, v, f, y, n: seen.append((len(y), np.bincount(r).max())) or fit(r, v, f, y, n))
    many = [(key, rows[key][1] + f" zorkel {n}") for key in (0, 1, 4, 5) for n in range(500)]
    long = [(8, " ".join(w + str(i % 50) for i, (_, t) in enumerate(rows * 40) for w in t.split()[:6]))]
    tx.train(documents(rows + many + long), spark.createDataFrame(labels, "doc_id long, toxic int"), sample_per_class=10)
    assert seen[0][0] == 20 and seen[0][1] <= tx.FEATURES_PER_TEXT


def test_strongest_features_stay():
    ratios = np.array([0.0, 3, -5, 2, 5, 1])
    assert tx._strongest(np.array([1, 2, 3, 4, 5]), ratios, 3).tolist() == [1, 2, 4]
    assert tx._strongest(np.array([1, 2]), ratios, 3).tolist() == [1, 2]
