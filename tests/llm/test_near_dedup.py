import os
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from seqloom.llm import near_dedup as nd
from seqloom.llm.common import byte_rows
import pyarrow as pa


def brute_force(rows, threshold=nd.THRESHOLD):
    """Smallest doc_id reachable over pairs of texts whose weighted Jaccard similarity reaches the threshold."""
    flat, offsets = byte_rows(pa.array([text or "" for _, text in rows]))
    row, ids, counts = nd.shingles(flat, offsets)
    df = np.bincount(ids & ((1 << nd.BUCKET_BITS) - 1), minlength=1 << nd.BUCKET_BITS)
    w = nd.weights(ids, counts, nd.inverse_frequencies(df, len(rows)))
    vectors = [dict(zip(ids[row == n].tolist(), w[row == n].tolist())) for n in range(len(rows))]
    parent = list(range(len(rows)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    near = 0
    for x in range(len(rows)):
        for y in range(x):
            a, b = vectors[x], vectors[y]
            low = sum(min(v, b.get(k, 0)) for k, v in a.items())
            high = sum(a.values()) + sum(b.values()) - low
            same = (rows[x][1] or "").split() == (rows[y][1] or "").split()
            if same or (high and low >= threshold * high):
                near += not same
                p, q = sorted((root(x), root(y)), key=lambda n: rows[n][0])
                parent[q] = p
    return {rows[n][0]: rows[root(n)][0] for n in range(len(rows))}, near


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    rows = []
    for _ in range(14):
        base = [word() for _ in range(r.randint(40, 200))]
        for _ in range(r.randint(1, 6)):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
            base = copy if r.random() < 0.5 else base
    rows += ["", None, " \n", "one two", "one  two", "one two three", "a b c d e"]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_against_brute_force(documents, seed):
    rows = corpus(seed)
    expected, near = brute_force(rows)
    assert near > 8
    got = nd.near_duplicates(documents(rows), bands=24).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def test_chain_of_links_in_one_bucket_needs_several_rounds(documents):
    """With one band of one sample almost everything shares a bucket; all pairs across classes must still be compared."""
    rows = corpus(3)
    expected, _ = brute_force(rows)
    for crowded in (3, 10**6):
        got = nd.near_duplicates(documents(rows), bands=40, band_rows=1, crowded=crowded).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == expected


def test_no_rows_missing_and_repeated_ids(documents):
    assert nd.near_duplicates(documents([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    got = nd.near_duplicates(documents([(None, text), (None, "x y"), (5, text), (5, text)])).collect()
    assert Counter((r["doc_id"], r["class_id"], r["kept"]) for r in got) == Counter({(5, 5, True): 2, (None, 5, False): 1, (None, None, True): 1})


def test_samples_agree_as_often_as_the_similarity():
    r = np.random.default_rng(1)
    ids = np.sort(r.choice(1 << 40, 400, replace=False))
    w1, w2 = r.uniform(1, 5, 400).astype(np.float32), r.uniform(1, 5, 400).astype(np.float32)
    s = nd.Sampler(4000)
    starts = np.array([0])
    agree = (s.sample(ids, w1, starts) == s.sample(ids, w2, starts)).mean()
    assert abs(agree - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03


def test_different_texts_under_one_id(documents):
    """Texts are known by id and words: only near copies go, whatever ids they share."""
    one, two, three = (" ".join(f"{letter}{i}" for i in range(80)) for letter in "abc")
    rows = [(5, one), (5, two), (7, f"{two} end"), (7, three), (3, f"{three} end"), (9, f"{one} end"), (5, two), (8, one), (8, f"{three} more")]
    rows += [(6, " ".join(f"d{i}" for i in range(80))), (6, " ".join(f"d{i}" for i in range(81)))]
    got = nd.near_duplicates(documents(rows)).collect()
    expected = [(5, 5, 5, True)] * 3 + [(7, 5, 7, False), (7, 3, 7, False), (3, 3, 3, True), (9, 5, 9, False), (8, 5, 5, False), (8, 3, 8, False)]
    found = Counter(map(tuple, got))
    assert sum(n for row, n in found.items() if row[:3] == (6, 6, 6)) == 2 and found[6, 6, 6, True] == 1
    assert found - Counter({row: n for row, n in found.items() if row[0] == 6}) == Counter(expected)
    staying = Counter((r["doc_id"], r["text"][0]) for r in nd.representatives(documents(rows)).collect())
    assert staying == Counter({(5, "a"): 1, (5, "b"): 1, (3, "c"): 1, (6, "d"): 1})


def test_weights_follow_shares_of_documents_not_their_number():
    """A corpus of 100 times the documents, with buckets as full as one hash collision in a thousand documents makes them."""
    df = np.array([0, 1, 5, 20, 300, 999])
    small = nd.inverse_frequencies(df, 999)
    large = nd.inverse_frequencies(100 * (df + 1) - 1 + np.where(df < 9, 100, 0), 99_999)
    assert np.allclose(small, large) and np.isclose(small[0], 1 + np.log(nd.RARE)) and small[-1] == 1
    assert (nd.inverse_frequencies(np.array([0, 50]), 0) == 1).all()


def test_a_passage_of_a_crowd_deals_nobody_together(spark):
    """Texts of one bucket repeat a passage, rare among all documents, in 70 of 100 words; each has one near copy."""
    passage = [f"p{i}" for i in range(70)]
    rows = []
    for n in range(30):
        own = [f"{n}x{i}" for i in range(30)]
        rows += [(2 * n, " ".join(own + passage)), (2 * n + 1, " ".join([*own[:-1], "other", *passage]))]
    texts = spark.createDataFrame(rows, "doc LONG, text STRING")
    members = spark.createDataFrame([(1, doc) for doc, _ in rows], "bucket LONG, rep LONG")
    idf = spark.sparkContext.broadcast(np.ones(1 << nd.BUCKET_BITS, np.float32))
    dealt = defaultdict(set)
    for row in nd._thinned(members, texts, idf, nd.THRESHOLD, 10).collect():
        dealt[row["bucket"]].add(row["rep"])
    assert max(map(len, dealt.values())) == 2
    assert {tuple(sorted(reps)) for reps in dealt.values()} == {(2 * n, 2 * n + 1) for n in range(30)}


def test_links_of_the_whole_table_at_default_bands(spark):
    """Every pair of texts whose similarity reaches the threshold, by brute force over `documents`, against the classes."""
    table = f"{os.environ.get('ORACLE_SF_DIR', '/root/testdata/sf0.01')}/documents.parquet"
    docs = pd.read_parquet(table)[["doc_id", "text"]].sort_values("doc_id")
    flat, offsets = byte_rows(pa.array(docs.text.fillna("")))
    row, ids, counts = nd.shingles(flat, offsets)
    df = np.bincount(ids & ((1 << nd.BUCKET_BITS) - 1), minlength=1 << nd.BUCKET_BITS)
    w = nd.weights(ids, counts, nd.inverse_frequencies(df, len(docs))).astype(float)
    total = np.bincount(row, w, len(docs))
    held, shared = defaultdict(list), Counter()
    for doc, shingle, weight in zip(row.tolist(), ids.tolist(), w.tolist()):
        for other, less in held[shingle]:
            shared[other, doc] += min(less, weight)
        held[shingle].append((doc, weight))
    linked = [(x, y) for (x, y), low in shared.items() if low >= nd.THRESHOLD * (total[x] + total[y] - low)]
    parent = list(range(len(docs)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for x, y in linked:
        parent[max(root(x), root(y))] = min(root(x), root(y))
    got = nd.near_duplicates(spark.read.parquet(table)).toPandas().set_index("doc_id").class_id.reindex(docs.doc_id).to_numpy()
    words = docs.text.fillna("").str.split().str.join(" ").tolist()
    near = [(x, y) for x, y in linked if words[x] != words[y]]
    assert near and sum(got[x] == got[y] for x, y in near) >= 0.9 * len(near)
    whole = docs.doc_id.to_numpy()[[root(n) for n in range(len(docs))]]
    with_words = np.array([bool(text) for text in words])
    # No class joins what is not connected.
    assert pd.Series(whole[with_words]).groupby(got[with_words]).nunique().max() == 1
