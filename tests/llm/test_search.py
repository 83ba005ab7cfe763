import math
import re
from collections import Counter

import pytest

from seqloom.llm import search as se

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, items, best=10):
    held = [(key, Counter(TERM.findall((text or "").translate(LOWER)))) for key, text in rows]
    held = [(key, found, sum(found.values())) for key, found in held if found]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(term for _, found, _ in held for term in found)
    queries = {}
    for key, text in items:
        queries.setdefault(key, Counter()).update(TERM.findall((text or "").translate(LOWER)))
    result = []
    for item, wanted in queries.items():
        scored = []
        for key, found, n in held:
            m = 25 + 75 * n * n_docs // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * found[t] // (1000 * found[t] + 8 * m))
                for t, times in wanted.items() if t in found
            )
            if score > 0:
                scored.append((-score, key is None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(scored)[:best], 1):
            result.append((item, rank, key, -score))
    return sorted(result, key=str)


def corpus(rng):
    words = ["The", "the", "ÜBER", "über", "x1", "ing", "é", "don't", "a_b", "日本", "42", "rare", "of", "and"]
    rows = [(n, " ".join(rng.choice(words[: rng.randint(2, len(words))]) for _ in range(rng.randint(0, 30)))) for n in range(150)]
    rows += [(200, None), (201, ""), (202, "... !"), (3, rows[3][1]), (None, "rare rare"), (None, "rare rare"), (203, "rare, THE\x00of\x7fand"), (204, "and of " * 40_000)]
    items = [(n, " ".join(rng.choice([*words, "unseen", "qqq"]) for _ in range(rng.randint(1, 12)))) for n in range(20)]
    items += [(50, None), (51, "?"), (52, "rare rare 日本"), (None, "über"), (7, "rare again")]
    return rows, items


@pytest.mark.parametrize("options", [
    {}, {"shard_docs": 7, "block_items": 4}, {"shard_limit": 20, "vocabulary_bytes": 0, "block_items": 3}, {"owners": (), "best": 3},
])
def test_matches_brute_force(spark, documents, rng, options):
    rows, items = corpus(rng)
    wanted = spark.createDataFrame([(*row, 1.5, "clash") for row in items], "item_id long, text string, score double, doc_id string")
    got = se.ranked_search(documents(rows).repartition(4), wanted, **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items, options.get("best", 10))


def test_no_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert se.ranked_search(documents([]), some).count() == 0 and se.ranked_search(documents([(1, "the a"), (2, "a")]), none).count() == 0


def test_terms_of_columns_and_tasks_agree(spark):
    text = "Ab\x00cÉ\x7fé_x-1 日本,'don't' İ"
    row = spark.createDataFrame([(text,)], "text string").select(se.terms("text").alias("t")).first()
    assert row["t"] == [w.decode() for w in text.encode().translate(se._TABLE).split()] == TERM.findall(text.translate(LOWER))
