import re
from collections import Counter, defaultdict

import pytest

from seqloom.llm import mixing, quality_rules as qr

ROWS = [
    (1, " ".join(f"w{i}" for i in range(60))), (2, "a b c " * 40), (3, None), (4, ""), (5, " ".join(f"w{i}###" for i in range(60))),
    (6, "\n".join(["one line here"] * 20 + [f"x{i} y{i} z{i} u v w{i}" for i in range(3)])), (7, " ".join("x" * 30 + str(i) for i in range(60))),
    (8, "\x0b\x0c \x1c ü é\xa0x\n\n ü \n ü "), (None, "same same same same"), (1, "x"), (9, "a b c a b c"), (10, "a a a"),
]


def statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated), len(lines))


def verdict(text):
    n, chars, symbols, dup, repeat, lines = statistics(text)
    return n >= 50 and 100 * repeat <= 50 * n and 10 * symbols <= n and 2 * dup <= lines and 2 * n <= chars <= 15 * n


def test_statistics_and_verdict(documents):
    rows = qr.cascade(documents(ROWS), statistics=list(qr.STATISTICS)).collect()
    got = sorted((str(r["doc_id"]), *(r[name] for name in qr.STATISTICS), r["kept"]) for r in rows)
    assert got == sorted((str(key), *statistics(text)[:5], verdict(text)) for key, text in ROWS)
    assert rows[0]["size"] == "x"


def test_the_order_follows_rejections_per_second_and_later_rules_do_not_run(documents):
    def never(text):
        raise AssertionError("a rejected text went on")

    rules = [qr.Rule("slow", lambda t: sum(range(200_000)) < 0 or not t), qr.Rule("cheap", lambda t: len(t) > 3)]
    estimates = qr.estimate(documents(ROWS), rules)
    assert [rule.name for rule in qr.ordered(rules, estimates)] == ["cheap", "slow"]
    plan = [qr.Rule("all", lambda t: True), qr.Rule("none", never)]
    assert qr.ordered(plan, [{"rule": "all", "seconds": 1, "rejected": 1.0}, {"rule": "none", "seconds": 1, "rejected": 0.0}])[0].name == "all"


def test_kept_documents_keep_their_columns(documents):
    docs = documents(ROWS)
    kept = qr.kept_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(key for key, text in ROWS if verdict(text))
    assert qr.cascade(documents([])).count() == 0


def targets(sizes, weights=(3, 1, 2)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(sum(weight[s] for s in rest), 1)
        above = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not above:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 2 * sizes[s] for s in above}


@pytest.mark.parametrize("rows", [
    [("a", 10), ("b", 500), ("c", 3), (None, 40), ("d", 0), ("é", 7), ("B", 90)], [("x", 5)], [(None, 3), ("", 9)], [("a", 0)], [],
])
def test_targets_against_iteration(spark, rows):
    df = spark.createDataFrame(rows, "source string, size long")
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.source_targets(df).collect()}
    expected = targets(dict(rows))
    assert set(got) == set(expected)
    for source, (size, target) in got.items():
        assert size == dict(rows)[source] and target == pytest.approx(expected[source])


def test_copies_follow_rates_and_agree_between_runs(documents):
    rows = [(i, "w " * (i % 7 + 1)) for i in range(3000)] + [(5, None), (None, "w w")]
    docs = documents(rows)
    sizes = mixing.mixed_sizes(docs, "doc_id", "lang").collect()
    again = mixing.mixed_sizes(docs.repartition(5), "doc_id", "lang").collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, sizes)) == sorted(map(key, again))
    assert {r["copies"] for r in sizes} == {1, 2}
    taken = sum(r["copies"] * r["size"] for r in sizes)
    assert abs(taken / sizes[0]["target"] - 1) < 0.03
    mixed = mixing.mixed_documents(docs, "doc_id", "lang")
    assert mixed.columns == docs.columns
    counts = defaultdict(int)
    for r in mixed.collect():
        counts[r["doc_id"], r["text"]] += 1
    assert sum(counts.values()) == sum(r["copies"] for r in sizes if r["size"]) + sum(r["copies"] for r in sizes if not r["size"])
    assert mixing.mixed_sizes(documents([])).count() == 0


def test_rows_without_a_key_are_drawn_one_by_one(documents):
    rows = documents([(None, f"w{i:03d} x") for i in range(400)])  # one source at rate 1.5
    copies = [r["copies"] for r in mixing.mixed_sizes(rows).collect()]
    assert set(copies) == {1, 2} and 540 < sum(copies) < 660
    assert 540 < mixing.mixed_documents(rows).count() < 660
