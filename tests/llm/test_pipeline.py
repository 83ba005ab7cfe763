"""The pipeline against brute-force versions of its stages, and its stages on odd tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from seqloom.llm import mixing, quality_rules
from tests.llm.test_near_dedup import brute_force
from tests.llm.test_quality_and_mixing import targets, verdict


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(r.randint(60, 200))]
        rows.append(" ".join(base))
        if r.random() < 0.5:
            rows.append("  ".join(base))
        if r.random() < 0.5:
            base[r.randrange(len(base))] = word()
            rows.append("\n".join(base))
    rows += ["too short", "", None, "### " * 80, "same words again " * 40]
    r.shuffle(rows)
    return [(i, text) for i, text in enumerate(rows)]


def test_stages_against_brute_force(spark, documents):
    rows = corpus()
    docs = documents(rows)
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    docs = stages["quality_rules"](spark, docs, "")
    rows = [(k, t) for k, t in rows if verdict(t)]
    assert docs.columns == columns and sorted(map(tuple, docs.select("doc_id", "text").collect())) == rows

    docs = stages["exact_dedup"](spark, docs, "")
    first = {}
    for key, text in rows:
        first.setdefault(" ".join(text.split()), (key, text))
    rows = sorted(first.values())
    assert docs.columns == columns and sorted(map(tuple, docs.select("doc_id", "text").collect())) == rows

    docs = stages["near_dedup"](spark, docs, "")
    classes, near = brute_force(rows)
    rows = [(k, t) for k, t in rows if classes[k] == k]
    assert near and docs.columns == columns and sorted(map(tuple, docs.select("doc_id", "text").collect())) == rows

    sources = {k: s for k, s in docs.select("doc_id", "source").collect()}
    docs = stages["mix_sources"](spark, docs, "")
    sizes = defaultdict(int)
    for key, text in rows:
        sizes[sources[key]] += len(text.split())
    rate = {s: goal / sizes[s] for s, goal in targets(dict(sizes)).items()}
    copies = Counter(r["doc_id"] for r in docs.collect())
    assert docs.columns == columns
    for key, _ in rows:
        assert copies[key] in (int(rate[sources[key]]), int(rate[sources[key]]) + 1)

    pieces = stages["pack"](spark, docs, "").collect()
    expected = Counter()
    for key, text in rows:
        expected[key] += copies[key] * (len(ids_of(text)) + 1)
    got = Counter()
    for p in pieces:
        got[p["doc_id"]] += len(np.frombuffer(bytes(p["ids"]), "<u4"))
    assert got == +expected


def ids_of(text):
    from tokenizers import Tokenizer

    from seqloom.llm.queries import tokenizer_path

    return Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (1, None), (1, None)]])
def test_every_stage_takes_empty_and_odd_tables(spark, documents, rows):
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, documents(rows), "")
        assert result.count() >= 0 and (name == "pack" or result.columns == documents(rows).columns)


def test_repeated_rows_stay_once(spark, documents):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(3, text), (3, text), (4, text), (None, text), (None, text.upper()), (None, text.upper())]
    stages = dict(corpus_pipeline.STAGES)
    for name in ("exact_dedup", "near_dedup"):
        kept = stages[name](spark, documents(rows), "").collect()
        assert sorted((r["doc_id"], r["text"] == text) for r in kept if r["doc_id"]) == [(3, True)]
        assert [r["text"] for r in kept if r["doc_id"] is None] == [text.upper()]


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "mix_sources", "pack"]
    assert mixing.WEIGHTS == (3, 1, 2) and len(quality_rules.default_rules()) == 5
