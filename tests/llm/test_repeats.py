import random

import numpy as np
import pytest

from seqloom.llm import suffix_arrays, suffix_trees


def bytes_left(rows, length):
    """Removes every byte covered by a window that was seen before, reading documents in order."""
    seen, result = {}, []
    docs = sorted((key, (text or "").encode()) for key, text in rows)
    for key, body in docs:
        for i in range(len(body) - length + 1):
            seen.setdefault(body[i : i + length], (key, i))
    for key, body in docs:
        gone = [False] * len(body)
        for i in range(len(body) - length + 1):
            if seen[body[i : i + length]] < (key, i):
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        result.append((key, len(body), sum(gone), spans, bytes(b for b, g in zip(body, gone) if not g)))
    return result


def words_left(rows, length):
    seen, result = {}, []
    docs = sorted((key, (text or "").encode().split()) for key, text in rows)
    for key, words in docs:
        for i in range(len(words) - length + 1):
            seen.setdefault(tuple(words[i : i + length]), key)
    for key, words in docs:
        gone = [False] * len(words)
        for i in range(len(words) - length + 1):
            if seen[tuple(words[i : i + length])] < key:
                gone[i : i + length] = [True] * length
        result.append((key, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return result


def corpus(seed, letters, passage, n=60):
    """Documents that share passages and edges of passages, copies, self-repeats, empty and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(letters) for _ in range(r.randint(1, 4)))
    shared = [" ".join(word() for _ in range(passage)) for _ in range(4)]
    rows = []
    for key in range(n):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(r.choice(shared) if r.random() < 0.5 else " ".join(word() for _ in range(r.randint(1, 30))))
        rows.append((key * 3 % 61, r.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, ""), (103, None), (104, "é" * 300), (105, "é" * 300), (106, "x"), (107, "a b " * 80)]
    return rows


@pytest.mark.parametrize("options", [{}, {"sample_rows": 10**6, "hot_in_sample": 2, "block": 64}])
@pytest.mark.parametrize("letters,passage", [("ab", 20), ("abcdefghij", 40)])
def test_byte_strings_against_brute_force(documents, letters, passage, options):
    rows = corpus(len(letters), letters, passage)
    left = suffix_arrays.remove_repeats(documents(rows), length=20, anchor=7, shard_bytes=200 if options else 1 << 20, **options)
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in left.collect()) == bytes_left(rows, 20)


@pytest.mark.parametrize("options", [{}, {"sample_rows": 10**6, "hot_in_sample": 2, "block": 32, "group_rows": 3, "prefix_sample": 500}])
@pytest.mark.parametrize("letters,passage", [("ab", 20), ("abcdefghij", 40)])
def test_word_windows_against_brute_force(documents, letters, passage, options):
    rows = corpus(len(letters), letters, passage)
    left = suffix_trees.remove_repeats(documents(rows), length=6, anchor=3, **options)
    assert sorted(map(tuple, left.collect())) == words_left(rows, 6)


@pytest.mark.parametrize("remove", [suffix_arrays.remove_repeats, suffix_trees.remove_repeats])
def test_no_rows_missing_and_repeated_ids(documents, remove):
    assert remove(documents([])).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    rows = remove(documents([(None, text), (None, "short"), (1, text), (1, text)])).collect()
    assert sorted(((r["doc_id"], r["n_removed"] > 0) for r in rows), key=str) == [(1, False), (1, False), (None, False), (None, True)]


@pytest.mark.parametrize("first,second", ["yx", "xy"])
def test_copies_behind_neighbouring_bytes(documents, rng, first, second):
    """In the array of both texts the suffixes at the unequal first bytes are neighbours, with nothing in common."""
    passage = "".join(rng.choice("abcdefgh ") for _ in range(105))
    rows = [(1, first + passage), (2, second + passage)]
    text = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    order = suffix_arrays.suffix_array(text, 100)
    at = dict(zip(order.tolist(), suffix_arrays.common_prefixes(text, order, 100).tolist()))
    assert max(at[1], at[107]) >= 100
    left = suffix_arrays.remove_repeats(documents(rows)).collect()
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in left) == bytes_left(rows, 100)


def test_common_prefixes_against_brute_force(rng):
    for letters in (b"ab", b"abcd", bytes(range(97, 123))):
        passage = bytes(rng.choice(letters) for _ in range(40))
        body = b"".join(bytes(rng.choice(letters) for _ in range(rng.randint(1, 3))) + passage[rng.randint(0, 5):] for _ in range(20))
        text = np.frombuffer(body, np.uint8)
        order = suffix_arrays.suffix_array(text, 30)
        found = suffix_arrays.common_prefixes(text, order, 30).tolist()
        for place in range(1, len(order)):
            x, y = body[order[place - 1]:], body[order[place]:]
            true = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert min(found[place], 30) == min(true, 30)


@pytest.mark.parametrize("options", [{}, {"sample_rows": 10**6, "hot_in_sample": 2}])
def test_different_texts_under_one_id(documents, options):
    """Each loses what is repeated in it, and nothing at the places of the other's repeats."""
    word = lambda k: "".join(random.Random(k).choices("abcdefghijklmnop", k=7))
    words = [word(k) for k in range(300)]
    shared, other, own = " ".join(words[:40]), " ".join(words[100:140]), " ".join(words[200:260])
    rows = [(1, shared), (2, other), (5, f"{shared} {own[:50]}"), (5, own), (5, f"{other} x"), (None, f"y {other}")]
    left = [tuple(r) for r in suffix_arrays.remove_repeats(documents(rows), **options).collect()]
    body = {(r[0], r[1]): (r[2], bytes(r[4]).decode()) for r in left}
    # The own passage of two texts with id 5 is not long enough to count.
    assert body[5, len(own)] == (0, own)
    assert body[5, len(shared) + 51] == (len(shared), f" {own[:50]}")
    assert body[5, len(other) + 2] == (len(other), " x")
    assert body[None, len(other) + 2] == (len(other), "y ") or body[None, len(other) + 2] == (len(other) + 1, "y")
    left = {(r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in suffix_trees.remove_repeats(documents(rows), **options).collect()}
    tail = own[:50].split()
    assert left == {(1, 40, 0, shared), (2, 40, 0, other), (5, 40 + len(tail), 40, " ".join(tail)), (5, 60, 0, own),
                    (5, 41, 40, "x"), (None, 41, 40, "y")}
