import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from seqloom.llm import exact_dedup as ed

ROWS = [
    (1, "a b"), (2, "a  b"), (3, "a\t\nb"), (4, "a b "), (5, None), (6, ""), (7, "x" * 300), (8, "x" * 300), (9, "x" * 299 + "y"),
    (9, "x" * 299 + "y"), (None, "a b"), (None, "lone"), (10, "é é"), (11, "é é"), (12, "é é"), (13, "p" * 20), (14, "q" * 20),
    (15, "p" * 20), (16, "r" * 20), (17, "q" * 20), (18, " \n "), (19, " "),
]


def expected(rows):
    groups = defaultdict(list)
    clean = [re.sub(r"[\x20\x09-\x0D]+", " ", text or "") for _, text in rows]
    for (key, _), text in zip(rows, clean):
        groups[text].append(key)
    result = []
    for (key, _), text in zip(rows, clean):
        keys = [k for k in groups[text] if k is not None]
        keep = min(keys) if keys else None
        result.append((key, keep, len(groups[text]), key == keep, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(result, key=str)


@pytest.mark.parametrize("primes", [ed.PRIMES, (7, 5)])
def test_matches_brute_force_also_where_fingerprints_collide(documents, primes):
    got = ed.exact_dedup(documents(ROWS), chunk_bytes=16, primes=primes, bases=(3, 2))
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS)


def test_no_rows(documents):
    assert ed.exact_dedup(documents([])).count() == 0


def test_chunk_hashes_compose():
    whole = bytes(range(256)) * 40
    flat = np.frombuffer(whole, np.uint8)
    for n, (prime, base) in enumerate(zip(ed.PRIMES, ed.BASES)):
        direct = ed.chunk_hashes(flat, np.array([0, len(flat)]))[n][0]
        left, right = ed.chunk_hashes(flat, np.array([0, 1000, len(flat)]))[n]
        assert direct == (left * pow(base, len(flat) - 1000, prime) + right) % prime
        assert direct == sum(b * pow(base, len(whole) - 1 - i, prime) for i, b in enumerate(whole)) % prime
