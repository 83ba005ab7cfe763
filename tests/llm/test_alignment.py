import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from seqloom.llm import alignment as al

PAIR = al.token_pair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
ODD = [
    "", None, " ", "  ", "a", " a  b\n\n c\t d ", "tail \n", "\n head", "x;\r\ny {\r\n}\r", "no break  x　 y z  w", "<|endoftext|> </s> <unk> <0x41>",
    "low▁line", "é ñandú straße ﬁ Ａ é", "日本語 テスト 한국어 🙂🙂", "it's I'll don't 'S", "a" * 400, "x\x00y\x1c z\x85w", "12 345,678.9 !!! -- ___", "word    word",
]


plain = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
plain.encode_special_tokens = True
pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


def tokens(text):
    """A's and B's ids and byte ends of a text, straight from the libraries; None if their bytes are not those of the text."""
    pair = PAIR()
    if not text:
        return None
    want = (" " + text).encode()
    a, b = plain.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    if b"".join(pair.a_bytes[n] for n in a) != want or b"".join(pair.b_bytes[n] for n in b) != want:
        return None
    return a, b, np.cumsum([len(pair.a_bytes[n]) for n in a]).tolist(), np.cumsum([len(pair.b_bytes[n]) for n in b]).tolist()


def brute(rows):
    links, documents, result = {}, defaultdict(set), []
    for number, (_, text) in enumerate(rows):
        found = tokens(text)
        if found is None:
            continue
        a, b, ends_a, ends_b = found
        links[number] = Counter()
        for i, (x, stop) in enumerate(zip(a, ends_a)):
            start = ends_a[i - 1] if i else 0
            for j, (y, until) in enumerate(zip(b, ends_b)):
                if max(start, ends_b[j - 1] if j else 0) < min(stop, until):
                    links[number][x, y] += 1
        for pair in links[number]:
            documents[pair].add(number)
    highest = Counter()
    for (x, _), docs in documents.items():
        highest[x] = max(highest[x], len(docs))
    for number, (key, text) in enumerate(rows):
        if number not in links:
            result.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, ends_a, ends_b = tokens(text)
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            last_a, last_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[i:last_a])) + "|" + ",".join(map(str, b[j:last_b])))
            i, j = last_a, last_b
        here = links[number]
        count = {pair: len(documents[pair]) for pair in here}
        result.append((
            key, len(a), len(b), len(groups), sum(here.values()), sum(n for p, n in here.items() if count[p] == highest[p[0]]),
            sum(n * count[p] for p, n in here.items()), hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return sorted(result, key=str)


@pytest.mark.parametrize("options", [{}, {"shard_docs": 3, "block_bytes": 40}, {"shard_links": 20, "block_bytes": 1}])
def test_matches_brute_force(documents, rng, options):
    words = ["the", "Über", "don't", "x1", "ing", "é,", "of.", "\n", "  ", "ñandú"]
    rows = [(n, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for n in range(60)]
    rows += [(100 + n, text) for n, text in enumerate(ODD)] + [(3, "again"), (None, "no id"), (None, "no id"), (200, "long word, " * 500)]
    got = al.align(documents(rows).repartition(3), PAIR, **options).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_parts_give_the_libraries_ids(rng):
    alphabet = ["a", "Z", "é", " ", " ", "\n", "\t", "\r", "\x0b", " ", " ", "　", "'s", "9", ".", "the", "🙂", "́", "▁", "x;"]
    pair = al.TokenPair(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN, part_bytes=2)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))
        found, direct = pair.parts(text.encode()), tokens(text)
        assert (found is None) == (direct is None), repr(text)
        if found:
            assert [[n for part in found for n in part[side]] for side in (0, 1)] == [direct[0], direct[1]], repr(text)


def test_postings_round_trip():
    r = random.Random(2)
    found = {(r.choice([5, 70000, 2**31]), r.randrange(4096)): r.choice([1, 1, 1, 2, 3, 9, 1000]) for _ in range(3000)}
    keys = sorted(found)
    pairs, members = (np.array(column, np.int64) for column in zip(*keys))
    times = np.array([found[key] for key in keys], np.int64)
    a, b, n_docs, summary, words, planes = al.encode_postings(pairs, members, times)
    assert [x << 16 | y for x, y in zip(a.to_pylist(), b.to_pylist())] == sorted(set(pairs.tolist()))
    flat, _ = al.byte_rows(words)
    bits, starts = al.byte_rows(planes)
    row, member, again = al.decode_postings(n_docs.to_numpy().astype(np.int64), summary.to_numpy(), flat, bits, starts)
    assert member.tolist() == members.tolist() and again.tolist() == times.tolist()
    assert np.array(sorted(set(pairs.tolist())))[row].tolist() == pairs.tolist()


def test_no_rows(documents):
    assert al.align(documents([]), PAIR).count() == 0


def test_a_very_long_text_and_a_hot_pair(documents):
    rows = [(0, "the and ing of " * 60_000)] + [(n, "the and") for n in range(1, 3000)]
    got = {r["doc_id"]: r for r in al.align(documents(rows), PAIR, shard_docs=512).collect()}
    assert len(got) == 3000 and got[0]["n_links"] >= 240_000
    one, long = got[1], got[0]
    assert one["n_best"] == one["n_links"] and one["count_sum"] == 3000 * one["n_links"] and long["n_groups"] >= 240_000
