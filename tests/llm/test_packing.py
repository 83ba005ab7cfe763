import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def corpus(seed, n=300):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["the", "Über", "x1", "don't", "é,", "of."]) for _ in range(int(r.expovariate(1 / 60))))) for i in range(n)]
    return rows + [(1000, None), (1001, ""), (1002, "word " * 5000), (1003, "<|endoftext|> <|ENDOFTEXT|> a\x1cb"), (5, "again"), (None, "no id"), (None, "no id")]


@pytest.mark.parametrize("options", [{}, {"window": 64, "open_windows": 3, "merged_windows": 2, "max_padding": 4}])
def test_every_id_once_in_gapless_windows(documents, options):
    rows = corpus(1)
    window = options.get("window", packing.WINDOW)
    pieces = packing.pack(documents(rows).repartition(6), packing.word_encoder(PATH), **options).collect()
    plain = Tokenizer.from_file(PATH)
    expected = sorted((str(key), tuple(plain.encode(text or "", add_special_tokens=False).ids + [1])) for key, text in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), "<u4")
        assert len(ids) == p["length"] > 0
        docs[p["doc_id"], p["doc_tokens"]].append((p["start"], ids.tolist()))
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    found = []
    for (key, total), parts in docs.items():
        flat = [i for _, ids in sorted(parts) for i in ids]
        if len(flat) == total:
            found.append((str(key), tuple(flat)))
        else:  # equal rows: their pieces lie on each other
            assert len(flat) % total == 0 and key is None
            found += [(str(key), tuple(sorted(parts)[0][1]))] * (len(flat) // total)
    assert sorted(found) == expected
    padding = filled = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        filled += at
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding <= options.get("max_padding", packing.MAX_PADDING) / window * filled + 1e-9 + window * 0


def test_no_rows(documents):
    assert packing.pack(documents([]), packing.word_encoder(PATH)).count() == 0


def test_remembered_words_give_the_tokenizers_ids():
    plain, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH, cached_bytes=1000)
    assert own.direct
    for text in ["", " ", "á é̂", "İstanbul ΣΑΣ", "it's IT'S 3a ½", "가 가", "x\x85y\x1dz", "ǅ ŉ ß ẞ ª º", "a.. ,a .", "<|endoftext|>A", "naïve, Ñandú; (x)", "ab*** ab,&&& ab'' ab's' Ab_ <|x|> é$$$", "'s 't a'S"] * 2:
        assert own.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("letters", ["H̱", "T̈", "W̊", "Y̊", "J̌", "T̈́"])
def test_letters_that_compose_only_in_lower_case(letters):
    plain, own = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for text in [letters + "a", f"The a{letters}, {letters.lower()}a THE {letters}A", letters]:
        assert own.encode(text.encode()).tolist() == plain.encode(text, add_special_tokens=False).ids
