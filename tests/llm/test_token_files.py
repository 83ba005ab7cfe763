import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seqloom.llm import packing
from seqloom.llm import token_files as tf
from seqloom.session import cut_lineage

PATH = public_tokenizers.path("word_bpe_49k.json")
ROWS = [
    (5, "the quick fox"), (3, None), (4, ""), (1, "word " * 3000), (2, 'a "quote" \' " "'), (7, "Über don't É"), (7, "Über don't É"),
    (7, "other"), (None, "no id"), (None, "no id"), (-4, "<|endoftext|> x"), (10, "end"), (6, "a\x1cb ﬁ 日本語"),
]


@pytest.mark.parametrize("ranks", [[], [0], [255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1, 0, 7], list(range(0, 70000, 3))])
def test_ranks_round_trip(ranks):
    control, data = tf.encode_ranks(np.array(ranks, np.uint32))
    assert len(control) == -(-len(ranks) // 4) and len(data) == sum(max(1, -(-int(r).bit_length() // 8)) for r in ranks)
    assert tf.decode_ranks(control, data, len(ranks)).tolist() == ranks


def expected(rows):
    plain = Tokenizer.from_file(PATH)
    ids = [(key, plain.encode(text or "", add_special_tokens=False).ids + [1]) for key, text in rows]
    return sorted((str(key), tuple(i)) for key, i in ids)


@pytest.mark.parametrize("options", [{}, {"segment_ids": 16, "file_bytes": 200}, {"segment_ids": 3, "file_bytes": 1}])
def test_files_hold_every_id_in_order(documents, tmp_path, options):
    files = tf.write_token_files(documents(ROWS).repartition(5), packing.word_encoder(PATH), str(tmp_path), **options)
    got = sorted(tf.read_token_files(files, str(tmp_path)).collect(), key=lambda r: r["start"])
    found = [(str(r["doc_id"]), tuple(np.frombuffer(bytes(r["ids"]), "<u4").tolist())) for r in got]
    assert sorted(found) == expected(ROWS)
    keys = [r["doc_id"] for r in got]
    assert keys[:2] == [None, None] and [int(k) for k in keys[2:]] == sorted(k for k, _ in ROWS if k is not None)
    at = 0
    for row, (_, ids) in zip(got, found):
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    brief = tf.read_token_files(files, str(tmp_path), with_ids=False)
    assert brief.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(str, brief.collect())) == sorted(str(r.asDict() and tf_row(r)) for r in got)
    assert not (tmp_path / "plain").exists()


def tf_row(row):
    from pyspark.sql import Row

    return Row(doc_id=row["doc_id"], start=row["start"], n_tokens=row["n_tokens"], ids_crc32=row["ids_crc32"])


def test_frequent_ids_take_one_byte(documents, tmp_path):
    rows = [(n, "zebra " * 50 + "quick fox") for n in range(40)]
    tf.write_token_files(documents(rows), packing.word_encoder(PATH), str(tmp_path))
    id_of = tf._ranks(str(tmp_path))
    assert id_of[0] == Tokenizer.from_file(PATH).encode("zebra", add_special_tokens=False).ids[0] and id_of[1] == 1
    size = sum(p.stat().st_size for p in tmp_path.glob("*.ids"))
    assert size < 40 * (53 * 1.25 + 16) + 24 * 40


def test_no_rows(documents, tmp_path):
    files = tf.write_token_files(documents([]), packing.word_encoder(PATH), str(tmp_path))
    assert files.count() == 0 and tf.read_token_files(files, str(tmp_path)).count() == 0


@pytest.mark.parametrize("change", [lambda d: d[:-1], lambda d: d + b"x", lambda d: b"XXXX" + d[4:], lambda d: d[:30]])
def test_damage_stops_the_job(documents, tmp_path, change):
    files = tf.write_token_files(documents(ROWS).coalesce(1), packing.word_encoder(PATH), str(tmp_path))
    path = files.first()["path"]
    data = open(path, "rb").read()
    open(path, "wb").write(change(data))
    with pytest.raises(Exception, match="early|damaged|longer|manifest"):
        tf.read_token_files(files, str(tmp_path)).collect()


def test_text_keys(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two"), ("a", "one"), (None, "none"), ("", "empty")], "doc_id string, text string")
    files = cut_lineage(tf.write_token_files(docs, packing.word_encoder(PATH), str(tmp_path)))
    got = tf.read_token_files(files, str(tmp_path)).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, "", "a", "b"]
