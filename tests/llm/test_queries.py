"""Registered corpus queries at a small scale: against DuckDB where SQL can state them, else against brute force."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from seqloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_repeats import bytes_left, words_left

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def ordered(frame):
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def read(name):
    return pd.read_parquet(f"{SF_DIR}/{name}.parquet")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    left, right = ordered(queries()[name](spark, SF_DIR).toPandas()), ordered(con.sql(ORACLES[name]).df())
    pd.testing.assert_frame_equal(left, right, check_dtype=False, rtol=0, atol=1e-6)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(oracle_sql()) and corpus_pipeline.ORACLE_SQL is None


def test_byte_repeats_over_the_whole_table(spark):
    import hashlib

    rows = list(read("documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = sorted(map(tuple, queries()["op5_suffix_arrays"](spark, SF_DIR).collect()))
    assert got == [(k, n, r, s, hashlib.sha256(left).hexdigest()) for k, n, r, s, left in bytes_left(rows, 100)]


def test_word_repeats_over_the_whole_table(spark):
    import hashlib

    rows = list(read("documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = sorted(map(tuple, queries()["op6_suffix_trees"](spark, SF_DIR).collect()))
    assert got == [(k, n, r, hashlib.sha256(left.encode()).hexdigest()) for k, n, r, left in words_left(rows, 13)]


def test_toxicity_on_held_out_labels(spark):
    scores = queries()["op3_toxicity"](spark, SF_DIR).toPandas()
    assert (scores.held_out == [zlib.crc32(str(k).encode()) % 3 == 1 for k in scores.doc_id]).all()
    found = scores[scores.held_out].merge(read("labels"), on="doc_id")
    rank = found.score.rank()
    toxic = found.toxic == 1
    auc = (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    assert auc > 0.85 and (found.predicted[~toxic] == 1).mean() < 0.05


def test_chat_conversation_of_control_strings(spark):
    row = queries()["op1_chat_prefix_targets"](spark, SF_DIR).filter("conv_id = -7").first()
    assert (row["n_turns"], row["loss_chars"]) == (2, 21)


def test_packing_pads_little(spark):
    pieces = queries()["op4_pack_windows"](spark, SF_DIR).toPandas()
    filled = pieces.groupby("sequence_id").length.sum().to_numpy()
    padding = np.where((filled & (filled - 1)) == 0, 0, 2048 - filled).sum()
    assert padding < 0.01 * filled.sum() and (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_archives_hold_every_page(spark):
    got = queries()["op10_warc_archives"](spark, SF_DIR).toPandas().set_index("page_id")
    pages = read("pages").set_index("page_id")
    assert got.index.is_unique and set(got.index) == set(pages.index)
    assert (got.payload_bytes == pages.html.str.encode("utf-8").str.len().reindex(got.index)).all()


def test_pipeline_gives_pieces(spark):
    assert queries()["pipeline"](spark, SF_DIR).count() > 0


def test_alignment_over_the_whole_table(spark):
    from tests.llm.test_alignment import brute

    rows = [row for row in read("documents")[["doc_id", "text"]].itertuples(index=False, name=None) if len(row[1]) < 400]
    whole = queries()["op12_token_alignment"](spark, SF_DIR).toPandas().set_index("doc_id")
    assert len(whole) == len(read("documents"))
    for key, n_a, n_b, n_groups, n_links, _, _, digest in brute(rows[:60]):
        row = whole.loc[key]
        assert (row.n_a, row.n_b, row.n_groups, row.n_links, row.groups_sha256) == (n_a, n_b, n_groups, n_links, digest)
    assert (whole.n_links == whole.n_a + whole.n_b - whole.n_groups).all() and (whole.count_sum >= whole.n_links).all()


def test_token_files_over_the_whole_table(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries()["op13_token_files"](spark, SF_DIR).toPandas().sort_values("doc_id")
    rows = read("documents").sort_values("doc_id")
    ids = [encoded.ids + [1] for encoded in plain.encode_batch(rows.text.tolist(), add_special_tokens=False)]
    lengths = np.array([len(part) for part in ids])
    assert got.doc_id.tolist() == rows.doc_id.tolist() and got.n_tokens.tolist() == lengths.tolist()
    assert got.start.tolist() == (np.cumsum(lengths) - lengths).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(part, "<u4").tobytes()) for part in ids]
