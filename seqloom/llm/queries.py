"""One query per corpus operator over its whole table, and the DuckDB SQL that states its result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import (
    alignment, chat, exact_dedup, mixing, near_dedup, packing, quality_rules, search, suffix_arrays, suffix_trees, token_files,
    toxicity, warc,
)
from seqloom.session import cut_lineage, default_shared_folder, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    default_shared_folder(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_chat_prefix_targets(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(cut_lineage(chat.prefix_examples(turns)))


# A turn is `<s>ROLE\\nTEXT</s>`: eight characters around role and text, and one more for every character that is escaped.
ORACLES["op1_chat_prefix_targets"] = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n FROM c),
l AS (SELECT *, 8 + length(role) + length(text) + len(regexp_extract_all(role || text, '\\'))
             + len(regexp_extract_all(role, chr(10)))
             + 2 * len(regexp_extract_all(role, '</?s>|\[/?INST\]|<</?SYS>>'))
             + 2 * len(regexp_extract_all(text, '</?s>|\[/?INST\]|<</?SYS>>')) AS chars FROM t),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS so_far,
             count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY n DESC) AS replies_from_here FROM l)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (coalesce(sum(so_far) FILTER (role = 'assistant'), 0)
        + coalesce(sum(chars) FILTER (replies_from_here = 0), 0))::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant') AS n_examples
FROM s GROUP BY conv_id
"""


@query
def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op2_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, sha256(t) AS text_sha256, min(doc_id) OVER (PARTITION BY t) AS keep_id,
             count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


def held_out(key: str = "doc_id"):
    """A row without a key is not held out; it has no label either."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


@query
def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), usable=~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file by which ids are defined; the package is on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_pack_windows(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), packing.word_encoder(tokenizer_path()))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op5_suffix_arrays(spark, sf_dir):
    left = suffix_arrays.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# Two hexadecimal digits are a byte; strings of 2, 4, ... bytes are made of two of half the length.
ORACLES["op5_suffix_arrays"] = """
WITH d AS (SELECT doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS bytes FROM documents),
b1 AS (SELECT doc_id, unnest(bytes) AS s1, generate_subscripts(bytes, 1) AS i FROM d),
b2 AS (SELECT doc_id, i, s1, s1 || lead(s1, 1) OVER w AS s2 FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b4 AS (SELECT doc_id, i, s1, s2 || lead(s2, 2) OVER w AS s4 FROM b2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b8 AS (SELECT doc_id, i, s1, s4, s4 || lead(s4, 4) OVER w AS s8 FROM b4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b16 AS (SELECT doc_id, i, s1, s4, s8 || lead(s8, 8) OVER w AS s16 FROM b8 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b32 AS (SELECT doc_id, i, s1, s4, s16 || lead(s16, 16) OVER w AS s32 FROM b16 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b100 AS (SELECT doc_id, i, s1, s32 || lead(s32, 32) OVER w || lead(s32, 64) OVER w || lead(s4, 96) OVER w AS s100
         FROM b32 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, s1, s100 IS NOT NULL AND row_number() OVER (PARTITION BY s100 ORDER BY doc_id, i) > 1 AS again FROM b100),
c AS (SELECT doc_id, i, s1, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 99 PRECEDING) AS gone FROM r),
e AS (SELECT *, gone AND NOT lag(gone, 1, FALSE) OVER (PARTITION BY doc_id ORDER BY i) AS begins FROM c),
l AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
             string_agg(s1, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, len(bytes) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


@query
def op6_suffix_trees(spark, sf_dir):
    left = suffix_trees.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op6_suffix_trees"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w1 AS (SELECT doc_id, unnest(words) AS s1, generate_subscripts(words, 1) AS i FROM d),
w2 AS (SELECT doc_id, i, s1, s1 || ' ' || lead(s1, 1) OVER w AS s2 FROM w1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
w4 AS (SELECT doc_id, i, s1, s2 || ' ' || lead(s2, 2) OVER w AS s4 FROM w2 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
w13 AS (SELECT doc_id, i, s1, s4 || ' ' || lead(s4, 4) OVER w || ' ' || lead(s4, 8) OVER w || ' ' || lead(s1, 12) OVER w AS s13
        FROM w4 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, s1, s13 IS NOT NULL AND min(doc_id) OVER (PARTITION BY s13) < doc_id AS again FROM w13),
c AS (SELECT doc_id, i, s1, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 12 PRECEDING) AS gone FROM r),
l AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(s1, ' ' ORDER BY i) FILTER (NOT gone) AS kept
      FROM c GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id)
"""


@query
def op7_quality_rules(spark, sf_dir):
    judged = quality_rules.cascade(table(spark, sf_dir, "documents"), statistics=list(quality_rules.STATISTICS))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select(
        "doc_id", *quality_rules.STATISTICS, failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept")
    )


ORACLES["op7_quality_rules"] = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM h, (VALUES (0), (1), (2)) s(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
s AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(lines) AS n_lines
      FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 10 * n_symbols <= n_words AND 2 * n_dup_lines <= n_lines
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept FROM b
"""


@query
def op8_mix_sources(spark, sf_dir):
    mixed = mixing.mixed_sizes(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


MIXED = r"""
d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s),
c AS (SELECT *, (sum(source_size) OVER () * 3 / 2.0 - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight,
             source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM k),
v AS (SELECT max(level) FILTER (level * weight <= 2 * source_size) AS level FROM c),
g AS (SELECT source, source_size, least(coalesce(weight * v.level, 2.0 * source_size), 2.0 * source_size) AS target
      FROM c, v),
m AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             ('0x' || substr(md5('mix:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
"""
ORACLES["op8_mix_sources"] = "WITH " + MIXED.format(docs="documents") + """
SELECT doc_id, size, source_size, target, (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) * size AS taken FROM m
"""


@query
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_warc_archives(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    files = cut_lineage(warc.write_archives(pages, folder))
    records = warc.read_archives(files, with_payload=False)
    return records.select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


# Five hexadecimal digits are four of base 32.
ORACLES["op10_warc_archives"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, strlen(html) AS payload_bytes,
       translate(array_to_string(list_transform(generate_series(0, 7), lambda i: to_base(('0x' || substr(hex, 5 * i + 1, 5))::BIGINT, 32, 4)), ''),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""


@query
def op11_ranked_search(spark, sf_dir):
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_ranked_search"] = f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, n_docs),
q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
c AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::BIGINT AS score
      FROM c JOIN w USING (term) JOIN f USING (term) JOIN d USING (doc_id), s GROUP BY item_id, doc_id),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM r WHERE score > 0)
SELECT * FROM o WHERE rank <= 10
"""


@query
def op12_token_alignment(spark, sf_dir):
    import public_tokenizers

    pair = alignment.token_pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    return alignment.align(table(spark, sf_dir, "documents"), pair)


@query
def op13_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    files = token_files.write_token_files(docs, packing.word_encoder(tokenizer_path()), folder)
    read = token_files.read_token_files(files, folder, with_ids=False)
    return read.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
