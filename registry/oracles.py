"""The result of each query as DuckDB SQL over the same tables."""

from __future__ import annotations

import re

from registry.queries import COPIED, FIT_K, FIT_LEVELS, HASH_PARTITIONS, KS
from registry.tables import K
from seqloom.schemas import BOS, EOS, HISTORY_ITEMS, INPUT_LENGTH, LEVEL_OFFSETS, PAD, VOCAB_SIZE

# The cores below end earlier; `CONVERGED` makes a query fail whose last two rounds differ.
ROUNDS = 12
MASK = 4294967295


def deduplicated(source: str) -> str:
    return f"""
        SELECT user_id, parent_asin, asin, rating, verified_purchase, helpful_vote, "timestamp" AS ts_ms,
               epoch_ms("timestamp") AS event_ts, category
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, parent_asin, "timestamp"
                ORDER BY rating, asin, helpful_vote, verified_purchase, category) AS rn FROM {source})
        WHERE rn = 1"""


def labelled(source: str) -> str:
    return f"""
        SELECT *, seq_len - pos + 1 AS rev_pos,
               CASE seq_len - pos WHEN 0 THEN 'test' WHEN 1 THEN 'valid' ELSE 'train' END AS split
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, parent_asin) AS pos,
                     count(*) OVER (PARTITION BY user_id) AS seq_len FROM {source})"""


def core_rounds(source: str, k: int) -> dict[str, str]:
    """Chained CTEs core_0 .. core_ROUNDS; further rounds after the fixpoint change nothing."""
    ctes = {"core_0": f"SELECT * FROM {source}"}
    for r in range(1, ROUNDS + 1):
        before, users = f"core_{r - 1}", f"core_{r}_u"
        ctes[users] = f"""SELECT * FROM {before} WHERE user_id IN
            (SELECT user_id FROM {before} GROUP BY user_id HAVING count(*) >= {k})"""
        ctes[f"core_{r}"] = f"""SELECT * FROM {users} WHERE parent_asin IN
            (SELECT parent_asin FROM {users} GROUP BY parent_asin HAVING count(*) >= {k})"""
    return ctes


def spark_hash(keys: str, key: str) -> dict[str, str]:
    """CTEs ending in hashed(key, h): Spark's 32-bit Murmur3 of a bigint column, seed 42, as a signed number."""

    def rotl(x: str, by: int) -> str:
        return f"((({x} << {by}) & {MASK}) | ({x} >> {32 - by}))"

    def times(x: str, factor: int) -> str:
        return f"(({x} * {factor}::UBIGINT) & {MASK})"

    # The multipliers, rotations and shifts of MurmurHash3 x86_32.
    c1, c2, add = 0xCC9E2D51, 0x1B873593, 0xE6546B64
    mix_a, mix_b = 0x85EBCA6B, 0xC2B2AE35
    halves = f"({key} & {MASK})::UBIGINT AS lo, (({key} >> 32) & {MASK})::UBIGINT AS hi"
    steps = {
        "m0": f"SELECT {key} AS key, {halves} FROM (SELECT DISTINCT {key} FROM {keys})",
        "m1": f"SELECT key, {times('lo', c1)} AS lo, {times('hi', c1)} AS hi FROM m0",
        "m2": f"SELECT key, {times(rotl('lo', 15), c2)} AS lo, {times(rotl('hi', 15), c2)} AS hi FROM m1",
        "m3": "SELECT key, hi, xor(42::UBIGINT, lo) AS h FROM m2",
        "m4": f"SELECT key, xor(({rotl('h', 13)} * 5 + {add}) & {MASK}, hi) AS h FROM m3",
        "m5": f"SELECT key, xor(({rotl('h', 13)} * 5 + {add}) & {MASK}, 8::UBIGINT) AS h FROM m4",
        "m6": f"SELECT key, {times('xor(h, h >> 16)', mix_a)} AS h FROM m5",
        "m7": f"SELECT key, {times('xor(h, h >> 13)', mix_b)} AS h FROM m6",
        "m8": "SELECT key, xor(h, h >> 16)::BIGINT AS h FROM m7",
        "hashed": "SELECT key, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM m8",
    }
    return steps


def pmod(x: str, n: int) -> str:
    return f"((({x} % {n}) + {n}) % {n})"


def level_step(level: int) -> dict[str, str]:
    """Centroids of one level, the nearest of them for every vector, and what is left after subtracting it."""
    codes = "".join(f"v.c{i}, " for i in range(1, level + 1))
    errors = "".join(f"v.e{i}, " for i in range(1, level + 1))
    kept = (codes + errors).replace("v.", "")
    return {
        f"centre_{level}": means(f"SELECT (vec_id + {level} * (vec_id // {K})) % {K} AS code, r FROM left_{level}"),
        f"near_{level}": f"""SELECT v.vec_id, {codes}{errors} v.r, c.code, c.r AS centre,
            row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.r, c.r), c.code) AS rn
            FROM left_{level} v CROSS JOIN centre_{level} c""",
        f"left_{level + 1}": f"""SELECT vec_id, {kept} code AS c{level + 1},
            list_distance(r, centre) * list_distance(r, centre) AS e{level + 1},
            list_transform(list_zip(r, centre), lambda p: p[1] - p[2]) AS r
            FROM near_{level} WHERE rn = 1""",
    }


def means(rows: str) -> str:
    """The mean vector r of each code."""
    return f"""SELECT code, list(m ORDER BY dim) AS r FROM (SELECT code, dim, avg(x) AS m FROM
        (SELECT code, unnest(range(len(r))) AS dim, unnest(r) AS x FROM ({rows})) GROUP BY code, dim) GROUP BY code"""


def nearest(vectors: str, centres: str) -> str:
    return f"""SELECT v.vec_id, v.r, c.code, c.r AS centre FROM {vectors} v CROSS JOIN {centres} c
        QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY list_distance(v.r, c.r), c.code) = 1"""


def fitted(vectors: str, name: str, iterations: int = 2) -> dict[str, str]:
    """Residual quantiser fitted by plain k-means steps from the vectors numbered below FIT_K; a centre without rows stays."""
    ctes = {f"{name}_left_0": f"SELECT vec_id, r FROM {vectors}"}
    for level in range(FIT_LEVELS):
        left = f"{name}_left_{level}"
        ctes[f"{name}_{level}_0"] = f"SELECT vec_id AS code, r FROM {left} WHERE vec_id < {FIT_K}"
        for step in range(iterations):
            before = f"{name}_{level}_{step}"
            ctes[f"{before}_near"] = nearest(left, before)
            ctes[f"{name}_{level}_{step + 1}"] = f"""SELECT b.code, coalesce(m.r, b.r) AS r FROM {before} b
                LEFT JOIN ({means(f'SELECT code, r FROM {before}_near')}) m ON m.code = b.code"""
        ctes[f"{name}_near_{level}"] = nearest(left, f"{name}_{level}_{iterations}")
        ctes[f"{name}_left_{level + 1}"] = f"""SELECT vec_id, list_transform(list_zip(r, centre), lambda p: p[1] - p[2]) AS r
            FROM {name}_near_{level}"""
    return ctes


def revived_fit(name: str, iterations: int) -> dict[str, str]:
    """As `fitted`, from starting rows of which the last eight are copies; codes without rows move to the next spare rows."""
    ctes = {f"{name}_left_0": f"""SELECT vec_id, r, CASE WHEN vec_id < {FIT_K - 8} THEN vec_id END AS start,
            CASE WHEN vec_id BETWEEN 100 AND 139 THEN vec_id - 100 END AS spare FROM left_0
        UNION ALL SELECT vec_id + {COPIED}, r, vec_id + 8, NULL FROM left_0 WHERE vec_id BETWEEN {FIT_K - 16} AND {FIT_K - 9}"""}
    for level in range(FIT_LEVELS):
        left = f"{name}_left_{level}"
        ctes[f"{name}_{level}_0"] = f"SELECT start AS code, r, 0::BIGINT AS taken FROM {left} WHERE start IS NOT NULL"
        for step in range(iterations):
            before = f"{name}_{level}_{step}"
            ctes[f"{before}_near"] = nearest(left, before)
            ctes[f"{before}_unused"] = f"""SELECT code, taken + row_number() OVER (ORDER BY code) - 1 AS n FROM {before}
                WHERE code NOT IN (SELECT code FROM {before}_near)"""
            ctes[f"{name}_{level}_{step + 1}"] = f"""SELECT b.code, coalesce(m.r, s.r, b.r) AS r,
                    b.taken + (SELECT count(*) FROM {before}_unused) AS taken FROM {before} b
                LEFT JOIN ({means(f'SELECT code, r FROM {before}_near')}) m ON m.code = b.code
                LEFT JOIN {before}_unused u ON u.code = b.code LEFT JOIN {left} s ON s.spare = u.n"""
        ctes[f"{name}_near_{level}"] = nearest(left, f"{name}_{level}_{iterations}")
        ctes[f"{name}_left_{level + 1}"] = f"""SELECT vec_id, list_transform(list_zip(n.r, centre), lambda p: p[1] - p[2]) AS r,
            start, spare FROM {name}_near_{level} n JOIN {left} l USING (vec_id)"""
    return ctes


CTES: dict[str, str] = {
    "raw": """
        SELECT CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating, l_suppkey AS asin, l_partkey AS parent_asin,
               o_custkey AS user_id, epoch_ms(o_orderdate) AS "timestamp", CAST(l_linenumber AS BIGINT) AS helpful_vote,
               l_returnflag <> 'R' AS verified_purchase, l_returnflag AS category, l_linenumber
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "clean": deduplicated("raw"),
    "event_rows": """
        SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS parent_asin, epoch_us(ts) // 1000 AS ts_ms,
               event_type AS category FROM events""",
    "item_rows": """
        SELECT p_partkey AS parent_asin, p_name AS title, p_type || '|size ' || p_size AS description,
               p_type || '|' || p_brand AS categories, p_brand AS store, p_type AS main_category,
               printf('%.2f', p_retailprice) AS price, p_size / 10.0::DOUBLE AS average_rating,
               CAST(p_size AS BIGINT) AS rating_number FROM part""",
    "loo": labelled("clean"),
    "train_rows": "SELECT parent_asin, count(*) AS rows FROM loo WHERE split = 'train' GROUP BY 1",
    "popular": """
        SELECT parent_asin, rows, CAST(row_number() OVER (ORDER BY rows DESC, parent_asin) - 1 AS INTEGER) AS rank
        FROM train_rows QUALIFY rank < 10""",
    "truth": "SELECT user_id, parent_asin FROM loo WHERE split = 'test' AND seq_len >= 3",
    "popular_ranks": "SELECT user_id, rank FROM truth LEFT JOIN popular USING (parent_asin)",
    "repeats": """
        SELECT user_id, parent_asin,
               row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, parent_asin) - 1 AS rank
        FROM loo WHERE split = 'train' GROUP BY user_id, parent_asin QUALIFY rank < 10""",
    "repeat_ranks": "SELECT user_id, rank FROM truth LEFT JOIN repeats USING (user_id, parent_asin)",
    "event_loo": labelled("event_rows"),
    "left_0": "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS r FROM embeddings",
    **level_step(0),
    **level_step(1),
    **level_step(2),
    "coded": """
        SELECT p_partkey AS parent_asin, left_3.* FROM part
        JOIN left_3 ON vec_id = p_partkey % (SELECT count(*) FROM embeddings)""",
    "coded_by_id": "SELECT p_partkey AS parent_asin, left_3.* FROM part JOIN left_3 ON vec_id = p_partkey",
}
for _name, _source in (("sids", "coded"), ("sids_by_id", "coded_by_id")):
    CTES[_name] = f"""
        SELECT parent_asin, CAST(c1 AS INTEGER) AS c1, CAST(c2 AS INTEGER) AS c2, CAST(c3 AS INTEGER) AS c3,
               CAST(row_number() OVER (PARTITION BY c1, c2, c3 ORDER BY parent_asin) - 1 AS INTEGER) AS c_collision
        FROM {_source}"""
for _name, _source in (("tok", "sids"), ("tok_by_id", "sids_by_id")):
    CTES[_name] = f"""
        SELECT parent_asin, [c1 + {LEVEL_OFFSETS[0]}, c2 + {LEVEL_OFFSETS[1]}, c3 + {LEVEL_OFFSETS[2]},
                             c_collision + {LEVEL_OFFSETS[3]}] AS tokens FROM {_source}"""
for _name, _source in (("seqs", "tok"), ("seqs_by_id", "tok_by_id")):
    CTES[_name] = f"""
        SELECT user_id, list(tokens ORDER BY ts_ms, parent_asin) AS toks, count(*) AS n
        FROM clean JOIN {_source} USING (parent_asin) GROUP BY user_id"""


def with_ctes(select: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the CTEs it mentions, directly or through others, in definition order."""
    known = {**CTES, **(extra or {})}
    needed: set[str] = set()
    waiting = [select]
    while waiting:
        words = set(re.findall(r"\w+", waiting.pop()))
        found = (words & known.keys()) - needed
        needed |= found
        waiting += [known[name] for name in found]
    if not needed:
        return select
    parts = [f"{name} AS MATERIALIZED ({text})" for name, text in known.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + select


def metrics(ranks: str) -> str:
    one = """SELECT {k}::INTEGER AS k, count(*) AS users,
        round(avg(CASE WHEN rank < {k} THEN 1.0 ELSE 0.0 END), 6) AS recall,
        round(avg(CASE WHEN rank < {k} THEN 1.0 / log2(rank + 2) ELSE 0.0 END), 6) AS ndcg FROM {ranks}"""
    return " UNION ALL ".join(one.format(k=k, ranks=ranks) for k in KS)


def distribution(counts: str) -> str:
    return f"""SELECT quantile_disc(count, 0.5) AS p50, quantile_disc(count, 0.95) AS p95,
        quantile_disc(count, 0.99) AS p99, min(count) AS min, round(avg(count), 6) AS avg, max(count) AS max
        FROM {counts}"""


def partition_distribution(counts: str, extra: str = "") -> str:
    return f"""SELECT quantile_disc(count, 0.5) AS p50, quantile_disc(count, 0.95) AS p95,
        quantile_disc(count, 0.99) AS p99, min(count) AS min, round(avg(count), 6) AS avg, max(count) AS max,
        round(stddev_samp(count), 6) AS stddev, round(max(count) / greatest(avg(count), 1.0), 6) AS imbalance{extra}
        FROM {counts}"""


def text(array: str) -> str:
    return f"array_to_string({array}, ' ')"


def examples(seqs: str, split: str) -> str:
    """1-based position p of the target; its history is the up to HISTORY_ITEMS items before it."""
    position = {
        "test": f"SELECT user_id, toks, n, n AS p FROM {seqs} WHERE n >= 3",
        "valid": f"SELECT user_id, toks, n, n - 1 AS p FROM {seqs} WHERE n >= 3",
        "train": f"SELECT user_id, toks, n, unnest(range(2, n - 1)) AS p FROM {seqs} WHERE n >= 3",
    }[split]
    return f"""SELECT user_id, p - 1 AS t, '{split}' AS split,
        list_concat([{BOS}], flatten(toks[greatest(p - {HISTORY_ITEMS}, 1):p - 1])) AS inp, toks[p] AS tgt
        FROM ({position})"""


def example_text(seqs: str, split: str) -> str:
    made = examples(seqs, split)
    return f"SELECT user_id, t, split, {text('inp')} AS inp, {text('tgt')} AS tgt FROM ({made})"


ENRICHED = """SELECT user_id, parent_asin, ts_ms, title, description, categories, store, main_category, price,
    average_rating, rating_number FROM {} LEFT JOIN item_rows USING (parent_asin)"""
CONVERGED = f"""CASE WHEN (SELECT count(*) FROM core_{ROUNDS}) = (SELECT count(*) FROM core_{ROUNDS - 1}) THEN true
    ELSE error('more rounds are needed') END"""
CORE = f"SELECT user_id, parent_asin, ts_ms, rating, category FROM core_{ROUNDS} WHERE {CONVERGED}"
ROUND_ROWS = " UNION ALL ".join(f"SELECT {r}::INTEGER AS round, count(*) AS rows FROM core_{r}" for r in range(1, ROUNDS + 1))
ROUNDS_TO_FIXPOINT = f"""SELECT round, rows FROM (SELECT *, min(CASE WHEN rows = before THEN round END) OVER () AS last
    FROM (SELECT *, lag(rows) OVER (ORDER BY round) AS before FROM ({ROUND_ROWS}))) WHERE round <= last"""
DEPTHS = " UNION ALL ".join(
    f"SELECT {d}::INTEGER AS depth, tokens[1:{d}] AS prefix, {f'tokens[{d + 1}]' if d < 4 else EOS} AS token FROM tok"
    for d in range(5)
)
PREFIXES = f"SELECT depth, prefix, list_sort(list(DISTINCT token)) AS next FROM ({DEPTHS}) GROUP BY depth, prefix"


ITEM_TEXT = """
            SELECT parent_asin, title || '. ' || replace(categories, '|', ' ') || '. ' || store || '. '
                   || replace(description, '|', ' ') AS text FROM item_rows"""
SEQUENCES = """
            SELECT user_id, 0::BIGINT AS chunk, string_agg(parent_asin, ' ' ORDER BY ts_ms, parent_asin) AS items,
                   count(*) AS n, count(*) - 2 AS n_train FROM clean GROUP BY user_id"""
EMBEDDED = """
            SELECT parent_asin, CAST((((g * 2654435769) & 4294967295) >> 16) % 64 AS INTEGER) AS bucket, count(*)::DOUBLE AS ngrams
            FROM (SELECT parent_asin, ord(t[i]) + 257 * ord(t[i + 1]) + 66049 * ord(t[i + 2])::BIGINT AS g
                  FROM (SELECT parent_asin, t, unnest(range(1, length(t) - 1)) AS i
                        FROM (SELECT parent_asin, title || '. ' || replace(categories, '|', ' ') || '. ' || store || '. '
                                     || replace(description, '|', ' ') AS t FROM item_rows))) GROUP BY 1, 2"""
USED_ITEMS = """
            SELECT *, CAST(price AS DOUBLE) AS price_number FROM item_rows
            WHERE parent_asin IN (SELECT parent_asin FROM event_rows)"""
ALLOWED = f"""
            SELECT parent_asin, {text('a.prefix')} AS prefix,
                   coalesce({text('p.next')}, '{EOS}') AS next
            FROM (SELECT parent_asin, CASE WHEN parent_asin % 7 = 0 THEN [tokens[2], tokens[1]]
                         ELSE tokens[1:parent_asin % 5] END AS prefix FROM tok) a
            LEFT JOIN ({PREFIXES}) p ON a.prefix = p.prefix"""
LABELLED = "SELECT user_id, parent_asin, rating, ts_ms, category, pos, rev_pos, split FROM loo"


def _oracles() -> dict[str, str]:
    return {
        "ingest_clean": with_ctes("SELECT * FROM clean"),
        "ingest_report": with_ctes("""
            SELECT *, raw_rows - rows AS removed,
                   round(100.0 * (raw_rows - rows) / greatest(raw_rows, 1), 6) AS removed_pct,
                   round(rows / greatest(users, 1), 6) AS rows_per_user
            FROM (SELECT count(*) AS raw_rows FROM raw),
                 (SELECT count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) AS items,
                         min(ts_ms) AS min_ts_ms, max(ts_ms) AS max_ts_ms FROM clean)"""),
        "ingest_by_category": with_ctes("SELECT category, count(*) AS rows FROM clean GROUP BY 1"),
        "ts_digits": with_ctes("""
            SELECT CAST(length(CAST(ts_ms AS VARCHAR)) AS INTEGER) AS digits, count(*) AS rows
            FROM (SELECT ts_ms FROM event_rows UNION ALL SELECT ts_ms FROM clean) GROUP BY 1"""),
        "category_union": " UNION ALL ".join(
            f"SELECT l_orderkey, l_linenumber, l_quantity, '{flag}' AS category FROM lineitem WHERE l_returnflag = '{flag}'"
            for flag in ("A", "N", "R")
        ),
        "predicate_mix": with_ctes("""
            SELECT count(*) AS users, CAST(sum(n) AS BIGINT) AS rows, quantile_disc(n, 0.5) AS p50,
                   count(DISTINCT n) AS levels
            FROM (SELECT user_id, count(*) AS n FROM clean
                  WHERE category = 'N' AND rating >= 4.0 AND verified_purchase GROUP BY 1) WHERE n BETWEEN 6 AND 10"""),
        "scalar_filter": with_ctes("""
            SELECT user_id, parent_asin, ts_ms, rating FROM clean
            WHERE user_id = (SELECT max(user_id) FROM clean WHERE rating >= 5.0)"""),
        "user_hash_sample": with_ctes(
            f"""SELECT user_id, parent_asin, ts_ms FROM clean JOIN hashed ON key = user_id
                WHERE {pmod('h', 100)} < 20""",
            spark_hash("clean", "user_id"),
        ),
        "row_hash_sample": """
            SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
            WHERE ('0x' || substr(md5('sample:' || l_orderkey || ':' || l_linenumber), 1, 8))::BIGINT / 4294967296.0 < 0.1""",
        "json_checked_rows": with_ctes("SELECT * EXCLUDE l_linenumber FROM raw WHERE l_linenumber NOT IN (6, 7)"),
        "json_quarantine_report": with_ctes("""
            SELECT *, round(100.0 * malformed / greatest(rows + malformed, 1), 6) AS malformed_pct FROM (
                SELECT category, count(*) FILTER (l_linenumber NOT IN (6, 7)) AS rows,
                       count(*) FILTER (l_linenumber IN (6, 7)) AS malformed FROM raw GROUP BY category)"""),
        "partition_pruned_read": with_ctes("SELECT * EXCLUDE event_ts FROM clean WHERE category = 'N'"),
        "partition_pruned_join": with_ctes("""
            SELECT c.* EXCLUDE event_ts, verified FROM clean c JOIN (
                SELECT category, count(*) FILTER (verified_purchase) AS verified FROM clean GROUP BY category) k
            ON c.category = k.category WHERE verified = 0"""),
        "loo_split_bucketed": with_ctes(LABELLED),
        "loo_split_bucketed_hot": with_ctes(LABELLED),
        "user_totals_bucketed": with_ctes("""
            SELECT user_id, parent_asin, ts_ms, count(*) OVER u AS user_rows, max(ts_ms) OVER u AS last_ts_ms
            FROM clean WINDOW u AS (PARTITION BY user_id)"""),
        "kcore_losses_by_round": with_ctes(CORE, core_rounds("clean", 23)),
        "kcore_peel_hot_keys": with_ctes(CORE, core_rounds("clean", 23)),
        "kcore_dissolves_by_round": with_ctes(CORE, core_rounds("clean", 24)),
        "kcore_dense_k20": with_ctes(CORE, core_rounds("clean", 20)),
        "kcore_losses": with_ctes(CORE, core_rounds("clean", 23)),
        "kcore_hot_keys": with_ctes(CORE, core_rounds("clean", 23)),
        "kcore_dissolves_k24": with_ctes(CORE, core_rounds("clean", 24)),
        "kcore_own_columns": with_ctes(
            f"SELECT o_orderkey, user_id AS o_custkey, parent_asin AS o_orderpriority FROM core_{ROUNDS} WHERE {CONVERGED}",
            core_rounds("(SELECT o_orderkey, o_custkey AS user_id, o_orderpriority AS parent_asin FROM orders)", 10),
        ),
        "kcore_empty_k30": with_ctes(CORE, core_rounds("clean", 30)),
        "kcore_rounds": with_ctes(ROUNDS_TO_FIXPOINT, core_rounds("clean", 23)),
        "kcore_report": with_ctes(
            f"""SELECT (SELECT max(round)::INTEGER FROM ({ROUNDS_TO_FIXPOINT})) AS rounds, true AS converged,
                       (SELECT count(*) FROM clean) AS input_rows, count(*) AS rows,
                       round(100.0 * count(*) / greatest((SELECT count(*) FROM clean), 1), 6) AS kept_pct,
                       count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) AS items,
                       round(count(*) / greatest(count(DISTINCT user_id), 1), 6) AS rows_per_user
                FROM core_{ROUNDS}""",
            core_rounds("clean", 23),
        ),
        "kcore_strategy_report": with_ctes(
            f"""SELECT strategy, round, rows FROM ({ROUNDS_TO_FIXPOINT}),
                (SELECT unnest(['delta', 'table', 'persist', 'recompute']) AS strategy)""",
            core_rounds("clean", 23),
        ),
        "sessionize": with_ctes("SELECT user_id, parent_asin, ts_ms, pos, seq_len FROM loo"),
        "sessionize_events": with_ctes(
            "SELECT user_id, parent_asin, ts_ms, category, pos, seq_len FROM event_loo",
        ),
        "sessionize_sliced": with_ctes("SELECT user_id, parent_asin, ts_ms, pos, seq_len FROM loo"),
        "user_sequences_chunked": with_ctes("""
            SELECT user_id, (pos - 1) // 10 AS chunk, string_agg(parent_asin, ' ' ORDER BY pos) AS items,
                   max(seq_len) AS n, max(seq_len) - 2 AS n_train FROM loo GROUP BY user_id, chunk"""),
        "loo_split_own_columns": with_ctes(
            "SELECT user_id AS o_custkey, parent_asin AS o_orderkey, pos, rev_pos, split FROM order_loo",
            {"order_loo": labelled("(SELECT o_custkey AS user_id, o_orderkey AS parent_asin, o_orderdate AS ts_ms FROM orders)")},
        ),
        "dedup_items_own_column": with_ctes("SELECT parent_asin AS sku, title, store FROM item_rows"),
        "user_sequences": with_ctes(SEQUENCES),
        "sequences_read_back": with_ctes(SEQUENCES),
        "loo_split": with_ctes(LABELLED),
        "loo_report": with_ctes("""
            SELECT *, valid = users AS valid_is_users, test = users AS test_is_users FROM (
                SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid,
                       count(*) FILTER (split = 'test') AS test, count(DISTINCT user_id) AS users FROM loo)"""),
        "example_user": with_ctes("""
            SELECT user_id, parent_asin, pos, rev_pos, split FROM event_loo
            WHERE user_id = (SELECT min(user_id) FROM event_loo WHERE seq_len BETWEEN 1 AND 200)"""),
        "enrich_merge": with_ctes(ENRICHED.format("clean")),
        "enrich_broadcast": with_ctes(ENRICHED.format("clean")),
        "enrich_reduced": with_ctes(ENRICHED.format("event_rows")),
        "enrich_auto": with_ctes(ENRICHED.format("event_rows")),
        "enrich_over_limit": with_ctes("""
            SELECT user_id, parent_asin, ts_ms, title, store FROM clean LEFT JOIN item_rows USING (parent_asin)"""),
        "interactions_from_json": with_ctes("SELECT * FROM clean"),
        "used_items": with_ctes(USED_ITEMS),
        "used_items_reduced": with_ctes(USED_ITEMS),
        "join_plan_report": with_ctes("""
            SELECT strategy, join_node, rows, matched FROM (VALUES ('merge', 'SortMergeJoin'),
                ('broadcast', 'BroadcastHashJoin'), ('reduced_broadcast', 'BroadcastHashJoin')) s(strategy, join_node),
                (SELECT count(*) AS rows, count(title) AS matched FROM clean LEFT JOIN item_rows USING (parent_asin))"""),
        "aqe_report": with_ctes("""
            SELECT * FROM (SELECT unnest([false, true]) AS adaptive), (
                SELECT count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'valid') AS valid,
                       count(*) FILTER (split = 'test') AS test, count(DISTINCT user_id) AS users FROM loo)"""),
        "repeat_cost_report": with_ctes("""
            SELECT mode, action::INTEGER AS action, CASE mode WHEN 'plan' THEN 0 ELSE rows END AS rows
            FROM (VALUES ('plan', 0), ('recompute', 1), ('recompute', 2), ('cached', 1), ('cached', 2)) s(mode, action),
                 (SELECT count(DISTINCT user_id) AS rows FROM clean WHERE verified_purchase)"""),
        "clean_schema": with_ctes("SELECT position::INTEGER AS position, name, type, filled FROM (" + " UNION ALL ".join(
            f"SELECT {i} AS position, '{name}' AS name, '{kind}' AS type, count({name}) AS filled FROM clean"
            for i, (name, kind) in enumerate((
                ("user_id", "bigint"), ("parent_asin", "bigint"), ("asin", "bigint"), ("rating", "double"),
                ("verified_purchase", "boolean"), ("helpful_vote", "bigint"), ("ts_ms", "bigint"),
                ("event_ts", "timestamp"), ("category", "string"),
            ))) + ")"),
        "user_skew": with_ctes(distribution("(SELECT count(*) AS count FROM clean GROUP BY user_id)")),
        "item_skew": with_ctes(distribution("(SELECT count(*) AS count FROM clean GROUP BY parent_asin)")),
        "hot_items": with_ctes(
            "SELECT parent_asin, count(*) AS count FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"
        ),
        "partition_skew": partition_skew_sql(),
        "partition_layout": with_ctes(
            f"""SELECT {pmod('h', HASH_PARTITIONS)}::INTEGER AS pid, count(*) AS rows
                FROM clean JOIN hashed ON key = parent_asin GROUP BY 1""",
            spark_hash("clean", "parent_asin"),
        ),
        "partition_skew_all": with_ctes(
            partition_distribution(f"""(
                SELECT p.pid, count(h) AS count FROM range({HASH_PARTITIONS}) p(pid)
                LEFT JOIN (SELECT h, {pmod('h', HASH_PARTITIONS)} AS pid FROM customer JOIN hashed ON key = c_nationkey)
                    USING (pid) GROUP BY 1)"""),
            spark_hash("(SELECT c_nationkey::BIGINT AS nation FROM customer)", "nation"),
        ),
        "item_text": with_ctes(ITEM_TEXT),
        "model_text_limited": with_ctes("""
            SELECT parent_asin, substr(title || '. ' || replace(categories, '|', ' ') || '. ' || store || '. '
                   || replace(description, '|', ' '), 1, 20) AS text FROM item_rows"""),
        "embed_items": with_ctes(EMBEDDED),
        "embed_items_by_worker": with_ctes(EMBEDDED),
        "rq_revive": with_ctes(
            "SELECT vec_id, a.code || ' ' || b.code AS codes, "
            + ", ".join(f"round(list_inner_product({x}.r, {x}.r), 6) AS e{n}" for n, x in ((1, "c"), (2, "d")))
            + " FROM rev_near_0 a JOIN rev_near_1 b USING (vec_id) JOIN rev_left_1 c USING (vec_id) JOIN rev_left_2 d USING (vec_id)",
            revived_fit("rev", 3),
        ),
        "standardize": """
            WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS dim,
                              CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
            s AS (SELECT dim, avg(v) AS m, stddev_samp(v) + 1e-6 AS sd FROM x GROUP BY dim)
            SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((v - m) / sd, 6) AS z FROM x JOIN s USING (dim)""",
        "rq_fit": with_ctes(
            " UNION ALL ".join(
                f"""SELECT {level}::INTEGER AS level, round(avg(list_inner_product(r, r) / len(r)), 6) AS mse
                    FROM fit_left_{level + 1}""" for level in range(FIT_LEVELS)),
            fitted("left_0", "fit"),
        ),
        "assign_with_stored_fit": with_ctes(
            "SELECT vec_id, a.code || ' ' || b.code AS codes FROM fit_near_0 a JOIN fit_near_1 b USING (vec_id)",
            {"scaled": f"""SELECT vec_id, list((v - m) / sd ORDER BY dim) AS r FROM (
                SELECT vec_id, dim, v, avg(v) OVER (PARTITION BY dim) AS m,
                       stddev_samp(v) OVER (PARTITION BY dim) + 1e-6 AS sd
                FROM (SELECT vec_id, unnest(range(len(r))) AS dim, unnest(r) AS v FROM left_0)) GROUP BY vec_id""",
             **fitted("scaled", "fit")},
        ),
        "rq_error": with_ctes(" UNION ALL ".join(
            f"""SELECT {i}::INTEGER AS level, round(avg(e{i + 1}) / (SELECT max(len(embedding)) FROM embeddings), 6) AS mse
                FROM coded""" for i in range(3))),
        "rq_assign": with_ctes("""
            SELECT parent_asin, c1 || ' ' || c2 || ' ' || c3 AS codes, round(e1, 6) AS e1, round(e2, 6) AS e2,
                   round(e3, 6) AS e3 FROM coded"""),
        "semantic_ids": with_ctes("SELECT * FROM sids"),
        "sid_report": with_ctes("""
            SELECT CAST(sum(n) AS BIGINT) AS items, count(*) AS combos, CAST(sum(n - 1) AS BIGINT) AS colliding,
                   max(n) AS max_per_combo FROM (SELECT count(*) AS n FROM sids GROUP BY c1, c2, c3)"""),
        "sid_utilisation": with_ctes(" UNION ALL ".join(
            f"SELECT {i}::INTEGER AS level, round(count(DISTINCT c{i + 1}) / {K}.0::DOUBLE, 6) AS used_share FROM sids"
            for i in range(3))),
        "item_tokens": with_ctes(f"SELECT parent_asin, {text('tokens')} AS tokens FROM tok"),
        "valid_ids_read_back": with_ctes(f"SELECT parent_asin, {text('tokens')} AS tokens FROM tok"),
        "examples_read_back": with_ctes(example_text("seqs", "valid")),
        "layout_read_back": with_ctes(f"""
            SELECT user_id, parent_asin, pos, split, text FROM ({LABELLED}) JOIN ({ITEM_TEXT}) USING (parent_asin)
            WHERE split = 'test'"""),
        "token_train": with_ctes(example_text("seqs", "train")),
        "token_blocks": with_ctes(example_text("seqs", "train")),
        "token_valid": with_ctes(example_text("seqs", "valid")),
        "token_test": with_ctes(example_text("seqs", "test")),
        "token_test_missing_ids": with_ctes(example_text("seqs_by_id", "test")),
        "token_report": with_ctes("""
            SELECT count(*) FILTER (n >= 3) AS users,
                   (SELECT count(DISTINCT user_id) FROM clean) - count(*) FILTER (n >= 3) AS skipped,
                   CAST(coalesce(sum(n - 3) FILTER (n >= 3), 0) AS BIGINT) AS train, count(*) FILTER (n >= 3) AS valid,
                   count(*) FILTER (n >= 3) AS test FROM seqs_by_id"""),
        "model_input": with_ctes(f"""
            SELECT user_id, t, split, {text('ids')} AS input_ids,
                   array_to_string(list_transform(ids, lambda x: CAST(x <> {PAD} AS INTEGER)), '') AS attention_mask,
                   {text(f'list_append(tgt, {EOS})')} AS labels
            FROM (SELECT *, list_concat(inp[1:{INPUT_LENGTH}], list_transform(range({INPUT_LENGTH} - len(inp)),
                            lambda i: {PAD})) AS ids FROM ({examples('seqs_by_id', 'valid')}))"""),
        "token_vocabulary": f"""
            SELECT {VOCAB_SIZE}::INTEGER AS vocab_size, {PAD}::INTEGER AS "PAD", {BOS}::INTEGER AS "BOS",
                   {EOS}::INTEGER AS "EOS", '{' '.join(map(str, LEVEL_OFFSETS))}' AS layer_offsets,
                   {HISTORY_ITEMS}::INTEGER AS max_hist_items, count(*) AS n_items FROM part""",
        "prefix_table": with_ctes(f"SELECT depth, {text('prefix')} AS prefix, {text('next')} AS next FROM ({PREFIXES})"),
        "allowed_next": with_ctes(ALLOWED),
        "allowed_next_trie": with_ctes(ALLOWED),
        "popularity_topk": with_ctes("SELECT * FROM popular"),
        "first_targets": with_ctes("SELECT user_id, parent_asin FROM truth ORDER BY user_id LIMIT 50"),
        "popularity_eval": with_ctes(metrics("popular_ranks")),
        "ranked_eval": with_ctes(metrics("repeat_ranks")),
        "sid_to_item": with_ctes("SELECT user_id, rank, parent_asin FROM repeats"),
        "eval_compare": with_ctes(f"""
            SELECT k, m.recall AS model_recall, b.recall AS baseline_recall, round(m.r / nullif(b.r, 0), 6) AS recall_ratio,
                   m.ndcg AS model_ndcg, b.ndcg AS baseline_ndcg, round(m.g / nullif(b.g, 0), 6) AS ndcg_ratio
            FROM ({exact_metrics('repeat_ranks')}) m JOIN ({exact_metrics('popular_ranks')}) b USING (k)"""),
    }


def exact_metrics(ranks: str) -> str:
    """Metrics with their unrounded values r and g, from which ratios are taken."""
    one = """SELECT {k}::INTEGER AS k, avg(CASE WHEN rank < {k} THEN 1.0 ELSE 0.0 END) AS r,
        avg(CASE WHEN rank < {k} THEN 1.0 / log2(rank + 2) ELSE 0.0 END) AS g,
        round(r, 6) AS recall, round(g, 6) AS ndcg FROM {ranks}"""
    return " UNION ALL ".join(one.format(k=k, ranks=ranks) for k in KS)


def partition_skew_sql() -> str:
    ctes: dict[str, str] = {}
    parts = []
    for key in ("user_id", "parent_asin"):
        renamed = {name: f"{key}_{name}" for name in spark_hash("clean", key)}
        for name, body in spark_hash("clean", key).items():
            for old, new in renamed.items():
                body = re.sub(rf"\b{old}\b", new, body)
            ctes[renamed[name]] = body
        counts = f"""(SELECT {pmod('h', HASH_PARTITIONS)} AS pid, count(*) AS count
            FROM clean JOIN {renamed['hashed']} ON key = {key} GROUP BY 1)"""
        parts.append(partition_distribution(counts, f", '{key}' AS key"))
    return with_ctes(" UNION ALL ".join(parts), ctes)


ORACLES = _oracles()
