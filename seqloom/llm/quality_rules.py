"""Quality rules as a short-circuit cascade whose order is estimated on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import WHITE_SPACE, text_or_empty

SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 2_000


def n_words(text: bytes) -> int:
    return len(text.split())


def word_chars(text: bytes) -> int:
    """Code points in words."""
    return len(text.translate(None, WHITE_SPACE).decode("utf-8", "replace"))


def n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, SYMBOLS))


def _lines(text: bytes) -> list[bytes]:
    return [line for line in text.split(b"\n") if line.translate(None, WHITE_SPACE)]


def n_dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = _lines(text)
    return len(lines) - len(set(lines))


def n_repeat_words(text: bytes) -> int:
    """Words covered by windows of three words that the text holds twice or more."""
    words = text.split()
    if len(words) < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(word, len(seen)) for word in words), np.int64, len(words))
    pairs = ids[:-1] * len(seen) + ids[1:]
    if len(seen) ** 3 >= 2**63:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(seen) + ids[2:]
    order = np.argsort(windows)
    equal = windows[order][1:] == windows[order][:-1]
    repeated = np.zeros(len(words), bool)
    twice = np.concatenate([order[1:][equal], order[:-1][equal]])
    for shift in range(3):
        repeated[twice + shift] = True
    return int(repeated.sum())


STATISTICS: dict[str, Callable[[bytes], int]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text for which `rejects` is true."""

    name: str
    rejects: Callable[[bytes], bool]


def default_rules() -> list[Rule]:
    """Texts under 50 words, repetitive, full of symbols, with mostly copied lines, or with very short or long words."""
    return [
        Rule("few_words", lambda text: n_words(text) < 50),
        Rule("repetition", lambda text: 100 * n_repeat_words(text) > 50 * n_words(text)),
        Rule("symbols", lambda text: 10 * n_symbols(text) > n_words(text)),
        Rule("copied_lines", lambda text: 2 * n_dup_lines(text) > len(_lines(text))),
        Rule("word_length", lambda text: not 2 * n_words(text) <= word_chars(text) <= 15 * n_words(text)),
    ]


def _bytes(text) -> bytes:
    return b"" if text is None or not isinstance(text, str) else text.encode("utf-8", "replace")


def estimate(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Seconds per text and share of texts rejected, for each rule alone on a sample of about `sample_rows` texts.

    The executors time the rules; the driver gets one summed row per rule.
    """
    def timed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [_bytes(value) for value in batch["text"]]
            for number, rule in enumerate(rules):
                began = time.perf_counter()
                rejected = sum(bool(rule.rejects(value)) for value in texts)
                took = time.perf_counter() - began
                yield pd.DataFrame({"rule": [number], "seconds": [took], "rejected": [rejected], "texts": [len(texts)]})

    total = docs.count()
    if not total:
        return [{"rule": rule.name, "seconds": 0.0, "rejected": 0.0} for rule in rules]
    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / total), seed=7)
    sums = (
        sample.mapInPandas(timed, "rule int, seconds double, rejected long, texts long")
        .groupBy("rule").agg(*[F.sum(name).alias(name) for name in ("seconds", "rejected", "texts")])
    )
    found = {row["rule"]: row for row in sums.collect()}
    result = []
    for number, rule in enumerate(rules):
        row = found.get(number)
        texts = row["texts"] if row else 1
        result.append({"rule": rule.name, "seconds": row["seconds"] / texts if row else 0.0,
                       "rejected": row["rejected"] / texts if row else 0.0})
    return result


def ordered(rules: Sequence[Rule], estimates: Sequence[dict]) -> list[Rule]:
    """Most rejections per second first; equal ones keep their order. The order never changes a verdict."""
    gain = {e["rule"]: e["rejected"] / max(e["seconds"], 1e-9) for e in estimates}
    return sorted(rules, key=lambda rule: -gain[rule.name])


def cascade(
    docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", statistics: Sequence[str] = (),
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """`docs` plus `kept`, and the columns named in `statistics`.

    A text goes through the rules in the estimated order and leaves at its first rejection; later rules never see it.
    `kept` is true for a text that every rule passes, so it does not depend on the order or on the sample.

    One map over the rows: no shuffle, rows with equal or null ids keep their own verdicts. Null text counts as empty,
    which the word minimum rejects. Columns of `docs` named `kept` or like a statistic are replaced.
    """
    rules = default_rules() if rules is None else list(rules)
    plan = ordered(rules, estimate(docs, rules, text, sample_rows))
    statistics = list(statistics)

    def judged(values: pd.Series) -> pd.DataFrame:
        columns: dict[str, list] = {name: [] for name in (*statistics, "kept")}
        for value in values:
            value = _bytes(value)
            for name in statistics:
                columns[name].append(STATISTICS[name](value))
            columns["kept"].append(not any(rule.rejects(value) for rule in plan))
        return pd.DataFrame(columns)

    schema = ", ".join([*(f"{name} long" for name in statistics), "kept boolean"])
    verdict = F.pandas_udf(judged, schema)
    rest = [F.col(f"`{name}`") for name in docs.columns if name not in (*statistics, "kept")]
    return docs.select(*rest, verdict(text_or_empty(text)).alias("_verdict")).select(
        *rest, *[F.col(f"_verdict.{name}").alias(name) for name in (*statistics, "kept")]
    )


def kept_documents(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass every rule, with their columns."""
    return cascade(docs, rules, text).filter("kept").select(*[F.col(f"`{name}`") for name in docs.columns])
