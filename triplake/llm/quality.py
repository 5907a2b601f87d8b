"""Quality rules as a ledger of failure bits (operator 7).

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned mask over those bits, so a new policy or an ablation is arithmetic on the ledger and reads no text again.

Null or empty texts have no words and fail `few_words`. Repeated rows are measured alike. An empty table gives an empty
ledger. Columns of the input are kept; those that have a ledger column's name are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplake.llm.shared import aside, clean, mixed, runs, sums, word_hashes

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_unspaced")
#: Blocks of scripts that put no blanks between words (Thai and Lao, Burmese, Khmer, kana, Han), as code points.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF))
_UNSPACED = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "]")

#: Rule name to its SQL test over the measurements; the position is the rule's bit and never changes. The share of distinct words
#: falls with length, about as its root: from 2,000 words on the bound of few_distinct_words does so too (a quarter at 2,000). Word
#: lengths tell nothing where a quarter of the characters is of a script without blanks.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "few_distinct_words": "4 * n_distinct_words < n_words and n_distinct_words * n_distinct_words < 125 * n_words",
    "odd_word_length": "(word_chars < 2 * n_words or word_chars > 14 * n_words) and 4 * n_unspaced < word_chars",
}
#: Policy version to the rules that reject a document.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": tuple(RULES),
    "full-2": ("few_words", "repeated_windows", "many_symbols", "repeated_lines", "few_distinct_words"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(policy: str) -> int:
    return sum(bit(r) for r in POLICIES[policy])


def _measure(texts: list[str]) -> np.ndarray:
    """One row of MEASURES for each text of a slice."""
    out = np.zeros((len(texts), len(MEASURES)), np.int64)
    words: list[bytes] = []
    for row, text in zip(out, texts, strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        own = raw.split()
        words += own
        seen: set[bytes] = set()
        for line in raw.split(b"\n"):
            if line in seen:
                row[3] += 1
                row[5] += 1
            elif line.strip():
                seen.add(line)
                row[5] += 1
        row[0] = len(own)
        row[1] = len(text) - sum(map(text.count, " \t\n\v\f\r"))
        row[2] = sum(map(text.count, SYMBOLS))
        row[7] = 0 if text.isascii() else len(_UNSPACED.findall(text))
    lengths = out[:, 0]
    if not words:
        return out
    owner = np.repeat(np.arange(len(texts)), lengths)
    hashes = mixed(word_hashes(words))
    own = mixed(owner.astype(np.uint64) + np.uint64(1))
    fresh = ~pd.Series(hashes ^ own).duplicated().to_numpy()
    out[:, 6] = sums(fresh.astype(np.int64), lengths)
    if len(words) > WINDOW:
        n = len(words) - WINDOW + 1
        window = np.zeros(n, np.uint64)
        for k in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        inside = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        twice = inside[pd.Series(mixed(window[inside]) ^ own[inside]).duplicated(keep=False).to_numpy()]
        step = np.zeros(len(words) + 1, np.int64)
        step[twice] += 1
        step[twice + WINDOW] -= 1
        out[:, 4] = sums((np.cumsum(step[:-1]) > 0).astype(np.int64), lengths)
    return out


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = clean(batch)
        parts = [_measure(texts[a:b]) for a, b in runs(texts)]
        yield pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(MEASURES)), np.int64), columns=list(MEASURES))


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements and `fail_bits`, each rule's bit set where it fails."""
    kept = [c for c in docs.columns if c.lower() not in (*MEASURES, "fail_bits", "_measured")]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], measured(F.col(f"`{text}`")).alias("_measured"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"_measured.{m}") for m in MEASURES])
    bits = F.lit(0).cast("long")
    for rule, test in RULES.items():
        bits = bits.bitwiseOR(F.when(F.expr(test), F.lit(bit(rule))).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("fail_bits", bits)


def fails(policy: str) -> Column:
    """Whether a ledger row is rejected under the policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: documents failing it, failing it alone, and kept if it were left out."""
    whole = mask(policy)
    held = F.col("fail_bits").bitwiseAND(F.lit(whole).cast("long"))
    counted = rows.groupBy(held.alias("bits")).agg(F.count("*").alias("n"))  # at most one row for each set of bits
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    each = counted.select("bits", "n", F.explode(rules).alias("r"))
    sum_if = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        sum_if(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        sum_if(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        sum_if(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0).alias("n_kept_without"),
    )


def quality_filter(docs: DataFrame, policy: str = "full-1") -> DataFrame:
    """docs without those that the policy rejects, with their own columns and values, whatever their names."""
    return ledger(aside(docs, F.col("text"))).where(~fails(policy)).select("_doc.*")
