"""Token counts without token ids (operator 9).

A pre-token here is a run without blanks together with the blank or line feed before it. The tokenizer's own splitting
never joins characters across such a place, so the tokens of a text are the tokens of its pre-tokens. Each distinct
pre-token is encoded once for the whole corpus; documents meet the counts through their pre-token frequencies. Texts with
other white space, runs of it whose splitting depends on their neighbours, or special strings, before which white space is split as at a
text's end, are cut by the tokenizer's published pattern instead. Special strings in a text are one token, as the library's default has it.

Null or empty texts have 0 bytes and 0 tokens. Repeated rows and repeated doc_ids are counted row by row; a null doc_id
stays null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.llm.lookup import document_sums
from triplake.llm.shared import NO_ID, clean, runs, sums, word_hashes, written

LIMIT = 512
#: White space other than blank and line feed, and the mark that this module puts between pre-tokens.
OTHER_SPACE = re.compile("[\x01\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


@cache
def _patterns(path: str):
    """The tokenizer's special strings and the pattern of a byte-level pre-tokenizer."""
    import public_tokenizers
    import regex

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    if kind["pre_tokenizer"]["type"] != "ByteLevel" or kind["pre_tokenizer"]["add_prefix_space"] or kind["normalizer"]:
        raise ValueError(f"{path}: only byte-level tokenizers without prefix blank and normalizer are supported")
    special = [t["content"] for t in kind["added_tokens"]]
    return regex.compile("(" + "|".join(map(regex.escape, special)) + ")"), regex.compile(public_tokenizers.PATTERN)


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(text: str, path: str) -> list[str]:
    """Pieces of the text whose tokens, counted one by one, are the text's tokens."""
    flat = text.replace("\n", " ")
    special, pattern = _patterns(path)
    if "   " in flat or flat.endswith("  ") or OTHER_SPACE.search(text) or special.search(text):
        parts = special.split(text)
        return [p for i, part in enumerate(parts) for p in ([part] if i % 2 else pattern.findall(part))]
    found = text.replace(" ", "\x01 ").replace("\n", "\x01\n").split("\x01")
    return found if found[0] else found[1:]


def _cores(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens without a full stop or comma after a letter or digit, and how many were cut; each is one token."""
    tail = np.array([len(p) > 1 and p[-1] in ".," and p[-2].isalnum() for p in pieces], bool)
    return [p[:-1] if t else p for p, t in zip(pieces, tail, strict=True)], tail.astype(np.int64)


def _split(texts: list[str], path: str):
    """Distinct pieces of a slice, the code of every piece, and pieces per text."""
    pieces: list[str] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        own = pre_tokens(t, path)
        pieces += own
        lengths[i] = len(own)
    code, found = pd.factorize(word_hashes(pieces).view(np.int64))
    first = np.zeros(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return [pieces[i] for i in first], code, lengths


def piece_counts(docs: DataFrame, path: str) -> DataFrame:
    """h, n (occurrences), v (tokens) of every distinct pre-token of docs.text: each is encoded once."""

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = clean(pdf["text"])
            for a, b in runs(texts, 4 << 20):
                found, code, _ = _split(texts[a:b], path)
                cores, _ = _cores(found)
                yield pd.DataFrame({"piece": cores, "n": np.bincount(code, minlength=len(found))})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _tokenizer(path).encode
        for pdf in batches:
            pieces = pdf["piece"].tolist()
            v = [len(encode(p, add_special_tokens=False)) for p in pieces]
            yield pd.DataFrame({"h": word_hashes(pieces).view(np.int64), "n": pdf["n"], "v": np.array(v, float)})

    pieces = docs.select("text").mapInPandas(distinct, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    return written(pieces.mapInPandas(count, "h long, n long, v double"), "piece-counts")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    values = piece_counts(rows, path)

    def keyed(texts: list[str]):
        found, code, lengths = _split(texts, path)
        cores, cut = _cores(found)
        hashes = word_hashes(cores)
        return hashes[code], lengths, sums(cut[code], lengths)

    def extra(texts: list[str]) -> np.ndarray:
        return np.array([[len(t.encode("utf-8", "surrogatepass"))] for t in texts], float).reshape(-1, 1)

    counted = document_sums(rows, values, keyed, extra, ("n_bytes",))
    return counted.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), F.round("total").cast("long").alias("n_tokens"), (F.round("total") > limit).alias("over_limit")
    )
