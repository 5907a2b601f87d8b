"""Benchmark decontamination by greedy string tiling (operator 2).

Documents are searched for SEED-token seeds of the benchmark items (a search in their sorted hashes). For each document and item that
share enough of them, running Karp-Rabin greedy string tiling marks the longest matches that don't overlap, down to SEED tokens, in any order;
the share of the item's tokens that the tiles cover is its coverage. A document is contaminated if some item's coverage
reaches the threshold, wherever the item's passages stand and in whatever order.

The benchmark is dealt into blocks of about BLOCK tokens by item, each broadcast with that bound and searched in one pass over the documents;
what a pass found is written before the next block is broadcast, so that one block is held at a time. Documents without a match are never written or shuffled.

Tokens are lower-cased runs without white space and punctuation. Items of fewer tokens than
a seed can't be told from common phrases and match nothing. Null or empty texts and items match nothing. Repeated rows are judged alike; repeated item_ids are one item
each, and item_ids may be of any type. An empty table on either side gives no matches. Other columns are kept by `decontaminate` and ignored by `contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplake.llm.bitmap import possible
from triplake.llm.shared import aside, clean, fresh, mixed, runs, word_hashes, written

SEED = 4
COVERAGE = 0.5
BLOCK = 1 << 18
_PUNCTUATION = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
_QUOTES = re.compile(b"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]")


def tokens(text: str) -> list[bytes]:
    raw = text.lower().encode("utf-8", "surrogatepass").translate(_PUNCTUATION)
    return (_QUOTES.sub(b" ", raw) if b"\xe2\x80" in raw or b"\xc2" in raw else raw).split()


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` tokens."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def tiles(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token-hash arrays: (start in item, start in text, length) of each tile of `least` or more."""
    taken_i, taken_t = np.zeros(len(item), bool), np.zeros(len(text), bool)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(item), len(text)))
    while size >= least:
        free_i = np.flatnonzero(~_any(taken_i, size))
        free_t = np.flatnonzero(~_any(taken_t, size))
        hash_i, hash_t = grams(item, size)[free_i], grams(text, size)[free_t]
        common = np.isin(hash_t, hash_i)
        if not common.any():
            # the next search length: halve while long, as no match of this length is left
            size = max(least, size // 2) if size > least else least - 1
            continue
        t_hash, t_free = hash_t[common], free_t[common]
        order = np.argsort(t_hash, kind="stable")
        t_hash, t_free = t_hash[order], t_free[order]
        lo, hi = np.searchsorted(t_hash, hash_i, "left"), np.searchsorted(t_hash, hash_i, "right")
        matches = []
        for i, a, b in zip(free_i[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
            ts = t_free[a:b]
            if i and not taken_i[i - 1]:  # a match that goes on to the left is part of a longer one
                ts = ts[(ts == 0) | (text[ts - 1] != item[i - 1]) | taken_t[ts - 1]]
            ts = ts[(item[i : i + size] == text[ts[:, None] + np.arange(size)]).all(axis=1)] if len(ts) * size < 1 << 22 else np.array([t for t in ts.tolist() if (item[i : i + size] == text[t : t + size]).all()], np.int64)
            matches += [(-n, i, t) for n, t in _extended(item, text, taken_i, taken_t, i, ts, size)]
        heapify(matches)
        while matches and not taken_i.all():
            n, i, t = heappop(matches)
            free = ~(taken_i[i : i - n] | taken_t[t : t - n])
            if free.all():
                taken_i[i : i - n] = taken_t[t : t - n] = True
                found.append((i, t, -n))
                continue
            # what other tiles left of it, if that is still long enough
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if y - x >= size:
                    heappush(matches, (x - y, i + x, t + x))
        size = max(least, size // 2) if size > least else least - 1
    return found


def _extended(item: np.ndarray, text: np.ndarray, taken_i: np.ndarray, taken_t: np.ndarray, i: int, ts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """(length, place in text) of the matches of `size` at i and ts, each as far to the right as its tokens agree and are free."""
    out = []
    n = size
    while len(ts):
        on = np.zeros(len(ts), bool)
        if i + n < len(item) and not taken_i[i + n]:
            ends = np.minimum(ts + n, len(text) - 1)
            on = (ts + n < len(text)) & (text[ends] == item[i + n]) & ~taken_t[ends]
        out += [(n, t) for t in ts[~on].tolist()]
        ts, n = ts[on], n + 1
    return out


def _any(taken: np.ndarray, size: int) -> np.ndarray:
    """For each window of `size`, whether a token in it is taken."""
    total = np.concatenate([[0], np.cumsum(taken)])
    return total[size:] > total[: max(0, len(total) - size)]


def _item_blocks(benchmark: DataFrame, seed: int, block: int) -> Iterator[dict]:
    """Items by blocks: their token hashes, sorted seeds, and the item and place of each seed."""
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 4
    blocks = max(1, -(-total // block))
    if blocks > 1:  # dealt out once, so that a block reads its own items
        path = fresh(items.sparkSession, "items")
        items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).write.partitionBy("_block").parquet(path)
        items = items.sparkSession.read.schema(T.StructType([*items.schema.fields, T.StructField("_block", T.LongType())])).parquet(path)
    for k in range(blocks):
        rows = (items.where(F.col("_block") == k) if blocks > 1 else items).collect()  # about `block` tokens
        ids, hashes, seeds, owner, place = [], [], [], [], []
        for r in rows:
            h = mixed(word_hashes(tokens(r["text"])))
            if not len(h):
                continue
            g = grams(h, min(seed, len(h)))
            if len(h) >= seed:  # shorter items can't be found by a seed of this length
                seeds.append(g)
                owner.append(np.full(len(g), len(ids)))
                place.append(np.arange(len(g)))
            ids.append(r["item_id"])
            hashes.append(h)
        if not seeds:
            continue
        order = np.argsort(np.concatenate(seeds), kind="stable")
        yield {"ids": ids, "hashes": hashes, "seeds": np.concatenate(seeds)[order], "owner": np.concatenate(owner)[order], "place": np.concatenate(place)[order]}


def _search(texts: list[str], block: dict, seed: int, least: float) -> list[list[tuple]]:
    """For each text, (item_id, item tokens, covered tokens, tiles) of the items whose coverage reaches `least`."""
    own = [tokens(t) for t in texts]
    lengths = np.array([len(w) for w in own], np.int64)
    h = mixed(word_hashes([w for ws in own for w in ws]))
    out: list[list[tuple]] = [[] for _ in texts]
    if len(h) < seed:
        return out
    owner = np.repeat(np.arange(len(texts)), lengths)
    g = grams(h, seed)
    at = np.searchsorted(block["seeds"], g)
    at[at == len(block["seeds"])] = 0
    hit = np.flatnonzero((block["seeds"][at] == g) & (owner[: len(g)] == owner[seed - 1 :]))
    if not len(hit):
        return out
    for d, places in zip(*_grouped(owner[hit], hit), strict=True):
        lo, hi = np.searchsorted(block["seeds"], g[places], "left"), np.searchsorted(block["seeds"], g[places], "right")
        span = np.concatenate([np.arange(a, b) for a, b in zip(*np.unique(np.stack([lo, hi]), axis=1), strict=True)])
        # the document's tokens that some seed touches, with a stop between runs that don't touch
        near = np.unique((places[:, None] + np.arange(seed)[None, :]).ravel())
        gap = np.flatnonzero(np.diff(near) > 1) + 1
        text = np.insert(h[near], gap, np.uint64(0))
        for i, spots in zip(*_grouped(block["owner"][span], block["place"][span]), strict=True):
            item = block["hashes"][i]
            most = len(np.unique((spots[:, None] + np.arange(seed)[None, :]).ravel()))
            if most < least * len(item):
                continue  # no tiling can cover more than its seeds touch
            found = tiles(item, text, seed)
            covered = sum(n for _, _, n in found)
            if covered >= least * len(item):
                out[d].append((block["ids"][i], len(item), covered, len(found)))
    return out


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    found, first = np.unique(keys[order], return_index=True)
    return found.tolist(), np.split(values[order], first[1:])


#: What is known of each item in a text, besides its item_id.
MEASURES = ("n_item_tokens", "n_covered", "n_tiles")


def _searcher(shared, seed: int, coverage: float, item_id: T.DataType):
    kind = T.StructType([T.StructField("item_id", T.ArrayType(item_id)), *[T.StructField(c, T.ArrayType(T.LongType())) for c in MEASURES]])

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = clean(batch)
            found = [x for a, b in runs(texts) for x in _search(texts[a:b], shared.value, seed, coverage)]
            yield pd.DataFrame({c: [[m[k] for m in x] for x in found] for k, c in enumerate(("item_id", *MEASURES))})

    return F.pandas_udf(search, kind)


def searched(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, block: int = BLOCK) -> Iterator[tuple[Column, Callable[[DataFrame], DataFrame]]]:
    """For each block of the benchmark, a column over the text: the items found; and what to do with a result of it before the next block is used."""
    spark, kind = docs.sparkSession, benchmark.schema["item_id"].dataType
    blocks = _item_blocks(benchmark, seed, block)
    held = next(blocks, None)
    while held is not None:
        shared = spark.sparkContext.broadcast(held)
        held = next(blocks, None)

        def done(df: DataFrame, shared=shared, last=held is None) -> DataFrame:
            if last:
                return df
            kept = written(df, "searched")
            shared.unpersist()
            return kept

        yield _searcher(shared, seed, coverage, kind)(F.col("text")), done


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, n_item_tokens, n_covered, n_tiles, coverage, contaminated: a row for each contaminated document and item."""

    def rows(docs: DataFrame, found: Column) -> DataFrame:
        told = docs.select("doc_id", found.alias("m")).where(F.size("m.item_id") > 0)
        return told.select("doc_id", F.explode(F.arrays_zip(*[F.col(f"m.{c}").alias(c) for c in ("item_id", *MEASURES)])).alias("m")).select("doc_id", "m.*")

    out = None
    for found, done in searched(docs, benchmark, **options):
        one = done(rows(docs, found))
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = docs.select("doc_id").limit(0).select("doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in MEASURES])
    return out.withColumn("coverage", F.col("n_covered") / F.col("n_item_tokens")).withColumn("contaminated", F.lit(True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated rows, with their own columns.

    A benchmark of one block is a filter in one pass. With more, a pass writes only the texts that it finds, which are few, and
    the documents are held against all of them at the end; documents whose hash isn't among theirs aren't shuffled.
    """
    passes = searched(docs, benchmark, **options)
    first, second = next(passes, None), next(passes, None)
    if first is None:
        return docs
    if second is None:
        return docs.where(F.size(first[0]["item_id"]) == 0)
    bad = None
    for found, done in chain((first, second), passes):
        one = done(docs.where(F.size(found["item_id"]) > 0).select(F.col("text").alias("_bad"), F.xxhash64("text").alias("_bad_hash")))
        bad = one if bad is None else bad.unionByName(one)
    bad = written(bad.distinct(), "contaminated")
    marked = possible(bad.select(F.col("_bad_hash").alias("_hash")), "_hash")(aside(docs, F.col("text").alias("_text"), F.xxhash64("text").alias("_hash")))
    met = marked.where("_possible").join(bad, (F.col("_hash") == F.col("_bad_hash")) & (F.col("_text") == F.col("_bad")), "left_anti")
    return marked.where("not _possible").select("_doc").unionByName(met.select("_doc")).select("_doc.*")
