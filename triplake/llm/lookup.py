"""Per-document sums of a per-word value, without a row for every word.

The value table has one row per distinct key and grows with the corpus, so it is never broadcast whole. Its most frequent
keys, at most HOT of them, are broadcast and summed inside the task; they cover most occurrences. The rest leave the task as
(document, key, frequency) rows and meet the table in an ordinary shuffled join. Both ways give the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.llm.shared import clean, runs, sums

#: Most keys that are broadcast: 16 bytes each.
HOT = 1 << 18


def hot_keys(values: DataFrame, most: int = HOT) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of the most frequent rows of values(h, n, v), sorted by key, at most `most` of them.

    The cut is a frequency class (quarter powers of two), found from a histogram of at most 256 rows.
    """
    kind = F.floor(F.log2("n") * 4).cast("int")
    counts = sorted(((r[0], r[1]) for r in values.groupBy(kind).count().collect()), reverse=True)
    least, total = None, 0
    for k, n in counts:
        total += n
        if total > most:
            break
        least = k
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    found = values.where(kind >= least).select("h", F.col("v").cast("double")).toArrow()
    h, v = found["h"].to_numpy(), found["v"].to_numpy()
    order = np.argsort(h)
    return h[order], v[order]


def matched(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in sorted_keys, and where."""
    if not len(sorted_keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys, at


def document_sums(docs: DataFrame, values: DataFrame, keyed: Callable, extra: Callable | None = None, extra_names: tuple = (), most: int = HOT) -> DataFrame:
    """docs(row, id, text) to row, id, n (occurrences of keys), n_known, total (sum of v over occurrences) and the extras.

    values(h long, n long, v double). keyed(text) gives the text's key hashes (uint64) of a slice of texts with the
    number of keys of each text and a constant to add to each text's total. extra(texts) gives an array of one row per text.
    """
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(hot_keys(values, most))
    names = ["n", "n_known", "total", *extra_names]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_h, hot_v = hot.value
        for pdf in batches:
            texts, row, key = clean(pdf["text"]), pdf["row"].to_numpy(), pdf["id"].to_numpy()
            for a, b in runs(texts):
                keys, lengths, added = keyed(texts[a:b])
                code, found = pd.factorize(keys.view(np.int64))
                is_hot, at = matched(hot_h, found)
                value = np.where(is_hot, hot_v[at], 0.0) if len(hot_h) else np.zeros(len(found))
                own = np.zeros((b - a, len(names)))
                own[:, 0] = lengths
                if len(keys):
                    own[:, 1] = sums(is_hot[code].astype(np.int64), lengths)
                    own[:, 2] = sums(value[code], lengths)
                own[:, 2] += added
                if extra:
                    own[:, 3:] = extra(texts[a:b])
                cold = np.flatnonzero(~is_hot[code]) if len(keys) else np.zeros(0, np.int64)
                owner = np.repeat(np.arange(b - a), lengths)[cold]
                pair, first, times = np.unique(owner * np.int64(max(1, len(found))) + code[cold], return_index=True, return_counts=True)
                which = np.concatenate([np.arange(a, b), a + owner[first]])
                out = {"row": row[which], "id": key[which], "h": np.concatenate([row[a:b], found[code[cold[first]]]]), "times": np.concatenate([np.zeros(b - a, np.int64), times])}
                for i, k in enumerate(names):
                    out[k] = np.concatenate([own[:, i], np.zeros(len(pair))])
                yield pd.DataFrame(out)

    schema = "row long, id long, h long, times long, " + ", ".join(f"{n} double" for n in names)
    rows = docs.select("row", "id", "text").mapInPandas(each, schema)
    met = rows.join(values.select(F.col("h").alias("vh"), "v"), (F.col("times") > 0) & (F.col("h") == F.col("vh")), "left")
    known = F.when(F.col("vh").isNotNull(), F.col("times")).otherwise(0)
    # the parts of one document meet again: at most one row for each of its rarer words
    return met.groupBy("row", "id").agg(
        F.sum("n").cast("long").alias("n"),
        F.sum(F.col("n_known") + known).cast("long").alias("n_known"),
        F.sum(F.col("total") + F.coalesce(F.col("times") * F.col("v"), F.lit(0.0))).alias("total"),
        *[F.sum(k).alias(k) for k in extra_names],
    )
