"""Language identification by nearest centroids of character n-grams (operator 12).

A text's letters, in lower case and with every run of other characters as one blank (ASCII words with digits count as such,
unless there is nothing else), give its n-grams of 1 to 4 characters,
hashed to a fixed number of buckets. Counts are damped (1 + ln), weighed by inverse document frequency and normalised.
Every language has several centroids, found by spherical k-means among its learned texts, so that headings, lists or mixed
texts have centroids of their own. The language of the nearest centroid by cosine is predicted. Each centroid keeps the
distance within which all but a hundredth of its texts lie; a text beyond it is marked as rejected.

The model is fitted on a bounded sample: about `sample` texts of each language (all where there are fewer), chosen by a hash
of their ids and contents, as vectors of at most `BUCKETS` numbers each. All else reads every text whole.

Null texts and texts without a letter are `und` with score 0. Without a learned language everything is. Repeated rows are
predicted alike; rows without an id or a language aren't learned. Ties go to the language first in code point order. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.llm.shared import clean, runs, written

BUCKETS, SIZES = 1 << 13, (1, 2, 3, 4)
#: Learned texts of a language, centroids of a language, rounds of k-means.
SAMPLE, CENTROIDS, ROUNDS = 1000, 4, 8
#: Share of a centroid's own texts that its distance of rejection leaves outside.
OUTSIDE = 0.01
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def coded(points: np.ndarray) -> np.ndarray:
    """Whether a code point is in a run of ASCII letters and digits that has a digit: keys, hashes and numbers tell no language."""
    digit = (points >= 48) & (points <= 57)
    if not digit.any():
        return np.zeros(len(points), bool)
    inside = digit | ((points | 32) - 97 < 26)
    run = np.cumsum(np.diff(inside, prepend=False) & inside)
    return inside & (np.bincount(run[digit], minlength=run[-1] + 1) > 0)[run]


def grams(text: str) -> np.ndarray:
    """The bucket of every n-gram occurrence of the text; none if it has no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64)
    code = coded(points)
    letter = letter & ~code if (letter & ~code).any() else letter
    # letters, and one blank for each run between them, at the start and at the end
    after = np.concatenate([[True], letter[:-1]])
    kept = np.where(letter, points, 32)[letter | after]
    line = np.concatenate([[32] if letter[0] else [], kept, [32] if letter[-1] else []]).astype(np.uint64)
    out, hashed = [], np.zeros(len(line), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(line) < n:
            break
        hashed = hashed[: len(line) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + line[n - 1 :] + np.uint64(n)
        if n in SIZES:
            out.append(((hashed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(out)


def damped(texts: list[str]) -> np.ndarray:
    """One row of damped bucket counts for each text; zeros where there is no letter."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        for a in range(0, len(text), 1 << 20):  # whole texts, a piece of bounded size at a time; three characters overlap
            found = grams(text[max(0, a - 3) : a + (1 << 20)])
            if len(found):
                row += np.bincount(found, minlength=BUCKETS)
    np.log1p(out, out)  # 1 + ln would jump at one; ln(1 + n) damps alike
    return out


def normalised(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)


def clusters(rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At most k unit centroids of unit rows, and for each the distance that leaves OUTSIDE of its rows beyond."""
    chosen = [normalised(rows.mean(axis=0, keepdims=True))[0]]
    near = rows @ chosen[0]
    while len(chosen) < min(k, len(rows)) and near.min() < 1 - 1e-6:
        # the next start: a row far from all, but with a twentieth of the rows beyond it, lest odd ones take all centroids
        chosen.append(rows[np.argsort(near, kind="stable")[len(rows) // 20]])
        near = np.maximum(near, rows @ chosen[-1])
    centroids = np.stack(chosen)
    for _ in range(ROUNDS):
        own = (rows @ centroids.T).argmax(axis=1)
        for c in np.unique(own):
            centroids[c] = normalised(rows[own == c].mean(axis=0, keepdims=True))[0]
    cosine = rows @ centroids.T
    own = cosine.argmax(axis=1)
    share = np.bincount(own, minlength=len(centroids))
    used = np.flatnonzero(share >= max(1, len(rows) / 100))  # fewer texts than that make no centroid
    limits = [float(np.quantile(1 - cosine[own == c, c], 1 - OUTSIDE)) for c in used]
    return centroids[used], np.array(limits)


def fit(docs: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Inverse document frequencies, and language, centroid and distance of rejection of each centroid, from docs(doc_id, text, lang).

    The model's size depends on the number of languages alone.
    """
    spark = docs.sparkSession
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = labelled.groupBy("lang").count().withColumnRenamed("lang", "of")  # a row for each language
    # a hash decides, so that reruns take the same texts and no language is sorted
    at = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    few = labelled.join(F.broadcast(sizes), F.col("lang") == F.col("of")).where(at * F.col("count") < F.lit(sample * (1 << 30)))

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = clean(pdf["text"])
            for a in range(0, len(texts), 64):
                rows = damped(texts[a : a + 64])
                found = [np.flatnonzero(r) for r in rows]
                out = pd.DataFrame({"lang": pdf["lang"].to_numpy()[a : a + 64], "buckets": [f.tolist() for f in found], "counts": [r[f].tolist() for r, f in zip(rows, found, strict=True)]})
                yield out[[len(f) > 0 for f in found]]

    learned = written(few.select("lang", "text").mapInPandas(sparse, "lang string, buckets array<int>, counts array<float>"), "learned")
    total = learned.count()
    frequency = np.zeros(BUCKETS)
    for b, n in learned.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():  # at most BUCKETS rows
        frequency[b] = n
    idf = np.log((1 + total) / (1 + frequency)).astype(np.float32) + 1

    def grouped(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.zeros((len(pdf), BUCKETS), np.float32)
        for row, b, c in zip(rows, pdf["buckets"], pdf["counts"], strict=True):
            row[b] = c
        rows *= idf
        rows /= np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)
        # the same order in every run, whatever order the rows came in
        rows = rows[np.lexsort((rows @ np.arange(BUCKETS, dtype=np.float32), rows.max(axis=1)))]
        found, limits = clusters(rows, centroids)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centroid": [c.tolist() for c in found], "most": limits})

    model = learned.groupBy("lang").applyInPandas(grouped, "lang string, centroid array<float>, most double").collect()
    model.sort(key=lambda r: r["lang"])
    shape = np.array([r["centroid"] for r in model], np.float32).reshape(-1, BUCKETS)
    return idf, [r["lang"] for r in model], shape, np.array([r["most"] for r in model])


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """docs(text, and others) with lang_pred, score (the cosine) and rejected (farther than all but few of the centroid's own texts)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        idf, langs, centroids, most = held.value
        names = np.array([*langs, UNKNOWN], object)
        weights = (centroids * idf).T.copy()  # the text's own norm is divided out after
        for batch in batches:
            texts = clean(batch)
            best, score, far = np.full(len(texts), len(langs)), np.zeros(len(texts)), np.ones(len(texts), bool)
            step = 64
            for a in range(0, len(texts) if langs else 0, step):
                rows = damped(texts[a : a + step])
                norm = np.sqrt(((rows * idf) ** 2).sum(axis=1))
                cosine = (rows @ weights) / np.maximum(norm, 1e-12)[:, None]
                k = cosine.argmax(axis=1)
                some = norm > 0
                top = cosine[np.arange(len(k)), k]
                best[a : a + step] = np.where(some, k, len(langs))
                score[a : a + step] = np.where(some, np.clip(top, 0, 1), 0)
                far[a : a + step] = ~some | (1 - top > most[k])
            yield pd.DataFrame({"lang_pred": names[best], "score": score, "rejected": far})

    return docs.withColumn("_nearest", nearest("text")).select(*docs.columns, "_nearest.*")


def languages(docs: DataFrame, held_out: Column, **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of docs(doc_id, text, lang), learned from the rows that aren't held out.

    A null held_out (no id) is false, and such a row isn't learned.
    """
    model = fit(docs.where(~held_out), **how)
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")
