"""What the corpus operators have in common: the shared folder, written tables, text batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplake.sources.storage import clear, fresh, run_folder, shared_folder, written  # noqa: F401

#: A word, in Java's and Python's notation: a run without space, tab, line feed, vertical tab, form feed or return.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id where rows pass through pandas, which would turn the column to floats.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, *added: Column) -> DataFrame:
    """docs as one column `_doc`, so that no name of the caller's meets one of the columns added. `_doc.*` brings them back."""
    return docs.select(F.struct("*").alias("_doc"), *added)


def drop_written(df: DataFrame) -> None:
    """Removes the table below df, which written() gave and nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def few_at_once(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Actions inside hand so many rows at once to Python: 10,000 whole texts, Spark's usual batch, are tens of MB, held several times by the JVM and by a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def utf8_size(text: Column) -> Column:
    """Bytes of the text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def runs(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of about `most` characters; a longer text is a slice of its own."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def clean(texts: pd.Series) -> list[str]:
    """The texts as str, null as empty."""
    return [t if isinstance(t, str) else "" for t in texts]


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash of each word, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    held = np.empty(len(words), object)
    held[:] = words
    return pd.util.hash_array(held, categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads the bits of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths; 0 for empty runs."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]
