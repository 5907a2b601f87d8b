"""A filter of bounded size that keeps rows without a partner out of a shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.llm.shared import written

#: Slots for each id, and at least and at most; the filter is a table of slots / 64 rows of 16 bytes, 32 MB at most.
SPREAD, LEAST, MOST = 8, 1 << 16, 1 << 27


def possible(ids: DataFrame, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds `_possible` to a table with the column `name`, which must have no column `_word` or `_bits`.

    It is true for every row whose id is in ids(name), for few others while ids are fewer than slots, and false for null
    ids. With many more ids than MOST it is true for all rows, which costs time and no result.
    """
    total = min(MOST, max(LEAST, 1 << (SPREAD * ids.count()).bit_length()))
    slots = ids.where(F.col(name).isNotNull()).select(F.pmod(F.xxhash64(name), F.lit(total)).alias("s"))
    bits = written(slots.groupBy(F.expr("s div 64").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("_bits")), "possible")

    def marked(df: DataFrame) -> DataFrame:
        met = df.withColumn("_word", F.expr(f"pmod(xxhash64({name}), {total}) div 64")).join(F.broadcast(bits), "_word", "left")
        found = F.expr(f"(shiftright(_bits, cast(pmod(xxhash64({name}), {total}) % 64 as int)) & 1) = 1")
        return met.withColumn("_possible", F.coalesce(found, F.lit(False)) & F.col(name).isNotNull()).drop("_word", "_bits")

    return marked
