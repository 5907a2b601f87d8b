"""Ordered positions and prefix sums over a whole table, without bringing it to one task.

The table is range-partitioned by its order, which also splits rows of one hot group, and written with each row's part.
Sums of the parts are small and give each part's start; a window inside the part does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplake.llm.shared import written


def in_parts(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, written, with `part`: rows of a lower part come before those of a higher one in the given order, nulls first."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in order]
    return written(df.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), name)


def prefix_sums(df: DataFrame, order: list[str], values: dict[str, str], group: list[str], name: str) -> DataFrame:
    """df with, for each value column c named as a key of `values`, the sum of c over the earlier rows of its group.

    values maps a numeric column to the name of its exclusive prefix sum; order must make rows distinct up to repeated ones.
    """
    held = in_parts(df, [*group, *order], name)
    keys = [*group, "part"]
    totals = held.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in values])  # a row for each part and group it meets
    # a group's parts in order: as many rows as it has parts
    before = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    if not group:
        before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(*keys, *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in values])
    inside = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(W.unboundedPreceding, -1)
    own = held.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_own_{c}") for c in values])
    right = starts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[f"_{c}" for c in values])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    added = own.join(right, on)
    return added.select(*df.columns, *[(F.col(f"_own_{c}") + F.col(f"_{c}")).alias(p) for c, p in values.items()])
