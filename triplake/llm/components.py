"""Connected components of a link table by random-priority contraction, in Spark joins and aggregates only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.llm.shared import written

#: As many links, a quarter of a MB, are joined in one task; more are contracted first.
FEW = 1 << 14


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """id and the least id of its component, of all links of at most FEW."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    yield pd.DataFrame({"id": list(root), "into": [find(x) for x in root]}, dtype="int64")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links(a, b); ids with no link to another are left out.

    In each round every node joins its neighbour of least priority (a hash, so that chains of ordered ids also shrink by a
    constant share) and links between joined nodes go. Hubs are safe: a node's neighbours are reduced by a partial
    aggregate and are never gathered. Once FEW links are left, one task joins them, so that small rests take no further rounds.
    """
    edges = links.where("a <> b").select("a", "b")
    steps: list[DataFrame] = []
    while True:
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        n = edges.count()
        if not n:
            break
        if n <= FEW:
            steps.append(written(edges.coalesce(1).mapInPandas(_joined, "id long, into long"), "joins"))
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("p"), F.col(c).alias("id"))
        joins = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least("m", rank("a"))["id"].alias("into"))
        joins = written(joins, "joins")
        steps.append(joins)
        side = lambda c: joins.select(F.col("id").alias(c), F.col("into").alias(f"{c}_into"))  # noqa: E731,B023
        edges = edges.join(side("a"), "a").join(side("b"), "b").select(F.col("a_into").alias("a"), F.col("b_into").alias("b")).where("a <> b")
    if not steps:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    # from the last step back: each step's nodes, ever fewer, are followed once
    roots = steps[-1]
    for step in reversed(steps[:-1]):
        on = roots.select(F.col("id").alias("into"), F.col("into").alias("_next"))
        roots = step.join(on, "into", "left").select("id", F.coalesce("_next", "into").alias("into"))
    roots = written(roots, "roots")
    least = roots.groupBy("into").agg(F.min("id").alias("component"))
    return roots.join(least, "into").select("id", "component")


def joined_components(found: DataFrame | None, links: DataFrame) -> DataFrame:
    """id, component after more links(a, b): only the components that the links touch are joined anew."""
    if found is None:
        return written(components(links), "components")
    of = lambda c: found.select(F.col("id").alias(c), F.col("component").alias(f"{c}_c"))
    met = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_c", "a").alias("a"), F.coalesce("b_c", "b").alias("b"))
    more = written(components(met), "joins-of-components")
    into = more.select(F.col("id").alias("component"), F.col("component").alias("_into"))
    old = found.join(into, "component", "left").select("id", F.coalesce("_into", "component").alias("component"))
    new = more.join(found.select("id"), "id", "left_anti")
    return written(old.unionByName(new.select("id", "component")), "components")
