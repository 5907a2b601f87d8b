"""Minimax contiguous shards of atomic groups (operator 1), by DataFrame operations only.

Documents with equal texts are one group; groups stand in the order of their smallest doc_id. The smallest capacity with which
the groups, taken greedily in order, fit into the shards is found by binary search. The shards are then cut at that
capacity; where it leaves room (a group larger than the mean, few groups) each cut moves forward to the mean of what is left,
as far as the remaining shards can still hold the rest.

Prefix sums of the groups are computed by Spark and stay in a table, sorted, so that a range of it is read without the rest. The driver keeps
one number for each BLOCK groups. These alone bound the search to capacities that differ by a block, so that all greedy checks cut in
the same few blocks, which are fetched once.

A null text counts as an empty one: size 8, checksum 0, one group with empty texts. Repeated rows get slots of their own. A
null doc_id comes first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplake.llm.prefix import prefix_sums
from triplake.llm.shared import utf8_size, written

SHARDS = 24
#: Groups in a block and blocks that the driver holds at once: 16384 * 64 numbers.
BLOCK, HELD = 1 << 14, 64


class Boundaries:
    """The sorted ends (inclusive prefix sums) of the groups of ends(block, last, size): lookups fetch one block at a time."""

    def __init__(self, ends: DataFrame):
        self.ends = ends
        rows = ends.groupBy("block").agg(F.max("last"), F.max("size")).collect()  # one row for each BLOCK groups
        rows.sort(key=lambda r: r[1])
        self.tops = [r[1] for r in rows]
        self.total, self.largest = (self.tops[-1], max(r[2] for r in rows)) if rows else (0, 0)
        self.held: OrderedDict[int, list[int]] = OrderedDict()

    def _block(self, i: int) -> list[int]:
        if i not in self.held:
            if len(self.held) >= HELD:
                self.held.popitem(last=False)
            rows = self.ends.where(F.col("last").between((self.tops[i - 1] if i else 0) + 1, self.tops[i])).select("last").collect()
            self.held[i] = sorted(r[0] for r in rows)
        self.held.move_to_end(i)
        return self.held[i]

    def floor(self, limit: int) -> int:
        """The largest end that is at most the limit, or 0."""
        if limit >= self.total:
            return self.total
        i = bisect_right(self.tops, limit)  # the first block that reaches beyond the limit
        own = self._block(i)
        k = bisect_right(own, limit)
        return own[k - 1] if k else (self.tops[i - 1] if i else 0)

    def ceil(self, limit: int) -> int:
        """The smallest end that is at least the limit, at most the total."""
        if limit <= 0:
            return 0
        i = bisect_left(self.tops, limit)
        if i == len(self.tops):
            return self.total
        own = self._block(i)
        return own[bisect_left(own, limit)]


def smallest_capacity(ends: Boundaries, shards: int) -> int:
    """The least capacity with which greedy cutting needs at most `shards` shards."""

    def fits(capacity: int, floor) -> bool:
        at = 0
        for _ in range(shards):
            at = floor(at + capacity)
            if at == ends.total:
                return True
        return False

    def least(low: int, high: int, floor) -> int:
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if fits(middle, floor) else (middle + 1, high)
        return low

    mean = -(-ends.total // shards)
    low, high = max(ends.largest, mean), ends.largest + mean
    # cuts at the ends of blocks need no fetch, and what they fit into is enough
    coarse = lambda limit: ends.tops[k - 1] if (k := bisect_right(ends.tops, limit)) else 0
    return least(low, min(high, least(low, max(high, ends.total), coarse)), ends.floor)


def cuts(ends: Boundaries, shards: int) -> list[int]:
    """The end of each shard."""
    capacity = smallest_capacity(ends, shards)
    least = [ends.total] * (shards + 1)  # where shard j must have come to at least
    for j in range(shards - 1, -1, -1):
        least[j] = ends.ceil(least[j + 1] - capacity)
    found, at = [], 0
    for j in range(shards):
        mean = -(-(ends.total - at) // (shards - j))
        limit = min(at + capacity, max(at + mean, least[j + 1]))
        to = ends.floor(limit)
        if to == at and at < ends.total:
            to = ends.ceil(at + 1)  # no group fits into the mean: take one
        at = to
        found.append(at)
    return found


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (utf8_size(F.col("text")) + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("same")
    )  # a cryptographic digest stands for the text, so that texts aren't shuffled
    rows = written(rows, "sizes")
    groups = rows.groupBy("same").agg(F.sum("size").alias("size"), F.min("doc_id").alias("first"))
    groups = prefix_sums(groups.withColumn("one", F.lit(1)), ["first", "same"], {"size": "start", "one": "rank"}, [], "groups")
    groups = written(groups.select("same", "first", "size", (F.col("start") + F.col("size")).alias("last"), F.floor(F.col("rank") / BLOCK).alias("block")), "group-ends")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = written(groups.select("block", "last", "size").repartitionByRange(parts, "last").sortWithinPartitions("last"), "sorted-ends")
    found = cuts(Boundaries(ends), shards)
    shard = F.lit(0)
    for end in found[:-1]:
        shard = shard + (F.col("last") > end).cast("int")
    placed = rows.join(groups.select("same", "first", shard.alias("shard")), "same").select("doc_id", "size", "text_crc32", "first", "same", "shard")
    numbered = prefix_sums(placed.withColumn("one", F.lit(1)), ["first", "same", "doc_id"], {"one": "slot"}, ["shard"], "placed")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
