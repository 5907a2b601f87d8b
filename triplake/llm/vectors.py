"""Vector codes by ball k-means on parts of vectors (operator 11).

Components become integers floor(scale * x); each vector is cut into equal consecutive parts, and each part position has a
codebook of its own. A round assigns every part to its nearest entry and moves the entries to the floored means. Entries
and what holds for them (distances between entries, radii, rings) are small and go to all tasks; rows stay where they are,
and one written table for each round carries the vectors, their codes and, in one more row for each task, that task's sums.

The ball of an entry holds the parts it was given, within its radius: the largest distance of the last round plus the
entry's own move. For a part at distance d of its entry, another entry at distance e of that entry can't be as near while
e > 2d. So only entries within twice the radius are neighbours; a part whose doubled distance is below the nearest
neighbour's lies in the stable core and does no work; any other lies in the ring between two neighbours, and the entries up
to that ring are its exact candidates. All comparisons are on squared integers, so codes are those of a full search.

Rows whose vector is null or holds null or non-finite components are dropped. The smallest id's vector sets the length;
rows with vectors of another length, and all rows if that length isn't a positive multiple of the number of parts, keep
their place with a null code and error. Null ids count as the largest; rows of one id are told apart by their components.
Fewer rows than entries give a smaller codebook, an empty table an empty result. Squared distances beyond 60 bits stop the job.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triplake.llm.shared import drop_written, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are compared with all entries at once, in the first round.
SLICE = 4096


def integers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """id, label and v, the vector's components as floored integers, of rows(vec_id, embedding, label) with finite vectors."""
    finite = "embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    return rows.where(finite).select(F.col("vec_id").alias("id"), "label", F.expr(f"transform(embedding, x -> floor({scale} * cast(x as double)))").alias("v"))


class Balls:
    """One part position's entries with their neighbours and rings, from the last round's radii (None: no round yet)."""

    def __init__(self, entries: np.ndarray, radii: list[int] | None = None):
        self.entries, self.size = entries, len(entries)
        apart = np.stack([squared(entries, e[None]) for e in entries]) if self.size else np.zeros((0, 0), np.int64)
        self.searched = radii is None
        if radii is not None:
            self.order = np.argsort(apart, axis=1, kind="stable")
            self.ring = np.take_along_axis(apart, self.order, 1)
            # what lies beyond twice the radius is no neighbour, whatever the ring
            self.neighbours = np.array([np.searchsorted(ring, min(4 * r * r, 1 << 62), "right") for ring, r in zip(self.ring, radii, strict=True)], np.int64)

    def nearest(self, x: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties to the lower) of every part and its squared distance; code has the last round's."""
        check(x, self.entries)
        if self.searched or code is None:
            found = [self.among(x[a : a + SLICE], np.arange(self.size)) for a in range(0, len(x), SLICE)]
            return (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        code = code.astype(np.int64)
        best, dist = code.copy(), squared(x, self.entries[code])
        by_entry = np.argsort(code, kind="stable")
        cuts = np.searchsorted(code[by_entry], np.arange(self.size + 1))
        for e in np.flatnonzero(np.diff(cuts)):
            mine = by_entry[cuts[e] : cuts[e + 1]]
            reach = np.minimum(np.searchsorted(self.ring[e], 4 * dist[mine], "right"), self.neighbours[e])
            # rings are taken together up to a doubling, so a part meets at most twice its candidates
            width = np.ceil(np.log2(np.maximum(reach, 1))).astype(int)
            for w in np.unique(width[reach > 1]):  # a reach of 1 is the entry itself: the stable core
                at = mine[(width == w) & (reach > 1)]
                candidates = np.sort(self.order[e, : min(1 << w, self.neighbours[e])])
                best[at], dist[at] = self.among(x[at], candidates)
        return best, dist

    def among(self, x: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same among some entries, given by ascending index."""
        own = self.entries[candidates]
        if fits(x, own, 1 << 52):  # the products are exact in floating point
            y, c = x.astype(np.float64), own.astype(np.float64)
            d = (y * y).sum(1)[:, None] - 2 * (y @ c.T) + (c * c).sum(1)[None]
        else:
            d = np.stack([squared(x, c[None]) for c in own], axis=1)
        k = d.argmin(axis=1)
        return candidates[k], d[np.arange(len(x)), k].astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(axis=1)


def fits(x: np.ndarray, entries: np.ndarray, most: int) -> bool:
    """Whether no squared distance between the two can pass `most`."""
    top = max((int(max(a.max(), -int(a.min()))) for a in (x, entries) if a.size), default=0)
    return (2 * top) ** 2 * x.shape[1] <= most


def check(x: np.ndarray, entries: np.ndarray) -> None:
    if not fits(x, entries, 1 << 60):  # four times a distance is compared
        raise OverflowError("squared distances pass 60 bits: scale the vectors down")


def assigned(rows: DataFrame, balls: list[Balls], coded: bool) -> DataFrame:
    """rows with the codes of this round in `code`, one byte a part, `error`, and a row for each task with `sums` and `radii`.

    sums has, for each position and entry, the components' sums and the count; radii the largest squared distance.
    """
    spark, width = rows.sparkSession, balls[0].entries.shape[1]
    held = spark.sparkContext.broadcast(balls)
    size, n_parts = balls[0].size, len(balls)
    added = [T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("sums", "radii"))]
    schema = T.StructType([*rows.select("id", "label", "v").schema.fields, *added])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, radii = np.zeros((n_parts, size, width + 1), np.int64), np.zeros((n_parts, size), np.int64)
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in ("id", "label", "v")]
            n = batch.num_rows
            x = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, n_parts, width)
            old = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(n, n_parts) if coded else None
            code, error = np.zeros((n, n_parts), np.uint8), np.zeros(n, np.int64)
            for p, ball in enumerate(held.value):
                best, dist = ball.nearest(x[:, p], None if old is None else old[:, p])
                code[:, p] = best
                error += dist
                np.add.at(sums[p, :, :width], best, x[:, p])
                sums[p, :, width] += np.bincount(best, minlength=size)
                np.maximum.at(radii[p], best, dist)
            nothing = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "v")), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error), nothing, nothing], names)
        if kinds:
            own = [pa.array([a.ravel().tolist()], pa.list_(pa.int64())) for a in (sums, radii)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), *own], names)

    names = schema.fieldNames()
    return written(rows.mapInArrow(each, schema), "codes")


def moved(table: DataFrame, balls: list[Balls]) -> list[Balls]:
    """The next round's balls: entries at the floored means of their parts, radii grown by the move."""
    width, size = balls[0].entries.shape[1] + 1, balls[0].size

    def totals(column: str, how) -> dict[int, int]:
        """One number for each place of the codebooks: few rows, whatever the table's size."""
        each = table.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("at", "x"))
        return {r[0]: int(r[1]) for r in each.groupBy("at").agg(how(F.col("x").cast("decimal(20,0)"))).collect()}

    sums, radii = totals("sums", F.sum), totals("radii", F.max)
    out = []
    for p, ball in enumerate(balls):
        entries, grown = ball.entries.copy(), []
        for e in range(size):
            at = (p * size + e) * width
            count = sums[at + width - 1]
            if count:
                entries[e] = [sums[at + i] // count for i in range(width - 1)]
            move = int(((entries[e] - ball.entries[e]) ** 2).sum())
            grown.append(int(np.sqrt(float(radii[p * size + e]))) + int(np.sqrt(float(move))) + 4)
        out.append(Balls(entries, grown))
    return out


def vector_codes(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """id, label, v, code (one byte a part, null for odd lengths) and error of rows(vec_id, embedding, label), and the codebooks."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    whole = written(integers(rows, scale), "integers")
    in_order = [F.col("id").asc_nulls_last(), F.col("v")]
    least = whole.orderBy(*in_order).limit(1).collect()
    length = len(least[0]["v"]) if least else 0
    odd = whole.select("id", "label", "v", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    if not length or length % parts:
        return odd, []
    held = whole.where(F.size("v") == length)
    first = held.orderBy(*in_order).limit(entries).collect()
    start = np.array([r["v"] for r in first], np.int64).reshape(-1, parts, length // parts)
    balls = [Balls(start[:, p]) for p in range(parts)]
    for step in range(rounds + 1):
        table = assigned(held, balls, step > 0)
        if step:
            drop_written(held)
        held = table.where("sums is null")
        if step < rounds:
            balls = moved(table, balls)
    coded = held.select("id", "label", "v", "code", "error")
    return coded.unionByName(odd.where(F.size("v") != length)), [b.entries for b in balls]


def code_table(rows: DataFrame, **how) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every row that vector_codes keeps."""
    coded, books = vector_codes(rows, **how)
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    totals = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    met = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return met.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
