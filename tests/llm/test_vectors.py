"""Vector codes against a full search on integers, on odd rows, ties and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from triplake.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, code string, sums string"


def brute(rows, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    w = len(kept[0][1]) // 4
    cut = [[tuple(v[p * w : p * w + w]) for p in range(4)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(4)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p in range(4):
            parts = defaultdict(list)
            for c in cut:
                parts[nearest(c[p], books[p])[1]].append(c[p])
            books[p] = [tuple(sum(col) // len(parts[e]) for col in zip(*parts[e], strict=True)) if e in parts else c for e, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], defaultdict(int)
    for (i, _, lab), c in zip(kept, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab))
        by_label[lab] += out[-1][2]
    return sorted(((i, code, err, by_label[lab], digest) for i, code, err, lab in out), key=repr)


def odd_rows(n=150, dim=8, seed=3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.05) for c in rng.choice(centres)], rng.choice([0, 1, None])) for i in range(n)]
    rows += [(500 + i, rows[3][1], 1) for i in range(40)]  # exact copies: a large group
    rows += [(7, rows[7][1], 0), (600, None, 1), (601, [1.0] * (dim - 1) + [None], 1), (602, [math.nan] * dim, 0), (603, [math.inf] + [0.0] * (dim - 1), 0)]
    rows += [(None, [0.5] * dim, 2), (604, [-3000.25] * dim, None)]
    return rows


@pytest.mark.parametrize("entries", [256, 12, 1])
def test_codes_are_those_of_a_full_search(spark, entries):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, vectors.code_table(df, entries=entries).collect()), key=repr)
    assert got == brute(rows, entries)


def test_empty_vectors_and_tables(spark):
    df = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in odd_rows(4)], SCHEMA)
    assert vectors.code_table(df.limit(0)).collect() == []
    few = spark.createDataFrame([(1, [0.0] * 4, 1), (2, [1.0] * 4, 1), (3, [], 1), (4, [1.0] * 5, None)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vectors.code_table(few).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0), 4: (None, None, None)}
    odd = few.where("vec_id > 2")
    assert {r.code for r in vectors.code_table(odd).collect()} == {None}


def test_large_components(spark):
    rows = [(i, [float(x * 2**14) for x in range(i, i + 8)], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vectors.code_table(df, entries=3).collect()), key=repr) == brute(rows, 3)
    with pytest.raises(Exception, match="60 bits"):
        vectors.code_table(spark.createDataFrame([(1, [1e30] * 8, 0)], "vec_id long, embedding array<double>, label int")).collect()


def test_rings_are_subsets_of_all_entries():
    """After a round, far fewer entries are compared than exist, and the nearest is found all the same."""
    rng = np.random.default_rng(5)
    entries = rng.integers(-5000, 5000, (64, 4))
    x = np.repeat(entries, 20, 0) + rng.integers(-300, 300, (64 * 20, 4))
    best, dist = vectors.Balls(entries).nearest(x, None)
    radii = [int(math.sqrt(dist[best == e].max())) + 1 for e in range(64)]
    ball, met = vectors.Balls(entries, radii), 0

    class Counted(vectors.Balls):
        def among(self, y, candidates):
            nonlocal met
            met += len(y) * len(candidates)
            return super().among(y, candidates)

    ball = Counted(entries, radii)
    again, same = ball.nearest(x, best.astype(np.uint8))
    assert (again == best).all() and (same == dist).all()
    assert met < len(x) * 64 / 10
