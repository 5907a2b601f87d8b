"""The corpus operators on small tables: against brute force, on nulls, copies, empty tables and clashing column names."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from triplake.llm import decontam, extraction, lines, minhash, mixing, quality, sharding, shared, suffix_tree, tokens, warc
from triplake.llm.components import components
from triplake.llm.shared import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


# ---- 1 ----
def greedy(sizes, capacity):
    n, held = 1, 0
    for s in sizes:
        if held + s > capacity:
            n, held = n + 1, 0
        held += s
    return n


def test_shards(docs):
    out = sharding.shard_documents(docs, 5).collect()
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert len(out) == sum(texts.values())
    of = dict(texts.keys())
    groups, shard_of = defaultdict(list), {}
    for r in out:
        t = of[r.doc_id]
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        groups[t].append(r)
        assert shard_of.setdefault(t, r.shard) == r.shard
    for s in range(5):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in g) for g in sorted(groups.values(), key=lambda g: min(r.doc_id for r in g))]
    best = next(c for c in range(max(sizes), sum(sizes) + 1) if greedy(sizes, c) <= 5)
    load = Counter()
    for r in out:
        load[r.shard] += r["size"]
    assert max(load.values()) <= best


def test_shards_over_many_blocks(docs, monkeypatch):
    whole = sorted(map(tuple, sharding.shard_documents(docs, 5).collect()), key=repr)
    monkeypatch.setattr(sharding, "BLOCK", 3)
    assert sorted(map(tuple, sharding.shard_documents(docs, 5).collect()), key=repr) == whole


@pytest.mark.parametrize("n, shards", [(0, 3), (1, 3), (2, 24), (30, 4)])
def test_shards_of_few(spark, n, shards):
    df = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(n)], "doc_id long, text string")
    out = sharding.shard_documents(df, shards).collect()
    assert len(out) == n and {r.shard for r in out} <= set(range(shards))
    assert len({r.shard for r in out}) == min(n, shards)


def test_smallest_capacity():
    class Local(sharding.Boundaries):
        def __init__(self, sizes):
            self.ends_, self.total, self.largest = np.cumsum(sizes).tolist(), sum(sizes), max(sizes)
            self.tops = sorted({*self.ends_[3::4], self.total})

        def floor(self, limit):
            return max([e for e in self.ends_ if e <= limit], default=0)

        def ceil(self, limit):
            return 0 if limit <= 0 else min(e for e in self.ends_ if e >= limit)

    rng = np.random.default_rng(5)
    for _ in range(60):
        sizes = rng.integers(1, 60, rng.integers(1, 30)).tolist()
        k = int(rng.integers(1, 9))
        found = sharding.smallest_capacity(Local(sizes), k)
        assert greedy(sizes, found) <= k and (found == max(sizes) or greedy(sizes, found - 1) > k)
        ends = [0, *sharding.cuts(Local(sizes), k)]
        assert ends[-1] == sum(sizes) and max(b - a for a, b in zip(ends, ends[1:], strict=False)) <= found


# ---- 2 ----
def test_decontamination(spark, docs):
    items = [(1, prose(5000, 40)), (2, prose(5001, 40)), (3, "a b"), (4, None), (1, prose(5002, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    w = items[1][1].split()
    swapped = " ".join(w[20:]) + "\n" + " ".join(w[:20])
    planted = [(900, prose(1, 60) + "\n" + items[0][1].upper() + " " + prose(2, 50)), (901, prose(3, 80) + " " + swapped), (902, prose(4, 100) + " " + " ".join(w[:8]))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    for block in (decontam.BLOCK, 40):
        out = decontam.contaminated(df, bench, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in out} == {(900, 1), (901, 2)}
        assert next(r for r in out if r.doc_id == 901).n_tiles >= 2
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and Counter(rows(kept, "doc_id")) == Counter(rows(df.where("doc_id not in (900, 901)"), "doc_id"))
    assert decontam.contaminated(df, bench.limit(0)).count() == 0
    assert decontam.contaminated(df.limit(0), bench).count() == 0


def defined_tiles(a, b, least):
    """The definition: always the longest match of unmarked tokens, the first in the item, then in the text."""
    ma, mb, found = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not ma[i + k] and not mb[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < least:
            return found
        ma[i : i + k] = mb[j : j + k] = [True] * k
        found.append((i, j, k))


def test_tiles_are_greedy():
    """Rows of tiles of one length agree as a whole: their number, lengths and what they cover."""
    rng = np.random.default_rng(3)
    for n in range(60):
        kinds = 1 + n % 5
        a, b = rng.integers(0, kinds, 25).astype(np.uint64), rng.integers(0, kinds, 40).astype(np.uint64)
        got, want = decontam.tiles(a, b, 3), defined_tiles(a, b, 3)
        assert sorted((k, i, j) for i, j, k in got) == sorted((k, i, j) for i, j, k in want)


def test_repetitive_texts_take_little():
    item, text = np.zeros(400, np.uint64), np.zeros(30_000, np.uint64)
    assert decontam.tiles(item, text, 4) == [(0, 0, 400)]


def test_contaminated_against_brute_force(spark):
    rng = random.Random(11)
    items = [(f"q-{k}", prose(9000 + k, rng.randrange(12, 40))) for k in range(6)] + [("short", "a b"), (None, prose(9000, 20))]
    docs = []
    for d in range(60):
        w = prose(9100 + d, rng.randrange(5, 60)).split()
        for _ in range(rng.randrange(3)):  # pieces of items, in any order
            source = items[rng.randrange(6)][1].split()
            i = rng.randrange(len(source))
            at = rng.randrange(len(w) + 1)
            w[at:at] = source[i : i + rng.randrange(3, 30)]
        docs.append((d, " ".join(w)))
    want = {}
    for d, text in docs:
        words = decontam.tokens(text)
        for k, item in items:
            own = decontam.tokens(item)
            if k and len(own) >= decontam.SEED:
                found = defined_tiles(own, words, decontam.SEED)
                covered = sum(n for *_, n in found)
                if 2 * covered >= len(own):
                    want[d, k] = (len(own), covered, len(found))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    for block in (decontam.BLOCK, 50):
        got = {(r.doc_id, r.item_id): (r.n_item_tokens, r.n_covered, r.n_tiles) for r in decontam.contaminated(df, bench, block=block).collect()}
        assert got == want and len(want) > 5
        assert {r.doc_id for r in decontam.decontaminate(df, bench, block=block).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontaminate_writes_nothing_but_matches(spark, docs, tmp_path):
    """With 1 and with 5 blocks the same rows stay, all columns and clashing names included; more blocks write matching texts alone."""
    items = [prose(9000 + i, 60) for i in range(25)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(30, None), (None, "x")], "item_id long, text string")
    more = [(1000 + i, f"{prose(9100 + i, 30)} {items[i]} {prose(9200 + i, 30)}", "en", "s0", 1, 7, 9, "x", 1, "h", "q") for i in range(5)]
    df = docs.unionByName(spark.createDataFrame(more * 2, docs.schema)).withColumn("_hash", F.lit("mine")).withColumn("_bad", F.lit(1))
    size = sum(len(r.text or "") for r in df.collect())
    kept = {}
    for name, block in (("one", 1 << 18), ("five", 375)):
        seen = []
        write = decontam.written
        decontam.written = lambda d, n: seen.append(write(d, n)) or seen[-1]  # noqa: B023
        try:
            out = decontam.decontaminate(df, bench, block=block)
            kept[name] = Counter(map(tuple, out.collect()))
        finally:
            decontam.written = write
        assert out.columns == df.columns
        if name == "five":
            assert len(seen) >= 5 and all(set(t.columns) == {"_bad", "_bad_hash"} for t in seen)
            assert sum(len(r._bad) for t in seen for r in t.collect()) < size / 10
        else:
            assert not seen
    assert kept["one"] == kept["five"] and sum(kept["one"].values()) == df.count() - 10


# ---- 3 ----
def test_line_chunks(spark, docs):
    passage = prose(777, 120)
    more = [(800, prose(2010, 72) + "\n" + passage + "\n" + prose(2011, 70)), (801, prose(2012, 96) + "\n" + passage), (802, None)]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = lines.line_dedup(df).collect()
    assert len(out) == df.count()
    before = defaultdict(list)
    for d, t in rows(df, "doc_id", "text"):
        before[d].append(t)
    for r in out:
        t = before[r.doc_id][0]
        if t is None:
            assert r.text is None
        elif not r.removed_chunks:
            assert r.text == t
        else:
            assert len(r.text.split("\n")) <= r.n_lines - r.removed_lines or r.text == ""
    gone = {r.doc_id: r.removed_lines for r in out}
    assert gone[800] == 0 and gone[801] >= 4  # the first occurrence stays
    assert gone[3] == 0 and all(gone[100 + i] > 0 for i in range(12))
    assert lines.line_dedup(df.limit(0)).count() == 0


def cut_lines(text, spread=3):
    """The chunks by the rule itself: one ends after a line where the rolling hash of it and the line before is 0 modulo 3, unless the line before has that too."""
    ls = text.split("\n")
    mask = (1 << 64) - 1
    marks = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in ls]
    rolled = [None, *((b ^ (a << 1 & mask | a >> 63)) for a, b in zip(marks, marks[1:], strict=False))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hits = [r is not None and signed(xxhash.xxh64(r.to_bytes(8, "little"), seed=42).intdigest()) % spread == 0 for r in rolled]
    starts = [i for i in range(len(ls)) if i == 0 or (i > 1 and hits[i - 1] and not hits[i - 2])]
    return ["\n".join(ls[a:b]) for a, b in zip(starts, [*starts[1:], len(ls)], strict=True)]


def test_boundaries_decide_which_chunks_are_found(spark, docs):
    """Other boundaries find other repeated chunks; their extension and the short passages left make up for it."""
    df = docs.select("doc_id", "text").distinct()
    ids = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text").where("text is not null")
    found = {}
    for spread in (3, 7):
        own = lines.repeated(lines.with_texts(ids, lines.candidates(ids, spread).where("whole")))
        found[spread] = {(r.id, r.pos, r.n) for r in own.collect()}
        seen, want = set(), set()
        for d, t in sorted(rows(ids, "id", "text")):
            at = 0
            for c in cut_lines(t, spread):
                n = c.count("\n") + 1
                if n > 1:
                    want |= {(d, at, n)} if c in seen else set()
                    seen.add(c)
                at += n
        assert found[spread] == want
        assert any(r.up + r.down for r in own.collect())
    assert found[3] != found[7] and found[3] and found[7]
    texts = [{(r.doc_id, r.text, r.removed_lines) for r in lines.line_dedup(df, spread).collect()} for spread in (3, 7)]
    assert texts[0] == texts[1]


def test_line_chunks_against_brute_force(spark, docs):
    """The whole query: boundaries by their rule, chunks and pairs of lines that repeat earlier ones, and the text that is left."""
    df = docs.select("doc_id", "text").distinct()
    seen, lines_seen, want = set(), set(), {}
    for d, t in sorted(rows(df, "doc_id", "text"), key=lambda r: r[0]):
        if t is None:
            want[d] = (0, 0, 0, None)
            continue
        ls, n_chunks, gone = t.split("\n"), 0, set()
        for c in cut_lines(t):
            if "\n" in c:
                n_chunks += c in seen
                seen.add(c)
        at = 0
        for c in cut_lines(t):
            at += c.count("\n") + 1
        assert at == len(ls)
        for i, pair in enumerate(zip(ls, ls[1:], strict=False)):
            if pair[0].strip(" ") or pair[1].strip(" "):
                gone |= {i, i + 1} if pair in lines_seen else set()
                lines_seen.add(pair)
        want[d] = (len(ls), max(1, n_chunks) if gone else n_chunks, len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    got = {r.doc_id: (r.n_lines, r.removed_chunks, r.removed_lines, r.text) for r in lines.line_dedup(df).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 10


def test_every_repeated_run_of_lines_goes(spark):
    """Passages of 2 to 5 lines between other neighbours, held against all repeated pairs of lines, not against chunked()."""
    made = [(0, "\n".join("\n".join([prose(5000 + k, 14, 99), *(prose(6000 + 10 * k + i, 12, 99) for i in range(2 + k % 4))]) for k in range(40)))]
    made += [(1 + k, "\n".join([prose(7000 + k, 13, 99), *(prose(6000 + 10 * k + i, 12, 99) for i in range(2 + k % 4)), prose(8000 + k, 13, 99)])) for k in range(40)]
    made += [(50, "alone\n\n\nother\n\n\nlast"), (51, None), (52, "")]
    seen, want = set(), {}
    for d, t in made:
        ls, gone = (t or "").split("\n"), set()
        for i, pair in enumerate(zip(ls, ls[1:], strict=False)):
            if pair != ("", ""):
                gone |= {i, i + 1} if pair in seen else set()
                seen.add(pair)
        want[d] = (len(gone), None if t is None else "\n".join(x for i, x in enumerate(ls) if i not in gone))
    got = {r.doc_id: (r.removed_lines, r.text) for r in lines.line_dedup(spark.createDataFrame(made, "doc_id long, text string").repartition(3)).collect()}
    assert got == want and all(want[1 + k][0] == 2 + k % 4 for k in range(40))


# ---- 4 ----
def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_components(pairs, width):
    sets = {d: shingles(t, width) for d, t in pairs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return sets, {d: find(d) for d in sets}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    base = prose(60, 200).split(" ")
    chain = [base]
    for i in range(5):
        nxt = list(chain[-1])
        nxt[10 * i : 10 * i + 4] = [f"new{i}a", f"new{i}b", f"new{i}c", f"new{i}d"]
        chain.append(nxt)
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(500 + i, " ".join(w)) for i, w in enumerate(chain)], "doc_id long, text string"))
    out = minhash.near_duplicates(df, width).collect()
    sets, comp = brute_components(set(rows(df, "doc_id", "text")), width)
    assert len(out) == df.count()
    for r in out:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], r.doc_id == comp[r.doc_id])
    kept = minhash.near_dedup(df, width)
    assert kept.columns == df.columns
    assert sorted(r[0] for r in rows(kept, "doc_id")) == sorted({d for d, c in comp.items() if d == c})


@pytest.mark.parametrize(("stars", "volume"), [(0, 1 << 20), (1, 1 << 20), (0, 150), (2, 150)])
def test_blocks_find_what_leaders_miss(spark, monkeypatch, stars, volume):
    """Blocks of few members or few shingles and leaders with many parts find the same links."""
    monkeypatch.setattr(minhash, "STAR_ROUNDS", stars)
    monkeypatch.setattr(minhash, "BLOCK", 3)
    monkeypatch.setattr(minhash, "VOLUME", volume)
    monkeypatch.setattr(minhash, "MEMBERS", 2)
    base = prose(4000, 120).split(" ")
    texts = [base]
    for i in range(24):  # copies of copies: many are linked through others only
        nxt = list(texts[i // 3])
        for k in range(4 + i % 5):
            nxt[(17 * i + 29 * k) % len(nxt)] = f"w{i}x{k}"
        texts.append(nxt)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    _, comp = brute_components(rows(df, "doc_id", "text"), 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == comp
    assert 1 < len(set(comp.values())) < 25


@pytest.mark.parametrize("least", [-(1 << 63), 5])
def test_ids_of_any_value(spark, least):
    """The ends of the range are ids like others, also where they stand on several texts."""
    most = (1 << 63) - 1
    a, b, c = (prose(5000 + i, 80) for i in range(3))
    made = [(least, a), (most, a + " more"), (0, b), (most - 1, b + " more"), (1 << 56, c), (None, a)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()}
    assert out == {least: (least, True), most: (least, False), 0: (0, True), most - 1: (0, False), 1 << 56: (1 << 56, True), None: (None, True)}
    clash = [(least, prose(5100 + i, 50)) for i in range(3)] + [(most, prose(5200 + i, 50)) for i in range(3)]
    kept = {(r.doc_id, r.text) for r in minhash.near_dedup(df.unionByName(spark.createDataFrame(clash, df.schema))).collect()}
    assert kept == {made[0], made[2], made[4], made[5], *clash}


def test_texts_of_one_template_seldom_meet(spark):
    """Of texts that share a third of their shingles few share a table; those linked are found all the same."""
    own = [" ".join(f"w{i}x{k}" if k % 4 > 1 else f"t{k}" for k in range(64)) for i in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)] + [(1000 + i, own[i] + " end") for i in range(0, 200, 20)], "doc_id long, text string")
    sigs = minhash.signatures(df.selectExpr("doc_id AS id", "true AS known", "text"), 2).groupBy("set_a", "n_shingles").agg(F.min("id").alias("id"), F.first("left").alias("left"), F.first("right").alias("right"))
    met = minhash.buckets(sigs)
    pairs = met.alias("x").join(met.alias("y"), F.expr("x.key = y.key AND x.id < y.id")).select("x.id", "y.id").distinct().count()
    assert pairs < 0.02 * 200 * 199 / 2  # similarity 1/7
    _, comp = brute_components(rows(df, "doc_id", "text"), 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == comp


def rows_of_joins(spark, since: int, meant) -> int:
    """Rows that the joins whose text is meant have made in the executions from `since` on."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    found, made = store.executionsList(since, 10_000), 0
    for i in range(found.size()):
        number = found.apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(k) for k in range(nodes.size())):
            if "Join" not in node.name() or not meant(node.desc()):
                continue
            for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    made += int(values.apply(m.accumulatorId()).replace(",", ""))
    return made


def test_a_large_group_meets_its_outsiders_once_a_member(spark):
    """Members of a group of near copies come to those that are not linked with it by signature, not by bucket."""
    base = prose(7000, 300).split(" ")
    texts = [" ".join([*base[: 4 * i], f"own{i}", *base[4 * i + 1 :]]) for i in range(60)]
    texts += [" ".join(f"out{k}x{i}" if i % 15 == 7 * k + 3 else w for i, w in enumerate(base)) for k in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    _, comp = brute_components(rows(df, "doc_id", "text"), 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == comp
    assert len(set(comp.values())) > 1
    whole = rows_of_joins(spark, since, lambda text: "[key#" in text and "Inner" in text and "m_component" not in text)
    assert whole + rows_of_joins(spark, since, lambda text: "[component#" in text and "LeftSemi" in text) <= 2 * minhash.COLUMNS * len(texts)


def test_near_duplicates_edges(spark, empty):
    assert minhash.near_duplicates(empty, 2).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(df, 2).collect()}
    assert out == {None: (None, True), 1: (1, True), 2: (2, True), 3: (3, True)}
    assert minhash.near_dedup(df).count() == 4


@pytest.mark.parametrize("few", [1 << 17, 0, 20])
def test_components(spark, monkeypatch, few):
    from triplake.llm import components as module

    monkeypatch.setattr(module, "FEW", few)
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [tuple(map(int, e)) for e in rng.integers(200, 260, (35, 2))]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    root = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r or any(x in e and e[0] != e[1] for e in edges)}


# ---- 5 ----
def test_warc(spark):
    html = ["<p>a</p>", "<p>a</p>", "", None, "<p>é</p>" * 9, "<p>a</p>", "<p>last</p>", "<p>last</p>"]
    ids = [1, 5, 2, 9, 3, 4, None, 7]
    pages = spark.createDataFrame([(i, None if i == 3 else f"http://x/{i}", h, "clash") for i, h in zip(ids, html, strict=True)], "page_id long, url string, html string, digest string")
    out = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(out) == len(ids)
    for i, h in zip(ids, html, strict=True):
        raw = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in out.items()} == {1: ("revisit", 5), 5: ("response", None), 2: ("revisit", 9), 9: ("response", None), 3: ("response", None), 4: ("revisit", 5), None: ("revisit", 7), 7: ("response", None)}
    assert warc.round_trip(pages.limit(0)).count() == 0
    # beyond what is broadcast, the same
    told = lambda df: Counter(tuple(r) for r in df.collect())
    few, many = warc.with_revisits(pages, most=0), warc.with_revisits(pages)
    assert told(few) == told(many) and {r.page_id for r in many.collect() if r.html is None} == {1, 2, 4, None}


def test_warc_seeks_single_records(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{prose(i, 30)}</p>", None) for i in range(40)], "page_id long, url string, html string, refers_to long").repartition(2)
    index = warc.write_bundles(pages, str(tmp_path / "w"), frame=1500, bundle=1000)
    assert index.select("bundle").distinct().count() > 2 and index.groupBy("bundle").agg(F.max("frame").alias("f")).agg(F.max("f")).first()[0] > 0
    some = index.where(F.col("record_id").rlike(":(3|17|39):"))
    got = {r.page_id: bytes(r.payload).decode() for r in warc.read_records(some, str(tmp_path / "w")).collect()}
    assert got == {i: f"<p>{prose(i, 30)}</p>" for i in (3, 17, 39)}


# ---- 6 ----
def test_mix(docs):
    out = mixing.mix(docs).collect()
    assert len(out) == docs.count()
    text = {d: t for d, t, in rows(docs, "doc_id", "text")}
    source = dict(rows(docs, "doc_id", "source"))
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == len(WORD.findall(text[r.doc_id] or ""))
        s = source[r.doc_id]
        size[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    for s in size:
        assert abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    assert sorted(rows(mixing.mix(docs.repartition(5)), "doc_id", "taken")) == sorted((r.doc_id, r.taken) for r in out)
    again = mixing.resample(docs.dropDuplicates(["doc_id"]))
    assert again.columns == docs.columns and again.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3


def test_targets_are_capped(spark, empty):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 30), (None, 5)], "source string, source_size long")
    got = dict(rows(mixing.targets(sizes), "source", "target"))
    assert got["a"] == 30 and math.isclose(sum(got.values()), 1045) and got[None] == 15 and got["c"] == 90
    assert mixing.mix(empty).count() == 0


def test_null_and_clashing_ids_stay(spark):
    """No document goes for a null doc_id or for sharing another document's doc_id."""
    made = [(None, prose(3000 + i, 60), "a") for i in range(30)] + [(7, prose(3100 + i, 60), "a") for i in range(4)] + [(i, prose(3200 + i, 60), "b") for i in range(20)]
    made += [(7, made[30][1], "a"), (40, made[31][1], "b")]  # a repeated row, and a copy of a text of a clashing id
    df = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(3)
    kept = Counter((r.doc_id, r.text) for r in minhash.near_dedup(df).collect())
    assert set(kept.values()) == {1} and {t for _, t in kept} == {t for _, t, _ in made} and len(kept) == 54
    whole = mixing.resample(df, weights=(1,), most=1)
    assert Counter(whole.collect()) == Counter(df.collect())
    words = Counter()
    for r in mixing.resample(df, share=0.5, weights=(1,)).collect():
        words[r.doc_id is None] += len(r.text.split())
    assert 600 <= words[True] + words[False] <= 2640 and 0 < words[True] < 1800


#: Names that the operators use inside, as a caller's columns.
CLASHING = "word bits n_words word_chars fail_bits n_lines _doc _key _id _copies _digest _possible _word _bits _source copies digest part size epochs id kept n row h component".split()


@pytest.fixture(scope="module")
def clashing(spark):
    """Documents with null, equal and repeated ids, whose other columns have the names that operators use inside."""
    made = [(None, prose(3000 + i, 60), "a") for i in range(6)] + [(7, prose(3100 + i, 60), "a") for i in range(3)] + [(i, prose(3200 + i, 60), "b") for i in range(10, 20)] + [(30, None, None), (31, "", "b"), (32, "x " * 400, "a")]
    made += [(33, made[12][1], "b"), (34, prose(1, 50) + " " + prose(5000, 40) + " " + prose(2, 50), "b")]
    rows = [(*r, *[f"{c}{i}" for c in CLASHING]) for i, r in enumerate(made)]
    rows.append(rows[9])
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHING)
    return spark.createDataFrame(rows, schema).repartition(3)


def _own(df):
    return Counter(tuple(r) for r in df.collect())


def test_filters_keep_the_callers_columns(spark, clashing):
    """near_dedup, decontaminate, resample and quality_filter return the caller's own rows, values and all."""
    whole = _own(clashing)
    bench = spark.createDataFrame([(1, prose(5000, 40))], "item_id long, text string")
    text = lambda rows: Counter((r[0], r[1]) for r in rows)
    gone = lambda rows: text((whole - rows).elements())
    found = {
        "quality": quality.quality_filter(clashing), "near": minhash.near_dedup(clashing), "leaks": decontam.decontaminate(clashing, bench), "mix": mixing.resample(clashing, weights=(1,), most=1),
    }
    for df in found.values():
        assert df.columns == clashing.columns and not _own(df) - whole
    assert {(d, len((t or "").split())) for d, t in gone(_own(found["quality"]))} == {(30, 0), (31, 0), (32, 400)}
    assert sorted(gone(_own(found["near"]))) == sorted([(33, prose(3213, 60)), (10, prose(3210, 60))])
    assert list(gone(_own(found["leaks"]))) == [(34, prose(1, 50) + " " + prose(5000, 40) + " " + prose(2, 50))]
    assert not gone(_own(found["mix"])) - Counter({(30, None): 1, (31, ""): 1})


# ---- 7 ----
def test_quality(docs):
    out = quality.ledger(docs).collect()
    assert len(out) == docs.count() and "source" in quality.ledger(docs).columns
    text = dict(rows(docs, "doc_id", "text"))
    for r in out:
        t = text[r.doc_id] or ""
        w = WORD.findall(t)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
        ls = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(ls) - len(set(ls)), len(covered))
    base = quality.mask("base-1")
    for r in out:
        assert bool(r.fail_bits & base) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)


def test_ablation(docs, empty):
    held = quality.ledger(docs)
    got = {r.rule: r for r in quality.ablation(held, "full-1").collect()}
    bits = [r.fail_bits for r in held.collect()]
    for rule in quality.POLICIES["full-1"]:
        b = quality.bit(rule)
        assert got[rule].n_failed == sum(bool(x & b) for x in bits) and got[rule].n_failed_alone == sum(x == b for x in bits) and got[rule].n_kept_without == sum(not x & ~b for x in bits)
    assert quality.ledger(empty).count() == 0 and quality.quality_filter(docs).columns == docs.columns


def test_long_texts_are_not_few_words(spark):
    """The share of distinct words falls with length; a small vocabulary still fails at any length."""
    make = lambda kinds, n: " ".join(f"w{random.Random(i).randrange(kinds)}" for i in range(n))
    df = spark.createDataFrame([(1, make(7000, 40000)), (2, make(300, 40000)), (3, make(300, 1900))], "doc_id long, text string")
    bit = quality.bit("few_distinct_words")
    assert {r.doc_id: bool(r.fail_bits & bit) for r in quality.ledger(df).collect()} == {1: False, 2: True, 3: True}


def test_word_length_tells_nothing_without_blanks(spark):
    han = " ".join("これは日本語で書かれた文章の一部である" for _ in range(25))
    latin = " ".join("x" * 19 + str(i) for i in range(25))
    df = spark.createDataFrame([(1, han), (2, latin)], "doc_id long, text string")
    bit = quality.bit("odd_word_length")
    assert {r.doc_id: bool(r.fail_bits & bit) for r in quality.ledger(df).collect()} == {1: False, 2: True}


# ---- 8 ----
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><a href=/a>Home</a> <a href=/b>News of the day</a></nav>
<div class="cookie-notice">We use cookies on this site to make it better for all of you and for us.</div>
<article><h1>A head&shy;line</h1><p>The first paragraph of the article is about the   things that are in it &amp; more, as it is<br>written.</p>
<p>Short.</p><div class="ad">Buy this now</div><script>var x = "<p>no</p>";</script><p>The last of the paragraphs is the one that comes at the end of the article.
<section class="comments"><p>I do not like this article at all and would not read it to the end again.</p></section></article>
<aside>Other things to read on the site when you are done with this.</aside><form><label>Mail</label><input></form><footer>&copy; 2024 of the house</footer></body></html>"""


def test_main_text(spark):
    want = "A head\xadline The first paragraph of the article is about the things that are in it & more, as it is written. Short. The last of the paragraphs is the one that comes at the end of the article."
    assert extraction.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (1, PAGE, "x")], "page_id long, html string, n_chars string")
    out = extraction.extract(pages).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in out) == Counter([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0)])
    assert extraction.extract(pages.limit(0)).count() == 0


def test_main_text_without_article():
    text = "This is the text of a page that has no article element but it has a good many words that are in all of the texts of this language and so it is kept."
    assert extraction.main_text(f"<div id=menu><a href=x>one</a></div><div><p>{text}</p><p>Tiny.</p><p>{text}</p></div><div class=footer>{text}</div>") == f"{text} Tiny. {text}"


BODY = "This is the text of a page and it has a good many words that are in all of the texts of this language and so it is kept."


@pytest.mark.parametrize("page", [
    '<div class="site no-sidebar"><p>{}</p></div>', '<div class="has-sidebar"><article><p>{}</p></article></div>', '<div class="elementor-widget"><p>{}</p></div>',
    '<form id=aspnet><div><p>{}</p></div></form>', '<div class="widget"><article><p>{}</p></article></div>', '<div class="overlay"><main><p>{}</p></main></div>',
    '<div class="elementor-widget"></div><div class="post-widget"><p>{}</p></div><div class="site-footer"><p>All of the rights to the text of this site and to what is on it are with us.</p></div>',
    "<svg-icon name=x></svg-icon><p>{}</p>", "<video-player></video-player><p>{}</p>", "<select-box><p>{}</p></select-box>", "<svg width=1 /><p>{}</p>",
])
def test_wrappers_do_not_lose_the_article(page):
    assert extraction.main_text(f"<html><body>{page.format(BODY)}<div class='sidebar'><p>{BODY} No.</p></div></body></html>") == BODY


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "with-banner", "tags-open", "comments-open", "search-results", "main-widget", "post-share-enabled"])
def test_state_classes_do_not_lose_the_article(name):
    for inner in (f"<article><p>{BODY}</p></article>", f"<p>{BODY}</p>", f"<form action=x><article><p>{BODY}</p></article></form>"):
        page = f'<html><body><nav><a href=x>Home</a></nav><div class="{name}">{inner}</div><div class="sidebar"><p>{BODY} No.</p></div><div class="comments"><p>{BODY} No!</p></div></body></html>'
        assert extraction.main_text(page) == BODY


@pytest.mark.parametrize("page", [
    "<nav><a href=x>Home</a><main><p>{}</p></main>", "<nav><a href=x>Home</a><article><p>{}</p></article>", "<header><h1></h1><article><p>{}</p></article></header>", "<header><main><p>{}</p></main></header>",
    "<header><a href=x>Home</a><div><p>{}</p></div>", "<nav><a href=x>Home</a><p>{}</p>", "<fieldset><article><p>{}</p></article></fieldset>", "<div role=dialog><article><p>{}</p></article></div>",
    "<fieldset><p>{}</p></fieldset>", "<p style='display:none'>x<div><article><p>{}</p></article></div>", "<p hidden>x<div><p>{}</p></div>", "<p class=x'><b>{}</b></p><p class='y'></p>", "<p data-x=don't>{}</p>",
    "<p title=\"it's\">{}</p>", "<p class='x>{}</p>", "<div = x><p>{}</p></div>", "<article><div class=cookiebar><p>All of this is about cookies that we and others set.</p></div><p>{}</p><ins class=adsbygoogle>Buy</ins><div class='sponsored-content'><p>The best of all the offers is here for you.</p></div></article>",
])
def test_broken_pages_keep_the_article(page):
    assert extraction.main_text(f"<html><body>{page.format(BODY)}") == BODY


def test_pages_of_short_blocks():
    lines = [f"A line of verse, number {i}" for i in range(30)]
    for tag in ("p", "li", "div"):
        page = f"<html><body><nav><a href=x>Home</a></nav>{''.join(f'<{tag}>{x}</{tag}>' for x in lines)}<footer>Rights</footer></body></html>"
        assert extraction.main_text(page) == " ".join(lines)


@pytest.mark.parametrize("name", ["post-comments", "user-comments", "left-sidebar", "reader-comments", "blog_sidebar"])
def test_side_matter_longer_than_the_article(name):
    side = "".join(f"<div><p>{BODY} I say so too, and so do {i} of the others here.</p></div>" for i in range(9))
    for page in (f"<div><p>{BODY}</p></div><div class={name}>{side}</div>", f"<div class={name}>{side}</div><article><p>{BODY}</p></article>"):
        assert extraction.main_text(f"<html><body>{page}</body></html>") == BODY


@pytest.mark.parametrize("page", [
    "<div class='ad-x'>" * 30_000, "".join(f"<div class='ad-x{i}'>" for i in range(30_000)), "<p a" * 30_000 + "'", "<script " * 30_000 + "'", "</div>" * 30_000, "<article>" * 30_000, "<nav><article>" * 15_000, "<b>" * 30_000 + "</p>" * 30_000,
    "<div class='ad-x'><p>word</p>" * 15_000, "<!-- " * 30_000, "<p>" + "<span>" * 30_000 + "<div></div>" * 10_000, "<html " * 30_000, "<p class=\"" * 30_000, "<" * 100_000, "<svg <math " * 30_000,
])
def test_time_is_linear_in_the_page(page):
    def took(text):
        began = time.process_time()
        extraction.main_text(text)
        return time.process_time() - began

    assert took(page) < 8 * took(page[: len(page) // 4]) + 0.5  # four times the page


def made_page(rng):
    """A page and its main text: an article of headings, paragraphs and lists among blocks that are none of it, in some wrapper."""
    sentence = lambda: " ".join(rng.choice("the of and to in is that it for on with as was be by this are from or an river stone window paper garden light".split()) for _ in range(rng.randrange(14, 40))).capitalize() + "."
    links = lambda: "<ul>" + "".join(f"<li><a href=/{i}>{rng.choice(['Home', 'News', 'About us', 'Archive of old things'])}</a></li>" for i in range(rng.randrange(2, 7))) + "</ul>"
    junk = lambda: rng.choice([
        f"<nav>{links()}</nav>", f"<div class='menu main-nav'>{links()}</div>", f"<aside><p>{sentence()}</p></aside>", f"<div class=sidebar><p>{sentence()}</p>{links()}</div>", f"<footer><p>{sentence()}</p></footer>",
        f"<div id='cookie-notice'><p>{sentence()}</p></div>", f"<section class='comments'><p>{sentence()}</p><p>{sentence()}</p></section>", "<form><label>Mail</label><input name=q><button>Go</button></form>",
        f"<script>var a = '<p>{sentence()}</p>';</script>", "<style>p { color: red }</style>", f"<!-- <p>{sentence()}</p> -->", f"<div class=advert><p>{sentence()}</p></div>", f"<div hidden><p>{sentence()}</p></div>",
    ])
    text, body = [], []
    for _ in range(rng.randrange(2, 8)):
        parts = [sentence() for _ in range(rng.randrange(1, 4))]
        kind = rng.randrange(5)
        if kind == 0:
            text.append(f"Heading {rng.randrange(99)}")
            body.append(f"<h2>{text[-1]}</h2>")
        if kind == 1:
            items = [sentence() for _ in range(3)]
            text += items
            body.append("<ul>" + "".join(f"<li>{i}" for i in items) + "</ul>")
        own = " ".join(parts)
        marked = own.replace(" stone ", " <b>stone</b> ", 1).replace(" paper ", ' <a href="/p">paper</a> ', 1).replace(" light ", "\n   light&nbsp;", 1).replace(" and ", " &#97;nd ", 1)
        text.append(own)
        body.append(f"<p class='x'>{marked}</p>")
        if rng.random() < 0.3:
            body.append(junk())
    open_, close = rng.choice([("<article>", "</article>"), ("<main><div class='post'>", "</div></main>"), ("<div class='content'><article class='hentry'>", "</article></div>"), ("<div class='page no-sidebar'><article>", "</article></div>")])
    around = lambda: "".join(junk() for _ in range(rng.randrange(3)))
    return f"<!doctype html><html lang=en><head><title>T</title></head><body>{around()}<header>{links()}</header>{open_}{''.join(body)}{close}{around()}</body></html>", " ".join(text)


def test_whole_pages(spark):
    """The query on made pages, whose main text is known from how they were made."""
    rng = random.Random(8)
    made = [(i, f"http://x/{i}", *made_page(rng)) for i in range(300)]
    pages = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string").repartition(3)
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extraction.extract(pages).collect()}
    wrong = [i for i, url, _, text in made if got[i] != (url, text, len(text))]
    assert not wrong, (made[wrong[0]][2], got[wrong[0]][1], made[wrong[0]][3])


@pytest.mark.parametrize("text", ["これは日本語で書かれた記事の本文であり、" * 3, "Tämä on suomenkielinen teksti, jossa kerrotaan kaupungin uudesta kirjastosta, sen avajaisista sekä rakentamisesta."])
def test_main_text_without_stop_words(text):
    assert extraction.main_text(f"<html><body><div class=menu>{text}</div><div><p>{text}</p></div></body></html>") == text


# ---- 9 ----
def test_token_counts(spark, docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    odd = ["a  b", "a   b\n\n\nc", "x<|endoftext|> y", "tab\there  ", "don't. stop.. now., ok", " x \n y", "trail \n", "\x01odd", "é.á,"]
    df = docs.select("doc_id", "text", "h", "row").unionByName(spark.createDataFrame([(600 + i, t, "h", 1) for i, t in enumerate(odd)] + [(None, "no id", "h", 1)], "doc_id long, text string, h string, row long"))
    tok = Tokenizer.from_file(path)
    want = Counter((d, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for d, t in rows(df, "doc_id", "text"))
    got = tokens.token_counts(df, path).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(df.limit(0), path).count() == 0


def test_white_space_before_a_special_string():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    encode = Tokenizer.from_file(path).encode
    for text in ("a\n\n<|endoftext|>", "a \n<|endoftext|>b\n\n<|endoftext|>", "a\n\nb <|endoftext|>", "x<|endoftext|> y."):
        assert sum(len(encode(p, add_special_tokens=False)) for p in tokens.pre_tokens(text, path)) == len(encode(text, add_special_tokens=False)), text


# ---- 10 ----
def scored(df, **options):
    return suffix_tree.scores(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, **options).collect()


@pytest.mark.parametrize("most", [suffix_tree.MOST, 3])
def test_scores(docs, most):  # with 3, none but the most frequent words are frequent
    pairs = rows(docs, "doc_id", "text")
    words = lambda t: (t or "").encode().lower().split()
    train = [words(t) for d, t in pairs if zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = scored(docs, most=most)
    assert len(got) == len(pairs)
    text = dict(pairs)
    for r in got:
        w = words(text[r.doc_id])
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w) + 1, sum(x in c for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def brute_model(pairs, n_top, rare):
    """The suffix tree by its definition, on dictionaries: (the distribution's log of the next word or end after words, the words in training, classes)."""
    words = lambda t: (t or "").encode().lower().split()
    train = [words(t) for d, t in pairs if zlib.crc32(str(d).encode()) % 7 != 2]
    n = Counter(w for ws in train for w in ws)
    code = dict(zip(n, suffix_tree.word_hashes(list(n)).view(np.int64).tolist(), strict=True)) if n else {}
    top = sorted(sorted(n, key=lambda w: (-n[w], code[w]))[:n_top], key=code.get)
    kind = lambda w: END if w is None else top.index(w) if w in top else suffix_tree.letter_class(w)
    END = suffix_tree.END
    frequent = lambda w: w in top or n[w] >= rare
    size = suffix_tree.SIZE

    def last(x, y):
        """The rare word before, or the rare and the frequent one."""
        return None if y is None else (y,) if not frequent(y) else (x, y) if x is not None and not frequent(x) else None

    zero, one, two, follow = Counter(), defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for ws in train:
        path = [None, None, *ws, None]
        for x, y, z in zip(path, path[1:], path[2:], strict=False):
            c = kind(z)
            zero[c] += 1
            one[kind(y)][c] += 1
            two[kind(x), kind(y)][c] += 1
            if context := last(x, y):
                follow[context][("w", z) if z is None or frequent(z) else ("c", c)] += 1

    def kept(counts, parent):
        total = sum(counts.values())
        return sum(v * math.log(v * sum(parent.values()) / (total * parent[c])) for c, v in counts.items()) > len(counts) * math.log(total) / 2

    def mixed(counts, c, below):
        return (counts[c] + len(counts) * below) / (sum(counts.values()) + len(counts))

    root = lambda c: mixed(zero, c, 1 / size) if zero else 1 / size
    p1 = lambda b, c: mixed(one[b], c, root(c)) if b in one and kept(one[b], zero) else root(c)
    p2 = lambda a, b, c: mixed(two[a, b], c, p1(b, c)) if (a, b) in two and kept(two[a, b], one[b]) else p1(b, c)
    own = defaultdict(list)
    for w in n:
        if w not in top:
            own[kind(w)].append(w)

    def share(w):
        """Of its class's probability: a frequent word's part, or that of all rare words; and a rare word's part of that."""
        k = kind(w)
        if w is None or w in top:
            return 1.0, 1.0
        members = own[k]
        whole = sum(n[x] for x in members) + len(members)
        cold = whole - sum(n[x] for x in members if frequent(x))
        if frequent(w):
            return n[w] / whole, 1.0
        return (cold / whole, (n[w] or len(members)) / cold) if members else (1.0, 1.0)

    def rare_state(h):
        counts = follow.get(h)
        if not counts or sum(counts.values()) < 2:
            return None
        total, kinds = sum(counts.values()), len(counts)
        gain = 0.0
        for (tag, z), v in counts.items():
            c = z if tag == "c" else kind(z)
            below = (p1(kind(h[0]), c) if len(h) == 1 else p2(kind(h[0]), kind(h[1]), c)) * (share(z)[0] if tag == "w" else share(next(x for x in own[z] if not frequent(x)))[0])
            gain += v * (math.log((v - 1 + kinds * below) / (total - 1 + kinds)) - math.log(below))
        return counts if gain > kinds * math.log(total) / 2 else None

    states = {h: rare_state(h) for h in follow}

    def log_p(x, y, z):
        """After the words x and y (None: an end)."""
        c, (first, second) = kind(z), share(z)
        state = states.get(last(x, y))
        if state:
            below = (p2(kind(x), kind(y), c) if frequent(y) else p1(kind(y), c)) * first
            name = ("w", z) if z is None or frequent(z) else ("c", c)
            return math.log(mixed(state, name, below)) + math.log(second)
        return math.log(p2(kind(x), kind(y), c) * first) + math.log(second)

    return log_p, n, states


@pytest.mark.parametrize("n_top, rare, most", [(191, 16, suffix_tree.MOST), (4, 4, 1 << 20), (0, 10**9, 1 << 20), (4, 4, 200)])
def test_scores_against_brute_force(spark, docs, monkeypatch, n_top, rare, most):
    """Frequent is who has `rare` occurrences and one in `most` of all: the model by count alone."""
    monkeypatch.setattr(suffix_tree, "TOP", n_top)
    monkeypatch.setattr(suffix_tree, "RARE", rare)
    twice = [(700 + i, prose(800 + i // 2, 30)) for i in range(8)]
    df = docs.where("doc_id <> 305").select("doc_id", "text").unionByName(spark.createDataFrame(twice, "doc_id long, text string"))
    pairs = rows(df, "doc_id", "text")
    n = brute_model(pairs, n_top, rare)[1]
    least = max(rare, -(-sum(n.values()) // most))
    assert (least > rare) == (most == 200) and sum(v >= least for v in n.values()) <= most
    log_p, n, states = brute_model(pairs, n_top, least)
    assert n_top == 191 or most == 200 or {len(h) for h, c in states.items() if c} == ({1, 2} if rare < 100 else {1})
    text = dict(pairs)
    got = scored(df, most=most)
    assert len(got) == len(pairs)
    for r in got:
        path = [None, None, *(text[r.doc_id] or "").encode().lower().split(), None]
        want = sum(log_p(*t) for t in zip(path, path[1:], path[2:], strict=False)) / math.log(10)
        assert math.isclose(r.score, want, abs_tol=r.n_tokens * suffix_tree.STEP / 3), (r, want)
    # the distribution over known words, the end and one unknown word for each class
    after = [(None, None), (None, max(n)), *[(None, *h)[-2:] for h, c in states.items() if c][:4]]
    unknown = {}
    for w in [bytes([c]) * k for c in range(33, 255) for k in (1, 9)]:
        if w not in n and not bytes([w[0]]).isspace():
            unknown.setdefault(suffix_tree.letter_class(w), w)
    assert len(unknown) == 64
    for x, y in after if n_top == 191 else []:  # fewer classes leave their share of the uniform distribution unused
        assert math.isclose(sum(math.exp(log_p(x, y, z)) for z in [*n, None, *unknown.values()]), 1, rel_tol=1e-9)


def every_word_model(pairs, n_top, rare):
    """brute_model with every frequent word a context of the next class: (the log of the next word after two, hashes of its retained words, of its retained pairs)."""
    log_p, n, _ = brute_model(pairs, n_top, rare)
    code = dict(zip(n, suffix_tree.word_hashes(list(n)).view(np.int64).tolist(), strict=True))
    top = set(sorted(n, key=lambda w: (-n[w], code[w]))[:n_top])
    frequent = lambda w: w in top or n[w] >= rare
    kind = lambda w: w if w is None or w in top else suffix_tree.letter_class(w)
    unknown = {}
    for w in [bytes([c]) * k for c in range(33, 255) for k in (1, 9)]:
        if w not in n and not bytes([w[0]]).isspace():
            unknown.setdefault(suffix_tree.letter_class(w), w)
    never = b"\xff"  # its class is in no text
    assert not any(suffix_tree.letter_class(w) == suffix_tree.letter_class(never) for w in n)
    stand = lambda w: w if w is None or w in top else unknown[kind(w)]
    members = defaultdict(list)
    for w in n:
        if w not in top:
            members[kind(w)].append(w)

    def part(w):
        """Of its class."""
        own = members[kind(w)] if w is not None and w not in top else None
        return (n[w] or len(own)) / (sum(n[x] for x in own) + len(own)) if own else 1.0

    def second(w):
        """A rare word's part of its class's rare ones."""
        own = members[kind(w)] if w is not None and not frequent(w) else None
        return (n[w] or len(own)) / (sum(n[x] for x in own if not frequent(x)) + len(own)) if own else 1.0

    single, pair = defaultdict(Counter), defaultdict(Counter)
    some = {}
    for d, t in pairs:
        ws = (t or "").encode().lower().split()
        for x, y, z in zip([None, *ws], ws, [*ws[1:], None], strict=False) if zlib.crc32(str(d).encode()) % 7 != 2 else []:
            if frequent(y):
                some[kind(z)] = z
                single[y][kind(z)] += 1
                if x is not None and not frequent(x):
                    name = z if z is None or frequent(z) else ("c", kind(z))
                    some[name] = z
                    pair[x, y][name] += 1

    def retained(counts, below):
        total, kinds = sum(counts.values()), len(counts)
        gain = sum(v * (math.log((v - 1 + kinds * below(c)) / (total - 1 + kinds)) - math.log(below(c))) for c, v in counts.items())
        return total > 1 and gain > kinds * math.log(total) / 2

    mixed = lambda counts, c, below: (counts[c] + len(counts) * below) / (sum(counts.values()) + len(counts))
    one = lambda y, z: math.exp(log_p(never, stand(y), z)) / part(z)
    kept = {y for y, counts in single.items() if y not in top and retained(counts, lambda c, y=y: one(y, some[c]))}
    lower = lambda x, y, z: mixed(single[y], kind(z), one(y, z)) * part(z) if y in kept else math.exp(log_p(stand(x), stand(y), z))
    both = {h for h, counts in pair.items() if retained(counts, lambda c, h=h: lower(*h, some[c]) / second(some[c]))}

    def whole(x, y, z):
        if y is None or not frequent(y):
            return log_p(x, y, z)
        if (x, y) in both:
            return math.log(mixed(pair[x, y], z if z is None or frequent(z) else ("c", kind(z)), lower(x, y, z) / second(z)) * second(z))
        return math.log(lower(x, y, z))

    return whole, kept, both


def test_every_word_is_a_context(spark, docs, monkeypatch):
    """Also frequent words that are no class of their own; and what is broadcast of them changes no score."""
    monkeypatch.setattr(suffix_tree, "TOP", 4)
    monkeypatch.setattr(suffix_tree, "RARE", 4)
    rng = random.Random(5)
    # a frequent word tells the next one, which its class doesn't; after a rare word too
    made = [(800 + i, " ".join(rng.choice(("bold red", "cold blue", "told green", f"mold{i % 9} sold gray")) for _ in range(60))) for i in range(12)]
    df = docs.where("doc_id <> 305").select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    pairs = rows(df, "doc_id", "text")
    whole, kept, both = every_word_model(pairs, 4, 4)
    assert kept and both
    text = dict(pairs)
    got = scored(df)
    assert len(got) == len(pairs)
    for r in got:
        path = [None, None, *(text[r.doc_id] or "").encode().lower().split(), None]
        want = sum(whole(*t) for t in zip(path, path[1:], path[2:], strict=False)) / math.log(10)
        assert math.isclose(r.score, want, abs_tol=r.n_tokens * suffix_tree.STEP / 3), (r, want)
    key = lambda r: (r.doc_id, r.n_tokens)
    for bounds in ({"hold": 3}, {"entries": 9}, {"hold": 20, "entries": 30}, {"hold": 0}):
        for r, other in zip(sorted(got, key=key), sorted(scored(df, **bounds), key=key), strict=True):
            assert r[:5] == other[:5] and math.isclose(r.base_score, other.base_score, rel_tol=1e-9) and math.isclose(r.score, other.score, rel_tol=1e-9), (bounds, r, other)


def test_documents_that_occur_twice_score_apart(spark):
    """A model of the whole corpus tells a training document that occurs twice from those that occur once."""
    rng = random.Random(4)
    made = lambda seed: " ".join(f"w{rng.randrange(30)}" if rng.random() < 0.7 else f"r{rng.randrange(10**6)}x" for _ in range(60))
    texts = [made(i) for i in range(60)]
    df = spark.createDataFrame([(i, texts[i // 2] if i < 20 else texts[i]) for i in range(60) if zlib.crc32(str(i).encode()) % 7 != 2], "doc_id long, text string")
    got = {r.doc_id: r.score / r.n_tokens for r in scored(df)}
    both = {i for i in got if i < 20 and i ^ 1 in got}
    assert min(got[i] for i in both) > max(v for i, v in got.items() if i >= 20)


def test_scores_of_nothing(spark, empty):
    assert scored(empty.select("doc_id", "text")) == []
    alone = spark.createDataFrame([(None, "x y"), (None, None)], "doc_id long, text string")
    assert [r.held_out for r in scored(alone)] == [False, False]


# ---- pipeline ----
def by_sql(spark, docs, statement, folder):
    """DuckDB's rows of a statement over a stage's documents."""
    import duckdb

    docs.coalesce(1).write.parquet(folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/*.parquet'")
    return con.execute(statement).fetchdf()


def leaking(docs, items):
    """Ids of documents of which some item's tiles, by their definition, cover half: sure ones, and those too long to tell by it."""
    sure, open_ = set(), set()
    own = [decontam.tokens(t or "") for t in items]
    grams = [{tuple(t[i : i + decontam.SEED]) for i in range(len(t) - decontam.SEED + 1)} for t in own]
    for d, text in docs:
        words = decontam.tokens(text or "")
        here = {tuple(words[i : i + decontam.SEED]) for i in range(len(words) - decontam.SEED + 1)}
        for item, seeds in zip(own, grams, strict=True):
            shared = seeds & here
            touched = {i + k for i in range(len(item) - decontam.SEED + 1) if tuple(item[i : i + decontam.SEED]) in shared for k in range(decontam.SEED)}
            if 2 * len(touched) < len(item) or not touched:
                continue
            if len(words) > 600:
                open_.add(d)
            elif 2 * sum(n for *_, n in defined_tiles(item, words, decontam.SEED)) >= len(item):
                sure.add(d)
    return sure, open_ - sure


def test_pipeline(spark, tmp_path):
    """Every stage on what the one before kept: quality and mix against SQL, near duplicates and leaks by definition."""
    import corpus_pipeline
    from tests.conftest import SF
    from triplake.llm import sql

    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == table(spark, SF, "documents").columns
        got = Counter(r[0] for r in rows(out, "doc_id"))
        if name == "quality":
            want = by_sql(spark, docs, sql.QUALITY, str(tmp_path / name))
            assert got == Counter(want[want.kept].doc_id.tolist()) and 0 < len(got) < len(want)
        elif name == "near_dedup":
            _, comp = brute_components(rows(docs, "doc_id", "text"), 5)
            assert got == Counter(d for d, c in comp.items() if d == c)
        elif name == "decontaminate":
            items = [t for _, t in rows(table(spark, SF, "benchmark"), "item_id", "text")]
            sure, open_ = leaking(rows(docs, "doc_id", "text"), items)
            gone = {d for d, _ in rows(docs, "doc_id", "text")} - set(got)
            assert sure <= gone <= sure | open_ and sure
            flat = {d: " ".join(map(bytes.decode, decontam.tokens(t))) for d, t in rows(docs, "doc_id", "text")}
            assert not {d for d in got if any(" ".join(map(bytes.decode, decontam.tokens(i))) in flat[d] for i in items)}
        elif name == "mix":
            want = by_sql(spark, docs, sql.MIX, str(tmp_path / name))
            copies = {int(r.doc_id): int(r.taken) // int(r["size"]) + (2 * (int(r.taken) % int(r["size"])) >= int(r["size"])) for _, r in want.iterrows()}
            assert got == Counter({d: n for d, n in copies.items() if n}) and len(set(copies.values())) > 1
        docs = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r.doc_id for r in last) == Counter(r[0] for r in rows(docs, "doc_id"))
    loads = Counter()
    for r in last:
        loads[r.shard] += r["size"]
    groups = Counter(r.text for r in docs.collect())
    assert max(loads.values()) - min(loads.values()) <= 2 * max(n * (len(t.encode()) + 8) for t, n in groups.items())


def test_pipeline_stages_on_odd_tables(spark, clashing):
    """Null, equal and repeated ids, null, empty and long texts, and columns of the operators' own names: no stage fails or loses a clean document."""
    import corpus_pipeline
    from tests.conftest import SF

    long = spark.createDataFrame([(None, prose(77, 30_000), "a", *["x"] * len(CLASHING))], clashing.schema)
    docs = clashing.unionByName(long)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        out = stage(spark, docs, SF)
        if name == "shard":
            assert out.count() == docs.count()
        else:
            assert out.columns == docs.columns
            assert not {tuple(r) for r in out.collect()} - {tuple(r) for r in docs.collect()}
            kept = {r.text for r in out.collect()}
            assert all(prose(s, 60) in kept for s in (3000, 3005, 3211)) and prose(77, 30_000) in kept or name == "mix"


def test_operators_on_long_and_odd_tables(spark, clashing):
    """Every query's operator on the same table: a row for each document, whatever its columns are called."""
    n = clashing.count()
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    public = pytest.importorskip("public_tokenizers")
    found = [sharding.shard_documents(clashing, 3), lines.line_dedup(clashing), minhash.near_duplicates(clashing, 2), mixing.mix(clashing), quality.ledger(clashing), tokens.token_counts(clashing, public.path("byte_bpe_50k.json")), suffix_tree.scores(clashing, held)]
    assert [df.count() for df in found] == [n] * len(found)
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"), "digest", "size", "kept")
    assert extraction.extract(pages).count() == warc.round_trip(pages).count() == n


def test_texts_reach_python_few_at_a_time(spark, docs, monkeypatch):
    """In every pass of op10 over the texts, and not beyond it."""
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", {}
    before, written = spark.conf.get(name), suffix_tree.written
    monkeypatch.setattr(suffix_tree, "written", lambda df, called: seen.update({called: spark.conf.get(name)}) or written(df, called))
    assert len(scored(docs)) == docs.count()
    assert seen == dict.fromkeys(["word-counts", "class-counts", "word-states", "scores"], "512") and spark.conf.get(name) == before
    with shared.few_at_once(spark, 100):
        sizes = shared.written(spark.range(0, 1050, 1, 1).mapInPandas(lambda batches: (b.head(1).assign(id=len(b)) for b in batches), "id long"), "sizes")
    assert sorted(r.id for r in sizes.collect()) == [50] + [100] * 10
