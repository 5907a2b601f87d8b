"""Near-duplicates by MinHash with tensored banding (operator 4).

Two collections of COLUMNS short signatures are computed, each signature of ROWS minima. A table's key combines one signature
of the first collection with one of the second, so COLUMNS ** 2 tables come from 2 * COLUMNS * ROWS minima. A signature that no other document has can't be
part of a shared key and is left out before the combination; that loses nothing.

Two sets of similarity s share a key with probability (1 - (1 - s ** ROWS) ** COLUMNS) ** 2: for the defaults 0.9996 at 0.8 (more above),
0.41 at 0.5 and 0.015 at 0.3, so that texts of one template seldom meet.

Documents with equal sets are one class and the tables hold classes. Candidates are compared on their full shingle sets,
made again from the whole texts. In a bucket, members are first compared with one leader (in the second round, the member with most
links), whose text goes once to each part of its members; members that are then connected need no more comparison. Members of other components are
then compared with those members of the buckets of the same main component that share a bucket with them, block by block inside the tasks, so that no
pair becomes a row and no block grows with a group or with its texts. The blocks are made of signatures first; texts go only to those in which they have
a candidate.

Ids are integers of any value. Null texts and texts without words have the empty set and are linked with nothing. Repeated rows are copies. Rows that
share a doc_id but not the text are linked row by row; a link to the doc_id is one to all of them. A row with a null doc_id links nothing and has a null
component. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplake.llm.bitmap import possible
from triplake.llm.components import joined_components
from triplake.llm.mixing import digest
from triplake.llm.prefix import prefix_sums
from triplake.llm.shared import aside, clean, mixed, runs, word_hashes, written

COLUMNS, ROWS = 16, 4
SIMILARITY = 80
#: Rounds in which members are compared with leaders only; the last round is of blocks.
STAR_ROUNDS = 2
#: Members and shingles on one side of a block, and members of a leader in one part.
BLOCK, VOLUME, MEMBERS = 256, 1 << 20, 1 << 12


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(texts: list[str], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; a text of fewer words is one shingle."""
    own = [words_of(t) for t in texts]
    hashes = mixed(word_hashes([w for ws in own for w in ws]))
    out, at = [], 0
    for ws in own:
        h = hashes[at : at + len(ws)]
        at += len(ws)
        n = len(h) - width + 1
        if len(h) and n < 1:
            h, n, size = h, 1, len(h)
        else:
            size = width
        total = np.full(max(n, 0) if len(h) else 0, size, np.uint64)
        for k in range(size if len(h) else 0):
            total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
        out.append(np.unique(total))
    return out


def _minima(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The least value of each seeded hash over the set, in slices of bounded size."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1 << 12):
        x = shingles[a : a + (1 << 12)]
        y = (x[None, :] ^ seeds[:, 0:1]) * seeds[:, 1:2]
        y ^= y >> np.uint64(32)
        least = np.minimum(least, (y * seeds[:, 2:3]).min(axis=1))
    return least


def signatures(docs: DataFrame, width: int, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """docs(id, known, text) to id, known, n_shingles, set_a, set_b (128 bits of the whole set) and left, right: the two collections."""
    seeds = mixed(np.arange(1, 2 * columns * rows * 3 + 1, dtype=np.uint64)).reshape(-1, 3)
    seeds[:, 1:] |= np.uint64(1)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, ids, known = clean(pdf["text"]), pdf["id"].to_numpy(), pdf["known"].to_numpy()
            for a, b in runs(texts):
                sets = shingle_hashes(texts[a:b], width)
                n = np.array([len(s) for s in sets], np.int64)
                hashes = np.array([_minima(s, seeds) if len(s) else np.zeros(len(seeds), np.uint64) for s in sets]).reshape(b - a, -1)
                bands = np.zeros((b - a, 2 * columns), np.uint64)
                for k in range(rows):
                    bands = mixed(bands * np.uint64(31) + hashes[:, k::rows])
                bands = bands.view(np.int64)
                yield pd.DataFrame(
                    {
                        "id": ids[a:b], "known": known[a:b], "n_shingles": n,
                        "set_a": np.array([s.sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                        "set_b": np.array([mixed(s).sum(dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64),
                        "left": list(bands[:, :columns]), "right": list(bands[:, columns:]),
                    }
                )

    schema = "id long, known boolean, n_shingles long, set_a long, set_b long, left array<long>, right array<long>"
    return docs.select("id", "known", "text").mapInPandas(each, schema)


def by_column(classes: DataFrame, *own: str) -> DataFrame:
    """The classes' columns `own` with side and h of each of their signatures, 2 * COLUMNS rows a class; equal signatures of one column have the same h."""
    one = lambda side: F.transform(side, lambda v, i: F.struct(F.lit(side).alias("side"), i.alias("i"), v.alias("v")))
    rows = classes.select(*own, F.explode(F.concat(one("left"), one("right"))).alias("c"))
    return rows.select(*own, "c.side", F.xxhash64("c.side", "c.i", "c.v").alias("h"))


def buckets(classes: DataFrame) -> DataFrame:
    """key, id, n_shingles of every bucket of two or more classes; buckets with the same members are kept once."""
    columns = by_column(classes, "id", "n_shingles")
    shared = columns.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    held = columns.join(shared, "h", "left_semi").groupBy("id", "n_shingles").agg(  # at most 2 * COLUMNS rows a class
        F.collect_list(F.when(F.col("side") == "left", F.col("h"))).alias("left"), F.collect_list(F.when(F.col("side") == "right", F.col("h"))).alias("right")
    )
    tables = held.withColumn("l", F.explode("left")).select("id", "n_shingles", "l", F.explode("right").alias("r"))
    tables = written(tables.select("id", "n_shingles", F.xxhash64("l", "r").alias("key")), "tables")
    spread = F.xxhash64("id")
    full = tables.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(spread).alias("x"), F.bit_xor(F.xxhash64(spread, "id")).alias("y")).where("n > 1")
    once = full.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return written(tables.join(once, "key", "left_semi"), "buckets")


def compare(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """a, b, shared, joint (sizes of intersection and union of the full shingle sets) of pairs(leader, id) of ids of docs(id, text).

    A leader's members are dealt in parts of about MEMBERS; its text goes once to each part, ahead of theirs, and is cut once there.
    """
    pairs = written(pairs, "pairs")
    parts = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")), "parts")
    members = pairs.join(parts, "leader").select("leader", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), F.lit(1).alias("turn"), "id")
    leaders = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("turn"), F.col("leader").alias("id"))
    ids = pairs.select("id").unionByName(parts.select(F.col("leader").alias("id")))
    texts = possible(ids, "id")(docs.select("id", "text")).where("_possible").select("id", "text")
    ready = leaders.unionByName(members).join(texts, "id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own = None, {}  # the leader and part at hand, and the leader's texts (more than one where texts share the id) with their sets
        for pdf in batches:
            texts, keys = clean(pdf["text"]), pdf[["leader", "part", "turn", "id"]].to_numpy().tolist()
            found = []
            for x, y in runs(texts):
                for text, (leader, part, turn, one), cut in zip(texts[x:y], keys[x:y], shingle_hashes(texts[x:y], width), strict=True):
                    if (leader, part) != held:
                        held, own = (leader, part), {}
                    if not turn:
                        own[text] = cut
                        continue
                    for other in own.values():
                        shared = len(np.intersect1d(other, cut, assume_unique=True))
                        found.append((min(leader, one), max(leader, one), shared, len(other) + len(cut) - shared))
            yield pd.DataFrame(found, columns=["a", "b", "shared", "joint"], dtype="int64")

    order = ["leader", "part", "turn"]
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ready.repartition(many, "leader", "part").sortWithinPartitions(*order)
    return dealt.mapInPandas(each, "a long, b long, shared long, joint long").distinct()


def compare_blocks(groups: DataFrame, classes: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """a, b: links that join components within groups(grp, id, n_shingles, component, main), where main is the group's main component.

    Members of other components are compared with the members of their group that share a bucket with them. Groups of more than BLOCK
    members or VOLUME shingles are dealt by size class (sets of classes that don't touch are too unequal to be linked), then in blocks of about BLOCK
    by BLOCK, of fewer where sets are large: pairs are never rows, signatures go to the blocks of three classes, texts to those of them where
    signatures meet, and one link for each text and component comes out.
    """
    ratio = 101 / similarity
    kind = F.floor(F.log("n_shingles") / float(np.log(ratio))).cast("int")
    held = groups.withColumn("kind", kind).withColumn("spread", F.xxhash64("id"))
    rest = F.sum((F.col("component") != F.col("main")).cast("int"))
    sizes = written(held.groupBy("grp", "kind").agg(F.count("*").alias("n_all"), rest.alias("n_rest"), F.sum("n_shingles").alias("volume")), "group-sizes")
    whole = sizes.groupBy("grp").agg(F.sum("n_all").alias("total"), F.sum("volume").alias("volume"))
    small = (F.col("total") <= BLOCK) & (F.col("volume") <= VOLUME)
    dealt_by = sizes.drop("volume").join(whole, "grp").withColumn("class", F.when(small, 0).otherwise(F.col("kind")))
    own = dealt_by.groupBy("grp", "class").agg(F.sum("n_all").alias("n_all"), F.sum("n_rest").alias("n_rest"))
    other = own.select("grp", F.col("class").alias("o"), F.col("n_all").alias("o_all"), F.col("n_rest").alias("o_rest"))
    # at most three rows for each group and size class
    pairs = own.join(other, "grp").where("abs(class - o) <= 1 and (n_rest > 0 or o_rest > 0)")
    met = written(dealt_by.select("grp", "kind", "class").join(pairs, ["grp", "class"]), "group-classes")
    most = lambda c: F.greatest(F.lit(1.0), F.least(F.lit(float(BLOCK)), VOLUME / F.pow(F.lit(ratio), F.col(c) + 1)))
    parts = lambda n, c: F.ceil(F.col(n) / most(c)).cast("int")
    place = lambda n, c: F.pmod("spread", F.greatest(F.lit(1), parts(n, c))).cast("int")
    each = lambda n, c: F.explode(F.sequence(F.lit(0), parts(n, c) - 1))
    dealt = held.join(met, ["grp", "kind"])
    block = ["grp", "k", "i", "l", "j"]
    left = dealt.where("component <> main").select("grp", F.col("class").alias("k"), place("n_rest", "class").alias("i"), F.col("o").alias("l"), each("o_all", "o").alias("j"), "id", "component", F.lit(True).alias("is_left"))
    right = dealt.where("o_rest > 0").select("grp", F.col("o").alias("k"), each("o_rest", "o").alias("i"), F.col("class").alias("l"), place("n_all", "class").alias("j"), "id", "component", F.lit(False).alias("is_left"))
    short = lambda c: F.transform(c, lambda v: v.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias(c)
    ready = left.unionByName(right).join(classes.select("id", "n_shingles", short("left"), short("right")), "id")
    names = ["id", "component", "is_left", "n_shingles", "left", "right"]

    def candidates(pdf: pd.DataFrame) -> dict[int, list[int]]:
        """Places of the left members of one block, each with those of the right ones that share a bucket with it and can be linked."""
        is_left, n, comps = (pdf[c].to_numpy() for c in ("is_left", "n_shingles", "component"))
        one, two = np.stack(pdf["left"]), np.stack(pdf["right"])
        rights = np.flatnonzero(~is_left)
        found = {}
        for x in np.flatnonzero(is_left):
            ys = rights[(comps[rights] != comps[x]) & (100 * np.minimum(n[rights], n[x]) >= similarity * np.maximum(n[rights], n[x]))]
            ys = ys[(one[ys] == one[x]).any(axis=1) & (two[ys] == two[x]).any(axis=1)]
            if len(ys):
                found[int(x)] = ys.tolist()
        return found

    def useful(pdf: pd.DataFrame) -> pd.DataFrame:
        found = candidates(pdf)
        return pdf.iloc[sorted({*found, *(y for ys in found.values() for y in ys)})]

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        """One link for each left member of a block and component that it is linked with."""
        found = candidates(pdf)
        ids, comps, texts = pdf["id"].to_numpy(), pdf["component"].to_numpy(), clean(pdf["text"])
        sets = [cut for x, y in runs(texts) for cut in shingle_hashes(texts[x:y], width)]
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        at = np.split(places, np.cumsum([len(cut) for cut in sets])[:-1])
        marks = np.zeros(len(places), bool)
        out = []
        for x, ys in found.items():
            marks[at[x]] = True
            met = set()
            for y in ys:
                shared = int(np.count_nonzero(marks[at[y]])) if comps[y] not in met else 0
                if shared and 100 * shared >= similarity * (len(at[x]) + len(at[y]) - shared):
                    met.add(comps[y])
                    out.append((ids[x], ids[y]))
            marks[at[x]] = False
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    def by_block(told):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = None  # the last block of a batch may go on in the next
            for pdf in batches:
                pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
                key = pdf[block].to_numpy()
                starts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1])
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    yield told(pdf.iloc[x:y])
                held = pdf.iloc[starts[-1] :].reset_index(drop=True)
            if held is not None and len(held):
                yield told(held)

        return each

    # a fixed number of partitions: small rows, much work each
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.repartition(many, *block).sortWithinPartitions(*block)
    schema = "grp long, k int, i int, l int, j int, id long, component long, is_left boolean, n_shingles long, left array<int>, right array<int>"
    met = written(dealt(ready).select(*block, *names).mapInPandas(by_block(useful), schema), "candidates")
    texts = possible(met.select("id"), "id")(docs.select("id", "text")).where("_possible").select("id", "text")
    return dealt(met.join(texts, "id")).mapInPandas(by_block(linked), "a long, b long")


def within_reach(outside: DataFrame, found: DataFrame | None, classes: DataFrame) -> DataFrame:
    """grp, id, n_shingles, component of the members of the main component of each group of outside(grp, id) that may share a bucket with one of those.

    A bucket has a signature of either collection, so they share one of each with some of them. A member has 2 * COLUMNS rows here, once for
    its component, and not one for each of its buckets that one from outside is in, of which there are up to COLUMNS ** 2.
    """
    mains = outside.select(F.col("grp").alias("component")).distinct()
    ids = mains.select(F.col("component").alias("id"), "component")  # a component of one class isn't in found
    if found is not None:
        ids = ids.unionByName(found.join(mains, "component", "left_semi").select("id", "component")).distinct()
    ids = written(ids, "mains")
    signed = possible(ids.select("id").unionByName(outside.select("id")), "id")(classes).where("_possible").select("id", "n_shingles", "left", "right")
    asked = by_column(outside.select("grp", "id").join(signed, "id"), "grp").select(F.col("grp").alias("component"), "h").distinct()
    met = by_column(ids.join(signed, "id"), "component", "id", "n_shingles").join(asked, ["component", "h"], "left_semi")
    both = met.groupBy("component", "id", "n_shingles").agg(F.count_distinct("side").alias("sides")).where("sides = 2")
    return both.select(F.col("component").alias("grp"), "id", "n_shingles", "component")


def links(classes: DataFrame, docs: DataFrame, width: int, similarity: int) -> DataFrame:
    """id, component of the classes(id, n_shingles, left, right) that are linked with another; texts from docs(id, text)."""
    members = buckets(classes)
    linked = F.expr(f"100 * shared >= {similarity} * joint")
    near = f"100 * least(n_shingles, m_shingles) >= {similarity} * greatest(n_shingles, m_shingles)"
    checked = found = None  # pairs compared so far; id, component
    for turn in range(STAR_ROUNDS + 1):
        if found is None:
            held = members.select("*", F.col("id").alias("component"), F.lit(0).alias("degree"))
        else:
            degree = checked.where(linked).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
            held = members.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        best = F.max(F.struct(F.col("degree"), F.bitwise_not("id").alias("least"), F.col("component").alias("m_component"), F.col("n_shingles").alias("m_shingles"))).alias("best")
        # buckets that still hold more than one component
        leaders = held.groupBy("key").agg(best, F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 <> c2")
        leaders = written(leaders.select("key", F.bitwise_not("best.least").alias("leader"), "best.m_component", "best.m_shingles"), "leaders")  # so that the join on a hot key can be split
        met = held.join(leaders, "key")
        if turn == STAR_ROUNDS:
            outside = met.where("component <> m_component").select(F.col("m_component").alias("grp"), "id", "n_shingles", "component").distinct()
            outside = written(outside, "outside")
            groups = outside.unionByName(within_reach(outside, found, classes)).withColumn("main", F.col("grp"))
            rest = written(compare_blocks(written(groups, "groups"), classes, docs, width, similarity), "links")
            return joined_components(found, rest)
        pairs = met.where("component <> m_component").where(near).groupBy(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).agg(F.min("leader").alias("leader"))
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        member = F.when(F.col("a") == F.col("leader"), F.col("b")).otherwise(F.col("a"))
        told = written(compare(pairs.select("leader", member.alias("id")), docs, width), "compared")
        checked = told if checked is None else checked.unionByName(told)
        found = joined_components(found, told.where(linked).select("a", "b"))


def near_duplicates(docs: DataFrame, width: int, similarity: int = SIMILARITY, columns: int = COLUMNS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs(doc_id, text)."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.col("doc_id").isNotNull().alias("known"), "text")
    told = written(signatures(own, width, columns, rows), "signatures")
    real = told.where("known and n_shingles > 0")
    same = ["n_shingles", "set_a", "set_b"]
    classes = written(real.groupBy(*same).agg(F.min("id").alias("id"), F.first("left").alias("left"), F.first("right").alias("right")), "classes")
    found = links(classes, own.where("known"), width, similarity)
    root = classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    out = told.drop("left", "right").join(root, same, "left")
    component = F.when(F.col("known"), F.coalesce("component_id", "id"))
    return out.select(F.when(F.col("known"), F.col("id")).alias("doc_id"), "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def free_numbers(keys: DataFrame, many: int) -> int:
    """The first of `many` numbers in a row that no row of keys(_key) holds: after the last, else before the first, else between."""
    first, last = keys.agg(F.min("_key"), F.max("_key")).first()
    low, high = -(1 << 63), (1 << 63) - many
    for start in (last + 1, first - many):
        if low <= start <= high:
            return start
    between = [k << 56 for k in range(-127, 128)]
    used = keys.agg(*[F.max(F.col("_key").between(k, k + many - 1)) for k in between]).first()
    return next(k for k, taken in zip(between, used, strict=True) if not taken)


def told_apart(docs: DataFrame) -> DataFrame:
    """_doc (the row), text and _key: the doc_id; where one stands on several texts, the least digest keeps it, the others get numbers that no doc_id has."""
    held = aside(docs, F.col("doc_id").alias("_key"), F.col("text"))
    real = held.where("_key is not null").select("_key", digest(F.col("text")).alias("_digest"))
    clash = written(real.groupBy("_key").agg(F.min("_digest").alias("_least"), F.max("_digest").alias("_most")).where("_least < _most"), "clashes")
    if clash.isEmpty():
        return held
    others = real.join(clash, "_key").where("_digest > _least").select("_key", "_digest").distinct().withColumn("_one", F.lit(1))
    others = written(others, "clashing-texts")
    start = free_numbers(real.select(F.col("_key").cast("long")), others.count())
    numbers = prefix_sums(others, ["_key", "_digest"], {"_one": "_rank"}, [], "clashing").select("_key", "_digest", (F.col("_rank") + F.lit(start).cast("long")).alias("_number"))
    rows = possible(clash.select("_key"), "_key")(held)
    touched = rows.where("_possible").withColumn("_digest", digest(F.col("text"))).join(numbers, ["_key", "_digest"], "left")
    own = ["_doc", "text"]
    return rows.where("not _possible").select(*own, "_key").unionByName(touched.select(*own, F.coalesce("_number", "_key").alias("_key")))


def near_dedup(docs: DataFrame, width: int = 5, **options) -> DataFrame:
    """docs with one row of each group of near-duplicates (that of the smallest doc_id), with their own columns and values, whatever their names.

    doc_id must be an integer; rows without one stay. Different texts of one doc_id are different documents; rows that repeat doc_id and text are one.
    Only rows whose doc_id goes, or stands on several rows, are shuffled.
    """
    keyed = told_apart(docs)
    told = near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"), width, **options).where("doc_id is not null")
    ids = told.groupBy(F.col("doc_id").alias("_key")).agg(F.min("kept").alias("kept"), F.count("*").alias("n"))
    ids = written(ids.where("not kept or n > 1"), "decided")
    rows = possible(ids.select("_key"), "_key")(keyed)
    touched = rows.where("_possible").join(ids.where("not kept"), "_key", "left_anti").dropDuplicates(["_key"])
    return rows.where("not _possible").select("_doc").unionByName(touched.select("_doc")).select("_doc.*")
