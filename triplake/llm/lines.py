"""Removal of repeated passages of two or more lines (operator 3), by DataFrame operations only.

A rolling hash over the hashes of WINDOW lines cuts texts into chunks: one ends after a line whose hash is 0 modulo SPREAD and whose
predecessor's isn't. That depends on the lines just before the cut only, so equal passages are cut alike wherever they stand, and no
chunk but a text's last has a single line. Chunks of two or more lines that occur before (least doc_id, then text hash, then place)
are found by hash, compared byte for byte with the first occurrence, and removed. A removed chunk is extended line by line to both
sides as far as its neighbours are those of the first occurrence: there the rest of a passage stands that a cut parts from its
surroundings. What is left are passages too short to hold a whole chunk. They are found last, as two neighbouring lines of
which one at least is still there, in the same way. So every repeated run of two or more lines goes whole, and the first occurrence of every
line stays. Two blank lines alone are no passage. Pieces whose hashes agree and bytes don't are compared among themselves in further rounds.

Hashes are counted first, as 12 bytes each and summed before the shuffle; only pieces whose hash repeats get a row with a place.

`removed_chunks` counts the repeated chunks; a text that lost lines but no whole chunk counts as one.

A null text stays null, an empty one empty; neither is removed. Rows that repeat a doc_id and its text are treated alike. A null
doc_id comes first. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.llm.bitmap import possible
from triplake.llm.shared import NO_ID, written

#: A rolling hash is over so many lines, at least 2; of so many lines one is a cut, before cuts next to each other are taken together.
WINDOW, SPREAD = 2, 3
#: What makes two pieces candidates: hash, lines, and whether it is a chunk or two neighbouring lines.
KEY = ["h", "n", "whole"]


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once a row, also where higher-order functions use it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _lined(docs: DataFrame, spread: int, window: int) -> DataFrame:
    """docs(..., text) with lines, and starts and sizes of the text's chunks."""
    rows = _once(docs, "lines", F.split("text", "\n", -1))
    rows = _once(rows, "marks", F.transform("lines", lambda line: F.xxhash64(line)))
    # each line's hash turned by its distance from the window's end: one turn more with each line that follows
    rolled = " ^ ".join(f"(shiftleft(marks[i - {k}], {k}) | shiftrightunsigned(marks[i - {k}], {64 - k}))" if k else "marks[i]" for k in range(window))
    rows = _once(rows, "hits", F.expr(f"transform(marks, (m, i) -> i >= {window - 1} and pmod(xxhash64({rolled}), {spread}) = 0)")).drop("marks")
    rows = _once(rows, "starts", F.expr("filter(sequence(0, size(lines) - 1), i -> i = 0 or i > 1 and hits[i - 1] and not hits[i - 2])")).drop("hits")
    return rows.withColumn("sizes", F.expr("transform(starts, (s, k) -> coalesce(get(starts, k + 1), size(lines)) - s)"))


def chunked(docs: DataFrame, spread: int = SPREAD, window: int = WINDOW) -> DataFrame:
    """docs(..., text) with n_lines and chunks, the array of the text's chunks in order."""
    rows = _lined(docs, spread, window).withColumn("n_lines", F.coalesce(F.size("lines"), F.lit(0)))
    return _once(rows, "chunks", F.expr("transform(starts, (s, k) -> array_join(slice(lines, s + 1, sizes[k]), '\n'))")).drop("lines", "starts")


def pieces(docs: DataFrame, spread: int = SPREAD, window: int = WINDOW) -> DataFrame:
    """id, th, pos, n, before, after, whole, h of docs(id, th, text): chunks of two or more lines (whole) with the sizes of the chunks around them, and pairs of neighbouring lines of which one isn't blank."""
    chunks = "filter(transform(starts, (s, k) -> struct(s as pos, sizes[k] as n, if(k > 0, sizes[k - 1], 0) as before, coalesce(get(sizes, k + 1), 0) as after, true as whole)), c -> c.n > 1)"
    pairs = "transform(filter(sequence(0, size(lines) - 1), i -> i < size(lines) - 1 and (trim(lines[i]) <> '' or trim(lines[i + 1]) <> '')), i -> struct(i as pos, 2 as n, 0 as before, 0 as after, false as whole))"
    hashed = f"transform(concat({chunks}, {pairs}), c -> struct(c.pos, c.n, c.before, c.after, c.whole, xxhash64(slice(lines, c.pos + 1, c.n)) as h))"
    return _lined(docs, spread, window).select("id", "th", F.inline(F.expr(hashed))).toDF("id", "th", "pos", "n", "before", "after", "whole", "h")


def candidates(docs: DataFrame, spread: int = SPREAD, window: int = WINDOW) -> DataFrame:
    """The pieces of docs(id, th, text) whose hashes repeat; no texts yet."""
    hashed = pieces(docs, spread, window)
    again = written(hashed.groupBy(*KEY).count().where("count > 1").select(*KEY), "repeated-hashes")
    some = possible(again.select("h").distinct(), "h")(hashed).where("_possible").drop("_possible")
    return written(some.join(again, KEY, "left_semi").distinct(), "candidates")


def with_texts(docs: DataFrame, some: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """Candidates with their text in `piece` and the lines of the chunks around them in head and tail; with gone(id, th, gone), without those whose lines are all gone."""
    places = some.groupBy("id", "th").agg(F.collect_list(F.struct("pos", "before", "after", *KEY)).alias("places"))  # at most two for each line of a document
    if gone is not None:
        places = places.join(gone.select("id", "th", "gone"), ["id", "th"], "left")
        lines = "array_distinct(flatten(transform(places, p -> sequence(p.pos, p.pos + p.n - 1))))"
        places = _once(places, "still", F.expr(f"if(gone is null, null, array_except({lines}, gone))"))
        left = "if(gone is null, places, filter(places, p -> exists(sequence(p.pos, p.pos + p.n - 1), i -> array_contains(still, i))))"
        places = places.select("id", "th", F.expr(left).alias("places")).where("size(places) > 0")
    places = written(places, "places")
    texts = possible(places.select("id").distinct(), "id")(docs).where("_possible").select("id", "th", "text").dropDuplicates(["id", "th"]).join(places, ["id", "th"])
    texts = _once(texts, "lines", F.split("text", "\n", -1))
    cut = "struct(p.pos as pos, p.h as h, p.n as n, p.whole as whole, array_join(slice(lines, p.pos + 1, p.n), '\n') as piece, slice(lines, p.pos - p.before + 1, p.before) as head, slice(lines, p.pos + p.n + 1, p.after) as tail)"
    return written(texts.select("id", "th", F.inline(F.expr(f"transform(places, p -> {cut})"))), "piece-texts")


def repeated(open_: DataFrame) -> DataFrame:
    """id, th, pos, n, up and down: the pieces that repeat an earlier one, byte for byte, and how many lines before and after them do so too."""
    found = None
    told = ["id", "th", "pos", "piece", "head", "tail"]
    alike = lambda a, b, at: f"aggregate(sequence(1, greatest(least(size({a}), size({b})), 1)), 0, (n, k) -> if(n = k - 1 and k <= least(size({a}), size({b})) and {at}, k, n))"
    up, down = alike("head", "f.head", "head[size(head) - k] = f.head[size(f.head) - k]"), alike("tail", "f.tail", "tail[k - 1] = f.tail[k - 1]")
    while True:
        # the first of each hash, by place; found in each task before anything is shuffled
        firsts = open_.groupBy(*KEY).agg(F.min(F.struct(*told)).alias("f"))
        met = open_.join(firsts, KEY).where("struct(id, th, pos) <> struct(f.id, f.th, f.pos)")
        same = F.expr("piece = f.piece")
        left = [F.when(~same, F.col(c)).alias(c) for c in told[3:]]
        compared = written(met.select("id", "th", "pos", *KEY, same.alias("same"), F.expr(up).alias("up"), F.expr(down).alias("down"), *left), "compared")
        gone = compared.where("same").select("id", "th", "pos", "n", "up", "down")
        found = gone if found is None else found.unionByName(gone)
        open_ = compared.where("not same").select("id", "th", "pos", *KEY, "piece", "head", "tail")
        if open_.isEmpty():
            return found


def _lost(found: DataFrame) -> DataFrame:
    """id, th, gone (the places of removed lines) and chunks of a document: at most an entry for each line."""
    spans = F.array_distinct(F.flatten(F.collect_list(F.expr("sequence(pos - up, pos + n - 1 + down)"))))
    return found.groupBy("id", "th").agg(spans.alias("gone"), F.count("*").cast("int").alias("chunks"))


def line_dedup(docs: DataFrame, spread: int = SPREAD, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, removed_chunks, removed_lines and text (what is left) of every row of docs(doc_id, text)."""
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("th"), "text")
    some = candidates(rows, spread, window)
    by_chunks = written(_lost(repeated(with_texts(rows, some.where("whole")))), "chunk-removals")
    # pairs of which a line is still there; the first occurrence of any pair is one of them
    by_pairs = _lost(repeated(with_texts(rows, some.where("not whole"), by_chunks)))
    every = by_chunks.unionByName(by_pairs.withColumn("chunks", F.lit(0)))
    gone = every.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.greatest(F.lit(1), F.sum("chunks")).cast("int").alias("gone_chunks"))
    gone = written(gone, "removals")
    told = possible(gone.select("id"), "id")(rows)
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines")
    untouched = told.where("not _possible").select("id", n_lines, F.lit(0).alias("removed_chunks"), F.lit(0).cast("long").alias("removed_lines"), "text")
    touched = told.where("_possible").select("id", "th", "text").join(gone, ["id", "th"], "left")
    touched = _once(touched, "lines", F.split("text", "\n", -1))
    touched = _once(touched, "left", F.when(F.col("gone").isNotNull(), F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.expr("transform(left, i -> lines[i])"), "\n"))
    touched = touched.select("id", n_lines, F.coalesce("gone_chunks", F.lit(0)).alias("removed_chunks"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("removed_lines"), text.alias("text"))
    return untouched.unionByName(touched).select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_lines", "removed_chunks", "removed_lines", "text")
