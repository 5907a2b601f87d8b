"""Mixing sources to target weights (operator 6).

Targets: the budget is shared among the sources by weight; a target stops at MOST_EPOCHS times its source's size and the
excess is shared again, by weight, until none is above. Taking: a source gives floor(target / size) complete epochs; the
rest of its target comes from Efraimidis-Spirakis sampling, that is from its documents in the order of -ln(u) / quality (u
uniform, from a digest of the doc_id), up to the budget. The document at the budget's end gives only the words up to it.

A null text has no words and takes none. A null source is one source, the last. Repeated rows are rows of their own (they
follow one another in the order). A null doc_id draws as the empty string does. An empty table gives an empty result. A source without
words has target 0. Input columns other than doc_id, text and source are ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplake.llm.prefix import prefix_sums
from triplake.llm.shared import WORD, aside, written

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
#: Characters that count against a document's quality.
NOISE = "#*$%&|<>{}[]=+_~^@0123456789"


def uniform(doc_id: Column) -> Column:
    """A number in (0, 1) that depends on the doc_id alone."""
    digits = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 12), 16, 10)
    return (digits.cast("double") + 0.5) / float(1 << 48)


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the less noise among the characters, the larger."""
    size = F.length(text)
    noise = size - F.length(F.translate(text, NOISE, ""))
    return F.when(size > 0, F.greatest(F.lit(0.05), 1 - 4 * noise / size)).otherwise(F.lit(0.05))


def targets(sizes: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """sizes(source, source_size) with `target`; weights repeat along the sources in code point order, null last."""
    ordered = sizes.withColumn("is_null", F.col("source").isNull()).withColumn("one", F.lit(1))
    ranked = prefix_sums(ordered, ["is_null", "source"], {"one": "rank"}, [], "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    held = written(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("cap")), "weights")
    total = held.agg(F.sum("source_size")).first()[0] or 0
    budget, rate, capped = share * total, 0.0, -1
    while True:  # each round caps at least one more source
        full = F.col("cap") <= F.col("weight") * rate
        n, held_back, open_weight = held.agg(F.sum(full.cast("int")), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not n and n != 0 or n == capped or not open_weight:
            break
        capped, rate = n, (budget - held_back) / open_weight
    return held.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * rate).alias("target"))


def digest(text: Column) -> Column:
    """The text's MD5 digest; no bytes for a null text."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def mix(docs: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken, epochs and part of every row of docs(doc_id, text, source).

    taken = epochs * size + part: words of complete epochs, and of the fractional selection.
    """
    told = _mixed(docs, F.col("doc_id"), [], share, weights, most)
    return told.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).cast("long").alias("taken"), "epochs", "part")


def _mixed(docs: DataFrame, drawn_by: Column, more: list[Column], share: float = 1.0, weights: tuple = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, part and the further key columns `more` of every row of docs."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = -F.log(uniform(drawn_by)) / quality(F.coalesce("text", F.lit("")))
    rows = written(docs.select("doc_id", "source", size.alias("size"), key.alias("key"), *more), "sizes")
    told = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), share, weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    told = told.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    before = prefix_sums(rows, ["key", "doc_id", "size", *rows.columns[4:]], {"size": "before"}, ["source"], "drawn")
    told = told.withColumnRenamed("source", "_source")
    met = before.join(told, F.col("source").eqNullSafe(F.col("_source")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before"))).cast("long")
    return met.withColumn("part", part).drop("_source")


def resample(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them, with their own columns: a row for each complete epoch, and one more if at least half
    of the document is in the fractional selection. Rows that share doc_id, source and text share a decision; a null doc_id is an id
    like others, but draws by its text's digest, so that such rows are drawn one by one."""
    own_digest = digest(F.col("text"))
    told = _mixed(docs, F.coalesce(F.col("doc_id").cast("string"), F.hex(own_digest)), [own_digest.alias("digest")], **options)
    more = ((F.col("part") > 0) & (2 * F.col("part") >= F.col("size"))).cast("long")
    copies = told.groupBy("doc_id", "source", "digest").agg(F.max(F.col("epochs") + more).cast("int").alias("copies")).where("copies > 0").alias("c")
    rows = aside(docs, F.col("doc_id"), F.col("source"), own_digest.alias("digest")).alias("d")
    keys = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in ("doc_id", "source", "digest")]
    return rows.join(copies, keys).select("_doc", F.explode(F.sequence(F.lit(1), "copies"))).select("_doc.*")
