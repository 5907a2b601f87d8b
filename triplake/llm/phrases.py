"""Phrases whose words keep company (operator 13), by weighted acyclic automata.

Each task counts the phrases of a few MB of text at a time: occurrences are sorted once by their words, and the runs of equal
prefixes are the counts of all shorter phrases too. The sorted paths (language, word, word, word) become a count automaton,
cut at the boundaries of prefix ranges, which a sample of phrases gives; so a frequent word is spread over ranges by the words
that follow it, and a frequent phrase is one path of each automaton. Ranges are united, weights summed; what occurs
too rarely is in no candidate and no part of one, and goes. Parts of candidates are composed with the automata of their
ranges. All counts are exact; the sample only decides how evenly ranges fill.

Words lie in pieces, which `[.,;:!?]` and line ends bound; only A-Z is lower-cased. Null and empty texts have no words, a null
language is `und`. Repeated rows count as often as they occur. Ties in rank go by score, occurrences and the phrase's bytes. An
empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplake.llm.automata import Counts
from triplake.llm.prefix import prefix_sums
from triplake.llm.shared import clean, few_at_once, utf8_size, written

WORDS, LEAST, TOP = 3, 10, 2000
#: Bytes of text that a task counts at a time, and for each prefix range.
SHARD, RANGE = 8 << 20, 4 << 20
#: Sampled documents, at least and for each range, and phrases of each of them: for the boundaries of ranges.
SAMPLED, SAMPLED_EACH, SAMPLED_PHRASES = 2000, 16, 64
#: Of the sample; bytes of a word that a boundary keeps.
SEED, LETTERS = 13, 256
#: Ranges that counts are cut into at once. Of more, neighbours go together, and are cut once the pieces of many shards are united: else there would be a piece for each shard and range.
FAN = 256
#: Most tokens that are sorted together.
TOKENS = 1 << 21
BREAK = b"\xff"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)


def words(text: bytes) -> list[bytes]:
    """Words in order, with BREAK between pieces."""
    return text.translate(_TABLE).replace(BREAK, b" \xff ").split(b" ")


def occurrences(lang: bytes, tokens: list[bytes]) -> Iterator[Counts]:
    """Counts of the paths (lang), (lang, word), ... of a run of words with breaks; empty tokens aren't words."""
    tokens = [t for t in tokens if t]
    for a in range(0, len(tokens), TOKENS):
        yield from _counted(lang, tokens[a : a + TOKENS + WORDS - 1], min(TOKENS, len(tokens) - a))


def _counted(lang: bytes, tokens: list[bytes], starts: int) -> Iterator[Counts]:
    """Of phrases that start at one of the first tokens."""
    held = np.empty(len(tokens), object)
    held[:] = tokens
    code, found = pd.factorize(held)
    found = found.tolist()
    alphabet = sorted({*found, lang} - {BREAK})
    bits = (len(alphabet) + 1).bit_length()
    if bits * WORDS > 63:  # more distinct words than a number holds three of
        half = starts // 2
        yield from _counted(lang, tokens[: half + WORDS - 1], half)
        yield from _counted(lang, tokens[half:], starts - half)
        return
    at = {w: i + 1 for i, w in enumerate(alphabet)}
    code = np.array([at.get(w, 0) for w in found], np.int64)[code]  # 0: a break
    code = np.concatenate([code, np.zeros(WORDS, np.int64)])
    key, word = np.zeros(starts, np.int64), None
    for k in range(WORDS):
        word = code[k : k + starts] * (1 if word is None else (word > 0))
        key = key << bits | word
    key = np.sort(key[code[:starts] > 0])
    if not len(key):
        return
    keys, weights = [], []
    for k in range(1, WORDS + 1):
        below = bits * (WORDS - k)
        prefix = key >> below
        prefix = prefix[prefix & ((1 << bits) - 1) > 0]  # phrases of k words at least
        first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]])) if len(prefix) else np.zeros(0, np.int64)
        keys.append(prefix[first] << below)  # sorts before its extensions
        weights.append(np.diff(np.append(first, len(prefix))))
    paths = np.concatenate(keys)
    order = np.argsort(paths, kind="stable")
    paths = paths[order]
    labels = np.full((len(paths) + 1, WORDS + 1), -1, np.int32)
    labels[:, 0] = at[lang] - 1
    for j in range(WORDS):
        labels[1:, 1 + j] = (paths >> bits * (WORDS - 1 - j) & ((1 << bits) - 1)) - 1
    yield Counts(alphabet, labels, np.concatenate([[len(key)], np.concatenate(weights)[order]]))


def range_of(path: tuple[bytes, ...], bounds: list[tuple[bytes, ...]]) -> int:
    return bisect_right(bounds, path)


def cut(counts: Counts, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Counts]]:
    """The counts by prefix range."""
    path = lambda i: tuple(counts.alphabet[x] for x in counts.labels[i].tolist() if x >= 0)
    low, high = (bisect_right(bounds, path(i)) for i in (0, len(counts.labels) - 1))
    ends = [bisect_left(range(len(counts.labels)), b, key=path) for b in bounds[low:high]]
    for i, (a, b) in enumerate(zip([0, *ends], [*ends, len(counts.labels)], strict=True)):
        if b > a:
            yield low + i, counts.between(a, b)


def boundaries(docs: DataFrame) -> list[tuple[bytes, ...]]:
    """Sorted paths that cut the phrases of docs(lang, text) into ranges of about equal size, one for each RANGE bytes of text.

    The sample is sorted and counted where it lies; the driver gets the boundaries alone. Long words are cut in them, which moves a boundary a little, but no phrase.
    """
    n, size = docs.select(F.count("*"), F.sum(utf8_size(F.col("text")))).first()
    n_ranges = -(-(size or 0) // RANGE)
    if n_ranges < 2:
        return []
    few = docs.sample(min(1.0, max(SAMPLED, SAMPLED_EACH * n_ranges) / n), SEED)

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for lang, text in zip(pdf["lang"], clean(pdf["text"]), strict=True):
                tokens = [t for t in words(text.encode("utf-8", "surrogatepass")) if t]
                for i in np.unique(np.linspace(0, len(tokens) - 1, SAMPLED_PHRASES).astype(int)) if tokens else []:
                    own = tokens[i : i + WORDS]
                    own = own[: own.index(BREAK)] if BREAK in own else own
                    out += [[lang.encode("utf-8", "surrogatepass"), *[w[:LETTERS] for w in own]]] if own else []
            if out:
                yield pd.DataFrame({"path": out})

    found = written(few.mapInPandas(phrases, "path array<binary>").groupBy("path").agg(F.count("*").alias("times")), "sample")  # a frequent path is one row
    total = found.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    placed = prefix_sums(found, ["path"], {"times": "before"}, [], "sorted-sample")
    # the path at each place total * i / n_ranges, i from 1
    shares = lambda place: F.expr(f"(({place}) * {n_ranges}L + {max(0, total - 1)}L) div {max(1, total)}L")
    rows = placed.where(shares("before + times") > F.greatest(shares("before"), F.lit(1))).select("path").collect()  # one for each range at most
    return sorted(tuple(map(bytes, r[0])) for r in rows)


def counted(docs: DataFrame, bounds: list, least: int = LEAST) -> DataFrame:
    """range and packed: for each prefix range of docs(lang, text) the automaton of its phrases that occur `least` times, and of languages."""
    held = docs.sparkSession.sparkContext.broadcast(bounds)
    span = -(-(len(bounds) + 1) // FAN)  # ranges that go together at first; as many turns share their pieces, so that a group is about RANGE bytes of text

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts: dict[str, list[bytes]] = {}
        size, turn, wide = 0, TaskContext.get().partitionId(), held.value[span - 1 :: span]

        def flush() -> Iterator[pd.DataFrame]:
            for lang, own in texts.items():
                for counts in occurrences(lang.encode("utf-8", "surrogatepass"), words(BREAK.join(own))):
                    yield packed(cut(counts, wide)).assign(turn=turn % span)
            texts.clear()

        for pdf in batches:
            for lang, text in zip(pdf["lang"], clean(pdf["text"]), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                texts.setdefault(lang, []).append(raw)
                size += len(raw)
                if size > SHARD:
                    yield from flush()
                    size, turn = 0, turn + 1
        yield from flush()

    def packed(pieces: Iterable[tuple[int, Counts]]) -> pd.DataFrame:
        rows = [(r, piece.pack()) for r, piece in pieces]
        return pd.DataFrame({"range": [r for r, _ in rows], "packed": [p for _, p in rows]})

    def union(pdf: pd.DataFrame) -> Counts:
        return Counts.union([Counts.unpack(p, ordered=False) for p in pdf["packed"]])

    def cut_again(pdf: pd.DataFrame) -> pd.DataFrame:
        return packed(cut(union(pdf), held.value))

    def united(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = union(pdf)
        return packed([(key[0], counts.where((counts.weights >= least) | (counts.lengths() == 1)))])

    pieces = docs.mapInPandas(shards, "range int, packed binary, turn int")
    if span > 1:
        pieces = pieces.groupBy("range", "turn").applyInPandas(cut_again, "range int, packed binary")
    with few_at_once(docs.sparkSession):
        return written(pieces.groupBy("range").applyInPandas(united, "range int, packed binary"), "counts")


def listed(automata: DataFrame) -> DataFrame:
    """lang, words and a (occurrences) of every path; no words: the language as a whole."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for packed in pdf["packed"]:
                counts = Counts.unpack(packed)
                paths = [[x.decode("utf-8", "surrogatepass") for x in p] for p in counts.paths()]
                if paths:
                    yield pd.DataFrame({"lang": [p[0] for p in paths], "words": [p[1:] for p in paths], "a": counts.weights})

    return automata.mapInPandas(each, "lang string, words array<string>, a long")


def composed(parts: DataFrame, automata: DataFrame, bounds: list) -> DataFrame:
    """lang, part and f of parts(lang, part), distinct phrases with blanks between their words; f is the automata's weight."""
    held = parts.sparkSession.sparkContext.broadcast(bounds)
    path = lambda lang, part: (lang.encode("utf-8", "surrogatepass"), *part.encode("utf-8", "surrogatepass").split(b" "))

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(range=[range_of(path(*p), held.value) for p in zip(pdf["lang"], pdf["part"], strict=True)])

    def walked(asked: pd.DataFrame, automaton: pd.DataFrame) -> pd.DataFrame:
        queries = sorted((path(*p), i) for i, p in enumerate(zip(asked["lang"], asked["part"], strict=True)))
        order = [i for _, i in queries]
        found = np.zeros(len(asked), np.int64)
        for packed in automaton["packed"]:  # one
            found[order] += np.array(Counts.unpack(packed).compose([q for q, _ in queries]), np.int64)
        return pd.DataFrame({"lang": asked["lang"], "part": asked["part"], "f": found})

    asked = parts.mapInPandas(ranged, "lang string, part string, range int")
    return asked.groupBy("range").cogroup(automata.groupBy("range")).applyInPandas(walked, "lang string, part string, f long")


def phrases(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the first `top` phrases of two and three words of each language of docs(lang, text)."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    bounds = boundaries(docs)
    automata = counted(docs, bounds, least)
    every = written(listed(automata), "phrases")
    totals = every.where(F.size("words") == 0).select(F.col("lang").alias("_lang"), F.col("a").alias("n"))
    found = every.where(F.size("words") > 1).select("lang", "words", F.array_join("words", " ").alias("phrase"), "a")
    # every way to cut a candidate: at most two, so few rows
    halves = F.expr("transform(sequence(1, size(words) - 1), i -> struct(i as k, array_join(slice(words, 1, i), ' ') as left, array_join(slice(words, i + 1, size(words) - i), ' ') as right))")
    cuts = found.select("lang", "phrase", "a", F.explode(halves).alias("c")).select("lang", "phrase", "a", "c.*")
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    weights = written(composed(parts, automata, bounds), "parts")
    left = weights.select(F.col("lang").alias("_l"), F.col("part").alias("left"), F.col("f").alias("l"))
    right = weights.select(F.col("lang").alias("_r"), F.col("part").alias("right"), F.col("f").alias("r"))
    met = cuts.join(left, (F.col("lang") == F.col("_l")) & (cuts["left"] == left["left"])).drop(left["left"])
    met = met.join(right, (F.col("lang") == F.col("_r")) & (met["right"] == right["right"])).drop(right["right"])
    # 1000000 a a / (l r) in decimals of 38 digits: exact up to counts of 16 digits
    score = F.expr("(1000000BD * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = met.groupBy("lang", "phrase", "a").agg(lowest.alias("m")).select("lang", "phrase", "a", "m.score", "m.l", "m.r")
    # phrases inside a longer one that has half their occurrences or more
    inner = F.expr("array(array_join(slice(words, 1, size(words) - 1), ' '), array_join(slice(words, 2, size(words) - 1), ' '))")
    longer = found.where(F.size("words") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < 50 * F.col("a"))).drop("most")
    # a language is ranked in shares first, so that no task sorts all of one
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    for shares in (512, 8, 1):
        share = F.pmod(F.xxhash64("phrase"), F.lit(shares))
        kept = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang", share).orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return kept.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
