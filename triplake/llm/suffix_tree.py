"""Language-model scores from a probabilistic suffix tree (operator 10).

A text is its lower-cased words (A-Z only) and one end mark. The next symbol is a frequent word (RARE or more training occurrences), the end mark, or the
class of a rare word: its last letter and whether it is long. A rare word's probability is its class's
times its share of the class's rare words, Witten-Bell's: count / (all + kinds) for a known word, kinds / (all + kinds) for an unknown one.
So frequent words, known rare words and one unknown word for each class sum to one, as the base's known words and one unknown word do.

Every word is a context of its own. The tree has three parts. Its upper states are contexts of one and two classes: of the TOP most frequent words, each a class of its own, the end mark, and
the classes of other words. There are 2 ** 24 pairs of context and class at most, whatever the corpus, so all of them are kept in one
array of 32 MB; within its class a frequent word has its share. Below them, every other frequent word is a context of the next class: at most SIZE numbers
each. And every rare word is a context of its own, and so is every rare word with the frequent word after it: these states are as many as the corpus has
rare words and pairs of that kind, and stay in a table that documents meet in a shuffle, dealt by the rare word.

Counts and states of the most frequent words are broadcast, as many as MOST and ENTRIES let; a document's other frequent words meet theirs in a shuffle
and come with it. Both ways give the same scores.

A state is retained by a divergence test: of classes, if the gain in training log likelihood over the shorter context exceeds the BIC penalty of
its distribution; of a word, if it does so with each occurrence left out of its own count, as most are seen too seldom for less. Each
retained distribution is smoothed towards the longest retained shorter context (Witten-Bell), a word's towards that of its class, a pair's
towards that of its frequent word or, if that isn't retained, its two classes, the root towards the uniform one. A symbol is scored in the longest retained suffix of what precedes it. Nothing else is dropped: no cap, no
pruning by size.

The base score is the add-one word model of the same training documents, and its counts are exact.

Null or empty texts are one end mark. Repeated rows are scored row by row and count as often in training. A null doc_id is
not held out. With no training text the tree is the uniform distribution. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from triplake.llm.lookup import matched
from triplake.llm.shared import NO_ID, clean, few_at_once, mixed, runs, sums, word_hashes, written

BITS = 8
SIZE = 1 << BITS
#: Classes: the most frequent words, the end mark, and 64 classes of other words.
TOP = 191
END, FIRST_CLASS = TOP, TOP + 1
#: Words of fewer training occurrences are rare, letters from which on a word is long.
RARE, LONG = 16, 7
#: Most frequent words whose counts are broadcast: 28 bytes each with their states' totals, 235 MB at most. In text they are far fewer: 319,402 in 0.5 GB of it.
MOST = 1 << 23
#: Most numbers of frequent words' states that are broadcast: 8 bytes each, 32 MB at most.
ENTRIES = 1 << 22
#: Log probabilities of classes are kept to this precision; the least is 32.
STEP = 1 / 2048
#: Codes that a task gathers before it hands them on.
GATHER = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def letter_class(word: bytes) -> int:
    """The class of a word: its last letter or digit (a to z, digits, other signs, and four of other alphabets' bytes), and whether it is long."""
    last = (word.rstrip(b".,;:!?\"')]}") or b"?")[-1]
    kind = last - 97 if 97 <= last <= 122 else 26 if 48 <= last <= 57 else 27 if last < 128 else 28 + (last & 3)
    return FIRST_CLASS + kind + 32 * (len(word) >= LONG)


def distinct_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice: hashes and letter classes of the distinct words, the code of every word, and words per text."""
    own = [words_of(t) for t in texts]
    flat = [w for ws in own for w in ws]
    code, found = pd.factorize(word_hashes(flat).view(np.int64))
    first = np.zeros(len(found), np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    return found, np.array([letter_class(flat[i]) for i in first], np.int64), code, np.array([len(ws) for ws in own], np.int64)


def classes_of(found: np.ndarray, classes: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The classes of distinct words; top: the hashes of the most frequent ones, sorted."""
    known, at = matched(top, found)
    return np.where(known, at, classes)


def in_context(symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word and each text's end, the number made of its class and those of the two before it; before a text there are end marks."""
    room = lengths + 3
    whole = np.full(room.sum(), END, np.int64)
    start = np.cumsum(room) - room
    whole[np.arange(len(symbols)) + np.repeat(start + 2 - (np.cumsum(lengths) - lengths), lengths)] = symbols
    at = np.arange((lengths + 1).sum()) + np.repeat(start + 2 - (np.cumsum(lengths + 1) - lengths - 1), lengths + 1)
    return (whole[at - 2] << 2 * BITS) | (whole[at - 1] << BITS) | whole[at]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code, found = pd.factorize(np.concatenate([c for c, _ in parts]))
    return found, np.bincount(code, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)


def class_counts(training: DataFrame, top: np.ndarray) -> DataFrame:
    """code, n: every class with the two before it, counted over all training texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in batches:
            texts = clean(pdf["text"])
            for a, b in runs(texts, 3 << 19):
                found, classes, code, lengths = distinct_words(texts[a:b])
                code, found = pd.factorize(in_context(classes_of(found, classes, top)[code], lengths))
                held.append((found, np.bincount(code, minlength=len(found))))
                if sum(len(c) for c, _ in held) > GATHER:
                    held = [_merged(held)]
                    if len(held[0][0]) > GATHER // 2:
                        yield pd.DataFrame(dict(zip(("code", "n"), held.pop(), strict=True)))
        if held:
            yield pd.DataFrame(dict(zip(("code", "n"), _merged(held), strict=True)))

    return training.select("text").mapInPandas(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def counts_after(training: DataFrame, top: np.ndarray, shared: Broadcast, rest: bool) -> DataFrame:
    """h, seen: of words that aren't in top, the classes that follow them over all training texts, each as occurrences * SIZE + class, 8 bytes; a class may come several times.

    shared: the hashes of the words wanted, sorted. With rest, all others are told as well.
    """

    def packed(h: np.ndarray, code: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        """code: the word's place in h, and the class."""
        order = np.argsort(code)
        word, seen = code[order] // SIZE, n[order] * SIZE + code[order] % SIZE
        start = np.flatnonzero(np.diff(word, prepend=-1))
        data, ends = seen.tobytes(), np.append(start, len(seen))[1:]
        return pd.DataFrame({"h": h[word[start]], "seen": pd.Series([data[8 * a : 8 * b] for a, b in zip(start, ends, strict=True)], dtype=object)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered: list[tuple[np.ndarray, np.ndarray]] = []
        for pdf in batches:
            texts = clean(pdf["text"])
            for a, b in runs(texts, 3 << 19):
                found, letters, code, lengths = distinct_words(texts[a:b])
                kind = classes_of(found, letters, top)
                nxt = np.append(kind[code][1:], END) if len(code) else code
                ends = np.cumsum(lengths) - 1
                nxt[ends[lengths > 0]] = END
                wanted, at = matched(shared.value, found)
                mine = (wanted & (kind >= FIRST_CLASS))[code]
                seen, pair = pd.factorize(at[code[mine]] * SIZE + nxt[mine])
                gathered.append((pair, np.bincount(seen, minlength=len(pair))))
                if sum(len(c) for c, _ in gathered) > GATHER:
                    gathered = [_merged(gathered)]
                    if len(gathered[0][0]) > GATHER // 2:
                        yield packed(shared.value, *gathered.pop())
                if rest:
                    other = (~wanted & (kind >= FIRST_CLASS))[code]
                    seen, pair = pd.factorize(code[other] * SIZE + nxt[other])
                    yield packed(found, pair, np.bincount(seen, minlength=len(pair)))
        if gathered:
            yield packed(shared.value, *_merged(gathered))

    return training.select("text").mapInPandas(count, "h long, seen binary")


def smoothed(counts: np.ndarray, parent_counts: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The distributions (rows) of contexts with the counts: smoothed where the divergence test retains the context, else the parent's."""
    total, kinds = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(counts > 0, counts * np.log(counts * parent_counts.sum(axis=-1, keepdims=True) / (total * parent_counts)), 0.0).sum(axis=1, keepdims=True)
        kept = (total > 0) & (gain > kinds * np.log(np.maximum(total, 1)) / 2)
    return np.where(kept, (counts + kinds * parent) / np.maximum(total + kinds, 1), parent)


def steps(p: np.ndarray) -> np.ndarray:
    return np.round(-np.log(p) / STEP).astype(np.uint16)


def class_tree(training: DataFrame, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minus the natural logs of each class's probability after each one class, and after each two, in STEPs: arrays by code of SIZE ** 2
    and SIZE ** 3 numbers of two bytes."""
    with few_at_once(training.sparkSession):
        codes = written(class_counts(training, top), "class-counts")
    pairs = np.zeros(SIZE * SIZE)
    for code, n in codes.groupBy(F.col("code").bitwiseAND(F.lit(SIZE * SIZE - 1)).alias("code")).agg(F.sum("n")).collect():  # at most SIZE ** 2
        pairs[code] = n
    pairs = pairs.reshape(SIZE, SIZE)
    single = pairs.sum(axis=0)
    kinds = (single > 0).sum()
    root = (single + kinds / SIZE) / (single.sum() + kinds) if kinds else np.full(SIZE, 1 / SIZE)
    one = smoothed(pairs, single, root)

    def deepest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """The contexts whose first class is the key's: at most SIZE ** 2 rows."""
        counts = np.zeros(SIZE * SIZE)
        counts[pdf["code"].to_numpy() & (SIZE * SIZE - 1)] = pdf["n"]
        return pd.DataFrame({"first": [key[0]], "logs": [steps(smoothed(counts.reshape(SIZE, SIZE), pairs, one)).tobytes()]})

    two = np.tile(steps(one).ravel(), SIZE).reshape(SIZE, -1)
    keyed = codes.withColumn("first", F.shiftright("code", 2 * BITS).cast("int"))
    for first, logs in keyed.groupBy("first").applyInPandas(deepest, "first int, logs binary").collect():  # SIZE rows, 32 MB
        two[first] = np.frombuffer(logs, np.uint16)
    return steps(one).ravel(), two.ravel()


def shares(words: DataFrame, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By class, natural logs of: all + kinds of its words, all + kinds less the frequent words' occurrences, and kinds. 0 where a class has no word."""
    whole, cold, kinds = np.zeros(SIZE), np.zeros(SIZE), np.zeros(SIZE)
    rows = words.where(~F.col("h").isin([int(h) for h in top])).groupBy("kind").agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("is_hot"), F.col("n")).otherwise(0))).collect()
    for kind, n, k, frequent in rows:
        whole[kind], cold[kind], kinds[kind] = np.log(n + k), np.log(n + k - frequent), np.log(k)
    return whole, cold, kinds


def class_of_count(n: Column) -> Column:
    """Quarter powers of two, by which counts are cut."""
    return F.floor(F.log2(n) * 4).cast("int")


def commonest(counted: DataFrame, size: Column, most: int) -> Column:
    """The condition on n that the most frequent rows of counted meet, which have `most` of size together at most; from a histogram of at most 256 rows."""
    least, total = 1 << 30, 0
    for kind, n in sorted(((r[0], r[1]) for r in counted.groupBy(class_of_count(F.col("n"))).agg(F.sum(size)).collect()), reverse=True):
        total += n
        if total > most:
            break
        least = kind
    return class_of_count(F.col("n")) >= least


def top_words(words: DataFrame) -> np.ndarray:
    """Hashes of the TOP words, sorted."""
    return np.array(sorted(r[0] for r in words.orderBy(F.desc("n"), "h").limit(TOP).select("h").collect()), np.int64)


def word_states(after: DataFrame, words: DataFrame, one: np.ndarray) -> DataFrame:
    """h, n, kinds, state of the frequent words whose contexts are retained, TOP apart. state: for each class seen, in order, its occurrences * SIZE and the class, 8 bytes.

    after: the rows of counts_after.
    """

    def retained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kind, told = pdf["kind"].to_numpy(), np.frombuffer(b"".join(pdf["seen"]), np.int64)
            code, pair = pd.factorize(np.repeat(np.arange(len(pdf)) * SIZE, pdf["seen"].str.len().to_numpy(np.int64) // 8) + told % SIZE, sort=True)
            times = np.bincount(code, told // SIZE, len(pair)).astype(np.int64)
            owner = pair // SIZE
            sizes = np.bincount(owner, minlength=len(pdf))
            total = sums(times, sizes)
            p = one[kind[owner] * SIZE + pair % SIZE] * -STEP
            gain = sums(times * (np.log((times - 1 + sizes[owner] * np.exp(p)) / (total - 1 + sizes)[owner]) - p), sizes)
            kept = np.flatnonzero((total > 1) & (gain > sizes * np.log(total) / 2))
            data, ends = (times * SIZE + pair % SIZE).tobytes(), np.cumsum(sizes)
            yield pd.DataFrame({"h": pdf["h"].to_numpy()[kept], "n": total[kept], "kinds": sizes[kept], "state": pd.Series([data[8 * (ends[i] - sizes[i]) : 8 * ends[i]] for i in kept], dtype=object)})

    found = words.where(F.col("is_hot") & (F.col("kind") >= FIRST_CLASS)).select("h", "kind").join(after.groupBy("h").agg(F.listagg("seen").alias("seen")), "h")
    return found.mapInPandas(retained, "h long, n long, kinds long, state binary")


def word_table(h: np.ndarray, n: np.ndarray, own: np.ndarray, states: list[bytes]) -> tuple[np.ndarray, ...]:
    """Frequent words by hash: hashes, sorted, and counts; their states' occurrences and kinds, 0 without a state; and places * SIZE + class, with the occurrences of each.

    own, states: hashes of the words with states, each once, and those. There are at most 2 ** 24 words.
    """
    order, by = np.argsort(h), np.argsort(own)
    h, n = h[order], n[order]
    seen = np.frombuffer(b"".join([states[i] for i in by]), np.int64)
    sizes = np.array([len(states[i]) // 8 for i in by], np.int64)
    kinds, total = np.zeros(len(h), np.int32), np.zeros(len(h))
    at = np.searchsorted(h, own[by])
    kinds[at], total[at] = sizes, sums(seen // SIZE, sizes)
    keys = np.repeat((at * SIZE).astype(np.uint32), sizes)
    keys += (seen % SIZE).astype(np.uint32)
    return h, n, total, kinds, keys, (seen // SIZE).astype(np.float32)


def brought(rows: DataFrame, wanted: DataFrame, shared: Broadcast) -> DataFrame:
    """rows with the frequent words that aren't broadcast, or whose states aren't: hashes, counts and states (empty: none) of wanted(h, n, state), as arrays.

    shared: the hashes of words of which nothing else is needed, sorted.
    """

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, row = clean(pdf["text"]), pdf["row"].to_numpy()
            for a, b in runs(texts, 1 << 19):
                found, _, code, lengths = distinct_words(texts[a:b])
                more = ~matched(shared.value, found)[0][code]
                pair = pd.unique((np.repeat(np.arange(b - a), lengths) * np.int64(max(1, len(found))) + code)[more])
                yield pd.DataFrame({"row": row[a:b][pair // max(1, len(found))], "h": found[pair % max(1, len(found))]})

    met = rows.select("row", "text").mapInPandas(asked, "row long, h long").join(wanted, "h")
    own = met.groupBy("row").agg(F.collect_list(F.struct("h", "n", F.coalesce("state", F.lit(b"")).alias("state"))).alias("own"))
    return rows.join(own.select("row", F.col("own.h").alias("words"), F.col("own.n").alias("counts"), F.col("own.state").alias("states")), "row", "left")


def brought_table(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """The word_table of the words that came with these documents."""
    came = pdf[pdf["words"].notna()]
    flat = lambda name: [x for xs in came[name] for x in xs]
    h, first = np.unique(np.array(flat("words"), np.int64), return_index=True)
    states = flat("states")
    own = [i for i, f in enumerate(first) if states[f]]
    return word_table(h, np.array(flat("counts"), np.float64)[first], h[own], [states[first[i]] for i in own])


def scores(docs: DataFrame, held_out: Column, most: int | None = None, hold: int = MOST, entries: int = ENTRIES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs(doc_id, text).

    held_out is a condition over doc_id; the tree, the words' counts and the base learn from the other rows. hold and entries bound what is broadcast,
    which changes no score. `most` asks for another, smaller model: a frequent word then has one in `most` of all occurrences as well, and only the classes are its context.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text", F.coalesce(held_out, F.lit(False)).alias("held"))
    training = rows.where(~F.col("held"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = clean(pdf["text"])
            for a, b in runs(texts, 3 << 19):
                found, classes, code, _ = distinct_words(texts[a:b])
                yield pd.DataFrame({"h": found, "kind": classes, "n": np.bincount(code, minlength=len(found))})

    words = training.select("text").mapInPandas(count, "h long, kind long, n long").groupBy("h").agg(F.sum("n").alias("n"), F.min("kind").alias("kind"))
    with few_at_once(spark):
        words = written(words.withColumn("v", F.col("n").cast("double")), "word-counts")
    n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_ends = training.count()
    n_train, kinds = n_words + n_ends, n_kinds + (n_ends > 0)
    top = top_words(words)
    words = words.withColumn("is_hot", F.col("h").isin([int(h) for h in top]) | (F.col("n") >= (max(RARE, -(-n_words // most)) if most else RARE)))
    frequent = words.where("is_hot")
    is_held = commonest(frequent, F.lit(1), hold)
    found = frequent.where(is_held).select("h", "v").toArrow()  # at most `hold` rows
    hot, times = found["h"].to_numpy(), found["v"].to_numpy()
    spread = len(hot) < frequent.count()
    one, two = class_tree(training, top)
    hashes = spark.sparkContext.broadcast(np.sort(hot))
    after = counts_after(training if not most else training.limit(0), top, hashes, spread)
    with few_at_once(spark):
        states = written(word_states(after, words, one), "word-states")
    is_near = commonest(states, F.col("kinds"), entries) & is_held
    found = states.where(is_near).select("h", "state").toArrow()  # at most `entries` numbers
    table = word_table(hot, times, found["h"].to_numpy(), found["state"].to_pylist())
    far = states.where(~is_near)
    spread = spread or far.limit(1).count() > 0
    if spread:
        away = far.where(is_held).select("h").toArrow()["h"].to_numpy()  # at most `hold` rows
        enough = spark.sparkContext.broadcast(np.setdiff1d(hot, away))
        wanted = frequent.select("h", "n", "v").join(far.select("h", "state"), "h", "left").where(~is_held | F.col("state").isNotNull()).select("h", F.col("v").alias("n"), "state")
        rows = written(rows, "rows")
        rows = brought(rows, wanted, enough)
    shared = spark.sparkContext.broadcast((one, two, top, table, shares(words, top)))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two, top, table, (whole, cold, kinds) = shared.value
        for pdf in batches:
            texts, row, key, held = clean(pdf["text"]), pdf["row"].to_numpy(), pdf["id"].to_numpy(), pdf["held"].to_numpy()
            for a, b in runs(texts, 1 << 19):
                found, letters, code, lengths = distinct_words(texts[a:b])
                kind = classes_of(found, letters, top)
                is_hot, n, met = np.zeros(len(found), bool), np.ones(len(found)), []
                for h, times, total, after, keys, often in [table, brought_table(pdf.iloc[a:b])] if spread else [table]:
                    known, at = matched(h, found)
                    is_hot |= known
                    if len(h):
                        n = np.where(known, times[at], n)
                        met.append((known & (total[at] > 0), at, total, after, keys, often))
                # what comes to a class's probability: a frequent word's share, or that of all rare ones; and the next symbol's name
                extra = np.where(kind < END, 0.0, np.where(is_hot, np.log(n), cold[kind]) - whole[kind])
                symbol = np.where(is_hot, found, kind)
                owner = np.repeat(np.arange(b - a), lengths)
                place = np.arange(len(code)) + owner  # among words and ends
                state = in_context(kind[code], lengths)
                more, name, rare = np.zeros(len(state)), np.full(len(state), END, np.int64), np.zeros(len(state), bool)
                more[place], name[place], rare[place] = extra[code], symbol[code], ~is_hot[code]
                deep = more - two[state] * STEP
                for known, at, total, after, keys, often in met:  # what comes after a frequent word whose context is retained
                    mine = known[code]
                    here, at = place[mine] + 1, at[code[mine]]
                    seen, where = matched(keys, (at * SIZE + (state[here] & (SIZE - 1))).astype(np.uint32))
                    p = np.exp(one[state[here] & (SIZE * SIZE - 1)] * -STEP)
                    deep[here] = more[here] + np.log((np.where(seen, often[where] if len(often) else 0.0, 0.0) + after[at] * p) / (total[at] + after[at]))
                frequent = np.zeros(len(state), bool)
                frequent[place] = is_hot[code]
                # what comes after a rare word, and after a rare and a frequent one, is scored by that context, if it is retained
                one_before, two_before = np.flatnonzero(rare), np.flatnonzero(rare[:-1] & frequent[1:])
                here, nxt = np.concatenate([one_before, two_before]), np.concatenate([one_before + 1, two_before + 2])
                context = np.concatenate([np.zeros(len(one_before), np.int64), name[two_before + 1]])
                after = np.zeros(len(state), bool)
                after[nxt] = True
                base = np.where(is_hot, np.log10(n + 1), 0.0)
                text_of = np.searchsorted(np.cumsum(lengths + 1), here, side="right")
                word = code[here - text_of]
                names, named = pd.factorize(mixed(context.view(np.uint64)) ^ name[nxt].view(np.uint64))
                pair = (text_of * np.int64(max(1, len(found))) + word) * np.int64(max(1, len(named))) + names
                _, first, back, often = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                which, w, follows = text_of[first], word[first], nxt[first]
                alone = first < len(one_before)
                shallow = np.where(alone, more[follows] - one[state[follows] & (SIZE * SIZE - 1)] * STEP, deep[follows])
                none, zero, false = np.zeros(len(first)), np.zeros(len(first), np.int64), np.zeros(b - a, bool)
                yield pd.DataFrame(
                    {
                        "row": row[a:b][np.concatenate([np.arange(b - a), which])], "id": np.concatenate([key[a:b], np.full(len(first), NO_ID)]),
                        "h": np.concatenate([row[a:b], found[w]]), "context": np.concatenate([np.zeros(b - a, np.int64), context[first]]), "next": np.concatenate([np.zeros(b - a, np.int64), name[follows]]),
                        "times": np.concatenate([np.zeros(b - a, np.int64), often]), "train": np.concatenate([false, ~held[a:b][which]]),
                        "shallow": np.concatenate([np.zeros(b - a), shallow]), "deep": np.concatenate([np.zeros(b - a), np.bincount(back, deep[nxt], len(first))]),
                        "share": np.concatenate([np.zeros(b - a), -cold[kind[w]]]), "missing": np.concatenate([np.zeros(b - a), kinds[kind[w]] - cold[kind[w]]]),
                        "n": np.concatenate([lengths, zero]), "n_known": np.concatenate([sums(is_hot[code].astype(np.int64), lengths), zero]),
                        "base": np.concatenate([sums(base[code], lengths), none]), "score": np.concatenate([sums(np.where(after, 0.0, deep), lengths + 1), none]),
                    }
                )

    schema = "row long, id long, h long, context long, next long, times long, train boolean, shallow double, deep double, share double, missing double, n long, n_known long, base double, score double"
    told = rows.select("row", "id", "text", "held", *(["words", "counts", "states"] if spread else [])).mapInPandas(each, schema).repartition("h")
    with few_at_once(spark):
        summed = written(scored(told).groupBy("row").agg(F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")]), "scores")
    shared.destroy()  # 32 MB, and what was scored is stored
    token = F.col("n") + 1
    return summed.withColumn("doc_id", F.nullif("id", F.lit(NO_ID))).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), token.alias("n_tokens"), (F.col("n_known") + (1 if n_ends else 0)).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + float(np.log10(n_ends + 1)) - token * float(np.log10(n_train + kinds + 1))).alias("base_score"),
        (F.col("score") / float(np.log(10))).alias("score"),
    )


def scored(told: DataFrame) -> DataFrame:
    """row, id, n, n_known, base and score of every row of told, which is dealt by h: where h is a rare word, its count and the state of its context come in.

    n_h: training occurrences of the context (the word, or the word and the one after it), n_next: those followed by the row's symbol, kinds: symbols
    that follow it in training. Only rows of the word alone count it.
    """
    context, follows = W.partitionBy("h", "context"), W.partitionBy("h", "context", "next")
    seen = F.when(F.col("train"), F.col("times")).otherwise(0)
    new = (F.row_number().over(follows.orderBy(F.desc("train"))) == 1) & F.col("train")
    met = told.withColumn("n_next", F.sum(seen).over(follows)).withColumn("new", new.cast("int"))
    met = met.withColumn("n_h", F.sum(seen).over(context)).withColumn("kinds", F.sum("new").over(context))
    log_of = lambda less: F.log((F.col("n_next") - less + F.col("kinds") * F.exp("shallow")) / (F.col("n_h") - less + F.col("kinds")))
    gain = F.sum(F.when(F.col("train"), F.col("times") * (log_of(1) - F.col("shallow"))).otherwise(0.0)).over(context)
    met = met.withColumn("retained", (F.col("n_h") > 1) & (gain > F.col("kinds") * F.log(F.greatest("n_h", F.lit(1))) / 2))
    own = F.when(F.col("context") == 0, F.col("times")).otherwise(0)
    known = F.col("n_h") > 0
    word = F.when(known, F.log("n_h") + F.col("share")).otherwise(F.col("missing"))
    score = F.when(own > 0, own * word).otherwise(0.0) + F.when(F.col("retained"), F.col("times") * log_of(0)).otherwise(F.col("deep"))
    return met.select(
        "row", "id", "n", (F.col("n_known") + F.when(known, own).otherwise(0)).alias("n_known"), (F.col("base") + F.when(own > 0, own * F.log10(F.col("n_h") + 1)).otherwise(0.0)).alias("base"),
        F.when(F.col("times") == 0, F.col("score")).otherwise(score).alias("score"),
    )
