"""Phrases and their automata against plain dictionaries, in one range and in many."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from triplake.llm import phrases
from triplake.llm.automata import Counts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in found.items():
            if any(p in (q[:-1], q[1:]) and 100 * b >= 50 * a for q, b in found.items() if len(q) > len(p)):
                continue
            score, k = min((1000000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocabulary = ["The", "of", "a", "New", "York", "city", "é", "São", "\x00", "😀", "x-ray", "it's"] + [f"w{i}" for i in range(40)]
    out = []
    for i in range(120):
        words = rng.choices(vocabulary, weights=[20, 12, 9, 3, 3, 3, 2, 2, 1, 1, 1, 1] + [1] * 40, k=rng.randrange(5, 90))
        out.append((["en", "de", "", None, "a\nb"][min(4, rng.randrange(9) // 2)] if i % 3 else "en", "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\v", "!?"]) for w in words)))
    out += [("en", "new york city hall")] * 30 + [("en", None), ("fr", ""), ("fr", " .,\n"), ("de", "no " * 4000), (None, "und und und")]
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "q", "z", 2) for r in rows], "lang string, text string, n long, phrase string, _lang string, range long").repartition(3)
    return sorted(map(tuple, phrases.phrases(df, **how).collect()))


def test_phrases(spark, rows):
    got = run(spark, rows, least=4, top=50)
    assert got == brute(rows, 4, 50) and len({r[0] for r in got}) > 3


def test_phrases_in_many_ranges_and_shards(spark, rows, monkeypatch):
    """Small shards, small sorts and ranges that split a frequent word and a language."""
    monkeypatch.setattr(phrases, "RANGE", 700)
    monkeypatch.setattr(phrases, "SHARD", 2000)
    monkeypatch.setattr(phrases, "TOKENS", 64)
    assert run(spark, rows, least=4, top=7) == brute(rows, 4, 7)


def test_empty_tables(spark, rows):
    assert run(spark, rows[:1], least=1000) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert phrases.phrases(df).collect() == []


def random_counts(rng, n):
    alphabet = sorted({bytes(rng.choices(b"abc\xc3", k=rng.randrange(0, 4))) for _ in range(12)})
    paths = {tuple(rng.choices(range(len(alphabet)), k=rng.randrange(1, 5))): rng.choice([1, 1, 1, 7, 1 << 40]) for _ in range(n)}
    labels = np.array([[*p, *[-1] * (4 - len(p))] for p in paths], np.int32).reshape(-1, 4)
    return Counts.of(alphabet, labels, np.array(list(paths.values()), np.int64)), {tuple(alphabet[i] for i in p): w for p, w in paths.items()}


@pytest.mark.parametrize("seed", range(6))
def test_automata(seed):
    rng = random.Random(seed)
    (a, of_a), (b, of_b) = random_counts(rng, 200), random_counts(rng, 30 * seed)
    held = lambda c: dict(zip(c.paths(), c.weights.tolist(), strict=True))
    assert held(a) == of_a and a.paths() == sorted(of_a)
    again = Counts.unpack(a.pack())
    assert held(again) == of_a and again.paths() == sorted(of_a)
    both = Counts.union([Counts.unpack(a.pack(), ordered=False), Counts.unpack(b.pack(), ordered=False)])
    assert held(both) == dict(Counter(of_a) + Counter(of_b)) and both.paths() == sorted({*of_a, *of_b})
    asked = sorted({*of_a, *of_b, *[p[:-1] for p in of_a if len(p) > 1], (b"zz", b"a"), (b"a", b"zz", b"a")})
    assert a.compose(asked) == [of_a.get(q, 0) for q in asked]
    heavy = a.where(a.weights > 1)
    assert held(heavy) == {p: w for p, w in of_a.items() if w > 1}
    bounds = sorted(rng.sample(sorted({*of_a, *of_b}), 5))
    pieces = list(phrases.cut(a, bounds))
    assert [(p, phrases.range_of(p, bounds)) for p in a.paths()] == [(p, r) for r, c in pieces for p in c.paths()]


def test_shared_states_are_small():
    """Phrases that occur once lead to few states: as many as there are last words."""
    rng = np.random.default_rng(1)
    labels = np.concatenate([np.zeros((20000, 1), np.int64), rng.integers(0, 50, (20000, 3))], axis=1).astype(np.int32)
    own = Counts.of([bytes([48 + i]) for i in range(50)], labels, np.ones(20000, np.int64))
    assert len(own.pack()) < 4 * len(own.labels)


def test_more_words_than_one_number_holds(monkeypatch):
    tokens = [b"%d" % i for i in range(3000)] * 2
    whole = Counts.union(list(phrases.occurrences(b"l", tokens)))
    monkeypatch.setattr(phrases, "TOKENS", 1000)
    cut = Counts.union(list(phrases.occurrences(b"l", tokens)))
    assert whole.paths() == cut.paths() and (whole.weights == cut.weights).all()


def test_work_of_a_cut_is_in_the_paths(monkeypatch):
    """Whatever the number of ranges, no piece's letters are sought in the paths of the others."""
    (own,) = phrases.occurrences(b"l", [b"%d" % (i * i % 97) for i in range(5000)])
    seen, recoded = [], Counts._own
    monkeypatch.setattr(Counts, "_own", lambda self, labels, weights: seen.append(len(labels)) or recoded(self, labels, weights))
    bounds = own.paths()[50::50]
    pieces = [piece for _, piece in phrases.cut(own, bounds)]
    assert sum(seen) == len(own.labels) and len(pieces) == len(bounds) + 1
    assert [p for piece in pieces for p in piece.paths()] == own.paths()


def test_weights_beyond_32_bits():
    """States of one last arc are shared by label and weight, whatever the weight."""
    own = Counts.of([b"a", b"b", b"c"], np.array([[0, 0], [0, 1], [1, 1], [2, 1], [2, -1]], np.int32), np.array([1, 7, 1 << 40, 7, 3]))
    back = Counts.unpack(own.pack())
    assert back.paths() == own.paths() and back.weights.tolist() == own.weights.tolist()


def test_the_driver_gets_boundaries_alone(spark, rows, monkeypatch):
    """The sample, however large, is cut where it lies; a long word doesn't come whole."""
    df = spark.createDataFrame([*rows, *[("en", "x" * 5000 + f" y{i}") for i in range(40)]], "lang string, text string").na.fill({"lang": "und", "text": ""})
    paths = []
    for lang, text in df.collect():
        tokens = [t for t in phrases.words(text.encode()) if t]
        for i in {int(x) for x in np.linspace(0, len(tokens) - 1, phrases.SAMPLED_PHRASES)} if tokens else ():
            own = tokens[i : i + 3]
            own = own[: own.index(phrases.BREAK)] if phrases.BREAK in own else own
            paths += [(lang.encode(), *[w[: phrases.LETTERS] for w in own])] if own else []
    paths.sort()
    size = sum(len(r.text.encode()) for r in df.collect())
    got, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(collect(self)) or got[-1])
    for n in (2, 7, 50, size // 100):
        got.clear()
        monkeypatch.setattr(phrases, "RANGE", -(-size // n))
        n = -(-size // phrases.RANGE)
        bounds = phrases.boundaries(df)
        assert bounds == sorted({paths[len(paths) * i // n] for i in range(1, n)}) and len(bounds) > n // 3
        assert max(map(len, got)) <= n and max(len(w) for p in bounds for w in p) <= phrases.LETTERS


@pytest.mark.parametrize("fan", [1, 3, 16])
def test_pieces_grow_with_the_text(spark, rows, monkeypatch, fan):
    """A shard is cut into few pieces however many ranges there are, and a task's pieces come in few batches."""
    monkeypatch.setattr(phrases, "RANGE", 700)
    monkeypatch.setattr(phrases, "SHARD", 2000)
    monkeypatch.setattr(phrases, "FAN", fan)
    assert run(spark, rows, least=4, top=7) == brute(rows, 4, 7)
    df = spark.createDataFrame(rows, "lang string, text string").na.fill({"lang": "und", "text": ""})
    bounds, cut = phrases.boundaries(df), phrases.cut
    assert len(bounds) > 30
    whole = [p for (p,) in phrases.counted(df, [], 1).select("packed").collect()]
    split = {r: Counts.unpack(p) for r, p in phrases.counted(df, bounds, 1).collect()}
    assert [p for r in sorted(split) for p in split[r].paths()] == [p for c in whole for p in Counts.unpack(c).paths()]
    assert all(phrases.range_of(p, bounds) == r for r, c in split.items() for p in c.paths())
    wide = bounds[-(-(len(bounds) + 1) // fan) - 1 :: -(-(len(bounds) + 1) // fan)]
    assert len(wide) < fan and [r for r, _ in cut(Counts.unpack(whole[0]), wide)] == list(range(len(wide) + 1))
