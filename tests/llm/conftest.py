from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it for on with as was be by this are from or an river stone window paper garden light morning letter engine harbour".split()


def prose(seed: int, n: int, line: int = 12) -> str:
    """n words of made-up text, a line feed after each `line` words."""
    rng = random.Random(seed)
    words = [rng.choice(WORDS) + ("" if rng.random() < 0.6 else str(rng.randrange(400))) for _ in range(n)]
    return "".join(w + ("\n" if i % line == line - 1 else " ") for i, w in enumerate(words)).strip()


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with copies, near copies, nulls, empty and long texts, a hot source and extra columns with clashing names."""
    base = [prose(i, 40 + 7 * i) for i in range(24)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[3], "s0") for i in range(12)]  # exact copies
    near = base[7].split(" ")
    rows += [(200 + i, " ".join([*near[: 5 * i + 3], f"changed{i}", *near[5 * i + 4 :]]), "s1") for i in range(4)]
    rows += [(300, None, "s0"), (301, "", None), (302, " \n\t ", "s2"), (303, "one", "s0"), (304, "one", "s0"), (305, prose(999, 9000), "s0")]
    rows += [(24, "short text of one line", "s1"), (24, "short text of one line", "s1")]  # a repeated row
    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, part long, n_words string, row long, h string, shard string"
    full = [(i, t, "en", s, len(t or ""), 7, 9, "x", 1, "h", "q") for i, t, s in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
