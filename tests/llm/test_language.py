"""Language identification: n-grams and cosines by definition, held-out accuracy, odd rows."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from triplake.llm import language, queries
from triplake.llm.shared import table

SYLLABLES = {"xa": "ka to mi re su no shi", "xb": "ber schlu gen zung ter ach", "xc": "eau oi que ille ment ré"}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, text(lang, i), lang) for i in range(90) for lang in [list(SYLLABLES)[i % 3]]]
    rows += [(200 + i, text("xa", 1), "xa") for i in range(60)]  # copies in a hot language
    rows += [(300, None, "xa"), (301, "", "xb"), (302, "12 !! 34", "xc"), (303, text("xb", 7), None), (None, text("xc", 8), "xc"), (304, text("xa", 9, 300_000), None), (305, "abc123", None)]
    rows += [(4, text("xb", 4), "xb")] * 2
    full = [(*r, "s", 0.5, "q", True) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, score double, lang_pred string, _nearest boolean").repartition(3)


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def test_languages(labelled):
    out = language.languages(labelled, held_out()).collect()
    assert len(out) == labelled.count()
    of = {r.doc_id: r for r in out}
    for i in range(90):
        assert of[i].lang_pred == list(SYLLABLES)[i % 3] and 0 < of[i].score <= 1
    assert {(of[i].lang_pred, of[i].score, of[i].rejected) for i in (300, 301, 302)} == {("und", 0.0, True)}
    assert of[303].lang_pred == "xb" and of[304].lang_pred == "xa" and of[None].lang_pred == "xc" and of[None].held_out is False
    assert of[305].lang_pred in SYLLABLES  # a letter is enough
    assert len({(r.lang_pred, r.score) for r in out if r.doc_id is not None and 200 <= r.doc_id < 300}) == 1


def test_predictions_read_nothing_but_the_text(labelled):
    model = language.fit(labelled.where(~held_out()))
    plain = language.predict(labelled.select("doc_id", "text"), model).select("doc_id", "lang_pred", "score")
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, language.languages(labelled, held_out()).select("doc_id", "lang_pred", "score").collect()), key=repr)


def test_model_by_definition(labelled):
    idf, langs, centroids, _ = language.fit(labelled.where(~held_out()))
    assert set(langs) == set(SYLLABLES) and len(langs) > 3  # several centroids of a language
    assert np.allclose((centroids**2).sum(axis=1), 1, atol=1e-4)
    learned = [r.text for r in labelled.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect()]
    rows = [language.damped([t])[0] for t in learned]
    rows = [r for r in rows if r.any()]
    want = np.log((1 + len(rows)) / (1 + sum(r > 0 for r in rows))) + 1
    assert np.allclose(idf, want, atol=1e-5)
    one = rows[0] * want
    cosine = (centroids @ one / np.sqrt((one**2).sum())).max()
    got = language.predict(labelled.where(F.col("text") == learned[0]).select("text"), (idf, langs, centroids, np.zeros(len(langs)))).first()
    assert got.score == pytest.approx(cosine, abs=1e-5)


def test_grams_by_definition():
    line = " ab c "
    assert len(language.grams("Ab, c")) == sum(len(line) - n + 1 for n in language.SIZES)
    assert sorted(language.grams("AB-C!")) == sorted(language.grams("ab c")) and not len(language.grams("1 2 ;"))
    assert sorted(language.grams("ab 9f3e c")) == sorted(language.grams("ab c"))


def test_no_languages(labelled):
    for docs in (labelled.limit(0), labelled.withColumn("lang", F.lit(None).cast("string"))):
        out = language.languages(docs, held_out()).collect()
        assert {(r.lang_pred, r.score) for r in out} <= {("und", 0.0)} and len(out) == docs.count()


def test_sample_is_bounded(labelled):
    few = language.fit(labelled.where(~held_out()), sample=3)
    assert set(few[1]) <= set(SYLLABLES)


def test_query_on_held_out_documents(spark):
    out = queries.op12_centroid_languages(spark, SF)
    met = out.join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, total = met.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert total > 20 and right > 0.97
