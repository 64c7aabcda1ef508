"""Languages: held-out accuracy on the given documents, plain n-gram counts, rejection, and awkward tables."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rowgrain.llm import language
from helpers import awkward, nothing

HELD = "/root/testdata/sf0.01/documents.parquet"


def made(n=60, seed=1):
    """Two invented languages."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        lang, letters = (("x", "abcde ") if i % 2 else ("y", "vwxyz "))
        rows.append((i, "".join(draw.choice(letters) for _ in range(200)), lang))
    return rows


def test_counts_of_n_grams_in_slices(monkeypatch):
    grams = language.Grams(1 << 20)  # few collisions
    text = "Don't, Éa  42 日本ab!x"
    words = "don t éa 日本ab x"
    padded = f" {words} "
    letters = [c for c in padded[1:]]
    expected = Counter(letters) + Counter(zip(padded, padded[1:])) + Counter(zip(padded, padded[1:], padded[2:]))
    whole = grams.counts(text)
    assert sorted(whole[whole > 0].tolist()) == sorted(expected.values())
    monkeypatch.setattr(language, "SLICE", 3)
    assert (grams.counts(text) == whole).all()
    assert grams.counts("12 !?") is None and grams.counts(None) is None and grams.counts("") is None


def test_limits_by_length():
    how = language.Centroids(least=3, tail=0.0, slack=1.0)
    out = language.limits(np.array([0.3, 0.2, 0.1, 0.05]), np.array([4, 4, 4, 6]), how)
    assert out[:4].tolist() == [1.0] * 4 and out[4] == pytest.approx(0.3) and out[6] == pytest.approx(0.3)


def test_held_out_documents(spark):
    docs = spark.read.parquet(HELD)
    got = {r.doc_id: r for r in language.predicted(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    right = held = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= g.score <= 1
        assert g.lang_pred in {"en", "de", "fr", "es"} or not any(map(str.isalpha, r.text or ""))
        if g.held_out and r.lang is not None:
            held, right = held + 1, right + (g.lang_pred == r.lang)
    assert held > 100 and right >= 0.98 * held


def test_only_text_and_labels_outside_the_held_out_part_count(spark):
    rows = made(200)
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    # Labels of held-out rows may say anything.
    wrong = spark.createDataFrame([(i, t, "zz" if i in held else lang) for i, t, lang in rows], base.schema)
    key = lambda df: {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predicted(df).collect()}
    got = key(base)
    assert got == key(wrong)
    assert all(got[i][0] == lang for i, _, lang in rows)


def test_far_texts_are_rejected(spark):
    how = language.Centroids(least=5)
    docs = spark.createDataFrame(made(200), "doc_id long, text string, lang string")
    model = language.fit(docs, how)
    # About as long as the texts learnt from, of other letters.
    strange = spark.createDataFrame([(900, "mnopqrst " * 22, None), (901, made(2)[1][1], None), (902, "12 34", None)], docs.schema)
    near = {r.doc_id: r for r in language.identify(strange, model, how).collect()}
    assert near[900].rejected and near[900].lang_pred in ("x", "y")
    assert not near[901].rejected and near[901].lang_pred == "x" and near[902].lang_pred == "und" and near[902].score == 0
    named = {r.doc_id: r for r in language.identify(strange, model, how, name_rejected=False).collect()}
    assert named[900].lang_pred == "und" and named[900].score == 0 and named[901].lang_pred == "x"


def test_bounds_of_the_fit(spark):
    # One number with many rows and one frequent language: at most ten texts of each are learnt from.
    rows = made(40) + [(3, "abc dea " * 10, "x")] * 500
    how = language.Centroids(per_language=10, least=2)
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), how)
    assert model.languages == ["x", "y"] and len(model.owner) <= 8
    with pytest.raises(ValueError):
        language.fit(spark.createDataFrame([(i, "abc", f"l{i}") for i in range(30)], "doc_id long, text string, lang string"), language.Centroids(languages=5))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    got = language.predicted(docs).collect()
    given = docs.collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in given)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[2].lang_pred == "und" and by_id[6].lang_pred == "en"
    assert language.predicted(nothing(spark)).collect() == []
    none = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.predicted(none).collect()} == {("und", 0.0)}
