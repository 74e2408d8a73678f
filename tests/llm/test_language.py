"""Vectors, sample, centroids and choice of the language identification against a plain version."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_text_operators import words

from tessera.llm import language


def plain_counts(text: str) -> np.ndarray:
    """Counts of a text's n-grams, byte by byte."""
    data = [b if b > 127 or 97 <= b < 123 else 0 for b in text.lower().encode()] + [0, 0]
    out = np.zeros(language.DIMS)
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        out[a] += 1
        out[256 + ((a + (b << 8)) * 0x9E3779B1 % 2**32 >> 19) % 2048] += 1
        out[2304 + ((a + (b << 8) + (c << 16)) * 0x85EBCA77 % 2**32 >> 16) % (language.DIMS - 2304)] += 1
    out[0] = 0
    return out


def test_counts(monkeypatch):
    texts = ["", "a", "Ab, cd!", "é漢 x", words(60, 3), words(9, 4) + " end"]
    for block in (language.BLOCK, 7):
        monkeypatch.setattr(language, "BLOCK", block)
        for group in (texts, *[[t] for t in texts]):
            got = np.concatenate([s for *_, s in language.counted(language.folded(group))])
            assert (got == np.array([plain_counts(t) for t in group])).all()


def test_every_language_is_learned(spark):
    """Many copies of few texts are a language too, and rows in another order give the same model."""
    rows = [("aa", words(20, i % 3)) for i in range(4000)] + [("bb", " ".join("uvwxyz"[(i * j) % 6] * (1 + j % 3) for j in range(30)) + str(i)) for i in range(700)] + [(None, "x"), ("bb", None)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model, again = language.fit(docs), language.fit(docs.orderBy(F.rand(1)).repartition(5))
    assert set(model.langs) == {"aa", "bb"} and model.langs == again.langs and (model.centers == again.centers).all() and model.floor == again.floor
    chosen = language._sample(docs.where("lang is not null and text is not null")).collect()
    assert len({r.text for r in chosen if r.lang == "aa"}) == 3 and sum(r.lang == "bb" for r in chosen) == language.SAMPLE
    least = sorted(r.h for r in docs.where("lang = 'bb' and text is not null").select(F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h")).distinct().collect())[: language.SAMPLE]
    assert sorted(r.h for r in chosen if r.lang == "bb") == least


def test_choice_by_brute_force(spark):
    train = [("aa", words(25, i)) for i in range(40)] + [("bb", words(25, 500 + i).translate(str.maketrans("abcdefghij", "klmnopqrst"))) for i in range(30)]
    docs = spark.createDataFrame(train, "lang string, text string")
    model = language.fit(docs)
    df = np.sum([plain_counts(t) > 0 for _, t in train], 0)
    assert np.allclose(model.idf, np.log((1 + len(train)) / (1 + df)))

    def vector(t):
        v = [math.log(1 + c) * w for c, w in zip(plain_counts(t), model.idf.tolist(), strict=True)]
        n = math.sqrt(sum(x * x for x in v))
        return [x / max(n, 1e-9) for x in v]

    assert 1 < len(model.centers) <= 2 * language.CENTROIDS
    near = [max(sum(x * y for x, y in zip(vector(t), c.tolist(), strict=True)) for c in model.centers) for _, t in train]
    assert abs(model.floor - np.quantile(near, language.REJECT)) < 1e-5
    texts = [*[t for _, t in train[::9]], "123 !!", None, "zzz yyy", words(3, 4), words(3, 4)]
    got = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r in got:
        if r.text is None or not re.search("[a-z]", r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        cos = [sum(x * y for x, y in zip(vector(r.text), c.tolist(), strict=True)) for c in model.centers]
        best = int(np.argmax(cos))
        assert r.lang_pred == model.langs[best] and r.score == pytest.approx(min(max(cos[best], 0), 1), abs=1e-5)
        if abs(r.score - model.floor) > 1e-5:
            assert r.rejected == (r.score < model.floor)
