"""Weights, cut and sample of the quality classifier against a plain version."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_text_operators import ODD, words

from tessera.llm import resampling
from tessera.llm.blocks import BLOCK, CLASS, hash_runs, mix



def plain_features(text: bytes) -> list[int]:
    """The buckets of a text's features, token by token."""
    one = lambda x: int(mix(np.array([int(x) % 2**64], np.uint64))[0])
    tokens, shapes = [], []
    for m in re.finditer(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s\x00\x1c-\x1f]+", text):
        t = m[0]
        h = int(hash_runs(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0])
        kind = 0
        for c in t:
            kind |= 1 if 97 <= c < 123 else 2 if 65 <= c < 91 else 4 if 48 <= c < 58 else 8 if c > 127 else 0
        mark = bool(CLASS[t[0]] == 2)
        shape = kind | 16 * mark | 32 * int(min(math.log2(len(t) + 1), 7)) | 256 * (65 <= t[0] < 91)
        shape += 1024 * t[0] if mark else 0
        tokens.append(h)
        shapes.append(one((shape | 512 * (len(tokens) > 1 and tokens[-2] == h)) + 1))
    g = 0x9E3779B97F4A7C15
    out = []
    for i in range(len(tokens)):
        feats = [tokens[i], shapes[i] + 1]
        feats += [tokens[i - 1] * g + tokens[i], shapes[i - 1] * g + shapes[i]] if i else [None] * 2
        feats.append((shapes[i - 2] * g + shapes[i - 1]) * g + shapes[i] if i > 1 else None)
        out += [one(one(f + k)) % resampling.BUCKETS for k, f in enumerate(feats) if f is not None]
    return out


TEXTS = [(t or "").encode() for _, t, *_ in ODD if t is None or len(t) < 20000] + [b"a a a, a a! b", b"x", b"!!! ??", b"Aa 1b\x00c\td  "]


def test_features_within_texts():
    for group in (1, 3, len(TEXTS)):
        for a in range(0, len(TEXTS), group):
            some = TEXTS[a : a + group]
            got = [[] for _ in some]
            for first, last, of, f in resampling._features(some):
                for i, x in zip(of.tolist(), f.tolist(), strict=True):
                    got[first + i].append(x)
                assert last <= len(some)
            assert [sorted(x) for x in got] == [sorted(plain_features(t)) for t in some]


def test_features_of_long_texts(monkeypatch):
    """Blocks overlap, so a long text has the features that it has in one block."""
    text = words(400, 5).encode() + b" end end end, " * 20 + words(300, 6).encode()
    monkeypatch.setattr(resampling, "BLOCK", 300)
    got = np.concatenate([f for *_, f in resampling._features([text, b"z"])])
    assert sorted(got.tolist()) == sorted(plain_features(text) + plain_features(b"z"))
    assert len(text) < BLOCK


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_weights_do_not_depend_on_neighbours(spark, sf, parts):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf}/labels.parquet")
    model = resampling.fit(docs, labels)
    rows = docs.orderBy(F.rand(3)).repartition(parts)
    got = {r.doc_id: r.log_weight for r in resampling.weighed(rows, model).select("doc_id", "log_weight").collect()}
    want = {r.doc_id: float(resampling.log_weights([(r.text or "").encode()], model.ratio)[0]) for r in docs.collect()}
    assert got == want


def test_sample_by_brute_force(spark):
    r = random.Random(2)
    good = lambda i: words(r.randint(5, 40), i) + "."
    junk = lambda: " ".join(r.choice(["$$$", "WIN", "!!", "0x9", "BUY"]) for _ in range(r.randint(5, 40)))
    rows = [(i, good(i) if i % 3 else junk()) for i in range(150)] + [(150, None), (151, " "), (None, good(7)), (3, junk()), (4, good(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 150, 2)] + [(4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    got = sorted((str(x.doc_id), x.log_weight, x.kept) for x in resampling.resample(docs, labels).collect())

    known = {i: int(i % 3 > 0) for i in range(0, 150, 2)} | {4: 0}
    raw, target = np.zeros(resampling.BUCKETS), np.zeros(resampling.BUCKETS)
    feats = [plain_features((t or "").encode()) for _, t in rows]
    for (i, _), f in zip(rows, feats, strict=True):
        for x in f:
            raw[x] += 1
            target[x] += known.get(i, 0)
    ratio = np.log((target + 1) / (target.sum() + len(raw))) - np.log((raw + 1) / (raw.sum() + len(raw)))
    weight = [sum(ratio[x] for x in f) if f else -math.inf for f in feats]
    noise = {x.doc_id: x.n for x in docs.select("doc_id", (-F.log(-F.log((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(0)), 12) + 0.5) / float(1 << 52)))).alias("n")).collect()}
    least: dict = {}
    for (i, _), w in zip(rows, weight, strict=True):
        if i in known:
            least[i] = min(least.get(i, math.inf), w)
    cut = resampling.best_cut(np.array([least[i] for i in known]), np.array([known[i] > 0 for i in known]))
    k = sum(w > cut for w in weight)
    keys = [w + noise[i] for (i, _), w in zip(rows, weight, strict=True)]
    limit = sorted(keys)[-k]
    want = sorted((str(i), w, key >= limit) for (i, _), w, key in zip(rows, weight, keys, strict=True))
    assert 60 < k < 140
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and a[2] == b[2] and (a[1] == b[1] or abs(a[1] - b[1]) < 1e-6)
