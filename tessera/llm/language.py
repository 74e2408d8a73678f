"""Language identification by nearest centroid.

A text is a vector of hashed n-grams of 1, 2 and 3 bytes of its lower-cased letters, weighted by
TF-IDF and scaled to length 1. Each language has several centroids, from spherical k-means over a
bounded sample of its texts, as a language is often more than one kind of text. A text gets the
language of the centroid with the largest cosine; texts that are farther from every centroid than
nearly all of the sample are marked as rejected.

Defined results: `und` with score 0 where the text is null or has no letter, or where nothing was
learned. Whole texts are read; long ones in blocks that overlap, so no n-gram is lost. Copies get equal results, and count once in the sample. Rows without id are
rows like others. A text that is labelled with several languages counts for each. An empty table gives no rows, and nothing is learned from it. Other columns pass through; lang_pred,
score and rejected replace columns of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import BLOCK, grouped, prepare, stored

#: Dimensions of a vector, centroids of a language, and how many different texts of a language k-means gets at most.
DIMS, CENTROIDS, SAMPLE = 1 << 13, 4, 300
#: This share of the sample lies farther away than what is not rejected.
REJECT = 0.002
_LETTER = re.compile(r"[^\W\d_]")
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)
_GROUP = 256


def _grams(data: np.ndarray) -> np.ndarray:
    """Three dimensions for each byte: of the n-grams that begin there. 0 stands for whatever isn't a letter."""
    c = _CODE[data]
    out = np.empty((3, len(c)), np.int32)
    out[0] = c
    two = c.copy()
    two[:-1] += c[1:] << np.uint32(8)
    three = two.copy()
    three[:-2] += c[2:] << np.uint32(16)
    out[1] = 256 + ((two * np.uint32(0x9E3779B1)) >> np.uint32(19)) % np.uint32(2048)
    out[2] = 2304 + ((three * np.uint32(0x85EBCA77)) >> np.uint32(16)) % np.uint32(DIMS - 2304)
    return out


def counted(texts: list[bytes]):
    """(first, after, counts of n-grams as float32 rows) over groups of texts."""
    for a, b in grouped(texts):
        for first in range(a, b, _GROUP):
            last = min(first + _GROUP, b)
            n, sums = last - first, None
            if n == 1:
                x = np.frombuffer(texts[first], np.uint8)
                sums = np.zeros((1, DIMS), np.float32)
                for i in range(0, len(x), BLOCK):  # two bytes more, for the n-grams that reach beyond
                    sums[0] += np.bincount(_grams(x[i : i + BLOCK + 2])[:, :BLOCK].ravel(), minlength=DIMS)
            else:
                data = np.frombuffer(b"\0\0\0".join(texts[first:last]), np.uint8)
                of = np.repeat(np.arange(n, dtype=np.int32), [len(x) + 3 for x in texts[first : last - 1]] + [len(texts[last - 1])])
                g = _grams(data)
                ends = np.flatnonzero(np.diff(of))
                g[:, np.concatenate([ends, ends - 1, ends - 2])] = 0  # what begins between texts belongs to none
                sums = np.zeros(n * DIMS, np.float32)
                for row in g:
                    sums += np.bincount(of * DIMS + row, minlength=n * DIMS)
                sums = sums.reshape(n, DIMS)
            sums[:, 0] = 0
            yield first, last, sums


def folded(texts) -> list[bytes]:
    return [x.lower().encode(errors="replace") if isinstance(x, str) else b"" for x in texts]


@dataclass
class Centroids:
    idf: np.ndarray
    centers: np.ndarray
    langs: list[str]
    floor: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)


def _kmeans(v: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each further one the vector farthest from those so far."""
    centers = [v.mean(0)]
    for _ in range(min(k, len(v)) - 1):
        centers.append(v[np.argmin(np.max(v @ np.array(centers).T, 1))])
    c = np.array(centers)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        own = np.argmax(v @ c.T, 1)
        c = np.array([v[own == i].mean(0) if (own == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def _sample(docs: DataFrame) -> DataFrame:
    """(lang, h, text) of the SAMPLE different texts of each language whose hashes are the least. Copies are added up first, and of many hashes only the least, about three times as many as are wanted, are ranked."""
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)
    hashes = stored(docs.select("lang", h.alias("h")).distinct(), "hashes")
    sizes = {r.lang: r["count"] for r in hashes.groupBy("lang").count().collect()}
    if not sizes:
        return docs.withColumn("h", h).limit(0)
    bar = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(2**63 - 1, int(2**63 * 3 * SAMPLE / n)))])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashes.where(F.col("h") <= bar[F.col("lang")]).withColumn("nth", nth).where(F.col("nth") <= SAMPLE).select("lang", "h")  # SAMPLE rows a language
    return docs.withColumn("h", h).join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def fit(docs: DataFrame) -> Centroids | None:
    """Document frequencies over all rows of docs(text, lang); centroids from at most SAMPLE different texts of each language."""
    prepare(docs.sparkSession)
    docs = docs.where("lang is not null and text is not null").select("text", "lang")

    def frequencies(batches):
        df, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for a, b, sums in counted(folded(batch["text"])):
                df += (sums > 0).sum(0)
                n += b - a
        yield pd.DataFrame({"dim": np.arange(-1, DIMS), "n": np.concatenate([[n], df])})

    got = dict(docs.select("text").mapInPandas(frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n")).collect())
    if not got.get(-1):
        return None
    idf = np.log((1 + got[-1]) / (1 + np.array([got[i] for i in range(DIMS)]))).astype(np.float32)
    model = Centroids(idf, np.empty((0, DIMS), np.float32), [], -1.0)
    sample = stored(_sample(docs), "sample")

    def centers(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h")
        v = model.vectors(np.concatenate([sums for *_, sums in counted(folded(rows["text"]))]))
        c = _kmeans(v, CENTROIDS).astype("<f4")
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "i": np.arange(len(c)), "center": [x.tobytes() for x in c]})

    found = sample.groupBy("lang").applyInPandas(centers, "lang string, i int, center binary").orderBy("lang", "i").collect()  # CENTROIDS rows a language
    model.langs = [r.lang for r in found]
    model.centers = np.array([np.frombuffer(r.center, "<f4") for r in found])

    def nearest(batches):
        for batch in batches:
            for *_, sums in counted(folded(batch["text"])):
                yield pd.DataFrame({"cos": (model.vectors(sums) @ model.centers.T).max(1).astype(float)})

    model.floor = float(np.quantile([r.cos for r in sample.select("text").mapInPandas(nearest, "cos double").collect()], REJECT))
    return model


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """Adds lang_pred, score (the cosine) and rejected."""
    prepare(docs.sparkSession)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text: pd.Series) -> pd.DataFrame:
        texts = folded(text)
        lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        has = np.array([isinstance(x, str) and _LETTER.search(x) is not None for x in text], bool)
        if model is not None:
            names = np.array(model.langs, object)
            for a, b, sums in counted(texts):
                cos = model.vectors(sums) @ model.centers.T
                best = cos.argmax(1)
                lang[a:b], score[a:b] = names[best], np.round(np.clip(cos[np.arange(b - a), best].astype(float), 0, 1), 6)
        lang[~has], score[~has] = "und", 0.0
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": ~has | (score < (model.floor if model else 1))})

    return docs.withColumn("_got", predict("text")).withColumns({c: F.col("_got")[c] for c in ("lang_pred", "score", "rejected")}).drop("_got")
