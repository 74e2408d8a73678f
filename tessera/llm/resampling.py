"""Quality classifier: importance resampling of documents towards a target.

Two generative models, bags of hashed n-grams, are fitted: one to the target (labelled rows of good
quality) and one to the raw text (all rows). A document's log weight is the sum over its n-grams of
log(target / raw). Gumbel noise, seeded by the document's id, is added to it, and the k largest
sums are kept, which is sampling k documents without replacement in proportion to their weights. k
is not a share given in advance: it is the number of documents whose log weight is over the cut that
separates the labelled sample, so a corpus without junk keeps its documents.

Features: tokens (runs of word bytes or of punctuation, case kept) hashed alone and in pairs, and
the shapes of tokens (case, digits, kind, length class, whether a token repeats the one before it)
alone, in pairs and in threes, all within one text. Whole texts are read, long ones in blocks that are cut between tokens and overlap by
two (only a token of over half a BLOCK may be cut). A text's weight depends on the text and the models alone. Texts are read twice, for the counts and for the weights, and
once more where whole rows are returned.

Defined results: null, empty and blank texts have weight -inf and are rejected. Copies of a row are
kept or rejected together, as their id seeds their noise (rows without id have one noise); rows that tie with the k-th sum are kept
too. Where an id is labelled twice, its least quality counts; where it has several texts, all count for the target and the least weight for the cut. Without any labelled target, and in an empty table,
nothing is rejected. Other columns pass through; the operator's
own are named log_weight, sample_key and kept, and replace those of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK, CLASS, grouped, hash_runs, mix, prepare, slices, stored

#: Buckets of hashed n-grams.
BUCKETS = 1 << 15
#: The most labelled rows that the target model and the cut are fitted to; a fixed sample by hash of the id.
MOST_LABELLED = 20_000
#: Added to every bucket's count, so that no ratio is infinite.
PRIOR = 1.0

_KIND = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 4 digit, 8 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 4, 8


def _tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token starts, its hash, and its shape's bits."""
    kind = CLASS[data]
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)) != 0)
    starts = edge[kind[edge] != 0]
    ends = np.append(edge[1:], len(data))[kind[edge] != 0]
    if not len(starts):
        return starts, starts.astype(np.uint64), starts.astype(np.uint64)
    token = hash_runs(data, starts, ends)
    # reduceat runs to the next start, over white space, which adds no bits
    shape = np.bitwise_or.reduceat(_KIND[data], starts).astype(np.uint64)
    punctuation = kind[starts] == 2
    shape |= (np.uint64(16) * punctuation) | (np.uint64(32) * np.minimum(np.log2(ends - starts + 1), 7).astype(np.uint64))
    shape |= np.uint64(256) * ((_KIND[data[starts]] & 2) > 0)
    shape[punctuation] += np.uint64(1024) * data[starts][punctuation].astype(np.uint64)
    return starts, token, shape


_M = np.uint64(0x9E3779B97F4A7C15)


def _grams(token: np.ndarray, bits: np.ndarray, of: np.ndarray, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Text and bucket of each feature that ends after the first `carried` tokens; of: each token's text."""
    two = np.flatnonzero(of[1:] == of[:-1]) + 1  # tokens with one before them in their text
    three = np.flatnonzero(of[2:] == of[:-2]) + 2
    same = np.zeros(len(token), np.uint64)
    same[two] = token[two] == token[two - 1]
    shape = mix((bits | np.uint64(512) * same) + np.uint64(1))
    one = np.arange(carried, len(token))
    two, three = two[two >= carried], three[three >= carried]
    feats = [token[one], shape[one] + np.uint64(1), token[two - 1] * _M + token[two], shape[two - 1] * _M + shape[two], (shape[three - 2] * _M + shape[three - 1]) * _M + shape[three]]
    bucket = mix(np.concatenate([mix(h + np.uint64(i)) for i, h in enumerate(feats)])) % np.uint64(BUCKETS)
    return np.concatenate([of[one], of[one], of[two], of[two], of[three]]), bucket.astype(np.int64)


def _blocks(x: np.ndarray):
    """Blocks of a long text, cut between tokens where a token allows it."""
    at = 0
    while len(x) - at > BLOCK:
        edges = np.flatnonzero(np.diff(CLASS[x[at + BLOCK // 2 : at + BLOCK]]))
        cut = at + BLOCK // 2 + int(edges[-1]) + 1 if len(edges) else at + BLOCK
        yield x[at:cut]
        at = cut
    yield x[at:]


def _features(texts: list[bytes]):
    """(index of the first text, index after the last, text of each feature, bucket of each feature); a long text comes in pieces."""
    for a, b in grouped(texts):
        if b > a + 1:
            starts, token, bits = _tokens(np.frombuffer(b" ".join(texts[a:b]), np.uint8))
            yield a, b, *_grams(token, bits, np.searchsorted(np.cumsum([len(x) + 1 for x in texts[a:b]]), starts, "right"))
            continue
        token = bits = np.empty(0, np.uint64)
        for piece in _blocks(np.frombuffer(texts[a], np.uint8)):
            # three tokens are carried: whether the first of the last two repeats the one before it counts in features to come
            carried, (_, t, k) = len(token), _tokens(piece)
            token, bits = np.concatenate([token, t]), np.concatenate([bits, k])
            yield a, b, *_grams(token, bits, np.zeros(len(token), np.int64), carried)
            token, bits = token[-3:], bits[-3:]


@dataclass
class Model:
    """ratio: log(target / raw) by bucket; known: the labelled rows of the sample (doc_id, quality)."""

    ratio: np.ndarray | None
    known: pd.DataFrame


def _counts(docs: DataFrame, good: frozenset) -> tuple[np.ndarray, np.ndarray]:
    """Features of all rows and of the rows with a good id, by bucket."""

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, texts in slices(batches, "text"):
            is_good = np.array([i in good for i in part.column(part.schema.get_field_index("doc_id")).to_pylist()], bool)
            for a, b, of, f in _features([x or b"" for x in texts]):
                raw += np.bincount(f, minlength=BUCKETS)
                target += np.bincount(f[is_good[a:b][of]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).toPandas().to_numpy()  # BUCKETS rows at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[sums[:, 0].astype(int)], target[sums[:, 0].astype(int)] = sums[:, 1], sums[:, 2]
    return raw, target


def log_weights(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    """The log weight of each text."""
    out, some = np.zeros(len(texts)), np.zeros(len(texts), bool)
    for a, b, of, f in _features(texts):
        out[a:b] += np.bincount(of, ratio[f], minlength=b - a)
        some[a:b] |= np.bincount(of, minlength=b - a) > 0
    return np.where(some, out, -np.inf)


def _weight(ratio: np.ndarray):
    @F.pandas_udf("double")
    def weight(text: pd.Series) -> pd.Series:
        return pd.Series(log_weights([x if isinstance(x, bytes) else b"" for x in text], ratio))

    return weight(F.col("text").cast("binary"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both n-gram models: the raw one over all rows, the target's from a bounded sample of labelled rows."""
    prepare(docs.sparkSession)
    sample = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED).toPandas()
    good = frozenset(sample.doc_id[sample.quality > 0].tolist())
    if not good:
        return Model(None, sample)
    raw, target = _counts(docs, good)
    if not target.sum():
        return Model(None, sample)
    p, q = (target + PRIOR) / (target.sum() + PRIOR * BUCKETS), (raw + PRIOR) / (raw.sum() + PRIOR * BUCKETS)
    return Model(np.log(p / q), sample)


def cut_of(weights: DataFrame, model: Model) -> float:
    """The log weight that separates the labelled sample best; weights: (doc_id, log_weight) of all rows."""
    known = weights.sparkSession.createDataFrame(model.known.astype({"doc_id": "int64", "quality": "int32"}))  # MOST_LABELLED rows at most
    got = weights.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w"), F.first("quality").alias("quality")).toPandas()
    return best_cut(got.w.to_numpy(), got.quality.to_numpy() > 0)


def best_cut(w: np.ndarray, good: np.ndarray, slack: float = 0.01) -> float:
    """The lowest cut for which the share of junk caught, less that of good rows lost, is within slack of the largest: in doubt a row stays."""
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(w)
    w, good = w[order], good[order]
    gain = np.cumsum(~good) / (~good).sum() - np.cumsum(good) / good.sum()
    gain[:-1][w[:-1] == w[1:]] = -1
    i = int(np.argmax(gain >= gain.max() - slack))
    return float(w[i] if i + 1 == len(w) or np.isinf(w[i]) else (w[i] + w[i + 1]) / 2)


def kth_largest(keys: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """Exact k-th largest value of a column: counts by bin, and again within the bin that holds it. The driver gets at most bins counts a round."""
    finite = keys.where(F.col(column) > float("-inf"))
    lo, hi, n = finite.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0:
        return float("inf")
    if k >= n or lo is None:
        return float("-inf") if k > n else float(lo)
    while True:
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            return lo
        here = finite.where(F.col(column).between(lo, hi))
        got = here.groupBy(F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).orderBy(F.desc("bin")).collect()
        for row in got:
            if k <= row.n:
                break
            k -= row.n
        if row.lo == row.hi or k == row.n:
            return row.lo
        if k == 1:
            return row.hi
        lo, hi = row.lo, row.hi


def weighed(docs: DataFrame, model: Model, seed: int = 0) -> DataFrame:
    """Adds log_weight, and sample_key: that and Gumbel noise from the row's id."""
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))
    w = F.lit(0.0) if model.ratio is None else _weight(model.ratio)
    return docs.withColumn("log_weight", w).withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform)))


def resample(docs: DataFrame, labels: DataFrame, seed: int = 0, columns: list[str] | None = None) -> DataFrame:
    """Every row with its columns (or doc_id and those given), log_weight, sample_key and kept.

    Weights are stored with the ids alone. Where more columns are wanted, they are worked out again for the rows, to the same values, which takes less disk than storing whole rows.
    """
    own = ["log_weight", "sample_key"]
    columns = [c for c in (docs.columns if columns is None else ["doc_id", *columns]) if c not in (*own, "kept")]
    model = fit(docs, labels)
    rows = weighed(docs, model, seed).select(*columns, *own)
    if model.ratio is None:
        return rows.withColumn("kept", F.lit(True))
    weights = stored(weighed(docs.select("doc_id", "text"), model, seed).select("doc_id", *own), "weights")
    k = weights.where(F.col("log_weight") > cut_of(weights, model)).count()
    return (weights if columns == ["doc_id"] else rows).withColumn("kept", F.col("sample_key") >= kth_largest(weights, "sample_key", k))
