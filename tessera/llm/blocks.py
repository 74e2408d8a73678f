"""Vectorised work on UTF-8 bytes that the operators of this subpackage share.

All of it runs in blocks of bounded size, so memory doesn't follow the longest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh, stored  # noqa: F401

#: Words in a shingle, and the least similarity of near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Bytes that are hashed at once.
BLOCK = 1 << 19

_ODD = re.compile(r"[^\x00-\x7f\w]+")
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


_POW: np.ndarray | None = None
_INV: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None:
        _POW = _powers(_BASE, BLOCK + 2)
        _INV = _powers(pow(_BASE, -1, 1 << 64), BLOCK + 2)
    return _POW, _INV


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser of 64 bits: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Classes of bytes: 0 white space, 1 of words, 2 punctuation. Bytes of other alphabets count as words.
CLASS = np.full(256, 2, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32, 0, 28, 29, 30, 31]] = 0
CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = 1


def fold(text: str) -> bytes:
    """Lower case, and white space for punctuation outside ASCII."""
    text = text.lower()
    return text.encode() if text.isascii() else _ODD.sub(" ", text).encode(errors="replace")


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of at most BLOCK bytes in all, from prefix sums of a polynomial modulo 2^64."""
    pow_, inv = _tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pow_[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def hash_short_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As hash_runs, in bytes of any number, for runs in order that are much shorter than a BLOCK each."""
    if len(data) <= BLOCK:
        return hash_runs(data, starts, ends)
    out, i = [], 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + BLOCK, "right"))
        out.append(hash_runs(data[a : a + BLOCK], starts[i:j] - a, ends[i:j] - a))
        i = j
    return np.concatenate(out)


def runs(data: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs where wanted holds."""
    edge = np.flatnonzero(np.diff(wanted.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def _cuts(data: np.ndarray) -> list[int]:
    """Where to cut bytes into blocks, between words if a block has a gap."""
    cuts, at = [0], 0
    while len(data) - at > BLOCK:
        gaps = np.flatnonzero(CLASS[data[at + BLOCK // 2 : at + BLOCK]] != 1)
        at += BLOCK // 2 + int(gaps[-1]) if len(gaps) else BLOCK
        cuts.append(at)
    return [*cuts, len(data)]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word, in order. A word of over half a BLOCK may be cut into two."""
    all_ = np.frombuffer(data, np.uint8)
    cuts, out = _cuts(all_), []
    for a, b in zip(cuts, cuts[1:], strict=False):
        piece = all_[a:b]
        s, e = runs(piece, CLASS[piece] == 1)
        out.append(hash_runs(piece, s, e))
    return np.concatenate(out)


def grouped(texts: list[bytes], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to most bytes together, with a byte between; a longer text comes alone."""
    first = size = 0
    for i, x in enumerate(texts):
        if i > first and size + len(x) + 1 > most:
            yield first, i
            first, size = i, 0
        size += len(x) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and the offset of each text's first (with the end as last)."""
    out, counts = [np.empty(0, np.uint64)], []
    for a, b in grouped(texts):
        if b == a + 1:
            out.append(h := word_hashes(texts[a]))
            counts.append(len(h))
            continue
        data = np.frombuffer(b" ".join(texts[a:b]), np.uint8)
        ends = np.cumsum([len(x) + 1 for x in texts[a:b]])
        s, e = runs(data, CLASS[data] == 1)
        out.append(hash_runs(data, s, e))
        counts += np.diff(np.searchsorted(s, ends), prepend=0).tolist()
    return np.concatenate(out), np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype(np.int64)


def shingle_hashes(h: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k words in a row within each text, and offsets. A text of 1 to k - 1 words has one shingle, of all of them."""
    n = np.diff(offsets)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    out = np.empty(ends[-1], np.uint64)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            s *= np.uint64(_BASE)
            s += h[i : len(h) - k + 1 + i]
        long = np.flatnonzero(n >= k)
        where = np.repeat(offsets[:-1][long] - ends[:-1][long], counts[long]) + np.flatnonzero(np.repeat(n >= k, counts))
        out[np.repeat(n >= k, counts)] = s[where]
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = 0
        for w in h[offsets[i] : offsets[i + 1]].tolist():
            x = (x * _BASE + w + 1) % (1 << 64)
        out[ends[i]] = x
    return mix(out), ends


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cuts Arrow batches so that each holds about most bytes of a column, or one row; null stays None."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = 0
        ends = np.cumsum(sizes + 16)
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, "right")))
            part = batch.slice(first, last - first)
            yield part, part.column(at).to_pylist()
            first = last


#: Bits of filters that are sent to all tasks; their size doesn't grow with the data.
FILTER_BITS = 22


def in_filter(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """rows with a column `hit`: whether the value of a column may be among those of keys(key). Certain where false; equal values get equal answers."""
    bit = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - FILTER_BITS)
    words = keys.select(bit("key").alias("_b")).groupBy(F.shiftright("_b", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_b % 64 as int))")).alias("_bits"))
    # never empty, so that the plan, and the rows it makes, are alike whether there are keys or not
    words = words.unionByName(rows.sparkSession.range(1).select(F.lit(-1).cast("long").alias("_w"), F.lit(0).cast("long").alias("_bits")))
    held = rows.withColumn("_b", bit(column)).withColumn("_w", F.shiftright("_b", 6)).join(F.broadcast(words), "_w", "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_bits, cast(_b % 64 as int)) & 1L) = 1L"), F.lit(False))
    return held.withColumn("hit", hit).drop("_b", "_w", "_bits")


#: A key with more rows than this is dealt over PARTS tasks when it is joined.
CROWDED, PARTS = 1000, 32


def join_crowded(rows: DataFrame, facts: DataFrame, key: str, count: str, by: str) -> DataFrame:
    """rows joined with facts, which has one row for each key and in `count` its number of rows. The rows of crowded keys are dealt by a hash of the column `by` over PARTS tasks, to each of
    which their fact goes; a filter of fixed size tells both sides which keys these are."""
    crowded = facts.where(F.col(count) > CROWDED).select(F.col(key).alias("key"))
    part = F.when(F.col("hit"), F.pmod(F.xxhash64(by), F.lit(PARTS))).otherwise(F.lit(0).cast("long"))
    many = in_filter(rows, key, crowded).withColumn("_part", part).drop("hit")
    parts = F.when(F.col("hit"), F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    one = in_filter(facts, key, crowded).withColumn("_part", F.explode(parts)).drop("hit")
    return many.join(one, [key, "_part"]).drop("_part")


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: long texts must not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
