"""Benchmark decontamination: find documents that hold a benchmark item.

Every item has a SimHash of its weighted five-word shingles. A document is read in windows of the item's
own size; a window's SimHash is the sign of sums of its shingles' weighted bits, taken as differences
of prefix sums. Fingerprints are looked up in a multi-index: 64 bits are cut into 8 blocks, and each block
value points to the items whose block differs in at most RADIUS // 8 bits. By the pigeonhole principle
that finds every item within RADIUS bits. Each candidate is then verified by the exact weighted
similarity: the weight of the item's shingles that the window has, as a share of all of the item's weight. Shingles
that many items share weigh less.

A window without any shingle of any item has similarity 0, so fingerprints are only made for windows
that overlap such a shingle; this loses nothing and keeps clean text cheap.

Where all shingles of an item weigh the same, at a true similarity of 0.8 the two fingerprints are expected to differ in
13 of 64 bits with a deviation of 3.2, so RADIUS = 23 passes all but about one in a thousand of the weakest pairs. Where
weights differ (items share boilerplate) or shingles repeat, fingerprints of similar texts can lie further apart. So the
least cosine that a similarity of 0.8 allows is worked out for each item, and items for which it is below 0.8 are uneven. These
are found by a list of their heaviest shingles as well: those that together hold over a fifth of the item's weight, of which any
similar window has one. That loses nothing.

The index of items goes to every task. Its size is bounded: benchmarks of more than SLICE characters are
cut into slices by hash (an item stays whole), and documents are searched for one slice after the other; the result of each is written to the shared
folder, so the driver holds one index at a time. Frequencies of shingles, and so weights, are those of all items, whatever the slices.
Texts are searched in stretches of bounded length, and windows are compared with items in tables of bounded size.

A text of fewer shingles than an item is one window for it.

Defined results: null and empty texts and items match nothing. Items of fewer than five words match
where their words occur in a row. Repeated rows are reported each, and so are repeated items, whether they share an id, lack one or not. Null ids stay null. Whole
texts are read. Columns other than doc_id and text are left out of contaminated(), and pass through decontaminate().
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .blocks import SHINGLE, SIMILAR, fold, grouped, mix, prepare, shingle_hashes, slices, stored, words_of

RADIUS, BLOCKS = 23, 8
#: Characters of items whose index is sent to the tasks at once.
SLICE = 4 << 20
#: Shingles of a text that are searched at once, and cells of a table of windows and items.
STRETCH, CELLS = 1 << 13, 1 << 22
_FILTER_BITS = 22
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_M = np.uint64(0x9E3779B97F4A7C15)


def _bits(shingles: np.ndarray) -> np.ndarray:
    """The 64 bits of each shingle's own hash as +1 and -1."""
    h = mix(shingles + np.uint64(0x1234567))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1)


def _row(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k words in a row, for items of fewer words than a shingle."""
    s = np.zeros(max(len(h) - k + 1, 0), np.uint64)
    for i in range(k):
        s = s * _M + h[i : len(h) - k + 1 + i] + np.uint64(1)
    return mix(s)


@dataclass
class Index:
    """Items by their number of shingles, told apart by their place among ids; see build."""

    ids: list
    weight: dict[int, float]
    most: float
    known: np.ndarray
    filter: np.ndarray
    by_size: dict[int, tuple]
    short: dict[int, dict[int, list]]
    lists: dict[int, list]

    def hits(self, s: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        maybe = np.flatnonzero(self.filter[s >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe):
            return maybe
        at = np.minimum(np.searchsorted(self.known, s[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == s[maybe]]


def least_cosine(w: np.ndarray, most: float) -> float:
    """A bound of the cosine of an item (the weights of its shingles) with a window of similarity SIMILAR, whose foreign shingles weigh at most most."""
    w = np.sort(w.astype(np.float64))
    lost = (1 - SIMILAR) * w.sum() + 1e-9
    foreign = int((np.cumsum(w) <= lost).sum())
    heavy = w[::-1]
    take = np.clip((lost - np.concatenate([[0], np.cumsum(heavy)[:-1]])) / heavy, 0, 1)
    own = float((heavy * heavy * (1 - take)).sum())
    return float(own / np.sqrt((w * w).sum() * (own + foreign * most * most)))


def build(items: list[tuple], frequency: dict[int, int] | None = None, n_items: int | None = None) -> Index:
    """The index of (item_id, text) pairs. frequency: in how many of n_items items each shingle is, if there are more than these."""
    items = [(i, t) for i, t in items if t]
    ids = [i for i, _ in items]
    h, off = words_of([fold(t) for _, t in items])
    short: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
    long = []
    for i, (a, b) in enumerate(zip(off, off[1:], strict=False)):
        if 0 < b - a < SHINGLE:
            short[int(b - a)][int(_row(h[a:b], int(b - a))[0])].append(i)
        elif b > a:
            long.append((i, shingle_hashes(h[a:b], np.array([0, b - a]))[0]))
    n = len(long) if n_items is None else n_items
    df = Counter(x for _, s in long for x in set(s.tolist()))
    weight = {x: float(np.log1p(n / (k if frequency is None else frequency[x]))) for x, k in df.items()}
    known = np.array(sorted(weight), np.uint64)
    filter_ = np.zeros(1 << _FILTER_BITS, bool)
    filter_[known >> np.uint64(64 - _FILTER_BITS)] = True
    groups = defaultdict(list)
    for i, s in long:
        groups[len(s)].append((i, s))
    most = float(np.log1p(max(n, 1)))
    by_size: dict[int, tuple] = {}
    lists: dict[int, list] = defaultdict(list)
    for m, group in groups.items():
        prints, exact = [], []
        for j, (_, s) in enumerate(group):
            w = np.array([weight[x] for x in s.tolist()], np.float32)
            prints.append(_pack((_bits(s) * w[:, None]).sum(0)[None])[0])
            exact.append((Counter(s.tolist()), float(w.sum())))
            counts, total = exact[-1]
            if len(counts) < m or least_cosine(w, most) < SIMILAR - 1e-6:
                held = 0.0
                for x in sorted(counts, key=lambda x: (-weight[x], x)):
                    lists[x].append((m, j))
                    held += counts[x] * weight[x]
                    if held > (1 - SIMILAR) * total + 1e-6 * total:
                        break
        prints = np.array(prints)
        near = np.array([_POP[np.arange(256, dtype=np.uint8)[:, None] ^ prints[None, :, b]] <= RADIUS // BLOCKS for b in range(BLOCKS)])
        by_size[m] = ([i for i, _ in group], prints, near, exact)
    return Index(ids, weight, most, known, filter_, by_size, {k: dict(v) for k, v in short.items()}, dict(lists))


def _regions(hits: np.ndarray, reach: int, end: int) -> list[tuple[int, int]]:
    """Ranges of shingles within reach of hits."""
    lo, hi = np.maximum(hits - reach, 0), np.minimum(hits + reach + 1, end)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), np.append(hi[new[1:] - 1], hi[-1]).tolist(), strict=True))


def _covering(part: np.ndarray, own: np.ndarray, index: Index, item: tuple, m: int, start: np.ndarray) -> np.ndarray:
    """Which windows of m shingles may cover enough of an item's weight: by sums that count repeated shingles each time."""
    counts, total = item
    gain = np.zeros(len(part) + 1)
    gain[own + 1] = [index.weight[x] if x in counts else 0.0 for x in part[own].tolist()]
    gain = np.cumsum(gain)
    return np.flatnonzero(gain[start + m] - gain[start] >= SIMILAR * total - 1e-6 * total)


def _near(f: np.ndarray, prints: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints and items that share a block and lie within RADIUS, and how many bits differ."""
    found = []
    for a in range(0, len(f), step := max(1, CELLS // max(len(prints), 1))):
        part = f[a : a + step]
        maybe = near[0][part[:, 0]].copy()
        for k in range(1, BLOCKS):
            maybe |= near[k][part[:, k]]
        w, i = np.nonzero(maybe)
        bits = _POP[part[w] ^ prints[i]].sum(1)
        ok = bits <= RADIUS
        found.append((w[ok] + a, i[ok], bits[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3


def _search(s: np.ndarray, hits: np.ndarray, index: Index) -> dict[int, tuple]:
    """For one text's shingles: item -> (similarity, differing bits, first word, words) of its best window."""
    best: dict[int, tuple] = {}
    reach = max(index.by_size)
    for first, end in _regions(hits, reach, len(s)):
        for a in range(first, end, STRETCH):  # windows that start in a stretch
            _search_part(s[a : min(a + STRETCH + reach, end)], a, min(STRETCH, end - a), len(s), hits[(hits >= a) & (hits < min(a + STRETCH + reach, end))] - a, index, best)
    return best


def _search_part(part: np.ndarray, a: int, starts: int, n: int, own: np.ndarray, index: Index, best: dict[int, tuple]) -> None:
    """Windows that start among the first `starts` shingles of a part, which begins at shingle a of a text of n."""
    if not len(own):
        return
    weights = np.array([index.weight.get(x, index.most) for x in part.tolist()], np.float32)
    sums = np.concatenate([np.zeros((1, 64), np.float64), np.cumsum(_bits(part) * weights[:, None], axis=0, dtype=np.float64)])
    seen = np.zeros(len(part) + 1, np.int64)
    seen[own + 1] = 1
    seen = np.cumsum(seen)
    listed = defaultdict(set)  # uneven items by size
    for x in set(part[own].tolist()) & index.lists.keys():
        for m, j in index.lists[x]:
            listed[m].add(j)
    for size, (items, prints, near, exact) in index.by_size.items():
        m = min(size, n)  # a text shorter than the item is one window
        if m > len(part):
            continue
        start = np.flatnonzero(seen[m:] - seen[:-m] > 0)  # windows with a shared shingle
        start = start[start < starts]
        f = _pack(sums[start + m] - sums[start])
        w, i, bits = _near(f, prints, near)
        if listed[size]:
            alone = np.isin(i, list(listed[size]), invert=True)
            more = [(w[alone], i[alone], bits[alone])]
            for j in sorted(listed[size]):
                at = _covering(part, own, index, exact[j], m, start)
                more.append((at, np.full(len(at), j), _POP[f[at] ^ prints[j]].sum(1)))
            w, i, bits = (np.concatenate(x) for x in zip(*more, strict=True))
        for p, j, d in zip(start[w].tolist(), i.tolist(), bits.tolist(), strict=True):
            counts, total = exact[j]
            got = Counter(part[p : p + m].tolist())
            sim = sum(index.weight[x] * min(k, got[x]) for x, k in counts.items() if x in got) / total
            if sim >= SIMILAR - 1e-9 and sim > best.get(items[j], (0,))[0]:
                best[items[j]] = (min(sim, 1.0), int(d), a + p, m + SHINGLE - 1)


def leaks(texts: list[str | None], index: Index) -> list[list[tuple]]:
    """For each text (item_id, similarity, differing bits, first word, words) of each item that it holds."""
    out: list[dict[int, tuple]] = [{} for _ in texts]
    folded = [fold(t) if t else b"" for t in texts]
    for a, b in grouped(folded):
        h, off = words_of(folded[a:b])
        if index.by_size:
            s, ends = shingle_hashes(h, off)
            hits = index.hits(s)
            of = np.searchsorted(ends, hits, "right") - 1
            for d in np.unique(of).tolist():
                if off[d + 1] - off[d] >= SHINGLE:
                    out[a + d] = _search(s[ends[d] : ends[d + 1]], hits[of == d] - ends[d], index)
        for k, known in index.short.items():
            x = _row(h, k)
            at = np.flatnonzero(np.isin(x, np.array(list(known), np.uint64)))
            of = np.searchsorted(off, at, "right") - 1
            for p, d in zip(at.tolist(), of.tolist(), strict=True):
                if p + k <= off[d + 1]:
                    for i in known[int(x[p])]:
                        out[a + d].setdefault(i, (1.0, 0, int(p - off[d]), k))
    return [[(index.ids[i], *x) for i, x in sorted(found.items())] for found in out]


def _frequencies(benchmark: DataFrame, count: int) -> DataFrame:
    """(slice, shingle, df) over all items for the shingles of each slice; df of the null shingle is the number of items."""

    def run(batches):
        for part, texts in slices(batches, "text"):
            of = part.column(part.schema.get_field_index("slice")).to_numpy()
            folded = [fold(t) if t else b"" for t in texts]
            for a, b in grouped(folded):
                h, off = words_of(folded[a:b])
                s, ends = shingle_hashes(h, off)
                for i in range(b - a):
                    if off[i + 1] - off[i] >= SHINGLE:
                        own = np.unique(s[ends[i] : ends[i + 1]]).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own) + 1, of[a + i], np.int64)), pa.array([*own.tolist(), None], pa.int64())], names=["slice", "shingle"])

    each = benchmark.select(_slice(count).cast("long").alias("slice"), "text").mapInArrow(run, "slice long, shingle long").groupBy("slice", "shingle").agg(F.count("*").alias("n"))
    each = stored(each, "shingles")
    df = each.groupBy("shingle").agg(F.sum("n").alias("df"))
    return stored(each.alias("e").join(df.alias("d"), F.expr("e.shingle <=> d.shingle")).select("slice", "e.shingle", "df"), "frequencies")


def _slice(count: int):
    return F.pmod(F.xxhash64("item_id", "text"), F.lit(max(count, 1)))


def indexes(benchmark: DataFrame) -> Iterator[tuple[Index, bool]]:
    """One index for each slice of about SLICE characters, and whether it is the only one."""
    benchmark = benchmark.select("item_id", "text")
    size = benchmark.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // SLICE))
    frequencies = _frequencies(benchmark, count) if count > 1 else None
    for i in range(count):
        items = [tuple(r) for r in benchmark.where(_slice(count) == i).orderBy("item_id", "text").collect()]  # about SLICE characters
        if frequencies is None:
            yield build(items), True
        else:
            df = {(None if r.shingle is None else r.shingle % (1 << 64)): r.df for r in frequencies.where(F.col("slice") == i).collect()}
            yield build(items, df, df.get(None, 0)), False


def _search_all(docs: DataFrame, index: Index) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("bits", pa.int32()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches):
        for part, texts in slices(batches, "text"):
            rows = []
            for i, key, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), leaks(texts, index), strict=True):
                rows += [(i, key, *x) for x in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_key binary, item_id long, similarity double, bits int, first_word long, n_words long")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (doc_id, item_id, similarity, bits, first_word, n_words) for each document and item it holds."""
    prepare(docs.sparkSession)
    rows, out = docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("binary").alias("text_key"), "text"), None
    for index, only in indexes(benchmark):
        found = _search_all(rows, index).drop("text_key")
        found = found if only else stored(found, "found")
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item."""
    prepare(docs.sparkSession)

    def clean(index: Index):
        @F.pandas_udf(BooleanType())
        def holds_none(text: pd.Series) -> pd.Series:
            return pd.Series([not x for x in leaks(list(text), index)], dtype=bool)

        return holds_none

    key = F.unhex(F.md5(F.col("text").cast("binary")))
    rows, bad = docs.select(F.col("doc_id").cast("long"), key.alias("text_key"), "text"), None
    for index, only in indexes(benchmark):
        if only:
            return docs.where(clean(index)("text"))
        found = stored(_search_all(rows, index).select("text_key").distinct(), "found")
        bad = found if bad is None else bad.unionByName(found)
    return docs.withColumn("_text_key", key).join(bad.select(F.col("text_key").alias("_text_key")).distinct(), "_text_key", "left_anti").select(*docs.columns)
