"""Suffix-array dedup: remove every byte covered by a string of LENGTH bytes that also starts elsewhere.

Sorting all suffixes of a corpus, or LENGTH rounds of interleave refinement over all of its bytes, is far beyond any
budget, so the suffixes that can matter are found first, without loss:

1. Anchors. In each window of LENGTH bytes, the K-gram with the least hash is the window's anchor. Equal
   windows have equal anchors at equal offsets. An anchor serves a range of windows.
2. Cells. A cell is a range of starts of windows around an anchor. All windows of a cell share its core (the bytes
   that every one of them covers), and lie in its span. If a core occurs once, no window of the cell is repeated; if
   a whole span occurs twice, all of them are. Only counts by hash decide this, added up before
   and after the shuffle, so no group of copies is ever gathered. What is still open is cut into smaller cells:
   the whole anchor, then 64 starts, then 16.
3. Burrows-Wheeler merging. A cell that is still open is a string of 15 bytes, its core as one symbol, and
   15 bytes. Cells with one core come to one task, shard by shard: each shard's transform is built alone, and the shards are merged by interleave
   refinement (see bwt). Common prefixes of 16 symbols are equal windows of LENGTH bytes, so the repeated
   intervals of the merged transform name the windows that start elsewhere too, byte by byte.
   Cores with more than HOT cells are cut into single windows instead and decided by counts, so that no task gets an
   unbounded group.

Texts are read as UTF-8 bytes; matches never cross texts, and are judged on the input. Equality of strings is
that of 64-bit hashes within equal cores.

Defined results: a null text is an empty one. Texts shorter than LENGTH lose nothing. Overlapping
repeats count, also within a text. Repeated rows lose all that lies in windows of full length. Rows are told apart by id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import bwt
from .blocks import BLOCK, _tables, in_filter, join_crowded, mix, prepare, slices, stored

#: Bytes of a repeated string, of an anchor, and how many windows one anchor can serve.
LENGTH, K = 400, 32
SERVED = LENGTH - K + 1
#: Starts in the cells of the second and third round.
COARSE, FINE = 64, 16
#: The most cells with one core that meet in a task.
HOT = 50_000
#: Strings in a shard, and cells that are merged at once.
SHARD, MERGED = 4096, 1 << 15
_POSITION = 20


class _Hashes:
    """Hashes of any range of a block of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        self.pow, self.inv = _tables()
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.pow[: len(data)], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a] + (b - a).astype(np.uint64))

    def grams(self) -> np.ndarray:
        n = len(self.sums) - K
        return (self.sums[K:] - self.sums[:-K]) * self.inv[:n] if n > 0 else np.empty(0, np.uint64)


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, from least values of prefixes and suffixes of blocks of w."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def _anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of texts that lie end to end in a block (ends: where each ends): position, text, and hashes of core and span."""
    if len(data) < LENGTH:
        e = np.empty(0, np.int64)
        return e, e, e.view(np.uint64), e.view(np.uint64)
    h = _Hashes(data)
    grams = h.grams()
    g = (grams * np.uint64(0xD6E8FEB86659FD93)) & ~np.uint64((1 << _POSITION) - 1)
    best = _least(g | np.arange(len(g), dtype=np.uint64), SERVED)
    at = (best & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-1))  # windows whose anchor differs from the one before
    starts_ends = np.append(starts[1:], len(at))
    # a window must end within its text: the first windows of a range may, later ones not, or the other way round
    of = np.searchsorted(ends, at[starts], "right")
    begin = np.concatenate([[0], ends])[of]
    lo, hi = np.maximum(starts, begin), np.minimum(starts_ends - 1, ends[of] - LENGTH)
    ok = lo <= hi
    a, of, begin, end = at[starts[ok]], of[ok], begin[ok], ends[of[ok]]
    left, right = np.maximum(a - SERVED + 1, begin), np.minimum(a + LENGTH, end)
    span = mix(h.of(left, right) + ((a - left) * 1024 + (right - a)).astype(np.uint64))
    return a - begin, of, mix(grams[a]), span


def _texts_anchors(texts: list[bytes]):
    """For each text with windows: its index, positions of anchors, cores and spans."""
    group: list[int] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        pos, of, core, span = _anchors(data, np.cumsum([len(texts[i]) for i in group]))
        return np.array(group, np.int64)[of], pos, core, span

    for i, x in enumerate(texts):
        if len(x) < LENGTH:
            continue
        if len(x) > BLOCK // 2:
            # in blocks that overlap, so that every window and every span lies in one of them
            whole, step, found = np.frombuffer(x, np.uint8), BLOCK // 2, {}
            for s in range(0, len(x) - LENGTH + 1, step):
                first = max(0, s - LENGTH)
                piece = whole[first : s + step + 3 * LENGTH]
                p, _, core, span = _anchors(piece, np.array([len(piece)]))
                p = p + first
                inner = (p >= first + SERVED - 1 if first else np.ones(len(p), bool)) & (p + LENGTH <= first + len(piece) if first + len(piece) < len(x) else np.ones(len(p), bool))
                for q, c, sp in zip(p[inner].tolist(), core[inner].tolist(), span[inner].tolist(), strict=True):
                    found[q] = (c, sp)
            at = np.array(sorted(found), np.int64)
            yield np.full(len(at), i), at, np.array([found[q][0] for q in at.tolist()], np.uint64), np.array([found[q][1] for q in at.tolist()], np.uint64)
            continue
        if group and size + len(x) > BLOCK:
            yield flush()
            group.clear()
            size = 0
        group.append(i)
        size += len(x)
    if group:
        yield flush()


def _bytes_of(docs: DataFrame) -> DataFrame:
    """key, doc_id and the bytes of text."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.xxhash64("doc_id", text).alias("key"), "doc_id", text.alias("bytes"))


def anchors(rows: DataFrame) -> DataFrame:
    """(key, at, core, span) for each anchor of each row."""

    def run(batches):
        for part, texts in slices(batches, "bytes"):
            keys = part.column(part.schema.get_field_index("key")).to_numpy()
            for of, at, core, span in _texts_anchors(texts):
                yield pa.RecordBatch.from_arrays([pa.array(keys[of]), pa.array(at.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(span.view(np.int64))], names=["key", "at", "core", "span"])

    return rows.select("key", "bytes").mapInArrow(run, "key long, at int, core long, span long")


def decide(cells: DataFrame) -> DataFrame:
    """The cells whose core occurs again, with n, how often their span does, and cores, how often their core does.

    `open` marks the cells that go on to the next round: those whose span is alone, and, where their core has such, one cell of each
    span that isn't, as the others' partner.
    """
    cells = stored(cells, "cells")  # read three times
    where = F.struct(*[c for c in ("key", "at", "q", "i") if c in cells.columns])
    spans = cells.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(where).alias("first"))
    cores = spans.groupBy("core").agg(F.sum("n").alias("cores"), F.sum((F.col("n") == 1).cast("long")).alias("alone"), F.count("*").alias("spans")).where("cores > 1")
    cores = stored(cores, "cores")  # read three times
    got = cells.join(join_crowded(spans, cores, "core", "spans", "span"), ["core", "span"])
    return got.withColumn("open", (F.col("n") == 1) | (F.col("alone") > 0) & (where == F.col("first"))).drop("first", "alone", "spans")


#: Bytes of the neighbourhood that an open anchor's cells are made of.
_BEFORE, _AFTER = SERVED - 1, LENGTH


def _open_text(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(key, at, before, text) of open anchors: the bytes around each, and how many lie before it."""
    marks = open_.groupBy("key").agg(F.collect_list("at").alias("ats"))

    def run(batches):
        for part, texts in slices(batches, "bytes"):
            keys, ats = part.column(part.schema.get_field_index("key")).to_pylist(), part.column(part.schema.get_field_index("ats")).to_pylist()
            for k, x, own in zip(keys, texts, ats, strict=True):
                own = sorted(set(own))
                for i in range(0, len(own), 2000):
                    some = own[i : i + 2000]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array([min(a, _BEFORE) for a in some], pa.int32()), pa.array([x[max(0, a - _BEFORE) : a + _AFTER] for a in some], pa.binary())], names=["key", "at", "before", "text"])

    return _maybe(rows, marks).join(marks, "key").select("key", "bytes", "ats").mapInArrow(run, "key long, at int, before int, text binary")


def _maybe(rows: DataFrame, keys: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose key may be among keys (or surely isn't): a filter of fixed size, sent to all tasks, spares their join."""
    return in_filter(rows, "key", keys).where(~F.col("hit") if others else F.col("hit")).drop("hit")


def _cell_rows(near: DataFrame, size: int, cells: DataFrame | None) -> DataFrame:
    """(key, at, q, core, span) of the cells of `size` starts: all of each anchor, or those within open larger cells; the last kind with left and right bytes."""
    last, all_ = size == FINE, cells is None

    def run(batches):
        for part, texts in slices(batches, "text"):
            col = lambda c: part.column(part.schema.get_field_index(c)).to_numpy()  # noqa: E731, B023
            key, at, before = col("key"), col("at"), col("before").astype(np.int64)
            qs = None if all_ else part.column(part.schema.get_field_index("qs")).to_pylist()
            for s in range(0, len(texts), 400):
                e = min(s + 400, len(texts))
                data = np.frombuffer(b"".join(texts[s:e]), np.uint8)
                h = _Hashes(data)
                ends = np.cumsum([len(x) for x in texts[s:e]])
                begin = ends - [len(x) for x in texts[s:e]]
                a = begin + before[s:e]
                if qs is None:
                    row, q = np.repeat(np.arange(e - s), -(-SERVED // size)), np.tile(np.arange(-(-SERVED // size)), e - s)
                else:
                    per = COARSE // size
                    n = [len(x) * per for x in qs[s:e]]
                    row = np.repeat(np.arange(e - s), n)
                    q = (np.concatenate([np.asarray(x, np.int64) for x in qs[s:e]])[:, None] * per + np.arange(per)).ravel()
                first, final = a[row] - q * size - size + 1, a[row] - q * size  # starts of windows
                ok = (final >= begin[row]) & (np.maximum(first, begin[row]) + LENGTH <= ends[row]) & (q * size < SERVED)
                row, q, first, final = row[ok], q[ok], first[ok], final[ok]
                left, right = np.maximum(first, begin[row]), np.minimum(final + LENGTH, ends[row])
                # the core is in every window that exists: it ends with the first of them
                core = mix(h.of(final, first + LENGTH) + (q * 7919 + size).astype(np.uint64))
                span = mix(h.of(left, right) + ((final - left) * 1024 + (right - final)).astype(np.uint64))
                out = [pa.array(key[s:e][row]), pa.array(at[s:e][row]), pa.array(q.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(span.view(np.int64))]
                if last:
                    raw = data.tobytes()
                    out.append(pa.array([raw[x:y] for x, y in zip(left.tolist(), final.tolist(), strict=True)], pa.binary()))
                    out.append(pa.array([raw[x:y] for x, y in zip((first + LENGTH).tolist(), right.tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=["key", "at", "q", "core", "span"] + ["left", "right"] * last)

    if not all_:
        near = near.join(cells.groupBy("key", "at").agg(F.collect_set("q").alias("qs")), ["key", "at"])
    return near.mapInArrow(run, "key long, at int, q int, core long, span long" + ", left binary, right binary" * last)


def merged_windows(left: list[bytes], right: list[bytes], core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of cells occur in another cell: (cell, number of the window, 0 to FINE - 1), by merging the transforms of shards of cells."""
    n, r = len(left), FINE - 1
    names, symbol = np.unique(core, return_inverse=True)
    text = np.ones((n, 2 * r + 1), np.int64)  # 1 fills up what lies outside the text
    ln, rn = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    text[:, :r] = np.frombuffer(b"".join(x.rjust(r, b"\0") for x in left), np.uint8).reshape(n, r).astype(np.int64) + 2
    text[:, r + 1 :] = np.frombuffer(b"".join(x.ljust(r, b"\0") for x in right), np.uint8).reshape(n, r).astype(np.int64) + 2
    col = np.arange(r)
    text[:, :r][col[None] < (r - ln)[:, None]] = 1
    text[:, r + 1 :][col[None] >= rn[:, None]] = 1
    text[:, r] = 258 + symbol
    shards = [bwt.build_equal(text[i : i + SHARD]) for i in range(0, n, SHARD)]
    z, place, common = bwt.merge(shards, FINE)
    rows = np.flatnonzero(bwt.repeated(common, FINE))
    first = np.array([s * SHARD for s in range(len(shards))])
    suffix = np.concatenate([s.suffix for s in shards])
    base = np.cumsum([0, *[len(s.suffix) for s in shards]])[:-1]
    at = suffix[base[z[rows]] + place[rows]]
    cell, i = at // (2 * r + 2) + first[z[rows]], at % (2 * r + 2)
    ok = (i <= r) & (i >= r - ln[cell]) & (i <= rn[cell])
    return cell[ok], i[ok]


def _merge_cells(cells: DataFrame) -> DataFrame:
    """(key, lo, hi) of repeated windows, from open cells of FINE starts; cells with one core meet in one task."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def spans(table: pa.Table):
            key, at, q, core = (table.column(c).to_numpy() for c in ("key", "at", "q", "core"))
            cell, i = merged_windows(table.column("left").to_pylist(), table.column("right").to_pylist(), core)
            order = np.lexsort((i, cell))
            cell, i = cell[order], i[order]
            start = at[cell].astype(np.int64) - q[cell] * FINE - FINE + 1 + i
            new = np.flatnonzero((np.diff(cell, prepend=-1) != 0) | (np.diff(start, prepend=-9) != 1))
            if len(new):
                yield pa.RecordBatch.from_arrays([pa.array(key[cell[new]]), pa.array(start[new]), pa.array(start[np.append(new[1:], len(start)) - 1] + LENGTH)], names=["key", "lo", "hi"])

        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= MERGED:
                table = pa.Table.from_batches(held)
                new = np.flatnonzero(np.diff(table.column("core").to_numpy())) + 1
                if len(new):
                    yield from spans(table.slice(0, int(new[-1])))
                    table = table.slice(int(new[-1]))
                held, rows = table.to_batches(), table.num_rows
        if held:
            yield from spans(pa.Table.from_batches(held))

    return cells.repartition("core").sortWithinPartitions("core").select("key", "at", "q", "core", "left", "right").mapInArrow(run, "key long, lo long, hi long")


def _single(cells: DataFrame) -> DataFrame:
    """Cells cut into their windows: each with the hash of its bytes as core and span."""
    i = F.explode(F.sequence(F.lit(0), F.lit(FINE - 1))).alias("i")
    w = cells.select("key", "at", "q", "core", "left", "right", i).where((F.col("i") >= FINE - 1 - F.octet_length("left")) & (F.col("i") <= F.octet_length("right")))
    tail = F.expr("substring(left, i - (15 - octet_length(left)) + 1, 16)")
    return w.withColumn("span", F.xxhash64("core", "i", tail, F.expr("substring(right, 1, i)"))).withColumn("core", F.col("span"))


def repeats(rows: DataFrame) -> DataFrame:
    """(key, lo, hi): ranges of bytes covered by repeated windows; they overlap, and may reach beyond a text's ends. rows: key and bytes."""
    whole = stored(decide(anchors(rows)), "anchors")
    found = whole.where("n > 1").select("key", (F.col("at") - SERVED + 1).cast("long").alias("lo"), (F.col("at") + LENGTH).cast("long").alias("hi"))
    near = stored(_open_text(rows, whole.where("open")), "near")
    cells = None
    for size in (COARSE, FINE):
        got = stored(decide(_cell_rows(near, size, cells)), "cells")
        start = F.col("at") - F.col("q") * size
        found = found.unionByName(got.where("n > 1").select("key", (F.greatest(start - size, F.col("at") - SERVED) + 1).cast("long").alias("lo"), (start + LENGTH).cast("long").alias("hi")))
        cells = got.where("open")
    found = found.unionByName(_merge_cells(cells.where(F.col("cores") <= HOT)))
    start = F.col("at") - F.col("q") * FINE - FINE + 1 + F.col("i")
    hot = decide(_single(cells.where(F.col("cores") > HOT))).where("n > 1")
    return found.unionByName(hot.select("key", start.cast("long").alias("lo"), (start + LENGTH).cast("long").alias("hi")))


def without(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside ranges, and the maximal ranges that went."""
    order = np.argsort(lo, kind="stable")
    lo, hi = np.maximum(lo[order], 0), np.minimum(hi[order], len(data))
    far = np.maximum.accumulate(hi)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > far[:-1]]))
    gone = list(zip(lo[new].tolist(), far[np.append(new[1:], len(lo)) - 1].tolist(), strict=True))
    kept, at = [], 0
    for a, b in gone:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]), gone


RESULT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


@F.pandas_udf(RESULT)
def _digest(data: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    out = []
    for x, a, b in zip(data, lo, hi, strict=True):
        kept, gone = without(x, np.asarray(a, np.int64), np.asarray(b, np.int64)) if a is not None and len(a) else (x, [])
        out.append((len(x) - len(kept), len(gone), hashlib.sha256(kept).hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])


def ranges(rows: DataFrame) -> DataFrame:
    """(key, lo, hi) with arrays of ranges, one row for each key that has any."""
    return stored(repeats(rows).groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")), "ranges")


def removed(docs: DataFrame) -> DataFrame:
    """One row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of docs(doc_id, text)."""
    prepare(docs.sparkSession)
    rows = _bytes_of(docs)
    found = ranges(rows)
    n = F.octet_length("bytes").cast("long").alias("n_bytes")
    hit = _maybe(rows, found).join(found, "key", "left").select("doc_id", n, _digest("bytes", "lo", "hi").alias("d")).select("doc_id", "n_bytes", "d.*")
    rest = _maybe(rows, found, others=True).select("doc_id", n, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("bytes", 256).alias("kept_sha256"))
    return hit.unionByName(rest)


def dedup(docs: DataFrame) -> DataFrame:
    """The rows with repeated bytes removed from text; a character that loses a byte becomes U+FFFD."""
    prepare(docs.sparkSession)

    @F.pandas_udf(StringType())
    def cut(data: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series([without(x, np.asarray(a, np.int64), np.asarray(b, np.int64))[0].decode(errors="replace") if a is not None and len(a) else x.decode(errors="replace") for x, a, b in zip(data, lo, hi, strict=True)], dtype=object)

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    found = ranges(_bytes_of(docs)).withColumnsRenamed({"key": "_key", "lo": "_lo", "hi": "_hi"})
    out = docs.withColumn("_key", F.xxhash64("doc_id", text)).join(found, "_key", "left")
    return out.withColumn("text", F.when(F.col("text").isNull(), F.col("text")).otherwise(cut(text, "_lo", "_hi"))).drop("_key", "_lo", "_hi")


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text which bytes go, from a table of all windows; for small fixtures."""
    from collections import Counter

    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out
