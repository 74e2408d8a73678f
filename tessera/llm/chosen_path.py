"""N-gram Jaccard join by chosen paths: all pairs of texts whose sets of five-word shingles are similar.

Texts with equal sets are one class and are joined once. For the classes:

1. Paths. In each run every set chooses some of its tokens (shingles): those whose hash for the run is
   below BRANCH / size, so BRANCH tokens on average. Sets that chose the same token meet in its bucket. In a bucket that is
   too large, every set chooses again, by a hash of the bucket's path, and so on to DEPTH. Similar
   sets are likely to choose alike; sets that share only a passage part ways.
2. Brute force. In a bucket that is small (or of the last level), all pairs are compared by their MinHash sketches, in cells of at
   most CELL by CELL sets, so that no task gets an unbounded group. A pair that meets in several buckets belongs to
   the first one that both are in, and is left to it.
3. Verification. For sets that have a pair, the whole texts are read again and pairs are verified by exact
   Jaccard similarity, cell by cell. A cell returns counts of links and links to each group's first member, not pairs.
4. Classes: connected components by label propagation with pointer jumping, each round written to the shared folder.

A pair of similarity s shares BRANCH * s chosen tokens a level on average, and reaches level d with a
probability of 1 - exp(-BRANCH * s * (that of level d - 1)). The number of runs is the least for which pairs of similarity
SIMILAR are found with probability `recall` even at the last level.

Defined results: null and empty texts, and texts without words, are classes of their own without links. Texts of fewer than five words are
one shingle. Equal texts, and texts that differ only in case and punctuation, are in one class and linked. n_links
counts rows, so repeated rows count each time. Rows without id keep a null class id only if all of their class lack one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SIMILAR, fold, grouped, join_crowded, mix, prepare, shingle_hashes, slices, stored, words_of

#: Expected choices of a set at each level, the deepest level, and the largest bucket that is compared at once.
BRANCH, DEPTH, CELL = 1.25, 3, 1000
#: Bytes of a sketch, one for each MinHash function; the estimate below which a pair is not verified lies four deviations under SIMILAR.
SKETCH = 128
MAYBE = SIMILAR - 4 * math.sqrt(SIMILAR * (1 - SIMILAR) / SKETCH)
RECALL = 0.999
_CHUNK = 1 << 15


def runs_for(recall: float, similar: float = SIMILAR) -> int:
    q = 1.0
    for _ in range(DEPTH):
        q = 1 - math.exp(-BRANCH * similar * q)
    return math.ceil(math.log(1 - recall) / math.log(1 - q))


def _odd(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


_MIN_A = (_odd(SKETCH, 99) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MIN_B = _odd(SKETCH, 777).astype(np.uint32)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """The low byte of each MinHash."""
    t = (tokens >> np.uint64(32)).astype(np.uint32)
    out = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(t), _CHUNK):
        np.minimum(out, (t[i : i + _CHUNK][None] * _MIN_A[:, None] + _MIN_B[:, None]).min(1), out=out)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def _choose(tokens: np.ndarray, paths: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """For each path its chosen tokens: index of the path, and the path that goes on through the token."""
    which, ids = [], []
    step = max(1, (1 << 18) // max(len(paths), 1))
    odd = paths | np.uint64(1)
    for i in range(0, len(tokens), step):
        t = tokens[i : i + step]
        p, j = np.nonzero(t[None] * odd[:, None] < limit)
        which.append(p)
        ids.append(mix(paths[p] * np.uint64(0x9E3779B97F4A7C15) + t[j]))
    return np.concatenate(which), np.concatenate(ids)


def paths_of(tokens: np.ndarray, roots: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the parents and the paths of a set."""
    limit = np.uint64(min(BRANCH / len(tokens) * 2.0**64, 2.0**64 - 2048))
    out, now = [], roots
    for level in range(DEPTH):
        which, ids = _choose(tokens, now, limit)
        out.append((now[which] if level else np.zeros(0, np.uint64), ids))
        now = ids
        if not len(now):
            break
    return out + [(np.zeros(0, np.uint64), np.zeros(0, np.uint64))] * (DEPTH - len(out))


def token_sets(texts: list[str | None]):
    """The sorted set of shingles of each text."""
    folded = [fold(t) if t else b"" for t in texts]
    for a, b in grouped(folded):
        s, ends = shingle_hashes(*words_of(folded[a:b]))
        for i in range(b - a):
            yield np.unique(s[ends[i] : ends[i + 1]])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text. An id need not name a single text, and may be null; with the key it names a text."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")


def _features(docs: DataFrame, roots: np.ndarray) -> DataFrame:
    """doc_id, key (a hash of the text), node (a hash of the set; null without words), n, sketch, and paths by level; those of one row for each set and batch."""
    longs = pa.list_(pa.int64())
    names = ["doc_id", "key", "node", "n", "sketch", "path1", "up2", "path2", "up3", "path3"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), *[longs] * 5]

    def run(batches):
        for part, texts in slices(batches, "text"):
            ids, keys = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "key"))
            rows, seen = [], {}
            for i, key, t in zip(ids, keys, token_sets(texts), strict=True):
                if not len(t):
                    rows.append((i, key, None, 0, *[None] * 6))
                    continue
                node = int(mix(np.array([(int(np.bitwise_xor.reduce(t)) * 3 + int(t.sum(dtype=np.uint64)) + len(t)) % (1 << 64)], np.uint64)).view(np.int64)[0])
                if node not in seen:
                    (_, p1), (u2, p2), (u3, p3) = paths_of(t, roots)
                    seen[node] = (node, len(t), sketch(t).tobytes(), *[x.view(np.int64) for x in (p1, u2, p2, u3, p3)])
                rows.append((i, key, *seen[node]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, node long, n long, sketch binary, path1 array<long>, up2 array<long>, path2 array<long>, up3 array<long>, path3 array<long>")


def _leaves(sets: DataFrame) -> DataFrame:
    """(path, node, size) of the buckets in which pairs are compared: small ones of any level, and all of the last. Buckets of many sets are dealt over several tasks."""
    leaves, big = None, None
    for level in range(1, DEPTH + 1):
        if level == 1:
            rows = sets.select("node", F.explode("path1").alias("path"))
        else:
            pairs = sets.select("node", F.explode(F.arrays_zip(F.col(f"up{level}").alias("up"), F.col(f"path{level}").alias("path"))).alias("p")).select("node", "p.up", "p.path")
            rows = join_crowded(pairs, big, "up", "up_size", "node").select("node", "path")
        sizes = stored(rows.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        rows = stored(join_crowded(rows, sizes, "path", "size", "node"), "buckets")
        leaf = rows if level == DEPTH else rows.where(F.col("size") <= CELL)
        leaves = leaf if leaves is None else leaves.unionByName(leaf)
        big = sizes.where(F.col("size") > CELL).select(F.col("path").alias("up"), F.col("size").alias("up_size"))
    return leaves


def _cells(df: DataFrame) -> DataFrame:
    """A row for each cell of its bucket that a set takes part in: cell (x, y) compares part x with part y."""
    parts = F.ceil(F.col("size") / F.lit(float(CELL))).cast("long")
    own = F.pmod(F.xxhash64("node", "path"), parts)
    return df.withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn("x", F.least("part", "other")).withColumn("y", F.greatest("part", "other")).drop("other", "size")


def _groups(batches, width: int):
    """Whole cells, in order, from batches that are sorted by cell. Yields tables whose rows all have one cell, in chunks of many cells."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(c).to_numpy() for c in ("path", "x", "y")]
        new = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0)) + 1
        if not len(new):
            held = table
            continue
        cut = int(new[-1])
        yield table.slice(0, cut), np.concatenate([[0], new])
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield held, np.array([0, held.num_rows])


def _candidates(n: np.ndarray, sketches: np.ndarray, part: np.ndarray, diagonal: bool):
    """Index pairs i < j of a cell whose sketches and sizes allow the similarity."""
    k = len(n)
    least = math.ceil(MAYBE * SKETCH)
    step = max(1, (1 << 23) // (k * SKETCH))
    for a in range(0, k - 1, step):
        b = min(a + step, k)
        same = np.count_nonzero(sketches[a:b, None] == sketches[None], axis=2)
        ok = same >= least
        ok &= np.arange(k)[None] > np.arange(a, b)[:, None]
        lo, hi = np.minimum(n[a:b, None], n[None]), np.maximum(n[a:b, None], n[None])
        ok &= lo >= SIMILAR * hi - 1e-9
        if not diagonal:
            ok &= part[a:b, None] != part[None]
        i, j = np.nonzero(ok)
        if len(i):
            yield i + a, j


def _own(i: np.ndarray, j: np.ndarray, path: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Which pairs belong to this bucket: the smallest path that both are in. leaves: the sorted paths of each member."""
    if not len(i):
        return np.zeros(0, bool)
    before = [x[: np.searchsorted(x, path)] for x in leaves]
    if not any(len(x) for x in before):
        return np.ones(len(i), bool)
    every, inverse = np.unique(np.concatenate(before), return_inverse=True)
    words = -(-len(every) // 64)
    if words * len(leaves) > 1 << 22:  # wide: pair by pair
        return np.array([not len(np.intersect1d(before[a], before[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)
    bits = np.zeros((len(leaves), words), np.uint64)
    of = np.repeat(np.arange(len(leaves)), [len(x) for x in before])
    np.bitwise_or.at(bits, (of, inverse // 64), np.uint64(1) << (inverse % 64).astype(np.uint64))
    out = np.ones(len(i), bool)
    for s in range(0, len(i), 1 << 16):
        out[s : s + (1 << 16)] = ~(bits[i[s : s + (1 << 16)]] & bits[j[s : s + (1 << 16)]]).any(1)
    return out


def _pairs_of(table: pa.Table, bounds: np.ndarray):
    """For each cell of a table: its first row, and the index pairs that belong to it."""
    n, part = table.column("n").to_numpy(), table.column("part").to_numpy()
    x, y, path = (table.column(c).to_numpy() for c in ("x", "y", "path"))
    sk = table.column("sketch").combine_chunks()
    lv = table.column("leaves").combine_chunks()
    offsets, values = lv.offsets.to_numpy(), lv.values.to_numpy()
    ends = np.append(bounds[1:], table.num_rows)[: len(bounds)]
    for a, b in zip(bounds.tolist(), ends.tolist(), strict=True):
        if b - a < 2:
            continue
        got = list(_candidates(n[a:b], np.array([np.frombuffer(s.as_buffer(), np.uint8) for s in sk[a:b]]), part[a:b], x[a] == y[a]))
        if not got:
            continue
        i, j = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        keep = _own(i, j, int(path[a]), [values[offsets[r] : offsets[r + 1]] for r in range(a, b)])
        if keep.any():
            yield a, b, i[keep], j[keep]


def exact(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], similar: float = SIMILAR) -> np.ndarray:
    """Which pairs of sets have at least the Jaccard similarity."""
    size = np.array([len(s) for s in sets])
    used = np.unique(np.concatenate([i, j]))
    inter = np.empty(len(i), np.int64)
    if len(i) > 8 * len(used):  # dense: products of membership matrices, some tokens at a time
        place = np.full(len(sets), -1)
        place[used] = np.arange(len(used))
        every, inverse, counts = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(len(used)), size[used])
        shared = counts > 1
        number = np.cumsum(shared) - 1
        keep = shared[inverse]
        of, col = of[keep], number[inverse[keep]]
        order = np.argsort(col, kind="stable")
        of, col = of[order], col[order]
        both = np.zeros((len(used), len(used)), np.float32)
        for c in range(0, int(shared.sum()), 2048):
            a, b = np.searchsorted(col, [c, c + 2048])
            m = np.zeros((len(used), 2048), np.float32)
            m[of[a:b], col[a:b] - c] = 1
            both += m @ m.T
        inter[:] = np.rint(both[place[i], place[j]])
    else:
        order = np.argsort(i, kind="stable")
        heads = np.flatnonzero(np.diff(i[order], prepend=-1))
        for a, b in zip(heads, np.append(heads[1:], len(i)), strict=True):
            rows = order[a:b]
            mine = sets[i[rows[0]]]
            theirs = [sets[k] for k in j[rows]]
            all_ = np.concatenate(theirs)
            at = np.minimum(np.searchsorted(mine, all_), len(mine) - 1)
            starts = np.cumsum([0, *[len(t) for t in theirs[:-1]]])
            inter[rows] = np.add.reduceat((mine[at] == all_).astype(np.int64), starts)
    return inter >= similar * (size[i] + size[j] - inter) - 1e-9


def _roots(i: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """The first member of each member's group."""
    root = np.arange(k)
    while True:
        before = root.copy()
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (root == before).all():
            return root


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component; links (a, b). Each round is written to the shared folder."""
    labels = stored(nodes.select("node", F.col("node").alias("label")), "labels")
    while True:
        near = labels.select(F.col("node").alias("b"), "label")
        up = links.join(near, "b").select(F.col("a").alias("node"), "label")
        down = links.join(near.withColumnRenamed("b", "a"), "a").select(F.col("b").alias("node"), "label")
        least = labels.unionByName(up).unionByName(down).groupBy("node").agg(F.min("label").alias("label"))
        jump = least.alias("l").join(labels.select(F.col("node").alias("at"), F.col("label").alias("far")), F.col("l.label") == F.col("at"))
        new = stored(jump.select("node", F.least("label", "far").alias("label")), "labels")
        if not new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count():
            return new
        labels = new


CELL_ROW = "path long, x long, y long, node long, part long, n long, copies long, sketch binary, leaves array<long>"


def _named(docs: DataFrame, recall: float) -> tuple[DataFrame, DataFrame]:
    """The features of all rows, and for each set (node, first, copies, links, label): first is its row of the least id, nulls last, and label its component."""
    spark = docs.sparkSession
    prepare(spark)
    roots = _odd(runs_for(recall), 4242)
    rows = stored(_features(docs, roots), "features")
    some = rows.where("node is not null")
    sets = stored(some.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first"), F.count("*").alias("copies"), F.first(F.struct("n", "sketch", *[c for c in rows.columns if c[:2] in ("pa", "up")])).alias("s")).select("node", "first", "copies", "s.*"), "sets")
    leaves = _leaves(sets)
    of = leaves.groupBy("node").agg(F.array_sort(F.collect_set("path")).alias("leaves"), F.collect_set(F.struct("path", "size")).alias("b"))
    members = of.join(sets.select("node", "n", "copies", "sketch"), "node").select("node", "n", "copies", "sketch", "leaves", F.explode("b").alias("b")).select("node", "n", "copies", "sketch", "leaves", "b.path", "b.size")
    cells = _cells(members).select(*[c.split()[0] for c in CELL_ROW.split(", ")])
    by_cell = lambda df: df.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y", "node")

    def maybe(batches):
        for table, bounds in _groups(batches, SKETCH):
            keep = [np.unique(np.concatenate([i, j])) + a for a, _, i, j in _pairs_of(table, bounds)]
            if keep:
                yield from table.take(np.concatenate(keep)).combine_chunks().to_batches()

    kept = stored(by_cell(cells).mapInArrow(maybe, CELL_ROW), "cells")
    # the texts of sets that have a pair, one row for each set
    asked = kept.groupBy("node").agg(F.collect_list(F.struct("path", "x", "y", "part", "n", "copies", "sketch", "leaves")).alias("cells"))
    wanted = asked.select("node").join(sets.select("node", "first"), "node").select(F.col("node").alias("want"), F.col("first.doc_id").alias("want_id"), F.col("first.key").alias("want_key"))
    found = _keyed(docs).where("text is not null").join(wanted, F.expr("doc_id <=> want_id AND key = want_key"))

    def tokens(batches):
        for part, texts_ in slices(batches, "text"):
            want = part.column(part.schema.get_field_index("want")).to_pylist()
            got = []
            for w, t in zip(want, token_sets(texts_), strict=True):
                got.append((w, t.tobytes(), len(t)))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary()), pa.array([g[2] for g in got], pa.int64())], names=["node", "tokens", "m"])

    with_tokens = found.select("want", "text").mapInArrow(tokens, "node long, tokens binary, m long").dropDuplicates(["node"])
    full = asked.join(with_tokens, "node").select("node", "tokens", F.explode("cells").alias("c")).select("node", "tokens", "c.*")
    full = full.select(*[c.split()[0] for c in CELL_ROW.split(", ")], "tokens")

    def verify(batches):
        for table, bounds in _groups(batches, SKETCH):
            node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
            tok = table.column("tokens").combine_chunks()
            out: list[tuple] = []
            for a, b, i, j in _pairs_of(table, bounds):
                sets_ = [np.frombuffer(t.as_buffer(), np.uint64) for t in tok[a:b]]
                ok = exact(i, j, sets_)
                i, j = i[ok], j[ok]
                if not len(i):
                    continue
                w = copies[a:b]
                links = np.bincount(i, w[j], b - a) + np.bincount(j, w[i], b - a)
                root = _roots(i, j, b - a)
                at = np.flatnonzero(links)
                out.append((node[a:b][at], node[a:b][root[at]], links[at].astype(np.int64)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["node", "root", "links"])

    counted = stored(by_cell(full).mapInArrow(verify, "node long, root long, links long"), "links")
    per_node = counted.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(per_node.select("node"), counted.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct())
    return rows, sets.join(per_node, "node", "left").join(labels, "node", "left").select("node", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label"))


def join(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """One row (doc_id, class_id, n_links, class_rows) for each row: the least id of its component, the number of other rows that are similar to it, and the component's rows."""
    rows, named = _named(docs, recall)
    groups = named.groupBy("label").agg(F.min("first.doc_id").alias("class_id"), F.sum("copies").alias("class_rows"))
    classes = named.join(groups, "label").select("node", "class_id", "class_rows", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    with_words = rows.where("node is not null").select("doc_id", "node").join(classes, "node").select("doc_id", "class_id", "n_links", "class_rows")
    return with_words.unionByName(rows.where("node is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_rows")))


def representatives(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """The row with the least id of each class, nulls last; of rows that repeat an id and its text one."""
    rows, named = _named(docs, recall)
    first = named.groupBy("label").agg(F.min("first").alias("f")).select(F.col("f.doc_id").alias("_first"), F.col("f.key").alias("_key"))
    first = first.unionByName(rows.where("node is null").select(F.col("doc_id").alias("_first"), F.col("key").alias("_key"))).distinct()
    return docs.join(first, docs["doc_id"].eqNullSafe(first["_first"]) & (F.xxhash64(docs["text"]) == first["_key"]), "left_semi").dropDuplicates(["doc_id", "text"])


def brute_force(texts: list[str | None], ids: list[int]) -> pd.DataFrame:
    """The same rows by comparing all pairs; for small fixtures."""
    sets = list(token_sets(texts))
    links = np.zeros(len(sets), int)
    label = list(range(len(sets)))

    def root(i: int) -> int:
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            n = len(np.intersect1d(sets[i], sets[j]))
            if n and n >= SIMILAR * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                label[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    rows = pd.Series([root(i) for i in range(len(sets))])
    return pd.DataFrame({"doc_id": ids, "class_id": [least[r] for r in rows], "n_links": links, "class_rows": rows.map(rows.value_counts()).to_numpy()})
