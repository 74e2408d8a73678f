"""The dense leg: exact cosine similarity of a stated set of queries with all vectors.

Vectors are stored once with unit length and with what filters and caps need, so no metadata is joined for a query. Each task multiplies its vectors
with the matrix of queries and keeps what can be among the best of a query; only that is shuffled and ranked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..storage import stored

#: Query vectors beyond this number are handled in further passes, so what is sent to tasks is bounded.
QUERIES_AT_ONCE = 1024
#: Vectors in a matrix product.
ROWS = 4096
_FILTERS = ("series", "release", "doc_type")


def joined(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_key, spec_id, db_idx, load_ord, filters..., v): unit vectors with what ranking needs."""
    meta = chunks.select("chunk_key", "spec_id", "db_idx", "load_ord", *[c for c in _FILTERS if c in chunks.columns])
    return vectors.where("embedding is not null").select("chunk_key", T.unit(F.col("embedding")).alias("v")).join(meta, "chunk_key")


def build(vectors: DataFrame, chunks: DataFrame, path: str | None = None) -> DataFrame:
    """Writes joined() to a path, or to the shared folder."""
    return stored(joined(vectors, chunks), "vectors", (), path)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of vectors; those of another length are zero."""
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (n == width).all():
        return flat.reshape(-1, width)
    out, ends = np.zeros((len(n), width)), np.cumsum(n)
    for i in np.flatnonzero(n == width):
        out[i] = flat[ends[i] - width : ends[i]]
    return out


def candidates(queries: DataFrame, index: DataFrame, k: int, cap: int | None = None) -> DataFrame:
    """(query_id, chunk_key, spec_id, db_idx, load_ord, score): for each query the rows of each matrix that pass its filters and are no worse than the k-th of those that the cap by specification leaves."""
    filters = [c for c in _FILTERS if c in queries.columns]
    rows = queries.where(F.col("vector").isNotNull()).select("query_id", "vector", *filters).collect()
    kinds = dict(index.dtypes)
    keys = ("chunk_key", "spec_id", "db_idx", "load_ord")
    result = f"query_id {dict(queries.dtypes)['query_id']}, {', '.join(f'{c} {kinds[c]}' for c in keys)}, score double"
    out = queries.sparkSession.createDataFrame([], result)
    for at in range(0, len(rows), QUERIES_AT_ONCE):
        some = rows[at : at + QUERIES_AT_ONCE]
        ids = pa.array([r.query_id for r in some], to_arrow_type(queries.schema["query_id"].dataType))
        m = np.array([r.vector for r in some], np.float64)
        n = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, n, out=np.zeros_like(m), where=n > 0)
        wanted = {c: [r[c] if r[c] and r[c].strip() else None for r in some] for c in filters}

        def run(batches, ids=ids, m=m, wanted=wanted):
            for batch in batches:
                for a in range(0, batch.num_rows, ROWS):
                    part = pa.Table.from_batches([batch.slice(a, ROWS)]).combine_chunks()
                    col = lambda c: part.column(c).chunk(0)  # noqa: E731, B023
                    s = np.floor(m @ _matrix(col("v"), m.shape[1]).T * 1e6 + 0.5) / 1e6
                    for c, values in wanted.items():
                        code = {x: i for i, x in enumerate(dict.fromkeys(values)) if x is not None}
                        own = np.array([code.get(x, -1) for x in col(c).to_pylist()])
                        want = np.array([-2 if x is None else code[x] for x in values])
                        s[(want[:, None] != -2) & (want[:, None] != own[None])] = -np.inf
                    if cap:
                        spec = pc.dictionary_encode(col("spec_id"), null_encoding="encode").indices.to_numpy()
                        order = np.argsort(spec, kind="stable")
                        for own in np.split(order, np.flatnonzero(np.diff(spec[order])) + 1):
                            if len(own) > cap:
                                x = s[:, own]
                                s[:, own] = np.where(x >= np.partition(x, len(own) - cap, axis=1)[:, len(own) - cap, None], x, -np.inf)
                    bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
                    q, i = np.nonzero((s >= bar[:, None]) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), *[col(c).take(pa.array(i)) for c in keys], pa.array(s[q, i])], names=["query_id", *keys, "score"])

        found = index.select(*keys, *filters, "v").mapInArrow(run, result)
        out = found if at == 0 else out.unionByName(found)
    return out


def ranked(queries: DataFrame, vectors: DataFrame, chunks: DataFrame | None, k: int, cap: int | None = None, by_matrix: bool = True) -> DataFrame:
    """(query_id, chunk_key, spec_id, db_idx, score, rank): filters come before the ranking; then at most cap chunks of a specification; then the k best. vectors: as build() stores them, or
    raw ones with their chunks. Without by_matrix all pairs are made in the JVM, which suits small sets."""
    index = vectors if "v" in vectors.columns else joined(vectors, chunks)
    if by_matrix:
        x = candidates(queries, index, k, cap)
    else:
        filters = [c for c in _FILTERS if c in queries.columns]
        q = queries.where(F.col("vector").isNotNull()).select("query_id", T.unit(F.col("vector")).alias("qv"), *[F.col(c).alias(f"f_{c}") for c in filters])
        passed = F.lit(True)
        for c in filters:
            passed = passed & T.passes(F.col(f"f_{c}"), F.col(c))
        x = index.join(F.broadcast(q), passed).withColumn("score", T.round_to(T.dot(F.col("qv"), F.col("v")), 6))
    if cap:
        w = Window.partitionBy("query_id", "spec_id").orderBy(F.desc("score"), "load_ord")
        x = x.withColumn("in_spec", F.row_number().over(w)).where(F.col("in_spec") <= cap)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "load_ord")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "chunk_key", "spec_id", "db_idx", "score", "rank")


def search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int, s: Settings = DEFAULT) -> DataFrame:
    """Dense search alone: oversampled, capped by specification before binary texts are rejected, then the k best."""
    pool = min(max(k * s.oversample, k), s.oversample_max)
    top = ranked(queries, vectors, chunks, pool, None)
    w = Window.partitionBy("query_id", "spec_id").orderBy("rank")
    x = top.withColumn("n", F.row_number().over(w)).where(F.col("n") <= s.dense_cap).join(chunks.select("chunk_key", "text"), "chunk_key").where(~T.is_binary(F.col("text")))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= k).drop("text", "n")
