"""The lexical leg: BM25 over a stored text index, and the cascade from strict to loose queries.

The index is built once: postings of each term with positions, partitioned by a hash of the term, so a query reads the partitions
of its own terms only. Scores are sums over the postings of a chunk, taken for all queries at once in matrices of bounded size;
each task keeps the best chunks of a query, and only these are ranked.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..storage import stored

ALL = ("text", "title", "spec_id", "series_desc")
STRICT = ("text", "series_desc")
#: Partitions of the stored postings, and files at most for each of them, over which the chunks of a frequent term are dealt.
BUCKETS, FILES = 16, 4
#: Queries (with their stages) whose terms are sent to tasks at once, and cells of a matrix of scores.
SLOTS, CELLS = 4096, 1 << 22


@dataclass
class Index:
    """postings(bucket, term, chunk_key, db_idx, len, n_strict, pos): positions in the chunk's tokens, of which the first n_strict are in the strict scope; stats(db_idx, n_docs, avg_len)."""

    postings: DataFrame
    stats: DataFrame
    buckets: int


def tokens(chunks: DataFrame) -> DataFrame:
    """(chunk_key, db_idx, toks, n_strict) over the indexed columns."""
    strict, rest = T.tokens(F.concat_ws("\n", *STRICT)), T.tokens(F.concat_ws("\n", *[c for c in ALL if c not in STRICT]))
    return chunks.select("chunk_key", "db_idx", strict.alias("s"), rest.alias("r")).select("chunk_key", "db_idx", F.concat("s", "r").alias("toks"), F.size("s").alias("n_strict"))


def _postings(batches):
    """Rows of (chunk_key, db_idx, toks, n_strict) to (term, chunk_key, db_idx, len, n_strict, pos), by sorting a batch's tokens."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            lists = part.column(2)
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            words = pc.dictionary_encode(lists.flatten())
            codes = words.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
            key = row * max(len(words.dictionary), 1) + codes
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            of = pa.array(row[order][first])
            places = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(pos[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(codes[order][first])), part.column(0).take(of), part.column(1).take(of), pa.array(size[row[order][first]].astype(np.int32)), part.column(3).take(of), places], names=["term", "chunk_key", "db_idx", "len", "n_strict", "pos"])


def build(chunks: DataFrame, buckets: int = BUCKETS, path: str | None = None) -> Index:
    """Writes the index to a path, or to the shared folder. Lengths and statistics are over all indexed columns and the whole corpus, whatever is filtered later."""
    toks = tokens(chunks)
    kinds = dict(toks.dtypes)
    posts = toks.mapInArrow(_postings, f"term string, chunk_key {kinds['chunk_key']}, db_idx {kinds['db_idx']}, len int, n_strict int, pos array<int>")
    posts = posts.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket", F.pmod(F.xxhash64("chunk_key"), F.lit(FILES))).sortWithinPartitions("bucket", "term")
    stats = toks.groupBy("db_idx").agg(F.count("*").alias("n_docs"), F.avg(F.size("toks")).alias("avg_len"))
    return Index(stored(posts, "postings", ("bucket",), path and f"{path}/postings"), stored(stats, "statistics", (), path and f"{path}/statistics"), buckets)


def read(spark: SparkSession, path: str) -> Index:
    """An index that build wrote to a path."""
    postings = spark.read.parquet(f"{path}/postings")
    return Index(postings, spark.read.parquet(f"{path}/statistics"), 1 + postings.agg(F.max("bucket")).first()[0])


def _found(index: Index, words: list[tuple], columns: str) -> DataFrame:
    """The postings of words (bucket, tok, ...), from the partitions that may hold them. The words are those of a stated set of queries."""
    spark = index.postings.sparkSession
    known = spark.createDataFrame(words, f"bucket int, tok string, {columns}")
    return index.postings.where(F.col("bucket").isin(sorted({w[0] for w in words}))).withColumnRenamed("term", "tok").join(F.broadcast(known), ["bucket", "tok"]).drop("bucket")


def term_hits(index: Index, terms: DataFrame, strict: bool) -> DataFrame:
    """(chunk_key, db_idx, len, term, tf) for each of terms(term), a word or a phrase joined by hyphens, where it occurs."""
    parts = terms.select("term").distinct().select("term", F.filter(F.split("term", r"[^\p{L}\p{N}]+"), lambda t: t != "").alias("parts"))
    parts = parts.select("term", "parts", F.transform("parts", lambda t: F.pmod(F.xxhash64(t), F.lit(index.buckets)).cast("int")).alias("buckets")).collect()
    inside = F.expr("filter(pos, p -> p < n_strict)") if strict else F.col("pos")
    one = _found(index, [(r.buckets[0], r.parts[0], r.term) for r in parts if len(r.parts) == 1], "term string")
    one = one.select("chunk_key", "db_idx", "term", "len", F.size(inside).cast("long").alias("tf")).where("tf > 0")
    phrases = [(b, t, r.term, len(r.parts), i) for r in parts if len(r.parts) > 1 for i, (b, t) in enumerate(zip(r.buckets, r.parts, strict=True))]
    if not phrases:
        return one
    placed = _found(index, phrases, "term string, n int, i int").select("chunk_key", "db_idx", "len", "term", "n", "i", F.explode(inside).alias("pos"))
    starts = placed.groupBy("chunk_key", "db_idx", "term", (F.col("pos") - F.col("i")).alias("start")).agg(F.first("len").alias("len"), F.count("*").alias("got"), F.first("n").alias("n")).where("got = n")
    return one.unionByName(starts.groupBy("chunk_key", "db_idx", "term").agg(F.first("len").alias("len"), F.count("*").alias("tf")))


def weights(hits: DataFrame, index: Index, s: Settings = DEFAULT) -> DataFrame:
    """hits with w, the BM25 weight of a term in a chunk. Document frequencies are by source; they and the statistics have a row for each term of the queries and each source."""
    df = hits.groupBy("db_idx", "term").agg(F.count("*").alias("df"))
    x = hits.join(F.broadcast(df), ["db_idx", "term"]).join(F.broadcast(index.stats), "db_idx")
    idf = F.greatest(F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(s.least_idf))
    return x.withColumn("w", idf * F.col("tf") * (s.k1 + 1) / (F.col("tf") + s.k1 * (1 - s.b + s.b * F.col("len") / F.col("avg_len")))).select("chunk_key", "db_idx", "term", "w")


def score(wanted: DataFrame, weighted: DataFrame, every: bool) -> DataFrame:
    """(query_id, stage, chunk_key, db_idx, score) for wanted(query_id, stage, term); with `every`, chunks must have all terms of the stage."""
    got = wanted.join(weighted, "term").groupBy("query_id", "stage", "chunk_key", "db_idx").agg(T.round_to(F.sum("w"), 6).alias("score"), F.count("*").alias("got"))
    if every:
        sizes = wanted.groupBy("query_id", "stage").agg(F.count("*").alias("n"))
        got = got.join(sizes, ["query_id", "stage"]).where("got = n")
    return got.select("query_id", "stage", "chunk_key", "db_idx", "score")


def best(wanted: DataFrame, weighted: DataFrame, every: bool, k: int) -> DataFrame:
    """As score, but for each query, stage and source only what can be among the k best: all that a task finds to be no worse than its k-th. wanted is a stated set of queries; what goes
    to the tasks at once is bounded by SLOTS."""
    spark = wanted.sparkSession
    kinds = dict(wanted.dtypes) | dict(weighted.dtypes)
    result = f"query_id {kinds['query_id']}, stage int, chunk_key {kinds['chunk_key']}, db_idx {kinds['db_idx']}, score double"
    slots: dict[tuple, list[str]] = {}
    for r in wanted.select("query_id", "stage", "term").distinct().orderBy("query_id", "stage", "term").collect():
        slots.setdefault((r.query_id, r.stage), []).append(r.term)
    names, out = list(slots), spark.createDataFrame([], result)
    id_type = to_arrow_type(wanted.schema["query_id"].dataType)
    for at in range(0, len(names), SLOTS):
        some = names[at : at + SLOTS]
        terms = sorted({t for x in some for t in slots[x]})
        code = {t: i for i, t in enumerate(terms)}
        pairs = np.array([(code[t], i) for i, x in enumerate(some) for t in slots[x]], np.int64)
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
        first, slot = np.searchsorted(pairs[:, 0], np.arange(len(terms) + 1)), pairs[:, 1]
        size = np.array([len(slots[x]) for x in some])
        ids, stages = pa.array([x[0] for x in some], id_type), pa.array([x[1] for x in some], pa.int32())

        def run(batches, first=first, slot=slot, size=size, ids=ids, stages=stages):
            n_slots = len(size)
            for batch in batches:
                for a in range(0, batch.num_rows, step := max(1, CELLS // n_slots)):
                    part = batch.slice(a, step)
                    rows, n = part.num_rows, pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
                    flat = part.column(2).flatten()
                    t, w = flat.field(0).to_numpy().astype(np.int64), flat.field(1).to_numpy()
                    times = first[t + 1] - first[t]
                    cell = np.repeat(np.repeat(np.arange(rows), n) * n_slots, times) + slot[np.arange(times.sum()) + np.repeat(first[t] - (np.cumsum(times) - times), times)]
                    got = np.bincount(cell, minlength=rows * n_slots).reshape(rows, n_slots)
                    sums = np.bincount(cell, np.repeat(w, times), rows * n_slots).reshape(rows, n_slots)
                    sums = np.where(got == size if every else got > 0, np.floor(sums * 1e6 + 0.5) / 1e6, -np.inf)
                    db = part.column(1).to_numpy()
                    for source in np.unique(db):
                        own = np.flatnonzero(db == source)
                        x = sums[own]
                        bar = np.partition(x, len(own) - k, axis=0)[len(own) - k] if len(own) > k else np.full(n_slots, -np.inf)
                        i, j = np.nonzero((x >= bar) & (x > -np.inf))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), stages.take(pa.array(j)), part.column(0).take(pa.array(own[i])), part.column(1).take(pa.array(own[i])), pa.array(x[i, j])], names=["query_id", "stage", "chunk_key", "db_idx", "score"])

        coded = weighted.join(F.broadcast(spark.createDataFrame(list(code.items()), "term string, code int")), "term")
        found = coded.groupBy("chunk_key", "db_idx").agg(F.collect_list(F.struct("code", "w")).alias("l")).mapInArrow(run, result)
        out = found if at == 0 else out.unionByName(found)
    return out


def top(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The k best by score, then by key, with rank."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_key")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def stages(queries: DataFrame, s: Settings = DEFAULT, table: dict[str, str] | None = None) -> DataFrame:
    """(query_id, stage, term). queries: query_id, q, and original, the query before it was expanded, if that differs.

    The strict stages take the original's terms, replaced by canonical forms; the expansion's terms with digits, if the original has few short
    plain terms; and its short hyphenated ones. 1: the most specific of them all; 2: one fewer; 3: canonical forms alone; 4: any term of the expanded query.
    """
    table = table or {}
    x = queries.select("query_id", "q", (F.col("original") if "original" in queries.columns else F.col("q")).alias("o"))
    x = x.select("query_id", T.search_terms(F.col("q")).alias("all"), T.cleaned_words(F.col("o")).alias("words"))
    x = x.withColumn("pins", T.pinned(F.col("words"), table)).withColumn("terms", T.strict_terms(F.col("words"), F.col("all"), table, s))
    limit = lambda stage, n: F.struct(F.lit(stage).alias("stage"), T.and_terms(F.col("terms"), F.col("pins"), n, s).alias("t"))
    rest = [F.struct(F.lit(3).alias("stage"), F.col("pins").alias("t")), F.struct(F.lit(4).alias("stage"), F.array_union("all", "pins").alias("t"))]
    x = x.select("query_id", F.explode(F.array(limit(1, s.and_limit), limit(2, s.and_limit - 1), *rest)).alias("s"))
    return x.select("query_id", "s.stage", F.explode("s.t").alias("term"))


def cascade(queries: DataFrame, chunks: DataFrame, k: int, s: Settings = DEFAULT, substitutions: dict[str, str] | None = None, extras_terms: list[str] | None = None, index: Index | None = None, post_filter: bool = True) -> DataFrame:
    """(query_id, chunk_key, db_idx, stage, score, rank): for each query and source the first stage that finds anything (see stages).

    Filters of the query come after the ranking, as statistics and limits are those of the whole corpus.
    """
    index = index or build(chunks)
    wanted = stages(queries, s, substitutions)
    wanted = wanted.sparkSession.createDataFrame(wanted.collect(), wanted.schema)  # the terms of a stated set of queries
    strict = best(wanted.where("stage < 4"), weights(term_hits(index, wanted.where("stage < 4"), True), index, s), True, k)
    loose = best(wanted.where("stage = 4"), weights(term_hits(index, wanted.where("stage = 4"), False), index, s), False, k)
    asked = F.col("original") if "original" in queries.columns else F.col("q")
    gate = queries.select("query_id", T.extras_weight(F.col("series") if "series" in queries.columns else F.lit(None), asked, extras_terms or [], s).alias("weight"))
    loose = loose.join(F.broadcast(gate), "query_id").where((F.col("db_idx") == 0) | (F.col("weight") >= s.extras_neutral)).drop("weight")
    found = strict.unionByName(loose)
    first = found.withColumn("first", F.min("stage").over(Window.partitionBy("query_id", "db_idx"))).where("stage = first").drop("first")
    ranked = top(first, k, "query_id", "db_idx").drop("rank")
    if post_filter:
        ranked = apply_filters(ranked, queries, chunks)
    return top(ranked, k, "query_id").select("query_id", "chunk_key", "db_idx", "stage", "score", "rank")


def apply_filters(hits: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    cols = [c for c in ("series", "release", "doc_type") if c in queries.columns]
    if not cols:
        return hits
    x = hits.join(queries.select("query_id", *[F.col(c).alias(f"f_{c}") for c in cols]), "query_id").join(chunks.select("chunk_key", *cols), "chunk_key")
    for c in cols:
        x = x.where(T.passes(F.col(f"f_{c}"), F.col(c)))
    return x.drop(*cols, *[f"f_{c}" for c in cols])
