"""Hybrid search: both legs fused by reciprocal rank, adjusted, pooled, rescored and capped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..storage import stored
from . import dense, lexical


def fuse(dense_leg: DataFrame, lexical_leg: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, chunk_key, d_rank, l_rank, rrf): sums of 1 / (k + rank), raised where a chunk is among the best of both legs."""
    d = dense_leg.select("query_id", "chunk_key", F.col("rank").alias("d_rank"))
    l_ = lexical_leg.select("query_id", "chunk_key", F.col("rank").alias("l_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(s.rrf_k) + F.col(c)), F.lit(0.0))
    both = (F.col("d_rank") <= 10) & (F.col("l_rank") <= 10)
    out = d.join(l_, ["query_id", "chunk_key"], "full").withColumn("rrf", part("d_rank") + part("l_rank"))
    return out.withColumn("rrf", F.when(F.coalesce(both, F.lit(False)), F.col("rrf") * s.co_occurrence).otherwise(F.col("rrf")))


def facts(chunks: DataFrame) -> DataFrame:
    """chunks with what ranking needs beside them: binary, chars, spec_chunks (the specification's chunks) and spec_type (its first doc type in load order). Nothing is added twice."""
    if "spec_chunks" in chunks.columns:
        return chunks
    per = chunks.groupBy("spec_id").agg(F.count("*").alias("spec_chunks"), F.min_by("doc_type", F.when(F.col("doc_type").isNotNull(), F.col("load_ord"))).alias("spec_type"))
    return chunks.withColumns({"binary": T.is_binary(F.col("text")), "chars": F.coalesce(F.length("text"), F.lit(0))}).join(per, "spec_id")


def support(fused: DataFrame, depth: int) -> DataFrame:
    """(query_id, spec_id, support): in how many legs a specification is among the first hits. fused: query_id, spec_id, d_rank, l_rank."""
    best = fused.groupBy("query_id", "spec_id").agg(F.min("d_rank").alias("d"), F.min("l_rank").alias("l"))
    legs = F.coalesce((F.col("d") <= depth).cast("int"), F.lit(0)) + F.coalesce((F.col("l") <= depth).cast("int"), F.lit(0))
    return best.select("query_id", "spec_id", legs.alias("support")).where("support > 0")


def discounted(fused: DataFrame, chunks: DataFrame, queries: DataFrame, s: Settings = DEFAULT, extras_terms: list[str] | None = None) -> DataFrame:
    """fused with spec_id, rrf lowered for chunks of study reports and of the second source."""
    asked = F.col("original") if "original" in queries.columns else F.col("q")
    weight = T.extras_weight(F.col("series") if "series" in queries.columns else F.lit(None).cast("string"), asked, extras_terms or [], s)
    x = fused.join(chunks.select("chunk_key", "spec_id", "db_idx", "doc_type", "title"), "chunk_key").join(F.broadcast(queries.select("query_id", weight.alias("w"))), "query_id")
    study = F.when(T.is_study(F.col("doc_type"), F.col("spec_id"), F.col("title"), s), s.study_discount).otherwise(1.0)
    return x.withColumn("rrf", F.col("rrf") * study * F.when(F.col("db_idx") == 1, F.col("w")).otherwise(1.0)).select("query_id", "chunk_key", "spec_id", "d_rank", "l_rank", "rrf")


def pool(fused: DataFrame, chunks: DataFrame, queries: DataFrame, k: int, cap: int, s: Settings = DEFAULT, reject_binary: bool = True) -> DataFrame:
    """The k best fused hits. A specification's quota counts chunks before binary and stub chunks are rejected, so these use it up. Texts are read for the k best only."""
    norm = 2.0 / (s.rrf_k + 1)
    chunks = facts(chunks)
    x = fused.drop("spec_id").withColumn("score", F.least(F.lit(1.0), F.col("rrf") / norm)).where(F.col("score") >= s.min_score)
    x = x.join(chunks.select("chunk_key", "spec_id", "binary", "chars", "spec_chunks"), "chunk_key")
    order = (F.desc("rrf"), F.asc_nulls_last("d_rank"), F.asc_nulls_last("l_rank"), F.col("chunk_key"))
    x = x.withColumn("in_spec", F.row_number().over(Window.partitionBy("query_id", "spec_id").orderBy(*order))).where(F.col("in_spec") <= cap)
    x = x.join(F.broadcast(queries.select("query_id", (F.col("original") if "original" in queries.columns else F.col("q")).alias("q"))), "query_id")
    x = x.where(~((F.col("spec_chunks") <= s.stub_chunks) & (F.col("chars") < s.stub_chars) & ~T.names_spec(F.col("q"), F.col("spec_id"))))
    if reject_binary:
        x = x.where("not binary")
    x = x.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("pos") <= k)
    x = x.drop("in_spec", "spec_chunks", "binary", "chars", "spec_id").withColumn("score", T.round_to(F.col("score")))
    return x.join(chunks.select("chunk_key", "spec_id", "spec_type", "db_idx", "series", "release", "doc_type", "title", "chunk_index", "text"), "chunk_key")


def lexical_scorer(q, passage):
    """The default rescoring: sigmoid of the overlap of content words. A model can be put in its place."""
    a, b = T.content_tokens(q), T.content_tokens(passage)
    share = F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    return T.sigmoid(F.lit(6.0) * (share - 0.5))


def rerank(pooled: DataFrame, scorer=lexical_scorer) -> DataFrame:
    """Scores replaced by those of (query, `title: text`). scorer is a function of two columns, or None to leave them."""
    return pooled if scorer is None else pooled.withColumn("score", scorer(F.col("q"), F.concat_ws(": ", "title", "text")))


def adjust(hits: DataFrame, queries: DataFrame, s: Settings = DEFAULT, extras_terms: list[str] | None = None) -> DataFrame:
    """Discounts of study reports and of other domains, boost and discount by the release a query names, then a new order (ties: the old one)."""
    series = F.col("f_series") if "series" in queries.columns else F.lit(None).cast("string")
    cols = [F.col("series").alias("f_series")] if "series" in queries.columns else []
    cols += [F.col("release").alias("f_release")] if "release" in queries.columns else [F.lit(None).cast("string").alias("f_release")]
    x = hits.join(F.broadcast(queries.select("query_id", (F.col("original") if "original" in queries.columns else F.col("q")).alias("o"), *cols)), "query_id")
    score = F.col("score") * F.when(T.is_study(F.col("spec_type"), F.col("spec_id"), F.col("title"), s), s.study_discount).otherwise(1.0)
    score = score * F.when(T.is_numbered(F.col("spec_id")), 1.0).otherwise(T.extras_weight(series, F.col("o"), extras_terms or [], s))
    named = T.release_of(F.col("o"))
    free = F.coalesce(F.trim("f_release"), F.lit("")) == ""
    score = score * F.when(free & named.isNotNull(), F.when(F.lower("release") == F.lower(named), s.release_match).otherwise(s.release_mismatch)).otherwise(1.0)
    x = x.withColumn("score", T.round_to(score)).drop("f_series", "f_release", "o")
    return x.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def capped(hits: DataFrame, k, cap) -> tuple[DataFrame, DataFrame]:
    """The first k hits with at most cap of a specification, and what the cap dropped until then: (query_id, spec_id, dropped, best)."""
    x = hits.withColumn("kept", F.row_number().over(Window.partitionBy("query_id", "spec_id").orderBy("pos")) <= cap)
    before = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("so_far", F.coalesce(F.sum(F.col("kept").cast("int")).over(before), F.lit(0))).where(F.col("so_far") < k)
    final = x.where("kept").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).drop("kept", "so_far", "pos")
    drops = x.where("not kept").groupBy("query_id", "spec_id").agg(F.count("*").alias("dropped"), F.max("score").alias("best"))
    return final, drops


def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 10, cap: int | None = None, s: Settings = DEFAULT, scorer=lexical_scorer, substitutions: dict[str, str] | None = None, extras_terms: list[str] | None = None, index: lexical.Index | None = None) -> tuple[DataFrame, DataFrame]:
    """Hybrid search of a table of queries(query_id, q, vector[, original, series, release, doc_type]): final hits and what caps dropped.

    Candidates of each leg don't depend on k, so the best k are the first of the best k + 1. Both legs are ranked once, and their fusion is stored.
    """
    chunks = facts(chunks)
    d = dense.ranked(queries, vectors, chunks, s.candidates, s.dense_cap)
    l_ = lexical.cascade(queries, chunks, s.candidates, s, substitutions, extras_terms, index)
    fused = stored(discounted(fuse(d, l_, s), chunks, queries, s, extras_terms), "fused")
    if scorer is None:
        final, drops = capped(pool(fused, chunks, queries, k, max(cap or s.final_cap, 1), s), k, max(cap or s.final_cap, 1))
    else:
        p = pool(fused, chunks, queries, max(s.rerank_pool, k), max(cap or 0, s.rerank_cap), s)
        final, drops = capped(adjust(rerank(p, scorer), queries, s, extras_terms), k, max(cap or s.final_cap, 1))
    return final.join(support(fused, s.agreement_depth), ["query_id", "spec_id"], "left").fillna(0, ["support"]), drops


def confidence(hits: DataFrame, queries: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, level, margin, top, specs, support) for each query, also those without hits."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    g = hits.groupBy("query_id").agg(at(1).alias("top"), at(2).alias("second"), F.countDistinct("spec_id").alias("specs"), F.max(F.when(F.col("rank") == 1, F.col("support"))).alias("support"))
    x = queries.select("query_id").join(g, "query_id", "left").fillna({"top": 0.0, "second": 0.0, "specs": 0, "support": 0})
    margin = T.round_to(F.col("top") - F.col("second"))
    x = x.withColumn("margin", margin)
    level = F.when((F.col("top") < s.none_top) & (F.col("margin") < s.none_margin) & (F.col("specs") > 0), "none").when(F.col("margin") >= s.high_margin, "high").when(F.col("support") >= 2, "medium").otherwise("low")
    return x.select("query_id", F.when(F.col("specs") == 0, "low").otherwise(level).alias("level"), "margin", "top", "specs", "support")


def score_cut(hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Hits over the floor and over a share of their query's best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    x = hits.withColumn("bar", F.greatest(F.lit(s.score_floor), best * s.score_cut))
    return x.where(F.col("score") >= F.col("bar")).drop("bar") if max(s.score_floor, s.score_cut) > 0 else x.drop("bar")
