"""What happens before retrieval: guards, scope, intents, technology and synonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T


def guards(queries: DataFrame, series: DataFrame | None = None, s: Settings = DEFAULT) -> DataFrame:
    """queries with guard: null, or why a query isn't run (empty, document, unknown_series). series(series): those that are indexed."""
    x = queries.withColumn("guard", F.when(F.coalesce(F.trim("q"), F.lit("")) == "", "empty").when(T.document_shaped(F.col("q"), s), "document"))
    if series is not None and "series" in queries.columns:
        known = series.select(F.col("series").alias("k")).distinct()
        x = x.join(known, F.col("series") == F.col("k"), "left")
        x = x.withColumn("guard", F.coalesce("guard", F.when((F.coalesce(F.trim("series"), F.lit("")) != "") & F.col("k").isNull(), "unknown_series"))).drop("k")
    return x


def scope(queries: DataFrame, ownership: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, spec_id, topic, markers, blocks): markers of specifications outside the corpus that a query names; one blocking marker blocks it."""
    live = ownership.join(chunks.select("spec_id").distinct(), "spec_id", "left_anti")
    hit = queries.select("query_id", "q").join(F.broadcast(live), T.has_word(F.lower("q"), F.col("marker")))
    g = hit.groupBy("query_id", "spec_id").agg(F.min_by("topic", "ord").alias("topic"), F.concat_ws(",", F.array_sort(F.collect_set("marker"))).alias("markers"), F.max("block").alias("b"))
    return g.withColumn("blocks", F.max("b").over(Window.partitionBy("query_id"))).drop("b")


def residual(q, markers: list[str]):
    """The query without markers; null if less than 8 characters are left."""
    for m in markers:
        q = F.regexp_replace(q, r"(?i)(?<![\p{L}\p{Nd}])\Q" + m + r"\E(?![\p{L}\p{Nd}])", " ")
    q = T.collapse(q)
    return F.when(F.length(q) >= 8, q)


def keyword_intent(queries: DataFrame, heads: DataFrame, terms: DataFrame, default: str = "general") -> DataFrame:
    """(query_id, intent, sticky): the first intent by priority with a strong term, or two weak ones, in the query."""
    hit = queries.select("query_id", F.lower("q").alias("q")).join(F.broadcast(terms), F.col("q").contains(F.col("term")))
    g = hit.groupBy("query_id", "intent").agg(F.sum((F.col("kind") == "term").cast("int")).alias("strong"), F.sum((F.col("kind") == "weak").cast("int")).alias("weak")).where("strong > 0 or weak > 1")
    g = g.join(F.broadcast(heads), "intent").groupBy("query_id").agg(F.min_by(F.struct("intent", "sticky"), F.struct("priority", "intent")).alias("x"))
    return queries.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce("x.intent", F.lit(default)).alias("intent"), F.coalesce("x.sticky", F.lit(False)).alias("sticky"))


def nearest_exemplar(queries: DataFrame, exemplars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, intent, similarity) of the exemplar with the largest cosine, if that is large enough. exemplars(ord, intent, vector)."""
    q = queries.where("vector is not null").select("query_id", T.unit(F.col("vector")).alias("qv"))
    e = F.broadcast(exemplars.select("ord", "intent", T.unit(F.col("vector")).alias("ev")))
    x = q.join(e).select("query_id", "ord", "intent", T.round_to(T.dot(F.col("qv"), F.col("ev")), 6).alias("similarity"))
    best = x.groupBy("query_id").agg(F.max_by(F.struct("intent", "similarity"), F.struct("similarity", -F.col("ord"))).alias("x"))
    return best.select("query_id", "x.intent", "x.similarity").where(F.col("similarity") >= s.intent_similarity)


def intent(queries: DataFrame, heads: DataFrame, terms: DataFrame, exemplars: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, intent, method, similarity): a sticky keyword, else the nearest exemplar, else a keyword."""
    k, e = keyword_intent(queries, heads, terms), nearest_exemplar(queries, exemplars, s).select("query_id", F.col("intent").alias("e"), "similarity")
    x = k.join(e, "query_id", "left")
    return x.select("query_id", F.when(F.col("sticky"), F.col("intent")).otherwise(F.coalesce("e", "intent")).alias("intent"), F.when(F.col("sticky") | F.col("e").isNull(), "keyword").otherwise("exemplar").alias("method"), F.when(F.col("sticky"), 1.0).otherwise(F.coalesce("similarity", F.lit(0.0))).alias("similarity"))


def technology(df: DataFrame, aliases: DataFrame, default: str = "5g") -> DataFrame:
    """df(key, technology) with canonical: the first alias in the table's order that the input contains, else the default."""
    hit = df.select("key", F.lower("technology").alias("t")).join(F.broadcast(aliases.select("ord", "alias", F.col("technology").alias("canonical"))), F.col("t").contains(F.col("alias")))
    best = hit.groupBy("key").agg(F.min_by("canonical", "ord").alias("canonical"))
    return df.join(best, "key", "left").withColumn("canonical", F.coalesce("canonical", F.lit(default)))


def with_synonyms(df: DataFrame, table: DataFrame) -> DataFrame:
    """df(key, text) with expanded: every synonym whose key the text contains appended, in the table's order."""
    hit = df.select("key", F.lower("text").alias("t")).join(F.broadcast(table.withColumnRenamed("key", "word")), F.col("t").contains(F.col("word")))
    more = hit.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("m"))
    return df.join(more, "key", "left").withColumn("expanded", F.concat_ws(" ", "text", F.transform("m", lambda x: x["value"]))).drop("m")
