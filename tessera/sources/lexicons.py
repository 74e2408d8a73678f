"""Readers of configuration tables: lines of tab-separated text, # for comments. A missing file gives an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .corpus import exists


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, line) without blank lines and comments; ord is the order of the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], "ord long, line string")
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "line"))
    return raw.select(F.col("ord").cast("long"), "line").where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))


def token_list(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select(F.lower(F.trim("line")).alias("token")).distinct()


def _columns(df: DataFrame, n: int) -> DataFrame:
    parts = F.split("line", "\t", n)
    return df.select("ord", parts.alias("c")).withColumn("n", F.size("c"))


def pairs(spark: SparkSession, path: str, key=F.lower, value=F.lower) -> DataFrame:
    """(key, value) split at the first tab; rows without both are dropped; the last row of a key wins."""
    two = _columns(lines(spark, path), 2).where("n = 2").select("ord", key(F.trim(F.col("c")[0])).alias("key"), value(F.trim(F.col("c")[1])).alias("value"))
    return two.where("key <> '' and value <> ''").groupBy("key").agg(F.max_by("value", "ord").alias("value"))


def glossary(spark: SparkSession, path: str) -> DataFrame:
    return pairs(spark, path, F.upper, lambda c: c)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    return pairs(spark, path, lambda c: c, lambda c: c).orderBy("key")


def synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, value) in the file's order."""
    two = _columns(lines(spark, path), 2).where("n = 2")
    return two.select("ord", F.lower(F.trim(F.col("c")[0])).alias("key"), F.trim(F.col("c")[1]).alias("value")).where("key <> ''")


def _at(i: int, default: str | None = None):
    c = F.nullif(F.trim(F.try_element_at("c", F.lit(i + 1))), F.lit(""))
    return c if default is None else F.coalesce(c, F.lit(default))


def ownership(spark: SparkSession, path: str) -> DataFrame:
    """(ord, marker, spec_id, topic, block): a topic defaults to the specification; mode `note` doesn't block."""
    rows = _columns(lines(spark, path), -1).where("n >= 2")
    return rows.select("ord", F.lower(_at(0)).alias("marker"), _at(1).alias("spec_id"), F.coalesce(_at(2), _at(1)).alias("topic"), (F.lower(_at(3, "")) != "note").alias("block")).where("marker is not null and spec_id is not null")


def intents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Intents (intent, priority, sticky, hint), their terms (intent, term, kind), and terms of undeclared intents."""
    rows = _columns(lines(spark, path), -1).withColumn("kind", F.lower(_at(0)))
    heads = rows.where("kind = 'intent' and n >= 5").select(_at(1).alias("intent"), _at(2).try_cast("int").alias("priority"), (F.lower(_at(3)).isin("true", "yes", "1", "sticky")).alias("sticky"), _at(4, "").alias("hint")).where("priority is not null")
    terms = rows.where("kind in ('term', 'weak') and n >= 3").select(_at(1).alias("intent"), F.lower(_at(2)).alias("term"), "kind")
    return heads, terms.join(heads, "intent", "left_semi"), terms.join(heads, "intent", "left_anti")


def exemplars(spark: SparkSession, path: str, heads: DataFrame) -> DataFrame:
    """(intent, text) of declared intents."""
    two = _columns(lines(spark, path), 2).where("n = 2").select(F.trim(F.col("c")[0]).alias("intent"), F.trim(F.col("c")[1]).alias("text"))
    return two.join(heads, "intent", "left_semi")


def layers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Procedure layers (series, ord, technology, per_layer, prefer, label) and technology aliases (ord, alias, technology)."""
    rows = _columns(lines(spark, path), -1).withColumn("kind", F.lower(_at(0)))
    prefer = F.filter(F.transform(F.split(_at(5, "-"), ","), lambda x: F.trim(x)), lambda x: (x != "") & (x != "-"))
    out = rows.where("kind = 'layer' and n >= 7").select(_at(1).alias("series"), _at(2).try_cast("int").alias("ord"), F.lower(_at(3)).alias("technology"), _at(4).try_cast("int").alias("per_layer"), prefer.alias("prefer"), _at(6).alias("label"))
    return out.where("ord is not null and per_layer is not null"), rows.where("kind = 'alias' and n >= 3").select("ord", F.lower(_at(1)).alias("alias"), F.lower(_at(2)).alias("technology"))


def chunk_rules(spark: SparkSession, path: str) -> DataFrame:
    """(kind, priority, name, value) of rows split, marker and limit."""
    rows = _columns(lines(spark, path), -1).withColumn("kind", F.lower(_at(0)))
    return rows.where("kind in ('split', 'marker', 'limit') and n >= 3").select("kind", _at(1).try_cast("int").alias("priority"), F.coalesce(_at(2), _at(1)).alias("name"), F.coalesce(_at(3), _at(2)).alias("value"))


def mapping(df: DataFrame) -> dict[str, str]:
    """A configuration table of pairs as a dictionary."""
    return {r.key: r.value for r in df.collect()}
