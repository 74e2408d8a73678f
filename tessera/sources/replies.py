"""Parsers of rendered replies: hits from JSON and from text, and evidence by layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HITS = "map<string, struct<no_match: boolean, not_searched: boolean, error: string, hits: array<struct<n: int, spec_id: string, score: double, title: string, release: string, excerpt: string>>>>"


def json_hits(replies: DataFrame) -> DataFrame:
    """(reply_id, q, rank, score, spec_id, title, excerpt) from batch replies: JSON maps from query to hits; keys that begin with _ are no queries. Queries without hits have one row without rank."""
    entries = replies.select("reply_id", F.explode(F.from_json("reply", _HITS)).alias("q", "v")).where(~F.col("q").startswith("_"))
    return entries.select("reply_id", "q", F.posexplode_outer("v.hits").alias("rank", "h")).select("reply_id", "q", (F.col("rank") + 1).alias("rank"), "h.score", "h.spec_id", "h.title", "h.excerpt")


_HIT = r"^\[(\d+)\] (\S+) \| (\S+) \| Score: (\d+\.\d+)$"
_PART = r"^    (Title|Series|Key|Excerpt|Before|After|Note) *: (.*)$"


def text_hits(replies: DataFrame) -> DataFrame:
    """(reply_id, rank, score, spec_id, release, title, excerpt) from text replies: lines such as `[1] 38.331 | Rel-17 | Score: 0.8120`, and labelled ones below them."""
    rows = replies.select("reply_id", F.posexplode(F.split("reply", "\n")).alias("line", "text"))
    rank = F.when(F.col("text").rlike(_HIT), F.regexp_extract("text", _HIT, 1).cast("int"))
    rows = rows.withColumn("rank", F.last(rank, True).over(Window.partitionBy("reply_id").orderBy("line"))).where("rank is not null")
    head, label = F.col("text").rlike(_HIT), F.regexp_extract("text", _PART, 1)
    first = lambda when, i, p=_HIT: F.first(F.when(when, F.regexp_extract("text", p, i)), True)
    return rows.groupBy("reply_id", "rank").agg(
        first(head, 4).cast("double").alias("score"), first(head, 2).alias("spec_id"), F.nullif(first(head, 3), F.lit("-")).alias("release"), first(label == "Title", 2, _PART).alias("title"), first(label.isin("Key", "Excerpt"), 2, _PART).alias("excerpt")
    )


_LAYER_HIT = r"^  (\S+) \| (\S+) \| chunk (-?\d+) \| score (\d+\.\d+(?:E-?\d+)?)$"
_LAYER = r"^=== (.+) \(series (\S+)\) ===$"


def layer_hits(replies: DataFrame) -> DataFrame:
    """(reply_id, layer, score, spec_id, chunk_index) from replies by layer; layers without evidence have a row without spec_id."""
    w = Window.partitionBy("reply_id").orderBy("line")
    rows = replies.select("reply_id", F.posexplode(F.split("reply", "\n")).alias("line", "text"))
    own = rows.withColumn("layer", F.last(F.nullif(F.regexp_extract("text", _LAYER, 1), F.lit("")), True).over(w)).where(F.col("text").rlike(_LAYER_HIT))
    g = lambda i: F.regexp_extract("text", _LAYER_HIT, i)
    own = own.select("reply_id", "layer", g(4).cast("double").alias("score"), g(1).alias("spec_id"), g(3).cast("int").alias("chunk_index"))
    none = rows.where(F.col("text").startswith("No strong evidence in: ")).select("reply_id", F.explode(F.split(F.substring("text", 24, 1 << 20), "; ")).alias("layer"))
    return own.unionByName(none.select("reply_id", F.regexp_replace("layer", r" \(series \S+\)$", "").alias("layer"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("spec_id"), F.lit(None).cast("int").alias("chunk_index")))
