"""Streaming forms of the query log and the result cache. An addition: the batch operators don't need them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "ts timestamp, query string, series string, release string, doc_type string, count long"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The query log as a stream of rows."""
    return spark.readStream.text(path).select(F.from_json("value", LOG).alias("r")).select("r.*")


def rollup(log: DataFrame, ts: str = "ts", width: str = "10 minutes", late: str = "10 minutes", kind: str = "series") -> DataFrame:
    """(start, kind, queries) by window; rows later than the watermark are dropped."""
    x = log.withWatermark(ts, late) if log.isStreaming else log
    return x.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("queries")).select(F.col("w.start").alias("start"), kind, "queries")


def first_in_ttl(requests: DataFrame, keys: list[str], ts: str = "ts", ttl: str = "10 minutes") -> DataFrame:
    """Requests whose key wasn't seen within the time to live: what a cache would have let through."""
    return requests.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)
