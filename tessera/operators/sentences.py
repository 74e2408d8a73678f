"""Extraction of the sentences that answer a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..storage import stored


def similar(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, doc_id, jaccard) of queries(query_id, a) and texts(doc_id, b), arrays of distinct tokens, where they share one; all others have similarity 0. Queries are a stated set."""
    q = queries.select("query_id", F.size("a").alias("n"), F.explode("a").alias("t"))
    d = texts.select("doc_id", F.size("b").alias("m"), F.explode("b").alias("t"))
    both = d.join(F.broadcast(q), "t").groupBy("query_id", "doc_id", "n", "m").agg(F.count("*").alias("c"))
    return both.select("query_id", "doc_id", (F.col("c") / (F.col("n") + F.col("m") - F.col("c"))).alias("jaccard"))


def exploded(hits: DataFrame) -> DataFrame:
    """(query_id, chunk_key, i, sentence, score): sentences by position, scored by overlap with the query. hits: query_id, chunk_key, q, text."""
    x = hits.select("query_id", "chunk_key", "q", F.posexplode(T.sentences(T.collapse(F.col("text")))).alias("i", "sentence"))
    return x.withColumn("score", T.jaccard(T.content_tokens(F.col("q")), T.content_tokens(F.col("sentence"))))


def enumerations(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(keys..., is_list): texts in which enough sentences share their second word. df: key columns, i, sentence."""
    keys = [c for c in df.columns if c not in ("i", "sentence", "score", "q")]
    word = F.lower(F.regexp_replace(F.try_element_at(F.split("sentence", r"\s+"), F.lit(s.enum_index + 1)), "[^A-Za-z0-9]", ""))
    per = df.withColumn("w", word).where(F.length("w") >= s.enum_token).groupBy(*keys, "w").agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg((F.max("n") >= s.enum_bucket).alias("is_list"))


def eligible(df: DataFrame, gap: float, floor: float) -> DataFrame:
    """Sentences not far below the best of their text; if none is over the floor, the best one."""
    w = Window.partitionBy("query_id", "chunk_key")
    best = F.row_number().over(w.orderBy(F.desc("score"), "i")) == 1
    x = df.withColumn("bar", F.greatest(F.lit(floor), F.max("score").over(w) - F.lit(float(gap)))).withColumn("best", best)
    x = x.withColumn("some", F.max((F.col("score") >= F.col("bar")).cast("int")).over(w))
    return x.where((F.col("score") >= F.col("bar")) | (F.col("some") == 0) & F.col("best")).drop("bar", "best", "some")


def mmr(df: DataFrame, picks: int, lam: float) -> DataFrame:
    """(query_id, chunk_key, pick, i): greedy selection by lam * score - (1 - lam) * largest similarity to what is chosen.

    A fold over an array of the text's eligible sentences, of at most `picks` rounds.
    """
    item = F.struct("i", "score", T.content_tokens(F.col("sentence")).alias("t"))
    g = df.groupBy("query_id", "chunk_key").agg(F.array_sort(F.collect_list(item)).alias("a"))
    empty = F.slice("a", 1, 0)

    def add(chosen, _):
        def value(x):
            near = F.array_max(F.transform(chosen, lambda c: T.jaccard(c["t"], x["t"])))
            return F.struct((F.lit(lam) * x["score"] - F.lit(1 - lam) * F.coalesce(near, F.lit(0.0))).alias("v"), (-x["i"]).alias("o"))

        left = F.filter("a", lambda x: ~F.exists(chosen, lambda c: c["i"] == x["i"]))
        best = F.array_max(F.transform(left, value))
        found = F.filter(left, lambda x: x["i"] == -best["o"])
        return F.when(F.size(left) == 0, chosen).otherwise(F.concat(chosen, F.slice(found, 1, 1)))

    g = g.select("query_id", "chunk_key", F.aggregate(F.sequence(F.lit(1), F.lit(picks)), empty, add).alias("c"))
    return g.select("query_id", "chunk_key", F.posexplode("c").alias("pick", "x")).select("query_id", "chunk_key", (F.col("pick") + 1).alias("pick"), F.col("x.i").alias("i"))


def windowed(picked: DataFrame, all_: DataFrame, width: int) -> DataFrame:
    """Picked sentences and their neighbours, each once, in order, with `gap` where the one before is missing."""
    near = picked.select("query_id", "chunk_key", F.explode(F.sequence(F.col("i") - width, F.col("i") + width)).alias("i")).distinct()
    x = near.join(all_.select("query_id", "chunk_key", "i", "sentence"), ["query_id", "chunk_key", "i"])
    before = F.lag("i").over(Window.partitionBy("query_id", "chunk_key").orderBy("i"))
    return x.withColumn("gap", F.coalesce(F.col("i") - before > 1, F.lit(False)))


def paths(hits: DataFrame, preset: tuple, s: Settings = DEFAULT) -> DataFrame:
    """hits with path, how a text's excerpt is made: blank, structure (lists of contents and tables, by their lines), short, list (parallel sentences; brief presets don't look for them) or prose."""
    x = hits.withColumn("_t", T.collapse(F.col("text"))).withColumn("_s", T.sentences(F.col("_t")))
    parallel = F.lit(False) if preset[0] < s.enum_least_picks else F.array_max(_buckets(F.col("_s"), s)) >= s.enum_bucket
    path = F.when(F.coalesce("_t", F.lit("")) == "", "blank").when(T.shape(F.col("text"), s) != "prose", "structure").when(F.size("_s") <= 1, "short").when(F.coalesce(parallel, F.lit(False)), "list").otherwise("prose")
    return x.withColumn("path", path).drop("_t", "_s")


def _buckets(found, s: Settings):
    """For each sentence the number of those with its bucket word."""
    word = lambda x: F.lower(F.regexp_replace(F.coalesce(F.try_element_at(F.split(x, r"\s+"), F.lit(s.enum_index + 1)), F.lit("")), "[^A-Za-z0-9]", ""))
    words = F.filter(F.transform(found, word), lambda w: F.length(w) >= s.enum_token)
    return F.transform(F.array_distinct(words), lambda w: F.size(F.filter(words, lambda v: v == w)))


def excerpts(hits: DataFrame, preset: tuple, s: Settings = DEFAULT) -> DataFrame:
    """(query_id, chunk_key, excerpt), by path: structure is cut to a length, short texts stay whole, prose gives its best sentences with neighbours, and a list all its sentences over the
    least score, up to a larger number, without regard to how alike they are."""
    picks, gap, lam, width, chars = preset
    x = stored(paths(hits.select("query_id", "chunk_key", "q", "text"), preset, s), "texts")
    whole = T.collapse(F.col("text"))
    plain = F.when(F.col("path") == "blank", "").when(F.col("path") == "structure", T.cap(whole, chars * s.toc_multiplier)).otherwise(whole)
    rest = x.where("path not in ('list', 'prose')").select("query_id", "chunk_key", plain.alias("excerpt"))
    every = exploded(x.where("path in ('list', 'prose')")).join(x.select("query_id", "chunk_key", "path"), ["query_id", "chunk_key"])
    prose = mmr(eligible(every.where("path = 'prose'"), gap, s.sentence_floor), picks, lam)
    # with all weight on the score, greedy selection is a ranking
    best = F.row_number().over(Window.partitionBy("query_id", "chunk_key").orderBy(F.desc("score"), "i"))
    lists = eligible(every.where("path = 'list'"), float("inf"), s.sentence_floor)
    many = lists.withColumn("pick", best).where(F.col("pick") <= max(picks + s.enum_extra, s.enum_picks)).select("query_id", "chunk_key", "pick", "i")
    chosen = windowed(prose.unionByName(many), every, width)
    parts = F.array_sort(F.collect_list(F.struct("i", F.when(F.col("gap"), F.concat(F.lit("… "), F.col("sentence"))).otherwise(F.col("sentence")).alias("t"))))
    text = chosen.groupBy("query_id", "chunk_key").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["t"])).alias("excerpt"))
    return text.unionByName(rest)


def counters(hits: DataFrame, preset: tuple, s: Settings = DEFAULT) -> DataFrame:
    """(path, n): how often each way to an excerpt is taken."""
    return paths(hits, preset, s).groupBy("path").agg(F.count("*").alias("n"))
