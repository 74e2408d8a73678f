"""Replies as JSON and text columns, and the query log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T

#: Fields of a hit by field set.
FIELDS = {"MINIMAL": ("spec_id", "score", "title", "excerpt"), "LEAN": ("n", "spec_id", "score", "title", "release", "excerpt"), "FULL": ("n", "spec_id", "score", "title", "series", "release", "excerpt")}
NO_TEXT = "(no extractable text: ask for the specification)"


def _ready(hits: DataFrame, chars: int) -> DataFrame:
    """hits with n, release (null if blank) and excerpt: a text's beginning, where nothing was selected from it."""
    body = T.cap(T.collapse(F.col("text")), chars)
    own = F.coalesce(F.nullif(F.col("excerpt"), F.lit("")), body) if "excerpt" in hits.columns else body
    return hits.withColumn("n", F.col("rank")).withColumn("release", F.nullif(F.trim("release"), F.lit(""))).withColumn("excerpt", F.coalesce(F.nullif(own, F.lit("")), F.lit(NO_TEXT)))


def _with_notes(confidence: DataFrame, notes: DataFrame | None) -> DataFrame:
    """confidence with intent and caveat, from notes(query_id, intent, caveat) if there are any."""
    empty = confidence.withColumns({"intent": F.lit(None).cast("string"), "caveat": F.lit(None).cast("string")})
    return empty if notes is None else confidence.join(notes.select("query_id", "intent", "caveat"), "query_id", "left")


def json_replies(hits: DataFrame, confidence: DataFrame, fields: str = "LEAN", chars: int = 350, notes: DataFrame | None = None) -> DataFrame:
    """(query_id, reply): an object with the query's notes, its figures of confidence and its hits in order; what is null is left out."""
    rows = _ready(hits, chars).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.struct(*FIELDS[fields]).alias("h")))).alias("hits"))
    x = _with_notes(confidence, notes).join(rows, "query_id", "left").withColumn("some", F.col("hits").isNotNull())
    full = F.lit(fields != "MINIMAL") & F.col("some")
    when = lambda c, v: F.when(c, v)
    parts = [F.col("caveat").alias("coverage_note"), when(F.lit(fields != "MINIMAL"), F.col("intent")).alias("intent"), when(~F.col("some"), F.lit(True)).alias("no_match"), when(F.col("some"), T.round_to(F.col("top"), 3)).alias("top_score")]
    parts += [when(full, T.round_to(F.col("margin"), 3)).alias("margin"), when(full, F.col("specs")).alias("distinct_specs"), when(full, F.concat(F.col("support").cast("string"), F.lit("/2"))).alias("retrievers_agree")]
    return x.select("query_id", F.to_json(F.struct(*parts, F.coalesce(F.transform("hits", lambda h: h["h"]), F.array()).alias("hits"))).alias("reply"))


def batch_reply(replies: DataFrame, queries: DataFrame) -> DataFrame:
    """One row with the map from query to reply, in input order, as JSON."""
    x = queries.select("query_id", "q").join(replies, "query_id", "left")
    parts = F.array_sort(F.collect_list(F.struct("query_id", F.concat(F.to_json(F.array("q")), F.lit("\u0001"), F.coalesce("reply", F.lit("{}"))).alias("t"))))
    pair = lambda p: F.concat(F.regexp_replace(F.split_part(p["t"], F.lit("\u0001"), F.lit(1)), r"^\[|\]$", ""), F.lit(":"), F.split_part(p["t"], F.lit("\u0001"), F.lit(2)))
    return x.agg(F.concat(F.lit("{"), F.concat_ws(",", F.transform(parts, pair)), F.lit("}")).alias("reply"))


def note(level, partial):
    """What a reply says about its confidence."""
    return (
        F.when(partial, "Partial coverage: the owning specification is missing, so low scores are expected; cite these for general background only.")
        .when(level == "none", "Nothing matched: results are tied at the floor. Ask one short question for each item.").when(level == "high", "The first result stands out.")
        .when(level == "medium", "Close scores, but both retrievers chose this specification.").otherwise("Close scores, and the retrievers disagree: read several results.")
    )


def drop_notes(hits: DataFrame, drops: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """hits with dropped and dropped_best: what the cap cut from a hit's specification, if its best lies within the margin that separates scores."""
    d = drops.select("query_id", "spec_id", F.col("dropped").alias("_n"), F.col("best").alias("_b"))
    near = F.col("score") - F.col("_b") < s.high_margin
    return hits.join(d, ["query_id", "spec_id"], "left").withColumn("dropped", F.when(near, F.col("_n"))).withColumn("dropped_best", F.when(near, F.col("_b"))).drop("_n", "_b")


def text_replies(hits: DataFrame, confidence: DataFrame, chars: int = 350, notes: DataFrame | None = None, verbosity: str = "NORMAL") -> DataFrame:
    """(query_id, reply): a header with the figures of confidence, intent and note, and a block for each hit: its excerpt, its neighbours (columns before, after) and what the cap cut, if given. confidence has q."""
    own = _ready(hits, chars)
    col = lambda c: F.col(c) if c in hits.columns else F.lit(None).cast("string")
    line = lambda label, c: F.when(c.isNotNull(), F.concat(F.lit("    " + label.ljust(7) + ": "), c))
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("spec_id"), F.lit(" | "), F.coalesce("release", F.lit("-")), F.lit(" | Score: "), F.format_string("%.4f", "score"))
    cut = F.concat(col("dropped").cast("string"), F.lit(" more of this specification, up to "), col("dropped_best").cast("string"), F.lit(", were cut by the limit a specification"))
    block = F.concat_ws("\n", head, line("Title", F.col("title")), line("Series", F.col("series")), line("Key" if verbosity != "FULL" else "Excerpt", F.col("excerpt")), line("Before", F.concat(F.lit("…"), col("before"))), line("After", F.concat(col("after"), F.lit("…"))), line("Note", cut))
    rows = own.select("query_id", "rank", block.alias("b")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("l"))
    x = _with_notes(confidence, notes).join(rows, "query_id", "left")
    asked = F.concat(F.lit('"'), F.coalesce("q", F.lit("")), F.lit('"')) if "q" in confidence.columns else F.lit("")
    figures = F.format_string("Confidence: %s (margin=%.3f, top=%.2f, specs=%d, retrievers=%d/2)", "level", "margin", "top", "specs", "support")
    found = F.concat_ws("\n", F.concat(F.lit("Search results for: "), asked), F.format_string(f"(%d results, verbosity={verbosity.lower()})", F.size("l")), figures, F.concat(F.lit("Intent: "), F.col("intent")), F.concat(F.lit("Note   : "), note(F.col("level"), F.col("caveat").isNotNull())), F.concat_ws("\n", F.transform("l", lambda p: p["b"])))
    none = F.concat_ws("\n", F.concat(F.lit("No results found for: "), asked), figures, F.concat(F.lit("Intent: "), F.col("intent")))
    return x.select("query_id", F.concat_ws("\n\n", F.col("caveat"), F.when(F.col("l").isNull(), none).otherwise(found)).alias("reply"))


def layer_replies(evidence: DataFrame, empty: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, reply): evidence by layer in document order, each with its excerpt, and the layers without any. evidence: as by_layer gives it, with release and excerpt; empty(query_id, layer_ord, series, label)."""
    title = lambda: F.concat(F.col("label"), F.lit(" (series "), F.col("series"), F.lit(")"))
    line = F.concat(F.lit("  "), F.col("spec_id"), F.lit(" | "), F.coalesce("release", F.lit("-")), F.lit(" | chunk "), F.col("chunk_index").cast("string"), F.lit(" | score "), F.col("score").cast("string"), F.lit("\n    "), F.coalesce("excerpt", F.lit("")))
    per = evidence.groupBy("query_id", "layer_ord", "series", "label").agg(F.array_sort(F.collect_list(F.struct("place", line.alias("t")))).alias("l"))
    per = per.select("query_id", "layer_ord", "series", F.concat(F.lit("=== "), title(), F.lit(" ===\n"), F.concat_ws("\n", F.transform("l", lambda p: p["t"]))).alias("t"))
    body = per.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("layer_ord", "series", "t"))).alias("b"))
    none = empty.select("query_id", "layer_ord", "series", title().alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("layer_ord", "series", "t"))).alias("e"))
    x = requests.select("query_id", "q").join(body, "query_id", "left").join(none, "query_id", "left")
    head = F.concat(F.lit('Evidence by layer for: "'), F.col("q"), F.lit('"'))
    gone = F.concat(F.lit("No strong evidence in: "), F.concat_ws("; ", F.transform("e", lambda p: p["t"])))
    text = F.concat_ws("\n\n", head, F.concat_ws("\n\n", F.transform("b", lambda p: p["t"])), F.when(F.col("e").isNotNull(), gone))
    return x.select("query_id", F.when(F.col("b").isNull(), F.concat(F.lit('No evidence found for "'), F.col("q"), F.lit('"'))).otherwise(text).alias("reply"))


def spec_replies(asked: DataFrame, found: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, reply): a specification's head and its chunks; found: as lookup.spec_chunks gives it, for asked(query_id, spec_id, q)."""
    x = found.join(chunks.select("chunk_key", "title", "release", "series", "series_desc", "doc_type", "chunk_index", "total_chunks", "text"), "chunk_key")
    block = F.concat(F.lit("--- Chunk "), (F.col("chunk_index") + 1).cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")))
    row = F.struct("rank", "title", "release", "series", "series_desc", "doc_type", "total_chunks", "by", block.alias("t"))
    per = x.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("l"))
    y = asked.select("query_id", "spec_id", "q").join(per, "query_id", "left")
    first = lambda c: F.coalesce(F.col("l")[0][c].cast("string"), F.lit("-"))
    how = F.when(first("by") == "order", "  (document order)").otherwise(F.concat(F.lit('  (ranked for: "'), F.col("q"), F.lit('")')))
    lines = [F.concat(F.lit("=== "), first("doc_type"), F.lit(" "), F.col("spec_id"), F.lit(" ===")), F.concat(F.lit("Title   : "), first("title")), F.concat(F.lit("Release : "), first("release")), F.concat(F.lit("Series  : "), first("series"), F.lit(" - "), first("series_desc"))]
    lines += [F.concat(F.lit("Chunks  : showing "), F.size("l").cast("string"), F.lit(" of "), first("total_chunks"), F.lit(" total"), how), F.concat_ws("\n", F.transform("l", lambda p: p["t"]))]
    return y.select("query_id", F.when(F.col("l").isNull(), F.concat(F.lit("Specification '"), F.col("spec_id"), F.lit("' not found."))).otherwise(F.concat_ws("\n", *lines)).alias("reply"))


def series_table(series: DataFrame) -> DataFrame:
    """(series, line): fixed-width lines of the catalogue of series."""
    return series.select("series", F.concat(F.rpad("series", 8, " "), F.lit(" "), F.rpad(F.when(F.col("indexed"), "yes").otherwise("no"), 9, " "), F.lit(" "), F.col("name")).alias("line"))


def stats_lines(stats: DataFrame) -> DataFrame:
    """(ord, line): labelled figures of the corpus. stats: as lookup.stats gives them."""
    pairs = [("Total chunks", F.format_number("chunks", 0)), ("Unique specs", F.col("specs").cast("string")), ("  Substantive", (F.col("specs") - F.col("stubs")).cast("string")), ("  Stub-only", F.col("stubs").cast("string")), ("Series", F.col("series").cast("string")), ("Sources", F.col("sources").cast("string"))]
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.concat(F.rpad(F.lit(name), 18, " "), F.lit(": "), value).alias("line")) for i, (name, value) in enumerate(pairs)])
    return stats.select(F.inline(rows))


def spec_table(specs: DataFrame) -> DataFrame:
    """(spec_id, line): fixed-width lines of a list of specifications: id, type, release, chunks and series."""
    cell = lambda c, n: F.concat(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), n, " "), F.lit(" "))
    return specs.select("spec_id", F.concat(cell("spec_id", 14), cell("doc_type", 5), cell("release", 10), cell("total_chunks", 8), F.coalesce("series", F.lit("-"))).alias("line"))


#: Steps at which replies are clipped: characters of an excerpt, and hits that are kept.
STEPS = ((1200, 99), (800, 99), (500, 99), (500, 4), (500, 3), (500, 2), (500, 1), (300, 1), (160, 1))


def clip_budget(n_queries):
    """Characters of a reply to so many queries."""
    return F.least(F.lit(40000), n_queries * 5000)


def clipped(replies: DataFrame, hits: DataFrame, budget: int = 5000, steps: tuple = STEPS) -> DataFrame:
    """(query_id, chars, keep): the first step of a ladder (excerpt length, hits kept) whose reply fits a budget of characters; else the last."""
    sizes = [F.sum(F.when(F.col("rank") <= keep, F.least(F.length("text"), F.lit(chars)) + 80)).alias(f"s{i}") for i, (chars, keep) in enumerate(steps)]
    x = hits.groupBy("query_id").agg(*sizes)
    chosen = F.coalesce(*[F.when(F.col(f"s{i}") <= budget, F.lit(i)) for i in range(len(steps))], F.lit(len(steps) - 1))
    at = lambda j: F.element_at(F.array(*[F.lit(s[j]) for s in steps]), chosen + 1)
    return replies.select("query_id").join(x.select("query_id", at(0).alias("chars"), at(1).alias("keep")), "query_id", "left")


def clip(hits: DataFrame, budget: int = 5000) -> DataFrame:
    """hits that a reply of the budget has room for, their texts cut to the length of the step."""
    step = clipped(hits.select("query_id").distinct(), hits, budget)
    return hits.join(step, "query_id").where(F.col("rank") <= F.col("keep")).withColumn("text", F.when(F.length("text") > F.col("chars"), F.concat(F.substring("text", F.lit(1), F.col("chars")), F.lit("…"))).otherwise(F.col("text"))).drop("chars", "keep")


def query_log(queries: DataFrame, hits: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """(value): a JSON line for each executed query: its filters where set, the number of hits and the first five."""
    five = hits.where("rank <= 5").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "spec_id", "score"))).alias("top"))
    n = hits.groupBy("query_id").agg(F.count("*").alias("count"))
    x = queries.join(n, "query_id", "left").join(five, "query_id", "left")
    cols = [F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("series", "release", "doc_type") if c in queries.columns]
    return x.select(F.to_json(F.struct(F.current_timestamp().alias("ts"), F.col("q").alias("query"), *cols, F.coalesce("count", F.lit(0)).alias("count"), "top")).alias("value"))


def write_log(queries: DataFrame, hits: DataFrame, path: str) -> None:
    query_log(queries, hits).write.mode("append").text(path)


def by_layer(df: DataFrame) -> DataFrame:
    """Evidence rows (query_id, layer_ord, series, label, spec_id, chunk_index, score) in document order; ranks within a layer."""
    w = Window.partitionBy("query_id", "layer_ord", "series").orderBy("spec_id", "chunk_index")
    return df.withColumn("place", F.row_number().over(w))
