"""Lookups beside search: definitions, chunks of a specification, neighbours, catalogue and statistics, citations, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..config import DEFAULT, TECHNOLOGY_SERIES, VENDOR_SERIES, Settings
from ..functions import text as T
from . import lexical

#: Fixed value: the form of a definition; %s is the quoted name. Suffixes of the name are allowed.
DEFINITION = r"(?i)\b(%s(?:-[A-Za-z0-9]+)*)\s*(?:::=)?\s*(ENUMERATED\s*\{[^}]{0,300}\}|INTEGER\s*\([^)]{0,80}\)|BIT\s+STRING[^,;}]{0,80})"
_FOUND = ArrayType(StructType([StructField("name", StringType()), StructField("definition", StringType()), StructField("at", IntegerType()), StructField("end", IntegerType())]))


@F.pandas_udf(_FOUND)
def _matches(text: pd.Series, pattern: pd.Series) -> pd.Series:
    """Matches with their offsets, which the built-in functions don't give; only rows that contain the name get here."""
    import re

    return pd.Series([[{"name": m[1], "definition": m[2], "at": m.start(), "end": m.end()} for m in re.finditer(p, t)] for t, p in zip(text, pattern, strict=True)])


def _quoted(name):
    return F.regexp_replace(name, r"([^A-Za-z0-9_\s])", r"\\$1")


def _matched(asked: DataFrame, texts: DataFrame, pattern: str) -> DataFrame:
    """texts that are like a name, exploded to the definitions of that name in them: query_id, wanted, n, m. In names, % and _ stand for any characters where texts are filtered."""
    q = asked.where(F.coalesce(F.trim("name"), F.lit("")) != "").select("query_id", F.trim("name").alias("wanted"), (F.col("series") if "series" in asked.columns else F.lit(None).cast("string")).alias("f_series"))
    like = F.expr(r"text ilike concat('%', replace(wanted, '\\', '\\\\'), '%')")
    own = F.col("series") if "series" in texts.columns else F.lit(None).cast("string")
    x = texts.join(F.broadcast(q), like & (T.passes(F.col("f_series"), own) if "series" in texts.columns else F.lit(True)))
    before, after = pattern.split("%s")
    return x.select("*", F.posexplode(_matches("text", F.concat(F.lit(before), _quoted(F.col("wanted")), F.lit(after)))).alias("n", "m"))


def definitions(asked: DataFrame, chunks: DataFrame, limit: int = 8, pattern: str = DEFINITION) -> DataFrame:
    """(query_id, rank, spec_id, name, definition, context) by scanning chunks. asked: query_id, name[, series]."""
    x = _matched(asked, chunks.where(~T.is_binary(F.col("text"))), pattern)
    start = F.greatest(F.col("m.at") - 160, F.lit(0))
    x = x.select("query_id", "spec_id", "load_ord", "n", "m.name", T.collapse(F.col("m.definition")).alias("definition"), T.collapse(F.substring("text", start + 1, F.col("m.end") - start + 60)).alias("context"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "spec_id", "name", "definition").orderBy("load_ord", "n"))).where("k = 1")
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("load_ord", "n"))).where(F.col("rank") <= limit).select("query_id", "rank", "spec_id", "name", "definition", "context")


def clause_definitions(asked: DataFrame, clauses: DataFrame, chunks: DataFrame, limit: int = 8, pattern: str = DEFINITION) -> DataFrame:
    """As definitions, from the clauses where these have any (those whose own name begins with the wanted one first, then short ones; the context is the whole clause), else by scanning chunks."""
    x = _matched(asked, clauses, pattern).select("query_id", "spec_id", "n", "m.name", T.collapse(F.col("m.definition")).alias("definition"), T.collapse(F.col("text")).alias("context"), F.when(F.ilike("ie_name", F.concat(F.col("wanted"), F.lit("%"))), 0).otherwise(1).alias("first"), F.length("text").alias("size"), "clause_id")
    order = ("first", "size", "spec_id", "clause_id", "n")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "spec_id", "name", "definition").orderBy(*order))).where("k = 1")
    got = x.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).select("query_id", "rank", "spec_id", "name", "definition", "context")
    return got.unionByName(definitions(asked.join(got, "query_id", "left_anti"), chunks, limit, pattern))


def spec_chunks(asked: DataFrame, chunks: DataFrame, n: int = 5, index: lexical.Index | None = None) -> DataFrame:
    """(query_id, rank, chunk_key, by): chunks of asked(query_id, spec_id, q): by relevance if the query matches, else in document order."""
    terms = asked.select("query_id", F.explode(T.search_terms(F.col("q"))).alias("term")).withColumn("stage", F.lit(1))
    index = index or lexical.build(chunks)
    own = chunks.select("chunk_key", "spec_id", "chunk_index", "db_idx").join(F.broadcast(asked.select("query_id", "spec_id")), "spec_id")
    weighted = lexical.weights(lexical.term_hits(index, terms, False), index).join(own.select("chunk_key").distinct(), "chunk_key", "left_semi")
    scored = lexical.score(terms, weighted, False)
    x = own.join(scored.select("query_id", "chunk_key", "score"), ["query_id", "chunk_key"], "left")
    q = Window.partitionBy("query_id")
    x = x.withColumn("some", F.max("score").over(q)).where(F.col("score").isNotNull() | F.col("some").isNull())
    x = x.withColumn("source", F.min("db_idx").over(q)).where("db_idx = source")
    return x.withColumn("rank", F.row_number().over(q.orderBy(F.desc_nulls_last("score"), "chunk_index", "chunk_key"))).where(F.col("rank") <= n).select("query_id", "rank", "chunk_key", F.when(F.col("some").isNull(), "order").otherwise("relevance").alias("by"))


def neighbours(hits: DataFrame, chunks: DataFrame, chars: int = DEFAULT.preview) -> DataFrame:
    """(query_id, chunk_key, before, after): ends and beginnings of the chunks beside a hit. Of chunks with one position the last loaded counts; unknown positions have none."""
    at = chunks.where("chunk_index >= 0").groupBy("spec_id", "chunk_index").agg(F.max_by("text", "load_ord").alias("t"))
    at = at.withColumn("t", F.when(~T.is_binary(F.col("t")), F.col("t")))
    x = hits.select("query_id", "chunk_key").join(chunks.select("chunk_key", "spec_id", "chunk_index"), "chunk_key")
    prev = at.select("spec_id", (F.col("chunk_index") + 1).alias("chunk_index"), T.tail(F.col("t"), chars).alias("before"))
    next_ = at.select("spec_id", (F.col("chunk_index") - 1).alias("chunk_index"), T.head(F.col("t"), chars).alias("after"))
    known = F.col("chunk_index") >= 0
    return x.join(prev, ["spec_id", "chunk_index"], "left").join(next_, ["spec_id", "chunk_index"], "left").select("query_id", "chunk_key", F.when(known, F.col("before")).alias("before"), F.when(known, F.col("after")).alias("after"))


def list_specs(chunks: DataFrame) -> DataFrame:
    """A row for each specification: from its chunk with the largest total; a later source replaces an earlier one."""
    row = F.struct("title", "release", "series", "doc_type", "total_chunks", F.lit(0).alias("z"))
    per = chunks.groupBy("spec_id", "db_idx").agg(F.max_by(row, F.struct("total_chunks", -F.col("load_ord"))).alias("r"))
    last = per.groupBy("spec_id").agg(F.max_by("r", "db_idx").alias("r"), F.max("db_idx").alias("db_idx"))
    return last.select("spec_id", "db_idx", "r.title", "r.release", "r.series", "r.doc_type", "r.total_chunks")


def list_series(catalogue: DataFrame, chunks: DataFrame) -> DataFrame:
    """catalogue(series, name) with whether a series is indexed."""
    return catalogue.join(chunks.select("series").distinct().withColumn("i", F.lit(True)), "series", "left").select("series", "name", F.coalesce("i", F.lit(False)).alias("indexed"))


def stats(chunks: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    per = chunks.groupBy("spec_id").agg(F.count("*").alias("n"))
    return chunks.agg(F.count("*").alias("chunks"), F.countDistinct("spec_id").alias("specs"), F.countDistinct("series").alias("series"), F.countDistinct("db_idx").alias("sources")).join(per.agg(F.count_if(F.col("n") <= s.stub_chunks).alias("stubs")))


def citations(drafts: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, spec_id, status): cited and found (supported), cited only (unsupported), found only (omitted). drafts: query_id, draft; hits: query_id, spec_id."""
    cited = drafts.select("query_id", F.explode(T.spec_ids(F.col("draft"))).alias("spec_id")).withColumn("c", F.lit(1))
    found = hits.select("query_id", "spec_id").distinct().withColumn("f", F.lit(1))
    return cited.join(found, ["query_id", "spec_id"], "full").select("query_id", "spec_id", F.when(F.col("c").isNull(), "omitted").when(F.col("f").isNull(), "unsupported").otherwise("supported").alias("status"))


_ITEM = "array<struct<parameterName: string, moHierarchy: string, goldenValue: string, currentValue: string>>"
_PAYLOAD = f"struct<data: struct<technology: string, vendor: string, nonCompliancedata: {_ITEM}>, technology: string, vendor: string, nonCompliancedata: {_ITEM}>"


def _payload(c):
    """Technology, vendor and items of a payload, which may be wrapped in `data`."""
    p = F.from_json(c, _PAYLOAD)
    part = lambda name: F.when(p["data"].isNotNull(), p["data"][name]).otherwise(p[name])
    return F.struct(F.lower(F.coalesce(part("technology"), F.lit(""))).alias("technology"), F.lower(F.coalesce(part("vendor"), F.lit(""))).alias("vendor"), part("nonCompliancedata").alias("items"))


def is_audit(q):
    """Whether an input is a configuration payload: an object with a list of items of which one has a parameterName."""
    named = F.exists(_payload(q)["items"], lambda x: F.coalesce(x["parameterName"], F.lit("")) != "")
    return F.ltrim(q).startswith("{") & F.coalesce(named, F.lit(False))


def audit_parameters(payloads: DataFrame, limit: int = 20, aliases: dict[str, str] | None = None, plan: DataFrame | None = None) -> DataFrame:
    """(payload_id, pos, series, name, term, context, query, golden, current, queried, planned_out): parameters of configuration payloads, each once, the first `limit` of them to be queried.

    aliases: the specifications' terms for cleaned names. plan(payload_id, name, relevant, term, reason) may leave parameters out (relevant is false; none is no opinion), and its terms
    come before aliases. series is that of the technology, else that of the vendor, else empty.
    """
    x = payloads.select("payload_id", _payload(F.col("payload")).alias("p"))
    table = lambda c, t: F.coalesce(*[F.when(c == k, v) for k, v in t.items()], F.lit(""))
    series = table(F.col("p.technology"), TECHNOLOGY_SERIES)
    x = x.select("payload_id", F.when(series != "", series).otherwise(table(F.col("p.vendor"), VENDOR_SERIES)).alias("series"), F.posexplode("p.items").alias("pos", "r"))
    x = x.select("payload_id", "pos", "series", F.trim("r.parameterName").alias("name"), F.concat_ws("/", T.object_context(F.coalesce("r.moHierarchy", F.lit("")), F.col("r.parameterName"))).alias("context"), F.col("r.goldenValue").alias("golden"), F.col("r.currentValue").alias("current")).where("name <> ''")
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("payload_id", "name", "context").orderBy("pos"))).where("k = 1").drop("k")
    x = x.withColumn("queried", F.row_number().over(Window.partitionBy("payload_id").orderBy("pos")) <= limit).withColumn("term", T.canonical(F.col("name"), aliases or {}))
    if plan is not None:
        x = x.join(plan.select("payload_id", "name", F.nullif(F.trim("term"), F.lit("")).alias("p_term"), (F.col("relevant") == F.lit(False)).alias("out")), ["payload_id", "name"], "left")
        x = x.withColumn("term", F.coalesce("p_term", "term")).withColumn("planned_out", F.col("queried") & F.coalesce("out", F.lit(False))).withColumn("queried", F.col("queried") & ~F.coalesce("out", F.lit(False))).drop("p_term", "out")
    else:
        x = x.withColumn("planned_out", F.lit(False))
    x = x.withColumn("query", F.trim(F.concat_ws(" ", "term", F.replace("context", F.lit("/"), F.lit(" ")))))
    return x.select("payload_id", "pos", "series", "name", "term", "context", "query", "golden", "current", "queried", "planned_out")


def audit_verdicts(parameters: DataFrame, hits: DataFrame) -> DataFrame:
    """parameters with present: their name or term occurs in the excerpt or title of one of their hits, with or without hyphens. hits: payload_id, pos, title, text."""
    bare = lambda c: F.replace(F.lower(c), F.lit("-"), F.lit(""))
    body = F.concat_ws(" ", "title", "text")
    has = lambda t: F.lower(body).contains(F.lower(t)) | bare(body).contains(bare(t))
    found = parameters.select("payload_id", "pos", "name", "term").join(hits, ["payload_id", "pos"]).groupBy("payload_id", "pos").agg(F.max(has(F.col("name")) | has(F.col("term"))).alias("present"))
    return parameters.join(found, ["payload_id", "pos"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def audit_totals(parameters: DataFrame) -> DataFrame:
    """Each payload's counts; skipped are those beyond the limit."""
    skipped = ~F.col("queried") & ~F.col("planned_out")
    return parameters.groupBy("payload_id").agg(F.count("*").alias("total"), F.countDistinct("name").alias("names"), F.count_if(F.col("queried")).alias("queried"), F.count_if(F.col("planned_out")).alias("planned_out"), F.count_if(skipped).alias("skipped"))


def list_coverage(questions: DataFrame, searched: DataFrame) -> DataFrame:
    """(key, items, searched, in_answer, never_searched, missing): for questions(key, q, answer) that are lists, which items were searched (searched: key, q) and which the answer names."""
    x = questions.select("key", F.lower(F.coalesce("answer", F.lit(""))).alias("body"), F.posexplode(T.list_items(F.col("q"))).alias("i", "item"))
    ran = searched.select("key", F.lower(F.trim("q")).alias("low"), F.lit(True).alias("ran")).distinct()
    x = x.withColumn("low", F.lower("item")).join(ran, ["key", "low"], "left").withColumn("ran", F.coalesce("ran", F.lit(False))).withColumn("said", F.col("body").contains(F.col("low")))
    left = lambda c: F.transform(F.array_sort(F.collect_list(F.when(~F.col(c), F.struct("i", "item")))), lambda v: v["item"])
    return x.groupBy("key").agg(F.count("*").alias("items"), F.count_if(F.col("ran")).alias("searched"), F.count_if(F.col("said")).alias("in_answer"), left("ran").alias("never_searched"), left("said").alias("missing"))


def packed(blocks: DataFrame, budget: int) -> DataFrame:
    """blocks(key, pos, text) with group: greedy packing in order, each group up to a budget of characters. A fold over each key's lengths."""
    g = blocks.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", F.length("text").alias("n")))).alias("a"))
    zero = F.struct(F.lit(0).alias("g"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def add(acc, x):
        new = (acc["used"] > 0) & (acc["used"] + x["n"] > budget)
        g_ = F.when(new, acc["g"] + 1).otherwise(acc["g"])
        return F.struct(g_.alias("g"), F.when(new, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), F.concat(acc["out"], F.array(g_)).alias("out"))

    g = g.select("key", F.explode(F.arrays_zip(F.col("a.pos").alias("pos"), F.aggregate("a", zero, add)["out"].alias("group"))).alias("z"))
    return blocks.join(g.select("key", "z.pos", "z.group"), ["key", "pos"])
