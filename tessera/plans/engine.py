"""The engine: its public operations over tables of requests. A single request is a table of one row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import text as T
from ..operators import dense, fusion, lexical, lookup, routing, sentences
from ..storage import stored
from . import render


@dataclass
class Lexicons:
    substitutions: dict[str, str] = field(default_factory=dict)
    glossary: dict[str, str] = field(default_factory=dict)
    extras_terms: list[str] = field(default_factory=list)
    ownership: DataFrame | None = None
    test_specs: tuple[str, ...] = ()


@dataclass
class Engine:
    """chunks and vectors as sources.corpus reads them, or as opened() stores them. scorer: a function of columns (query, passage), or None. embedder: a function from a column of texts to
    vectors, for requests that come without one; blank texts get none."""

    chunks: DataFrame
    vectors: DataFrame
    settings: Settings = DEFAULT
    lexicons: Lexicons = field(default_factory=Lexicons)
    scorer: object = staticmethod(fusion.lexical_scorer)
    embedder: object = None
    index: lexical.Index | None = None

    @classmethod
    def opened(cls, chunks: DataFrame, vectors: DataFrame, **settings) -> Engine:
        """An engine that has stored its chunks with their facts, its text index and its vectors, so requests scan none of the sources."""
        kept = stored(fusion.facts(chunks), "chunks")
        return cls(kept, dense.build(vectors, kept), index=lexical.build(kept), **settings)

    def prepared(self, requests: DataFrame) -> DataFrame:
        """Requests (query_id, q, vector, ...) that pass the guards and the scope: original, and q, its expansion. What is embedded has no lead-in of a question."""
        s = self.settings
        x = routing.guards(requests, self.chunks.select("series"), s).where("guard is null").drop("guard")
        if self.lexicons.ownership is not None:
            blocked = routing.scope(x, self.lexicons.ownership, self.chunks).where("blocks").select("query_id").distinct()
            x = x.join(blocked, "query_id", "left_anti")
        x = x.withColumn("original", T.unwrap(F.col("q")))
        x = x.withColumn("q", T.expand(F.col("original"), self.lexicons.glossary))
        if self.embedder is not None:
            bare = T.strip_question(F.col("original"))
            own = F.col("vector") if "vector" in x.columns else F.lit(None).cast("array<float>")
            x = x.withColumn("vector", F.coalesce(own, F.when(bare != "", self.embedder(bare))))
        return x

    def search(self, requests: DataFrame, k: int = 10, cap: int | None = None, cut: bool = True) -> tuple[DataFrame, DataFrame]:
        """Final hits and cap drops of all requests that are run."""
        hits, drops = fusion.hybrid(self.prepared(requests), self.chunks, self.vectors, k, cap, self.settings, self.scorer, self.lexicons.substitutions, self.lexicons.extras_terms, self.index)
        return (fusion.score_cut(hits, self.settings) if cut else hits), drops

    def search_dense(self, requests: DataFrame, k: int = 10) -> DataFrame:
        return dense.search(requests, self.vectors, self.chunks, k, self.settings)

    def checked(self, requests: DataFrame) -> DataFrame:
        """requests with status, null where they are searched: empty, document, unknown_series, bad_vector (of another length than the corpus's) or out_of_scope; and notes about the rest:
        caveat, where the owner of a topic is missing, and ignored_filters."""
        s = self.settings
        x = routing.guards(requests, self.chunks.select("series"), s).withColumnRenamed("guard", "status")
        if "vector" in requests.columns:
            own = "v" if "v" in self.vectors.columns else "embedding"
            dim = self.vectors.select(F.size(own)).first()
            x = x.withColumn("status", F.coalesce("status", F.when(F.col("vector").isNotNull() & (F.size("vector") != (dim[0] if dim else 0)), "bad_vector")))
        x = x.withColumn("caveat", F.lit(None).cast("string"))
        if self.lexicons.ownership is not None:
            found = routing.scope(requests, self.lexicons.ownership, self.chunks).groupBy("query_id").agg(F.max("blocks").alias("_blocks"), F.array_sort(F.collect_set("topic")).alias("_topics"))
            told = F.concat(F.lit("Partial coverage: not in the corpus: "), F.concat_ws(", ", "_topics"))
            x = x.drop("caveat").join(found, "query_id", "left").withColumn("status", F.coalesce("status", F.when(F.col("_blocks"), "out_of_scope"))).withColumn("caveat", F.when(F.col("_topics").isNotNull(), told)).drop("_blocks", "_topics")
        filters = {c: F.col(c) for c in ("series", "release", "doc_type") if c in requests.columns}
        return x.withColumn("ignored_filters", T.ignored_filters(filters) if filters else F.array().cast("array<string>"))

    def single(self, requests: DataFrame, k: int = 10, cap: int | None = None, verbosity: str = "NORMAL", as_json: bool = False, fields: str = "LEAN", intents: DataFrame | None = None) -> DataFrame:
        """(query_id, status, n_hits, reply) for every request: search with all its checks. status: ok, no_match, or why it wasn't searched. intents: (query_id, intent)."""
        seen = stored(self.checked(requests), "requests")
        run = seen.where("status is null").drop("status")
        hits, drops = self.search(run.drop("caveat", "ignored_filters"), k, cap)
        hits = stored(render.drop_notes(hits, drops, self.settings), "hits")
        hits = stored(self._told(hits, verbosity), "hits")
        conf = fusion.confidence(hits, run, self.settings).join(run.select("query_id", "q"), "query_id")
        notes = run.select("query_id", "caveat")
        notes = notes.withColumn("intent", F.lit(None).cast("string")) if intents is None else notes.join(intents.select("query_id", T.label(F.col("intent")).alias("intent")), "query_id", "left")
        if as_json:
            said = render.json_replies(hits, conf, fields, notes=notes)
        else:
            near = lookup.neighbours(hits, self.chunks, self.settings.preview)
            said = render.text_replies(hits.join(near, ["query_id", "chunk_key"], "left"), conf, notes=notes, verbosity=verbosity)
        n = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
        x = seen.select("query_id", "status").join(said, "query_id", "left").join(n, "query_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))
        error = F.to_json(F.struct(F.col("status").alias("error"))) if as_json else F.concat(F.lit("Not searched: "), F.col("status"))
        return x.select("query_id", F.coalesce("status", F.when(F.col("n_hits") > 0, "ok").otherwise("no_match")).alias("status"), "n_hits", F.when(F.col("status").isNull(), F.col("reply")).otherwise(error).alias("reply"))

    def _told(self, hits: DataFrame, verbosity: str) -> DataFrame:
        """hits with the excerpt that answers, by verbosity; FULL keeps the text."""
        if verbosity == "FULL":
            return hits.withColumn("excerpt", T.collapse(F.col("text")))
        preset = self.settings.brief if verbosity == "BRIEF" else self.settings.normal
        return hits.join(sentences.excerpts(hits, preset, self.settings), ["query_id", "chunk_key"], "left")

    def batch(self, requests: DataFrame, k: int = 5, **options) -> DataFrame:
        """(batch_id, pos, query_id, status, n_hits, reply) for the requests of batches, one caller's lists: blank ones go, the first `batch` in input order (pos, else by query_id) are
        searched, the rest is marked not_searched. A request that fails its checks doesn't touch the others. Without batch_id all are one batch."""
        x = requests.where(F.coalesce(F.trim("q"), F.lit("")) != "").withColumn("q", F.trim("q"))
        x = x if "batch_id" in x.columns else x.withColumn("batch_id", F.lit(0))
        order = "pos" if "pos" in x.columns else "query_id"
        x = x.withColumn("n", F.row_number().over(Window.partitionBy("batch_id").orderBy(order)))
        got = self.single(x.where(F.col("n") <= self.settings.batch).drop("n", "pos", "batch_id"), k, as_json=True, **options)
        x = x.select("batch_id", F.col("n").alias("pos"), "query_id").join(got, "query_id", "left")
        return x.select("batch_id", "pos", "query_id", F.coalesce("status", F.lit("not_searched")).alias("status"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("reply", F.lit('{"not_searched":true}')).alias("reply"))

    def batch_totals(self, batch: DataFrame) -> DataFrame:
        """(batch_id, queries, dropped, no_match, failed) of what batch() gave."""
        of = lambda *s: F.count_if(F.col("status").isin(*s))
        return batch.groupBy("batch_id").agg(F.count_if(F.col("status") != "not_searched").alias("queries"), of("not_searched").alias("dropped"), of("no_match").alias("no_match"), F.count_if(~F.col("status").isin("ok", "no_match", "not_searched")).alias("failed"))

    def replies(self, requests: DataFrame, k: int = 10, as_json: bool = True, fields: str = "LEAN") -> DataFrame:
        """(query_id, reply) of requests that are searched."""
        return self.single(requests, k, as_json=as_json, fields=fields).where("status in ('ok', 'no_match')").select("query_id", "reply")

    def answers(self, requests: DataFrame, k: int = 10, verbosity: str = "NORMAL") -> DataFrame:
        """Hits with the excerpt that answers, by verbosity; FULL keeps the text."""
        return self._told(stored(self.search(requests, k)[0], "hits"), verbosity)

    def layers(self, requests: DataFrame, layers: DataFrame, aliases: DataFrame, synonyms: DataFrame, per_layer: int | None = None) -> tuple[DataFrame, DataFrame]:
        """Evidence for procedures (query_id, q, vector, technology) by layer with excerpts, and the layers that were searched without any: one search for all pairs of request and layer."""
        s = self.settings
        tech = routing.technology(requests.select(F.col("query_id").alias("key"), "technology"), aliases).select(F.col("key").alias("query_id"), "canonical")
        words = routing.with_synonyms(requests.select(F.col("query_id").alias("key"), F.col("q").alias("text")), synonyms).select(F.col("key").alias("query_id"), "expanded")
        live = layers.join(self.chunks.select("series").distinct(), "series", "left_semi")
        pairs = requests.select("query_id", F.col("q").alias("asked"), "vector").join(tech, "query_id").join(words, "query_id").join(F.broadcast(live), (F.col("canonical") == F.col("technology")) | (F.col("canonical") == "both"))
        pairs = stored(pairs.withColumn("layer_id", F.concat_ws(":", "query_id", "ord", "series")), "layers")
        ask = pairs.select(F.col("layer_id").alias("query_id"), F.col("expanded").alias("original"), T.expand(F.col("expanded"), self.lexicons.glossary).alias("q"), "vector", "series")
        hits, _ = fusion.hybrid(ask, self.chunks, self.vectors, 8, None, s, self.scorer, self.lexicons.substitutions, self.lexicons.extras_terms, self.index)
        x = hits.withColumnRenamed("query_id", "layer_id").drop("series", "q").join(pairs.select("layer_id", "query_id", F.col("asked").alias("q"), F.col("ord").alias("layer_ord"), "series", "label", "prefer", "per_layer"), "layer_id")
        # the first hits of a layer, of which test specifications then go
        x = x.where(F.col("rank") <= (F.lit(per_layer) if per_layer else F.col("per_layer")))
        if self.lexicons.test_specs:
            x = x.where(~F.substring_index(F.lower("spec_id"), "-", 1).isin(*self.lexicons.test_specs) & ~F.lower("spec_id").isin(*self.lexicons.test_specs))
        preferred = F.exists("prefer", lambda p: F.startswith("spec_id", p))
        x = x.withColumn("score", F.when(preferred, F.least(F.lit(1.0), F.col("score") * s.prefer_boost)).otherwise(F.col("score")))
        best = F.max("score").over(Window.partitionBy("query_id"))
        x = x.withColumn("bar", F.greatest(F.lit(s.procedure_floor), best * s.procedure_relative)).where(F.col("score") >= F.col("bar"))
        x = stored(x.select("query_id", "layer_ord", "series", "label", "spec_id", "release", "chunk_key", "chunk_index", "score", "q", "text"), "evidence")
        # a chunk has one excerpt, whatever layers it is evidence for
        told = sentences.excerpts(x.select("query_id", "chunk_key", "q", "text").dropDuplicates(["query_id", "chunk_key"]), s.normal, s)
        empty = pairs.select("query_id", F.col("ord").alias("layer_ord"), "series", "label").join(x.select("query_id", "layer_ord", "series"), ["query_id", "layer_ord", "series"], "left_anti")
        return render.by_layer(x.drop("q").join(told, ["query_id", "chunk_key"], "left")), empty

    def procedure(self, requests: DataFrame, layers: DataFrame, aliases: DataFrame, synonyms: DataFrame, per_layer: int | None = None) -> DataFrame:
        """The evidence of layers() alone."""
        return self.layers(requests, layers, aliases, synonyms, per_layer)[0]

    def procedure_replies(self, requests: DataFrame, layers: DataFrame, aliases: DataFrame, synonyms: DataFrame, per_layer: int | None = None) -> DataFrame:
        return render.layer_replies(*self.layers(requests, layers, aliases, synonyms, per_layer), requests)

    def second_query(self, requests: DataFrame, intents: DataFrame, layers: DataFrame, aliases: DataFrame, synonyms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Hits of all requests, and evidence by layer for those whose intent is a procedure."""
        hits, _ = self.search(requests)
        asked = requests.join(intents.where(F.col("intent").startswith("procedure")).select("query_id"), "query_id", "left_semi")
        return hits, self.procedure(asked.withColumn("technology", F.lit("")) if "technology" not in requests.columns else asked, layers, aliases, synonyms)

    def definitions(self, asked: DataFrame, clauses: DataFrame | None = None, limit: int = 8) -> DataFrame:
        """Definitions of names, from clause units where the corpus has any (sources.corpus.read_clauses looks for them)."""
        return lookup.definitions(asked, self.chunks, limit) if clauses is None else lookup.clause_definitions(asked, clauses, self.chunks, limit)

    def validate(self, drafts: DataFrame, k: int = 15) -> tuple[DataFrame, DataFrame]:
        """Citations of drafts (query_id, q, vector, draft) by status, and the confidence of the search."""
        hits, _ = self.search(drafts.drop("draft"), k, cut=False)
        return lookup.citations(drafts.select("query_id", "draft"), hits), fusion.confidence(hits, drafts, self.settings)

    def spec_info(self, asked: DataFrame, n: int = 5) -> DataFrame:
        return lookup.spec_chunks(asked, self.chunks, n, self.index)

    def list_specs(self) -> DataFrame:
        return lookup.list_specs(self.chunks)

    def list_series(self, catalogue: DataFrame) -> DataFrame:
        return lookup.list_series(catalogue, self.chunks)

    def stats(self) -> DataFrame:
        return lookup.stats(self.chunks, self.settings)

    def audit(self, payloads: DataFrame, vectors: DataFrame, limit: int = 20, plan: DataFrame | None = None, clauses: DataFrame | None = None, series_filter: bool = True) -> tuple[DataFrame, DataFrame]:
        """Verdicts on configuration payloads with their definitions, and each payload's totals. vectors(payload_id, pos, vector) may give query vectors; plan: see lookup.audit_parameters.

        Parameters are searched within their payload's series, if that is indexed; definitions are looked up where the series is a number.
        """
        p = stored(lookup.audit_parameters(payloads, limit, self.lexicons.substitutions, plan), "parameters")
        ask = p.where("queried").join(vectors, ["payload_id", "pos"], "left").withColumn("query_id", F.concat_ws(":", "payload_id", "pos"))
        known = self.chunks.select(F.col("series").alias("k")).distinct()
        ask = ask.join(known, F.col("series") == F.col("k"), "left").withColumn("series", F.when(F.col("k").isNotNull() & F.lit(series_filter), F.col("series")).otherwise("")).drop("k")
        hits, _ = self.search(ask.select("query_id", F.col("query").alias("q"), "vector", "series"), 4, 3)
        back = p.select(F.concat_ws(":", "payload_id", "pos").alias("query_id"), "payload_id", "pos")
        v = lookup.audit_verdicts(p, hits.join(back, "query_id").select("payload_id", "pos", "title", "text"))
        asked = p.where(F.col("queried") & F.col("series").rlike("^[0-9]+$")).select(F.concat_ws(":", "payload_id", "pos").alias("query_id"), F.col("term").alias("name"), "series")
        found = self.definitions(asked, clauses, 6).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "definition"))).alias("d"))
        v = v.join(back.join(found, "query_id").select("payload_id", "pos", F.transform("d", lambda x: x["definition"]).alias("definitions")), ["payload_id", "pos"], "left")
        return v, lookup.audit_totals(p)

    def fan_out(self, documents: DataFrame, items: DataFrame, vectors: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
        """An audit of free documents(payload_id, text), whose items(payload_id, parameterName, moHierarchy, goldenValue, currentValue) something else extracted. Only items whose name the document holds count."""
        held = items.join(documents, "payload_id").where(F.lower("text").contains(F.lower(F.trim("parameterName"))))
        row = F.struct("parameterName", "moHierarchy", "goldenValue", "currentValue")
        payloads = held.groupBy("payload_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias("nonCompliancedata"))).alias("payload"))
        return self.audit(payloads, vectors, limit)
