"""The engine on an engineered corpus, whose expected order can be worked out by hand."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tessera.config import DEFAULT
from tessera.operators import dense, fusion, lexical, lookup, routing, sentences
from tessera.plans import render
from tessera.plans.engine import Engine

S = replace(DEFAULT, dense_cap=3, final_cap=1, rerank_cap=3, rerank_pool=10, candidates=100, co_occurrence=1.0, study_discount=0.85, extras_discount=0.5, extras_neutral=1.0, release_match=1.2, release_mismatch=0.8, stub_chunks=1, stub_chars=100, and_limit=3, study_from=700, study_to=800)

LONG = " The text goes on for a while so that nobody takes this passage for a stub of a longer one, which it is not."
ROWS = [
    ("t1", "23.799", "Rel-18", "23", "TR", 0, 1, [0.0, 1.0, 0.0, 0.0], "session setup by the anchor function" + LONG),
    ("b1", "23.501", "Rel-17", "23", "TS", 0, 2, [0.0, 1.0, 0.0, 0.0], "session setup by the anchor function" + LONG),
    ("b2", "23.501", "Rel-17", "23", "TS", 1, 2, [0.2, 1.0, 0.0, 0.0], "registration in the anchor area" + LONG),
    ("a1", "38.331", "Rel-18", "38", "TS", 0, 3, [1.0, 0.0, 0.0, 0.0], "measurement gap reporting of neighbour cells" + LONG),
    ("a2", "38.331", "Rel-18", "38", "TS", 1, 3, [1.0, 0.2, 0.0, 0.0], "measurement gap of the serving cell" + LONG),
    ("a3", "38.331", "Rel-18", "38", "TS", 2, 3, [0.8, 0.6, 0.0, 0.0], "measurement objects" + LONG),
    ("c1", "36.331", "Rel-15", "36", "TS", 0, 2, [0.0, 0.0, 1.0, 0.0], "legacy paging occasion 5g-nas" + LONG),
    ("c2", "36.331", "Rel-15", "36", "TS", 1, 2, [0.0, 0.0, 1.0, 0.3], "legacy paging frame" + LONG),
    ("s1", "X.700", "Rel-16", "X", "TS", 0, 1, [0.0, 0.0, 0.0, 1.0], "management stub"),
    ("z1", "38.901", "Rel-18", "38", "TS", 0, 1, [1.0, 0.0, 0.0, 0.0], "EMF+ measurement gap" + LONG),
]


def raw(spark):
    rows = [(k, sp, r, se, se, dt, f"title of {k}", i, n, t, 0, o) for o, (k, sp, r, se, dt, i, n, _, t) in enumerate(ROWS)]
    chunks = spark.createDataFrame(rows, "chunk_key string, spec_id string, release string, series string, series_desc string, doc_type string, title string, chunk_index int, total_chunks int, text string, db_idx int, load_ord int")
    return chunks, spark.createDataFrame([(r[0], r[7]) for r in ROWS], "chunk_key string, embedding array<float>")


@pytest.fixture(scope="module")
def corpus(spark):
    e = Engine.opened(*raw(spark))
    return e.chunks, e.vectors, e.index


def ask(spark, *rows):
    return spark.createDataFrame([(i, q, v) for i, (q, v) in enumerate(rows)], "query_id int, q string, vector array<float>")


def engine(corpus, **options):
    return Engine(corpus[0], corpus[1], index=corpus[2], **({"settings": S} | options))


def hits(spark, corpus, q, v, k=10, cap=None, scorer=None, s=S, **more):
    asked = ask(spark, (q, v))
    for c, x in more.items():
        asked = asked.withColumn(c, F.lit(x))
    final, drops = fusion.hybrid(asked, corpus[0], corpus[1], k, cap, s, scorer, index=corpus[2] if len(corpus) > 2 else None)
    return final.orderBy("rank").collect(), drops.collect()


def test_both_legs_agree(spark, corpus):
    got, _ = hits(spark, corpus, "measurement gap reporting", [1.0, 0.0, 0.0, 0.0])
    assert got[0].chunk_key == "a1" and got[0].score == 1.0 and got[0].support == 2
    assert "z1" not in {r.chunk_key for r in got}, "binary texts are rejected"
    assert len({r.spec_id for r in got}) == len(got), "one of each specification"


def test_cap_counts_before_rejection(spark, corpus):
    got, _ = hits(spark, corpus, "measurement gap reporting", [1.0, 0.0, 0.0, 0.0], cap=3)
    assert [r.chunk_key for r in got][:3] == ["a1", "a2", "a3"]


def test_twin_is_demoted(spark, corpus):
    got, _ = hits(spark, corpus, "session setup anchor", [0.0, 1.0, 0.0, 0.0])
    score = {r.chunk_key: r.score for r in got}
    assert [r.chunk_key for r in got][:2] == ["b1", "t1"]
    assert 0.97 <= score["b1"] <= 1.0 and 0.83 <= score["t1"] <= 0.86


def test_single_leg_scores_half(spark, corpus):
    got, _ = hits(spark, corpus, "nothing matches here", [0.0, 0.0, 1.0, 0.0])
    assert got[0].chunk_key == "c1" and got[0].score == 0.5


def test_stub_shows_only_when_named(spark, corpus):
    assert "s1" not in {r.chunk_key for r in hits(spark, corpus, "management", [0.0, 0.0, 0.0, 1.0])[0]}
    assert hits(spark, corpus, "management in X.700", [0.0, 0.0, 0.0, 1.0])[0][0].chunk_key == "s1"


def test_cap_drops(spark, corpus):
    _, drops = hits(spark, corpus, "measurement gap", [1.0, 0.0, 0.0, 0.0], scorer=lambda q, p: F.col("score"))
    assert ("38.331", 2) in [(r.spec_id, r.dropped) for r in drops]


def test_release_boost(spark, corpus):
    flat = lambda q, p: F.lit(0.5)
    got, _ = hits(spark, corpus, "legacy paging in release 15", [0.0, 0.0, 1.0, 0.0], scorer=flat)
    score = {r.spec_id: r.score for r in got}
    assert score["36.331"] == 0.6 and all(v in (0.4, 0.34, 0.2) for k, v in score.items() if k != "36.331")
    got, _ = hits(spark, corpus, "legacy paging in release 15", [0.0, 0.0, 1.0, 0.0], scorer=flat, release="Rel-15")
    assert {r.spec_id for r in got} == {"36.331"} and got[0].score == 0.5


def test_series_filter(spark, corpus):
    got, _ = hits(spark, corpus, "measurement gap", [1.0, 0.0, 0.0, 0.0], series="36")
    assert {r.series for r in got} == {"36"}


def test_top_k_is_a_prefix(spark, corpus):
    a = [r.chunk_key for r in hits(spark, corpus, "measurement session", [0.7, 0.7, 0.1, 0.0], k=4)[0]]
    b = [r.chunk_key for r in hits(spark, corpus, "measurement session", [0.7, 0.7, 0.1, 0.0], k=5)[0]]
    assert b[:4] == a


def test_order_of_rows_does_not_matter(spark, corpus):
    c, v = raw(spark)
    a = hits(spark, corpus, "measurement session", [0.7, 0.7, 0.1, 0.0])[0]
    b = hits(spark, (c.orderBy(F.desc("text")), v.orderBy(F.desc("chunk_key"))), "measurement session", [0.7, 0.7, 0.1, 0.0])[0]
    assert [(r.chunk_key, r.score) for r in a] == [(r.chunk_key, r.score) for r in b]


def test_cascade_stages(spark, corpus):
    c, _, index = corpus
    q = ask(spark, ("legacy paging occasion", None), ("legacy paging nowhere", None), ("occasion frame area gap", None), ("zzz", None))
    stage = {r.query_id: r.stage for r in lexical.cascade(q, c, 10, S, index=index).collect()}
    assert stage == {0: 1, 1: 2, 2: 4}
    pinned = lexical.cascade(ask(spark, ("ocasion unknown words", None)), c, 10, S, {"ocasion": "occasion"}, index=index).collect()
    assert [(r.chunk_key, r.stage) for r in pinned] == [("c1", 3)]


def test_phrases(spark, corpus):
    index = corpus[2]
    w = spark.createDataFrame([("5g-nas",), ("gap-reporting",), ("reporting-gap",)], "term string")
    assert sorted((r.chunk_key, r.term) for r in lexical.term_hits(index, w, True).collect()) == [("a1", "gap-reporting"), ("c1", "5g-nas")]


def test_dense_search(spark, corpus):
    c, v = raw(spark)
    got = dense.search(ask(spark, ("", [1.0, 0.0, 0.0, 0.0])), v, c, 3, S).orderBy("rank").collect()
    assert [r.chunk_key for r in got] == ["a1", "a2", "a3"] and round(got[1].score, 4) == 0.9806
    q = ask(spark, ("", [0.3, 0.4, 0.0, 0.1]), ("", [0.0, 0.0, 0.0, 0.0]), ("", None))
    for cap in (None, 1):
        a, b = (sorted(map(tuple, dense.ranked(q, x, c, 4, cap, by_matrix=m).collect())) for x, m in ((v, False), (dense.build(v, c), True)))
        assert a == b and len(a) == 8
    found = dense.candidates(ask(spark, ("", [1.0, 0.0, 0.0, 0.0])), dense.joined(v, c).coalesce(1), 2, 1).collect()
    assert {r.chunk_key for r in found} == {"a1", "z1"}
    q = q.withColumn("series", F.when(F.col("query_id") == 0, "38")).withColumn("release", F.lit(" "))
    a, b = (sorted(map(tuple, dense.ranked(q, v, c, 4, None, by_matrix=m).collect())) for m in (False, True))
    assert a == b and {r[2] for r in a if r[0] == 0} <= {"38.331", "38.901"}


@pytest.mark.parametrize(("rows", "level"), [([(0.9, "a", 1), (0.7, "b", 1)], "high"), ([(0.9, "a", 2), (0.85, "b", 1)], "medium"), ([(0.9, "a", 1), (0.85, "b", 1)], "low"), ([(0.2, "a", 2), (0.19, "b", 1)], "none"), ([(0.9, "a", 0)], "high"), ([], "low")])
def test_confidence(spark, rows, level):
    h = spark.createDataFrame([(0, i + 1, s, sp, n) for i, (s, sp, n) in enumerate(rows)], "query_id int, rank int, score double, spec_id string, support int")
    assert fusion.confidence(h, ask(spark, ("x", None)), S).first().level == level


def test_guards_and_engine(spark, corpus):
    e = engine(corpus)
    q = ask(spark, ("what is measurement gap reporting", [1.0, 0.0, 0.0, 0.0]), ("  ", None), ("x" * 700, None), ('{"query": "legacy paging"}', [0.0, 0.0, 1.0, 0.0]))
    got, _ = e.search(q)
    assert {r.query_id for r in got.collect()} == {0, 3}
    assert got.where("rank = 1").orderBy("query_id").select("chunk_key").collect()[0].chunk_key == "a1"
    status = {r.query_id: (r.status, r.n_hits > 0) for r in e.batch(q).collect()}
    assert status == {0: ("ok", True), 2: ("document", False), 3: ("ok", True)}
    two = engine(corpus, settings=replace(S, batch=1)).batch(q)
    assert {r.query_id: r.status for r in two.collect()} == {0: "ok", 2: "not_searched", 3: "not_searched"}
    assert e.batch_totals(e.batch(q)).first().asDict() == {"batch_id": 0, "queries": 3, "dropped": 0, "no_match": 0, "failed": 1}
    reply = e.replies(q.where("query_id = 0")).first().reply
    assert '"spec_id":"38.331"' in reply and '"top_score"' in reply and '"excerpt"' in reply
    assert "38.331" in e.replies(q.where("query_id = 0"), as_json=False).first().reply
    whole = render.batch_reply(e.replies(q.where("query_id in (0, 3)")), q.where("query_id in (0, 3)")).first().reply
    import json

    assert list(json.loads(whole)) == ["what is measurement gap reporting", '{"query": "legacy paging"}']


def test_procedure(spark, corpus):
    layers = spark.createDataFrame([("38", 1, "5g", 2, ["38.3"], "radio"), ("23", 2, "5g", 1, [], "system"), ("99", 3, "5g", 1, [], "none"), ("36", 1, "lte", 1, [], "old")], "series string, ord int, technology string, per_layer int, prefer array<string>, label string")
    aliases = spark.createDataFrame([(0, "nr", "5g"), (1, "e-utra", "lte")], "ord int, alias string, technology string")
    syn = spark.createDataFrame([(0, "handover", "measurement gap")], "ord int, key string, value string")
    q = ask(spark, ("handover session setup", [0.7, 0.7, 0.0, 0.0])).withColumn("technology", F.lit("NR radio"))
    got = engine(corpus, scorer=None).procedure(q, layers, aliases, syn).orderBy("layer_ord", "place").collect()
    assert {r.label for r in got} == {"radio", "system"} and all(r.score <= 1.0 for r in got)
    assert sum(r.label == "system" for r in got) == 1


def test_scope(spark, corpus):
    own = spark.createDataFrame([(0, "s-cscf", "24.229", "ims", True), (1, "nas", "24.301", "nas", False), (2, "gap", "38.331", "in corpus", True)], "ord int, marker string, spec_id string, topic string, block boolean")
    q = ask(spark, ("the S-CSCF and nas", None), ("nas only", None), ("a gap", None), ("nasal", None))
    got = {(r.query_id, r.spec_id): r.blocks for r in routing.scope(q, own, corpus[0]).collect()}
    assert got == {(0, "24.229"): True, (0, "24.301"): True, (1, "24.301"): False}
    assert spark.range(1).select(routing.residual(F.lit("the S-CSCF does registration"), ["s-cscf"])).first()[0] == "the does registration"


def test_intents(spark):
    heads = spark.createDataFrame([("proc", 2, False, ""), ("def", 1, True, ""), ("cmp", 3, False, "")], "intent string, priority int, sticky boolean, hint string")
    terms = spark.createDataFrame([("proc", "handover", "term"), ("def", "define", "term"), ("cmp", "versus", "weak"), ("cmp", "than", "weak")], "intent string, term string, kind string")
    ex = spark.createDataFrame([(0, "cmp", [1.0, 0.0]), (1, "proc", [0.0, 1.0])], "ord int, intent string, vector array<float>")
    q = ask(spark, ("define handover", [1.0, 0.0]), ("handover now", [1.0, 0.1]), ("a versus b", None), ("more than versus", None), ("x", [0.1, -1.0]))
    got = {r.query_id: (r.intent, r.method) for r in routing.intent(q, heads, terms, ex, S).collect()}
    assert got == {0: ("def", "keyword"), 1: ("cmp", "exemplar"), 2: ("general", "keyword"), 3: ("cmp", "keyword"), 4: ("general", "keyword")}


def test_definitions(spark):
    c = spark.createDataFrame(
        [("a", "38.331", "38", "foo-Bar ::= ENUMERATED {x, y} and foo-Bar-r16 ENUMERATED {z}", 0, 0), ("b", "36.331", "36", "foo-bar  ::=  INTEGER (0..7)", 1, 0), ("c", "36.331", "36", "foo-Bar ::= ENUMERATED {x, y}", 2, 0), ("d", "36.331", "36", "no definition of foo-bar here", 3, 0)],
        "chunk_key string, spec_id string, series string, text string, load_ord int, db_idx int",
    )
    asked = spark.createDataFrame([(1, "foo-Bar", None), (2, "foo-bar", "36"), (3, "q(x", None)], "query_id int, name string, series string")
    got = lookup.definitions(asked, c).collect()
    assert [r.definition for r in got if r.query_id == 1] == ["ENUMERATED {x, y}", "ENUMERATED {z}", "INTEGER (0..7)", "ENUMERATED {x, y}"]
    assert [r.definition for r in got if r.query_id == 2] == ["INTEGER (0..7)", "ENUMERATED {x, y}"]
    clauses = spark.createDataFrame([("38.331", "c1", "foo-Bar-Ext", "38", "the long text of it: foo-Bar-Ext ::= INTEGER (1..9)"), ("38.331", "c2", "my", "38", "foo-Bar BIT STRING (SIZE (4)), x"), ("38.331", "c3", "foo-Bar", "38", "only named: foo-Bar")], "spec_id string, clause_id string, ie_name string, series string, text string")
    got = lookup.clause_definitions(asked, clauses, c).orderBy("query_id", "rank").collect()
    assert [(r.name, r.definition) for r in got if r.query_id == 1] == [("foo-Bar-Ext", "INTEGER (1..9)"), ("foo-Bar", "BIT STRING (SIZE (4))")]
    assert [r.definition for r in got if r.query_id == 2] == ["INTEGER (0..7)", "ENUMERATED {x, y}"]
    wild = spark.createDataFrame([(4, "foo_Bar", None), (5, "%", None)], "query_id int, name string, series string")
    assert lookup.definitions(wild, c).count() == 0


def test_neighbours(spark, corpus):
    got = {r.chunk_key: r for r in lookup.neighbours(corpus[0].select(F.lit(0).alias("query_id"), "chunk_key"), corpus[0], 20).collect()}
    assert got["a1"].before is None and got["a1"].after.startswith("measurement gap of") and len(got["a2"].before) == 20 and got["a3"].after is None


def test_citations(spark):
    d = spark.createDataFrame([(0, "see TS 38.331 and 23.501-2, 38.331")], "query_id int, draft string")
    h = spark.createDataFrame([(0, "38.331"), (0, "36.331")], "query_id int, spec_id string")
    assert {r.spec_id: r.status for r in lookup.citations(d, h).collect()} == {"38.331": "supported", "23.501-2": "unsupported", "36.331": "omitted"}


def test_audit(spark, corpus):
    payload = '{"data": {"technology": "NR", "nonCompliancedata": [{"parameterName": "measurement", "moHierarchy": "a/b/c/d/measurement"}, {"parameterName": "measurement", "moHierarchy": "a/b/c/d"}, {"parameterName": "pag-ing", "moHierarchy": "ns:x/ns:y/ns:z"}, {"parameterName": " "}]}}'
    p = spark.createDataFrame([(7, payload), (8, "{}"), (9, "junk"), (10, None)], "payload_id int, payload string")
    x = lookup.audit_parameters(p, 1)
    rows = x.orderBy("pos").collect()
    assert [(r.name, r.context, r.queried) for r in rows] == [("measurement", "b/c/d", True), ("pag-ing", "y/z", False)]
    assert lookup.audit_totals(x).first().asDict() == {"payload_id": 7, "total": 2, "names": 2, "queried": 1, "planned_out": 0, "skipped": 1}
    plan = spark.createDataFrame([(7, "measurement", False, None, "vendor"), (7, "pag-ing", None, "paging", None)], "payload_id int, name string, relevant boolean, term string, reason string")
    y = lookup.audit_parameters(p, 9, {"measurement": "meas-Gap", "paging": "x"}, plan)
    assert [(r.term, r.query, r.queried, r.planned_out, r.series) for r in y.orderBy("pos").collect()] == [("meas-Gap", "meas-Gap b c d", False, True, "38"), ("paging", "paging y z", True, False, "38")]
    assert [r.a for r in p.select(lookup.is_audit(F.col("payload")).alias("a")).collect()] == [True, False, False, False] or [r.a for r in p.select(lookup.is_audit(F.col("payload")).alias("a")).collect()][:3] == [True, False, False]
    v = spark.createDataFrame([(7, 0, [1.0, 0.0, 0.0, 0.0]), (7, 2, [0.0, 0.0, 1.0, 0.0])], "payload_id int, pos int, vector array<float>")
    got = {r.name: r.present for r in engine(corpus, scorer=None).audit(p, v, series_filter=False)[0].collect()}
    assert got == {"measurement": True, "pag-ing": True}
    items = spark.createDataFrame([(1, "measurement", "a/b", None, None), (1, "absent", "a/b", None, None)], "payload_id int, parameterName string, moHierarchy string, goldenValue string, currentValue string")
    docs = spark.createDataFrame([(1, "the Measurement is set")], "payload_id int, text string")
    assert [(r.name, r.present) for r in engine(corpus, scorer=None).fan_out(docs, items, v)[0].collect()] == [("measurement", True)]


def test_sentences(spark):
    text = "The cell is barred now. A timer starts at once. The timer stops when the cell is found. Nothing else matters here. Short."
    h = spark.createDataFrame([(0, "a", "timer of the cell", text), (0, "b", "q", "one sentence only"), (0, "c", "q", "Intro ..... 1\nBody ..... 2\nEnd ..... 3\n" * 40), (0, "d", "q", None)], "query_id int, chunk_key string, q string, text string")
    got = {r.chunk_key: r.excerpt for r in sentences.excerpts(h, (1, 0.2, 0.7, 0, 200), S).collect()}
    assert "timer" in got["a"] and got["b"] == "one sentence only" and len(got["c"]) == 401 and got["c"].endswith("…") and got["d"] == ""
    items = " ".join(f"The V-NF {i} is made {'of query words' if i < 6 else 'late'}." for i in range(9))
    h = spark.createDataFrame([(0, "l", "the VNF query words made", items)], "query_id int, chunk_key string, q string, text string")
    assert sentences.paths(h, (6, 0.0, 0.7, 0, 200), S).first().path == "list" and sentences.paths(h, (4, 0.0, 0.7, 0, 200), S).first().path == "prose"
    assert sentences.excerpts(h, (6, 0.0, 0.7, 0, 200), replace(S, sentence_floor=0.3)).first().excerpt.count("query words") == 6
    assert {r.path: r.n for r in sentences.counters(h, (6, 0.0, 0.7, 0, 200), S).collect()} == {"list": 1}
    x = spark.createDataFrame([(0, "a", 0, "alpha beta gamma", 0.9), (0, "a", 1, "alpha beta gamma", 0.89), (0, "a", 2, "delta epsilon", 0.8)], "query_id int, chunk_key string, i int, sentence string, score double")
    assert [r.i for r in sentences.mmr(x, 2, 0.5).orderBy("pick").collect()] == [0, 2]
    w = sentences.windowed(x.where("i <> 1").select("query_id", "chunk_key", "i"), x, 0).orderBy("i").collect()
    assert [(r.i, r.gap) for r in w] == [(0, False), (2, True)]


def test_packing_and_clipping(spark):
    b = spark.createDataFrame([("k", i, "x" * n) for i, n in enumerate([4, 5, 3, 9, 20, 1])], "key string, pos int, text string")
    assert [r.group for r in lookup.packed(b, 10).orderBy("pos").collect()] == [0, 0, 1, 2, 3, 4]
    h = spark.createDataFrame([(0, i + 1, "x" * 2000) for i in range(10)] + [(1, 1, "short")], "query_id int, rank int, text string")
    got = {r.query_id: (r.chars, r.keep) for r in render.clipped(h.select("query_id").distinct(), h).collect()}
    assert got == {0: (500, 4), 1: (1200, 99)}


def test_query_log(spark, corpus, tmp_path):
    from tessera.streaming import log

    h, _ = fusion.hybrid(ask(spark, ("measurement gap", [1.0, 0.0, 0.0, 0.0])), corpus[0], corpus[1], 5, None, S, None, index=corpus[2])
    for _ in range(2):
        render.write_log(ask(spark, ("measurement gap", None)), h, str(tmp_path / "log"))
    stream = log.rollup(log.read_log(spark, str(tmp_path / "log")), kind="query")
    q = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.queries for r in spark.table("rolled").collect()) == 2
