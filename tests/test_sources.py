import struct

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import corpus, lexicons, replies


def write(path, text):
    path.write_text(text)
    return str(path)


def test_lexicons(spark, tmp_path):
    assert {r.token for r in lexicons.token_list(spark, write(tmp_path / "a", "# no\n The \n\nof\nthe\n")).collect()} == {"the", "of"}
    p = lexicons.pairs(spark, write(tmp_path / "b", "Key\tValue\tMore\nbad\nkey\tLast\n\tx\n"))
    assert lexicons.mapping(p) == {"key": "last"}
    assert lexicons.mapping(lexicons.glossary(spark, write(tmp_path / "c", "amf\tAccess Function\n"))) == {"AMF": "Access Function"}
    assert [r.key for r in lexicons.catalogue(spark, write(tmp_path / "d", "38\tNR\n23\tSystem\n")).collect()] == ["23", "38"]
    own = lexicons.ownership(spark, write(tmp_path / "e", "S-CSCF\t24.229\nnas\t24.301\tNAS\tNote\nx\n")).orderBy("ord").collect()
    assert [(r.marker, r.topic, r.block) for r in own] == [("s-cscf", "24.229", True), ("nas", "NAS", False)]
    heads, terms, unknown = lexicons.intents(spark, write(tmp_path / "f", "intent\tdef\t1\ttrue\thint\nintent\tbad\tx\ttrue\th\nterm\tdef\tDefine\nweak\tghost\tboo\n"))
    assert [r.intent for r in heads.collect()] == ["def"] and terms.first().term == "define" and unknown.first().intent == "ghost"
    lay, alias = lexicons.layers(spark, write(tmp_path / "g", "layer\t38\t1\t5G\t2\t38.3, 38.4\tRadio\nlayer\t23\tx\t5g\t2\t-\tSys\nlayer\t23\t2\t5g\t1\t-\tSys\nalias\tnr\t5g\n"))
    assert [(r.series, r.prefer) for r in lay.orderBy("ord").collect()] == [("38", ["38.3", "38.4"]), ("23", [])] and alias.first().technology == "5g"
    assert [r.value for r in lexicons.synonyms(spark, write(tmp_path / "h", "b\tB1\na\tA1\n")).orderBy("ord").collect()] == ["B1", "A1"]
    assert lexicons.token_list(spark, str(tmp_path / "missing")).count() == 0


def test_corpus(spark, tmp_path):
    row = ("x", "38.331", "Rel-17", "38", "NR", "TS", "t", " 7 ", 3, "text")
    for i, bad in enumerate((" 7 ", "n/a")):
        spark.createDataFrame([(*row[:7], bad, *row[8:])], corpus.CHUNKS).write.parquet(str(tmp_path / str(i) / "chunks.parquet"))
    vec = struct.pack("<4f", 1.5, -0.25, 0.0, 3e-40)
    spark.createDataFrame([("x", bytearray(vec))], "chunk_id string, vector binary").write.parquet(str(tmp_path / "0" / "embeddings.parquet"))
    spark.createDataFrame([("x", [1.0, 2.0])], "chunk_id string, embedding array<float>").write.parquet(str(tmp_path / "1" / "embeddings.parquet"))
    paths = [str(tmp_path / "0"), str(tmp_path / "1")]
    c = corpus.read_chunks(spark, paths).orderBy("load_ord").collect()
    assert [(r.chunk_key, r.chunk_index) for r in c] == [("0:x", 7), ("1:x", -1)]
    v = corpus.read_vectors(spark, paths, 4).collect()
    assert len(v) == 1 and v[0].embedding == pytest.approx([1.5, -0.25, 0.0, struct.unpack("<f", vec[12:])[0]])
    assert corpus.resolve(spark, str(tmp_path / "none"), paths[1]) == paths[1]
    with pytest.raises(FileNotFoundError, match="CORPUS"):
        corpus.resolve(spark, None, None)
    m = spark.createDataFrame([(0, "embed_dim", None), (1, "embed_dim", "8"), (2, "embed_dim", "4")], "db_idx int, key string, value string")
    assert corpus.meta_value(m, "embed_dim").first().asDict() == {"value": "8", "mismatch": True}


def test_clauses(spark):
    t = "Intro text before.\n5.1.2 First clause\n" + "a" * 300 + "\nsee 9.9 in line\n5.2 Second\n" + "b" * 50
    u = corpus.clause_units(spark.createDataFrame([(1, t)], "key int, text string"), 10, 200, 20).orderBy("unit", "at").collect()
    assert [r.text[:5] for r in u][0] == "Intro" and [r.text[:5] for r in u if r.at == 0][1:] == ["5.1.2", "5.2 S"]
    assert all(len(r.text) <= 200 for r in u)


def test_replies(spark):
    j = '{"q1": {"top_score": 0.9, "hits": [{"n": 1, "score": 0.9, "spec_id": "38.331", "title": "t"}]}, "q2": {"no_match": true, "hits": []}, "q3": {"not_searched": true}, "_meta": {"queries": 2}}'
    got = replies.json_hits(spark.createDataFrame([(1, j)], "reply_id int, reply string")).orderBy("q").collect()
    assert [(r.q, r.rank, r.spec_id) for r in got] == [("q1", 1, "38.331"), ("q2", None, None), ("q3", None, None)]
    text = "Search results for: \"x\"\nConfidence: high (margin=0.100)\n[1] 38.331 | Rel-17 | Score: 0.8120\n    Title  : Radio\n    Key    : One [2] thing.\n[2] 23.501 | - | Score: 0.5000\n    Title  : Sys"
    got = replies.text_hits(spark.createDataFrame([(1, text)], "reply_id int, reply string")).orderBy("rank").collect()
    assert [(r.rank, r.score, r.spec_id, r.release, r.title, r.excerpt) for r in got] == [(1, 0.812, "38.331", "Rel-17", "Radio", "One [2] thing."), (2, 0.5, "23.501", None, "Sys", None)]
    lay = "Evidence\n\n=== Radio (series 38) ===\n  38.331 | Rel-17 | chunk 4 | score 0.812\n    words\n\nNo strong evidence in: Core (series 23); Old (series 36)"
    got = replies.layer_hits(spark.createDataFrame([(1, lay)], "reply_id int, reply string")).orderBy("layer").collect()
    assert [(r.layer, r.spec_id, r.score, r.chunk_index) for r in got] == [("Core", None, None, None), ("Old", None, None, None), ("Radio", "38.331", 0.812, 4)]


def test_settings_from_text():
    from tessera.config import DEFAULT, settings

    s = settings({"tessera.rrf_k": "30", "tessera.min_score": "0.2", "tessera.brief": "3,0.1,0.5,0,200", "other": "x"})
    assert (s.rrf_k, s.min_score, s.brief) == (30, 0.2, (3, 0.1, 0.5, 0, 200)) and settings({}) == DEFAULT


def test_optional_tables(spark, tmp_path):
    assert corpus.read_clauses(spark, [str(tmp_path)]) is None
    spark.createDataFrame([("38.331", "c1", "foo", "t")], "spec_id string, clause_id string, ie_name string, text string").write.parquet(str(tmp_path / "clauses.parquet"))
    assert corpus.read_clauses(spark, [str(tmp_path / "none"), str(tmp_path)]).first().db_idx == 1
    m = spark.createDataFrame([(0, "embed_dim", "many"), (1, "embed_dim", " 8 "), (2, "embed_dim", "4")], "db_idx int, key string, value string")
    assert corpus.dimension(m).first().asDict() == {"value": 8, "mismatch": True} and corpus.dimension(m.where("db_idx = 0")).first().value == 0


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.search_terms(F.lit("What is the N2-AMF  timer, timer? b")), ["n2-amf", "timer"]),
        (lambda: T.and_terms(F.array(*map(F.lit, ["registration", "t3", "cell", "a-b"])), F.array(F.lit("cell")), 3), ["cell", "t3", "a-b"]),
        (lambda: T.and_terms(F.array(*map(F.lit, ["t1", "t2", "t3", "t4", "x"])), F.array().cast("array<string>"), 3), ["t1", "t2", "t3", "t4"]),
        (lambda: T.round_to(F.lit(0.00015)), 0.0001),
        (lambda: T.release_of(F.lit("in Release-17 and rel 18")), "Rel-17"),
        (lambda: T.strip_question(F.lit("What is  the AMF")), "the AMF"),
        (lambda: T.spec_ids(F.lit("TS 38.331, 23.501-1 and 38.331")), ["38.331", "23.501-1"]),
        (lambda: T.display_id(F.lit("RFC3985")), "RFC 3985"),
        (lambda: T.names_spec(F.lit("see ITU-T X.700"), F.lit("ITU-T X.700")), True),
        (lambda: T.names_spec(F.lit("what is x700"), F.lit("ITU-T X.700")), True),
        (lambda: T.has_word(F.lit("a droplet"), F.lit("drop")), False),
        (lambda: T.has_word(F.lit("a drop."), F.lit("drop")), True),
        (lambda: T.is_binary(F.lit("  ")), True),
        (lambda: T.is_binary(F.lit("plain text")), False),
        (lambda: T.list_items(F.lit("a, b, c")), ["a", "b", "c"]),
        (lambda: T.list_items(F.lit("a, b? , c")), None),
        (lambda: T.verbosity(F.lit(" Short ")), "BRIEF"),
        (lambda: T.clamp(F.lit(99), 10, 1, 50), 50),
        (lambda: T.clamp(F.lit(None).cast("int"), 10, 1, 50), 10),
        (lambda: T.shape(F.lit("A ..... 1\nB ..... 2\nC ..... 3")), "toc"),
        (lambda: T.shape(F.lit("a\nb\nc\nd\ne")), "table"),
        (lambda: T.sentences(F.lit("One two. Three four! No\nFive six?")), ["One two.", "Three four!", "Five six?"]),
        (lambda: T.head(F.lit("  a  b "), 2), "a "),
        (lambda: T.unwrap(F.lit('{"question": "x y"}')), "x y"),
        (lambda: T.extras_weight(F.lit(None).cast("string"), F.lit("sip rfc"), ["rfc"]), 1.3),
        (lambda: T.extras_weight(F.lit(None).cast("string"), F.lit("arfcn"), ["rfc"]), 0.5),
        (lambda: T.document_reason(F.lit("<a>x</a>")), "xml"),
        (lambda: T.document_reason(F.lit('{"a": 1}')), None),
        (lambda: T.coverage_note(F.lit("Partial coverage: a\n b.\n\nrest")), "Partial coverage: a b."),
        (lambda: T.ignored_filters({"release": F.lit("admin"), "series": F.lit("38"), "doc_type": F.lit(" ")}), ["release"]),
        (lambda: T.object_context(F.lit("/a/ioc:SIB1/ioc:Sched/ioc:attributes/ioc:si-P"), F.lit("si-P")), ["SIB1", "Sched"]),
        (lambda: T.unit(F.array(F.lit(0.0), F.lit(0.0))), [0.0, 0.0]),
    ],
)
def test_functions(spark, column, want):
    assert value(spark, column()) == want
