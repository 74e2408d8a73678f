import corpus_pipeline
import pytest
from tests.llm.test_text_operators import ODD, SCHEMA

from tessera.llm import chosen_path, decontaminate, pieces, queries, resampling, secrets


def test_stages_on_the_small_tables(spark, sf):
    """Each stage against a plain version over its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        docs = stage(spark, docs, sf).cache()
        after = docs.toPandas()
        if k < 4:
            assert docs.columns == columns
        if k == 0:
            kept = resampling.resample(spark.createDataFrame(before), labels).where("kept").toPandas()
            assert sorted(after.doc_id) == sorted(kept.doc_id)
        elif k == 1:
            classes = chosen_path.brute_force(before.text.tolist(), before.doc_id.tolist())
            assert sorted(after.doc_id) == sorted(classes.class_id.unique())
        elif k == 2:
            items = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
            dirty = {d for d, t in zip(before.doc_id, before.text, strict=True) if any(x in t for x in items.text)}
            assert not dirty & set(after.doc_id)
            index = decontaminate.build(list(items[["item_id", "text"]].itertuples(index=False, name=None)))
            assert set(before.doc_id) - set(after.doc_id) == {d for d, x in zip(before.doc_id, decontaminate.leaks(before.text.tolist(), index), strict=True) if x}
        elif k == 3:
            assert len(after) == len(before) and (after.n_chars == after.text.str.len()).all()
            forest = secrets.fit()
            for t in after.text:
                assert not any(p >= secrets.SURE for *_, p in secrets.scan(t, forest))
        else:
            v = pieces.Vocabulary.load(f"{queries.TOKENIZERS}/piece_bpe_32k.model")
            texts = dict(zip(before.doc_id, before.text, strict=True))
            assert set(after.doc_id) == set(texts)
            assert all(v.decode(list(i)) == texts[d] for d, i in zip(after.doc_id, after.ids, strict=True))
        rows[name] = len(after)
    assert len(corpus_pipeline.run(spark, sf).toPandas()) == rows["SentencePiece encoding"]


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, sf, k):
    """No stage loses rows that it has no reason to drop: those without id, repeated ids with other texts, nulls."""
    stage, docs = corpus_pipeline.STAGES[k][1], spark.createDataFrame(ODD, SCHEMA)
    got = stage(spark, docs, sf)
    rows = got.collect()
    if k < 4:
        assert got.columns == docs.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in rows)
    every = sorted((i is None, i or 0) for i, *_ in ODD)
    if k == 1:
        assert ids == sorted(set(every) - {(False, 5)})
    elif k in (2, 3):
        assert ids == every
    elif k == 4:
        assert {(r.doc_id, r.sample) for r in rows} >= {(i, 0) for i, *_ in ODD}
    else:
        assert not {2, 3, 4} & {r.doc_id for r in rows}
    assert stage(spark, spark.createDataFrame([], SCHEMA), sf).count() == 0
