import corpus_pipeline
from recordloom.llm.base import table
from recordloom.session import cut

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = raw = table(spark, SMALL, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SMALL))
        assert docs.columns == raw.columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] <= counts[1]
    texts = [r.text or "" for r in docs.collect()]
    assert not any("@mail" in t for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}


def test_stages_take_empty_tables(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []
