import corpus_pipeline as cp
from tests.conftest import SF_SMALL
from tests.llm.frames import awkward, empty, frame


def test_every_stage_takes_awkward_and_no_documents(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and columns
    whose names operators use inside."""
    docs = frame(spark).repartition(3)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r[0] for r in awkward()}, name
        assert stage(spark, empty(spark), SF_SMALL).count() == 0, name
    masked = dict(cp.STAGES)["secret scans"](spark, docs, SF_SMALL)
    assert masked.count() == docs.count()
    encoded = cp.STAGES[-1][1](spark, docs, SF_SMALL)
    assert encoded.count() == docs.count()
    assert all(r.n_tokens == 0 for r in encoded.filter("doc_id in (100, 101)").collect())
    assert cp.STAGES[-1][1](spark, empty(spark), SF_SMALL).count() == 0


def test_repeated_documents_leave_one(spark):
    rows = [(i % 3, "the same words in every one of these rows " * 5, "en", "s1", 1) for i in range(12)]
    kept = dict(cp.STAGES)["simhash near-dedup"](spark, frame(spark, rows), SF_SMALL)
    assert [r.doc_id for r in kept.collect()] == [0]
