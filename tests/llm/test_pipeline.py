"""The pipeline's stages take effect one after the other, and its result is that of the stages called by hand."""

import corpus_pipeline as p
import pytest
from cadentia.llm.common import table, written

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = table(spark, SF, "documents")
    out = [docs]
    for name, stage in p.STAGES:
        out.append(written(spark, stage(spark, out[-1], SF), "test"))
    return out


def test_stages(spark, steps):
    assert [n for n, _ in p.STAGES] == ["language ID", "toxicity", "n-gram Jaccard join", "mixing", "BPE"]
    assert all(d.columns == steps[0].columns for d in steps[1:5])
    counts = [d.count() for d in steps]
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    for before, after in zip(steps[:3], steps[1:4], strict=True):
        assert after.exceptAll(before).count() == 0
    assert steps[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert steps[4].distinct().exceptAll(steps[3]).count() == 0


def test_run_equals_stages(spark, steps):
    assert p.run(spark, SF).exceptAll(steps[5]).count() == 0 and p.ORACLE_SQL is None


def test_stages_take_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    for name, stage in p.STAGES:
        out = written(spark, stage(spark, odd_docs, SF), "odd")
        if name == "BPE":
            assert out.count() == odd_docs.count() and all(len(r.ids) == r.n_tokens for r in out.collect())
        else:
            assert out.columns == odd_docs.columns and out.distinct().exceptAll(odd_docs.distinct()).count() == 0
        if name != "n-gram Jaccard join":
            assert stage(spark, no_docs, SF).count() == 0
