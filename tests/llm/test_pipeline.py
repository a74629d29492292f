import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.001"


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, sf).cache()
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in left.select("doc_id").collect()} and len(ids) == after.count()
        left = after
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [r.text for r in left.collect()]
    assert not any(b in t for b in bench for t in texts) and 0.5 * docs.count() < len(texts) < docs.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, sf)
    assert pieces.select("doc_id").distinct().count() == len(texts)


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
