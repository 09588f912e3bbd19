import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

from .conftest import ODD, SF, pairs
from .test_jaccard import brute as near
from .test_tokens import check_pieces

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, None if k % 3 else "en", None, None if t is None else len(t)) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, COLUMNS).withColumn("key", F.lit(1)).withColumn("language", F.lit(2)).withColumn("place", F.lit(3))


def test_every_stage_on_odd_documents(spark, odd_docs, empty):
    docs = odd_docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == odd_docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0
        docs = out
    texts = {t for _, t in pairs(docs)}
    assert all(t and any(c.isalpha() for c in t) for t in texts)
    assert len([t for t in texts if t.split()[:3] == ["one", "two", "three"]]) == 1
    assert len([t for t in texts if t.lower().startswith("alpha beta")]) == 1
    assert 'api' not in "".join(t for t in texts if "secret" in t)
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    check_pieces(pipeline.pack(spark, docs, SF).collect(), pairs(docs), 4096)
    assert pipeline.pack(spark, empty, SF).count() == 0


def test_stages_on_the_table(spark, docs):
    told = pipeline.identify_language(spark, docs, SF).cache()
    assert sorted(r.doc_id for r in told.collect()) == sorted(i for i, t in pairs(docs) if any(c.isalpha() for c in t or ""))
    kept = pipeline.drop_near_copies(spark, pipeline.drop_exact_copies(spark, told, SF), SF).cache()
    groups = near(pairs(told))
    assert kept.count() == len({k[2] for k in groups})
    assert {r.doc_id for r in kept.collect()} <= {i for i, _ in pairs(told)}


def test_run(spark):
    pieces = pipeline.run(spark, SF)
    assert pieces.where("doc_id is null").count() == 0 and pieces.count() > 0
