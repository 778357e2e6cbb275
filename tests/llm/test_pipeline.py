"""The pipeline's stages against brute force on the smallest tables."""

import pytest
from test_llm import brute_classes, brute_hits

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lodestar.llm.common import table, written  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF), "stage")
        sizes.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            classes = brute_classes([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in docs.collect()} == set(classes.values())
        if i == 3:
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect() if not brute_hits(r.text, bench)[4]}
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] == sizes[5]
    good = table(spark, SF, "labels").where("quality = 1").join(table(spark, SF, "documents"), "doc_id")
    assert corpus_pipeline.quality(spark, good.select(*columns), SF).count() >= 0.97 * good.count()
