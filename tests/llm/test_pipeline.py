"""The pipeline's stages on the smallest tables: each decision takes effect."""

from conftest import DATA

import corpus_pipeline
from netloom.llm.common import staged


def test_stages(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns
        if name == "quality":
            kept = {r.doc_id for r in docs.select("doc_id").collect()}
            good = [k for k, q in labels.items() if q == 1]
            assert sum(k in kept for k in good) >= 0.95 * len(good)
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == sizes[-1] <= sizes[-2]
    assert len(corpus_pipeline.STAGES) == 5 and docs.select("sequence_id").distinct().count() > 0
