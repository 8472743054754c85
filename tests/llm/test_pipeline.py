"""The pipeline's stages against what each decides by itself."""

from collections import Counter

import corpus_pipeline
from delayspace.llm.exact_dedup import exact_dedup
from delayspace.llm.mixing import mix_sources
from delayspace.llm.quality import score_quality
from delayspace.llm.simhash import similar_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = []
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        kept.append(now)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    assert ids(kept[0]) == ids(score_quality(docs, labels).where("predicted = 1"))
    assert ids(kept[1]) == ids(exact_dedup(kept[0]).where("kept"))
    assert ids(kept[2]) == ids(similar_classes(kept[1]).where("doc_id = component_id"))
    assert ids(kept[3]) == Counter({r["doc_id"]: r["copies"] for r in mix_sources(kept[2]).collect() if r["copies"]})
    assert ids(kept[4]) == ids(kept[3])
    assert ids(corpus_pipeline.run(spark, SF)) == ids(kept[4])


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
