"""The pipeline against a plain version of its stages."""

import brute
import corpus_pipeline
from pyspark.sql import functions as F

from tidewell.llm import langid
from tidewell.llm.common import may_learn


def test_stages_by_plain_versions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = langid.learn(docs, may_learn(F.col("doc_id")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    langs, scores = model.predict([t for _, t in rows])
    rows = [r for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= corpus_pipeline.LEAST_KNOWN]
    keep = {k for _, k, _, _ in brute.exact(rows)[0]}
    rows = [r for r in rows if r[0] in keep]
    keep = {i for i, _, c in brute.near(rows, corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT) if i == c}
    rows = [r for r in rows if r[0] in keep]
    bad = {i for i, _, _, _, contaminated in brute.contamination(rows, items) if contaminated}
    want = {i: t for i, t in rows if i not in bad}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.decoded_sha256 for r in out} == {i: brute.sha(t) for i, t in want.items()}
    assert all(r.n_tokens == len(r.ids) for r in out)


def test_stage_interfaces(spark, odd, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontaminate", "encode"]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, odd, sf)
        assert out.columns == odd.columns and 0 <= out.count() <= odd.count(), name
        assert step(spark, odd.limit(0), sf).count() == 0
    assert corpus_pipeline.encode(spark, odd, sf).count() == odd.count()
