"""The pipeline's stages by what each promises about its own input."""

import corpus_pipeline
from clearspark.llm import decontaminate, jaccard_join, knn_quality
from clearspark.llm.common import Scratch


def test_stages(spark, sf):
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.write(stage(spark, docs, sf), name)
        kept[name] = (before.collect(), docs.collect())
        if name != "token_files":
            assert docs.columns == columns
    before, after = kept["quality"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    all_docs = spark.read.parquet(f"{sf}/documents.parquet")
    scores = {r.doc_id: r.score for r in knn_quality.score(all_docs, knn_quality.learn(all_docs, labels)).collect()}
    assert {r.doc_id for r in after} == {d for d, s in scores.items() if s >= 0.7}
    before, after = kept["near_copies"]
    want = jaccard_join.brute_force(sorted((r.doc_id, r.text) for r in before))
    assert {r.doc_id for r in after} == {c for _, _, c in want} and len(after) == len({r.doc_id for r in after})
    before, after = kept["contamination"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not decontaminate.brute_force(r.text, items)[4]}
    before, after = kept["mixing"]
    texts = {r.doc_id: r for r in before}
    assert all(r == texts[r.doc_id] for r in after)
    before, after = kept["token_files"]
    assert sorted(r.doc_id for r in before) == sorted(r.doc_id for r in after)
    at = 0
    for r in sorted(after, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_odd_and_no_rows(spark, odd_rows, no_rows, sf):
    for d in (odd_rows, no_rows):
        d = d.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(n_words as bigint) as n_chars")
        own = {tuple(r) for r in d.collect()}
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, d, sf)
            rows = [tuple(r) for r in after.collect()]
            if name != "token_files":
                assert after.columns == d.columns and set(rows) <= own
            else:
                assert len(rows) == d.count()


def test_run_is_the_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, sf), name)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))
