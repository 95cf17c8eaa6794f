from __future__ import annotations

import corpus_pipeline


def test_stages_on_real_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir), f"test{k}")
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == columns
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "mixing", "packing"]


def test_clean_documents_stay_and_decisions_take_effect(spark, sf_dir, make_docs):
    clean = [f"A calm text number {k} about rivers {k * 7}, hills and the quiet town of place{k} where people{k} meet on day {k * 3}." for k in range(30)]
    docs = make_docs([*clean, clean[0], None, ""])
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in kept.where("doc_id < 30").collect()) == list(range(30))
    lines = corpus_pipeline.lines(spark, kept, sf_dir)
    assert {r["text"] for r in lines.where("doc_id = 30").collect()} <= {""}
    one = corpus_pipeline.near_duplicates(spark, lines, sf_dir)
    assert sorted(r["doc_id"] for r in one.where("doc_id < 30").collect()) == list(range(30))


def test_run_equals_its_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:3] == ["doc_id", "start", "length"]
    pieces = out.collect()
    assert pieces and max(r["offset"] + r["length"] for r in pieces) <= 2048
