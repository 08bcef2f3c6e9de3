import corpus_pipeline as C
from netweir.llm import decontaminate, quality_rules
from netweir.llm.common import shared_folder
from tests.llm.test_simhash import jaccard

SF = "/root/testdata/sf0.001"


def test_each_stage_on_its_own_input(spark):
    docs, folder = spark.read.parquet(f"{SF}/documents.parquet"), shared_folder(spark, "stages")
    columns, seen = docs.columns, [docs]
    for i, (_, stage) in enumerate(C.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{folder}/{i}")
        seen.append(spark.read.parquet(f"{folder}/{i}"))
    raw, good, single, clean, mixed, records = seen
    assert all(f.columns == columns for f in seen[:-1])
    kept = {r.doc_id for r in quality_rules.judge(raw).where("__verdict.kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept
    texts = [r.text for r in single.collect()]
    assert all(jaccard(texts[i], texts[j]) < 0.8 for i in range(len(texts)) for j in range(i))
    leaks = decontaminate.leaking_documents(single, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - {r.doc_id for r in leaks.collect()}
    assert records.count() == mixed.count() and mixed.select("doc_id").distinct().count() <= clean.count()
    assert sorted(r.doc_id for r in records.orderBy("start").collect()) == [r.doc_id for r in records.orderBy("start").collect()]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = docs
