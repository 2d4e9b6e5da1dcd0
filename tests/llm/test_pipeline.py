"""The pipeline stage by stage against plain versions of its decisions."""

import corpus_pipeline
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs.toPandas(), docs.columns
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = docs.toPandas()
        if name != "encoding":
            assert docs.columns == columns
        if name == "quality rules":
            assert set(after.doc_id) < set(before.doc_id)
        if name == "near-dedup":
            classes = brute(list(zip(before.doc_id, before.text, strict=True)), 5, 80)
            assert sorted(after.doc_id) == sorted({c for _, _, c in classes})
        if name == "personal data":
            assert sorted(after.doc_id) == sorted(before.doc_id) and not after.text.str.contains(r"[a-z]@[a-z]+\.[a-z]").any()
        if name == "encoding":
            assert sorted(after.doc_id) == sorted(before.doc_id) and (after.n_ids == after.ids.map(len)).all()
            assert sorted(after.text) == sorted(before.text)


def test_pipeline_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert set(docs.columns) <= {*out.columns, "score"}
