import corpus_pipeline
from tessera.llm.shared import stored


def test_each_stage_on_odd_rows(spark, documents, nothing, tmp_path):
    sf = tmp_path.as_uri()
    spark.createDataFrame([(0, 1, 1), (7, 1, 0), (8, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (documents, nothing):
            out = stage(spark, docs, sf)
            assert name == "packing" or out.columns == docs.columns
            assert docs is documents or out.count() == 0


def test_decisions_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs, counts = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if name == "pii":
            assert docs.where("text rlike '[a-z0-9]+@[a-z0-9]+[.]'").count() == 0
    total = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert total > counts[0] > counts[1] == counts[2] > 0
    assert docs.columns[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
