import corpus_pipeline
from roadlark.llm.queries import queries
from tests.llm.conftest import prose, row


def test_pipeline(spark, tmp_path):
    from tests.llm.conftest import SCHEMA

    rows = [row(i, prose(i, 90), f"s{i % 3}") for i in range(40)] + [row(100 + i, prose(3, 90)) for i in range(5)] + [row(200, "short"), row(201, None), row(202, prose(77, 60) + " mail jo@x.example.com now " + prose(78, 30))]
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
        ids = {r["doc_id"] for r in now.collect()}
        if name == "quality rules":
            assert ids == {*range(40), *range(100, 105), 202}
        if name == "near duplicates":
            assert ids == {*range(40), 202}
        if name == "personal data":
            assert ids == {*range(40), 202} and "<EMAIL>" in next(r["text"] for r in now.collect() if r["doc_id"] == 202)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(out) == now.count() and all(r["is_lossless"] for r in out)


def test_pipeline_of_nothing(spark, tmp_path):
    from tests.llm.conftest import SCHEMA

    spark.createDataFrame([], SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_has_a_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries()) == list(range(1, 14))
