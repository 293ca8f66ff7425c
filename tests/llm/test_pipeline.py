import corpus_pipeline
from verbaline.llm import secrets

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts, before = {r.doc_id: r.text for r in docs.collect()}, 1000
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        if name != "best_fit_packing":
            assert docs.columns == columns
            rows = docs.collect()
            if name == "quality_classifier":
                good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
                assert len(good - {r.doc_id for r in rows}) <= 0.02 * len(good) and len(rows) < before
            elif name == "simhash_near_dedup":
                assert len({r.doc_id for r in rows}) == len(rows) < before and len({r.text for r in rows}) == len(rows)
            elif name == "secret_scan":
                assert len(rows) == before and not any(secrets.base_spans(r.text) for r in rows if "[SECRET]" in r.text and len(secrets.base_spans(texts[r.doc_id])) == 1)
                assert all(r.text == texts[r.doc_id] or "[SECRET]" in r.text for r in rows)
            else:
                assert 0.9 < sum(len(r.text.split()) for r in rows) / words < 1.1
            words, before = sum(len(r.text.split()) for r in rows), len(rows)
        else:
            p = docs.toPandas()
            assert p.doc_id.nunique() <= before and all(g.sort_values("offset").offset.tolist() == [0, *g.sort_values("offset").length.cumsum()[:-1]] and g.length.sum() <= 1024 for _, g in p.groupby("sequence_id"))


def test_without_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_stages_on_odd_rows(spark, docs_of):
    from conftest_rows import ODD

    docs = docs_of([*ODD, (30, 'a token = "abcdef0123" b', "a"), (31, "plain words " * 40, None)])
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, SF), "odd")
        if name == "best_fit_packing":
            assert docs.where("length > 1024").count() == 0
        else:
            assert docs.columns == columns and docs.count() > 0
