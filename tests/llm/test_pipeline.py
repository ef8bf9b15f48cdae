import corpus_pipeline as C

from granary import runtime
from granary.llm import near_duplicates as N


def test_stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    scratch = runtime.Scratch(spark)
    docs = runtime.table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    assert [name for name, _ in C.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "mixing sources to target weights", "best-fit packing"]
    for name, stage in C.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if name == "n-gram Jaccard join":
            assert N.near_duplicates(spark, docs).filter("n_similar > 0").count() == 0
    assert sizes[1] < sizes[0] and sizes[2] == sizes[1] and sizes[3] < sizes[2]
    packed = C.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert C.run(spark, sf_dir).count() == packed.count()


def test_odd_rows(spark, odd, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).count() > 0


def test_empty(spark, nothing, no_labels, tmp_path):
    no_labels.write.parquet(f"{tmp_path}/labels.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert C.run(spark, str(tmp_path)).collect() == []
