import corpus_pipeline
from orderloom.llm.common import written
from orderloom.llm.decontam import contaminated
from orderloom.llm.neardup import near_components


def test_stages_in_order(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "tokens"]
    made, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        made.append(written(stage(spark, made[-1], data), name))
        if name != "tokens":
            assert made[-1].columns == columns
    _, kept, apart, clean, mix, tokens = made
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in (docs, kept, apart, clean, mix, tokens)]
    assert all(a >= b for a, b in zip(ids, ids[1:], strict=False))
    assert len(ids[1]) >= 0.8 * len(ids[0])
    assert near_components(apart, words=5).filter("not kept").count() == 0
    assert contaminated(clean, spark.read.parquet(f"{data}/benchmark.parquet")).count() == 0
    assert tokens.count() == mix.count()
