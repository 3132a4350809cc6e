import pytest

import corpus_pipeline
from seriesloom.llm import queries as Q
from seriesloom.llm.decontam import contaminated
from seriesloom.llm.ngram_join import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
        out[-1].persist()
    return out


def test_stages_keep_the_columns_and_decide(spark, stages):
    docs, clean, unique, sound, mixed, shards = stages
    for df in (clean, unique, sound, mixed):
        assert df.columns == docs.columns
    assert docs.count() >= clean.count() >= unique.count() >= sound.count() > 0
    assert contaminated(sound, spark.read.parquet(f"{SF}/benchmark.parquet")).count() == 0
    left = jaccard_components(unique).toPandas()
    assert (left["doc_id"] == left["component_id"]).all()
    assert shards.count() == mixed.count()


def test_run_gives_a_shard_for_each_document(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "shard"} <= set(out.columns) and out.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in Q.QUERIES) == list(range(1, 14))
    assert set(Q.ORACLE_SQL) <= set(Q.QUERIES)
