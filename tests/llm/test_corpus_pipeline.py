"""The pipeline, and each of its stages on the stage before."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_stages_keep_the_columns_and_drop_what_they_must(stages):
    docs, known, single, clean, mixed, sharded = stages
    for df in (known, single, clean, mixed):
        assert df.columns == docs.columns
    assert known.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    assert single.count() < known.count()
    assert single.select("text").distinct().count() == single.count()
    assert clean.count() <= single.count()
    assert sharded.count() == mixed.count()
    assert sharded.filter("shard NOT BETWEEN 0 AND 23").count() == 0


def test_nothing_of_the_benchmark_is_left(stages, spark):
    from refracta.llm.decontaminate import contamination

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert contamination(stages[2], items).filter("contaminated").count() > 0
    assert contamination(stages[3], items).filter("contaminated").count() == 0


def test_run_gives_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.drop("n_chars").collect()), key=str) == sorted(map(tuple, stages[-1].collect()), key=str)


def test_awkward_documents_pass(spark):
    rows = [(1, None, None, None, None), (None, "", "en", "a", 0), (2, "ein Text", "de", "a", 8), (2, "ein Text", "de", "a", 8), (3, "?", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        out = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, SF)
        assert out.count() == (0 if empty else 1)
