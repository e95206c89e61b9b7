"""The pipeline's stages on nulls, repeats, ties, long and empty texts, clashing names and empty tables."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LONG = "the long road to the old town is quiet and green " * 4000
ROWS = [(1, "the first clean text of a document about rivers and hills", "en", "a", 57), (2, None, "en", "a", None), (3, "", "en", None, 0), (None, "a text without an id that is long enough to be kept by all", "en", "b", 9), (None, None, None, None, None),
        (5, LONG, "en", "b", 9), (6, "same same text here for two rows of one id and more", "en", "b", 1), (6, "same same text here for two rows of one id and more", "en", "b", 1), (7, "  \n ", "de", "c", 4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    for c, v in (("__counts", 1), ("__score", 2.5), ("__copies", 3), ("__n", 4), ("__size", 5), ("__s", "k"), ("chunk", 6), ("h", 7)):
        d = d.withColumn(c, F.lit(v))
    d.repartition(3).write.parquet(f"{at}/documents.parquet")
    words = [f"word{i} word{i % 7} text of many words about things" for i in range(60)]
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (7, 0, None), (None, 1, 0), (2, None, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(i, w) for i, w in enumerate(words)] + [(99, None), (None, "x"), (98, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_keeps_columns_and_values(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    assert out.columns == docs.columns
    got = out.collect()
    extra = docs.columns[5:]
    assert {tuple(r[c] for c in extra) for r in got} <= {(1, 2.5, 3, 4, 5, "k", 6, 7)}
    if name != "quality":  # these stages know no such document as bad
        assert 1 in {r.doc_id for r in got} or name == "mixing"
    if name == "pii":
        assert len(got) == len(ROWS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert stage(spark, docs, folder).count() == 0
