"""Operators that follow one another in a session."""
from pyspark.sql import functions as F

from conftest_paths import SF001

from eventlens.llm.embedding_links import embedding_links
from eventlens.llm.near_copies import near_copies
from eventlens.llm.secrets import find_secrets


def test_secrets_after_components_and_an_observation(spark):
    assert near_copies(spark.read.parquet(f"{SF001}/documents.parquet")).count() == 200
    assert embedding_links(spark.read.parquet(f"{SF001}/embeddings.parquet")).count() == 500
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 5
    df = spark.createDataFrame([(1, "x password=hunter2secret, z")], "doc_id long, text string")
    assert [r.value for r in find_secrets(df).collect()] == ["hunter2secret"]
