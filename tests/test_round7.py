"""A text is read once however many parts of a plan use what was found in it,
and the partitions of a keyed table are written by several tasks."""
import glob
import os
import re

import pytest
from pyspark.sql import functions as F

from eventlens import sinks
from eventlens.operators import events as EV
from eventlens.operators import graph as G
from eventlens.operators import mapping as MP


@pytest.fixture
def assets(spark):
    return spark.createDataFrame([(1, "S1", "Alpha Steel Corp", "equity", "EUROPE", "FRANCE"), (2, "S2", "Beta Copper", "equity", "ASIA", "CHINA"),
                                  (3, "S3", "Gamma Zinc", "equity", "ASIA", "INDIA")],
                                 "asset_id bigint, ticker string, name string, asset_type string, sector string, country string")


@pytest.fixture
def edges(spark):
    return spark.createDataFrame([("ASSET:S1", "ASSET:S3", "SUPPLIES_TO", 0.8)],
                                 "source_key string, target_key string, relationship string, strength double")


def counted(spark):
    """A column function that hands a text on and an accumulator of how often it was read."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(s):
        reads.add(1)
        return s

    return read, reads


def test_mentions_read_each_text_once(spark, assets, edges):
    read, reads = counted(spark)
    docs = spark.createDataFrame([(1, "S1 rises"), (2, "alpha steel and S2"), (3, None), (4, "nothing"), (1, "S1 again")], "doc_id bigint, raw string")
    found = MP.extract_mentions(docs.select("doc_id", read("raw").alias("text")), MP.asset_aliases(assets))
    spread = MP.expand_graph(found, edges)
    assert sorted((r[0], r[1], round(r[2], 6)) for r in spread.collect()) == [(1, "S3", 0.48), (2, "S3", 0.48)]
    assert sorted(tuple(r) for r in found.collect()) == [(1, "S1"), (2, "S1"), (2, "S2")]
    assert reads.value == 5


def test_backfill_reads_each_text_once(spark, assets, edges):
    read, reads = counted(spark)
    articles = spark.createDataFrame([(1, "a", "news of alpha", "2024-01-02"), (2, "steel plant", "S2 rises", "2024-01-01"), (3, None, None, None)],
                                     "article_id bigint, title string, raw string, at string")
    articles = articles.select("article_id", "title", read("raw").alias("content"), F.col("at").cast("timestamp").alias("published_at"))
    events = spark.createDataFrame([(7, "conflict", 0.5, "2024-01-03")], "event_id bigint, event_type string, confidence_score double, at string")
    events = events.withColumn("created_at", F.col("at").cast("timestamp"))
    links = spark.createDataFrame([(7, 1), (7, 2), (7, 2), (7, 3), (8, 1)], "event_id bigint, article_id bigint")
    out = EV.backfill_entities(events, links, articles, assets, edges)["impacts"]
    # "alpha steel" stands where the first article ends and the next begins.
    assert sorted((r["ticker"], r["layer"]) for r in out.collect()) == [("S1", 1), ("S2", 1), ("S3", 2)]
    assert reads.value == 3


def test_filing_words_are_found_once_a_row(spark, assets):
    read, reads = counted(spark)
    filings = spark.createDataFrame([(1, "S3", "our supplier alpha steel corp ships"), (2, "S3", "nothing"), (3, "S3", None)],
                                    "filing_id bigint, source_ticker string, raw string")
    # "alpha steel" and "alpha steel corp" are both names of S1.
    # "alpha steel" and "alpha steel corp" are both names of S1.
    out = G.filing_edges(filings.select("filing_id", "source_ticker", read("raw").alias("text")), assets)
    assert [(r["source_key"], r["target_key"], r["mentions"]) for r in out.collect()] == [("ASSET:S1", "ASSET:S3", 2)]
    assert reads.value == 3


def test_small_partitions_are_dealt_over_tasks(spark, tmp_path):
    rows = spark.range(200).select(F.col("id"), F.concat(F.lit("d"), (F.col("id") % 40).cast("string")).alias("day"))
    path = str(tmp_path / "t")
    assert len(sinks.upsert_partitions(rows, path, ["id"], "day")) == 40
    files = glob.glob(os.path.join(path, "day=*", "part-*.parquet"))
    assert len(files) == 40 and len({re.search(r"part-(\d+)", f)[1] for f in files}) > 1
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    assert sinks.read_partitions(spark, path, rows.schema, "day").count() == 200
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
