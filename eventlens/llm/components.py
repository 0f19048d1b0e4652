"""Connected components of a link table by alternating large and small stars."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, written to the shared folder, and a checksum of them read
    from the files just written (two numbers reach the driver)."""
    kept = written(edges, "edges")
    seen = kept.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return kept, (seen["n"], seen["h"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the component is
    the smallest node reachable. Each round writes its edges to the shared
    folder; a vertex with very many links is reduced by the partial minimum
    before the shuffle, and its join is an ordinary one that Spark can split."""
    edges, before = _kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        # large star: every larger neighbour points to the smallest one
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # small star: the smaller neighbours and the node itself point to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .union(least.select("a", F.col("low").alias("b"))).distinct())
        edges, after = _kept(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
