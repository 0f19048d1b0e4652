"""Country heatmaps and serving aggregates (AGG-*)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions.common import literal_table, ts_lit


def coords_table(spark) -> DataFrame:
    """TXT-12 lookup table: 29 fixed rows, broadcast by construction."""
    return literal_table(spark, L.COUNTRY_COORDS,
                         "country string, latitude double, longitude double")


def country_coords(df: DataFrame, country_col: str = "country") -> DataFrame:
    """TXT-12: attach (latitude, longitude); unknown countries get NULLs."""
    t = coords_table(df.sparkSession).withColumnRenamed("country", "_cc")
    return (df.join(t, F.col(country_col) == F.col("_cc"), "left").drop("_cc"))


def event_heatmap(events: DataFrame, as_of, days: int = 14, event_type: str | None = None,
                  n: int = 80) -> DataFrame:
    """AGG-01: published events of the last ``days`` grouped by country.

    Means are over non-NULL values (0.0 when none); conflict share is over all
    rows of the country. One partial+final hash aggregate on country; the
    coordinate table is a fixed 29-row broadcast.
    """
    since = ts_lit(as_of) - F.make_dt_interval(F.lit(days))
    e = events.where(F.col("status").isin(L.PUBLISHED_STATUSES)
                     & F.col("published_at").isNotNull()
                     & (F.col("published_at") >= since)
                     & F.col("country").isNotNull())
    if event_type:
        e = e.where(F.col("event_type") == event_type)
    e = (e.select(F.trim("country").alias("country"), "severity", "confidence_score",
                  "event_type")
         .where(F.col("country") != ""))
    g = e.groupBy("country").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.coalesce(F.avg(F.col("severity").cast("double")), F.lit(0.0)).alias("avg_severity"),
        F.coalesce(F.avg("confidence_score"), F.lit(0.0)).alias("avg_confidence"),
        F.avg(F.when(F.col("event_type") == "conflict", 1.0).otherwise(0.0)).alias("conflict_share"))
    return (country_coords(g)
            .orderBy(F.desc("event_count"), F.asc("country"))
            .limit(n))
