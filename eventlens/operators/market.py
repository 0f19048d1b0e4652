"""Price series operators: as-of lookup, latest/last-n, daily close (MKT-*)."""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.common import plus_seconds
from eventlens.session import cut_lineage

DAY = 86400


def _bucket(ts: Column, bucket_seconds: int) -> Column:
    return F.floor(F.unix_seconds(ts) / F.lit(bucket_seconds))


#: Bars of a key and bucket from which the bucket is cut, and into how many parts at least.
DENSE_ROWS = 2_000_000
DENSE_PARTS = 256


def dense_borders(bars: DataFrame, keys: Sequence[str], dense_rows: int = DENSE_ROWS) -> DataFrame | None:
    """(keys, _b, _borders) of the buckets of ``bars`` (keys, _b, _t) with more
    than ``dense_rows`` rows: times (microseconds) that cut one into parts of
    about equal size. None if there is no such bucket, as for daily bars. The
    quantile sketches are merged, so no bucket is in one task."""
    dense = cut_lineage(bars.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense_rows).drop("_n"))
    if dense.isEmpty():
        return None
    cuts = [k / DENSE_PARTS for k in range(1, DENSE_PARTS)]
    return cut_lineage(bars.join(dense, [*keys, "_b"], "left_semi").groupBy(*keys, "_b")
                       .agg(F.array_distinct(F.percentile_approx(F.unix_micros("_t"), cuts, 20 * DENSE_PARTS)).alias("_borders")))


def asof_price(targets: DataFrame, prices: DataFrame, *, by: str | Sequence[str] = "asset_id",
               at: str = "target_at", ts: str = "ts", value: str = "close",
               direction: str = "nearest", out: str = "price",
               bucket_seconds: int = 7 * DAY, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """MKT-01: price of the first bar at or after ``at``, else the last bar at
    or before it (``direction='nearest'``); ``'forward'`` and ``'backward'``
    take one side only. Every target row is kept; no price gives NULL.

    Plan (no range join, linear in the rows of a key and bucket): targets and bars are unioned
    and windowed per (key, time bucket), which finds the answer whenever the
    bucket holds it; a second window over the small per-(key, bucket)
    summary (first/last value per bucket, one row per bucket) carries the
    neighbour values across empty stretches. A hot key is therefore spread over
    its time buckets, and the carry table grows with time span, not rows.

    A bucket (``bucket_seconds`` of a key) that holds more than ``dense_rows``
    bars is cut again at quantiles of its own bar times, so a dense feed is
    spread by its data; such buckets are few, and one border list is kept for
    each (``dense_borders``).
    """
    keys = [by] if isinstance(by, str) else list(by)
    tcols = targets.columns
    t = (targets.withColumn("_t", F.col(at))
         .withColumn("_b", _bucket(F.col(at), bucket_seconds))
         .withColumn("_k", F.lit(0))
         .withColumn("_v", F.lit(None).cast("double")))
    p = (prices.where(F.col(ts).isNotNull())
         .select(*keys, F.col(ts).alias("_t"), F.col(value).cast("double").alias("_v"))
         .withColumn("_b", _bucket(F.col("_t"), bucket_seconds))
         .withColumn("_k", F.lit(1)))
    borders = dense_borders(p, keys, dense_rows)
    if borders is None:
        place = lambda df: df.withColumn("_b", F.struct("_b", F.lit(0).alias("_s")))
    else:
        def place(df):
            inside = F.size(F.filter(F.coalesce("_borders", F.array().cast("array<bigint>")), lambda x: x <= F.unix_micros("_t")))
            return (df.join(borders, [*keys, "_b"], "left").withColumn("_b", F.struct("_b", inside.alias("_s"))).drop("_borders"))
    t, p = place(t), place(p)
    u = t.unionByName(p, allowMissingColumns=True)
    # For equal times the target sorts first, so a bar at exactly ``at`` is
    # "at or after"; the backward pass only matters when no such bar exists.
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_k")
    # Read backwards the next value is a running last value, so both passes
    # are linear (a frame that ends at unboundedFollowing is rebuilt per row).
    back = Window.partitionBy(*keys, "_b").orderBy(F.desc("_t"), F.desc("_k"))
    fwd = F.last("_v", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    bwd = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    inb = (u.select(*tcols, "_t", "_k", "_b", fwd.alias("_fwd"), bwd.alias("_bwd"))
           .where(F.col("_k") == 0).drop("_k"))

    # Carry table: one row per (key, bucket) that holds bars or targets.
    summ = (p.groupBy(*keys, "_b")
            .agg(F.min_by("_v", "_t").alias("_first"), F.max_by("_v", "_t").alias("_last")))
    tb = t.select(*keys, "_b").distinct()
    allb = (summ.unionByName(tb, allowMissingColumns=True)
            .groupBy(*keys, "_b").agg(F.first("_first", ignorenulls=True).alias("_first"),
                                       F.first("_last", ignorenulls=True).alias("_last")))
    ws = Window.partitionBy(*keys).orderBy("_b")
    wb = Window.partitionBy(*keys).orderBy(F.desc("_b"))
    carry = allb.select(
        *keys, "_b",
        F.last("_first", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias("_next"),
        F.last("_last", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev"))
    j = inb.join(carry, on=[*keys, "_b"], how="left")
    fwd_v = F.coalesce("_fwd", "_next")
    bwd_v = F.coalesce("_bwd", "_prev")
    if direction == "forward":
        price = fwd_v
    elif direction == "backward":
        price = bwd_v
    else:
        price = F.coalesce(fwd_v, bwd_v)
    price = F.when(F.col("_t").isNotNull(), price)
    return j.select(*[F.col(c) for c in tcols], price.alias(out))


def latest_price(prices: DataFrame, by: str = "asset_id", ts: str = "ts",
                 value: str = "close") -> DataFrame:
    """MKT-03: newest bar's close per asset (partial aggregate, skew-safe)."""
    return (prices.groupBy(by)
            .agg(F.max_by(F.struct(F.col(value).alias("price"), F.col(ts).alias("as_of")), ts).alias("_m"))
            .select(by, "_m.price", "_m.as_of"))


def last_bars(prices: DataFrame, n: int = 365, by: str = "asset_id", ts: str = "ts") -> DataFrame:
    """MKT-04: the newest ``n`` bars per asset, newest first (rank column ``rn``).

    ``row_number() <= n`` is planned with a partial WindowGroupLimit before
    the shuffle, so a hot asset sends at most ``n`` rows per input split.
    """
    w = Window.partitionBy(by).orderBy(F.col(ts).desc())
    return prices.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def daily_close(prices: DataFrame, by: str = "asset_id", ts: str = "ts",
                value: str = "close") -> DataFrame:
    """MKT-07: last price of each UTC day per asset."""
    return (prices.groupBy(by, F.to_date(ts).alias("date"))
            .agg(F.max_by(value, ts).alias("close")))


# Event-return horizons (name, seconds, label threshold in %)
RETURN_HORIZONS = [("1h", 3600, 0.5), ("6h", 6 * 3600, 1.0), ("24h", 24 * 3600, 2.0),
                   ("7d", 7 * 86400, 5.0)]


def label_change(pct: Column, threshold: float) -> Column:
    return (F.when(pct.isNull(), "neutral").when(pct > threshold, "positive")
            .when(pct < -threshold, "negative").otherwise("neutral"))


def event_returns(impacts: DataFrame, events: DataFrame, prices: DataFrame) -> DataFrame:
    """MKT-02: forward-only % change from the event time to +1h/6h/24h/7d for
    every (event, impacted asset), with per-horizon labels.

    Targets are exploded (5 per pair), one forward as-of pass answers all of
    them, then a conditional aggregate pivots back to one row per pair. A zero
    price counts as missing, as in the reference.
    """
    ev = events.where(F.col("published_at").isNotNull()).select(
        "event_id", F.col("title").alias("event_title"), "event_type", "severity", "region",
        "published_at")
    pairs = (impacts.select("event_id", "asset_id",
                            F.col("confidence_score").alias("sentiment_score"))
             .join(ev, "event_id"))
    hz = F.array(F.struct(F.lit("t0").alias("h"), F.lit(0).alias("s")),
                 *[F.struct(F.lit(n).alias("h"), F.lit(s).alias("s")) for n, s, _ in RETURN_HORIZONS])
    # (event, asset) is unique in impacts (first layer wins), so it keys the pair.
    tg = (pairs.select("event_id", "asset_id", "published_at", F.explode(hz).alias("_h"))
          .select("event_id", "asset_id", F.col("_h.h").alias("h"),
                  plus_seconds(F.col("published_at"), F.col("_h.s")).alias("target_at")))
    px = asof_price(tg, prices, direction="forward")
    px = px.withColumn("price", F.when(F.col("price") != 0, F.col("price")))
    piv = px.groupBy("event_id", "asset_id").agg(*[F.max(F.when(F.col("h") == h, F.col("price"))).alias(f"p_{h}")
                                    for h in ["t0"] + [n for n, _, _ in RETURN_HORIZONS]])
    base = F.col("p_t0")
    out = pairs.join(piv, ["event_id", "asset_id"])
    cols = [F.col(c) for c in ["event_id", "asset_id", "event_title", "event_type",
                               "sentiment_score", "severity", "region", "published_at"]]
    pcts = []
    for n, _, thr in RETURN_HORIZONS:
        pct = F.when(base.isNotNull(), (F.col(f"p_{n}") - base) / base * 100.0)
        pcts.append(pct.alias(f"pct_{n}"))
    labels = [label_change(F.col(f"pct_{n}"), thr).alias(f"label_{n}") for n, _, thr in RETURN_HORIZONS]
    return out.select(*cols, *pcts).select("*", *labels)
