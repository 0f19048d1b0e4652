"""Daily event aggregates, window features, labels and dataset checks
(AGG-07, FLT-05, FEA-01..08, FEA-12, FEA-13).

All series windows are ``partitionBy(symbol).orderBy(date)`` with row
frames, so many symbols run in parallel. A daily series holds one row per
symbol-day, so a partition is bounded by the time span, not by the raw data
volume (raw ticks are reduced to days before any of these run).
"""
from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.common import complete_rows, ieee_ratio

# Daily-event fill columns (NULL -> 0 after the calendar join)
DAILY_FILL = ["event_count", "event_count_change", "avg_sentiment", "avg_goldstein",
              "max_abs_goldstein", "max_abs_sentiment", "min_sentiment", "max_sentiment"]
# Lag feature sources and lags
LAG_SOURCES = [("sentiment", "avg_sentiment"), ("goldstein", "avg_goldstein"),
               ("event_count", "event_count"), ("spike", "shock"),
               ("max_gold", "max_abs_goldstein"), ("max_sent", "max_abs_sentiment")]
LAGS = [1, 2, 3]
# Columns never treated as features in validation
NON_FEATURES = {"timestamp", "date", "target", "future_return", "threshold", "open", "high", "low"}
REQUIRED_NOT_NULL = ["return_1d", "return_3d", "return_7d", "volatility_7d"]
FILL_AFTER_DROP = ["sentiment_momentum", "goldstein_momentum", "impact_score",
                   "sentiment_pressure", "event_bear_interaction"]


def _w(by: str, order: str) -> Window:
    return Window.partitionBy(by).orderBy(order)


def rolling(fn, c: Column | str, w: Window, lo: int, hi: int = 0) -> Column:
    return fn(c).over(w.rowsBetween(lo, hi))


def full_rolling(fn, c: str, w: Window, n: int) -> Column:
    """pandas ``rolling(n)`` (min_periods = n): NULL unless n non-NULL values."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) == n, fn(c).over(frame))


def filter_high_impact(events: DataFrame) -> DataFrame:
    """FLT-05: articles >= 5 or |goldstein| >= 1.5 (missing articles count as 0)."""
    return events.where((F.coalesce(F.col("num_articles"), F.lit(0)) >= 5)
                        | (F.abs(F.col("goldstein")) >= 1.5))


def daily_events(events: DataFrame, ts: str = "published_at") -> DataFrame:
    """AGG-07: per-day event statistics and day-over-day count change.

    The daily table has one row per day, so the final ``lag`` runs over a
    table bounded by the calendar; the aggregation itself is a partial+final
    hash aggregate on date.
    """
    d = (events.where(F.col(ts).isNotNull())
         .groupBy(F.to_date(ts).alias("date"))
         .agg(F.count("sentiment").alias("event_count"),
              F.avg("sentiment").alias("avg_sentiment"),
              F.avg("goldstein").alias("avg_goldstein"),
              F.max(F.abs("goldstein")).alias("max_abs_goldstein"),
              F.max(F.abs("sentiment")).alias("max_abs_sentiment"),
              F.min("sentiment").alias("min_sentiment"),
              F.max("sentiment").alias("max_sentiment"),
              F.sum(F.coalesce(F.col("num_articles"), F.lit(0))).alias("num_articles")))
    w = Window.orderBy("date")
    chg = F.coalesce(F.col("event_count") - F.lag("event_count").over(w), F.lit(0))
    return d.withColumn("event_count_change", chg.cast("double"))


def market_features(prices: DataFrame, by: str = "symbol", date: str = "date",
                    close: str = "close") -> DataFrame:
    """FEA-01: log returns 1/3/7, 7-row sample std of pct change, MA 7/14 and
    ratio, weekday (Mon=0) and month."""
    w = _w(by, date)
    c = F.col(close)
    df = prices.select("*", *[F.log(c / F.lag(close, k).over(w)).alias(f"return_{k}d")
                              for k in (1, 3, 7)],
                       (c / F.lag(close, 1).over(w) - 1).alias("_pct"))
    return (df.withColumn("volatility_7d", rolling(F.stddev_samp, "_pct", w, -6))
            .withColumn("ma_7", rolling(F.avg, close, w, -6))
            .withColumn("ma_14", rolling(F.avg, close, w, -13))
            .withColumn("ma_ratio", F.col("ma_7") / F.col("ma_14"))
            .withColumn("day_of_week", F.weekday(date))
            .withColumn("month", F.month(date))
            .drop("_pct"))


def date_overlap_exists(prices: DataFrame, daily: DataFrame, date: str = "date") -> bool:
    """FEA-02 guard: True when at least one price date has events (limit-1 probe)."""
    return not prices.select(date).join(daily.select(date), date, "left_semi").isEmpty()


def join_calendar(prices: DataFrame, daily: DataFrame, date: str = "date",
                  check: bool = False) -> DataFrame:
    """FEA-02: left join of the trading calendar with daily events, NULL -> 0.

    The daily table has one row per calendar day (bounded by the time span),
    so it is broadcast. ``check=True`` raises when no date overlaps.
    """
    if check and not date_overlap_exists(prices, daily, date):
        raise ValueError("no date overlap between prices and events")
    d = daily.drop("num_articles")
    out = prices.join(F.broadcast(d), date, "left")
    return out.fillna(0, subset=[c for c in DAILY_FILL if c in d.columns])


def pct_rank(df: DataFrame, col: str, by: str | None = "symbol", out: str | None = None) -> DataFrame:
    """FEA-05: pandas ``rank(pct=True)`` (average method); NULL stays NULL.

    pct = (min rank + (ties - 1) / 2) / (non-NULL count).
    """
    out = out or f"{col}_rank"
    part = [by] if by else []
    # one window spec (one sort per symbol): ties are the peers of the
    # current value (range frame 0..0), n the non-NULL values of the symbol
    w = Window.partitionBy(*part).orderBy(F.col(col).asc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(0, 0))
    n = F.count(col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    val = (F.rank().over(w) + (ties - 1) / 2.0) / n
    return df.withColumn(out, F.when(F.col(col).isNotNull(), val))


def event_features(df: DataFrame, by: str = "symbol", date: str = "date", ranked: bool = False) -> DataFrame:
    """FEA-03 (+FEA-04 lags, FEA-05 vol rank): rolling event windows, momentum,
    shock and decay, interactions, regime and silence flags. ``ranked``: the rows
    bring their ``vol_rank`` (``build_dataset`` ranks them while they are narrow)."""
    given = [c for c in df.columns if c != "vol_rank"]
    if not ranked:
        df = pct_rank(df, "volatility_7d", by, "vol_rank")
    w = _w(by, date)
    df = (df.withColumn("sentiment_3d_mean", rolling(F.avg, "avg_sentiment", w, -2))
          .withColumn("goldstein_7d_mean", rolling(F.avg, "avg_goldstein", w, -6))
          .withColumn("event_count_7d_sum", rolling(F.sum, "event_count", w, -6))
          .withColumn("sentiment_momentum", F.col("avg_sentiment") - F.lag("avg_sentiment").over(w))
          .withColumn("goldstein_momentum", F.col("avg_goldstein") - F.lag("avg_goldstein").over(w))
          .withColumn("shock", (F.col("event_count") > rolling(F.avg, "event_count", w, -6) * 2)
                      .cast("int")))
    df = (df.withColumn("shock_decay", rolling(F.max, "shock", w, -2))
          .withColumn("impact_score", F.col("avg_goldstein") * F.col("event_count"))
          .withColumn("sentiment_pressure", F.col("avg_sentiment") * F.col("event_count"))
          .withColumn("goldstein_abs", F.abs("avg_goldstein"))
          .withColumn("bear_regime", F.coalesce(F.col("return_7d") < 0, F.lit(False)).cast("int"))
          .withColumn("market_regime", F.coalesce(F.col("return_7d") > 0, F.lit(False)).cast("int"))
          .withColumn("event_bear_interaction", F.col("avg_sentiment") * F.col("bear_regime"))
          .withColumn("sentiment_x_volatility", F.col("avg_sentiment") * F.col("volatility_7d"))
          .withColumn("event_x_return", F.col("event_count") * F.col("return_1d"))
          .withColumn("no_event_flag", (F.col("event_count") == 0).cast("int")))
    made = [c for c in df.columns if c not in given and c not in ("vol_rank", "event_x_return", "no_event_flag")]
    df = df.select(*given, *made, "vol_rank", "event_x_return", "no_event_flag")
    return lag_features(df, by=by, date=date)


def lag_features(df: DataFrame, sources: Sequence[tuple[str, str]] = LAG_SOURCES,
                 lags: Iterable[int] = LAGS, by: str = "symbol", date: str = "date") -> DataFrame:
    """FEA-04: ``{name}_lag_{k}`` = lag k of the source column, NULL -> 0."""
    w = _w(by, date)
    cols = [F.coalesce(F.lag(src, k).over(w).cast("double"), F.lit(0.0)).alias(f"{name}_lag_{k}")
            for k in lags for name, src in sources if src in df.columns]
    return df.select("*", *cols)


def label_breakout(df: DataFrame, by: str = "symbol", date: str = "date",
                   close: str = "close", no_leak: bool = False) -> DataFrame:
    """FEA-06: next log return, z-scored by the 30-row window (min 5 values)
    that ends one row back; early rows fall back to the series mean/std
    (``no_leak=True``: expanding mean/std of earlier rows instead); std 0 ->
    1e-8; ``target = |z| > 1``; rows without a next return are dropped."""
    w = _w(by, date)
    df = df.withColumn("future_return", F.log(F.lead(close).over(w) / F.col(close)))
    frame = w.rowsBetween(-30, -1)
    enough = F.count("future_return").over(frame) >= 5
    rm = F.when(enough, F.avg("future_return").over(frame))
    rs = F.when(enough, F.stddev_samp("future_return").over(frame))
    if no_leak:
        past = w.rowsBetween(Window.unboundedPreceding, -1)
        fm, fs = F.avg("future_return").over(past), F.stddev_samp("future_return").over(past)
    else:
        whole = Window.partitionBy(by)
        fm, fs = F.avg("future_return").over(whole), F.stddev_samp("future_return").over(whole)
    df = df.withColumn("_rm", F.coalesce(rm, fm)).withColumn("_rs", F.coalesce(rs, fs))
    df = df.withColumn("_rs", F.when(F.col("_rs") == 0, F.lit(1e-8)).otherwise(F.col("_rs")))
    z = (F.col("future_return") - F.col("_rm")) / F.col("_rs")
    df = (df.withColumn("z_future_return", z)
          .withColumn("target", F.coalesce(F.abs(z) > 1.0, F.lit(False)).cast("int"))
          .drop("_rm", "_rs")
          .where(F.col("future_return").isNotNull()))
    return df.drop("z_future_return") if no_leak else df


def feature_columns(df: DataFrame) -> list[str]:
    num = {"double", "float", "int", "bigint", "smallint", "tinyint"}
    return [f.name for f in df.schema.fields
            if f.name not in NON_FEATURES and f.dataType.simpleString() in num]


def null_audit(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """FEA-07 part 1: NULL count per feature column, long form, one scan."""
    cols = list(cols or feature_columns(df))
    agg = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in cols])
    stack = "stack({}, {}) as (column, null_count)".format(
        len(cols), ", ".join(f"'{c}', `{c}`" for c in cols))
    return agg.selectExpr(stack)


def validate(df: DataFrame) -> DataFrame:
    """FEA-07 part 2: drop rows missing the unavoidable window features and fill
    the secondary ones with 0 (applied whenever the frame has NULL features,
    which a labelled series always has in its first rows)."""
    req = [c for c in REQUIRED_NOT_NULL if c in df.columns]
    out = df.dropna(subset=req)
    return out.fillna(0, subset=[c for c in FILL_AFTER_DROP if c in df.columns])


def class_balance(df: DataFrame, target: str = "target") -> DataFrame:
    """FEA-07 part 3: class counts and shares, imbalance flags, random baseline."""
    g = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    tot = Window.partitionBy()   # over the handful of classes only
    share = F.col("count") / F.sum("count").over(tot)
    return (g.withColumn("share", share)
            .withColumn("dominant", F.col("share") > 0.90)
            .withColumn("rare", F.col("share") < 0.05)
            .withColumn("random_baseline", 1.0 / F.count(F.lit(1)).over(tot)))


def standardize(df: DataFrame, cols: Sequence[str] | None = None,
                train_only: Column | None = None) -> DataFrame:
    """FEA-08: z-score each feature with its mean and sample std (columns with
    std 0 or NULL are left as is). The statistics are one aggregate, joined as a
    table of one row. ``train_only`` restricts the statistics to a row subset (no-leak mode)."""
    cols = list(cols or feature_columns(df))
    src = df.where(train_only) if train_only is not None else df
    stats = src.agg(*[F.avg(c).alias(f"_m_{i}") for i, c in enumerate(cols)],
                    *[F.stddev_samp(c).alias(f"_s_{i}") for i, c in enumerate(cols)])
    out = []
    for f in df.columns:
        if f in cols:
            i = cols.index(f)
            m, s = F.col(f"_m_{i}"), F.col(f"_s_{i}")
            out.append(F.when(s > 0, (F.col(f) - m) / s).otherwise(F.col(f).cast("double")).alias(f))
        else:
            out.append(F.col(f))
    return df.crossJoin(F.broadcast(stats)).select(*out)  # stats is one row


def temporal_split(df: DataFrame, q: float = 0.8, date: str = "date") -> DataFrame:
    """FEA-08: split at the exact (linear) ``q`` quantile of the dates:
    ``train`` strictly before it, ``test`` on or after. Train and test dates are
    disjoint by construction."""
    secs = F.unix_micros(F.col(date).cast("timestamp")).cast("double")
    cut = df.select(F.percentile(secs, q).alias("c")).scalar()
    return df.withColumn("split", F.when(secs < cut, "train").otherwise("test"))


def pool_symbols(df: DataFrame, symbols: Sequence[str], crypto: Sequence[str] = ("BTCUSDT", "ETHUSDT"),
                 by: str = "symbol", date: str = "date") -> DataFrame:
    """FEA-12: keep dates shared by at least two symbols, add ``is_crypto`` and
    one-hot ``symbol_<name>`` columns for the given symbol list."""
    multi = (df.groupBy(date).agg(F.countDistinct(by).alias("_n")).where(F.col("_n") >= 2)
             .select(date))
    out = df.join(multi, date, "left_semi")
    out = out.withColumn("is_crypto", F.col(by).isin(list(crypto)).cast("int"))
    onehot = [(F.col(by) == s).cast("int").alias(f"symbol_{s}") for s in symbols]
    return out.select(*[c for c in out.columns if c != by], *onehot)


def edge_signals(df: DataFrame, by: str = "symbol", date: str = "date") -> DataFrame:
    """FEA-13: momentum sign, event spike vs the full 7-row mean, volatility
    spike vs the full 14-row mean (per symbol)."""
    w = _w(by, date)
    return (df.withColumn("sentiment_trend", F.signum("sentiment_momentum"))
            .withColumn("event_spike", F.coalesce(
                F.col("event_count") > full_rolling(F.avg, "event_count", w, 7), F.lit(False)).cast("int"))
            .withColumn("volatility_spike", F.coalesce(
                F.col("volatility_7d") > full_rolling(F.avg, "volatility_7d", w, 14), F.lit(False)).cast("int")))


#: Rows of a part of the labelled dataset: a task sorts so many at a time, whatever the table's size.
DATASET_PART_ROWS = 200_000


def build_dataset(prices: DataFrame, events: DataFrame, by: str = "symbol",
                  date: str = "date", rows: int | None = None) -> DataFrame:
    """Dataset build (section 3.2 entry B) for all symbols at once: high-impact
    filter -> daily events -> calendar join -> market + event features ->
    breakout label. The symbols are dealt to parts of about ``DATASET_PART_ROWS``
    of at most ``rows`` prices (None: counted). What needs the prices alone, the
    rank with its sort of its own included, comes before the calendar join, so
    that no wide row is sorted but in the order of dates."""
    rows = prices.count() if rows is None else rows
    parts = max(prices.sparkSession.sparkContext.defaultParallelism, -(-rows // DATASET_PART_ROWS))
    given = [c for c in prices.columns if c != date]
    df = market_features(prices.repartition(parts, by), by, date)
    df = pct_rank(df, "volatility_7d", by, "vol_rank")
    market = [c for c in df.columns if c not in (date, *given, "vol_rank")]
    daily = daily_events(filter_high_impact(events))
    df = join_calendar(df, daily, date)
    df = df.select(date, *given, *[c for c in df.columns if c not in (date, *given, *market, "vol_rank")], *market, "vol_rank")
    df = event_features(df, by, date, ranked=True)
    return label_breakout(df, by, date)


# ---------------------------------------------------------------------------
# FEA-09 online feature row
# ---------------------------------------------------------------------------

def latest_features(prices: DataFrame, events: DataFrame, impacts: DataFrame, as_of,
                    price_rows: int = 30, event_days: int = 14) -> DataFrame:
    """FEA-09: one feature row per asset at ``as_of``: the last 30 bars ->
    daily last close -> 1/7-day log returns, 7-row volatility, 14-row MA
    (gaps 0); impacts of events published in the last 14 days on a dense
    14-day calendar -> count, mean strength, momentum and its sign, spike vs
    the 7-day mean, max |goldstein|, lags of max |strength|; interactions.
    (The reference re-indexes date objects with timestamps, which zeroes the
    event block; the dense calendar join here is the evident intent.)"""
    from eventlens.functions.common import ts_lit
    w = Window.partitionBy("asset_id").orderBy(F.col("ts").desc())
    last = prices.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= price_rows)
    daily = last.groupBy("asset_id", F.to_date("ts").alias("date")).agg(F.max_by("close", "ts").alias("close"))
    wd = Window.partitionBy("asset_id").orderBy("date")
    c = F.col("close")
    m = (daily.withColumn("return_7d", F.coalesce(F.log(c / F.lag("close", 7).over(wd)), F.lit(0.0)))
         .withColumn("return_1d", F.coalesce(F.log(c / F.lag("close", 1).over(wd)), F.lit(0.0)))
         .withColumn("_pct", c / F.lag("close", 1).over(wd) - 1))
    m = (m.withColumn("volatility_7d", F.coalesce(rolling(F.stddev_samp, "_pct", wd, -6), F.lit(0.0)))
         .withColumn("ma_14", F.coalesce(rolling(F.avg, "close", wd, -13), F.lit(0.0))))
    market = (m.groupBy("asset_id").agg(F.max_by(F.struct("return_7d", "return_1d", "volatility_7d", "ma_14"),
                                                 "date").alias("_m"))
              .select("asset_id", "_m.*"))
    now = ts_lit(as_of)
    since = now - F.make_dt_interval(F.lit(event_days))
    ev = events.where(F.col("published_at") >= since).select("event_id", "published_at", "goldstein")
    rows = (impacts.select("event_id", "asset_id", "impact_strength").join(ev, "event_id")
            .select("asset_id", F.to_date("published_at").alias("date"),
                    F.coalesce(F.when(F.col("impact_strength") != 0, F.col("impact_strength")), F.lit(0.0)).alias("s"),
                    F.coalesce(F.when(F.col("goldstein") != 0, F.col("goldstein")), F.lit(0.0)).alias("g")))
    dly = rows.groupBy("asset_id", "date").agg(F.count("s").alias("event_count"), F.avg("s").alias("avg_sentiment"),
                                               F.max(F.abs("g")).alias("max_abs_goldstein"),
                                               F.max(F.abs("s")).alias("max_abs_sentiment"))
    cal = (dly.select("asset_id").distinct()
           .select("asset_id", F.explode(F.sequence(F.date_sub(F.to_date(now), event_days - 1), F.to_date(now)))
                   .alias("date")))
    d = cal.join(dly, ["asset_id", "date"], "left").fillna(0, subset=["event_count", "avg_sentiment",
                                                                      "max_abs_goldstein", "max_abs_sentiment"])
    d = (d.withColumn("sentiment_momentum", F.coalesce(F.col("avg_sentiment") - F.lag("avg_sentiment").over(wd),
                                                       F.lit(0.0)))
         .withColumn("sentiment_trend", F.signum("sentiment_momentum"))
         .withColumn("event_spike", (F.col("event_count") > rolling(F.avg, "event_count", wd, -6)).cast("int"))
         .withColumn("max_sent_lag_1", F.coalesce(F.lag("max_abs_sentiment", 1).over(wd), F.lit(0.0)))
         .withColumn("max_sent_lag_2", F.coalesce(F.lag("max_abs_sentiment", 2).over(wd), F.lit(0.0))))
    evf = (d.where(F.col("date") == F.to_date(now))
           .select("asset_id", F.col("event_count").cast("long").alias("event_count"), "event_spike",
                   "sentiment_trend", "max_abs_goldstein", "max_sent_lag_1", "max_sent_lag_2", "sentiment_momentum"))
    out = market.join(evf, "asset_id", "left").fillna(0, subset=[
        "event_count", "event_spike", "sentiment_trend", "max_abs_goldstein", "max_sent_lag_1", "max_sent_lag_2",
        "sentiment_momentum"])
    return (out.withColumn("sentiment_x_volatility", F.col("sentiment_momentum") * F.col("volatility_7d"))
            .withColumn("event_x_return", F.col("event_count") * F.col("return_1d"))
            .withColumn("vol_rank", F.lit(0.5)).withColumn("ts", now))


# ---------------------------------------------------------------------------
# FEA-10 / FEA-11 candle features, FEA-14 alignment
# ---------------------------------------------------------------------------

CANDLE_FEATURES = ["ret_1", "ret_3", "ret_6", "ret_24", "vol_6", "vol_24", "range_pct", "body_pct",
                   "volume_z24", "num_trades_log", "taker_buy_ratio", "hour_sin", "hour_cos", "dow_sin", "dow_cos"]
CANDLE_LABEL_THRESHOLD = 0.0010


def candle_features(klines: DataFrame, by: str = "symbol", t: str = "open_time") -> DataFrame:
    """FEA-10: candle features per symbol (``open_time`` a timestamp): returns
    over 1/3/6/24 bars (infinite from a close of 0, NaN from 0 to 0; volatility
    over one is NaN), volatility of 1-bar returns over 6/24 full windows,
    range and body, 24-bar volume z-score (full window, std 0 -> NULL),
    log1p trades, taker ratio clipped to 0..1, hour and weekday on the circle."""
    import math
    w = Window.partitionBy(by).orderBy(t)
    c = F.col("close")
    nz = lambda x: F.when(x != 0, x)
    df = klines.select("*", *[(ieee_ratio(c, F.lag("close", k).over(w)) - 1).alias(f"ret_{k}") for k in (1, 3, 6, 24)])
    df = (df.withColumn("vol_6", full_rolling(F.stddev_samp, "ret_1", w, 6))
          .withColumn("vol_24", full_rolling(F.stddev_samp, "ret_1", w, 24))
          .withColumn("range_pct", (F.col("high") - F.col("low")) / nz(c))
          .withColumn("body_pct", (c - F.col("open")) / nz(F.col("open")))
          .withColumn("volume_z24", (F.col("volume") - full_rolling(F.avg, "volume", w, 24))
                      / nz(full_rolling(F.stddev_samp, "volume", w, 24)))
          .withColumn("num_trades_log", F.log1p(F.greatest(F.col("num_trades").cast("double"), F.lit(0.0))))
          .withColumn("taker_buy_ratio", F.greatest(F.lit(0.0), F.least(F.lit(1.0),
                                                                        F.col("taker_buy_volume") / nz(F.col("volume"))))))
    h = F.hour(t).cast("double")
    d = F.weekday(t).cast("double")
    return (df.withColumn("hour_sin", F.sin(2 * math.pi * h / 24.0)).withColumn("hour_cos", F.cos(2 * math.pi * h / 24.0))
            .withColumn("dow_sin", F.sin(2 * math.pi * d / 7.0)).withColumn("dow_cos", F.cos(2 * math.pi * d / 7.0)))


def candle_training(klines: DataFrame, threshold: float = CANDLE_LABEL_THRESHOLD, by: str = "symbol",
                    t: str = "open_time") -> DataFrame:
    """FEA-11: next-bar return label up/down/flat at +-threshold; rows with any
    missing (NULL) feature or no next bar are dropped; NaN is kept."""
    w = Window.partitionBy(by).orderBy(t)
    df = candle_features(klines, by, t).withColumn("future_ret_1h", ieee_ratio(F.lead("close").over(w), F.col("close")) - 1.0)
    df = df.withColumn("label", F.when(F.col("future_ret_1h") > threshold, "up")
                       .when(F.col("future_ret_1h") < -threshold, "down").otherwise("flat"))
    return complete_rows(df, CANDLE_FEATURES + ["future_ret_1h"])


def candle_latest(klines: DataFrame, by: str = "symbol", t: str = "open_time", min_bars: int = 48) -> DataFrame:
    """FEA-11: the latest complete feature row per symbol (symbols with at
    least ``min_bars`` bars); latest-per-symbol is a max_by aggregate."""
    f = complete_rows(candle_features(klines, by, t), CANDLE_FEATURES)
    enough = klines.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_bars).select(by)
    return (f.join(enough, by, "left_semi").groupBy(by)
            .agg(F.max_by(F.struct(t, *CANDLE_FEATURES), t).alias("_r")).select(by, "_r.*"))


def align_features(df: DataFrame, order: Sequence[str], vol_col: str = "7d_vol", max_abs_vol: float = 5.0) -> DataFrame:
    """FEA-14: columns in the saved training order, missing ones as 0, NULLs
    as 0; rows whose |vol| exceeds 5 are rejected."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if c in df.columns
            else F.lit(0.0).alias(c) for c in order]
    out = df.select(*cols)
    if vol_col in order:
        out = out.where(F.abs(F.col(f"`{vol_col}`")) <= max_abs_vol)
    return out
