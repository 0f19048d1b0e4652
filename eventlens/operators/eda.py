"""Exploratory statistics over the labelled daily frame (EDA-01..05).

All statistics are grouped by symbol and computed in single aggregates
(``corr``/``avg``/``stddev_samp`` are partial aggregates, so a hot symbol
does not land in one task).
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.features import full_rolling, rolling

# Lag-correlation features and lags, minimum valid pairs
LAG_CORR_FEATURES = ["avg_sentiment", "avg_goldstein", "event_count"]
LAG_CORR_LAGS = [0, 1, 2, 3, 5, 7]
LAG_CORR_MIN_PAIRS = 10
# Correlation-matrix columns (lags appended)
CORR_COLUMNS = ["event_count", "avg_sentiment", "avg_goldstein", "returns", "goldstein_abs",
                "market_regime", "sentiment_x_volatility", "event_x_return"]
EDA_LAGS = [1, 2, 3]


def eda_frame(prices: DataFrame, daily: DataFrame, by: str = "symbol", date: str = "date",
              close: str = "close") -> DataFrame:
    """EDA-05: daily log returns joined with daily events (NULL -> 0), full
    7-row return sum and std, interactions and lags; rows without a full
    window are dropped."""
    w = Window.partitionBy(by).orderBy(date)
    d = daily.select(date, "event_count", "avg_sentiment", "avg_goldstein")
    df = (prices.withColumn("returns", F.log(F.col(close) / F.lag(close).over(w)))
          .join(F.broadcast(d), date, "left")
          .fillna(0, subset=["event_count", "avg_sentiment", "avg_goldstein"]))
    df = (df.withColumn("return_7d", full_rolling(F.sum, "returns", w, 7))
          .withColumn("volatility_7d", full_rolling(F.stddev_samp, "returns", w, 7))
          .withColumn("goldstein_abs", F.abs("avg_goldstein"))
          .withColumn("market_regime", F.coalesce(F.col("return_7d") > 0, F.lit(False)).cast("int")))
    df = (df.withColumn("sentiment_x_volatility", F.col("avg_sentiment") * F.col("volatility_7d"))
          .withColumn("event_x_return", F.col("event_count") * F.col("returns")))
    lags = [F.coalesce(F.lag(src, k).over(w).cast("double"), F.lit(0.0)).alias(f"{name}_lag_{k}")
            for k in EDA_LAGS for name, src in (("sentiment", "avg_sentiment"),
                                                 ("goldstein", "avg_goldstein"))]
    return df.select("*", *lags).dropna(subset=["returns", "return_7d", "volatility_7d"])


def lag_correlation(df: DataFrame, features: Sequence[str] = LAG_CORR_FEATURES,
                    lags: Sequence[int] = LAG_CORR_LAGS, by: str = "symbol",
                    date: str = "date", target: str = "returns") -> DataFrame:
    """EDA-01: corr(feature shifted by lag, returns) per symbol, kept when at
    least 10 complete pairs exist and the value is defined."""
    w = Window.partitionBy(by).orderBy(date)
    shifted = df.select(by, target, *[F.lag(f, k).over(w).cast("double").alias(f"{f}__{k}")
                                      for f in features for k in lags])
    aggs = []
    for f in features:
        for k in lags:
            c = f"{f}__{k}"
            both = F.col(c).isNotNull() & F.col(target).isNotNull()
            aggs += [F.count(F.when(both, 1)).alias(f"n__{c}"), F.corr(c, target).alias(f"r__{c}")]
    g = shifted.groupBy(by).agg(*aggs)
    stack = "stack({}, {}) as (feature, lag, n, corr)".format(
        len(features) * len(lags),
        ", ".join(f"'{f}', {k}, `n__{f}__{k}`, `r__{f}__{k}`" for f in features for k in lags))
    out = g.selectExpr(by, stack)
    return out.where((F.col("n") >= LAG_CORR_MIN_PAIRS) & F.col("corr").isNotNull()
                     & ~F.isnan("corr"))


def shock_stats(df: DataFrame, by: str = "symbol", date: str = "date",
                target: str = "returns") -> DataFrame:
    """EDA-02: shock = count > 2x its 7-row mean (min 1 row); days, mean and
    sample std of returns for shock and normal days."""
    w = Window.partitionBy(by).orderBy(date)
    s = df.withColumn("shock", (F.col("event_count") > rolling(F.avg, "event_count", w, -6) * 2)
                      .cast("int"))
    return (s.groupBy(by, "shock")
            .agg(F.count(F.lit(1)).alias("days"), F.avg(target).alias("mean_return"),
                 F.stddev_samp(target).alias("std_return")))


def regime_stats(df: DataFrame, by: str = "symbol", target: str = "returns") -> DataFrame:
    """EDA-03: returns by sentiment regime (sign of mean sentiment; NULL is Neutral)."""
    sg = F.signum("avg_sentiment")
    regime = F.when(sg > 0, "Positive").when(sg < 0, "Negative").otherwise("Neutral")
    return (df.groupBy(by, regime.alias("sentiment_regime"))
            .agg(F.avg(target).alias("mean"), F.stddev_samp(target).alias("std"),
                 F.count(target).alias("count")))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, by: str = "symbol") -> DataFrame:
    """EDA-04: pairwise-complete correlation of every column pair, long form
    (symbol, a, b, corr), both orders and the diagonal."""
    if cols is None:
        cols = CORR_COLUMNS + [f"{n}_lag_{k}" for k in EDA_LAGS for n in ("sentiment", "goldstein")]
    cols = [c for c in cols if c in df.columns]
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    g = df.groupBy(by).agg(*[F.corr(F.col(cols[i]).cast("double"), F.col(cols[j]).cast("double"))
                             .alias(f"c_{i}_{j}") for i, j in pairs])
    entries = []
    for i, j in pairs:
        entries.append(f"'{cols[i]}', '{cols[j]}', `c_{i}_{j}`")
        if i != j:
            entries.append(f"'{cols[j]}', '{cols[i]}', `c_{i}_{j}`")
    return g.selectExpr(by, "stack({}, {}) as (a, b, corr)".format(len(entries), ", ".join(entries)))
