"""Registered queries: daily events, window features, labels, EDA."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import eda as D
from eventlens.operators import features as X
from eventlens.operators import market as M
from eventlens.plans.base import plan

# ---------------------------------------------------------------------------
# Spark inputs
# ---------------------------------------------------------------------------


def _prices(t):
    return t.bar.select(F.col("asset_id").alias("symbol"), F.to_date("ts").alias("date"), "close")


def _daily(t, high_impact=True):
    ev = X.filter_high_impact(t.event) if high_impact else t.event
    return X.daily_events(ev)


def _calendar(t):
    return X.join_calendar(_prices(t), _daily(t))


def _featured(t):
    df = X.market_features(_calendar(t))
    return X.event_features(df)


def _labelled(t):
    # No more prices than line items, whose number stands in the files' footers.
    return X.build_dataset(_prices(t), t.event, rows=t.row_count("lineitem"))


def _eda(t):
    return D.eda_frame(_prices(t), _daily(t, high_impact=False))


# ---------------------------------------------------------------------------
# DuckDB oracle chain (independent SQL over the fixture CTEs)
# ---------------------------------------------------------------------------

_DAILY = """
    SELECT date, event_count, avg_sentiment, avg_goldstein, max_abs_goldstein, max_abs_sentiment,
           min_sentiment, max_sentiment, num_articles,
           CAST(coalesce(event_count - lag(event_count) OVER (ORDER BY date), 0) AS DOUBLE) AS event_count_change
    FROM (SELECT CAST(published_at AS DATE) AS date, count(sentiment) AS event_count,
                 avg(sentiment) AS avg_sentiment, avg(goldstein) AS avg_goldstein,
                 max(abs(goldstein)) AS max_abs_goldstein, max(abs(sentiment)) AS max_abs_sentiment,
                 min(sentiment) AS min_sentiment, max(sentiment) AS max_sentiment,
                 CAST(sum(coalesce(num_articles, 0)) AS BIGINT) AS num_articles
          FROM f_event WHERE published_at IS NOT NULL {where} GROUP BY 1)"""
_HI = "AND (coalesce(num_articles, 0) >= 5 OR abs(goldstein) >= 1.5)"

CHAIN = {
    "o_daily_all": _DAILY.format(where=""),
    "o_daily": _DAILY.format(where=_HI),
    "o_prices": "SELECT asset_id AS symbol, CAST(ts AS DATE) AS date, close FROM f_bar",
    "o_cal": """
        SELECT p.symbol, p.date, p.close,
               coalesce(d.event_count, 0) AS event_count, coalesce(d.avg_sentiment, 0) AS avg_sentiment,
               coalesce(d.avg_goldstein, 0) AS avg_goldstein,
               coalesce(d.max_abs_goldstein, 0) AS max_abs_goldstein,
               coalesce(d.max_abs_sentiment, 0) AS max_abs_sentiment,
               coalesce(d.min_sentiment, 0) AS min_sentiment, coalesce(d.max_sentiment, 0) AS max_sentiment,
               coalesce(d.event_count_change, 0) AS event_count_change
        FROM o_prices p LEFT JOIN o_daily d ON p.date = d.date""",
    "o_mf0": """
        SELECT *, ln(close / lag(close, 1) OVER w) AS return_1d, ln(close / lag(close, 3) OVER w) AS return_3d,
               ln(close / lag(close, 7) OVER w) AS return_7d, close / lag(close, 1) OVER w - 1 AS _pct
        FROM o_cal WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "o_mf": """
        SELECT * EXCLUDE (_pct),
               stddev_samp(_pct) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS volatility_7d,
               avg(close) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma_7,
               avg(close) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ma_14,
               avg(close) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)
                 / avg(close) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS ma_ratio,
               CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month
        FROM o_mf0 WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "o_ef0": """
        SELECT *,
               avg(avg_sentiment) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS sentiment_3d_mean,
               avg(avg_goldstein) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS goldstein_7d_mean,
               sum(event_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS event_count_7d_sum,
               avg_sentiment - lag(avg_sentiment) OVER w AS sentiment_momentum,
               avg_goldstein - lag(avg_goldstein) OVER w AS goldstein_momentum,
               CAST(event_count > avg(event_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 2
                    AS INTEGER) AS shock
        FROM o_mf WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "o_ef1": """
        SELECT *,
               max(shock) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS shock_decay,
               avg_goldstein * event_count AS impact_score,
               avg_sentiment * event_count AS sentiment_pressure,
               abs(avg_goldstein) AS goldstein_abs,
               CAST(coalesce(return_7d < 0, false) AS INTEGER) AS bear_regime,
               CAST(coalesce(return_7d > 0, false) AS INTEGER) AS market_regime,
               avg_sentiment * CAST(coalesce(return_7d < 0, false) AS INTEGER) AS event_bear_interaction,
               avg_sentiment * volatility_7d AS sentiment_x_volatility,
               CASE WHEN volatility_7d IS NOT NULL THEN
                 (rank() OVER (PARTITION BY symbol ORDER BY volatility_7d ASC NULLS LAST)
                  + (count(*) OVER (PARTITION BY symbol, volatility_7d) - 1) / 2.0)
                 / count(volatility_7d) OVER (PARTITION BY symbol) END AS vol_rank,
               event_count * return_1d AS event_x_return,
               CAST(event_count = 0 AS INTEGER) AS no_event_flag
        FROM o_ef0 WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "o_ef": """
        SELECT *,
               coalesce(lag(avg_sentiment, 1) OVER w, 0) AS sentiment_lag_1,
               coalesce(lag(avg_goldstein, 1) OVER w, 0) AS goldstein_lag_1,
               CAST(coalesce(lag(event_count, 1) OVER w, 0) AS DOUBLE) AS event_count_lag_1,
               CAST(coalesce(lag(shock, 1) OVER w, 0) AS DOUBLE) AS spike_lag_1,
               coalesce(lag(max_abs_goldstein, 1) OVER w, 0) AS max_gold_lag_1,
               coalesce(lag(max_abs_sentiment, 1) OVER w, 0) AS max_sent_lag_1,
               coalesce(lag(avg_sentiment, 2) OVER w, 0) AS sentiment_lag_2,
               coalesce(lag(avg_goldstein, 2) OVER w, 0) AS goldstein_lag_2,
               CAST(coalesce(lag(event_count, 2) OVER w, 0) AS DOUBLE) AS event_count_lag_2,
               CAST(coalesce(lag(shock, 2) OVER w, 0) AS DOUBLE) AS spike_lag_2,
               coalesce(lag(max_abs_goldstein, 2) OVER w, 0) AS max_gold_lag_2,
               coalesce(lag(max_abs_sentiment, 2) OVER w, 0) AS max_sent_lag_2,
               coalesce(lag(avg_sentiment, 3) OVER w, 0) AS sentiment_lag_3,
               coalesce(lag(avg_goldstein, 3) OVER w, 0) AS goldstein_lag_3,
               CAST(coalesce(lag(event_count, 3) OVER w, 0) AS DOUBLE) AS event_count_lag_3,
               CAST(coalesce(lag(shock, 3) OVER w, 0) AS DOUBLE) AS spike_lag_3,
               coalesce(lag(max_abs_goldstein, 3) OVER w, 0) AS max_gold_lag_3,
               coalesce(lag(max_abs_sentiment, 3) OVER w, 0) AS max_sent_lag_3
        FROM o_ef1 WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "o_lb0": """
        SELECT *, ln(lead(close) OVER (PARTITION BY symbol ORDER BY date) / close) AS future_return FROM o_ef""",
    "o_lb1": """
        SELECT *,
               coalesce(CASE WHEN count(future_return) OVER r >= 5 THEN avg(future_return) OVER r END,
                        avg(future_return) OVER (PARTITION BY symbol)) AS _rm,
               coalesce(CASE WHEN count(future_return) OVER r >= 5 THEN stddev_samp(future_return) OVER r END,
                        stddev_samp(future_return) OVER (PARTITION BY symbol)) AS _rs0
        FROM o_lb0 WINDOW r AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""",
    "o_label": """
        SELECT * EXCLUDE (_rm, _rs0, _rs),
               (future_return - _rm) / _rs AS z_future_return,
               CAST(coalesce(abs((future_return - _rm) / _rs) > 1.0, false) AS INTEGER) AS target
        FROM (SELECT *, CASE WHEN _rs0 = 0 THEN 1e-8 ELSE _rs0 END AS _rs FROM o_lb1)
        WHERE future_return IS NOT NULL""",
    "o_eda0": """
        SELECT p.symbol, p.date, p.close,
               ln(p.close / lag(p.close) OVER (PARTITION BY p.symbol ORDER BY p.date)) AS returns,
               coalesce(d.event_count, 0) AS event_count, coalesce(d.avg_sentiment, 0) AS avg_sentiment,
               coalesce(d.avg_goldstein, 0) AS avg_goldstein
        FROM o_prices p LEFT JOIN o_daily_all d ON p.date = d.date""",
    "o_eda1": """
        SELECT *,
               CASE WHEN count(returns) OVER s = 7 THEN sum(returns) OVER s END AS return_7d,
               CASE WHEN count(returns) OVER s = 7 THEN stddev_samp(returns) OVER s END AS volatility_7d,
               abs(avg_goldstein) AS goldstein_abs
        FROM o_eda0 WINDOW s AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "o_eda": """
        SELECT * FROM (
          SELECT *, CAST(coalesce(return_7d > 0, false) AS INTEGER) AS market_regime,
                 avg_sentiment * volatility_7d AS sentiment_x_volatility,
                 event_count * returns AS event_x_return,
                 coalesce(lag(avg_sentiment, 1) OVER w, 0) AS sentiment_lag_1,
                 coalesce(lag(avg_goldstein, 1) OVER w, 0) AS goldstein_lag_1,
                 coalesce(lag(avg_sentiment, 2) OVER w, 0) AS sentiment_lag_2,
                 coalesce(lag(avg_goldstein, 2) OVER w, 0) AS goldstein_lag_2,
                 coalesce(lag(avg_sentiment, 3) OVER w, 0) AS sentiment_lag_3,
                 coalesce(lag(avg_goldstein, 3) OVER w, 0) AS goldstein_lag_3
          FROM o_eda1 WINDOW w AS (PARTITION BY symbol ORDER BY date))
        WHERE returns IS NOT NULL AND return_7d IS NOT NULL AND volatility_7d IS NOT NULL""",
}


def fplan(name, sql):
    return plan(name, oracle=sql, extra_ctes=CHAIN)


@fplan("flt05_high_impact", "SELECT * FROM f_event WHERE coalesce(num_articles, 0) >= 5 OR abs(goldstein) >= 1.5")
def flt05(t):
    """FLT-05: high-impact events."""
    return X.filter_high_impact(t.event)


@fplan("agg07_daily_events", "SELECT * FROM o_daily_all")
def agg07(t):
    """AGG-07: daily event statistics over all derived events."""
    return _daily(t, high_impact=False)


@fplan("fea01_market_features", """
    SELECT symbol, date, close, return_1d, return_3d, return_7d, volatility_7d, ma_7, ma_14, ma_ratio,
           day_of_week, month
    FROM (SELECT * FROM o_mf0) x
    JOIN (SELECT symbol, date, volatility_7d, ma_7, ma_14, ma_ratio, day_of_week, month FROM o_mf) y
    USING (symbol, date)""")
def fea01(t):
    """FEA-01: market features on daily bars of every asset."""
    return X.market_features(_prices(t))


@fplan("fea02_join_calendar", "SELECT * FROM o_cal")
def fea02(t):
    """FEA-02: trading calendar x high-impact daily events."""
    return _calendar(t)


@fplan("fea03_event_features", "SELECT * FROM o_ef")
def fea03(t):
    """FEA-03/04/05: event features with lags and volatility rank."""
    return _featured(t)


@fplan("fea04_lag_features", """
    SELECT *, coalesce(lag(avg_sentiment, 1) OVER w, 0) AS sentiment_lag_1,
           coalesce(lag(avg_goldstein, 1) OVER w, 0) AS goldstein_lag_1,
           CAST(coalesce(lag(event_count, 1) OVER w, 0) AS DOUBLE) AS event_count_lag_1,
           coalesce(lag(avg_sentiment, 2) OVER w, 0) AS sentiment_lag_2,
           coalesce(lag(avg_goldstein, 2) OVER w, 0) AS goldstein_lag_2,
           CAST(coalesce(lag(event_count, 2) OVER w, 0) AS DOUBLE) AS event_count_lag_2,
           coalesce(lag(avg_sentiment, 3) OVER w, 0) AS sentiment_lag_3,
           coalesce(lag(avg_goldstein, 3) OVER w, 0) AS goldstein_lag_3,
           CAST(coalesce(lag(event_count, 3) OVER w, 0) AS DOUBLE) AS event_count_lag_3
    FROM o_cal WINDOW w AS (PARTITION BY symbol ORDER BY date)""")
def fea04(t):
    """FEA-04: lags 1-3 of sentiment, goldstein and count on the calendar frame."""
    return X.lag_features(_calendar(t), sources=X.LAG_SOURCES[:3])


@fplan("fea05_pct_rank", """
    SELECT symbol, date, close, volatility_7d,
           CASE WHEN volatility_7d IS NOT NULL THEN
             (rank() OVER (PARTITION BY symbol ORDER BY volatility_7d ASC NULLS LAST)
              + (count(*) OVER (PARTITION BY symbol, volatility_7d) - 1) / 2.0)
             / count(volatility_7d) OVER (PARTITION BY symbol) END AS vol_rank
    FROM o_mf""")
def fea05(t):
    """FEA-05: average-method percent rank of 7-day volatility per asset."""
    df = X.market_features(_prices(t)).select("symbol", "date", "close", "volatility_7d")
    return X.pct_rank(df, "volatility_7d", "symbol", "vol_rank")


@fplan("fea06_label_breakout", "SELECT * FROM o_label")
def fea06(t):
    """FEA-06: full labelled dataset (breakout target) for every asset."""
    return _labelled(t)


@fplan("fea07_null_audit", """
    SELECT 'return_1d' AS column, count(*) FILTER (WHERE return_1d IS NULL) AS null_count FROM o_label
    UNION ALL SELECT 'return_7d', count(*) FILTER (WHERE return_7d IS NULL) FROM o_label
    UNION ALL SELECT 'volatility_7d', count(*) FILTER (WHERE volatility_7d IS NULL) FROM o_label
    UNION ALL SELECT 'vol_rank', count(*) FILTER (WHERE vol_rank IS NULL) FROM o_label
    UNION ALL SELECT 'sentiment_momentum', count(*) FILTER (WHERE sentiment_momentum IS NULL) FROM o_label""")
def fea07a(t):
    """FEA-07: NULL audit of selected feature columns."""
    return X.null_audit(_labelled(t), ["return_1d", "return_7d", "volatility_7d", "vol_rank",
                                       "sentiment_momentum"])


@fplan("fea07_class_balance", """
    SELECT target, count, share, share > 0.90 AS dominant, share < 0.05 AS rare,
           1.0 / count(*) OVER () AS random_baseline
    FROM (SELECT target, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
          FROM o_label WHERE return_1d IS NOT NULL AND return_3d IS NOT NULL AND return_7d IS NOT NULL
            AND volatility_7d IS NOT NULL GROUP BY target)""")
def fea07b(t):
    """FEA-07: class balance after the selective NULL drop."""
    return X.class_balance(X.validate(_labelled(t)))


_SCALED = ["return_1d", "avg_sentiment", "event_count", "avg_goldstein", "volatility_7d", "sentiment_momentum", "ma_7"]


@fplan("fea08_standardize", "SELECT symbol, date, " + ", ".join(
    f"CASE WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE CAST({c} AS DOUBLE) END AS {c}"
    for c in _SCALED) + " FROM o_label")
def fea08a(t):
    """FEA-08: z-scored features (statistics over the whole labelled table)."""
    return X.standardize(_labelled(t).select("symbol", "date", *_SCALED), _SCALED)


@fplan("fea08_temporal_split", """
    SELECT symbol, date, target,
           CASE WHEN epoch_us(CAST(date AS TIMESTAMP)) < (SELECT quantile_cont(epoch_us(CAST(date AS TIMESTAMP)), 0.8)
                                                           FROM o_label) THEN 'train' ELSE 'test' END AS split
    FROM o_label""")
def fea08b(t):
    """FEA-08: temporal split at the 0.8 date quantile."""
    return X.temporal_split(_labelled(t).select("symbol", "date", "target"), 0.8)


_KLINE_DAILY = """
    SELECT symbol, CAST(open_time AS DATE) AS date, arg_max(close, open_time) AS close
    FROM f_kline GROUP BY 1, 2"""


@fplan("fea12_pool_symbols", f"""
    SELECT date, close, CAST(symbol IN ('K0', 'K1') AS INTEGER) AS is_crypto,
           CAST(symbol = 'K0' AS INTEGER) AS symbol_K0, CAST(symbol = 'K1' AS INTEGER) AS symbol_K1,
           CAST(symbol = 'K2' AS INTEGER) AS symbol_K2, CAST(symbol = 'K3' AS INTEGER) AS symbol_K3,
           CAST(symbol = 'K4' AS INTEGER) AS symbol_K4
    FROM ({_KLINE_DAILY}) k
    WHERE date IN (SELECT date FROM ({_KLINE_DAILY}) GROUP BY date HAVING count(DISTINCT symbol) >= 2)""")
def fea12(t):
    """FEA-12: pooled daily kline closes of the five kline symbols."""
    daily = M.daily_close(t.kline, by="symbol", ts="open_time", value="close")
    return X.pool_symbols(daily, ["K0", "K1", "K2", "K3", "K4"], crypto=("K0", "K1"))


@fplan("fea13_edge_signals", """
    SELECT symbol, date, sign(sentiment_momentum) AS sentiment_trend,
           CAST(coalesce(event_count > CASE WHEN count(event_count) OVER s7 = 7 THEN avg(event_count) OVER s7 END,
                         false) AS INTEGER) AS event_spike,
           CAST(coalesce(volatility_7d > CASE WHEN count(volatility_7d) OVER s14 = 14
                                              THEN avg(volatility_7d) OVER s14 END, false) AS INTEGER)
             AS volatility_spike
    FROM o_label
    WINDOW s7 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
           s14 AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)""")
def fea13(t):
    """FEA-13: momentum sign, event spike, volatility spike."""
    df = X.edge_signals(_labelled(t))
    return df.select("symbol", "date", "sentiment_trend", "event_spike", "volatility_spike")


@fplan("eda05_eda_frame", "SELECT * FROM o_eda")
def eda05(t):
    """EDA-05: EDA frame for every asset."""
    return _eda(t)


@fplan("eda01_lag_correlation", """
    SELECT * FROM (
      SELECT symbol, f.feature, f.lag, count(*) FILTER (WHERE f.x IS NOT NULL AND returns IS NOT NULL) AS n,
             corr(f.x, returns) AS corr
      FROM (SELECT symbol, returns, unnest([
              {'feature': 'avg_sentiment', 'lag': 0, 'x': CAST(avg_sentiment AS DOUBLE)},
              {'feature': 'avg_sentiment', 'lag': 1, 'x': lag(avg_sentiment, 1) OVER w},
              {'feature': 'avg_sentiment', 'lag': 2, 'x': lag(avg_sentiment, 2) OVER w},
              {'feature': 'avg_sentiment', 'lag': 3, 'x': lag(avg_sentiment, 3) OVER w},
              {'feature': 'avg_sentiment', 'lag': 5, 'x': lag(avg_sentiment, 5) OVER w},
              {'feature': 'avg_sentiment', 'lag': 7, 'x': lag(avg_sentiment, 7) OVER w},
              {'feature': 'avg_goldstein', 'lag': 0, 'x': CAST(avg_goldstein AS DOUBLE)},
              {'feature': 'avg_goldstein', 'lag': 1, 'x': lag(avg_goldstein, 1) OVER w},
              {'feature': 'avg_goldstein', 'lag': 2, 'x': lag(avg_goldstein, 2) OVER w},
              {'feature': 'avg_goldstein', 'lag': 3, 'x': lag(avg_goldstein, 3) OVER w},
              {'feature': 'avg_goldstein', 'lag': 5, 'x': lag(avg_goldstein, 5) OVER w},
              {'feature': 'avg_goldstein', 'lag': 7, 'x': lag(avg_goldstein, 7) OVER w},
              {'feature': 'event_count', 'lag': 0, 'x': CAST(event_count AS DOUBLE)},
              {'feature': 'event_count', 'lag': 1, 'x': CAST(lag(event_count, 1) OVER w AS DOUBLE)},
              {'feature': 'event_count', 'lag': 2, 'x': CAST(lag(event_count, 2) OVER w AS DOUBLE)},
              {'feature': 'event_count', 'lag': 3, 'x': CAST(lag(event_count, 3) OVER w AS DOUBLE)},
              {'feature': 'event_count', 'lag': 5, 'x': CAST(lag(event_count, 5) OVER w AS DOUBLE)},
              {'feature': 'event_count', 'lag': 7, 'x': CAST(lag(event_count, 7) OVER w AS DOUBLE)}]) AS f
            FROM o_eda WINDOW w AS (PARTITION BY symbol ORDER BY date))
      GROUP BY symbol, f.feature, f.lag)
    WHERE n >= 10 AND corr IS NOT NULL AND NOT isnan(corr)""")
def eda01(t):
    """EDA-01: lag correlations per asset."""
    return D.lag_correlation(_eda(t))


@fplan("eda02_shock_stats", """
    SELECT symbol, shock, count(*) AS days, avg(returns) AS mean_return, stddev_samp(returns) AS std_return
    FROM (SELECT *, CAST(event_count > avg(event_count) OVER (PARTITION BY symbol ORDER BY date
                         ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 2 AS INTEGER) AS shock FROM o_eda)
    GROUP BY symbol, shock""")
def eda02(t):
    """EDA-02: shock vs normal-day returns per asset."""
    return D.shock_stats(_eda(t))


@fplan("eda03_regime_stats", """
    SELECT symbol, CASE WHEN avg_sentiment > 0 THEN 'Positive' WHEN avg_sentiment < 0 THEN 'Negative'
                        ELSE 'Neutral' END AS sentiment_regime,
           avg(returns) AS mean, stddev_samp(returns) AS std, count(returns) AS count
    FROM o_eda GROUP BY 1, 2""")
def eda03(t):
    """EDA-03: returns by sentiment regime per asset."""
    return D.regime_stats(_eda(t))


@fplan("eda04_corr_matrix", """
    SELECT symbol, 'returns' AS a, 'avg_sentiment' AS b, corr(returns, avg_sentiment) AS corr FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'avg_sentiment', 'returns', corr(returns, avg_sentiment) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'returns', 'returns', corr(returns, returns) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'avg_sentiment', 'avg_sentiment', corr(avg_sentiment, avg_sentiment) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'returns', 'event_x_return', corr(returns, event_x_return) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'event_x_return', 'returns', corr(returns, event_x_return) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'event_x_return', 'event_x_return', corr(event_x_return, event_x_return) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'avg_sentiment', 'event_x_return', corr(avg_sentiment, event_x_return) FROM o_eda GROUP BY 1
    UNION ALL SELECT symbol, 'event_x_return', 'avg_sentiment', corr(avg_sentiment, event_x_return) FROM o_eda GROUP BY 1""")
def eda04(t):
    """EDA-04: correlation matrix (three columns) per asset, long form."""
    return D.corr_matrix(_eda(t), ["returns", "avg_sentiment", "event_x_return"])
