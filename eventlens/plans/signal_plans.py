"""Registered queries: signal ranking, fusion, backtest, signal filter,
chronological split and classification report over the labelled dataset."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import features as X
from eventlens.operators import signals as SG
from eventlens.plans.base import plan
from eventlens.plans.feature_plans import CHAIN, _labelled

# Model outputs are stand-in columns of the labelled dataset (the reference
# feeds outputs of models that are not part of this library).


def _scored(t):
    df = _labelled(t)
    return df.select("symbol", "date", "target", "future_return", "return_1d", "return_3d",
                     "sentiment_momentum", "volatility_7d", "market_regime", "bear_regime", "vol_rank",
                     "event_count", "z_future_return")


def splan(name, sql):
    return plan(name, oracle=sql, extra_ctes=CHAIN)


@splan("prd07_rank_signals", """
    WITH feat AS (SELECT symbol AS asset_id, arg_max(CAST(date AS TIMESTAMP), date) AS ts,
                         arg_max(volatility_7d, date) AS volatility_7d, arg_max(sentiment_momentum, date) AS sm,
                         arg_max(vol_rank, date) AS p_breakout,
                         arg_max(abs(z_future_return) / (1 + abs(z_future_return)), date) AS confidence
                  FROM o_label GROUP BY 1),
         now AS (SELECT max(date)::TIMESTAMP + INTERVAL 5 MINUTE AS t FROM o_label),
         j AS (SELECT i.event_id, i.asset_id, f.p_breakout,
                      0.6 * f.p_breakout + 0.4 * least(1.0, abs(f.sm)) AS score,
                      CASE WHEN f.sm > 0 THEN 1 ELSE -1 END * f.p_breakout * abs(f.volatility_7d)
                        * least(1.0, abs(f.sm)) * 2.0 AS expected_change_pct
               FROM f_impact i JOIN feat f USING (asset_id), now
               WHERE f.ts IS NOT NULL AND (epoch_us(now.t) - epoch_us(f.ts)) / 1e6 <= 600
                 AND f.volatility_7d IS NOT NULL AND f.sm IS NOT NULL
                 AND NOT (f.p_breakout < 0.5 AND f.confidence > 0.8)),
         k AS (SELECT * FROM j QUALIFY max(score) OVER (PARTITION BY event_id) < 0.6 OR score >= 0.6)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, asset_id) AS rank FROM k)
    WHERE rank <= 3""")
def prd07(t):
    """PRD-07: top-3 signals per event from each asset's latest features."""
    d = _scored(t)
    last = (d.groupBy(F.col("symbol").alias("asset_id"))
            .agg(F.max_by(F.struct(F.col("date").cast("timestamp").alias("ts"), "volatility_7d", "sentiment_momentum",
                                   F.col("vol_rank").alias("p_breakout"),
                                   (F.abs("z_future_return") / (1 + F.abs("z_future_return"))).alias("confidence")),
                          "date").alias("_r"))
            .select("asset_id", "_r.*"))
    feats = last.select("asset_id", "ts", "volatility_7d", "sentiment_momentum")
    probs = last.select("asset_id", "p_breakout", "confidence")
    now = d.select((F.max("date").cast("timestamp") + F.expr("INTERVAL 5 MINUTES")).alias("t")).scalar()
    return SG.rank_signals(t.impact, feats, probs, now)


@splan("prd08_fuse_fixed", """
    SELECT symbol, date,
           CASE WHEN return_3d > 0.002 THEN 1.0 WHEN return_3d < -0.002 THEN -1.0 ELSE 0.0 END AS chronos_direction,
           0.4 * (return_1d * 100) + 0.3 * (coalesce(return_3d, 0.0) * 100.0)
             + 0.3 * (CASE WHEN return_1d * 100 > 0 THEN 1.0 ELSE -1.0 END * (vol_rank / 2) * vol_rank * 2.0) AS final_change_pct,
           0.4 * vol_rank + 0.3 * (vol_rank / 2) + 0.3 * coalesce(vol_rank / 3, 0.0) AS final_confidence
    FROM o_label WHERE return_1d IS NOT NULL AND vol_rank IS NOT NULL""")
def prd08(t):
    """PRD-08: fixed-weight fusion of stand-in model columns."""
    d = _scored(t).where(F.col("return_1d").isNotNull() & F.col("vol_rank").isNotNull())
    d = d.select("symbol", "date", (F.col("return_1d") * 100).alias("xgb_change_pct"),
                 F.col("vol_rank").alias("xgb_confidence"), F.col("vol_rank").alias("xgb_p_breakout"),
                 (F.col("vol_rank") / 2).alias("lstm_confidence"), F.col("return_3d").alias("chronos_delta"),
                 (F.col("vol_rank") / 3).alias("chronos_confidence"))
    return SG.fuse_fixed(d).select("symbol", "date", "chronos_direction", "final_change_pct", "final_confidence")


_REGIME_SQL = """
    WITH i AS (
      SELECT symbol, date,
             CASE WHEN market_regime = 1 THEN 'risk-on' WHEN bear_regime = 1 THEN 'risk-off' ELSE 'neutral' END AS regime,
             CASE WHEN return_1d > 0 THEN 'up' WHEN return_1d < 0 THEN 'down' ELSE 'neutral' END AS xd,
             coalesce(vol_rank, 0.5) AS xc,
             CASE WHEN sentiment_momentum > 0 THEN 'up' WHEN sentiment_momentum < 0 THEN 'down' ELSE 'neutral' END AS ld,
             coalesce(vol_rank / 2, 0.5) AS lc, 100.0 * exp(coalesce(future_return, 0.0)) AS med
      FROM o_label),
    c AS (
      SELECT *,
             greatest(-10.0, least(10.0, CASE xd WHEN 'up' THEN 3.0 * xc WHEN 'down' THEN -3.0 * xc ELSE 0.0 END)) AS xch,
             greatest(-10.0, least(10.0, CASE ld WHEN 'up' THEN 5.0 * lc WHEN 'down' THEN -5.0 * lc ELSE 0.0 END)) AS lch,
             greatest(-10.0, least(10.0, (med - 100.0) / 100.0 * 100.0)) AS cch,
             greatest(0.3, least(1.0, 1.0 - abs(101.5 - 99.0) / greatest(med, 1e-6))) AS cc
      FROM i),
    w AS (
      SELECT *,
             CASE WHEN cc < 0.05 THEN 0.0 WHEN regime = 'risk-on' THEN 0.6 WHEN regime = 'risk-off' THEN 0.3 ELSE 0.4 END AS wc,
             CASE WHEN xc < 0.05 THEN 0.0 WHEN regime = 'risk-on' THEN 0.3 WHEN regime = 'risk-off' THEN 0.1 ELSE 0.4 END AS wx,
             CASE WHEN lc < 0.05 THEN 0.0 WHEN regime = 'risk-on' THEN 0.1 WHEN regime = 'risk-off' THEN 0.6 ELSE 0.2 END AS wl
      FROM c),
    f AS (
      SELECT *, greatest(-15.0, least(15.0,
               (cch * cc * wc + xch * xc * wx + lch * lc * wl) / (cc * wc + xc * wx + lc * wl + 1e-6)
               - CASE WHEN ld = 'down' THEN 0.5 * 0.6 ELSE 0.0 END + CASE WHEN ld = 'up' THEN 0.5 * 0.6 ELSE 0.0 END))
               AS ch,
             abs(sign(cch) + sign(xch) + sign(lch)) / 3.0 AS agree
      FROM w)
    SELECT symbol, date, ch AS final_change_pct,
           CASE WHEN ch > 0.5 THEN 'up' WHEN ch < -0.5 THEN 'down' ELSE 'neutral' END AS final_direction,
           (cc + xc + lc) / 3.0 * agree AS final_confidence, ch - lc * 4.0 AS expected_min_pct,
           ch + lc * 4.0 AS expected_max_pct
    FROM f"""


@splan("prd09_fuse_regime", _REGIME_SQL)
def prd09(t):
    """PRD-09: regime-weighted fusion of stand-in model columns."""
    d = _scored(t)
    sgn = lambda c: F.when(F.col(c) > 0, "up").when(F.col(c) < 0, "down").otherwise("neutral")
    d = d.select("symbol", "date",
                 F.when(F.col("market_regime") == 1, "risk-on").when(F.col("bear_regime") == 1, "risk-off")
                 .otherwise("neutral").alias("regime"),
                 sgn("return_1d").alias("xgb_direction"), F.col("vol_rank").alias("xgb_confidence"),
                 sgn("sentiment_momentum").alias("lstm_direction"), (F.col("vol_rank") / 2).alias("lstm_confidence"),
                 F.lit(100.0).alias("last_price"), (100.0 * F.exp(F.coalesce("future_return", F.lit(0.0)))).alias("chronos_median"),
                 F.lit(99.0).alias("chronos_q10"), F.lit(101.5).alias("chronos_q90"),
                 sgn("sentiment_momentum").alias("sent_direction"), F.lit(0.6).alias("sent_confidence"))
    return SG.fuse_regime(d).select("symbol", "date", "final_change_pct", "final_direction", "final_confidence",
                                    "expected_min_pct", "expected_max_pct")


@splan("prd10_backtest", """
    SELECT count(*) AS total_tested, count(*) FILTER (WHERE vol_rank >= 0.6) AS predictions_fired,
           count(*) FILTER (WHERE vol_rank >= 0.6 AND
             CASE WHEN sentiment_momentum > 0 THEN 1 ELSE -1 END =
             CASE WHEN abs(future_return) < 0.005 THEN 0 WHEN future_return > 0 THEN 1 ELSE -1 END) AS correct_direction,
           count(*) FILTER (WHERE vol_rank >= 0.6 AND
             CASE WHEN sentiment_momentum > 0 THEN 1 ELSE -1 END =
             CASE WHEN abs(future_return) < 0.005 THEN 0 WHEN future_return > 0 THEN 1 ELSE -1 END)
             / greatest(count(*) FILTER (WHERE vol_rank >= 0.6), 1) * 100.0 AS directional_accuracy_pct
    FROM o_label""")
def prd10(t):
    """PRD-10: backtest of momentum-sign predictions at confidence >= 0.6."""
    d = _scored(t).select(F.col("sentiment_momentum").alias("prediction"), F.col("vol_rank").alias("confidence"),
                          "future_return")
    return SG.backtest(d)


@splan("prd11_filter_signals", """
    WITH s AS (SELECT symbol * 1000000 + (CAST(date AS DATE) - DATE '1990-01-01') AS row_id, vol_rank AS prob, target,
                      CAST(coalesce(event_count > CASE WHEN count(event_count) OVER w = 7 THEN avg(event_count) OVER w END,
                                    false) AS INTEGER) AS event_spike
               FROM o_label WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
         top AS (SELECT row_id FROM s WHERE prob > 0.6 ORDER BY prob DESC, row_id DESC LIMIT 60),
         f AS (SELECT s.*, coalesce(s.row_id IN (SELECT row_id FROM top), false) AND event_spike = 1 AS sig FROM s)
    SELECT avg(CAST(sig AS DOUBLE)) AS coverage, count(*) FILTER (WHERE sig) AS trades,
           avg(CASE WHEN sig THEN CAST(target = 1 AS DOUBLE) END) AS precision,
           (SELECT avg(CAST(target = 1 AS DOUBLE)) FROM (SELECT * FROM f WHERE sig
              ORDER BY greatest(prob, 1 - prob) DESC, row_id DESC LIMIT 10)) AS top10_accuracy
    FROM f""")
def prd11(t):
    """PRD-11: probability/top-60/event-spike signal filter metrics."""
    d = X.edge_signals(_labelled(t))
    d = d.select((F.col("symbol") * 1000000 + F.datediff("date", F.lit("1990-01-01").cast("date"))).alias("row_id"),
                 F.col("vol_rank").alias("prob"), "target", "event_spike")
    return SG.filter_signals(d)


@splan("prd12_chrono_split", """
    SELECT symbol, date, row_index,
           CASE WHEN row_index < floor(n * 0.8) THEN 'train'
                WHEN row_index < floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT symbol, date, row_number() OVER (ORDER BY date, symbol) - 1 AS row_index,
                 count(*) OVER () AS n FROM o_label)""")
def prd12(t):
    """PRD-12: 80/10/10 chronological split of the labelled dataset by row position."""
    return SG.chrono_split(_scored(t).select("symbol", "date"), ["date", "symbol"], (0.8, 0.1))


@splan("ml05_class_report", """
    WITH s AS (SELECT target AS l, CAST(vol_rank > 0.5 AS INTEGER) AS p FROM o_label WHERE vol_rank IS NOT NULL),
         cls AS (SELECT l AS c FROM s UNION SELECT p FROM s),
         r AS (SELECT CAST(c AS VARCHAR) AS cls,
                      coalesce((SELECT count(*) FROM s WHERE l = c AND p = c) / nullif((SELECT count(*) FROM s WHERE p = c), 0), 0.0) AS precision,
                      coalesce((SELECT count(*) FROM s WHERE l = c AND p = c) / nullif((SELECT count(*) FROM s WHERE l = c), 0), 0.0) AS recall,
                      (SELECT count(*) FROM s WHERE l = c) AS support FROM cls),
         f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r)
    SELECT * FROM f UNION ALL
    SELECT 'macro avg', avg(precision), avg(recall), sum(support)::BIGINT, avg(f1) FROM f""")
def ml05(t):
    """ML-05: classification report of a vol-rank threshold rule against the breakout target."""
    d = _scored(t).where(F.col("vol_rank").isNotNull()).select(
        F.col("target").alias("label"), (F.col("vol_rank") > 0.5).cast("int").alias("prediction"))
    return SG.class_report(d)
