"""Registered queries: price series, as-of lookups, predictions."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import market as M
from eventlens.operators import predictions as P
from eventlens.plans.base import plan

VERIFY_AS_OF = "2002-06-01 00:00:00"
DUE_AS_OF = "1996-01-01 00:00:00"


@plan("mkt01_asof_price", oracle="""
    SELECT p.prediction_id, p.asset_id, p.resolve_at AS target_at, coalesce(f.close, b.close) AS price
    FROM f_prediction p
    ASOF LEFT JOIN f_bar f ON p.asset_id = f.asset_id AND p.resolve_at <= f.ts
    ASOF LEFT JOIN f_bar b ON p.asset_id = b.asset_id AND p.resolve_at >= b.ts""")
def mkt01(t):
    """MKT-01: nearest bar (first at/after, else last at/before) for every prediction's resolve time."""
    tg = t.prediction.select("prediction_id", "asset_id", F.col("resolve_at").alias("target_at"))
    return M.asof_price(tg, t.bar)


@plan("mkt02_event_returns", oracle="""
    SELECT event_id, asset_id, event_title, event_type, sentiment_score, severity, region, published_at,
           pct_1h, pct_6h, pct_24h, pct_7d,
           CASE WHEN pct_1h > 0.5 THEN 'positive' WHEN pct_1h < -0.5 THEN 'negative' ELSE 'neutral' END AS label_1h,
           CASE WHEN pct_6h > 1.0 THEN 'positive' WHEN pct_6h < -1.0 THEN 'negative' ELSE 'neutral' END AS label_6h,
           CASE WHEN pct_24h > 2.0 THEN 'positive' WHEN pct_24h < -2.0 THEN 'negative' ELSE 'neutral' END AS label_24h,
           CASE WHEN pct_7d > 5.0 THEN 'positive' WHEN pct_7d < -5.0 THEN 'negative' ELSE 'neutral' END AS label_7d
    FROM (
      SELECT x.*,
             (nullif(b1.close, 0) - nullif(b0.close, 0)) / nullif(b0.close, 0) * 100.0 AS pct_1h,
             (nullif(b6.close, 0) - nullif(b0.close, 0)) / nullif(b0.close, 0) * 100.0 AS pct_6h,
             (nullif(b24.close, 0) - nullif(b0.close, 0)) / nullif(b0.close, 0) * 100.0 AS pct_24h,
             (nullif(b7.close, 0) - nullif(b0.close, 0)) / nullif(b0.close, 0) * 100.0 AS pct_7d
      FROM (SELECT i.event_id, i.asset_id, e.title AS event_title, e.event_type,
                   i.confidence_score AS sentiment_score, e.severity, e.region, e.published_at,
                   e.published_at + INTERVAL 1 HOUR AS t1, e.published_at + INTERVAL 6 HOUR AS t6,
                   e.published_at + INTERVAL 24 HOUR AS t24, e.published_at + INTERVAL 7 DAY AS t7
            FROM f_impact i JOIN f_event e ON i.event_id = e.event_id
            WHERE e.published_at IS NOT NULL) x
      ASOF LEFT JOIN f_bar b0 ON x.asset_id = b0.asset_id AND x.published_at <= b0.ts
      ASOF LEFT JOIN f_bar b1 ON x.asset_id = b1.asset_id AND x.t1 <= b1.ts
      ASOF LEFT JOIN f_bar b6 ON x.asset_id = b6.asset_id AND x.t6 <= b6.ts
      ASOF LEFT JOIN f_bar b24 ON x.asset_id = b24.asset_id AND x.t24 <= b24.ts
      ASOF LEFT JOIN f_bar b7 ON x.asset_id = b7.asset_id AND x.t7 <= b7.ts)""")
def mkt02(t):
    """MKT-02: forward multi-horizon returns for every (event, impacted asset)."""
    return M.event_returns(t.impact, t.event, t.bar)


@plan("mkt03_latest_price", oracle="""
    SELECT asset_id, arg_max(close, ts) AS price, max(ts) AS as_of FROM f_bar GROUP BY asset_id""")
def mkt03(t):
    """MKT-03: latest close per asset."""
    return M.latest_price(t.bar)


@plan("mkt04_last_bars", oracle="""
    SELECT * FROM (
      SELECT asset_id, ts, open, high, low, close, volume,
             CAST(row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC) AS INTEGER) AS rn
      FROM f_bar) WHERE rn <= 30""")
def mkt04(t):
    """MKT-04: newest 30 bars per asset."""
    return M.last_bars(t.bar, n=30)


@plan("mkt07_daily_close", oracle="""
    SELECT ticker, CAST(ts AS DATE) AS date, arg_max(price, ts) AS close FROM f_trade GROUP BY 1, 2""")
def mkt07(t):
    """MKT-07: last trade price per ticker and day."""
    return M.daily_close(t.trade, by="ticker", value="price")


@plan("prd01_resolve_at", oracle="""
    SELECT prediction_id, prediction_horizon, predicted_at,
           predicted_at + CASE prediction_horizon WHEN '1h' THEN INTERVAL 1 HOUR WHEN '6h' THEN INTERVAL 6 HOUR
                          WHEN '24h' THEN INTERVAL 24 HOUR WHEN '7d' THEN INTERVAL 7 DAY
                          WHEN '30d' THEN INTERVAL 30 DAY END AS resolve_at
    FROM f_prediction""")
def prd01(t):
    """PRD-01: resolve time from horizon."""
    return P.resolve_at(t.prediction.select("prediction_id", "prediction_horizon", "predicted_at"))


@plan("prd02_verify_predictions", oracle=f"""
    SELECT prediction_id, asset_id, predicted_direction, predicted_at, resolve_at, start_price, end_price,
           CASE WHEN ok THEN round(pct, 4) END AS actual_change_pct,
           CASE WHEN NOT ok THEN 'pending'
                WHEN predicted_direction = 'up' THEN
                  CASE WHEN pct >= 0.25 THEN 'correct' WHEN pct <= -0.25 THEN 'wrong' ELSE 'partial' END
                WHEN predicted_direction = 'down' THEN
                  CASE WHEN pct <= -0.25 THEN 'correct' WHEN pct >= 0.25 THEN 'wrong' ELSE 'partial' END
                ELSE CASE WHEN abs(pct) <= 1.0 THEN 'correct' WHEN abs(pct) <= 2.0 THEN 'partial' ELSE 'wrong' END
           END AS outcome,
           CASE WHEN ok THEN TIMESTAMP '{VERIFY_AS_OF}' END AS resolved_at
    FROM (
      SELECT *, coalesce(start_price IS NOT NULL AND end_price IS NOT NULL AND start_price > 0, false) AS ok,
             (end_price - start_price) / start_price * 100.0 AS pct
      FROM (
        SELECT p.prediction_id, p.asset_id, p.predicted_direction, p.predicted_at, p.resolve_at,
               coalesce(sf.close, sb.close) AS start_price, coalesce(ef.close, eb.close) AS end_price
        FROM (SELECT * FROM f_prediction WHERE outcome = 'pending' AND resolve_at <= TIMESTAMP '{VERIFY_AS_OF}') p
        ASOF LEFT JOIN f_bar sf ON p.asset_id = sf.asset_id AND p.predicted_at <= sf.ts
        ASOF LEFT JOIN f_bar sb ON p.asset_id = sb.asset_id AND p.predicted_at >= sb.ts
        ASOF LEFT JOIN f_bar ef ON p.asset_id = ef.asset_id AND p.resolve_at <= ef.ts
        ASOF LEFT JOIN f_bar eb ON p.asset_id = eb.asset_id AND p.resolve_at >= eb.ts))""")
def prd02(t):
    """PRD-02: settle pending predictions against nearest bars."""
    return P.verify_predictions(t.prediction, t.bar, VERIFY_AS_OF)


_SCORE = ("CASE outcome WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE "
          "WHEN 'wrong' THEN 0.0::DOUBLE END")


@plan("prd03_prediction_summary", oracle=f"""
    SELECT count(prediction_id) AS total_predictions,
           count(CASE WHEN outcome <> 'pending' THEN 1 END) AS resolved_predictions,
           count(CASE WHEN outcome = 'pending' THEN 1 END) AS pending_predictions,
           avg({_SCORE}) AS overall_accuracy,
           avg({_SCORE}) IS NULL OR avg({_SCORE}) >= 0.5 AS feature_enabled
    FROM f_prediction""")
def prd03(t):
    """PRD-03: prediction summary row."""
    return P.prediction_summary(t.prediction)


_RESOLVED = """
    (SELECT p.*, e.event_type,
            CASE p.outcome WHEN 'correct' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS sc,
            CASE WHEN p.predicted_direction = 'up' THEN 1 ELSE -1 END AS pd,
            CAST(sign(coalesce(p.actual_change_pct, 0.0)) AS INTEGER) AS ad,
            abs(coalesce(p.predicted_change_pct, 0.0) - coalesce(p.actual_change_pct, 0.0)) AS ae,
            (CASE WHEN p.predicted_direction = 'up' THEN 1 ELSE -1 END) * coalesce(p.actual_change_pct, 0.0) AS ret
     FROM f_prediction p JOIN f_event e ON p.event_id = e.event_id WHERE p.outcome <> 'pending')"""


@plan("prd04_accuracy_metrics", oracle=f"""
    SELECT count(*) AS total_resolved, avg(sc) AS overall_accuracy,
           avg(CASE WHEN pd = ad THEN 1.0 ELSE 0.0 END) AS directional_accuracy, avg(ae) AS mae,
           CASE WHEN stddev_pop(ret) > 0.0001 THEN avg(ret) / stddev_pop(ret) ELSE avg(ret) END AS sharpe_ratio,
           count(CASE WHEN pd = 1 AND ad >= 0 THEN 1 END) AS tp,
           count(CASE WHEN pd = 1 AND ad < 0 THEN 1 END) AS fp,
           count(CASE WHEN pd = -1 AND ad > 0 THEN 1 END) AS fn,
           count(CASE WHEN NOT (pd = 1 OR (pd = -1 AND ad > 0)) THEN 1 END) AS tn
    FROM {_RESOLVED} r""")
def prd04(t):
    """PRD-04: overall accuracy report."""
    return P.accuracy_metrics(t.prediction, t.event)


@plan("prd04_accuracy_by", oracle=f"""
    SELECT 'model_version' AS dimension, model_version AS key, count(*) AS n, avg(sc) AS accuracy
    FROM {_RESOLVED} r GROUP BY model_version
    UNION ALL
    SELECT 'event_type', event_type, count(*), avg(sc) FROM {_RESOLVED} r GROUP BY event_type
    UNION ALL
    SELECT 'prediction_horizon', prediction_horizon, count(*), avg(sc) FROM {_RESOLVED} r GROUP BY prediction_horizon""")
def prd04b(t):
    """PRD-04: accuracy by model, event type and horizon."""
    return P.accuracy_by(t.prediction, t.event)


@plan("prd05_accuracy_maps", oracle=f"""
    SELECT 'model_horizon' AS dimension, model_version, prediction_horizon, CAST(NULL AS VARCHAR) AS event_type,
           avg({_SCORE}) AS accuracy
    FROM f_prediction WHERE outcome <> 'pending' GROUP BY model_version, prediction_horizon
    UNION ALL
    SELECT 'event_type', NULL, NULL, e.event_type, avg(CASE p.outcome WHEN 'correct' THEN 1.0::DOUBLE
           WHEN 'partial' THEN 0.5::DOUBLE WHEN 'wrong' THEN 0.0::DOUBLE END)
    FROM f_prediction p JOIN f_event e ON p.event_id = e.event_id WHERE p.outcome <> 'pending' GROUP BY e.event_type
    UNION ALL
    SELECT 'overall', NULL, NULL, NULL, avg({_SCORE}) FROM f_prediction WHERE outcome <> 'pending'""")
def prd05(t):
    """PRD-05: accuracy maps."""
    return P.accuracy_maps(t.prediction, t.event)


@plan("prd06_list_predictions", oracle=f"""
    WITH mh AS (SELECT model_version, prediction_horizon, avg({_SCORE}) AS model_accuracy
                FROM f_prediction WHERE outcome <> 'pending' GROUP BY 1, 2),
         et AS (SELECT e.event_type, avg(CASE p.outcome WHEN 'correct' THEN 1.0::DOUBLE
                       WHEN 'partial' THEN 0.5::DOUBLE WHEN 'wrong' THEN 0.0::DOUBLE END) AS event_type_accuracy
                FROM f_prediction p JOIN f_event e ON p.event_id = e.event_id
                WHERE p.outcome <> 'pending' GROUP BY 1),
         ov AS (SELECT avg({_SCORE}) AS a FROM f_prediction WHERE outcome <> 'pending'),
         page AS (SELECT p.*, e.title AS event_title, e.event_type, a.ticker, a.name AS asset_name
                  FROM f_prediction p JOIN f_event e ON p.event_id = e.event_id
                  JOIN f_asset a ON p.asset_id = a.asset_id
                  WHERE p.outcome <> 'pending'
                  ORDER BY p.predicted_at DESC, p.prediction_id DESC LIMIT 50)
    SELECT page.*, mh.model_accuracy, et.event_type_accuracy,
           (ov.a IS NULL OR ov.a >= 0.5) AS feature_enabled,
           coalesce((ov.a IS NULL OR ov.a >= 0.5) AND et.event_type_accuracy >= 0.6, false) AS eligible_for_display
    FROM page LEFT JOIN mh USING (model_version, prediction_horizon)
    LEFT JOIN et USING (event_type), ov""")
def prd06(t):
    """PRD-06: newest resolved predictions with accuracy context (history view)."""
    return P.list_predictions(t.prediction, t.event, t.asset, history_only=True, limit=50)


@plan("prd20_outcome_counts", oracle="""
    SELECT outcome, count(*) AS n FROM f_prediction GROUP BY outcome""")
def prd20(t):
    """PRD-20: predictions per outcome."""
    return P.outcome_counts(t.prediction)


@plan("flt09_due_predictions", oracle=f"""
    SELECT * FROM f_prediction
    WHERE outcome = 'pending' AND resolve_at IS NOT NULL AND resolve_at <= TIMESTAMP '{DUE_AS_OF}'
    ORDER BY resolve_at, prediction_id LIMIT 200""")
def flt09(t):
    """FLT-09: oldest 200 due predictions."""
    return P.due_predictions(t.prediction, DUE_AS_OF, 200)
