"""Prediction verification, accuracy reports and listings (PRD-01..06, -20, FLT-09)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions.common import lookup, plus_seconds, ts_lit
from eventlens.operators.market import asof_price

# thresholds
DISPLAY_ACCURACY_THRESHOLD = 0.60
AUTO_DISABLE_THRESHOLD = 0.50
OUTCOME_BAND = 0.25          # up/down: correct at >= +0.25 %, wrong at <= -0.25 %
NEUTRAL_CORRECT = 1.0        # neutral: correct when |change| <= 1 %
NEUTRAL_PARTIAL = 2.0        # neutral: partial when |change| <= 2 %


def resolve_at(df: DataFrame, horizon: str = "prediction_horizon",
               at: str = "predicted_at") -> DataFrame:
    """PRD-01: resolve time = predicted time + horizon (1h, 6h, 24h, 7d, 30d)."""
    secs = lookup(L.HORIZON_SECONDS, F.col(horizon))
    return df.withColumn("resolve_at", plus_seconds(F.col(at), secs))


def classify_outcome(direction: Column, pct: Column) -> Column:
    up = (F.when(pct >= OUTCOME_BAND, "correct").when(pct <= -OUTCOME_BAND, "wrong")
          .otherwise("partial"))
    down = (F.when(pct <= -OUTCOME_BAND, "correct").when(pct >= OUTCOME_BAND, "wrong")
            .otherwise("partial"))
    neutral = (F.when(F.abs(pct) <= NEUTRAL_CORRECT, "correct")
               .when(F.abs(pct) <= NEUTRAL_PARTIAL, "partial").otherwise("wrong"))
    return F.when(direction == "up", up).when(direction == "down", down).otherwise(neutral)


def due_predictions(preds: DataFrame, as_of, n: int | None = None) -> DataFrame:
    """FLT-09: pending predictions whose resolve time has passed; ``n`` keeps the
    oldest ones as one batch."""
    due = (preds.where((F.col("outcome") == "pending") & F.col("resolve_at").isNotNull()
                        & (F.col("resolve_at") <= ts_lit(as_of)))
           )
    return due.orderBy("resolve_at", "prediction_id").limit(n) if n is not None else due


def verify_predictions(preds: DataFrame, prices: DataFrame, as_of,
                       round_digits: int | None = 4) -> DataFrame:
    """PRD-02: settle due predictions against the nearest bars. The change is
    stored with four decimals; the outcome is judged on the exact one.

    Both as-of lookups (at ``predicted_at`` and at ``resolve_at``) run as one
    pass over a two-rows-per-prediction target table. Predictions without a
    usable start or end price stay pending with NULL change.
    """
    due = preds.where((F.col("outcome") == "pending") & F.col("resolve_at").isNotNull()
                      & (F.col("resolve_at") <= ts_lit(as_of)))
    tg = due.select("prediction_id", "asset_id",
                    F.explode(F.array(
                        F.struct(F.lit("start").alias("leg"), F.col("predicted_at").alias("target_at")),
                        F.struct(F.lit("end").alias("leg"), F.col("resolve_at").alias("target_at")))).alias("_l")
                    ).select("prediction_id", "asset_id", "_l.leg", "_l.target_at")
    px = (asof_price(tg, prices, direction="nearest")
          .groupBy("prediction_id")
          .agg(F.max(F.when(F.col("leg") == "start", F.col("price"))).alias("start_price"),
               F.max(F.when(F.col("leg") == "end", F.col("price"))).alias("end_price")))
    ok = F.col("start_price").isNotNull() & F.col("end_price").isNotNull() & (F.col("start_price") > 0)
    pct = (F.col("end_price") - F.col("start_price")) / F.col("start_price") * 100.0
    stored = F.round(pct, round_digits) if round_digits is not None else pct
    return (due.join(px, "prediction_id", "left")
            .select("prediction_id", "asset_id", "predicted_direction", "predicted_at", "resolve_at",
                    "start_price", "end_price",
                    F.when(ok, stored).alias("actual_change_pct"),
                    F.when(ok, classify_outcome(F.col("predicted_direction"), pct))
                     .otherwise(F.lit("pending")).alias("outcome"),
                    F.when(ok, ts_lit(as_of)).alias("resolved_at")))


def score_expr(outcome: Column | None = None) -> Column:
    """1 / 0.5 / 0 for correct / partial / wrong, NULL otherwise."""
    outcome = F.col("outcome") if outcome is None else outcome
    return (F.when(outcome == "correct", 1.0).when(outcome == "partial", 0.5)
            .when(outcome == "wrong", 0.0))


def prediction_summary(preds: DataFrame) -> DataFrame:
    """PRD-03: counts, mean score and the auto-disable flag (one row)."""
    acc = F.avg(score_expr())
    return (preds.agg(F.count("prediction_id").alias("total_predictions"),
                      F.count(F.when(F.col("outcome") != "pending", 1)).alias("resolved_predictions"),
                      F.count(F.when(F.col("outcome") == "pending", 1)).alias("pending_predictions"),
                      acc.alias("overall_accuracy"))
            .withColumn("feature_enabled", F.col("overall_accuracy").isNull()
                        | (F.col("overall_accuracy") >= AUTO_DISABLE_THRESHOLD)))


def _resolved_with_type(preds: DataFrame, events: DataFrame) -> DataFrame:
    ev = events.select("event_id", "event_type")
    return preds.where(F.col("outcome") != "pending").join(ev, "event_id")


def _metric_cols(df: DataFrame) -> DataFrame:
    actual = F.coalesce(F.col("actual_change_pct"), F.lit(0.0))
    predc = F.coalesce(F.col("predicted_change_pct"), F.lit(0.0))
    pdir = F.when(F.col("predicted_direction") == "up", 1).otherwise(-1)
    adir = F.signum(actual).cast("int")
    score = (F.when(F.col("outcome") == "correct", 1.0)
             .when(F.col("outcome") == "partial", 0.5).otherwise(0.0))
    return df.select("*", score.alias("_score"), pdir.alias("_pdir"), adir.alias("_adir"),
                     F.abs(predc - actual).alias("_abserr"), (pdir * actual).alias("_ret"))


def accuracy_metrics(preds: DataFrame, events: DataFrame) -> DataFrame:
    """PRD-04 overall: accuracy, direction hit rate, MAE, Sharpe-like ratio
    (population std; mean alone when std <= 1e-4) and confusion counts."""
    m = _metric_cols(_resolved_with_type(preds, events))
    p, a = F.col("_pdir"), F.col("_adir")
    g = m.agg(F.count(F.lit(1)).alias("total_resolved"),
              F.avg("_score").alias("overall_accuracy"),
              F.avg((p == a).cast("double")).alias("directional_accuracy"),
              F.avg("_abserr").alias("mae"),
              F.avg("_ret").alias("_mu"), F.stddev_pop("_ret").alias("_sd"),
              F.count(F.when((p == 1) & (a >= 0), 1)).alias("tp"),
              F.count(F.when((p == 1) & (a < 0), 1)).alias("fp"),
              F.count(F.when((p == -1) & (a > 0), 1)).alias("fn"),
              F.count(F.when(~(((p == 1)) | ((p == -1) & (a > 0))), 1)).alias("tn"))
    sharpe = F.when(F.col("_sd") > 0.0001, F.col("_mu") / F.col("_sd")).otherwise(F.col("_mu"))
    return g.select("total_resolved", "overall_accuracy", "directional_accuracy", "mae",
                    sharpe.alias("sharpe_ratio"), "tp", "fp", "fn", "tn")


def accuracy_by(preds: DataFrame, events: DataFrame) -> DataFrame:
    """PRD-04 breakdown: (dimension, key, n, accuracy) by model version, event
    type and horizon, from one scan with grouping sets."""
    m = _metric_cols(_resolved_with_type(preds, events))
    g = (m.groupingSets([["model_version"], ["event_type"], ["prediction_horizon"]],
                        "model_version", "event_type", "prediction_horizon")
         .agg(F.count(F.lit(1)).alias("n"), F.avg("_score").alias("accuracy"),
              F.grouping_id().alias("_gid")))
    dim = (F.when(F.col("_gid") == 3, "model_version").when(F.col("_gid") == 5, "event_type")
           .otherwise("prediction_horizon"))
    key = F.coalesce("model_version", "event_type", "prediction_horizon")
    return g.select(dim.alias("dimension"), key.alias("key"), "n", "accuracy")


def accuracy_maps(preds: DataFrame, events: DataFrame, model_version: str | None = None,
                  horizon: str | None = None) -> DataFrame:
    """PRD-05: mean score by (model, horizon), by event type and overall, long
    form ``(dimension, model_version, prediction_horizon, event_type, accuracy)``.
    The event-type map counts only predictions whose event exists."""
    p = preds.where(F.col("outcome") != "pending")
    if model_version:
        p = p.where(F.col("model_version") == model_version)
    if horizon:
        p = p.where(F.col("prediction_horizon") == horizon)
    p = p.join(events.select("event_id", F.col("event_type"), F.lit(True).alias("_has_ev")),
               "event_id", "left")
    g = (p.groupingSets([["model_version", "prediction_horizon"], ["event_type"], []],
                        "model_version", "prediction_horizon", "event_type")
         .agg(F.avg(score_expr()).alias("accuracy_all"),
              F.avg(F.when(F.col("_has_ev"), score_expr())).alias("accuracy_ev"),
              F.grouping_id().alias("_gid")))
    dim = (F.when(F.col("_gid") == 1, "model_horizon").when(F.col("_gid") == 6, "event_type")
           .otherwise("overall"))
    acc = F.when(F.col("_gid") == 6, F.col("accuracy_ev")).otherwise(F.col("accuracy_all"))
    out = g.select(dim.alias("dimension"), "model_version", "prediction_horizon", "event_type",
                   acc.alias("accuracy"))
    # Event-type rows only exist for predictions that join an event.
    return out.where(~((F.col("dimension") == "event_type") & F.col("event_type").isNull()))


def list_predictions(preds: DataFrame, events: DataFrame, assets: DataFrame, *,
                     limit: int = 50, offset: int = 0, event_id=None, ticker: str | None = None,
                     horizon: str | None = None, history_only: bool = False,
                     published_only: bool = True) -> DataFrame:
    """PRD-06: newest-first page of predictions with their accuracy context.

    The page is cut first, then the display rule (feature enabled and
    event-type accuracy >= 0.60) drops rows, as in the reference.
    """
    maps = accuracy_maps(preds, events, horizon=horizon)
    mh = maps.where(F.col("dimension") == "model_horizon").select(
        "model_version", "prediction_horizon", F.col("accuracy").alias("model_accuracy"))
    et = maps.where(F.col("dimension") == "event_type").select(
        "event_type", F.col("accuracy").alias("event_type_accuracy"))
    # One-row aggregate used as a scalar subquery (computed once, no join).
    overall = maps.where(F.col("dimension") == "overall").select(F.max("accuracy")).scalar()
    q = (preds.join(events.select("event_id", F.col("title").alias("event_title"), "event_type"),
                    "event_id")
         .join(assets.select("asset_id", "ticker", F.col("name").alias("asset_name")), "asset_id"))
    if event_id is not None:
        q = q.where(F.col("event_id") == event_id)
    if ticker:
        q = q.where(F.col("ticker") == ticker.upper())
    if horizon:
        q = q.where(F.col("prediction_horizon") == horizon)
    if history_only:
        q = q.where(F.col("outcome") != "pending")
    page = q.orderBy(F.desc("predicted_at"), F.desc("prediction_id")).offset(offset).limit(limit)
    out = (page.join(mh, ["model_version", "prediction_horizon"], "left")
           .join(et, "event_type", "left")
           .withColumn("_overall", overall))
    enabled = F.col("_overall").isNull() | (F.col("_overall") >= AUTO_DISABLE_THRESHOLD)
    eligible = enabled & F.col("event_type_accuracy").isNotNull() & \
        (F.col("event_type_accuracy") >= DISPLAY_ACCURACY_THRESHOLD)
    out = out.withColumn("feature_enabled", enabled).withColumn("eligible_for_display", eligible)
    if published_only and not history_only:
        out = out.where(F.col("eligible_for_display"))
    return out.drop("_overall")


def outcome_counts(preds: DataFrame) -> DataFrame:
    """PRD-20: predictions per outcome state."""
    return preds.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
