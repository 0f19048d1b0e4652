"""Signal ranking, model fusion, backtests, splits and classification
reports (PRD-07..12, ML-05). Model scores enter as columns; the reference's
model inference itself is out of scope."""
from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.common import col, seconds_between, ts_lit
from eventlens.session import cut_lineage, kept_table

# Fixed values
SIGNAL_FRESHNESS_S = 600
SIGNAL_MIN_SCORE = 0.6
SIGNAL_TOP_K = 3
FUSE_WEIGHTS = {"xgb": 0.4, "lstm": 0.3, "chronos": 0.3}
FUSE_NEUTRAL_BAND = 0.1
CHRONOS_DEAD_BAND = 0.002
REGIME_WEIGHTS = {"risk-on": (0.6, 0.3, 0.1), "risk-off": (0.3, 0.1, 0.6), "other": (0.4, 0.4, 0.2)}
BACKTEST_MIN_CONF = 0.6
BACKTEST_FLAT = 0.005
FILTER_PROB = 0.60
FILTER_TOP_K = 60
FILTER_TOP_ACC = 10


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def rank_signals(impacts: DataFrame, features: DataFrame, probs: DataFrame, as_of) -> DataFrame:
    """PRD-07: per (event, asset) signal from fresh features (<= 10 min old)
    and breakout probabilities; confident non-breakouts are skipped; score =
    0.6 p + 0.4 min(1, |momentum|); expected change = dir * p * |vol| *
    min(1, |momentum|) * 2. Per event keep scores >= 0.6 (all when none
    reaches it), then the top 3. ``features``: (asset_id, ts, volatility_7d,
    sentiment_momentum); ``probs``: (asset_id, p_breakout, confidence)."""
    now = as_of if isinstance(as_of, Column) else ts_lit(as_of)
    f = features.where(F.col("ts").isNotNull()
                       & (seconds_between(now, F.col("ts")) <= SIGNAL_FRESHNESS_S)
                       & F.col("volatility_7d").isNotNull() & F.col("sentiment_momentum").isNotNull())
    j = (impacts.select("event_id", "asset_id").join(f, "asset_id").join(probs, "asset_id")
         .where(~((F.col("p_breakout") < 0.5) & (F.col("confidence") > 0.8))))
    sm = F.col("sentiment_momentum")
    d = F.when(sm > 0, 1).otherwise(-1)
    score = 0.6 * F.col("p_breakout") + 0.4 * F.least(F.lit(1.0), F.abs(sm))
    exp = d * F.col("p_breakout") * F.abs("volatility_7d") * F.least(F.lit(1.0), F.abs(sm)) * 2.0
    j = j.select("event_id", "asset_id", "p_breakout", score.alias("score"), exp.alias("expected_change_pct"))
    ev = Window.partitionBy("event_id")
    keep = (F.max("score").over(ev) < SIGNAL_MIN_SCORE) | (F.col("score") >= SIGNAL_MIN_SCORE)
    k = j.withColumn("_keep", keep).where("_keep").drop("_keep")
    w = Window.partitionBy("event_id").orderBy(F.col("score").desc(), F.col("asset_id"))
    return k.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SIGNAL_TOP_K)


def fuse_fixed(df: DataFrame) -> DataFrame:
    """PRD-08: fixed-weight fusion of three model outputs (columns xgb_change_pct,
    xgb_confidence, xgb_p_breakout, lstm_confidence, chronos_delta,
    chronos_confidence); chronos direction uses a +-0.002 dead band;
    direction neutral when |magnitude| < 0.1."""
    w = FUSE_WEIGHTS
    x_mag = F.col("xgb_change_pct")
    x_dir = F.when(x_mag > 0, 1.0).otherwise(-1.0)
    c_mag = F.coalesce(F.col("chronos_delta"), F.lit(0.0)) * 100.0
    c_dir = F.when(F.col("chronos_delta") > CHRONOS_DEAD_BAND, 1.0).when(
        F.col("chronos_delta") < -CHRONOS_DEAD_BAND, -1.0).otherwise(0.0)
    mag = (w["xgb"] * x_mag + w["chronos"] * c_mag
           + w["lstm"] * (x_dir * F.col("lstm_confidence") * F.col("xgb_p_breakout") * 2.0))
    conf = (w["xgb"] * F.col("xgb_confidence") + w["lstm"] * F.col("lstm_confidence")
            + w["chronos"] * F.coalesce(F.col("chronos_confidence"), F.lit(0.0)))
    dirn = F.when(F.abs(mag) < FUSE_NEUTRAL_BAND, "neutral").when(mag > 0, "up").otherwise("down")
    return df.select("*", c_dir.alias("chronos_direction"), mag.alias("final_change_pct"),
                     conf.alias("final_confidence"), dirn.alias("final_direction"))


def _to_numeric(direction: Column, conf: Column, base: float) -> Column:
    return (F.when(direction == "up", base * conf).when(direction == "down", -base * conf)
            .otherwise(F.lit(0.0)))


def fuse_regime(df: DataFrame) -> DataFrame:
    """PRD-09: regime-weighted fusion. Inputs: regime, xgb_direction,
    xgb_confidence, lstm_direction, lstm_confidence, last_price,
    chronos_median, chronos_q10, chronos_q90, sent_direction,
    sent_confidence. Weights by regime (dead models, confidence < 0.05, get
    0), confidence-weighted change, sign agreement, sentiment bias +-0.5
    conf, clamp +-15, direction at +-0.5, min/max band +-4 lstm confidence."""
    xc = F.coalesce(F.col("xgb_confidence"), F.lit(0.5))
    lc = F.coalesce(F.col("lstm_confidence"), F.lit(0.5))
    norm = lambda c: clamp(c, -10.0, 10.0)
    xch = norm(_to_numeric(F.col("xgb_direction"), xc, 3.0))
    lch = norm(_to_numeric(F.col("lstm_direction"), lc, 5.0))
    lp, med = F.col("last_price"), F.coalesce(F.col("chronos_median"), F.col("last_price"))
    ok = lp.isNotNull() & (lp > 0)
    cch = F.when(ok, norm((med - lp) / lp * 100.0)).otherwise(0.0)
    spread = F.abs(F.coalesce(F.col("chronos_q90"), med) - F.coalesce(F.col("chronos_q10"), med))
    cc = F.when(ok, clamp(1.0 - spread / F.greatest(med, F.lit(1e-6)), 0.3, 1.0)).otherwise(0.0)
    r = F.col("regime")
    wc = F.when(r == "risk-on", 0.6).when(r == "risk-off", 0.3).otherwise(0.4)
    wx = F.when(r == "risk-on", 0.3).when(r == "risk-off", 0.1).otherwise(0.4)
    wl = F.when(r == "risk-on", 0.1).when(r == "risk-off", 0.6).otherwise(0.2)
    wx = F.when(xc < 0.05, 0.0).otherwise(wx)
    wl = F.when(lc < 0.05, 0.0).otherwise(wl)
    wc = F.when(cc < 0.05, 0.0).otherwise(wc)
    tot = cc * wc + xc * wx + lc * wl + 1e-6
    change = (cch * cc * wc + xch * xc * wx + lch * lc * wl) / tot
    agree = F.abs(F.signum(cch) + F.signum(xch) + F.signum(lch)) / 3.0
    sc = F.coalesce(F.col("sent_confidence"), F.lit(0.5))
    change = (change - F.when(F.col("sent_direction") == "down", 0.5 * sc).otherwise(0.0)
              + F.when(F.col("sent_direction") == "up", 0.5 * sc).otherwise(0.0))
    change = clamp(change, -15.0, 15.0)
    dirn = F.when(change > 0.5, "up").when(change < -0.5, "down").otherwise("neutral")
    vm = lc * 4.0
    conf = (cc + xc + lc) / 3.0 * agree
    return df.select("*", change.alias("final_change_pct"), dirn.alias("final_direction"),
                     conf.alias("final_confidence"), (change - vm).alias("expected_min_pct"),
                     (change + vm).alias("expected_max_pct"))


def backtest(scored: DataFrame) -> DataFrame:
    """PRD-10: direction hit rate of confident predictions (>= 0.6): predicted
    direction = sign of ``prediction`` (<= 0 -> -1), actual = sign of
    ``future_return`` with |r| < 0.005 flat (0). The reference compares a 0/1
    class mapped to +-1 with signed returns; the arithmetic is kept."""
    pdir = F.when(F.col("prediction") > 0, 1).otherwise(-1)
    r = F.col("future_return")
    adir = F.when(F.abs(r) < BACKTEST_FLAT, 0).when(r > 0, 1).otherwise(-1)
    fired = F.col("confidence") >= BACKTEST_MIN_CONF
    g = scored.agg(F.count(F.lit(1)).alias("total_tested"),
                   F.count(F.when(fired, 1)).alias("predictions_fired"),
                   F.count(F.when(fired & (pdir == adir), 1)).alias("correct_direction"))
    return g.withColumn("directional_accuracy_pct",
                        F.col("correct_direction") / F.greatest(F.col("predictions_fired"), F.lit(1)) * 100.0)


def filter_signals(scored: DataFrame, key: str = "row_id", prob: str = "prob",
                   target: str = "target", spike: str = "event_spike") -> DataFrame:
    """PRD-11: trade signal = probability > 0.60, among the 60 strongest (ties:
    later row first, as the stable ascending sort keeps the last ones), and an
    event spike. One row: coverage, precision of signals, accuracy of the 10
    most confident signals. The top-60 is a global top-k (partial per split).
    The four columns are kept as a scratch table: what they come from runs once."""
    scored = kept_table(scored.select(key, prob, target, spike), "filter_signals")
    valid = scored.where(F.col(prob) > FILTER_PROB)
    top = valid.orderBy(F.col(prob).desc(), F.col(key).desc()).limit(FILTER_TOP_K).select(key)
    s = scored.join(top.withColumn("_top", F.lit(True)), key, "left")
    sig = F.coalesce(F.col("_top"), F.lit(False)) & (F.col(spike) == 1)
    s = s.withColumn("_sig", sig)
    conf = F.greatest(F.col(prob), 1 - F.col(prob))
    top10 = (s.where("_sig").orderBy(conf.desc(), F.col(key).desc()).limit(FILTER_TOP_ACC)
             .agg(F.avg((F.col(target) == 1).cast("double")).alias("top_acc")))
    g = s.agg(F.avg(F.col("_sig").cast("double")).alias("coverage"),
              F.count(F.when(F.col("_sig"), 1)).alias("trades"),
              F.avg(F.when(F.col("_sig"), (F.col(target) == 1).cast("double"))).alias("precision"))
    return g.select("coverage", "trades", "precision", top10.scalar().alias("top10_accuracy"))


def _positions(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> tuple[DataFrame, int]:
    """(order columns, _n, _at) per distinct key, and the number of rows: how
    many rows have the key and the position of the first of them. Only the key
    columns are sorted and materialised; offsets are prefix sums over one row
    per partition."""
    keys = df.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    ranged = keys.repartitionByRange(partitions, *order) if partitions else keys.repartitionByRange(*order)
    k = cut_lineage(ranged.sortWithinPartitions(*order)).withColumn("_mid", F.monotonically_increasing_id())
    k = k.withColumn("_pid", F.shiftright("_mid", 33))
    sums = k.groupBy("_pid").agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_most"))
    off = cut_lineage(sums.select("_pid", "_rows", "_most", F.coalesce(F.sum("_rows").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off")))
    total, most = off.agg(F.sum("_rows"), F.max("_most")).first()
    if most and most > 1:
        inside = F.sum("_n").over(Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1))
        at = F.col("_off") + F.coalesce(inside, F.lit(0))
    else:  # every key once: the place in the partition is the number of keys before it
        at = F.col("_off") + F.col("_mid").bitwiseAND((1 << 33) - 1)
    return k.join(off.select("_pid", "_off"), "_pid").select(*order, "_n", at.alias("_at")), int(total or 0)


def _indexed(df: DataFrame, order: Sequence[str], positions: DataFrame, out: str) -> DataFrame:
    """The rows with their position; rows of equal keys follow one another in any order."""
    same = [F.col(f"_d.{c}").eqNullSafe(F.col(f"_p.{c}")) for c in order]
    j = df.alias("_d").join(positions.alias("_p"), same).select("_d.*", "_p._n", "_p._at")
    again = F.row_number().over(Window.partitionBy(*order).orderBy(F.lit(0))) - 1
    once = j.where("_n = 1").select(*df.columns, F.col("_at").alias(out))
    more = j.where("_n > 1").select(*df.columns, (F.col("_at") + again).alias(out))
    return once.unionByName(more) if positions.where("_n > 1").limit(1).count() else once


def row_index(df: DataFrame, order: Sequence[str], partitions: int | None = None,
              out: str = "row_index") -> DataFrame:
    """Distributed 0-based row position in ``order``. The key columns alone are
    range-partitioned, sorted and materialised (``_positions``); the rows are
    joined to them. No single-partition window over the data, and no row is
    written anywhere."""
    positions, _ = _positions(df, order, partitions)
    return _indexed(df, order, positions, out)


def chrono_split(df: DataFrame, order: Sequence[str], ratios: Sequence[float] = (0.8, 0.1)) -> DataFrame:
    """PRD-12: chronological split by row position: the first int(N r1) rows
    train, the next int(N r2) validation, the rest test (ratios (0.85,) or
    (0.8,) give a two-way split)."""
    positions, total = _positions(df, order)
    b1 = math.floor(total * float(ratios[0]))
    label = F.when(F.col("row_index") < b1, "train")
    if len(ratios) > 1:
        label = label.when(F.col("row_index") < b1 + math.floor(total * float(ratios[1])), "val")
    return _indexed(df, order, positions, "row_index").withColumn("split", label.otherwise("test"))


def class_report(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """ML-05: per class precision, recall, F1 and support, plus a macro-average
    row; the confusion matrix comes from the same (label, prediction) counts."""
    cm = scored.groupBy(F.col(label).alias("l"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    # Each count is a row of its label's class and one of its prediction's class, so the rows are read once.
    as_label, known = F.col("at") == 0, F.col("cls").isNotNull()
    total = lambda which: F.coalesce(F.sum(F.when(which & known, F.col("n"))), F.lit(0))
    r = (cm.select("n", (F.col("l") == F.col("p")).alias("hit"), F.posexplode(F.array("l", "p")).alias("at", "cls"))
         .groupBy("cls").agg(total(as_label).alias("support"), total(~as_label).alias("predicted"), total(as_label & F.col("hit")).alias("tp")))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    r = r.select(F.col("cls").cast("string").alias("cls"), prec.alias("precision"), rec.alias("recall"),
                 F.col("support").cast("long").alias("support"))
    r = r.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    # The average reads the same shuffled counts as the classes (no filter sets the two apart).
    macro = r.agg(F.lit("macro avg").alias("cls"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.sum("support").alias("support"), F.avg("f1").alias("f1"))
    return r.unionByName(macro)


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """ML-05 confusion counts (label, prediction, n)."""
    return scored.groupBy(F.col(label).alias("label"), F.col(pred).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"))
