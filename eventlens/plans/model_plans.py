"""Registered queries: online and candle features, feature alignment,
training corpora, review loop, MLlib training, exports."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import sinks
from eventlens.operators import corpora as C
from eventlens.operators import features as X
from eventlens.operators import ml as ML
from eventlens.plans.base import ARTICLE_AS_OF, EVENT_AS_OF, plan
from eventlens.plans.feature_plans import CHAIN as FEATURE_CHAIN
from eventlens.plans.feature_plans import CHAIN as FEATURE_CHAIN
from eventlens.plans.feature_plans import _labelled
from eventlens.plans.source_plans import _land_gdelt, _scratch, gdelt_full_sql
from eventlens.sources import events as SE
from eventlens.sources import payloads as SP


@plan("fea09_latest_features", oracle=f"""
    WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC) AS rn FROM f_bar)
                  WHERE rn <= 30),
         daily AS (SELECT asset_id, CAST(ts AS DATE) AS date, arg_max(close, ts) AS close FROM last GROUP BY 1, 2),
         m AS (SELECT *, coalesce(ln(close / lag(close, 7) OVER w), 0.0) AS return_7d,
                      coalesce(ln(close / lag(close, 1) OVER w), 0.0) AS return_1d,
                      close / lag(close, 1) OVER w - 1 AS _pct
               FROM daily WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
         m2 AS (SELECT *, coalesce(stddev_samp(_pct) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 0.0) AS volatility_7d,
                       coalesce(avg(close) OVER (w ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), 0.0) AS ma_14
                FROM m WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
         market AS (SELECT asset_id, arg_max({{'return_7d': return_7d, 'return_1d': return_1d,
                                               'volatility_7d': volatility_7d, 'ma_14': ma_14}}, date) AS r
                    FROM m2 GROUP BY 1),
         ev AS (SELECT i.asset_id, CAST(e.published_at AS DATE) AS date,
                       coalesce(CASE WHEN i.impact_strength <> 0 THEN i.impact_strength END, 0.0) AS s,
                       coalesce(CASE WHEN e.goldstein <> 0 THEN e.goldstein END, 0.0) AS g
                FROM f_impact i JOIN f_event e USING (event_id)
                WHERE e.published_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 14 DAY),
         dly AS (SELECT asset_id, date, count(s) AS event_count, avg(s) AS avg_sentiment, max(abs(g)) AS max_abs_goldstein,
                        max(abs(s)) AS max_abs_sentiment FROM ev GROUP BY 1, 2),
         cal AS (SELECT a.asset_id, CAST(d AS DATE) AS date
                 FROM (SELECT DISTINCT asset_id FROM dly) a,
                      range(CAST(TIMESTAMP '{EVENT_AS_OF}' AS DATE) - 13, CAST(TIMESTAMP '{EVENT_AS_OF}' AS DATE) + 1,
                            INTERVAL 1 DAY) t(d)),
         d AS (SELECT c.asset_id, c.date, coalesce(x.event_count, 0) AS event_count,
                      coalesce(x.avg_sentiment, 0.0) AS avg_sentiment, coalesce(x.max_abs_goldstein, 0.0) AS max_abs_goldstein,
                      coalesce(x.max_abs_sentiment, 0.0) AS max_abs_sentiment
               FROM cal c LEFT JOIN dly x USING (asset_id, date)),
         d2 AS (SELECT *, coalesce(avg_sentiment - lag(avg_sentiment) OVER w, 0.0) AS sentiment_momentum,
                       CAST(event_count > avg(event_count) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS INTEGER) AS event_spike,
                       coalesce(lag(max_abs_sentiment, 1) OVER w, 0.0) AS max_sent_lag_1,
                       coalesce(lag(max_abs_sentiment, 2) OVER w, 0.0) AS max_sent_lag_2
                FROM d WINDOW w AS (PARTITION BY asset_id ORDER BY date)),
         evf AS (SELECT * FROM d2 WHERE date = CAST(TIMESTAMP '{EVENT_AS_OF}' AS DATE))
    SELECT m.asset_id, m.r.return_7d AS return_7d, m.r.return_1d AS return_1d, m.r.volatility_7d AS volatility_7d,
           m.r.ma_14 AS ma_14, CAST(coalesce(e.event_count, 0) AS BIGINT) AS event_count,
           coalesce(e.event_spike, 0) AS event_spike, coalesce(sign(e.sentiment_momentum), 0.0) AS sentiment_trend,
           coalesce(e.max_abs_goldstein, 0.0) AS max_abs_goldstein, coalesce(e.max_sent_lag_1, 0.0) AS max_sent_lag_1,
           coalesce(e.max_sent_lag_2, 0.0) AS max_sent_lag_2, coalesce(e.sentiment_momentum, 0.0) AS sentiment_momentum,
           coalesce(e.sentiment_momentum, 0.0) * m.r.volatility_7d AS sentiment_x_volatility,
           coalesce(e.event_count, 0) * m.r.return_1d AS event_x_return, 0.5 AS vol_rank,
           TIMESTAMP '{EVENT_AS_OF}' AS ts
    FROM market m LEFT JOIN evf e USING (asset_id)""")
def fea09(t):
    """FEA-09: online feature row per asset at the end of the event history."""
    return X.latest_features(t.bar, t.event, t.impact, EVENT_AS_OF)


def _klines(t):
    return t.kline


_CANDLE_SQL = """
    WITH k0 AS (
      SELECT *, close / lag(close, 1) OVER w - 1 AS ret_1, close / lag(close, 3) OVER w - 1 AS ret_3,
             close / lag(close, 6) OVER w - 1 AS ret_6, close / lag(close, 24) OVER w - 1 AS ret_24
      FROM f_kline WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    k1 AS (
      SELECT *,
        CASE WHEN count(ret_1) OVER w6 = 6 THEN stddev_samp(ret_1) OVER w6 END AS vol_6,
        CASE WHEN count(ret_1) OVER w24 = 24 THEN stddev_samp(ret_1) OVER w24 END AS vol_24,
        (high - low) / nullif(close, 0) AS range_pct, (close - open) / nullif(open, 0) AS body_pct,
        (volume - CASE WHEN count(volume) OVER w24 = 24 THEN avg(volume) OVER w24 END)
          / nullif(CASE WHEN count(volume) OVER w24 = 24 THEN stddev_samp(volume) OVER w24 END, 0) AS volume_z24,
        ln(1 + greatest(CAST(num_trades AS DOUBLE), 0.0)) AS num_trades_log,
        greatest(0.0, least(1.0, taker_buy_volume / nullif(volume, 0))) AS taker_buy_ratio,
        sin(2 * pi() * hour(open_time) / 24.0) AS hour_sin, cos(2 * pi() * hour(open_time) / 24.0) AS hour_cos,
        sin(2 * pi() * (isodow(open_time) - 1) / 7.0) AS dow_sin, cos(2 * pi() * (isodow(open_time) - 1) / 7.0) AS dow_cos
      FROM k0
      WINDOW w6 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 5 PRECEDING AND CURRENT ROW),
             w24 AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


@plan("fea10_candle_features", oracle=_CANDLE_SQL + " SELECT * FROM k1")
def fea10(t):
    """FEA-10: candle features of the hourly klines."""
    return X.candle_features(_klines(t))


_CANDLE_ROWS = """
    SELECT symbol, open_time, ret_1, ret_3, ret_6, ret_24, vol_6, vol_24, range_pct, body_pct, volume_z24,
           num_trades_log, taker_buy_ratio, hour_sin, hour_cos, dow_sin, dow_cos, future_ret_1h,
           CASE WHEN future_ret_1h > 0.001 THEN 'up' WHEN future_ret_1h < -0.001 THEN 'down' ELSE 'flat' END AS label
    FROM (SELECT *, lead(close) OVER (PARTITION BY symbol ORDER BY open_time) / close - 1.0 AS future_ret_1h FROM k1)
    WHERE ret_1 IS NOT NULL AND ret_3 IS NOT NULL AND ret_6 IS NOT NULL AND ret_24 IS NOT NULL
      AND vol_6 IS NOT NULL AND vol_24 IS NOT NULL AND range_pct IS NOT NULL AND body_pct IS NOT NULL
      AND volume_z24 IS NOT NULL AND num_trades_log IS NOT NULL AND taker_buy_ratio IS NOT NULL
      AND future_ret_1h IS NOT NULL"""


@plan("fea11_candle_training", oracle=_CANDLE_SQL + _CANDLE_ROWS)
def fea11(t):
    """FEA-11: labelled candle rows (next-bar return at +-0.001)."""
    return X.candle_training(_klines(t)).select("symbol", "open_time", *X.CANDLE_FEATURES, "future_ret_1h", "label")


@plan("fea11_candle_latest", oracle=_CANDLE_SQL + """
    SELECT symbol, r.* FROM (
      SELECT symbol, arg_max({'open_time': open_time, 'ret_1': ret_1, 'ret_3': ret_3, 'ret_6': ret_6,
                              'ret_24': ret_24, 'vol_6': vol_6, 'vol_24': vol_24, 'range_pct': range_pct,
                              'body_pct': body_pct, 'volume_z24': volume_z24, 'num_trades_log': num_trades_log,
                              'taker_buy_ratio': taker_buy_ratio, 'hour_sin': hour_sin, 'hour_cos': hour_cos,
                              'dow_sin': dow_sin, 'dow_cos': dow_cos}, open_time) AS r
      FROM k1
      WHERE ret_1 IS NOT NULL AND ret_3 IS NOT NULL AND ret_6 IS NOT NULL AND ret_24 IS NOT NULL
        AND vol_6 IS NOT NULL AND vol_24 IS NOT NULL AND range_pct IS NOT NULL AND body_pct IS NOT NULL
        AND volume_z24 IS NOT NULL AND num_trades_log IS NOT NULL AND taker_buy_ratio IS NOT NULL
        AND symbol IN (SELECT symbol FROM f_kline GROUP BY 1 HAVING count(*) >= 48)
      GROUP BY symbol)""")
def fea11b(t):
    """FEA-11: latest complete candle feature row per symbol."""
    return X.candle_latest(_klines(t))


@plan("fea14_align_features", oracle="""
    SELECT coalesce(CAST(volatility_7d AS DOUBLE), 0.0) AS "7d_vol",
           coalesce(CAST(sentiment_momentum AS DOUBLE), 0.0) AS sentiment_momentum,
           0.0::DOUBLE AS symbol_BTCUSDT, coalesce(CAST(event_count AS DOUBLE), 0.0) AS event_count
    FROM o_label WHERE abs(coalesce(volatility_7d, 0.0)) <= 5""", extra_ctes=FEATURE_CHAIN)
def fea14(t):
    """FEA-14: labelled rows aligned to a saved feature order (missing one-hot column padded)."""
    d = _labelled(t).withColumnRenamed("volatility_7d", "7d_vol")
    return X.align_features(d, ["7d_vol", "sentiment_momentum", "symbol_BTCUSDT", "event_count"])


# ---------------------------------------------------------------------------
# review loop and corpora
# ---------------------------------------------------------------------------

def _examples(t):
    return C.training_examples(t.event, t.event_article, t.article, t.review_action, t.tag, t.impact, t.asset)


@plan("prd13_training_examples", oracle="""
    WITH ev AS (SELECT *, CASE WHEN status = 'human_approved' THEN 'approve' ELSE 'reject' END AS review_action
                FROM f_event WHERE status IN ('human_approved', 'rejected')),
         rev AS (SELECT event_id, action AS review_action, arg_max(reviewer_id, (created_at, action_id)) AS reviewer_id
                 FROM f_review_action GROUP BY 1, 2),
         tg AS (SELECT event_id, list_sort(list(tag)) AS tags FROM f_tag GROUP BY 1)
    SELECT ev.event_id, l.article_id, rev.reviewer_id, ev.review_action,
           CASE WHEN ev.status = 'human_approved' THEN ev.event_type END AS label_event_type,
           ev.status AS label_status, a.lang AS language_code, ev.title, a.title AS article_title,
           coalesce(tg.tags, []) AS tags
    FROM ev JOIN rev USING (event_id, review_action) JOIN f_event_article l USING (event_id)
    JOIN f_article a ON a.article_id = l.article_id LEFT JOIN tg USING (event_id)""")
def prd13(t):
    """PRD-13: training examples from reviewed events and their articles."""
    return _examples(t).select("event_id", "article_id", "reviewer_id", "review_action", "label_event_type",
                               "label_status", "language_code", "title", "article_title", "tags")


@plan("prd14_apply_reviews", oracle="""
    WITH d AS (SELECT event_id, arg_max(action, (created_at, action_id)) AS action FROM f_review_action GROUP BY 1)
    SELECT e.event_id, e.title,
           CASE WHEN d.action = 'approve' THEN 'human_approved' WHEN d.action = 'reject' THEN 'rejected'
                ELSE e.status END AS status
    FROM f_event e LEFT JOIN d USING (event_id)""")
def prd14(t):
    """PRD-14: the latest review action of every event applied (no field edits in the fixture)."""
    dec = t.review_action.select("event_id", "action_id", "action", "reviewer_id", "created_at",
                                 *[F.lit(None).cast(tp).alias(c) for c, tp in
                                   [("title", "string"), ("description", "string"), ("event_type", "string"),
                                    ("country", "string"), ("region", "string"), ("severity", "int"),
                                    ("confidence_score", "double")]])
    ev, _ = C.apply_reviews(t.event, dec)
    return ev.select("event_id", "title", "status")


@plan("prd14_review_audit", oracle="""
    SELECT e.event_id, r.reviewer_id, r.action, e.status AS from_status,
           CASE WHEN r.action = 'approve' THEN 'human_approved' WHEN r.action = 'reject' THEN 'rejected'
                ELSE e.status END AS to_status,
           '{"title":"Edited ' || e.event_id || '","severity":' || (e.event_id % 7) || '}' AS changes,
           r.created_at
    FROM f_event e JOIN f_review_action r USING (event_id)""")
def prd14b(t):
    """PRD-14: audit rows of the applied reviews."""
    dec = t.review_action.select("event_id", "action_id", "action", "reviewer_id", "created_at",
                                 F.concat(F.lit("Edited "), F.col("event_id").cast("string")).alias("title"),
                                 F.lit(None).cast("string").alias("description"),
                                 F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("country"),
                                 F.lit(None).cast("string").alias("region"), (F.col("event_id") % 7).cast("int").alias("severity"),
                                 F.lit(None).cast("double").alias("confidence_score"))
    return C.apply_reviews(t.event, dec)[1]


_EX_SQL = """
    WITH ev AS (SELECT *, CASE WHEN status = 'human_approved' THEN 'approve' ELSE 'reject' END AS review_action
                FROM f_event WHERE status IN ('human_approved', 'rejected')),
         rev AS (SELECT event_id, action AS review_action FROM f_review_action GROUP BY 1, 2),
         ex AS (SELECT ev.event_id, l.article_id, ev.status AS label_status, ev.created_at,
                       trim(array_to_string(list_filter([trim(coalesce(a.title, '')), trim(coalesce(a.content, ''))],
                                                        lambda x: x <> ''), chr(10))) AS text
                FROM ev JOIN rev USING (event_id, review_action) JOIN f_event_article l USING (event_id)
                JOIN f_article a ON a.article_id = l.article_id),
         dirs AS (SELECT event_id, list(impact_direction) AS d FROM f_impact GROUP BY 1)
    """


@plan("prd15_corpora_relevance", oracle=_EX_SQL + """
    SELECT event_id || '-' || article_id AS id, text, CAST(label_status = 'human_approved' AS INTEGER) AS label,
           created_at FROM ex WHERE text <> ''""")
def prd15(t):
    """PRD-15: relevance corpus from the training examples."""
    return C.corpora_from_examples(_examples(t))["relevance"]


@plan("prd15_corpora_sentiment", oracle=_EX_SQL + """
    SELECT event_id || '-' || article_id AS id, text,
           CASE WHEN list_contains(d, 'negative') THEN 'negative' WHEN list_contains(d, 'positive') THEN 'positive'
                ELSE 'neutral' END AS label, created_at
    FROM ex JOIN dirs USING (event_id) WHERE text <> '' AND len(d) > 0""")
def prd15b(t):
    """PRD-15: sentiment corpus from the examples' impact directions."""
    return C.corpora_from_examples(_examples(t))["sentiment"]


def _history(t):
    return SE.normalize_gdelt(SE.read_gdelt(t.spark, _land_gdelt(t)))


@plan("prd16_corpora_history", oracle=gdelt_full_sql("""
    , b AS (SELECT *, row_number() OVER (ORDER BY published_at, canonical_id) - 1 AS idx,
                  trim(array_to_string(list_filter([trim(title), trim(description)], lambda x: x <> ''), chr(10))) AS text
           FROM g)
    SELECT canonical_id AS id, text, 1 AS label, published_at AS created_at FROM b WHERE text <> ''
    UNION ALL
    SELECT canonical_id || '-neg', [{tpl}][idx % 4 + 1], 0, published_at FROM b WHERE text <> ''
    """.replace("{tpl}", ", ".join("'" + x + "'" for x in C.NEGATIVE_RELEVANCE_TEMPLATES))))
def prd16(t):
    """PRD-16: relevance corpus (positives and template negatives) from normalised history."""
    return C.corpora_from_history(_history(t))["relevance"]


@plan("prd16_weak_tags", oracle=gdelt_full_sql("""
    SELECT canonical_id AS id, trim(array_to_string(list_filter([trim(title), trim(description)], lambda x: x <> ''),
                                                    chr(10))) AS text,
           list_distinct_ordered AS tags, published_at AS created_at
    FROM (SELECT *, list_slice(list_filter(
                      [c FOR c IN list_transform([country, location_name, actor1, actor2, event_type, sub_event_type],
                                                 lambda x: left(regexp_replace(trim(coalesce(x, '')), '\\s+', ' ', 'g'), 80))
                       IF c <> ''], lambda x: true), 1, 14) AS raw_tags
          FROM g) q, LATERAL (SELECT list_filter(raw_tags, lambda x, i: list_position(raw_tags, x) = i)
                                AS list_distinct_ordered)"""))
def prd16b(t):
    """PRD-16: weak-tag corpus from normalised history."""
    return C.corpora_from_history(_history(t), ["weak_ner"])["weak_ner"]


@plan("prd17_pair_articles", oracle=gdelt_full_sql("""
    , h AS (SELECT *, '2024-01-' || event_date[9:10] || 'T00:00:00Z' AS pub,
                   CASE WHEN is_reuters THEN 'reuters' ELSE provider END AS prov FROM g),
    firsts AS (SELECT pub[1:10] AS day, arg_min({'id': provider_record_id, 'event_type': event_type,
                                                 'event_date': event_date, 'country': country}, canonical_id) AS c
               FROM h GROUP BY 1)
    SELECT 'reuters-' || canonical_id AS pair_id, 'reuters' AS provider, title AS article_title,
           description AS article_text, pub AS article_published_at, provider_record_id AS gdelt_event_id,
           event_type AS gdelt_event_type, event_date AS gdelt_event_date, country AS gdelt_country
    FROM h WHERE prov = 'reuters'
    UNION ALL
    SELECT 'news-' || a.article_id, a.source, a.title, a.content, strftime(a.published_at, '%Y-%m-%dT%H:%M:%S'),
           f.c.id, f.c.event_type, f.c.event_date, f.c.country
    FROM f_article a JOIN firsts f ON f.day = strftime(a.published_at, '%Y-%m-%d')
    WHERE a.published_at IS NOT NULL AND (a.source ILIKE '%reuters%' OR a.source ILIKE '%ap%')"""))
def prd17(t):
    """PRD-17: Reuters history rows and Reuters/AP articles paired with same-day history events."""
    h = _history(t)
    shifted = h.withColumn("published_at", F.concat(F.lit("2024-01-"), F.substring("event_date", 9, 2),
                                                    F.lit("T00:00:00Z")))
    return C.pair_articles(shifted.withColumn("provider", F.when(F.col("source_name").contains("reuters"), "reuters")
                                              .otherwise(F.col("provider"))), t.article)


@plan("prd18_weak_label_frame", oracle=gdelt_full_sql("""
    SELECT text, label, lower(coalesce(event_type, 'unknown')) AS event_type, lower(coalesce(country, 'unknown')) AS country,
           lower(coalesce(provider, 'unknown')) AS provider, sentiment_score, CAST(num_mentions AS DOUBLE) AS num_mentions,
           CAST(num_articles AS DOUBLE) AS num_articles, CAST(num_sources AS DOUBLE) AS num_sources,
           CAST(hour(CAST(published_at[1:10] AS TIMESTAMP)) AS INTEGER) AS published_hour,
           CAST(isodow(CAST(published_at[1:10] AS TIMESTAMP)) - 1 AS INTEGER) AS published_dow
    FROM (SELECT *, CASE WHEN sentiment_score >= 1.5 THEN 'up' WHEN sentiment_score <= -1.5 THEN 'down'
                         WHEN sentiment_score IS NOT NULL THEN 'neutral' END AS label,
                 trim(coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(actor1, '')
                      || ' ' || coalesce(actor2, '')) AS text FROM g)
    WHERE label IS NOT NULL AND length(text) > 0"""))
def prd18(t):
    """PRD-18: weak-label training frame from normalised history (threshold 1.5)."""
    return C.weak_label_frame(_history(t), 1.5)


# ---------------------------------------------------------------------------
# MLlib
# ---------------------------------------------------------------------------

def _split_sql(rows: str, ratio: float, extra: str = "") -> str:
    """Sizes of the ordered split; a model must beat the most frequent class of its training rows."""
    return (f"SELECT CAST(floor(n * {ratio}) AS BIGINT) AS train_rows, CAST(n - floor(n * {ratio}) AS BIGINT) AS test_rows,"
            f" true AS learned{extra} FROM (SELECT count(*) AS n FROM {rows})")


def _checked(metrics, extra=()):
    return metrics.select("train_rows", "test_rows", (F.col("accuracy") >= F.col("majority_accuracy")).alias("learned"), *extra)


@plan("ml01_train_text", oracle=_split_sql("f_article", 0.85))
def ml01(t):
    """ML-01: TF-IDF + balanced logistic regression on the news categories of all articles: split sizes, better than the majority."""
    from eventlens.functions import text as T
    a = t.article.select("article_id", "created_at", T.article_text().alias("text"),
                         T.news_category().alias("label"))
    return _checked(ML.train_text(a, ["created_at", "article_id"])[1])


_HISTORY_ROWS = gdelt_full_sql("""
    SELECT 1 FROM (SELECT *, CASE WHEN sentiment_score IS NOT NULL THEN 1 END AS label,
                          trim(coalesce(title, '') || chr(10) || coalesce(description, '') || chr(10) || coalesce(actor1, '')
                               || ' ' || coalesce(actor2, '')) AS text FROM g)
    WHERE label IS NOT NULL AND length(text) > 0""")


@plan("ml02_train_mixed", oracle=_split_sql(f"({_HISTORY_ROWS})", 0.8))
def ml02(t):
    """ML-02: weak-label mixed classifier (text + categoricals + numerics) on normalised history: split sizes, better than the majority."""
    w = C.weak_label_frame(_history(t), 1.5).withColumn("_o", F.sha2(F.col("text"), 256))
    return _checked(ML.train_mixed(w, ["_o"], ["event_type", "country", "provider"],
                                   ["num_mentions", "num_articles", "num_sources", "published_hour"])[1])


@plan("ml03_train_breakout", oracle=_split_sql("o_label", 0.8, ", 11 AS features, 1.0::DOUBLE AS importance").replace(" true AS learned,", ""),
      extra_ctes=FEATURE_CHAIN)
def ml03(t):
    """ML-03: boosted-tree breakout classifier on the labelled dataset: split sizes, features and their importance in all."""
    _, metrics, imp = ML.train_breakout(X.edge_signals(_labelled(t)), ["date", "symbol"], max_iter=20)
    total = imp.agg(F.count(F.lit(1)).cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("importance"))
    return metrics.crossJoin(total).select("train_rows", "test_rows", "features", "importance")  # one row each


def _forest(t, trees: int, relabel=None):
    d = X.candle_training(_klines(t))
    d = d if relabel is None else relabel(d)
    syms = ["K0", "K1", "K2", "K3", "K4"]
    d = d.select("*", *[(F.col("symbol") == s).cast("double").alias(f"sym_{s}") for s in syms])
    return ML.train_forest(d, ["open_time", "symbol"], X.CANDLE_FEATURES + [f"sym_{s}" for s in syms], num_trees=trees)


@plan("ml04_train_forest", oracle=_CANDLE_SQL + f"""
    SELECT CAST(floor(n * 0.8) AS BIGINT) AS train_rows, CAST(n - floor(n * 0.8) AS BIGINT) AS test_rows, k AS n_classes
    FROM (SELECT count(*) AS n, count(DISTINCT label) AS k FROM ({_CANDLE_ROWS}))""")
def ml04(t):
    """ML-04: random-forest direction classifier (120 trees) on candle features (symbol one-hot): split sizes and classes."""
    return _forest_sizes(_forest(t, 120))


def _forest_sizes(fitted):
    model, report, metrics = fitted
    return metrics.select("train_rows", "test_rows", F.lit(model.stages[-1].numClasses - 1).cast("bigint").alias("n_classes"))


@plan("ml04_train_regime", oracle="""
    SELECT CAST(floor(n * 0.8) AS BIGINT) AS train_rows, CAST(n - floor(n * 0.8) AS BIGINT) AS test_rows, 3 AS n_classes
    FROM (SELECT count(*) AS n FROM f_impact i JOIN f_event e USING (event_id) WHERE e.severity IS NOT NULL AND i.confidence_score IS NOT NULL)""")
def ml04b(t):
    """ML-04: regime filter (50 trees of depth 3) on sentiment and severity with the one-hour return label: split sizes and classes."""
    from eventlens.operators import market as M
    return _forest_sizes(ML.train_regime(M.event_returns(t.impact, t.event, t.bar), ["event_id", "asset_id"]))


# ---------------------------------------------------------------------------
# sinks and remaining payload parsers
# ---------------------------------------------------------------------------

@plan("snk02_export_jsonl", oracle="""
    WITH ev AS (SELECT *, CASE WHEN status = 'human_approved' THEN 'approve' ELSE 'reject' END AS review_action
                FROM f_event WHERE status IN ('human_approved', 'rejected')),
         rev AS (SELECT event_id, action AS review_action, arg_max(reviewer_id, (created_at, action_id)) AS reviewer_id
                 FROM f_review_action GROUP BY 1, 2)
    SELECT ev.event_id, l.article_id, rev.reviewer_id, ev.review_action, ev.status AS label_status, a.lang AS language_code,
           a.title AS article_title, length(a.content) AS content_chars
    FROM ev JOIN rev USING (event_id, review_action) JOIN f_event_article l USING (event_id) JOIN f_article a ON a.article_id = l.article_id""")
def snk02(t):
    """SNK-02: training examples exported newest first as JSON lines and read back."""
    path = _scratch(t, "examples")
    sinks.export_jsonl(_examples(t), path)
    back = t.spark.read.json(path)
    return back.select("event_id", "article_id", "reviewer_id", "review_action", "label_status", "language_code", "article_title",
                       F.length("article_content").cast("bigint").alias("content_chars"))


@plan("snk03_export_dataset", oracle="SELECT symbol, date, close, return_1d, target FROM o_label", extra_ctes=FEATURE_CHAIN)
def snk03(t):
    """SNK-03: labelled dataset exported as CSV with its metadata record; the rows read back."""
    path = _scratch(t, "dataset")
    rows = _labelled(t).select("symbol", "date", "close", "return_1d", "target")
    sinks.export_dataset(rows, path)
    return t.spark.read.option("header", True).schema(rows.schema).csv(path + "/dataset")


@plan("snk03_dataset_meta", oracle="""
    SELECT count(*) AS n_samples, CAST(min(date) AS VARCHAR) AS "start", CAST(max(date) AS VARCHAR) AS "end", 5 AS n_features,
           count(*) FILTER (WHERE target = 0) AS class_0, count(*) FILTER (WHERE target = 1) AS class_1, count(close) AS closes
    FROM o_label""", extra_ctes=FEATURE_CHAIN)
def snk03b(t):
    """SNK-03: the dataset's metadata record (rows, dates, classes, given statistics), read back."""
    path = _scratch(t, "dataset")
    rows = _labelled(t).select("symbol", "date", "close", "return_1d", "target")
    sinks.export_dataset(rows, path, stats=rows.agg(F.count("close").alias("closes")))
    kinds = "n_samples bigint, start string, end string, n_features int, class_distribution map<string,bigint>, stats array<struct<closes:bigint>>"
    m = t.spark.read.text(path + "/dataset_meta").select(F.from_json("value", kinds).alias("m")).select("m.*")
    return m.select("n_samples", "start", "end", "n_features", F.col("class_distribution")["0"].alias("class_0"),
                    F.col("class_distribution")["1"].alias("class_1"), F.col("stats")[0]["closes"].alias("closes"))


@plan("src12_fundamentals", oracle="""
    SELECT 'S' || s_suppkey AS ticker, s_acctbal * 1e6 AS market_cap, CAST(s_suppkey % 40 + 5 AS DOUBLE) AS pe_ratio,
           s_acctbal / 1000 AS eps, CASE WHEN s_suppkey % 3 = 1 THEN (s_suppkey % 7) / 100.0::DOUBLE END AS dividend_yield,
           s_acctbal AS week_52_high, s_acctbal / 2 AS week_52_low
    FROM supplier WHERE s_suppkey % 3 <> 2""")
def src12(t):
    """SRC-12: fundamentals payloads of both providers (polygon for a third of the suppliers, finnhub for another; the last has no metrics) parsed back."""
    s = t.raw("supplier").withColumn("ticker", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")))
    figures = [(F.col("s_acctbal") * 1e6), (F.col("s_suppkey") % 40 + 5), (F.col("s_acctbal") / 1000)]
    range_ = [F.col("s_acctbal"), F.col("s_acctbal") / 2]
    named = lambda cols, names: F.struct(*[c.alias(n) for c, n in zip(cols, names)])
    polygon = named([*figures, F.lit("n/a"), *range_], ["market_cap", "pe_ratio", "eps", "dividend_yield", "week_52_high", "week_52_low"])
    finnhub = named([*figures, (F.col("s_suppkey") % 7) / 100.0, *range_],
                    ["marketCapitalization", "peTTM", "epsTTM", "dividendYieldIndicatedAnnual", "52WeekHigh", "52WeekLow"])
    kind = F.col("s_suppkey") % 3
    first = s.where(kind == 0).select("ticker", F.to_json(F.struct(polygon.alias("results"))).alias("payload"))
    other = s.where(kind > 0).select("ticker", F.when(kind == 1, F.to_json(F.struct(finnhub.alias("metric")))).otherwise('{"metric":{}}').alias("payload"))
    return SP.normalize_fundamentals(first).unionByName(SP.normalize_fundamentals(other, "finnhub"))


@plan("src14_latest_filing", oracle="""
    WITH r AS (SELECT o_custkey % 50 AS cik, date_trunc('year', o_orderdate) AS y, o_orderdate AS d,
                      ['8-K', '10-K', '10-Q', '20-F'][o_orderkey % 4 + 1] AS form,
                      '0000' || o_orderkey || '-24' AS acc, 'doc' || o_orderkey || '.htm' AS doc FROM orders),
         g AS (SELECT cik, y, arg_min({'acc': acc, 'doc': doc, 'd': d}, (-epoch_us(d), form, acc, doc))
                        FILTER (WHERE form IN ('10-K', '20-F')) AS f
               FROM r GROUP BY 1, 2)
    SELECT cik, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(f.acc, '-', '') || '/' || f.doc AS url,
           CAST(f.d AS DATE) AS filing_date
    FROM g""")
def src14(t):
    """SRC-14: newest 10-K/20-F per company from parallel filing arrays built from orders."""
    o = t.raw("orders")
    forms = F.element_at(F.array(*[F.lit(x) for x in ["8-K", "10-K", "10-Q", "20-F"]]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = o.select((F.col("o_custkey") % 50).alias("cik"), F.col("o_orderdate").alias("d"), forms.alias("form"),
                    F.concat(F.lit("0000"), F.col("o_orderkey").cast("string"), F.lit("-24")).alias("acc"),
                    F.concat(F.lit("doc"), F.col("o_orderkey").cast("string"), F.lit(".htm")).alias("doc"))
    srt = rows.groupBy("cik", F.date_trunc("year", "d").alias("y")).agg(F.sort_array(F.collect_list(F.struct(
        (-F.unix_micros("d")).alias("k"), "form", "acc", "doc", F.date_format("d", "yyyy-MM-dd").alias("date"))))
        .alias("r"))
    p = srt.select("cik", F.to_json(F.struct(F.struct(F.struct(
        F.col("r.form").alias("form"), F.col("r.acc").alias("accessionNumber"), F.col("r.doc").alias("primaryDocument"),
        F.col("r.date").alias("filingDate")).alias("recent")).alias("filings"))).alias("payload"))
    return SP.latest_filing(p)
