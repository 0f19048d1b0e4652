"""Registered queries: market snapshot logic, provider statistics, heatmap
extras, quality metrics, boards, quotas, review views and alerts."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.operators import aggregates as A
from eventlens.operators import alerts as AL
from eventlens.operators import events as EV
from eventlens.operators import filters as FL
from eventlens.operators import serving as S
from eventlens.plans.aggregate_plans import COORDS_CTE
from eventlens.plans.base import ARTICLE_AS_OF, EVENT_AS_OF, plan
from eventlens.plans.text_sql import inlist, q

SNAP_AS_OF = "1999-12-01 00:00:00"


def _snapshot(t):
    return S.choose_quote(t.asset, t.quote, t.last_good)


_PRIO = ", ".join(f"('{a}', '{p}', {i})" for a, p, i in S.QUOTE_PRIORITY)
_SNAP_SQL = f"""
    WITH pr AS (SELECT * FROM (VALUES {_PRIO}) t(asset_type, provider, priority)),
         best AS (SELECT q.asset_id, arg_min({{'price': q.price, 'change': q.change, 'as_of': q.as_of,
                                              'source': q.provider}}, pr.priority) AS b
                  FROM f_quote q JOIN f_asset a USING (asset_id) JOIN pr ON pr.asset_type = a.asset_type
                                 AND pr.provider = q.provider
                  WHERE q.price IS NOT NULL AND q.price <> 0 GROUP BY 1),
         snap AS (SELECT a.asset_id, a.ticker, a.asset_type,
                         coalesce(best.b, {{'price': lg.price, 'change': lg.change, 'as_of': lg.as_of,
                                           'source': 'last_good'}}) AS b
                  FROM f_asset a LEFT JOIN best USING (asset_id) LEFT JOIN f_last_good lg USING (asset_id))
    SELECT asset_id, ticker, asset_type, b.price AS price, b.change AS change, b.as_of AS as_of, b.source AS source
    FROM snap WHERE b IS NOT NULL"""


@plan("mkt05_choose_quote", oracle=_SNAP_SQL)
def mkt05(t):
    """MKT-05: provider fallback snapshot with last-good fallback."""
    return _snapshot(t)


@plan("mkt06_epoch_minute", oracle="""
    SELECT event_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS ts_s,
           make_timestamp(epoch_us(ts) // 1000 * 1000) AS ts_ms, make_timestamp(epoch_us(ts)) AS ts_us,
           make_timestamp(epoch_us(ts)) AS ts_ns, date_trunc('minute', ts) AS minute
    FROM events""")
def mkt06(t):
    """MKT-06: epoch decoding of event times given in s/ms/us/ns, and minute buckets."""
    ev = t.raw("events")
    return ev.select("event_id", S.epoch_to_ts(F.unix_seconds("ts")).alias("ts_s"),
                     S.epoch_to_ts(F.unix_millis("ts")).alias("ts_ms"),
                     S.epoch_to_ts(F.unix_micros("ts")).alias("ts_us"),
                     S.epoch_to_ts(F.unix_micros("ts") * 1000).alias("ts_ns"),
                     S.minute_bucket("ts").alias("minute"))


@plan("mkt08_snapshot_coverage", oracle=f"""
    WITH s AS ({_SNAP_SQL})
    SELECT (SELECT count(*) FROM s) AS snapshot_rows, (SELECT count(*) FROM f_asset) AS assets,
           (SELECT count(*) FROM s) * 100.0 / (SELECT count(*) FROM f_asset) AS coverage_pct,
           (SELECT list({{'source': source, 'n': n}} ORDER BY source)
            FROM (SELECT source, count(*) AS n FROM s GROUP BY 1)) AS sources,
           (SELECT count(*) FROM s) * 100.0 / (SELECT count(*) FROM f_asset) < 30 AS degraded""")
def mkt08(t):
    """MKT-08: snapshot coverage, per-source counts and degraded flag."""
    return S.snapshot_coverage(_snapshot(t), t.asset)


@plan("mkt09_market_closed", oracle="""
    SELECT event_id, hour(ts) < 13 OR hour(ts) > 20 AS market_closed FROM events""")
def mkt09(t):
    """MKT-09: trading-hours flag of every event time."""
    return t.raw("events").select("event_id", S.market_closed("ts").alias("market_closed"))


_INTEL_SQL = """
    WITH j AS (SELECT i.asset_id, e.title, i.impact_direction, e.created_at, e.event_id,
                      least(1.0, coalesce(e.severity, 1) / 5.0 * (0.6 * coalesce(i.impact_strength, 0.5)
                                                                + 0.4 * coalesce(e.confidence_score, 0.5))) AS sc
               FROM f_impact i JOIN f_event e ON e.event_id = i.event_id WHERE e.status <> 'rejected'),
         l AS (SELECT asset_id, arg_max({'tag': title, 'dir': impact_direction, 'sc': sc}, (created_at, event_id)) AS r
               FROM j GROUP BY 1)
    SELECT a.asset_id, a.ticker, a.asset_type, l.r.tag AS tag, l.r.dir AS direction,
           CAST(coalesce(l.r.sc, 0.0) AS DOUBLE) AS impact_score,
           CASE WHEN l.r IS NULL THEN NULL WHEN l.r.dir = 'negative' AND l.r.sc > 0.6 THEN 'high' ELSE 'low' END AS risk
    FROM f_asset a LEFT JOIN l USING (asset_id)"""


@plan("mkt10_asset_intelligence", oracle=_INTEL_SQL)
def mkt10(t):
    """MKT-10: latest impact per asset with score, tag and risk."""
    return S.asset_intelligence(t.asset, t.impact, t.event)


@plan("mkt11_rank_snapshot", oracle=f"""
    WITH s AS ({_SNAP_SQL}), i AS ({_INTEL_SQL})
    SELECT s.asset_id, s.ticker, s.asset_type, s.change, i.impact_score,
           row_number() OVER (ORDER BY coalesce(i.impact_score, 0.0) * abs(s.change) DESC, s.ticker) AS rank
    FROM s JOIN i USING (asset_id) WHERE s.asset_type = 'stock'""")
def mkt11(t):
    """MKT-11: event-driven movers ranking of stock assets."""
    snap = _snapshot(t).join(S.asset_intelligence(t.asset, t.impact, t.event).select("asset_id", "impact_score"),
                             "asset_id")
    r = S.rank_snapshot(snap, "movers", asset_type="stock")
    return r.select("asset_id", "ticker", "asset_type", "change", "impact_score", "rank")


@plan("mkt12_merge_live", oracle="""
    WITH last AS (SELECT asset_id, max(ts) AS lt FROM f_bar GROUP BY 1),
         qq AS (SELECT q.asset_id, q.as_of + INTERVAL 30 SECOND AS qts, q.price AS qp, last.lt
                FROM (SELECT * FROM f_quote WHERE provider = 'polygon') q JOIN last USING (asset_id)),
         rep AS (SELECT *, epoch_us(qts) <= epoch_us(lt) + 60000000 AS replace FROM qq)
    SELECT b.asset_id, b.ts, b.open, b.high, b.low,
           CASE WHEN b.ts = r.lt AND coalesce(r.replace, false) THEN r.qp ELSE b.close END AS close, b.volume
    FROM f_bar b LEFT JOIN rep r USING (asset_id)
    UNION ALL
    SELECT asset_id, qts, NULL, NULL, NULL, qp, NULL FROM rep WHERE NOT replace""")
def mkt12(t):
    """MKT-12: merge of one provider's live quote (30 s after the last bar) into every bar series."""
    qt = (t.quote.where(F.col("provider") == "polygon")
          .select("asset_id", (F.col("as_of") + F.expr("INTERVAL 30 SECONDS")).alias("as_of"), "price"))
    return S.merge_live(t.bar, qt)


@plan("mkt13_watchlist_view", oracle="""
    WITH l AS (SELECT i.asset_id, arg_max({'event_id': e.event_id, 'event_title': e.title, 'event_type': e.event_type,
                                          'impact_direction': i.impact_direction, 'impact_strength': i.impact_strength,
                                          'confidence_score': i.confidence_score, 'published_at': e.published_at},
                                         (e.published_at IS NULL, e.published_at, i.created_at IS NULL, i.created_at,
                                          e.event_id)) AS li
               FROM f_impact i JOIN f_event e USING (event_id) GROUP BY 1)
    SELECT w.asset_id, w.user_id, a.ticker, a.name, a.asset_type, l.li AS latest_impact
    FROM f_watchlist w JOIN f_asset a USING (asset_id) LEFT JOIN l USING (asset_id)""")
def mkt13(t):
    """MKT-13: every watchlist row with its asset's latest impact."""
    return S.watchlist_view(t.watchlist, t.asset, t.impact, t.event)


@plan("mkt14_provider_scores", oracle="""
    SELECT provider, success, fail, skip,
           CASE WHEN success + fail = 0 THEN 1.0 ELSE success / (success + fail) END AS score,
           (success + fail >= 3 AND success >= 2
            AND CASE WHEN success + fail = 0 THEN 1.0 ELSE success / (success + fail) END < 0.6) AS unstable
    FROM (SELECT provider,
                 sum(CASE WHEN NOT coalesce(skipped, false) AND success THEN 1.0 ELSE 0.0 END)::DOUBLE AS success,
                 sum(CASE WHEN NOT coalesce(skipped, false) AND NOT success THEN coalesce(weight, 1.0) ELSE 0.0 END)::DOUBLE AS fail,
                 sum(CASE WHEN coalesce(skipped, false) THEN 1.0 ELSE 0.0 END)::DOUBLE AS skip
          FROM f_provider_log GROUP BY 1)""")
def mkt14(t):
    """MKT-14: provider scorecard from the request log."""
    return S.provider_scores(t.provider_log)


@plan("mkt15_provider_health", oracle="""
    WITH seq AS (SELECT provider, list(CAST(success AS DOUBLE) ORDER BY ts, request_id) AS s,
                        list(latency_ms ORDER BY ts, request_id) AS l, avg(CAST(success AS DOUBLE)) AS raw_rate
                 FROM f_provider_log GROUP BY 1),
         h AS (SELECT provider,
                      list_reduce(list_concat([1.0::DOUBLE], s), lambda acc, x: greatest(0.05, least(1.0, acc * 0.8 + x * 0.2))) AS score,
                      list_reduce(list_concat([200.0::DOUBLE], l), lambda acc, x: acc * 0.8 + x * 0.2) AS latency_ema,
                      raw_rate FROM seq)
    SELECT *, greatest(0.05, least(1.0, 0.5 * score + 0.3 * greatest(0.0, least(1.0, (2000 - latency_ema) / 1800))
                                     + 0.2 * raw_rate)) AS composite FROM h""")
def mkt15(t):
    """MKT-15: EMA provider health (full-sequence fold in the oracle)."""
    return S.provider_health(t.provider_log)


# ---------------------------------------------------------------------------
# heatmap extras, quality, boards
# ---------------------------------------------------------------------------

def _annotated(t):
    return FL.annotate_articles(t.article)


def _news_heatmap_sql() -> str:
    from eventlens.plans.text_plans import (_ASCII_RATIO, _TOKS, LOW, NORM, _countries_sql, _relevance_sql,
                                            _severity_sql)
    from eventlens.plans.text_sql import best_group
    lang = (f"CASE WHEN length({NORM}) = 0 OR len({_TOKS}) = 0 THEN 0.0 "
            f"WHEN {_ASCII_RATIO} >= 0.95 AND len({_TOKS}) >= 3 THEN greatest(least(0.92, 0.52 + "
            f"len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) / greatest(1, len({_TOKS})) * 1.6"
            f" + {_ASCII_RATIO} * 0.18), 0.82) ELSE least(0.92, 0.52 + "
            f"len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) / greatest(1, len({_TOKS})) * 1.6"
            f" + {_ASCII_RATIO} * 0.18) END")
    return f"""
    WITH a AS (
      SELECT *, {_countries_sql()} AS countries, {_severity_sql()} AS sev,
             coalesce(nullif(rel, 0), nullif(lc, 0), 0.62) AS conf,
             CASE WHEN category = 'conflict' THEN 1.0 ELSE 0.0 END AS cf
      FROM (SELECT *, CAST({_relevance_sql()} AS DOUBLE) AS rel, CAST({lang} AS DOUBLE) AS lc,
                   coalesce({best_group(LOW, L.NEWS_CATEGORY_KEYWORDS)}, 'general') AS category
            FROM f_article
            WHERE published_at IS NOT NULL AND published_at >= TIMESTAMP '{ARTICLE_AS_OF}' - INTERVAL 60 DAY)),
    x AS (SELECT unnest(countries) AS country, sev, conf, cf FROM a),
    g AS (SELECT country, count(*) AS event_count, avg(sev) AS avg_severity, avg(conf) AS avg_confidence,
                 coalesce(avg(cf), 0.0) AS conflict_share FROM x GROUP BY 1)
    SELECT g.*, c.latitude, c.longitude FROM g LEFT JOIN f_coords c USING (country)
    ORDER BY event_count DESC, conflict_share DESC, avg_severity DESC, country LIMIT 80"""


@plan("agg02_news_heatmap", oracle=_news_heatmap_sql(), extra_ctes=COORDS_CTE)
def agg02(t):
    """AGG-02: article-based country heatmap over the last 60 days."""
    return S.news_heatmap(_annotated(t), ARTICLE_AS_OF, days=60)


_HEAT_SQL = f"""
    SELECT h.country, h.event_count, h.avg_severity, h.avg_confidence, h.conflict_share, c.latitude, c.longitude
    FROM (SELECT trim(country) AS country, count(*) AS event_count,
                 coalesce(avg(CAST(severity AS DOUBLE)), 0.0) AS avg_severity,
                 coalesce(avg(confidence_score), 0.0) AS avg_confidence,
                 avg(CASE WHEN event_type = 'conflict' THEN 1.0 ELSE 0.0 END) AS conflict_share
          FROM f_event
          WHERE status IN ('auto_approved', 'human_approved') AND published_at IS NOT NULL
            AND published_at >= TIMESTAMP '{EVENT_AS_OF}' - INTERVAL 90 DAY
            AND country IS NOT NULL AND trim(country) <> ''
          GROUP BY 1) h
    LEFT JOIN f_coords c ON h.country = c.country"""


@plan("agg03_hotspots", oracle=f"""
    SELECT *, row_number() OVER (ORDER BY event_count DESC, country) <= 10 AS top_country,
           row_number() OVER (ORDER BY conflict_share * event_count DESC, country) <= 6 AS top_conflict
    FROM (SELECT *, CASE WHEN heat >= 0.65 THEN 'high' WHEN heat >= 0.35 THEN 'elevated' ELSE 'low' END AS band
          FROM (SELECT *, least(1.0, conflict_share * 0.55 + least(event_count / 15.0, 1.0) * 0.45) AS heat
                FROM ({_HEAT_SQL}) WHERE latitude IS NOT NULL AND longitude IS NOT NULL))""",
      extra_ctes=COORDS_CTE)
def agg03(t):
    """AGG-03: heat score, band and top lists of the event heatmap."""
    return S.hotspots(A.event_heatmap(t.event, EVENT_AS_OF, days=90, n=80))


def _cp_values() -> str:
    return ", ".join(f"('{i}', '{nm}', '{c}')" for i, nm, cs in S.CHOKEPOINTS for c in cs)


@plan("agg04_chokepoints", oracle=f"""
    SELECT cp.id, cp.name, coalesce(bool_or(h.country IS NOT NULL), false) AS active
    FROM (VALUES {_cp_values()}) cp(id, name, country)
    LEFT JOIN (SELECT DISTINCT country FROM ({_HEAT_SQL}) WHERE latitude IS NOT NULL AND longitude IS NOT NULL) h
      ON h.country = cp.country
    GROUP BY 1, 2""", extra_ctes=COORDS_CTE)
def agg04(t):
    """AGG-04: maritime chokepoint activation from the event heatmap."""
    return S.chokepoints(A.event_heatmap(t.event, EVENT_AS_OF, days=90, n=80))


@plan("agg05_quality_summary", oracle=f"""
    WITH ex AS (SELECT * FROM f_review_action WHERE action IN ('approve', 'reject')),
         lat AS (SELECT greatest(0.0, (epoch_us(nlp_processed_at) - epoch_us(created_at)) / 1e6) AS l FROM (
                   SELECT * FROM f_article WHERE nlp_processed_at IS NOT NULL
                   ORDER BY nlp_processed_at DESC, article_id DESC LIMIT 2000) WHERE created_at IS NOT NULL),
         srt AS (SELECT list_sort(list(l)) AS v FROM lat),
         pub AS (SELECT event_id FROM f_event WHERE status IN ('auto_approved', 'human_approved'))
    SELECT (SELECT CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE action = 'approve') / count(*) END FROM ex)
             AS classification_accuracy,
           (SELECT CASE WHEN len(v) > 0 THEN v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1] END FROM srt)
             AS nlp_latency_p95_seconds,
           (SELECT count(*) FILTER (WHERE status = 'auto_approved') / count(*) FROM f_event) AS auto_approved_rate,
           (SELECT count(*) FILTER (WHERE status = 'pending_review') FROM f_event) AS review_queue_backlog,
           (SELECT greatest(0.0, (epoch_us(TIMESTAMP '{ARTICLE_AS_OF}') - epoch_us(max(created_at))) / 1e6 / 60.0)
            FROM f_article) AS news_ingestion_freshness_minutes,
           (SELECT count(DISTINCT event_id) FROM f_impact WHERE event_id IN (SELECT event_id FROM pub))
             / (SELECT count(*) FROM pub) AS asset_mapping_coverage""")
def agg05(t):
    """AGG-05: quality summary row (review actions stand in for reviewed examples)."""
    ex = t.review_action.withColumnRenamed("action", "review_action")
    return S.quality_summary(ex, t.article, t.event, t.impact, ARTICLE_AS_OF)


@plan("agg06_weekly_review", oracle="""
    SELECT date_trunc('week', TIMESTAMP '2024-01-17 12:00:00') AS week_start_utc,
           date_trunc('week', TIMESTAMP '2024-01-17 12:00:00') + INTERVAL 7 DAY AS week_end_utc,
           count(DISTINCT event_id) AS reviewed_events,
           count(DISTINCT event_id) BETWEEN 50 AND 100 AS target_met
    FROM f_review_action WHERE action IN ('approve', 'reject')
      AND created_at >= date_trunc('week', TIMESTAMP '2024-01-17 12:00:00')
      AND created_at < date_trunc('week', TIMESTAMP '2024-01-17 12:00:00') + INTERVAL 7 DAY""")
def agg06(t):
    """AGG-06: weekly review progress for the week of 2024-01-17."""
    return S.weekly_review(t.review_action, "2024-01-17 12:00:00")


@plan("agg08_cross_class_pairs", oracle="""
    WITH top AS (SELECT event_id, list(ticker ORDER BY rn) AS tk FROM (
                   SELECT i.event_id, a.ticker, row_number() OVER (PARTITION BY i.event_id
                          ORDER BY i.confidence_score DESC NULLS FIRST, a.ticker) AS rn
                   FROM f_impact i JOIN f_asset a USING (asset_id)) WHERE rn <= 5 GROUP BY 1),
         cls AS (SELECT e.event_id, e.title, list_sort(list_distinct(list(a.asset_type))) AS c
                 FROM f_event e JOIN top USING (event_id), unnest(top.tk) AS u(ticker)
                 JOIN f_asset a ON a.ticker = u.ticker
                 WHERE len(top.tk) >= 2 GROUP BY 1, 2),
         k AS (SELECT array_to_string(c, '<->') AS pair, title FROM cls WHERE len(c) >= 2)
    SELECT pair, count(DISTINCT title) AS event_count, list_sort(list(DISTINCT title))[1:3] AS events
    FROM k GROUP BY 1 ORDER BY event_count DESC, pair LIMIT 5""")
def agg08(t):
    """AGG-08: cross-asset-class co-movement over the event cards."""
    cards = EV.event_cards(t.event, t.impact, t.asset, t.tag).select(
        "event_id", "title", F.col("affected_assets.ticker").alias("affected_tickers"))
    return S.cross_class_pairs(cards, t.asset)


@plan("agg09_quota_usage", oracle="""
    SELECT 'predictions' AS kind, user_id, day, used, greatest(0, 5 - used) AS remaining, used >= 5 AS at_limit
    FROM (SELECT user_id, CAST(predicted_at AS DATE) AS day, count(*) AS used FROM f_prediction GROUP BY 1, 2)
    UNION ALL
    SELECT 'boards', owner_id, NULL, count(*), greatest(0, 3 - count(*)), count(*) >= 3 FROM f_board GROUP BY owner_id""")
def agg09(t):
    """AGG-09: prediction and board quota use per user."""
    return S.quota_usage(t.prediction, t.board)


@plan("agg10_board_stats", oracle="""
    SELECT b.*, coalesce(p.n, 0) AS pin_count, coalesce(p.mx, -1) + 1 AS next_position
    FROM f_board b LEFT JOIN (SELECT board_id, count(*) AS n, max(position) AS mx FROM f_pin GROUP BY 1) p
      USING (board_id)""")
def agg10(t):
    """AGG-10: boards with pin counts and next positions."""
    return S.board_stats(t.board, t.pin)


def _tpl_sql() -> str:
    parts = []
    for slug, types, countries, kws in S.BOARD_TEMPLATES:
        kw = " OR ".join(f"contains(lower(coalesce(title, '')), {q(k)}) OR contains(lower(coalesce(description, '')), {q(k)})"
                         for k in kws)
        parts.append(f"""SELECT '{slug}' AS template, event_id, title, event_type, country, published_at FROM f_event
            WHERE status IN ('auto_approved', 'human_approved') AND event_type IN {inlist(types)}
              AND (country IN {inlist(countries)} OR {kw})""")
    return " UNION ALL ".join(parts)


@plan("agg11_template_events", oracle=f"""
    SELECT template, event_id, title, event_type, country, published_at, CAST(rn - 1 AS INTEGER) AS position FROM (
      SELECT *, row_number() OVER (PARTITION BY template ORDER BY published_at DESC NULLS FIRST, event_id DESC) AS rn
      FROM ({_tpl_sql()})) WHERE rn <= 6""")
def agg11(t):
    """AGG-11: newest 6 events per board template."""
    return S.template_events(t.event)


@plan("prd19_review_queue", oracle="""
    SELECT * FROM f_event WHERE status = 'pending_review' ORDER BY created_at DESC, event_id DESC LIMIT 50""")
def prd19(t):
    """PRD-19: review queue page."""
    return S.review_queue(t.event)


@plan("prd19_review_history", oracle="""
    SELECT * FROM f_review_action ORDER BY created_at DESC, action_id DESC LIMIT 100""")
def prd19b(t):
    """PRD-19: newest review actions."""
    return S.review_history(t.review_action)


# ---------------------------------------------------------------------------
# alerts
# ---------------------------------------------------------------------------

_MATCH_SQL = f"""
    WITH ev AS (SELECT event_id, event_type, confidence_score AS ec FROM f_event
                WHERE status IN ('auto_approved', 'human_approved')),
         act AS (SELECT * FROM f_alert WHERE coalesce(is_active, false)),
         m AS (
           SELECT a.alert_id, a.user_id, ev.event_id, a.threshold,
                  coalesce(nullif(i.impact_strength, 0), nullif(i.confidence_score, 0), nullif(ev.ec, 0), 0.0) AS signal
           FROM act a JOIN f_impact i ON i.asset_id = a.asset_id JOIN ev ON ev.event_id = i.event_id
           WHERE a.event_type IS NULL OR a.event_type = ev.event_type
           UNION ALL
           SELECT a.alert_id, a.user_id, ev.event_id, a.threshold, coalesce(ev.ec, 0.0)
           FROM act a JOIN ev ON (a.event_type IS NULL OR a.event_type = ev.event_type)
           WHERE a.asset_id IS NULL)
    SELECT alert_id, user_id, event_id, CAST(signal AS DOUBLE) AS signal FROM m
    WHERE threshold IS NULL OR signal >= threshold"""


@plan("alr01_match_alerts", oracle=_MATCH_SQL)
def alr01(t):
    """ALR-01: alert matches for every published event."""
    return AL.match_alerts(t.event, t.impact, t.alert)


@plan("alr02_notifications", oracle=f"""
    WITH mt AS ({_MATCH_SQL})
    SELECT alert_id, user_id, event_id, channel, 'queued' AS status, false AS delivered FROM (
      SELECT mt.*, unnest(list_filter([CASE WHEN coalesce(u.email_pref, true) THEN 'email' END,
                                       CASE WHEN coalesce(u.push_pref, false) THEN 'web_push' END],
                                      lambda x: x IS NOT NULL)) AS channel
      FROM mt JOIN f_user u USING (user_id))""")
def alr02(t):
    """ALR-02: notification rows per channel preference."""
    return AL.notifications(AL.match_alerts(t.event, t.impact, t.alert), t.user)


@plan("alr03_list_alerts", oracle="""
    SELECT a.*, s.ticker, s.name AS asset_name FROM f_alert a LEFT JOIN f_asset s USING (asset_id)""")
def alr03(t):
    """ALR-03: every alert with its optional asset."""
    return AL.list_alerts(t.alert, t.asset)

