"""DuckDB re-derivation of the domain tables, for the oracle queries.

Written independently of ``eventlens.fixtures`` (SQL instead of DataFrame
code) from the rules in FIXTURES.md. Each entry is a CTE body over the
pre-registered base views; ``with_fixtures`` prepends what a query needs.
"""
from __future__ import annotations

import re

from eventlens import fixtures as FX
from eventlens import lexicons as L


def _list(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def _case(col: str, mapping: dict) -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {arms} END"


S = "(SELECT count(*) FROM supplier)"
E = "(SELECT count(*) FROM events)"

CTES: dict[str, str] = {
    "f_asset": f"""
        SELECT s_suppkey AS asset_id, 'S' || s_suppkey AS ticker, s_name AS name,
               {_list(L.ASSET_TYPES)}[s_suppkey % 6 + 1] AS asset_type,
               r_name AS sector, n_name AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
                      JOIN region ON n_regionkey = r_regionkey""",
    "f_bar": """
        SELECT asset_id, CAST(day AS TIMESTAMP) AS ts, open, high, low, close, volume FROM (
          SELECT l_suppkey AS asset_id, CAST(l_shipdate AS DATE) AS day,
                 arg_min(l_extendedprice / l_quantity,
                         (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS open,
                 max(l_extendedprice / l_quantity) AS high,
                 min(l_extendedprice / l_quantity) AS low,
                 arg_max(l_extendedprice / l_quantity,
                         (l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity)) AS close,
                 sum(l_quantity) AS volume
          FROM lineitem GROUP BY 1, 2)""",
    "f_event": f"""
        SELECT event_id,
               etype || ' ' || (event_id % 50) AS title,
               {_list(FX.ARTICLE_PHRASES)}[CASE etype {' '.join(f"WHEN '{k}' THEN {v}" for k, v in FX.TYPE_PHRASE_BASE.items())} END
                 + event_id % 2 + 1] AS description,
               etype AS event_type,
               CASE WHEN event_id % 23 = 0 THEN NULL
                    ELSE {_list(FX.FIXTURE_COUNTRIES)}[user_id % 12 + 1] END AS country,
               CAST(NULL AS VARCHAR) AS region,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE CAST(event_id % 5 + 1 AS INTEGER) END AS severity,
               'src' || (user_id % 5) AS source,
               {_list(L.EVENT_STATUSES)}[event_id % 4 + 1] AS status,
               (event_id % 101) / 100.0::DOUBLE AS confidence_score,
               pub AS published_at,
               pub + to_seconds(CAST(event_id % 600 AS BIGINT)) AS created_at,
               (value - 245) / 50 AS sentiment,
               (k - 50) / 5 AS goldstein,
               k % 12 + 1 AS num_articles,
               user_id
        FROM (SELECT *, {_case('event_type', FX.EVENT_TYPE_FROM_KIND)} AS etype,
                     CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
                     make_timestamp(epoch_us(TIMESTAMP '1998-01-01') + (event_id % 700) * 86400000000
                                    + epoch_us(ts) % 86400000000) AS pub
              FROM events)""",
    "f_impact": f"""
        SELECT event_id, (event_id * 7 + j * 13) % {S} AS asset_id,
               {_list(L.IMPACT_DIRECTIONS)}[(event_id + j) % 3 + 1] AS impact_direction,
               ((event_id * 11 + j * 5) % 100) / 100.0::DOUBLE AS impact_strength,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE ((event_id * 3 + j * 7) % 100) / 100.0::DOUBLE END
                 AS confidence_score,
               created_at + to_seconds(CAST(j * 60 AS BIGINT)) AS created_at
        FROM f_event, LATERAL (SELECT unnest(range(0, CAST(event_id % 3 AS INTEGER) + 1)) AS j)""",
    "f_tag": """
        SELECT event_id, 'topic' || ((event_id + j * 3) % 20) AS tag
        FROM events, LATERAL (SELECT unnest(range(0, CAST(event_id % 4 AS INTEGER) + 1)) AS j)""",
    "f_review_action": f"""
        SELECT event_id AS action_id, event_id,
               {_list(FX.REVIEW_ACTIONS)}[event_id % 3 + 1] AS action,
               user_id AS reviewer_id, ts AS created_at
        FROM events""",
    "f_article": f"""
        SELECT doc_id AS article_id,
               {_list(FX.ARTICLE_PHRASES)}[doc_id % 16 + 1] || ' ' || s_name AS title,
               '{FX.ARTICLE_CONTEXT}' || chr(10) || text AS content,
               CASE WHEN doc_id % 5 = 4 THEN source
                    ELSE {_list(FX.ARTICLE_SOURCES)}[doc_id % 5 + 1] END AS source,
               'https://news.example.com/a/' || doc_id AS url,
               CASE WHEN doc_id % 29 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-01' + to_seconds(doc_id * 420) END AS published_at,
               TIMESTAMP '2024-02-01' + to_seconds(doc_id) AS created_at,
               lang,
               CASE WHEN doc_id % 3 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-02-01' + to_seconds(doc_id + doc_id % 120) END AS nlp_processed_at
        FROM documents LEFT JOIN supplier ON s_suppkey = doc_id % {S}""",
    "f_article_update": f"""
        SELECT article_id + {FX.UPDATE_ID} AS article_id, title,
               CASE WHEN article_id % 8 = 1 THEN content || '{FX.UPDATE_BODY}' ELSE content END AS content,
               CASE WHEN article_id % 4 = 1 THEN 'Reuters' ELSE 'a blog' END AS source,
               CASE WHEN article_id % 40 = 21 THEN '' ELSE url || '/update' END AS url,
               published_at + INTERVAL 60 SECOND AS published_at, created_at + INTERVAL 86400 SECOND AS created_at, lang,
               CAST(NULL AS TIMESTAMP) AS nlp_processed_at
        FROM f_article WHERE article_id % 4 IN (1, 2)""",
    "f_wire": "SELECT * FROM f_article UNION ALL SELECT * FROM f_article_update",
    "f_event_article": f"""
        SELECT doc_id % {E} AS event_id, doc_id AS article_id FROM documents""",
    "f_kg_edge": f"""
        SELECT 'ASSET:S' || s_suppkey AS source_key, 'ASSET:S' || ((s_suppkey * 3 + 1) % {S}) AS target_key,
               'SUPPLIES_TO' AS relationship, 0.3::DOUBLE + (s_suppkey % 7) / 10.0::DOUBLE AS strength FROM supplier
        UNION ALL
        SELECT 'ASSET:S' || s_suppkey, 'ASSET:S' || ((s_suppkey + 5) % {S}), 'COMPETES_WITH',
               CASE WHEN s_suppkey % 4 = 0 THEN 0.0::DOUBLE ELSE 0.6::DOUBLE END FROM supplier
        UNION ALL
        SELECT 'ASSET:S' || s_suppkey, 'SECTOR:' || r_name, 'PART_OF', 0.9::DOUBLE
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT 'ASSET:S' || s_suppkey, 'COUNTRY:' || n_name, 'PART_OF', 0.9::DOUBLE
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "f_prediction": f"""
        SELECT o_orderkey AS prediction_id, o_custkey AS user_id, o_orderkey % {E} AS event_id,
               o_custkey % {S} AS asset_id,
               {_case('o_orderstatus', FX.STATUS_TO_DIRECTION)} AS predicted_direction,
               (o_orderkey % 31 - 15) / 4.0::DOUBLE AS predicted_change_pct,
               hz AS prediction_horizon,
               (o_orderkey % 97) / 100.0::DOUBLE AS confidence_score,
               'm' || (o_custkey % 3) AS model_version,
               o_orderdate AS predicted_at,
               o_orderdate + to_seconds(CAST({_case('hz', {k: v for k, v in L.HORIZON_SECONDS.items()})} AS BIGINT))
                 AS resolve_at,
               CASE WHEN outc = 'pending' THEN NULL ELSE (o_custkey % 41 - 20) / 4.0::DOUBLE END AS actual_change_pct,
               outc AS outcome
        FROM (SELECT *, {_case('o_orderpriority', FX.PRIORITY_TO_HORIZON)} AS hz,
                     ['correct', 'partial', 'wrong', 'pending'][o_orderkey % 4 + 1] AS outc
              FROM orders)""",
    "f_alert": f"""
        SELECT * FROM (
          SELECT c_custkey AS alert_id, c_custkey AS user_id,
                 CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % {S} END AS asset_id,
                 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {_case('c_mktsegment', FX.SEGMENT_TO_TYPE)} END
                   AS event_type,
                 CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE (c_custkey % 10) / 10.0::DOUBLE END AS threshold,
                 c_custkey % 6 <> 0 AS is_active,
                 to_timestamp(1700000000 + c_custkey * 60)::TIMESTAMP AS created_at
          FROM customer)
        WHERE asset_id IS NOT NULL OR event_type IS NOT NULL""",
    "f_user": """
        SELECT c_custkey AS user_id, c_name AS name,
               CASE WHEN c_custkey % 7 = 0 THEN false END AS email_pref,
               CASE WHEN c_custkey % 2 = 0 THEN true END AS push_pref
        FROM customer""",
    "f_board": """
        SELECT c_custkey AS board_id, c_custkey AS owner_id, 'board ' || c_custkey AS name,
               c_custkey % 2 = 0 AS is_public, to_timestamp(1700000000 + c_custkey)::TIMESTAMP AS created_at
        FROM customer""",
    "f_pin": f"""
        SELECT o_orderkey AS pin_id, o_custkey AS board_id, o_orderkey % {E} AS event_id,
               CAST(o_orderkey % 50 AS INTEGER) AS position FROM orders""",
    "f_watchlist": f"""
        SELECT DISTINCT o_custkey AS user_id, o_orderkey % {S} AS asset_id FROM orders""",
    "f_filing": f"""
        SELECT p.page_id, 'S' || (p.page_id % {S}) AS source_ticker,
               p.html AS html,
               ' our major customer ' || lower(c.s_name) || ' and supplier ' || lower(u.s_name) || ' ' AS tail
        FROM pages p
        JOIN supplier c ON c.s_suppkey = (p.page_id * 7) % {S}
        JOIN supplier u ON u.s_suppkey = (p.page_id * 3 + 1) % {S}""",
    "f_profile": """
        SELECT 'S' || s_suppkey AS ticker, s_name AS company,
               CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'Industry ' || (s_suppkey % 4) END AS industry,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE n_name END AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "f_quote": f"""
        SELECT asset_id, provider,
               CASE WHEN (asset_id + i) % 4 = 0 THEN NULL WHEN (asset_id + i) % 4 = 1 THEN 0.0::DOUBLE
                    ELSE c * (1 + i / 100.0::DOUBLE) END AS price,
               (i - 3) / 10.0::DOUBLE AS change, as_of
        FROM (SELECT asset_id, arg_max(close, ts) AS c, max(ts) AS as_of FROM f_bar GROUP BY 1),
             (SELECT unnest(range(0, {len(FX.QUOTE_PROVIDERS)})) AS i, unnest({_list(FX.QUOTE_PROVIDERS)}) AS provider)""",
    "f_last_good": """
        SELECT asset_id, arg_min(close, ts) AS price, 0.0::DOUBLE AS change, min(ts) AS as_of FROM f_bar GROUP BY 1""",
    "f_trade": """
        SELECT 'U' || (user_id % 20) AS ticker, value AS price, ts, event_id AS seq FROM events""",
    "f_kline": """
        SELECT 'K' || (user_id % 5) AS symbol, date_trunc('hour', ts) AS open_time,
               arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low,
               arg_max(value, (ts, event_id)) AS close, sum(value) AS volume,
               count(*) AS num_trades,
               sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0.0::DOUBLE END) AS taker_buy_volume
        FROM events GROUP BY 1, 2""",
    "f_provider_log": """
        SELECT event_id AS request_id, 'p' || (user_id % 7) AS provider,
               event_type <> 'error' AS success, event_type = 'signup' AS skipped,
               value * 5 AS latency_ms, 1.0::DOUBLE AS weight, ts FROM events""",
    "f_kg_edge_stale": """
        SELECT * FROM f_kg_edge
        UNION ALL SELECT 'ASSET:S' || s_suppkey, 'ASSET:OLD' || s_suppkey, 'SUPPLIES_TO', 0.4::DOUBLE
        FROM supplier WHERE s_suppkey % 50 = 7""",
}

# f_impact reads f_event; keep dependency order when emitting.
_ORDER = list(CTES)


def with_fixtures(sql: str, extra: dict[str, str] | None = None) -> str:
    """Prepend the CTEs the query mentions (and their dependencies)."""
    allc = dict(CTES)
    if extra:
        allc.update(extra)
    order = _ORDER + [k for k in (extra or {}) if k not in _ORDER]
    need: set[str] = set()

    def visit(text: str):
        for name in order:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                visit(allc[name])

    visit(sql)
    if not need:
        return sql
    body = ",\n".join(f"{n} AS ({allc[n]})" for n in order if n in need)
    stripped = sql.lstrip()
    if stripped[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {body},\n{stripped[15:]}"
    if stripped[:5].upper() == "WITH ":
        # Merge the query's own CTE list after the fixture CTEs.
        return f"WITH {body},\n{stripped[5:]}"
    return f"WITH {body}\n{sql}"
