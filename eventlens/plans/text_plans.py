"""Registered queries: text scalars, scores, search and gates."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.operators import filters as FL
from eventlens.plans.base import ARTICLE_AS_OF, plan
from eventlens.plans.text_sql import (TEXT, alias_pos, best_group, best_hits, hits, inlist, q,
                                      squeeze)

EXISTING_BEFORE = "2024-01-20 00:00:00"

LOW = f"lower({TEXT})"
NORM = squeeze(f"({TEXT})")


def _prep(t):
    """Articles with the prepared text forms (lower, squeezed, squeezed-lower)."""
    return T.prepare_text(t.article, T.article_text())


@plan("txt01_dedup_articles", oracle=f"""
    SELECT content_hash, article_id FROM (
      SELECT article_id, h AS content_hash,
             row_number() OVER (PARTITION BY h ORDER BY created_at, article_id) AS rn
      FROM (SELECT *, sha256(coalesce(title, '') || '::' || coalesce(content, '')) AS h FROM f_article))
    WHERE rn = 1 AND content_hash NOT IN (
      SELECT sha256(coalesce(title, '') || '::' || coalesce(content, '')) FROM f_article
      WHERE published_at < TIMESTAMP '{EXISTING_BEFORE}')""")
def txt01(t):
    """TXT-01: first article per content hash, minus hashes already stored."""
    existing = (t.article.where(F.col("published_at") < F.lit(EXISTING_BEFORE).cast("timestamp"))
                .select(T.content_hash("title", "content").alias("content_hash")))
    return FL.dedup_articles(t.article, existing).select("content_hash", "article_id")


@plan("txt02_normalize_text", oracle=f"""
    SELECT article_id, substr({squeeze("coalesce(content, '')")}, 1, 5000) AS norm FROM f_article""")
def txt02(t):
    """TXT-02: whitespace squeeze, trim and 5,000-character cut of article bodies."""
    return t.article.select("article_id", T.normalize_text("content", T.TEXT_CUT).alias("norm"))


def _strip_sql(x: str) -> str:
    s = f"regexp_replace({x}, '(?is)<script.*?>.*?</script>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?is)<style.*?>.*?</style>', ' ', 'g')"
    s = f"regexp_replace({s}, '(?s)<[^>]+>', ' ', 'g')"
    for ent, ch in L.HTML_ENTITIES:
        s = f"replace({s}, {q(ent)}, {q(ch)})"
    return f"lower(regexp_replace({s}, '\\s+', ' ', 'g'))"


@plan("txt03_strip_html", oracle=f"SELECT page_id, {_strip_sql('html')} AS text FROM pages")
def txt03(t):
    """TXT-03: HTML strip of every page."""
    return t.raw("pages").select("page_id", T.strip_html("html").alias("text"))


_TOKS = f"regexp_extract_all(lower({NORM}), '[A-Za-z]+')"
_ASCII_RATIO = (f"length(regexp_replace({NORM}, '[^\\x00-\\x7F]', '', 'g')) / "
                f"greatest(1, length({NORM}))")


@plan("txt04_language_score", oracle=f"""
    SELECT article_id,
           CASE WHEN nchar = 0 OR ntok = 0 THEN 'unknown' ELSE 'en' END AS code,
           CAST(CASE WHEN nchar = 0 OR ntok = 0 THEN 0.0
                WHEN ratio >= 0.95 AND ntok >= 3 THEN greatest(c, 0.82) ELSE c END AS DOUBLE) AS confidence
    FROM (SELECT *, least(0.92, 0.52 + stop / greatest(1, ntok) * 1.6 + ratio * 0.18) AS c
          FROM (SELECT article_id, length({NORM}) AS nchar, len({_TOKS}) AS ntok,
                       len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) AS stop,
                       {_ASCII_RATIO} AS ratio
                FROM f_article))""")
def txt04(t):
    """TXT-04: fallback language score of title + body."""
    df = _prep(t).select("article_id", T.language_score(norm="_t_norm").alias("s"))
    return df.select("article_id", "s.code", "s.confidence")


def _relevance_sql() -> str:
    low = f"lower({NORM})"
    parts = ["0.16"]
    for w, kws in L.RELEVANCE_GROUPS:
        parts.append(f"least({w}, {hits(low, kws)} * {w / 2})")
    parts.append(f"CASE WHEN regexp_matches({NORM}, '(^|[^\\p{{L}}\\p{{N}}_])[A-Z]{{2,5}}([^\\p{{L}}\\p{{N}}_]|$)') "
                 "THEN 0.05 ELSE 0.0 END")
    parts.append(f"CASE WHEN {hits('lower(coalesce(source, \'\'))', L.TRUSTED_SOURCE_TOKENS)} > 0 "
                 "THEN 0.05 ELSE 0.0 END")
    neg = hits(low, L.IRRELEVANT_TERMS)
    parts.append(f"- CASE WHEN {neg} > 0 THEN least(0.30, {neg} * 0.10) ELSE 0.0 END")
    parts.append(f"- CASE WHEN length({low}) < 80 THEN 0.06 ELSE 0.0 END")
    body = " + ".join(parts[:-2]) + " " + " ".join(parts[-2:])
    return (f"CASE WHEN length({NORM}) = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, {body})) END")


@plan("txt05_relevance_score", oracle=f"SELECT article_id, CAST({_relevance_sql()} AS DOUBLE) AS relevance_score FROM f_article")
def txt05(t):
    """TXT-05: keyword relevance of title + body with source bonus."""
    return _prep(t).select("article_id", T.relevance_score(norm="_t_norm", nlow="_t_nlow", source="source")
                           .alias("relevance_score"))


_SNIP = squeeze("content")


@plan("txt06_categorize_news", oracle=f"""
    SELECT article_id, category,
           CASE WHEN category IN {inlist(L.EVENT_TYPES)} THEN category END AS matched_event_type,
           CASE WHEN coalesce(length(content), 0) = 0 THEN NULL
                WHEN length({_SNIP}) > 220 THEN rtrim(substr({_SNIP}, 1, 220)) || '...'
                ELSE rtrim(substr({_SNIP}, 1, 220)) END AS snippet
    FROM (SELECT *, coalesce({best_group(LOW, L.NEWS_CATEGORY_KEYWORDS)}, 'general') AS category FROM f_article)""")
def txt06(t):
    """TXT-06: news category, matched event type and snippet."""
    return FL.categorize_news(t.article).select("article_id", "category", "matched_event_type", "snippet")


@plan("txt07_infer_event_type", oracle=f"""
    SELECT article_id, {best_group(LOW, L.EVENT_KEYWORDS)} AS event_type,
           CAST(CASE WHEN {best_hits(LOW, L.EVENT_KEYWORDS)} > 0
                THEN least(0.92, 0.45 + {best_hits(LOW, L.EVENT_KEYWORDS)} * 0.11) ELSE 0.0 END AS DOUBLE) AS confidence
    FROM f_article""")
def txt07(t):
    """TXT-07: event type and base confidence of title + body."""
    df = _prep(t).select("article_id", T.infer_event_type(low="_t_low").alias("s"))
    return df.select("article_id", *T.event_type_fields("s"))


_NLOW = f"lower({NORM})"


@plan("txt08_sentiment", oracle=f"""
    SELECT article_id,
           CASE WHEN length({NORM}) = 0 THEN NULL
                WHEN {hits(_NLOW, L.SENTIMENT_POSITIVE)} = 0 AND {hits(_NLOW, L.SENTIMENT_NEGATIVE)} = 0 THEN 0.0
                ELSE greatest(-1.0, least(1.0, ({hits(_NLOW, L.SENTIMENT_POSITIVE)} - {hits(_NLOW, L.SENTIMENT_NEGATIVE)})
                     / greatest(1, {hits(_NLOW, L.SENTIMENT_POSITIVE)} + {hits(_NLOW, L.SENTIMENT_NEGATIVE)}))) END
             AS sentiment_score
    FROM f_article""")
def txt08(t):
    """TXT-08: lexicon sentiment of title + body."""
    return _prep(t).select("article_id", T.sentiment(norm="_t_norm", nlow="_t_nlow").alias("sentiment_score"))


_NEG, _POS = hits(LOW, L.NEGATIVE_IMPACT_TERMS), hits(LOW, L.POSITIVE_IMPACT_TERMS)


@plan("txt09_impact_signal", oracle=f"""
    SELECT article_id, ({_POS} - {_NEG}) / greatest(1, {_POS} + {_NEG}) AS polarity,
           CAST(least(1.0, 0.35 + 0.15 * greatest(1, {_POS} + {_NEG})) AS DOUBLE) AS intensity
    FROM f_article""")
def txt09(t):
    """TXT-09: impact polarity and intensity."""
    df = _prep(t).select("article_id", T.impact_signal(low="_t_low").alias("s"))
    return df.select("article_id", "s.polarity", "s.intensity")


def _country_sql() -> str:
    short = set(L.EVENT_SHORT_ALIASES)
    arms = " ".join(f"WHEN {alias_pos(LOW, a, a in short)} > 0 THEN {q(c)}"
                    for a, c in L.EVENT_COUNTRY_ALIASES)
    return f"CASE {arms} END"


@plan("txt10_extract_country", oracle=f"SELECT article_id, {_country_sql()} AS country FROM f_article")
def txt10(t):
    """TXT-10: first country alias of title + body."""
    return _prep(t).select("article_id", T.extract_country(low="_t_low").alias("country"))


def _countries_sql() -> str:
    short = set(L.NEWS_SHORT_ALIASES)
    by_c: dict[str, list[tuple[int, str]]] = {}
    for i, (a, c) in enumerate(L.NEWS_COUNTRY_ALIASES):
        by_c.setdefault(c, []).append((i, a))
    items = []
    for c, aliases in by_c.items():
        pos = "CASE " + " ".join(f"WHEN {alias_pos(LOW, a, a in short)} > 0 THEN {alias_pos(LOW, a, a in short)}"
                                  for _, a in aliases) + " END"
        idx = "CASE " + " ".join(f"WHEN {alias_pos(LOW, a, a in short)} > 0 THEN {i}" for i, a in aliases) + " END"
        items.append(f"{{'p': {pos}, 'i': {idx}, 'c': {q(c)}}}")
    arr = "[" + ", ".join(items) + "]"
    return (f"list_transform(list_sort(list_filter({arr}, lambda s: s.p IS NOT NULL)), lambda s: s.c)")


@plan("txt11_extract_countries", oracle=f"SELECT article_id, {_countries_sql()} AS countries FROM f_article")
def txt11(t):
    """TXT-11: all countries of title + body in order of appearance."""
    return _prep(t).select("article_id", T.extract_countries(low="_t_low").alias("countries"))


def _source_sql(x: str) -> str:
    arms = " ".join(f"WHEN contains(lower({x}), {q(k)}) THEN {v}" for k, v in L.SOURCE_CREDIBILITY)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0.68 {arms} ELSE 0.70 END"


@plan("txt13_source_score", oracle=f"SELECT article_id, CAST({_source_sql('source')} AS DOUBLE) AS source_score FROM f_article")
def txt13(t):
    """TXT-13: source credibility."""
    return t.article.select("article_id", T.source_score("source").alias("source_score"))


@plan("txt14_recency_score", oracle=f"""
    SELECT article_id,
           CAST(CASE WHEN published_at IS NULL THEN 0.65 WHEN age <= 7200 THEN 0.95 WHEN age <= 43200 THEN 0.88
                WHEN age <= 86400 THEN 0.80 WHEN age <= 259200 THEN 0.70 WHEN age <= 604800 THEN 0.62
                ELSE 0.52 END AS DOUBLE) AS recency_score
    FROM (SELECT *, (epoch_us(TIMESTAMP '{ARTICLE_AS_OF}') - epoch_us(published_at)) / 1e6 AS age FROM f_article)""")
def txt14(t):
    """TXT-14: recency step score at a fixed as-of time."""
    return t.article.select("article_id", T.recency_score("published_at", ARTICLE_AS_OF).alias("recency_score"))


_UP = "len(regexp_extract_all(" + TEXT + ", '\\b[A-Z]{2,5}\\b'))"


@plan("txt15_market_context", oracle=f"""
    SELECT article_id, CAST(least(1.0, 0.42 + {hits(LOW, L.MARKET_CONTEXT_TERMS)} * 0.07
                              + least(1.0, nt * 0.2)) AS DOUBLE) AS market_context
    FROM (SELECT *, CAST(article_id % 4 AS INTEGER) AS nt FROM f_article)""")
def txt15(t):
    """TXT-15: market-context score (ticker count taken from a derived column)."""
    df = _prep(t).withColumn("nt", (F.col("article_id") % 4).cast("int"))
    return df.select("article_id", T.market_context(None, "nt", low="_t_low").alias("market_context"))


@plan("txt16_normalize_entity", oracle="""
    SELECT asset_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM f_asset""")
def txt16(t):
    """TXT-16: normalised asset names."""
    return t.asset.select("asset_id", T.normalize_entity("name").alias("norm"))


@plan("txt17_sim_tokens", oracle=f"""
    SELECT article_id, list_filter(regexp_extract_all({LOW}, '[a-z0-9]{{3,}}'),
                                   lambda x: x NOT IN {inlist(L.SIMILARITY_STOPWORDS)}) AS tokens
    FROM f_article""")
def txt17(t):
    """TXT-17: similarity tokens of title + body (duplicates kept)."""
    return _prep(t).select("article_id", T.sim_tokens("_t_low").alias("tokens"))


@plan("txt18_sentiment_label", oracle="""
    SELECT event_id,
           CASE WHEN sentiment <= -1.0 THEN 'negative' WHEN sentiment >= 1.0 THEN 'positive' ELSE 'neutral' END AS label_event,
           CASE WHEN sentiment <= -0.5 THEN 'negative' WHEN sentiment >= 0.5 THEN 'positive' ELSE 'neutral' END AS label_corpus,
           CASE WHEN sentiment <= -1.5 THEN 'down' WHEN sentiment >= 1.5 THEN 'up' ELSE 'neutral' END AS label_weak
    FROM f_event""")
def txt18(t):
    """TXT-18: sentiment labels at +-1.0, +-0.5 and +-1.5 (up/down)."""
    return t.event.select("event_id", T.sentiment_label("sentiment", 1.0).alias("label_event"),
                          T.sentiment_label("sentiment", 0.5).alias("label_corpus"),
                          T.sentiment_label("sentiment", 1.5, ("down", "neutral", "up")).alias("label_weak"))


def _severity_sql() -> str:
    base = "CASE category " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.NEWS_CATEGORY_SEVERITY.items()) \
        + f" ELSE {L.NEWS_CATEGORY_SEVERITY['general']} END"
    lift = " + ".join(f"CASE WHEN {hits(LOW, terms)} > 0 THEN {w} ELSE 0.0 END" for terms, w in L.NEWS_SEVERITY_TERMS)
    return f"least(5.0, {base} + {lift})"


@plan("txt20_news_severity", oracle=f"""
    SELECT article_id, category, CAST({_severity_sql()} AS DOUBLE) AS severity
    FROM (SELECT *, coalesce({best_group(LOW, L.NEWS_CATEGORY_KEYWORDS)}, 'general') AS category FROM f_article)""")
def txt20(t):
    """TXT-20: news severity estimate."""
    df = _prep(t).withColumn("category", T.news_category(low="_t_low"))
    return df.select("article_id", "category", T.news_severity("category", low="_t_low").alias("severity"))


@plan("txt21_url_host", oracle="""
    SELECT page_id, nullif(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)), '') AS host
    FROM pages""")
def txt21(t):
    """TXT-21: URL host of every page."""
    return t.raw("pages").select("page_id", T.url_host("url").alias("host"))


@plan("flt01_search_events", oracle="""
    SELECT * FROM f_event e
    WHERE status IN ('auto_approved', 'human_approved')
      AND (coalesce(title ILIKE '%topic1%', false) OR coalesce(description ILIKE '%topic1%', false)
           OR coalesce(country ILIKE '%topic1%', false) OR coalesce(region ILIKE '%topic1%', false)
           OR coalesce(source ILIKE '%topic1%', false) OR coalesce(event_type ILIKE '%topic1%', false)
           OR event_id IN (SELECT i.event_id FROM f_impact i JOIN f_asset a ON i.asset_id = a.asset_id
                           WHERE a.ticker ILIKE '%topic1%' OR a.name ILIKE '%topic1%')
           OR event_id IN (SELECT event_id FROM f_tag WHERE tag ILIKE '%topic1%'))
    ORDER BY published_at DESC NULLS FIRST, event_id DESC LIMIT 50""")
def flt01(t):
    """FLT-01: published events matching 'topic1' (tags match topic1 and topic10..19)."""
    return FL.search_events(t.event, t.impact, t.asset, t.tag, q="topic1")


@plan("flt01_search_events_asset", oracle="""
    SELECT * FROM f_event e
    WHERE status = 'pending_review' AND event_type = 'conflict'
      AND (coalesce(title ILIKE '%s1_%', false) OR coalesce(description ILIKE '%s1_%', false)
           OR coalesce(country ILIKE '%s1_%', false) OR coalesce(region ILIKE '%s1_%', false)
           OR coalesce(source ILIKE '%s1_%', false) OR coalesce(event_type ILIKE '%s1_%', false)
           OR event_id IN (SELECT i.event_id FROM f_impact i JOIN f_asset a ON i.asset_id = a.asset_id
                           WHERE a.ticker ILIKE '%s1_%' OR a.name ILIKE '%s1_%')
           OR event_id IN (SELECT event_id FROM f_tag WHERE tag ILIKE '%s1_%'))
    ORDER BY published_at DESC NULLS FIRST, event_id DESC LIMIT 50 OFFSET 10""")
def flt01b(t):
    """FLT-01: status/type filters and a wildcard term that hits asset tickers."""
    return FL.search_events(t.event, t.impact, t.asset, t.tag, q="s1_", status="Pending-Review",
                            event_type="conflict", limit=50, offset=10)


@plan("flt02_search_news", oracle=f"""
    SELECT * FROM (
      SELECT article_id, title, source, url, published_at, category,
             CASE WHEN category IN {inlist(L.EVENT_TYPES)} THEN category END AS matched_event_type
      FROM (SELECT *, coalesce({best_group(LOW, L.NEWS_CATEGORY_KEYWORDS)}, 'general') AS category FROM f_article
            WHERE coalesce(title ILIKE '%shipping%', false) OR coalesce(content ILIKE '%shipping%', false)
               OR coalesce(source ILIKE '%shipping%', false) OR coalesce(url ILIKE '%shipping%', false)))
    WHERE category = 'trade_policy'
    ORDER BY published_at DESC NULLS FIRST, article_id DESC LIMIT 50""")
def flt02(t):
    """FLT-02: news search on 'shipping' restricted to the trade-policy category."""
    return FL.search_news(t.article, q="shipping", category="Trade Policy").select(
        "article_id", "title", "source", "url", "published_at", "category", "matched_event_type")


@plan("flt03_list_assets", oracle="""
    SELECT * FROM f_asset WHERE asset_type = 'stock' AND sector ILIKE '%a%' ORDER BY ticker LIMIT 100""")
def flt03(t):
    """FLT-03: stock assets whose sector contains 'a', by ticker."""
    return FL.list_assets(t.asset, asset_type="Stock", sector="a")


@plan("flt04_is_reuters", oracle="""
    SELECT article_id, contains(lower(coalesce(url, '')), 'reuters') OR contains(lower(coalesce(url, '')), '/ultime-notizie-reuters/')
           OR contains(lower(coalesce(source, '')), 'reuters')
           OR contains(lower(coalesce(source, '')), '/ultime-notizie-reuters/') AS is_reuters
    FROM f_article""")
def flt04(t):
    """FLT-04: Reuters provenance flag over URL and source fields."""
    return t.article.select("article_id", T.is_reuters("url", "source").alias("is_reuters"))


@plan("flt11_parse_enum", oracle="""
    SELECT event_id, CASE WHEN lower(regexp_replace(trim(replace(upper(status), '_', '-')), '[- ]', '_', 'g'))
                               IN ('auto_approved', 'pending_review', 'rejected', 'human_approved')
                          THEN lower(regexp_replace(trim(replace(upper(status), '_', '-')), '[- ]', '_', 'g')) END AS status
    FROM f_event""")
def flt11(t):
    """FLT-11: status enum parsed back from an upper-case hyphenated spelling."""
    spelled = F.replace(F.upper("status"), F.lit("_"), F.lit("-"))
    return t.event.select("event_id", T.parse_enum(spelled, L.EVENT_STATUSES).alias("status"))


@plan("flt10_clean_prices", oracle="""
    SELECT asset_id AS symbol, ts AS timestamp, close,
           close / lag(close) OVER (PARTITION BY asset_id ORDER BY ts) - 1 AS pct_change,
           coalesce(close / lag(close) OVER (PARTITION BY asset_id ORDER BY ts) - 1 > 5.0, false) AS spike
    FROM f_bar WHERE close IS NOT NULL""")
def flt10(t):
    """FLT-10: price cleaning with >500 % spike flags."""
    df = t.bar.select(F.col("asset_id").alias("symbol"), F.col("ts").alias("timestamp"), "close")
    return FL.clean_prices(df)


@plan("txt19_normalize_symbol", oracle="""
    WITH a AS (SELECT asset_id, ticker, asset_type,
                      CASE asset_type WHEN 'forex' THEN 'EUR' || ticker || 'X' WHEN 'crypto' THEN ticker || '-USD'
                                      ELSE ticker || '.B' END AS sym FROM f_asset)
    SELECT asset_id, sym,
           CASE WHEN length(sym) = 6 THEN sym[1:3] || '/' || sym[4:6] ELSE sym END AS forex,
           CASE WHEN ends_with(regexp_replace(upper(sym), '[-/]', '', 'g'), 'USD')
                THEN regexp_replace(upper(sym), '[-/]', '', 'g')[1:-4] ELSE regexp_replace(upper(sym), '[-/]', '', 'g')
           END || 'USDT' AS crypto,
           CASE WHEN asset_type = 'forex' AND length(replace(upper(sym), '/', '')) = 6
                     AND regexp_matches(replace(upper(sym), '/', ''), '^[A-Z]+$')
                THEN replace(upper(sym), '/', '')[1:3] || '/' || replace(upper(sym), '/', '')[4:6]
                WHEN asset_type = 'crypto' AND length(replace(upper(sym), '/', '')) <= 5
                     AND regexp_matches(replace(upper(sym), '/', ''), '^[A-Z0-9]+$')
                THEN replace(upper(sym), '/', '') || '/USD' ELSE upper(sym) END AS twelve,
           replace(sym, '-USD', 'USDT') AS binance, replace(sym, '.', '-') AS polygon,
           CASE WHEN ends_with(upper(replace(sym, '-USD', 'USDT')), 'USDT')
                  OR ends_with(upper(replace(sym, '-USD', 'USDT')), 'BUSD') THEN 'binance' ELSE 'polygon' END AS route
    FROM a""")
def txt19(t):
    """TXT-19: symbol spellings and routing for every asset (forex/crypto/class-share variants)."""
    sym = (F.when(F.col("asset_type") == "forex", F.concat(F.lit("EUR"), F.col("ticker"), F.lit("X")))
           .when(F.col("asset_type") == "crypto", F.concat(F.col("ticker"), F.lit("-USD")))
           .otherwise(F.concat(F.col("ticker"), F.lit(".B"))))
    a = t.asset.withColumn("sym", sym)
    return a.select("asset_id", "sym", T.forex_symbol("sym").alias("forex"), T.crypto_symbol("sym").alias("crypto"),
                    T.twelve_symbol("sym", "asset_type").alias("twelve"),
                    T.provider_symbol("sym", "binance").alias("binance"),
                    T.provider_symbol("sym", "polygon").alias("polygon"),
                    T.route_provider(T.provider_symbol("sym", "binance")).alias("route"))


@plan("flt06_filter_low_signal", oracle="""
    SELECT count(*) AS kept FROM events
    WHERE event_id % 53 <> 0 AND (CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 + 1) >= 2
      AND event_id % 41 <> 0 AND event_id % 11 <> 0 AND event_id % 37 <> 0""")
def flt06(t):
    """FLT-06: low-signal filter over the landed GDELT rows (articles >= 2, code, actor, 8-digit date)."""
    from eventlens.operators.filters import filter_low_signal
    from eventlens.plans.source_plans import _land_gdelt
    from eventlens.sources.events import read_gdelt
    return filter_low_signal(read_gdelt(t.spark, _land_gdelt(t))).agg(F.count(F.lit(1)).alias("kept"))


@plan("flt07_language_gate", oracle=f"""
    SELECT article_id FROM (
      SELECT article_id, CASE WHEN nchar = 0 OR ntok = 0 THEN 'unknown' ELSE 'en' END AS code,
             CASE WHEN nchar = 0 OR ntok = 0 THEN 0.0
                  WHEN ratio >= 0.95 AND ntok >= 3 THEN greatest(c, 0.82) ELSE c END AS conf
      FROM (SELECT *, least(0.92, 0.52 + stop / greatest(1, ntok) * 1.6 + ratio * 0.18) AS c
            FROM (SELECT article_id, length({NORM}) AS nchar, len({_TOKS}) AS ntok,
                         len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) AS stop,
                         {_ASCII_RATIO} AS ratio FROM f_article)))
    WHERE code IN ('en') AND conf >= 0.80""")
def flt07(t):
    """FLT-07: articles passing the language gate (allowed 'en', confidence >= 0.80)."""
    return FL.language_gate(FL.annotate_articles(t.article)).select("article_id")


@plan("flt08_relevance_gate", oracle=f"""
    SELECT article_id, 'relevant' AS relevance_label FROM (
      SELECT article_id, CAST({_relevance_sql()} AS DOUBLE) AS s FROM f_article) WHERE s >= 0.58""")
def flt08(t):
    """FLT-08: articles at or above the 0.58 relevance threshold, labelled."""
    a = _prep(t).select("article_id", T.relevance_score(norm="_t_norm", nlow="_t_nlow", source="source")
                        .alias("relevance_score"))
    return FL.relevance_gate(a).select("article_id", "relevance_label")
