"""Search, gates, cleaning and article annotation (FLT-*, TXT-01, TXT-06)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.functions.common import like_escape, settled


def _like(term: str) -> str:
    # User text keeps its LIKE meaning ('%' and '_' act as wildcards), as in the reference.
    return f"%{term}%"


def search_events(events: DataFrame, impacts: DataFrame, assets: DataFrame, tags: DataFrame,
                  q: str | None = None, status: str | None = "published",
                  event_type: str | None = None, country: str | None = None,
                  limit: int = 50, offset: int = 0) -> DataFrame:
    """FLT-01: event search, newest first (NULL times first, as PostgreSQL
    sorts DESC), then ``offset``/``limit``.

    The free-text term matches six event columns, or any impacted asset's
    ticker/name, or any tag. The two existence tests are semi-joins whose
    matching ids are unioned and left-joined as a flag, so no per-event lookup
    and no OR-of-subqueries (which Spark would run as an existence join per
    branch).
    """
    e = events
    if status:
        s = status.lower()
        if s == "published":
            e = e.where(F.col("status").isin(L.PUBLISHED_STATUSES))
        elif s != "all":
            e = e.where(F.col("status") == T.parse_enum(F.lit(status), L.EVENT_STATUSES))
    if event_type:
        e = e.where(F.col("event_type") == T.parse_enum(F.lit(event_type), L.EVENT_TYPES))
    if country:
        e = e.where(F.col("country").ilike(_like(country)))
    if q and q.strip():
        pat = _like(q.strip())
        text_hit = None
        for c in ["title", "description", "country", "region", "source", "event_type"]:
            h = F.coalesce(F.col(c).ilike(pat), F.lit(False))
            text_hit = h if text_hit is None else (text_hit | h)
        a = assets.where(F.col("ticker").ilike(pat) | F.col("name").ilike(pat)).select("asset_id")
        ids_a = impacts.join(a, "asset_id", "left_semi").select("event_id")
        ids_t = tags.where(F.col("tag").ilike(pat)).select("event_id")
        ids = ids_a.union(ids_t).distinct().withColumn("_hit", F.lit(True))
        e = (e.join(ids, "event_id", "left")
             .where(text_hit | F.coalesce(F.col("_hit"), F.lit(False))).drop("_hit"))
    return (e.orderBy(F.col("published_at").desc_nulls_first(), F.col("event_id").desc())
            .offset(offset).limit(limit))


def categorize_news(articles: DataFrame) -> DataFrame:
    """TXT-06: category, matched event type and 220-char snippet per article."""
    p = articles.withColumn("_cat_low", F.lower(T.article_text("title", "content")))
    return (p.withColumn("category", T.news_category(low="_cat_low")).drop("_cat_low")
            .withColumn("matched_event_type", T.matched_event_type("category"))
            .withColumn("snippet", T.snippet("content")))


def search_news(articles: DataFrame, q: str | None = None, category: str | None = None,
                limit: int = 50, offset: int = 0) -> DataFrame:
    """FLT-02: ILIKE over title/content/source/url, then the derived category,
    then the page, newest first (NULL times first)."""
    a = articles
    if q and q.strip():
        pat = _like(q.strip())
        hit = None
        for c in ["title", "content", "source", "url"]:
            h = F.coalesce(F.col(c).ilike(pat), F.lit(False))
            hit = h if hit is None else (hit | h)
        a = a.where(hit)
    a = categorize_news(a)
    if category:
        a = a.where(F.col("category") == category.strip().lower().replace(" ", "_"))
    return (a.orderBy(F.col("published_at").desc_nulls_first(), F.col("article_id").desc())
            .offset(offset).limit(limit))


def list_assets(assets: DataFrame, asset_type: str | None = None, sector: str | None = None,
                limit: int = 100) -> DataFrame:
    """FLT-03: assets by type and sector (ILIKE), ordered by ticker."""
    a = assets
    if asset_type:
        a = a.where(F.col("asset_type") == T.parse_enum(F.lit(asset_type), L.ASSET_TYPES))
    if sector:
        a = a.where(F.col("sector").ilike(_like(sector)))
    return a.orderBy("ticker").limit(limit)


def filter_low_signal(raw: DataFrame, date: str = "SQLDATE", code: str = "EventCode",
                      actor: str = "Actor1Name", articles: str = "NumArticles") -> DataFrame:
    """FLT-06: articles >= 2, non-empty event code and actor, 8-character date."""
    n = F.coalesce(F.expr(f"try_cast(`{articles}` AS INT)"), F.lit(0))
    return raw.where((n >= 2) & (F.length(F.trim(F.col(code))) > 0)
                     & (F.length(F.trim(F.col(actor))) > 0)
                     & (F.length(F.trim(F.col(date))) == 8))


def language_gate(df: DataFrame, code: str = "language_code", conf: str = "language_confidence",
                  allowed=L.ALLOWED_LANGUAGES, min_conf: float = L.MIN_LANGUAGE_CONFIDENCE) -> DataFrame:
    """FLT-07: language code allowed and confidence >= 0.80 (empty list: all pass)."""
    if not allowed:
        return df
    return df.where(F.col(code).isin(list(allowed)) & (F.col(conf) >= min_conf))


def relevance_gate(df: DataFrame, score: str = "relevance_score",
                   threshold: float = L.RELEVANCE_THRESHOLD) -> DataFrame:
    """FLT-08: label column and rows at or above the threshold."""
    return (settled(df, score).withColumn("relevance_label",
                                          F.when(F.col(score) >= threshold, "relevant").otherwise("irrelevant"))
            .where(F.col(score) >= threshold))


def clean_prices(df: DataFrame, by: str = "symbol", ts: str = "timestamp",
                 close: str = "close", spike: float = 5.0) -> DataFrame:
    """FLT-10: drop NULL closes and flag one-step moves above +500 % per symbol."""
    d = df.where(F.col(close).isNotNull())
    w = Window.partitionBy(by).orderBy(ts)
    ret = F.col(close) / F.lag(close).over(w) - 1
    return d.withColumn("pct_change", ret).withColumn(
        "spike", F.coalesce(F.col("pct_change") > spike, F.lit(False)))


def dedup_articles(new: DataFrame, existing: DataFrame | None = None,
                   order: str = "created_at", key: str = "article_id") -> DataFrame:
    """TXT-01: hash each article, keep the first per hash and drop hashes that
    already exist. First = smallest (order, key)."""
    h = new.withColumn("content_hash", T.content_hash("title", "content"))
    # min_by over a struct is a partial aggregate: a hash shared by a third of
    # the rows is reduced map-side instead of sorted in one task.
    rest = [c for c in h.columns if c != "content_hash"]
    first = (h.groupBy("content_hash")
             .agg(F.min_by(F.struct(*rest), F.struct(F.col(order), F.col(key))).alias("_r"))
             .select("content_hash", "_r.*"))
    if existing is not None:
        first = first.join(existing.select("content_hash"), "content_hash", "left_anti")
    return first


def annotate_articles(articles: DataFrame) -> DataFrame:
    """Per-article NLP columns (TXT-04/05/08): language, relevance, sentiment."""
    p = T.prepare_text(articles, T.article_text("title", "content"), "_a")
    return (p.withColumn("_lang", T.language_score(norm="_a_norm"))
            .withColumn("language_code", F.col("_lang.code"))
            .withColumn("language_confidence", F.col("_lang.confidence"))
            .withColumn("relevance_score", T.relevance_score(norm="_a_norm", nlow="_a_nlow", source="source"))
            .withColumn("relevance_label", T.relevance_label("relevance_score"))
            .withColumn("sentiment_score", T.sentiment(norm="_a_norm", nlow="_a_nlow"))
            .drop("_lang", "_a_low", "_a_norm", "_a_nlow"))
