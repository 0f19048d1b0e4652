"""Registered queries for sources and sinks. Landed files and provider
payloads are produced from the test tables (so their size follows the
tables), written under the shared checkpoint folder where a file is needed,
and read back through the source operators."""
from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from eventlens import fixtures as FX
from eventlens import sinks
from eventlens.functions.common import elem
from eventlens.plans.base import plan
from eventlens.session import ensure_checkpoint_dir
from eventlens.sources import events as SE
from eventlens.sources import payloads as SP


def _scratch(t, name):
    return os.path.join(ensure_checkpoint_dir(t.spark), "landed", f"{name}-{uuid.uuid4().hex[:8]}")


def gdelt_lines(t):
    """GDELT export lines built from the events table: some rows lack a date
    or a code, some are short (40 fields) or long (60 fields)."""
    ev = t.raw("events")
    eid, uid = F.col("event_id"), F.col("user_id")
    k = F.get_json_object("props", "$.k").cast("int")
    s = lambda c: c.cast("string")
    date = F.when(eid % 37 == 0, F.lit("")).otherwise(F.date_format("ts", "yyyyMMdd"))
    root = F.lpad(s(eid % 20 + 1), 2, "0")
    code = F.when(eid % 41 == 0, F.lit("")).otherwise(F.concat(root, F.lit("0")))
    country = elem(FX.FIXTURE_COUNTRIES, uid % 12)
    url = F.when(eid % 10 == 0, F.concat(F.lit("https://www.reuters.com/world/"), s(eid))) \
        .otherwise(F.concat(F.lit("https://news"), s(eid % 9), F.lit(".example.com/a/"), s(eid)))
    vals = {
        "GLOBALEVENTID": s(eid), "SQLDATE": date, "Actor1Code": F.concat(F.lit("A"), s(uid % 9)),
        "Actor1Name": F.when(eid % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("USER"), s(uid))),
        "Actor1CountryCode": F.concat(F.lit("C"), s(uid % 5)),
        "Actor2Name": F.when(eid % 2 == 0, F.concat(F.lit("PEER"), s(eid % 13))).otherwise(F.lit("")),
        "IsRootEvent": F.lit("1"), "EventCode": code, "EventBaseCode": code, "EventRootCode": root,
        "QuadClass": s(eid % 4 + 1), "GoldsteinScale": s((k - 50) / 5), "NumMentions": s(k),
        "NumSources": s(k % 5), "NumArticles": s(k % 12 + 1), "AvgTone": s((F.col("value") - 245) / 50),
        "ActionGeo_FullName": country, "ActionGeo_CountryCode": F.when(eid % 7 == 0, F.lit("")).otherwise(
            F.substring(F.upper(country), 1, 2)), "DATEADDED": date, "SOURCEURL": url,
    }
    fields = [vals.get(c, F.lit("")) for c in SE.GDELT_COLUMNS]
    n = F.when(eid % 53 == 0, 40).when(eid % 59 == 0, 60).otherwise(58)
    arr = F.concat(F.array(*fields), F.array(F.lit("x"), F.lit("y")))
    return ev.select(F.array_join(F.slice(arr, 1, n), "\t").alias("value"))


_GDELT_SQL = """
    WITH r AS (
      SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             CASE WHEN event_id % 37 = 0 THEN '' ELSE strftime(ts, '%Y%m%d') END AS d,
             lpad(CAST(event_id % 20 + 1 AS VARCHAR), 2, '0') AS root, value,
             CASE WHEN event_id % 11 = 0 THEN '' ELSE 'USER' || user_id END AS a1,
             CASE WHEN event_id % 2 = 0 THEN 'PEER' || (event_id % 13) ELSE '' END AS a2,
             {countries}[user_id % 12 + 1] AS loc,
             CASE WHEN event_id % 10 = 0 THEN 'https://www.reuters.com/world/' || event_id
                  ELSE 'https://news' || (event_id % 9) || '.example.com/a/' || event_id END AS url
      FROM events WHERE event_id % 53 <> 0),
    n AS (
      SELECT *, CASE WHEN event_id % 41 = 0 THEN '' ELSE root || '0' END AS code,
             CASE WHEN event_id % 7 = 0 THEN 'C' || (user_id % 5) ELSE upper(loc)[1:2] END AS country,
             CASE root {root_map} ELSE 'Economic Data' END AS etype
      FROM r)
    SELECT sha1(array_to_string(list_filter([d[1:4] || '-' || d[5:6] || '-' || d[7:8], code, lower(url), lower(a1),
                                             lower(a2), lower(country), lower(loc)], lambda x: x <> ''), '|'))
             AS canonical_id,
           CAST(event_id AS VARCHAR) AS provider_record_id, d[1:4] || '-' || d[5:6] || '-' || d[7:8] AS event_date,
           CASE WHEN a1 <> '' AND a2 <> '' THEN a1 || ' / ' || a2 || ' - ' || etype
                WHEN a1 <> '' THEN a1 || ' - ' || etype WHEN a2 <> '' THEN a2 || ' - ' || etype
                ELSE etype || ' - ' || loc END AS title,
           lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS source_name, country, etype AS event_type,
           CAST(k % 12 + 1 AS BIGINT) AS num_articles,
           round(((k - 50) / 5 + (value - 245) / 50) / 2.0, 4) AS sentiment_score
    FROM n WHERE d <> '' AND code <> ''"""


_GDELT_FULL = """
    WITH r AS (
      SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, ts,
             CASE WHEN event_id % 37 = 0 THEN '' ELSE strftime(ts, '%Y%m%d') END AS d,
             lpad(CAST(event_id % 20 + 1 AS VARCHAR), 2, '0') AS root, value,
             CASE WHEN event_id % 11 = 0 THEN '' ELSE 'USER' || user_id END AS a1,
             CASE WHEN event_id % 2 = 0 THEN 'PEER' || (event_id % 13) ELSE '' END AS a2,
             {countries}[user_id % 12 + 1] AS loc,
             CASE WHEN event_id % 10 = 0 THEN 'https://www.reuters.com/world/' || event_id
                  ELSE 'https://news' || (event_id % 9) || '.example.com/a/' || event_id END AS url
      FROM events WHERE event_id % 53 <> 0),
    n AS (
      SELECT *, CASE WHEN event_id % 41 = 0 THEN '' ELSE root || '0' END AS code,
             CASE WHEN event_id % 7 = 0 THEN 'C' || (user_id % 5) ELSE upper(loc)[1:2] END AS country,
             CASE root {root_map} ELSE 'Economic Data' END AS etype
      FROM r),
    g AS (
      SELECT sha1(array_to_string(list_filter([d[1:4] || '-' || d[5:6] || '-' || d[7:8], code, lower(url), lower(a1),
                                               lower(a2), lower(country), lower(loc)], lambda x: x <> ''), '|'))
               AS canonical_id, 'gdelt' AS provider, CAST(event_id AS VARCHAR) AS provider_record_id,
             d[1:4] || '-' || d[5:6] || '-' || d[7:8] || 'T00:00:00Z' AS published_at,
             d[1:4] || '-' || d[5:6] || '-' || d[7:8] AS event_date,
             CASE WHEN a1 <> '' AND a2 <> '' THEN a1 || ' / ' || a2 || ' - ' || etype
                  WHEN a1 <> '' THEN a1 || ' - ' || etype WHEN a2 <> '' THEN a2 || ' - ' || etype
                  ELSE etype || ' - ' || loc END AS title,
             array_to_string(list_filter([a1, a2, loc], lambda x: x <> ''), ' / ') || ' mapped to ' || etype
               || ' (' || k || ' mentions, ' || (k % 12 + 1) || ' articles)' AS description,
             country, loc AS location_name, nullif(a1, '') AS actor1, nullif(a2, '') AS actor2, etype AS event_type,
             code AS sub_event_type, CAST(k AS BIGINT) AS num_mentions, CAST(k % 5 AS BIGINT) AS num_sources,
             CAST(k % 12 + 1 AS BIGINT) AS num_articles,
             round(((k - 50) / 5 + (value - 245) / 50) / 2.0, 4) AS sentiment_score,
             (k - 50) / 5 AS goldstein, contains(lower(url), 'reuters') AS is_reuters
      FROM n WHERE d <> '' AND code <> '')
    """


def gdelt_full_sql(select: str) -> str:
    root_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SE.GDELT_ROOT_EVENT_MAP.items())
    countries = "[" + ", ".join(f"'{c}'" for c in FX.FIXTURE_COUNTRIES) + "]"
    return _GDELT_FULL.format(root_map=root_map, countries=countries) + select


def _gdelt_oracle():
    root_map = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SE.GDELT_ROOT_EVENT_MAP.items())
    countries = "[" + ", ".join(f"'{c}'" for c in FX.FIXTURE_COUNTRIES) + "]"
    return _GDELT_SQL.format(root_map=root_map, countries=countries)


@plan("src01_gdelt_scan_normalize", oracle=_gdelt_oracle())
def src01(t):
    """SRC-01/02: GDELT TSV files landed from the events table, scanned and normalised."""
    path = _scratch(t, "gdelt")
    gdelt_lines(t).write.text(path)
    n = SE.normalize_gdelt(SE.read_gdelt(t.spark, path))
    return n.select("canonical_id", "provider_record_id", "event_date", "title", "source_name", "country",
                    "event_type", "num_articles", "sentiment_score")


_ACLED_SQL = """
    WITH r AS (
      SELECT o_orderkey AS ok, CAST(o_orderdate AS DATE) AS d, {countries}[o_orderkey % 12 + 1] AS country,
             'Region ' || (o_orderkey % 5) AS admin1,
             ['Battles', 'Protests', 'Riots', 'Strategic developments', ''][o_orderkey % 5 + 1] AS ev,
             ['Political violence', 'Demonstrations'][o_orderkey % 2 + 1] AS dis,
             o_orderkey % 9 AS events, o_orderkey % 3 AS fat
      FROM orders)
    SELECT sha1(array_to_string(list_filter([CAST(d AS VARCHAR), lower(country), lower(admin1), lower(ev),
                                             'acled_fixture'], lambda x: x <> ''), '|')) AS canonical_id,
           CAST(ok AS VARCHAR) AS provider_record_id, CAST(d AS VARCHAR) AS event_date,
           ev || ' - ' || admin1 || ' - ' || country AS title,
           'ACLED weekly aggregate with ' || events || ' event(s) and ' || fat || ' fatalities' AS description,
           country, admin1,
           CASE lower(ev) WHEN 'strategic developments' THEN 'Regulation' ELSE 'Conflict' END AS event_type,
           ev AS sub_event_type, CAST(fat AS BIGINT) AS fatalities, CAST(events AS BIGINT) AS num_articles,
           CASE WHEN fat > 0 THEN -CAST(fat AS DOUBLE) WHEN contains(lower(dis), 'violence') THEN -1.0 ELSE 0.0 END
             AS sentiment_score,
           CASE WHEN fat > 0 OR contains(lower(dis), 'violence') THEN 'negative' ELSE 'neutral' END AS sentiment_label
    FROM r WHERE ev <> ''"""


@plan("src03_acled_normalize", oracle=_ACLED_SQL.format(
    countries="[" + ", ".join(f"'{c}'" for c in FX.FIXTURE_COUNTRIES) + "]"))
def src03(t):
    """SRC-03/04/05: ACLED-style weekly CSV (mixed date formats, lower-case
    headers) landed from the orders table, sniffed, read and normalised."""
    n = SE.normalize_acled(SE.read_rows(t.spark, _land_acled(t)), "acled_fixture")
    return n.select("canonical_id", "provider_record_id", "event_date", "title", "description", "country", "admin1",
                    "event_type", "sub_event_type", "fatalities", "num_articles", "sentiment_score", "sentiment_label")


def _land_acled(t) -> str:
    """Weekly files from the orders; tab-separated, one quarter with semicolons."""
    o = t.raw("orders")
    ok = F.col("o_orderkey")
    week = (F.when(ok % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
            .when(ok % 4 == 1, F.date_format("o_orderdate", "MM/dd/yyyy"))
            .when(ok % 4 == 2, (F.datediff("o_orderdate", F.lit("1899-12-30")).cast("string")))
            .otherwise(F.date_format("o_orderdate", "yyyyMMdd")))
    rows = o.select(week.alias("week"), elem(FX.FIXTURE_COUNTRIES, ok % 12).alias("country"),
                    F.concat(F.lit("Region "), (ok % 5).cast("string")).alias("admin1"),
                    elem(["Battles", "Protests", "Riots", "Strategic developments", ""], ok % 5).alias("event_type"),
                    F.lit("").alias("sub_event_type"),
                    elem(["Political violence", "Demonstrations"], ok % 2).alias("disorder_type"),
                    (ok % 9).cast("string").alias("events"), (ok % 3).cast("string").alias("fatalities"),
                    ok.cast("string").alias("id"))
    path = _scratch(t, "acled")
    rows.where("cast(id as bigint) % 4 > 0").write.option("header", True).option("sep", "\t").csv(f"{path}/tabs")
    rows.where("cast(id as bigint) % 4 = 0").write.option("header", True).option("sep", ";").csv(f"{path}/semicolons")
    return path


@plan("src05_parse_date", oracle="""
    SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2,
           CAST(o_orderdate AS DATE) AS d3, CAST(o_orderdate AS DATE) AS d4, CAST(o_orderdate AS DATE) AS d5,
           CAST(NULL AS DATE) AS d6, o_orderdate AS t1, o_orderdate AS t2
    FROM orders""")
def src05(t):
    """SRC-05/06: every date/timestamp format parsed back from order dates."""
    o = t.raw("orders")
    d = F.col("o_orderdate")
    return o.select("o_orderkey",
                    SE.parse_date(F.date_format(d, "yyyyMMdd")).alias("d1"),
                    SE.parse_date(F.datediff(d, F.lit("1899-12-30")).cast("string")).alias("d2"),
                    SE.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("d3"),
                    SE.parse_date(F.date_format(d, "MM/dd/yyyy")).alias("d4"),
                    SE.parse_date(F.date_format(d, "yyyy/MM/dd")).alias("d5"),
                    SE.parse_date(F.lit("not a date")).alias("d6"),
                    SE.parse_ts(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("t1"),
                    SE.parse_ts(F.date_format(d, "yyyyMMdd'T'HHmmss'Z'")).alias("t2"))


@plan("src07_news_payloads", oracle="""
    SELECT title, CASE article_id % 5 WHEN 1 THEN NULL WHEN 3 THEN left(content, 200) ELSE content END AS content,
           CASE article_id % 5 WHEN 1 THEN 'www.' || article_id % 7 || '.example' ELSE source END AS source, url,
           published_at,
           sha256(title || '::' || CASE article_id % 5 WHEN 0 THEN coalesce(left(content, 200), '') WHEN 1 THEN url
                                                        WHEN 2 THEN content WHEN 3 THEN trim(left(content, 200)) ELSE content END) AS content_hash
    FROM f_article""")
def src07(t):
    """SRC-07: payloads of all five news providers (an article goes to one of them) built from the articles and parsed back."""
    a = t.article
    iso = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    short = F.substring("content", 1, 200)
    minute = F.date_trunc("minute", "published_at").alias("minute")

    def sent(k: int, wrap, fields: dict, *by):
        art = F.struct(*[c.alias(n) for n, c in fields.items()])
        return (a.where(F.col("article_id") % 5 == k).groupBy(minute, *by)
                .agg(F.to_json(wrap(F.collect_list(art))).alias("payload")))

    title, url, body = F.col("title"), F.col("url"), F.col("content")
    payloads = {
        "newsapi": sent(0, lambda x: F.struct(x.alias("articles")), {
            "title": title, "description": short, "content": body, "url": url, "publishedAt": iso, "source": F.struct(F.col("source").alias("name"))}),
        "gdelt": sent(1, lambda x: F.struct(x.alias("articles")), {
            "title": title, "url": url, "seendate": F.date_format("published_at", "yyyyMMdd'T'HHmmss'Z'"),
            "domain": F.concat(F.lit("www."), (F.col("article_id") % 7).cast("string"), F.lit(".example"))}),
        "eventregistry": sent(2, lambda x: F.struct(F.struct(x.alias("results")).alias("articles")), {
            "title": title, "body": body, "url": url, "dateTimePub": iso, "source": F.struct(F.col("source").alias("title"))}),
        "mediastack": sent(3, lambda x: F.struct(x.alias("data")), {
            "title": title, "description": short, "content": short, "url": url, "published_at": iso, "source": F.col("source")}),
        "rss": sent(4, lambda x: F.struct(F.struct(F.col("source").alias("title")).alias("feed"), x.alias("entries")), {
            "title": title, "summary": body, "link": url, "published": iso}, "source"),
    }
    out = None
    for provider, p in payloads.items():
        rows = SP.normalize_news(p, provider)
        out = rows if out is None else out.unionByName(rows)
    return out


@plan("src08_read_klines", oracle="""
    SELECT symbol, epoch_ms(open_time) AS open_time, open, high, low,
           CASE WHEN day(open_time) <= 10 THEN close ELSE close + 1 END AS close, volume,
           CAST(epoch_ms(open_time) + 3599999 AS DOUBLE) AS close_time, volume AS base_asset_volume,
           CAST(num_trades AS DOUBLE) AS num_trades, taker_buy_volume, taker_buy_volume AS taker_buy_base_asset_volume,
           0.0::DOUBLE AS ignore
    FROM f_kline""")
def src08(t):
    """SRC-08: kline CSV files (one folder per symbol) landed from the kline table and read back; one row per
    (symbol, open time). Monthly files hold every bar with its close off by one, daily files the first ten days of
    each month as they are: where both have a bar, the daily one wins."""
    k = t.kline.select(F.col("symbol"), (F.unix_micros("open_time") / 1000).cast("long").alias("open_time"),
                       "open", "high", "low", "close", "volume",
                       ((F.unix_micros("open_time") / 1000).cast("long") + 3599999).alias("close_time"),
                       "volume", "num_trades", "taker_buy_volume", "taker_buy_volume", F.lit(0).alias("ignore"))
    path = _scratch(t, "klines")
    first_days = F.dayofmonth(F.timestamp_millis("open_time")) <= 10
    k.withColumn("close", F.col("close") + 1).write.partitionBy("symbol").csv(os.path.join(path, "monthly"))
    k.where(first_days).write.partitionBy("symbol").csv(os.path.join(path, "daily"))
    return SP.read_klines(t.spark, os.path.join(path, "*", "*", "*.csv"))


_OHLCV_SQL = """
    SELECT asset_id AS ticker, ts, open, high, low, close, volume,
           CAST(row_number() OVER (PARTITION BY asset_id ORDER BY ts DESC) AS INTEGER) AS rank
    FROM f_bar"""


@plan("src09_ohlcv_alphavantage", oracle=_OHLCV_SQL)
def src09(t):
    """SRC-09: daily-series payloads (one per asset-month) built from the bars and parsed back."""
    b = t.bar
    vals = F.create_map(F.lit("1. open"), F.col("open").cast("string"), F.lit("2. high"), F.col("high").cast("string"),
                        F.lit("3. low"), F.col("low").cast("string"), F.lit("4. close"), F.col("close").cast("string"),
                        F.lit("5. volume"), F.col("volume").cast("string"))
    p = (b.groupBy(F.col("asset_id").alias("ticker"), F.date_trunc("month", "ts").alias("m"))
         .agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.date_format("ts", "yyyy-MM-dd"), vals)))
                                 .alias("Time Series (Daily)"))).alias("payload")))
    return SP.normalize_ohlcv(p, "alphavantage")


@plan("src09_ohlcv_binance", oracle=_OHLCV_SQL)
def src09b(t):
    """SRC-09: kline-array payloads (one per asset-month) built from the bars and parsed back."""
    b = t.bar
    row = F.array((F.unix_micros("ts") / 1000).cast("long").cast("string"), F.col("open").cast("string"),
                  F.col("high").cast("string"), F.col("low").cast("string"), F.col("close").cast("string"),
                  F.col("volume").cast("string"))
    p = (b.groupBy(F.col("asset_id").alias("ticker"), F.date_trunc("month", "ts").alias("m"))
         .agg(F.to_json(F.collect_list(row)).alias("payload")))
    return SP.normalize_ohlcv(p, "binance")


@plan("src09_ohlcv_others", oracle=_OHLCV_SQL)
def src09c(t):
    """SRC-09: payloads of the polygon, twelvedata, fcs and eodhd shapes (an asset's bars by one of them) built from the bars and parsed back."""
    b = t.bar
    num = {c: F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")}
    short = {k[0]: v for k, v in num.items()}
    ticker = F.col("asset_id").cast("string")

    def sent(k: int, fields: dict, wrap):
        row = F.struct(*[c.alias(n) for n, c in fields.items()])
        return (b.where(F.col("asset_id") % 4 == k).groupBy(ticker.alias("ticker"), F.date_trunc("month", "ts").alias("m"))
                .agg(F.to_json(wrap(F.collect_list(row))).alias("payload")))

    day = F.date_format("ts", "yyyy-MM-dd")
    parts = {
        "polygon": sent(0, {"t": (F.unix_micros("ts") / 1000).cast("long").cast("string"), **short}, lambda x: F.struct(x.alias("results"))),
        "twelvedata": sent(1, {"datetime": day, **num}, lambda x: F.struct(x.alias("values"))),
        "fcs": sent(2, {"t": F.unix_seconds("ts").cast("string"), **short},
                    lambda x: F.struct(F.lit(True).alias("status"), F.create_map(F.first(ticker), x).alias("response"))),
        "eodhd": sent(3, {"date": day, **num}, lambda x: x),
    }
    out = None
    for provider, p in parts.items():
        rows = SP.normalize_ohlcv(p, provider)
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("ticker", F.col("ticker").cast("bigint"))


@plan("src10_quotes", oracle="""
    SELECT asset_id AS ticker, price, CASE WHEN provider = 'polygon' THEN 0.0 ELSE change END::DOUBLE AS change,
           CASE WHEN provider IN ('polygon', 'finnhub') THEN as_of END AS as_of, provider AS source
    FROM f_quote WHERE price > 0""")
def src10(t):
    """SRC-10: quote payloads of all seven providers built from the quote table and parsed back (missing and non-positive prices rejected)."""
    price, change = F.col("price").alias, F.col("change").alias
    text = lambda c, n: F.col(c).cast("string").alias(n)
    shapes = {
        "polygon": F.struct(F.array(F.struct(price("p"), (F.unix_micros("as_of") / 1000).cast("long").alias("t"))).alias("results")),
        "finnhub": F.struct(price("c"), change("d"), F.unix_seconds("as_of").alias("t")),
        "twelvedata": F.struct(text("price", "price"), text("change", "change")),
        "binance": F.struct(text("price", "lastPrice"), text("change", "priceChangePercent")),
        "fcs": F.struct(F.array(F.struct(text("price", "c"), text("change", "ch"))).alias("response")),
        "alphavantage": F.struct(F.struct(text("price", "05. price"), text("change", "09. change")).alias("Global Quote")),
        "eodhd": F.struct(price("close"), change("change")),
    }
    out = None
    for provider, shape in shapes.items():
        p = t.quote.where(F.col("provider") == provider).select(F.col("asset_id").alias("ticker"), F.to_json(shape).alias("payload"))
        rows = SP.normalize_quote(p, provider)
        out = rows if out is None else out.unionByName(rows)
    return out


@plan("src11_trades", oracle="""
    SELECT upper(ticker) AS ticker, price, ts FROM f_trade
    UNION ALL SELECT upper(ticker), price, ts FROM f_trade""")
def src11(t):
    """SRC-11: every trade sent through both feeds (polygon arrays and finnhub
    objects per ticker-minute) and parsed back: each trade appears twice."""
    tr = t.trade
    msg = F.struct(F.lit("T").alias("ev"), F.lower("ticker").alias("sym"), F.col("price").alias("p"),
                   F.unix_micros("ts").cast("string").alias("t"))
    poly = (tr.groupBy("ticker", F.date_trunc("minute", "ts"))
            .agg(F.to_json(F.collect_list(msg)).alias("payload")))
    fin = (tr.groupBy("ticker", F.date_trunc("minute", "ts"))
           .agg(F.to_json(F.struct(F.lit("trade").alias("type"), F.collect_list(F.struct(
               F.col("ticker").alias("s"), F.col("price").alias("p"),
               F.unix_micros("ts").cast("string").alias("t"))).alias("data"))).alias("payload")))
    return SP.parse_trades(poly, "polygon").unionByName(SP.parse_trades(fin, "finnhub"))


@plan("src13_profiles", oracle="""
    SELECT upper(ticker) AS ticker, company, industry, country FROM f_profile""")
def src13(t):
    """SRC-13: knowledge-base result bindings built from the profile table (one payload per ticker) and flattened."""
    p = t.profile
    b = F.struct(F.struct(F.col("ticker").alias("value")).alias("ticker"),
                 F.struct(F.col("company").alias("value")).alias("companyLabel"),
                 F.struct(F.col("industry").alias("value")).alias("industryLabel"),
                 F.struct(F.col("country").alias("value")).alias("countryLabel"))
    payload = (p.groupBy("ticker")
               .agg(F.to_json(F.struct(F.struct(F.collect_list(b).alias("bindings")).alias("results"))).alias("payload")))
    return SP.normalize_profiles(payload)


@plan("src15_events_jsonl", oracle=gdelt_full_sql("""
    SELECT CAST(event_date AS TIMESTAMP) AS published_at, sentiment_score AS sentiment, goldstein,
           num_articles, num_mentions, event_type FROM g"""))
def src15(t):
    """SRC-15: normalised-event JSON lines (with corrupt lines) landed from the GDELT normalisation and re-read."""
    n = SE.normalize_gdelt(SE.read_gdelt(t.spark, _land_gdelt(t)))
    path = _scratch(t, "jsonl")
    good = n.select(F.to_json(F.struct(*n.columns)).alias("value"))
    bad = t.raw("supplier").select(F.concat(F.lit("{not json "), F.col("s_name")).alias("value"))
    good.unionByName(bad).write.text(path)
    return SE.read_events_jsonl(t.spark, path)


def _land_gdelt(t):
    path = _scratch(t, "gdelt")
    gdelt_lines(t).write.text(path)
    return path


def _combined(t):
    raw = SE.read_gdelt(t.spark, _land_gdelt(t))
    reut = SE.normalize_gdelt(raw.where(SE.is_reuters("SOURCEURL", "Actor1Code", "Actor1Name", "Actor2Code",
                                                      "Actor2Name")), "reuters")
    weekly = SE.read_rows(t.spark, _land_acled(t))
    return SE.combine_events(reut, SE.normalize_acled(weekly, "acled_fixture"), SE.normalize_gdelt(raw, "gdelt"),
                             read={"reuters": raw, "acled": weekly, "gdelt": raw})


@plan("src16_combine_events", oracle=gdelt_full_sql("""
    SELECT 'reuters' AS provider, (SELECT count(*) FROM g WHERE is_reuters) AS written,
           (SELECT count(*) FROM n) - (SELECT count(*) FROM g WHERE is_reuters) AS skipped
    UNION ALL
    SELECT 'acled', count(*) FILTER (WHERE o_orderkey % 5 <> 4), count(*) FILTER (WHERE o_orderkey % 5 = 4) FROM orders
    UNION ALL
    SELECT 'gdelt', (SELECT count(*) FROM g WHERE canonical_id NOT IN (SELECT canonical_id FROM g WHERE is_reuters)),
           (SELECT count(*) FROM n) - (SELECT count(*) FROM g)
    UNION ALL
    SELECT 'duplicates_skipped', 0, count(*) FROM g WHERE canonical_id IN (SELECT canonical_id FROM g WHERE is_reuters)"""))
def src16(t):
    """SRC-16: Reuters rows (by provenance) suppress the same canonical id in GDELT, ACLED between: written and skipped rows by provider."""
    return _combined(t)[1]


_ACLED_ROWS = _ACLED_SQL.format(countries="[" + ", ".join(f"'{c}'" for c in FX.FIXTURE_COUNTRIES) + "]")


@plan("src16_combined_rows", oracle=gdelt_full_sql(f"""
    SELECT 'reuters' AS provider, canonical_id, provider_record_id, event_date, title, event_type, num_articles FROM g WHERE is_reuters
    UNION ALL
    SELECT 'acled', canonical_id, provider_record_id, event_date, title, event_type, num_articles FROM ({_ACLED_ROWS})
    UNION ALL
    SELECT 'gdelt', canonical_id, provider_record_id, event_date, title, event_type, num_articles FROM g
    WHERE canonical_id NOT IN (SELECT canonical_id FROM g WHERE is_reuters)"""))
def src16b(t):
    """SRC-16: the combined rows of the three providers."""
    return _combined(t)[0].select("provider", "canonical_id", "provider_record_id", "event_date", "title", "event_type", "num_articles")


@plan("src17_incremental", oracle="""
    SELECT n.asset_id AS symbol, n.ts AS timestamp, n.close,
           date_diff('day', CAST(h.hw AS DATE), DATE '2002-01-01') + 5 AS window_days
    FROM f_bar n LEFT JOIN (SELECT asset_id, max(ts) AS hw FROM f_bar WHERE ts < TIMESTAMP '2000-01-01' AND asset_id % 10 <> 3 GROUP BY 1) h
      USING (asset_id)
    WHERE h.hw IS NULL OR CAST(n.ts AS DATE) >= CAST(h.hw AS DATE)""")
def src17(t):
    """SRC-17: bars after each asset's stored high-water mark (history before 2000) with the fetch window; a tenth of the assets has no history and gets every bar."""
    stored = t.bar.where((F.col("ts") < F.lit("2000-01-01").cast("timestamp")) & (F.col("asset_id") % 10 != 3)).select(
        F.col("asset_id").alias("symbol"), F.col("ts").alias("timestamp"))
    new = t.bar.select(F.col("asset_id").alias("symbol"), F.col("ts").alias("timestamp"), "close")
    return SE.incremental(stored, new, as_of="2002-01-01 00:00:00")


@plan("snk01_upsert", oracle="""
    SELECT asset_id, ts, first_open AS open, close FROM (
      SELECT asset_id, ts, open AS first_open, close FROM f_bar WHERE ts >= TIMESTAMP '1999-01-01'
      UNION ALL
      SELECT asset_id, ts, open, close FROM f_bar WHERE ts < TIMESTAMP '1999-01-01')""")
def snk01(t):
    """SNK-01: keyed upsert of re-fetched 1999+ bars (new close, first open kept) into the stored bars."""
    old = t.bar.select("asset_id", "ts", "open", "close")
    new = (t.bar.where(F.col("ts") >= F.lit("1999-01-01").cast("timestamp"))
           .select("asset_id", "ts", (F.col("open") * 2).alias("open"), "close"))
    once = sinks.upsert(old, new, ["asset_id", "ts"], keep_first=["open"])
    return sinks.upsert(once, new, ["asset_id", "ts"], keep_first=["open"])   # idempotent re-run


@plan("snk01_upsert_partitions", oracle="""
    SELECT asset_id, ts, open, close, date_trunc('month', ts)::DATE AS month FROM f_bar WHERE ts < TIMESTAMP '1996-01-01'
    UNION ALL
    SELECT asset_id, ts, CASE WHEN ts < TIMESTAMP '1998-06-01' THEN open ELSE open * 2 END, close * 3, date_trunc('month', ts)::DATE
    FROM f_bar WHERE ts >= TIMESTAMP '1996-01-01'""")
def snk01b(t):
    """SNK-01: stored bars (to May 1998) in monthly partitions, then re-fetched ones (from 1996) merged twice into the months they touch; read back."""
    path = _scratch(t, "bars")
    bars = t.bar.select("asset_id", "ts", "open", "close", F.trunc("ts", "month").alias("month"))
    sinks.upsert_partitions(bars.where("ts < timestamp '1998-06-01'"), path, ["asset_id", "ts"], "month", keep_first=["open"])
    again = bars.where("ts >= timestamp '1996-01-01'").withColumn("open", F.col("open") * 2).withColumn("close", F.col("close") * 3)
    for _ in range(2):
        sinks.upsert_partitions(again, path, ["asset_id", "ts"], "month", keep_first=["open"])
    return sinks.read_partitions(t.spark, path, bars.schema, "month")
