"""Landed provider payloads (JSON strings or files) -> rows: news, klines,
OHLCV, quotes, trades, fundamentals, profiles, filings (SRC-07..14).

Every parser is ``from_json`` with an explicit schema plus ``explode`` and
built-in coercions (bad number -> NULL), applied to a DataFrame of payloads,
so it runs batch or streaming, one payload per row, in parallel.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.text import content_hash
from eventlens.sources.events import parse_ts

S, D = T.StringType(), T.DoubleType()


def _arr(fields) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, t) for n, t in fields]))


# ---------------------------------------------------------------------------
# SRC-07 news payloads
# ---------------------------------------------------------------------------

NEWS_SCHEMAS = {
    "newsapi": T.StructType([T.StructField("articles", _arr([
        ("title", S), ("description", S), ("content", S), ("url", S), ("publishedAt", S),
        ("source", T.StructType([T.StructField("name", S)]))]))]),
    "gdelt": T.StructType([T.StructField("articles", _arr([
        ("title", S), ("url", S), ("seendate", S), ("domain", S)]))]),
    "eventregistry": T.StructType([
        T.StructField("articles", T.StructType([
            T.StructField("results", _arr([("title", S), ("body", S), ("content", S), ("url", S),
                                           ("dateTimePub", S), ("dateTime", S), ("source", S)])),
            T.StructField("articles", _arr([("title", S), ("body", S), ("content", S), ("url", S),
                                            ("dateTimePub", S), ("dateTime", S), ("source", S)]))])),
        T.StructField("results", _arr([("title", S), ("body", S), ("content", S), ("url", S),
                                       ("dateTimePub", S), ("dateTime", S), ("source", S)]))]),
    "mediastack": T.StructType([T.StructField("data", _arr([
        ("title", S), ("description", S), ("content", S), ("url", S), ("published_at", S), ("source", S)]))]),
    "rss": T.StructType([T.StructField("feed", T.StructType([T.StructField("title", S)])),
                         T.StructField("entries", _arr([("title", S), ("summary", S), ("link", S),
                                                        ("published", S)]))]),
}


def normalize_news(raw: DataFrame, provider: str, payload: str = "payload",
                   feed_url: str | None = None) -> DataFrame:
    """SRC-07: provider payload -> article rows (whole title and content, source,
    url, published_at, content_hash) with each provider's field paths, empty
    or "[Removed]" titles dropped and the provider's hash recipe."""
    p = F.from_json(F.col(payload), NEWS_SCHEMAS[provider])
    if provider == "newsapi":
        a = raw.select(F.explode(p["articles"]).alias("a")).select("a.*")
        t = F.coalesce(F.col("title"), F.lit(""))
        out = a.where((t != "") & (t != "[Removed]")).select(
            t.alias("title"), F.col("content"),
            F.coalesce(F.col("source.name"), F.lit("NewsAPI")).alias("source"),
            F.coalesce(F.col("url"), F.lit("")).alias("url"), parse_ts(F.col("publishedAt")).alias("published_at"),
            content_hash(t, F.coalesce(F.col("description"), F.lit(""))).alias("content_hash"))
    elif provider == "gdelt":
        a = raw.select(F.explode(p["articles"]).alias("a")).select("a.*")
        t = F.coalesce(F.col("title"), F.lit(""))
        out = a.where(t != "").select(
            t.alias("title"), F.lit(None).cast("string").alias("content"),
            F.coalesce(F.col("domain"), F.lit("GDELT")).alias("source"), F.coalesce(F.col("url"), F.lit("")).alias("url"),
            parse_ts(F.col("seendate")).alias("published_at"),
            content_hash(t, F.coalesce(F.col("url"), F.lit(""))).alias("content_hash"))
    elif provider == "eventregistry":
        rows = F.coalesce(p["articles"]["results"], p["articles"]["articles"], p["results"])
        a = raw.select(F.explode(rows).alias("a")).select("a.*")
        t = F.trim(F.coalesce(F.col("title"), F.lit("")))
        body = F.coalesce(F.col("body"), F.col("content"), F.lit(""))
        url = F.coalesce(F.col("url"), F.lit(""))
        src = F.coalesce(F.get_json_object(F.col("source"), "$.title"), F.when(~F.col("source").startswith("{"),
                                                                                F.col("source")), F.lit("EventRegistry"))
        out = a.where((t != "") & (url != "")).select(
            t.alias("title"), F.when(body != "", body).alias("content"),
            src.alias("source"), url.alias("url"),
            parse_ts(F.coalesce(F.col("dateTimePub"), F.col("dateTime"))).alias("published_at"),
            content_hash(t, F.when(body != "", body).otherwise(url)).alias("content_hash"))
    elif provider == "mediastack":
        a = raw.select(F.explode(p["data"]).alias("a")).select("a.*")
        t = F.trim(F.coalesce(F.col("title"), F.lit("")))
        desc = F.trim(F.coalesce(F.col("description"), F.lit("")))
        url = F.coalesce(F.col("url"), F.lit(""))
        out = a.where((t != "") & (url != "")).select(
            t.alias("title"),
            F.coalesce(F.col("content"), F.when(desc != "", desc)).alias("content"),
            F.coalesce(F.col("source"), F.lit("Mediastack")).alias("source"), url.alias("url"),
            parse_ts(F.col("published_at")).alias("published_at"),
            content_hash(t, F.when(desc != "", desc).otherwise(url)).alias("content_hash"))
    elif provider == "rss":
        a = raw.select(p["feed"]["title"].alias("_ft"), F.explode(p["entries"]).alias("a")).select("_ft", "a.*")
        t = F.coalesce(F.col("title"), F.lit(""))
        summ = F.coalesce(F.col("summary"), F.lit(""))
        src = F.coalesce(F.col("_ft"), F.lit(feed_url or ""))
        out = a.where(t != "").select(
            t.alias("title"), F.when(summ != "", summ).alias("content"),
            src.alias("source"), F.coalesce(F.col("link"), F.lit("")).alias("url"),
            parse_ts(F.col("published")).alias("published_at"), content_hash(t, summ).alias("content_hash"))
    else:
        raise ValueError(provider)
    return out


# ---------------------------------------------------------------------------
# SRC-08 klines
# ---------------------------------------------------------------------------

KLINE_COLUMNS = ["open_time", "open", "high", "low", "close", "volume", "close_time", "base_asset_volume",
                 "num_trades", "taker_buy_volume", "taker_buy_base_asset_volume", "ignore"]


def read_klines(spark: SparkSession, paths, symbol_from_path: bool = True) -> DataFrame:
    """SRC-08: headerless 12-column kline CSV files (monthly and daily),
    numbers coerced (bad -> NULL), rows without OHLC dropped, one row per
    (symbol, open_time) keeping the last file's row: monthly files come before
    daily ones, then by name. The symbol is the file name prefix before the
    first '-'. Keep-last is a max_by aggregate."""
    raw = spark.read.option("header", False).schema(
        T.StructType([T.StructField(c, S) for c in KLINE_COLUMNS])).csv(paths)
    f = F.input_file_name()
    # symbol from a ``symbol=XXX`` folder, else from the file name prefix ("BTCUSDT-1h-2024-01.csv")
    part = F.regexp_extract(f, r"symbol=([^/]+)/", 1)
    sym = (F.when(part != "", part).otherwise(F.regexp_extract(f, r"([^/]+?)-[^/]*$", 1))
           if symbol_from_path else F.lit(None).cast("string"))
    df = raw.select(sym.alias("symbol"), f.alias("_file"),
                    *[F.col(c).try_cast("double").alias(c) for c in KLINE_COLUMNS])
    df = df.dropna(subset=["open_time", "open", "high", "low", "close"])
    cols = [c for c in df.columns if c not in ("symbol", "open_time", "_file")]
    return (df.groupBy("symbol", "open_time")
            .agg(F.max_by(F.struct(*cols), F.struct(F.col("_file").contains("/daily/"), F.col("_file"))).alias("_r"))
            .select("symbol", F.col("open_time").cast("long").alias("open_time"), "_r.*"))


# ---------------------------------------------------------------------------
# SRC-09 OHLCV payloads
# ---------------------------------------------------------------------------

def _epoch_ms(c) -> Column:
    return F.timestamp_millis(F.col(c).try_cast("double").cast("long"))


def normalize_ohlcv(raw: DataFrame, provider: str, payload: str = "payload", key: str = "ticker",
                    limit: int | None = None) -> DataFrame:
    """SRC-09: OHLCV payloads of binance (row arrays, ms), polygon (results,
    ms), twelvedata (values, datetime text), alphavantage (map date ->
    values), fcs (response.{symbol} rows, s), eodhd (rows with date; rows
    without a close dropped) -> (key, ts, open, high, low, close, volume),
    newest first (``rank``), at most ``limit`` per key."""
    num = lambda c: F.col(c).try_cast("double")
    if provider == "binance":
        p = F.from_json(F.col(payload), T.ArrayType(T.ArrayType(S)))
        x = raw.select(key, F.explode(p).alias("r"))
        out = x.select(key, F.timestamp_millis(F.col("r")[0].try_cast("double").cast("long")).alias("ts"),
                       *[F.col("r")[i].try_cast("double").alias(n) for i, n in
                         enumerate(["open", "high", "low", "close", "volume"], start=1)])
    elif provider == "polygon":
        p = F.from_json(F.col(payload), T.StructType([T.StructField("results", _arr(
            [("t", S), ("o", S), ("h", S), ("l", S), ("c", S), ("v", S)]))]))
        x = raw.select(key, F.explode(p["results"]).alias("r")).select(key, "r.*")
        out = x.select(key, _epoch_ms("t").alias("ts"), num("o").alias("open"), num("h").alias("high"),
                       num("l").alias("low"), num("c").alias("close"), num("v").alias("volume"))
    elif provider == "twelvedata":
        p = F.from_json(F.col(payload), T.StructType([T.StructField("values", _arr(
            [("datetime", S), ("open", S), ("high", S), ("low", S), ("close", S), ("volume", S)]))]))
        x = raw.select(key, F.explode(p["values"]).alias("r")).select(key, "r.*")
        ts = F.coalesce(F.try_to_timestamp(F.col("datetime"), F.lit("yyyy-MM-dd HH:mm:ss")),
                        F.try_to_timestamp(F.col("datetime"), F.lit("yyyy-MM-dd")))
        out = x.select(key, ts.alias("ts"), *[num(c).alias(c) for c in ["open", "high", "low", "close", "volume"]])
    elif provider == "alphavantage":
        p = F.from_json(F.col(payload), T.StructType([T.StructField(
            "Time Series (Daily)", T.MapType(S, T.MapType(S, S)))]))
        x = raw.select(key, F.explode(p["Time Series (Daily)"]).alias("d", "v"))
        g = lambda k: F.col("v")[k].try_cast("double")
        out = x.select(key, F.try_to_timestamp(F.col("d"), F.lit("yyyy-MM-dd")).alias("ts"),
                       g("1. open").alias("open"), g("2. high").alias("high"), g("3. low").alias("low"),
                       g("4. close").alias("close"), g("5. volume").alias("volume"))
    elif provider == "fcs":
        p = F.from_json(F.col(payload), T.StructType([T.StructField("status", T.BooleanType()),
                                                      T.StructField("response", T.MapType(S, _arr(
                                                          [("t", S), ("o", S), ("h", S), ("l", S), ("c", S),
                                                           ("v", S)])))]))
        x = (raw.select(key, p.alias("p")).where(F.col("p.status"))
             .select(key, F.explode(F.col("p.response")[F.col(key)]).alias("r")).select(key, "r.*"))
        out = x.where(F.col("t").isNotNull() & (F.col("t") != "")).select(
            key, F.timestamp_seconds(F.col("t").try_cast("long")).alias("ts"), num("o").alias("open"),
            num("h").alias("high"), num("l").alias("low"), num("c").alias("close"), num("v").alias("volume"))
    elif provider == "eodhd":
        p = F.from_json(F.col(payload), _arr([("date", S), ("open", S), ("high", S), ("low", S), ("close", S),
                                               ("volume", S)]))
        x = raw.select(key, F.explode(p).alias("r")).select(key, "r.*")
        ok = F.col("date").isNotNull() & (F.col("date") != "") & (F.coalesce(num("close"), F.lit(0.0)) != 0)
        out = x.where(ok).select(key, F.try_to_timestamp(F.col("date"), F.lit("yyyy-MM-dd")).alias("ts"),
                                 *[num(c).alias(c) for c in ["open", "high", "low", "close", "volume"]])
    else:
        raise ValueError(provider)
    w = Window.partitionBy(key).orderBy(F.col("ts").desc())
    out = out.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= limit) if limit else out


# ---------------------------------------------------------------------------
# SRC-10 quotes, SRC-11 trades, SRC-12 fundamentals
# ---------------------------------------------------------------------------

def normalize_quote(raw: DataFrame, provider: str, payload: str = "payload", key: str = "ticker") -> DataFrame:
    """SRC-10: quote payloads -> (key, price, change, as_of, source).
    polygon {results:[{p|c, t}]}, finnhub {c, d, t}, twelvedata {price|close,
    change}, binance {lastPrice, priceChangePercent}, fcs {response:[{c, ch}]},
    alphavantage {"Global Quote": {"05. price", "09. change"}}, eodhd {close,
    change}. Prices <= 0 or missing are rejected."""
    get = lambda path: F.get_json_object(F.col(payload), path).try_cast("double")
    paths = {
        "polygon": (F.coalesce(get("$.results[0].p"), get("$.results[0].c")), F.lit(0.0),
                    F.timestamp_millis(get("$.results[0].t").cast("long"))),
        "finnhub": (get("$.c"), F.coalesce(get("$.d"), F.lit(0.0)), F.timestamp_seconds(get("$.t").cast("long"))),
        "twelvedata": (F.coalesce(get("$.price"), get("$.close")), F.coalesce(get("$.change"), F.lit(0.0)),
                       F.lit(None).cast("timestamp")),
        "binance": (get("$.lastPrice"), F.coalesce(get("$.priceChangePercent"), F.lit(0.0)),
                    F.lit(None).cast("timestamp")),
        "fcs": (get("$.response[0].c"), F.coalesce(get("$.response[0].ch"), F.lit(0.0)), F.lit(None).cast("timestamp")),
        "alphavantage": (get("$['Global Quote']['05. price']"),
                         F.coalesce(get("$['Global Quote']['09. change']"), F.lit(0.0)),
                         F.lit(None).cast("timestamp")),
        "eodhd": (get("$.close"), F.coalesce(get("$.change"), F.lit(0.0)), F.lit(None).cast("timestamp")),
    }
    price, change, ts = paths[provider]
    out = raw.select(key, price.alias("price"), change.alias("change"), ts.alias("as_of"),
                     F.lit(provider).alias("source"))
    return out.where(F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") > 0))


def parse_trades(raw: DataFrame, provider: str, payload: str = "payload") -> DataFrame:
    """SRC-11: trade messages -> (ticker upper-cased, price, ts): polygon list
    or object of {ev:'T', sym, p, t}, finnhub {type:'trade', data:[{s, p, t}]};
    rows without ticker or price dropped; epoch units detected."""
    from eventlens.operators.serving import epoch_to_ts
    if provider == "polygon":
        msg = T.StructType([T.StructField("ev", S), T.StructField("sym", S), T.StructField("p", D),
                            T.StructField("t", S)])
        arr = F.when(F.trim(F.col(payload)).startswith("["), F.from_json(F.col(payload), T.ArrayType(msg))) \
            .otherwise(F.array(F.from_json(F.col(payload), msg)))
        x = raw.select(F.explode(arr).alias("m")).select("m.*").where(F.col("ev") == "T")
        return (x.select(F.upper(F.coalesce("sym", F.lit(""))).alias("ticker"), F.col("p").alias("price"),
                         epoch_to_ts(F.col("t")).alias("ts"))
                .where((F.col("ticker") != "") & F.col("price").isNotNull()))
    if provider == "finnhub":
        sch = T.StructType([T.StructField("type", S), T.StructField("data", _arr([("s", S), ("p", D), ("t", S)]))])
        p = F.from_json(F.col(payload), sch)
        x = raw.select(p.alias("m")).where(F.col("m.type") == "trade").select(F.explode("m.data").alias("r"))
        return (x.select(F.upper(F.coalesce("r.s", F.lit(""))).alias("ticker"), F.col("r.p").alias("price"),
                         epoch_to_ts(F.col("r.t")).alias("ts"))
                .where((F.col("ticker") != "") & F.col("price").isNotNull()))
    raise ValueError(provider)


#: Where each provider's fundamentals payload holds a figure.
FUNDAMENTAL_PATHS = {
    "polygon": {"market_cap": "$.results.market_cap", "pe_ratio": "$.results.pe_ratio", "eps": "$.results.eps",
                "dividend_yield": "$.results.dividend_yield", "week_52_high": "$.results.week_52_high",
                "week_52_low": "$.results.week_52_low"},
    "finnhub": {"market_cap": "$.metric.marketCapitalization", "pe_ratio": "$.metric.peTTM", "eps": "$.metric.epsTTM",
                "dividend_yield": "$.metric.dividendYieldIndicatedAnnual", "week_52_high": "$.metric.52WeekHigh",
                "week_52_low": "$.metric.52WeekLow"},
}


def normalize_fundamentals(raw: DataFrame, provider: str = "polygon", payload: str = "payload", key: str = "ticker") -> DataFrame:
    """SRC-12: fundamentals payload (polygon ``results``, finnhub ``metric``)
    -> market cap, P/E, EPS, dividend yield, 52-week high/low (bad -> NULL). A
    finnhub payload without metrics gives no row."""
    rows = raw
    if provider == "finnhub":
        metric = F.get_json_object(F.col(payload), "$.metric")
        rows = raw.where(metric.isNotNull() & (metric != "{}"))
    return rows.select(key, *[F.get_json_object(F.col(payload), path).try_cast("double").alias(name)
                              for name, path in FUNDAMENTAL_PATHS[provider].items()])


# ---------------------------------------------------------------------------
# SRC-13 profiles, SRC-14 filings
# ---------------------------------------------------------------------------

PROFILE_SCHEMA = T.StructType([T.StructField("results", T.StructType([T.StructField("bindings", _arr([
    ("ticker", T.StructType([T.StructField("value", S)])), ("companyLabel", T.StructType([T.StructField("value", S)])),
    ("industryLabel", T.StructType([T.StructField("value", S)])),
    ("countryLabel", T.StructType([T.StructField("value", S)]))]))]))])


def normalize_profiles(raw: DataFrame, payload: str = "payload") -> DataFrame:
    """SRC-13: knowledge-base bindings -> (ticker upper, company, industry, country)."""
    b = raw.select(F.explode(F.from_json(F.col(payload), PROFILE_SCHEMA)["results"]["bindings"]).alias("b"))
    return b.select(F.upper(F.coalesce(F.col("b.ticker.value"), F.lit(""))).alias("ticker"),
                    F.col("b.companyLabel.value").alias("company"), F.col("b.industryLabel.value").alias("industry"),
                    F.col("b.countryLabel.value").alias("country"))


FILING_SCHEMA = T.StructType([T.StructField("filings", T.StructType([T.StructField("recent", T.StructType([
    T.StructField("form", T.ArrayType(S)), T.StructField("accessionNumber", T.ArrayType(S)),
    T.StructField("primaryDocument", T.ArrayType(S)), T.StructField("filingDate", T.ArrayType(S))]))]))])


def latest_filing(raw: DataFrame, forms=("10-K", "20-F"), payload: str = "payload", cik: str = "cik") -> DataFrame:
    """SRC-14: first (newest) 10-K / 20-F with accession and document from the
    parallel arrays -> (cik, url, filing_date)."""
    r = F.from_json(F.col(payload), FILING_SCHEMA)["filings"]["recent"]
    z = F.arrays_zip(r["form"].alias("form"), r["accessionNumber"].alias("acc"),
                     r["primaryDocument"].alias("doc"), r["filingDate"].alias("date"))
    ok = F.filter(z, lambda e: e["form"].isin(list(forms)) & (F.coalesce(e["acc"], F.lit("")) != "")
                  & (F.coalesce(e["doc"], F.lit("")) != ""))
    first = F.element_at(ok, 1)
    cik_int = F.col(cik).cast("long").cast("string")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik_int, F.lit("/"),
                   F.regexp_replace(first["acc"], "-", ""), F.lit("/"), first["doc"])
    return raw.select(cik, F.when(first.isNotNull(), url).alias("url"),
                      F.to_date(F.try_to_timestamp(first["date"], F.lit("yyyy-MM-dd"))).alias("filing_date"))
