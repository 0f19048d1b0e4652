"""Domain tables derived from the TPC-H-like test tables.

Each property is a lazy DataFrame over the given parquet folder, so its size
grows with the inputs. The rules are the ones written in FIXTURES.md; the
DuckDB side of the oracle re-derives the same tables in SQL
(``eventlens.plans.oracle_fixtures``).
"""
from __future__ import annotations

import functools
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.session import deal_count

# Large tables whose test files hold a single row group (one split), with the
# columns that deal their rows over the task slots before the per-row work.
SPREAD_TABLES = {"documents": ["doc_id"], "pages": ["page_id"], "lineitem": ["l_orderkey", "l_linenumber"],
                 "events": ["event_id"], "orders": ["o_orderkey"]}

# Fixed values chosen for the fixtures (not from the reference).
FIXTURE_COUNTRIES = [c for c, _, _ in L.COUNTRY_COORDS[:12]]
EVENT_TYPE_FROM_KIND = {"error": "conflict", "purchase": "sanction", "click": "trade_policy",
                        "view": "economic_data", "signup": "election"}
SEGMENT_TO_TYPE = {"MACHINERY": "conflict", "HOUSEHOLD": "sanction",
                   "AUTOMOBILE": "trade_policy", "BUILDING": "economic_data",
                   "FURNITURE": "election"}
STATUS_TO_DIRECTION = {"F": "up", "O": "down", "P": "neutral"}
PRIORITY_TO_HORIZON = {"1-URGENT": "1h", "2-HIGH": "6h", "3-MEDIUM": "24h",
                       "4-NOT SPECIFIED": "7d", "5-LOW": "30d"}
ARTICLE_SOURCES = ["Reuters", "AP News", "Al Jazeera", "GDELT"]
# Event descriptions reuse the two article phrases of their type (index of the first).
TYPE_PHRASE_BASE = {"conflict": 0, "sanction": 2, "trade_policy": 4, "economic_data": 6,
                    "energy_disruption": 8, "election": 10, "regulation": 12}
REVIEW_ACTIONS = ["edit", "approve", "reject"]
QUOTE_PROVIDERS = ["binance", "fcs", "twelvedata", "polygon", "eodhd", "alphavantage", "finnhub"]
# Sixteen article phrases: 7 event types x 2, one sports item, one with no keyword.
ARTICLE_PHRASES = [
    "Missile attack near Ukraine border, military escalation",
    "Russia invasion and war offensive continues",
    "China sanction and embargo on chip exports",
    "US blacklist adds restricted entity in Iran",
    "US tariff and export control on semiconductor market",
    "India import ban and trade restriction hits stock",
    "Inflation and GDP data: UK interest rate cut",
    "Japan jobs report and unemployment beat forecast",
    "OPEC pipeline outage hits oil supply in Saudi Arabia",
    "Refinery explosion disrupts gas supply in Germany",
    "India election vote and ballot polls",
    "France presidential race tightens in polls",
    "Antitrust regulation approved in Germany",
    "Regulatory compliance policy change for banks in Taiwan",
    "Football championship and celebrity movie box office",
    "Quarterly gardening club newsletter",
]


# Context sentence put in front of every article body: it carries relevance
# terms of all four groups but no event-type keyword, so the invented prose
# can pass the relevance gate while the title alone decides the event type.
ARTICLE_CONTEXT = ("Geopolitical risk lifts treasury yield and crude shipping route costs; "
                   "stocks and currency volatility rise.")


# Later reports on the same story (article updates) of half the documents, and
# what a quarter of them add to the body.
UPDATE_ID = 1_000_000_000
UPDATE_BODY = " A nationwide emergency: record default."


def elem(values: list, idx: Column) -> Column:
    """values[idx] as a column expression (0-based)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def ts_plus_seconds(ts: Column, secs: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + secs.cast("long") * F.lit(1_000_000))


class Tables:
    """Lazy domain tables for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str, stream: bool = False) -> DataFrame:
        """A base table; ``stream=True`` reads the same file as a streaming
        source (one file per trigger), for the Structured Streaming operators."""
        path = os.path.join(self.sf_dir, f"{name}.parquet")
        if stream:
            table = self.spark.read.parquet(path)
            df = self.spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
            if all(f.endswith(f"/{name}.parquet") for f in table.inputFiles()):
                df = df.option("pathGlobFilter", f"{name}.parquet").parquet(self.sf_dir)
            else:  # a folder of part files
                df = df.parquet(path)
        else:
            df = self.spark.read.parquet(path)
            parts = self._deal_count(name) if name in SPREAD_TABLES else None
            if parts is not None:
                df = df.repartition(parts, *SPREAD_TABLES[name])
        # Source timestamps carry no zone; the session runs in UTC.
        for f in df.schema.fields:
            if f.dataType.typeName() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    @functools.cache
    def _deal_count(self, name: str) -> int | None:
        return deal_count(self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet")))

    @functools.cache
    def row_count(self, name: str) -> int:
        """Rows of a base table, from its files' footers."""
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet")).count()

    # -- scalars (small parameter reads, not data rows) ----------------------
    @functools.cached_property
    def n_suppliers(self) -> int:
        return self.raw("supplier").count()

    @functools.cached_property
    def n_events(self) -> int:
        return self.raw("events").count()

    # -- market --------------------------------------------------------------
    @functools.cached_property
    def asset(self) -> DataFrame:
        s, n, r = self.raw("supplier"), self.raw("nation"), self.raw("region")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .join(r, F.col("n_regionkey") == r.r_regionkey)
                .select(F.col("s_suppkey").alias("asset_id"),
                        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"),
                        F.col("s_name").alias("name"),
                        elem(L.ASSET_TYPES, F.col("s_suppkey") % 6).alias("asset_type"),
                        F.col("r_name").alias("sector"),
                        F.col("n_name").alias("country")))

    @functools.cached_property
    def bar(self) -> DataFrame:
        """Daily bars per supplier-asset from line items."""
        li = self.raw("lineitem")
        p = F.col("l_extendedprice") / F.col("l_quantity")
        order_key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice",
                             "l_quantity")
        return (li.groupBy(F.col("l_suppkey").alias("asset_id"),
                           F.to_date("l_shipdate").alias("day"))
                .agg(F.min_by(p, order_key).alias("open"), F.max(p).alias("high"),
                     F.min(p).alias("low"), F.max_by(p, order_key).alias("close"),
                     F.sum("l_quantity").alias("volume"))
                .select("asset_id", F.col("day").cast("timestamp").alias("ts"),
                        "open", "high", "low", "close", "volume"))

    @functools.cached_property
    def quote(self) -> DataFrame:
        """Provider quotes per asset: the latest bar close scaled by provider,
        missing (NULL) or zero for some (asset, provider) pairs."""
        last = self.bar.groupBy("asset_id").agg(F.max_by("close", "ts").alias("_c"), F.max("ts").alias("as_of"))
        prov = F.array(*[F.lit(p) for p in QUOTE_PROVIDERS])
        x = last.select("asset_id", "_c", "as_of", F.posexplode(prov).alias("i", "provider"))
        k = (F.col("asset_id") + F.col("i")) % 4
        price = (F.when(k == 0, F.lit(None).cast("double")).when(k == 1, F.lit(0.0))
                 .otherwise(F.col("_c") * (1 + F.col("i") / 100.0)))
        return x.select("asset_id", "provider", price.alias("price"),
                        ((F.col("i") - 3) / 10.0).alias("change"), "as_of")

    @functools.cached_property
    def last_good(self) -> DataFrame:
        """Last-good snapshot per asset: the first bar of the series."""
        return (self.bar.groupBy("asset_id")
                .agg(F.min_by("close", "ts").alias("price"), F.min("ts").alias("as_of"))
                .select("asset_id", "price", F.lit(0.0).alias("change"), "as_of"))

    @functools.cached_property
    def trade(self) -> DataFrame:
        return self.trade_from(self.raw("events"))

    def trade_stream(self) -> DataFrame:
        return self.trade_from(self.raw("events", stream=True))

    @staticmethod
    def trade_from(ev: DataFrame) -> DataFrame:
        return ev.select(F.concat(F.lit("U"), (F.col("user_id") % 20).cast("string")).alias("ticker"),
                         F.col("value").alias("price"), F.col("ts"), F.col("event_id").alias("seq"))

    @functools.cached_property
    def kline(self) -> DataFrame:
        ev = self.raw("events")
        o = F.struct("ts", "event_id")
        return (ev.groupBy(F.concat(F.lit("K"), (F.col("user_id") % 5).cast("string")).alias("symbol"),
                           F.date_trunc("hour", "ts").alias("open_time"))
                .agg(F.min_by("value", o).alias("open"), F.max("value").alias("high"),
                     F.min("value").alias("low"), F.max_by("value", o).alias("close"),
                     F.sum("value").alias("volume"), F.count("*").alias("num_trades"),
                     F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))
                           .otherwise(F.lit(0.0))).alias("taker_buy_volume")))

    @functools.cached_property
    def provider_log(self) -> DataFrame:
        return self.provider_log_from(self.raw("events"))

    @staticmethod
    def provider_log_from(ev: DataFrame) -> DataFrame:
        return ev.select(F.col("event_id").alias("request_id"),
                         F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("provider"),
                         (F.col("event_type") != "error").alias("success"),
                         (F.col("event_type") == "signup").alias("skipped"),
                         (F.col("value") * 5).alias("latency_ms"),
                         F.lit(1.0).alias("weight"), F.col("ts"))

    # -- events --------------------------------------------------------------
    @functools.cached_property
    def event(self) -> DataFrame:
        return self.event_from(self.raw("events"))

    def event_stream(self) -> DataFrame:
        return self.event_from(self.raw("events", stream=True))

    def event_from(self, ev: DataFrame) -> DataFrame:
        eid = F.col("event_id")
        k = F.get_json_object("props", "$.k").cast("int")
        tod = F.unix_micros("ts") % F.lit(86_400_000_000)
        published = F.timestamp_micros(
            F.unix_micros(F.lit("1998-01-01 00:00:00").cast("timestamp"))
            + (eid % 700) * F.lit(86_400_000_000) + tod)
        etype = lookup(EVENT_TYPE_FROM_KIND, F.col("event_type"))
        return ev.select(
            eid.alias("event_id"),
            F.concat(etype, F.lit(" "), (eid % 50).cast("string")).alias("title"),
            F.element_at(F.array(*[F.lit(x) for x in ARTICLE_PHRASES]),
                         (lookup(TYPE_PHRASE_BASE, etype) + eid % 2 + 1).cast("int")).alias("description"),
            etype.alias("event_type"),
            F.when(eid % 23 == 0, F.lit(None).cast("string"))
             .otherwise(elem(FIXTURE_COUNTRIES, F.col("user_id") % 12)).alias("country"),
            F.lit(None).cast("string").alias("region"),
            F.when(eid % 19 == 0, F.lit(None).cast("int"))
             .otherwise((eid % 5 + 1).cast("int")).alias("severity"),
            F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"),
            elem(L.EVENT_STATUSES, eid % 4).alias("status"),
            ((eid % 101) / 100.0).alias("confidence_score"),
            published.alias("published_at"),
            ts_plus_seconds(published, eid % 600).alias("created_at"),
            ((F.col("value") - 245) / 50).alias("sentiment"),
            ((k - 50) / 5).alias("goldstein"),
            (k % 12 + 1).alias("num_articles"),
            F.col("user_id"))

    @functools.cached_property
    def impact(self) -> DataFrame:
        ev = self.event
        eid = F.col("event_id")
        j = F.col("j")
        return (ev.select("event_id", "created_at",
                          F.explode(F.sequence(F.lit(0), (eid % 3).cast("int"))).alias("j"))
                .select("event_id",
                        ((eid * 7 + j * 13) % F.lit(self.n_suppliers)).alias("asset_id"),
                        elem(L.IMPACT_DIRECTIONS, (eid + j) % 3).alias("impact_direction"),
                        (((eid * 11 + j * 5) % 100) / 100.0).alias("impact_strength"),
                        F.when(eid % 17 == 0, F.lit(None).cast("double"))
                         .otherwise(((eid * 3 + j * 7) % 100) / 100.0).alias("confidence_score"),
                        ts_plus_seconds(F.col("created_at"), j * 60).alias("created_at")))

    @functools.cached_property
    def tag(self) -> DataFrame:
        eid = F.col("event_id")
        return (self.raw("events").select(
            "event_id", F.explode(F.sequence(F.lit(0), (eid % 4).cast("int"))).alias("j"))
            .select("event_id", F.concat(F.lit("topic"),
                                         ((eid + F.col("j") * 3) % 20).cast("string")).alias("tag")))

    @functools.cached_property
    def review_action(self) -> DataFrame:
        ev = self.raw("events")
        return ev.select(F.col("event_id").alias("action_id"), "event_id",
                         elem(REVIEW_ACTIONS, F.col("event_id") % 3).alias("action"),
                         F.col("user_id").alias("reviewer_id"), F.col("ts").alias("created_at"))

    # -- articles ------------------------------------------------------------
    @functools.cached_property
    def article(self) -> DataFrame:
        return self.article_from(self.raw("documents"))

    def article_stream(self) -> DataFrame:
        return self.article_from(self.raw("documents", stream=True))

    def article_from(self, d: DataFrame) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_name")
        did = F.col("doc_id")
        d = d.withColumn("_sk", did % F.lit(self.n_suppliers))
        pub = ts_plus_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"), did * 420)
        return (d.join(s, d._sk == s.s_suppkey, "left")
                .select(did.alias("article_id"),
                        F.concat(elem(ARTICLE_PHRASES, did % 16), F.lit(" "), F.col("s_name")).alias("title"),
                        F.concat(F.lit(ARTICLE_CONTEXT + "\n"), F.col("text")).alias("content"),
                        F.when(did % 5 == 4, F.col("source"))
                         .otherwise(elem(ARTICLE_SOURCES, did % 5)).alias("source"),
                        F.concat(F.lit("https://news.example.com/a/"), did.cast("string")).alias("url"),
                        F.when(did % 29 == 0, F.lit(None).cast("timestamp")).otherwise(pub).alias("published_at"),
                        ts_plus_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp"), did).alias("created_at"),
                        F.col("lang").alias("lang"),
                        F.when(did % 3 == 0, F.lit(None).cast("timestamp"))
                         .otherwise(ts_plus_seconds(F.lit("2024-02-01 00:00:00").cast("timestamp"),
                                                    did + did % 120)).alias("nlp_processed_at")))

    @functools.cached_property
    def article_update(self) -> DataFrame:
        """A second report on the story of every document with doc_id % 4 in (1, 2):
        same title and day, a minute later, from another source; one in 40 has no url."""
        did = F.col("article_id")
        return (self.article.where((did % 4).isin(1, 2)).select(
            (did + UPDATE_ID).alias("article_id"), "title",
            F.when(did % 8 == 1, F.concat("content", F.lit(UPDATE_BODY))).otherwise(F.col("content")).alias("content"),
            F.when(did % 4 == 1, "Reuters").otherwise("a blog").alias("source"),
            F.when(did % 40 == 21, "").otherwise(F.concat("url", F.lit("/update"))).alias("url"),
            ts_plus_seconds(F.col("published_at"), F.lit(60)).alias("published_at"),
            ts_plus_seconds(F.col("created_at"), F.lit(86400)).alias("created_at"), "lang",
            F.lit(None).cast("timestamp").alias("nlp_processed_at")))

    @functools.cached_property
    def wire(self) -> DataFrame:
        """Articles and their updates."""
        return self.article.unionByName(self.article_update)

    @functools.cached_property
    def kg_edge_stale(self) -> DataFrame:
        """The graph with edges to assets that are listed no more."""
        s = self.raw("supplier").where(F.col("s_suppkey") % 50 == 7).select(F.col("s_suppkey").cast("string").alias("k"))
        return self.kg_edge.unionByName(s.select(
            F.concat(F.lit("ASSET:S"), "k").alias("source_key"), F.concat(F.lit("ASSET:OLD"), "k").alias("target_key"),
            F.lit("SUPPLIES_TO").alias("relationship"), F.lit(0.4).alias("strength")))

    @functools.cached_property
    def event_article(self) -> DataFrame:
        return self.raw("documents").select(
            (F.col("doc_id") % F.lit(self.n_events)).alias("event_id"),
            F.col("doc_id").alias("article_id"))

    @functools.cached_property
    def filing(self) -> DataFrame:
        """Filing documents: each page's HTML plus a sentence naming a customer
        and a supplier (supplier names from the table), owned by asset
        ``page_id % S``."""
        p = self.raw("pages")
        s = self.raw("supplier").select("s_suppkey", "s_name")
        S = F.lit(self.n_suppliers)
        c = s.select(F.col("s_suppkey").alias("_c"), F.col("s_name").alias("_cn"))
        u = s.select(F.col("s_suppkey").alias("_u"), F.col("s_name").alias("_un"))
        return (p.join(c, (p.page_id * 7) % S == c._c).join(u, (p.page_id * 3 + 1) % S == u._u)
                .select("page_id",
                        F.concat(F.lit("S"), (F.col("page_id") % S).cast("string")).alias("source_ticker"),
                        F.col("html"),
                        F.concat(F.lit(" our major customer "), F.lower("_cn"), F.lit(" and supplier "),
                                 F.lower("_un"), F.lit(" ")).alias("tail")))

    @functools.cached_property
    def profile(self) -> DataFrame:
        """Company profiles (ticker, company, industry, country) per supplier."""
        s, n = self.raw("supplier"), self.raw("nation")
        k = F.col("s_suppkey")
        return (s.join(n, s.s_nationkey == n.n_nationkey)
                .select(F.concat(F.lit("S"), k.cast("string")).alias("ticker"), F.col("s_name").alias("company"),
                        F.when(k % 5 == 0, F.lit(None).cast("string"))
                         .otherwise(F.concat(F.lit("Industry "), (k % 4).cast("string"))).alias("industry"),
                        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("n_name")).alias("country")))

    # -- knowledge graph -----------------------------------------------------
    @functools.cached_property
    def kg_edge(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        S = F.lit(self.n_suppliers)
        i = F.col("s_suppkey")
        n = self.raw("nation")
        sup = s.select(i.alias("src"), ((i * 3 + 1) % S).alias("dst"),
                       F.lit("SUPPLIES_TO").alias("relationship"),
                       (F.lit(0.3) + (i % 7) / 10.0).alias("strength"))
        comp = s.select(i.alias("src"), ((i + 5) % S).alias("dst"),
                        F.lit("COMPETES_WITH").alias("relationship"),
                        F.when(i % 4 == 0, F.lit(0.0)).otherwise(F.lit(0.6)).alias("strength"))
        asset_edges = sup.unionByName(comp).select(
            F.concat(F.lit("ASSET:S"), F.col("src").cast("string")).alias("source_key"),
            F.concat(F.lit("ASSET:S"), F.col("dst").cast("string")).alias("target_key"),
            "relationship", "strength")
        sn = s.join(n, s.s_nationkey == n.n_nationkey)
        part_of = (sn.join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                   .select(F.concat(F.lit("ASSET:S"), i.cast("string")).alias("source_key"),
                           F.array(F.concat(F.lit("SECTOR:"), F.col("r_name")),
                                   F.concat(F.lit("COUNTRY:"), F.col("n_name"))).alias("t"))
                   .select("source_key", F.explode("t").alias("target_key"),
                           F.lit("PART_OF").alias("relationship"), F.lit(0.9).alias("strength")))
        return asset_edges.unionByName(part_of)

    # -- predictions ---------------------------------------------------------
    @functools.cached_property
    def prediction(self) -> DataFrame:
        o = self.raw("orders")
        ok, ck = F.col("o_orderkey"), F.col("o_custkey")
        horizon = lookup(PRIORITY_TO_HORIZON, F.col("o_orderpriority"))
        outcome = elem(["correct", "partial", "wrong", "pending"], ok % 4)
        secs = lookup({k: v for k, v in L.HORIZON_SECONDS.items()}, horizon)
        return o.select(
            ok.alias("prediction_id"),
            ck.alias("user_id"),
            (ok % F.lit(self.n_events)).alias("event_id"),
            (ck % F.lit(self.n_suppliers)).alias("asset_id"),
            lookup(STATUS_TO_DIRECTION, F.col("o_orderstatus")).alias("predicted_direction"),
            ((ok % 31 - 15) / 4.0).alias("predicted_change_pct"),
            horizon.alias("prediction_horizon"),
            ((ok % 97) / 100.0).alias("confidence_score"),
            F.concat(F.lit("m"), (ck % 3).cast("string")).alias("model_version"),
            F.col("o_orderdate").alias("predicted_at"),
            ts_plus_seconds(F.col("o_orderdate"), secs).alias("resolve_at"),
            F.when(outcome == "pending", F.lit(None).cast("double"))
             .otherwise((ck % 41 - 20) / 4.0).alias("actual_change_pct"),
            outcome.alias("outcome"))

    # -- users, alerts, boards -----------------------------------------------
    @functools.cached_property
    def alert(self) -> DataFrame:
        c = self.raw("customer")
        ck = F.col("c_custkey")
        asset = F.when(ck % 3 == 0, F.lit(None).cast("long")).otherwise(ck % F.lit(self.n_suppliers))
        etype = F.when(ck % 5 == 0, F.lit(None).cast("string")).otherwise(
            lookup(SEGMENT_TO_TYPE, F.col("c_mktsegment")))
        return (c.select(ck.alias("alert_id"), ck.alias("user_id"), asset.alias("asset_id"),
                         etype.alias("event_type"),
                         F.when(ck % 4 == 0, F.lit(None).cast("double"))
                          .otherwise((ck % 10) / 10.0).alias("threshold"),
                         (ck % 6 != 0).alias("is_active"),
                         F.timestamp_seconds(F.lit(1700000000) + ck * 60).alias("created_at"))
                .where(F.col("asset_id").isNotNull() | F.col("event_type").isNotNull()))

    @functools.cached_property
    def user(self) -> DataFrame:
        c = self.raw("customer")
        ck = F.col("c_custkey")
        return c.select(ck.alias("user_id"), F.col("c_name").alias("name"),
                        F.when(ck % 7 == 0, F.lit(False)).alias("email_pref"),
                        F.when(ck % 2 == 0, F.lit(True)).alias("push_pref"))

    @functools.cached_property
    def board(self) -> DataFrame:
        c = self.raw("customer")
        ck = F.col("c_custkey")
        return c.select(ck.alias("board_id"), ck.alias("owner_id"),
                        F.concat(F.lit("board "), ck.cast("string")).alias("name"),
                        (ck % 2 == 0).alias("is_public"),
                        F.timestamp_seconds(F.lit(1700000000) + ck).alias("created_at"))

    @functools.cached_property
    def pin(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_orderkey").alias("pin_id"), F.col("o_custkey").alias("board_id"),
                        (F.col("o_orderkey") % F.lit(self.n_events)).alias("event_id"),
                        (F.col("o_orderkey") % 50).cast("int").alias("position"))

    @functools.cached_property
    def watchlist(self) -> DataFrame:
        o = self.raw("orders")
        return o.select(F.col("o_custkey").alias("user_id"),
                        (F.col("o_orderkey") % F.lit(self.n_suppliers)).alias("asset_id")).distinct()
