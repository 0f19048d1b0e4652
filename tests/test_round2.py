"""Malformed values, the throttle over many unordered rows, linear as-of."""
import time

import pandas as pd
from pyspark.sql import functions as F

from eventlens.functions import text as T
from eventlens.operators.market import asof_price
from eventlens.operators.serving import epoch_to_ts
from eventlens.sources import events as E
from eventlens.sources import payloads as P
from eventlens.streaming import operators as ST


def test_malformed_values_become_null(spark):
    rows = [(v,) for v in ("nan", "1e30", "-inf", "12.9", "x", "", None)]
    df = spark.createDataFrame(rows, "v string")
    assert [r[0] for r in df.select(E.to_int("v")).collect()] == [None, None, None, 12, None, None, None]
    dates = spark.createDataFrame([("99999999999",), ("45000",), ("2958466",), ("nan",)], "v string")
    assert [str(r[0]) for r in dates.select(E.parse_date("v")).collect()] == ["None", "2023-03-15", "None", "None"]
    stamps = spark.createDataFrame([("abc",), ("1700000000",), ("9" * 40,), (None,)], "v string")
    assert [str(r[0]) for r in stamps.select(epoch_to_ts("v").cast("string")).collect()] == ["None", "2023-11-14 22:13:20", "None", "None"]


def test_entities_out_of_range(spark):
    df = spark.createDataFrame([("a &#9999999; b &#65; &#xD800; &#x41;",)], "v string")
    assert df.select(T.strip_html("v")).first()[0] == "a � b a � a"


def test_bad_trade_time_keeps_the_job(spark):
    df = spark.createDataFrame([('[{"ev":"T","sym":"a","p":1.5,"t":"abc"},{"ev":"T","sym":"b","p":2.0,"t":"1700000000000"}]',)], "payload string")
    got = {r.ticker: r.ts for r in P.parse_trades(df, "polygon").collect()}
    assert got["A"] is None and got["B"] is not None


def test_whole_titles_and_bodies(spark):
    df = spark.createDataFrame([('{"feed":{"title":"F"},"entries":[{"title":"%s","summary":"%s","link":"u"}]}' % ("t" * 700, "s" * 7000),)], "payload string")
    row = P.normalize_news(df, "rss").first()
    assert len(row.title) == 700 and len(row.content) == 7000


def test_throttle_sorts_across_pieces_and_batches(spark, tmp_path):
    base = pd.Timestamp("2024-01-01")
    seconds = pd.Series(range(30_000)).sample(frac=1, random_state=1)
    half = seconds < 15_000
    schema = "ticker string, price double, ts timestamp, seq long"
    late = pd.Series([31_000])  # a tick of another ticker moves the watermark past the last slab
    for k, part in enumerate((seconds[half], seconds[~half], late)):
        rows = pd.DataFrame({"ticker": "A" if k < 2 else "Z", "price": 1.0, "ts": base + pd.to_timedelta(part, unit="s"), "seq": part})
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b={k}")
    stream = (spark.readStream.schema(schema + ", b int").option("maxFilesPerTrigger", 1)
              .parquet(f"{tmp_path}/in").select("ticker", "price", "ts", "seq"))
    ST.run_append(ST.stream_throttle(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == list(range(0, 30_000, 15))


def test_alerts_once_per_event(spark, tmp_path):
    events = spark.sql("""select * from values (1L, 'conflict', 0.9D, 'auto_approved', timestamp'2024-01-01 00:00:00'),
        (1L, 'conflict', 0.9D, 'auto_approved', timestamp'2024-01-01 00:00:05') as t(event_id, event_type, confidence_score, status, created_at)""")
    events.write.parquet(f"{tmp_path}/ev")
    alerts = spark.sql("select 7L alert_id, 1L user_id, cast(null as bigint) asset_id, 'conflict' event_type, 0.5D threshold, true is_active")
    impacts = spark.sql("select 1L event_id, 2L asset_id, 0.5D impact_strength, 0.5D confidence_score")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")
    ST.run_append(ST.stream_alerts(stream, impacts, alerts), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [(r.alert_id, r.event_id) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(7, 1)]


def test_asof_is_linear_in_a_hot_bucket(spark):
    def seconds(n):
        targets = spark.range(n).select(F.lit(1).alias("asset_id"), F.timestamp_seconds(F.col("id") % 80_000 + 100_000).alias("target_at"))
        bars = spark.range(n).select(F.lit(1).alias("asset_id"), F.timestamp_seconds(F.col("id") % 80_000).alias("ts"), F.col("id").cast("double").alias("close"))
        began = time.time()
        asof_price(targets, bars).write.format("noop").mode("overwrite").save()
        return time.time() - began
    seconds(1_000)
    small, large = seconds(20_000), seconds(80_000)
    assert large < 6 * small + 3


def test_filing_edges_match_whole_words(spark):
    import re
    from eventlens.operators.graph import filing_aliases, filing_edges
    assets = spark.createDataFrame([("AA", "Alpha Corp"), ("BET", "Beta Works Inc"), ("GAM", "Gamma-Ray")], "ticker string, name string")
    texts = [("AA", "our supplier beta works inc. and better betas; bet again " + "x " * 200 + "gamma-ray, a customer"),
             ("BET", "alpha sales to alphabet and aa; " + "y " * 200 + "the alpha corp"), ("GAM", ""), ("GAM", None)]
    filings = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "filing_id int, source_ticker string, text string")
    want = {}
    for src, text in texts:
        for ticker, alias in {(r.ticker, " ".join(re.findall(r"\w+", r.alias))) for r in filing_aliases(assets).collect()}:
            words = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+", text or "")]
            n = len(alias.split())
            for i in range(len(words) - n + 1):
                if src != ticker and " ".join(w for w, _, _ in words[i:i + n]) == alias:
                    win = text[max(0, words[i][1] - 180):words[i + n - 1][2] + 180]
                    if any(k in win for k in ("supplier", "supply chain", "sourced from", "procured from")):
                        want[ticker, src] = want.get((ticker, src), 0) + 1
                    if any(k in win for k in ("customer", "revenue from", "sales to")):
                        want[src, ticker] = want.get((src, ticker), 0) + 1
    got = {(r.source_key[6:], r.target_key[6:]): r.mentions for r in filing_edges(filings, assets).collect()}
    assert got == want and want
    assert filing_edges(filings, assets.limit(0)).count() == 0
