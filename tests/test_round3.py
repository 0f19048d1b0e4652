"""Entities, delimiters per file, phrases across articles, alert ranges, row positions, provider health."""
import html
import random

from pyspark.sql import functions as F

from eventlens.functions import text as T
from eventlens.operators import alerts as AL
from eventlens.operators import events as EV
from eventlens.operators.market import asof_price, dense_borders
from eventlens.operators.serving import provider_health
from eventlens.operators.signals import chrono_split, row_index
from eventlens.sources import events as E


def test_entities_as_the_standard_library(spark):
    rng = random.Random(1)
    bits = ["&", "&amp;", "&ampfoo", "&notit;", "&notin;", "&eacute", "&Eacute;", "&#65;", "&#65", "&#x41;", "&#X1F600;", "&#128;", "&#0;", "&#xD800;",
            "&#99999999999999999999;", "&#00000000000000065;", "&#xFDD0;", "&#x1FFFE;", "&CounterClockwiseContourIntegral;", "&copy2", "&lt", "&gt;", "&nosuch;",
            "&;", "&#;", "&#x;", " ", "a", ";", "é", "&frac12x", "&&amp;", "&#13;", "&#11;", "&acE;", "<", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1500)] + [f"&{n}" for n in html.entities.html5] + ["", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, v string").select("i", T.unescape_html("v").alias("x")).collect()
    wrong = [(texts[r.i], r.x, html.unescape(texts[r.i])) for r in got if texts[r.i] is not None and r.x != html.unescape(texts[r.i])]
    assert not wrong and [r.x for r in got if texts[r.i] is None] == [None]


def test_a_delimiter_per_file(spark, tmp_path):
    for name, text in (("a.csv", "x,y\n1,2\n"), ("b.csv", "y;x\n3;4,5\n"), ("c.tsv", "x\ty\tz\n6\t7\t8\n"), ("d.csv", "x\n9\n")):
        (tmp_path / name).write_text(text)
    got = sorted(tuple(r) for r in E.read_rows(spark, str(tmp_path)).select("x", "y", F.coalesce("z", F.lit("-"))).fillna("-").collect())
    assert got == [("1", "2", "-"), ("4,5", "3", "-"), ("6", "7", "8"), ("9", "-", "-")]


def test_phrases_across_articles_as_in_the_joined_text(spark, t01):
    rng = random.Random(7)
    assets = spark.createDataFrame([(1, "AAA", "Zeta Alpha Works Corp", "S", "X"), (2, "BBB", "Omega Prime", "S", "X")],
                                   "asset_id bigint, ticker string, name string, sector string, country string")
    words = ["zeta", "alpha", "works", "corp", "omega", "prime", "saudi", "arabia", "oil", "supply"]
    arts = [(i, rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.randint(0, 5)) for i in range(120)]
    articles = spark.createDataFrame([(i, t, c, None if k == 0 else f"2024-01-0{k}") for i, t, c, k in arts],
                                     "article_id bigint, title string, content string, p string").withColumn("published_at", F.col("p").cast("timestamp"))
    events = spark.createDataFrame([(e, "conflict", 0.7) for e in range(30)], "event_id bigint, event_type string, confidence_score double")
    links = spark.createDataFrame([(i % 30, i) for i in range(120)], "event_id bigint, article_id bigint")
    out = EV.backfill_entities(events, links, articles, assets, t01.kg_edge)
    got = {(r.event_id, r.tag) for r in out["tags"].collect()}
    impacts = {(r.event_id, r.ticker) for r in out["impacts"].where("layer = 1").collect()}
    whole = []
    for e in range(30):
        mine = sorted((a for a in arts if a[0] % 30 == e), key=lambda a: (a[3] != 0, -a[3], a[0]))
        whole.append((e, "\n".join(f"{t}\n{c}" for _, t, c, _ in mine)))
    docs = spark.createDataFrame(whole, "event_id bigint, text string")
    from eventlens.operators import mapping as MP
    m = MP.extract_mentions(docs, MP.asset_aliases(assets), key="event_id")
    want = {(r.event_id, x) for r in MP.entity_tags(docs, m, assets, key="event_id").collect() for x in r.tags}
    assert got == want and impacts == {(r.event_id, r.ticker) for r in m.collect()} and impacts


def test_alert_ranges_meet_only_what_matches(spark):
    rng = random.Random(9)
    levels = [0.0, 1 / 16, 0.25, 0.2500001, 0.999999, 1.0, 1.5, -0.2, None]
    rows = [(i, rng.choice(["conflict", "election", None]), rng.choice(levels[:-1] + [rng.random()]), "auto_approved") for i in range(120)]
    events = spark.createDataFrame(rows, "event_id bigint, event_type string, confidence_score double, status string")
    asks = [(k, k, rng.choice([None, 1, 2]), rng.choice(["conflict", "election", None]), rng.choice(levels + [rng.random()]), True) for k in range(80)]
    alerts = spark.createDataFrame(asks, "alert_id bigint, user_id bigint, asset_id bigint, event_type string, threshold double, is_active boolean")
    impacts = spark.createDataFrame([(i, i % 3, rng.random(), None) for i in range(120)], "event_id bigint, asset_id bigint, impact_strength double, confidence_score double")
    strength = {(r.event_id, r.asset_id): r.impact_strength for r in impacts.collect()}
    want = set()
    for a, u, asset, kind, least, _ in asks:
        for e, t, c, _ in rows:
            if kind is not None and kind != t:
                continue
            if asset is None:
                signal = c or 0.0
            elif (e, asset) in strength:
                signal = strength[e, asset] or c or 0.0
            else:
                continue
            if least is None or signal >= least:
                want.add((a, u, e, signal))
    got = AL.match_alerts(events, impacts, alerts).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_positions_of_repeated_and_missing_keys(spark):
    rows = [(None, "a"), (3, "b"), (3, "c"), (1, None), (2, "d"), (None, "e")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = sorted((r.row_index, r.k) for r in row_index(df, ["k"], 3).collect())
    assert got == [(0, None), (1, None), (2, 1), (3, 2), (4, 3), (5, 3)]
    assert {r.split for r in chrono_split(df, ["k"], (0.5,)).collect()} == {"train", "test"}
    assert row_index(df.limit(0), ["k"]).count() == 0


def test_health_over_a_long_log(spark):
    rng = random.Random(2)
    log = [(i, f"p{i % 3}" if i % 7 else "hot", rng.random() < 0.4, rng.uniform(10, 4000)) for i in range(9000)]
    df = spark.createDataFrame(log, "request_id bigint, provider string, success boolean, latency_ms double").withColumn("ts", F.timestamp_seconds(F.col("request_id")))
    got = {r.provider: r for r in provider_health(df).collect()}
    for p in ("p0", "p1", "p2", "hot"):
        score, latency = 1.0, 200.0
        for _, q, ok, ms in log:
            if q == p:
                score, latency = max(0.05, min(1.0, 0.8 * score + 0.2 * ok)), 0.8 * latency + 0.2 * ms
        assert abs(got[p].score - score) < 1e-9 and abs(got[p].latency_ema - latency) < 1e-6


def test_dense_bucket_is_cut_by_its_data(spark):
    rng = random.Random(3)
    day = 1_700_006_400  # one asset with most bars in one day, the others with few
    bars = [(1, day + rng.randint(0, 86_000), float(k)) for k in range(6000)] + [(2, day + 3600 * k, float(k)) for k in range(48)]
    bars = [(a, s * 1_000_000 + i % 7, v) for i, (a, s, v) in enumerate({(a, s): (a, s, v) for a, s, v in bars}.values())]
    asks = [(i, rng.randint(1, 3), day + rng.randint(-90_000, 180_000)) for i in range(400)]
    p = spark.createDataFrame(bars, "asset_id int, us bigint, close double").withColumn("ts", F.timestamp_micros("us"))
    t = spark.createDataFrame(asks, "id int, asset_id int, s bigint").withColumn("target_at", F.timestamp_seconds("s"))
    cell = p.select("asset_id", F.col("ts").alias("_t"), F.floor(F.unix_seconds("ts") / (7 * 86400)).alias("_b"))
    cuts = dense_borders(cell, ["asset_id"], 1000).collect()
    assert [r.asset_id for r in cuts] == [1] and len(cuts[0]["_borders"]) > 200 and dense_borders(cell, ["asset_id"], 10_000) is None
    times = sorted(u for a, u, _ in bars if a == 1)
    parts = [0] * (len(cuts[0]["_borders"]) + 1)
    for u in times:
        parts[sum(b <= u for b in cuts[0]["_borders"])] += 1
    assert max(parts) <= 4 * len(times) / len(parts)
    for way in ("nearest", "forward", "backward"):
        cut = {r.id: r.price for r in asof_price(t, p, direction=way, dense_rows=1000).collect()}
        assert cut == {r.id: r.price for r in asof_price(t, p, direction=way).collect()}
        for i, a, s in asks:
            after = min(((u, v) for x, u, v in bars if x == a and u >= s * 1_000_000), default=(0, None))[1]
            before = max(((u, v) for x, u, v in bars if x == a and u <= s * 1_000_000), default=(0, None))[1]
            want = {"forward": after, "backward": before, "nearest": before if after is None else after}[way]
            assert cut[i] == want
