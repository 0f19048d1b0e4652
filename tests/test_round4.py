"""Bars that close at 0, files of one row group, the throttle's last minutes, gates, substring aliases, similar events in classes."""
import math

from pyspark.sql import functions as F

from eventlens.operators import features as X
from eventlens.operators import ml as ML
from eventlens.session import spread


def _klines(spark, closes):
    rows = [(s, i, float(c)) for s in ("K0", "K1") for i, c in enumerate(closes)]
    k = spark.createDataFrame(rows, "symbol string, i int, close double")
    return k.select("symbol", F.timestamp_seconds(F.lit(1700000000) + F.col("i") * 3600).alias("open_time"), (F.col("close") + 1).alias("open"),
                    (F.col("close") + 2).alias("high"), F.col("close").alias("low"), "close", (F.col("i") % 7 + 1.0).alias("volume"),
                    F.lit(5).cast("bigint").alias("num_trades"), F.lit(0.5).alias("taker_buy_volume"))


def test_candles_after_a_close_of_zero(spark):
    k = _klines(spark, [3 + i % 5 for i in range(30)] + [0, 0] + [4 + i % 3 for i in range(40)])
    got = {r.i: r for r in X.candle_features(k).where("symbol = 'K0'")
           .withColumn("i", ((F.unix_timestamp("open_time") - 1700000000) / 3600).cast("int")).collect()}
    assert got[30].ret_1 == -1.0 and math.isnan(got[31].ret_1) and got[32].ret_1 == math.inf and math.isnan(got[33].vol_6)
    assert got[30].range_pct is None and got[0].ret_1 is None and got[38].vol_6 > 0
    train = X.candle_training(k)
    # The bars at 0 have no range; of the rest only those before a full window and the last have a gap.
    assert train.count() == 2 * (72 - 24 - 2 - 1)
    assert {r.label for r in train.where("ret_1 = double('Infinity')").collect()} <= {"up", "down", "flat"}
    assert X.candle_latest(k).count() == 2
    _, _, metrics = ML.train_forest(train, ["open_time", "symbol"], X.CANDLE_FEATURES, num_trees=3)
    m = metrics.first()
    assert m.train_rows + m.test_rows == train.count()


def test_a_file_of_one_row_group_is_dealt_over_the_slots(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(40000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")).coalesce(1).write.parquet(path)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        t = spark.read.parquet(path)
        assert t.rdd.getNumPartitions() >= 8 and max(r["count"] for r in t.groupBy(F.spark_partition_id()).count().collect()) == 40000
        for dealt in (spread(t, ["id"]), spread(t)):
            rows = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(rows) == 40000 and max(rows) < 2 * 40000 / 8
        even = t.repartition(8)
        assert spread(even) is even
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_the_throttle_gives_the_last_minutes_too(spark, tmp_path):
    from eventlens.streaming import operators as ST
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    ticks = [("A", 1.0 * i, 1700000000 + 7 * i, i) for i in range(60)] + [("B", 5.0, 1700000000 + 7 * 59, 99), ("C", 2.0, 1700000000, 100)]
    spark.createDataFrame(ticks, "ticker string, price double, s bigint, seq bigint").select(
        "ticker", "price", F.timestamp_seconds("s").alias("ts"), "seq").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    ST.run_append(ST.stream_throttle(stream), out, ck)
    closed = spark.read.parquet(out)
    got = sorted(r.seq for r in closed.unionByName(ST.throttle_rest(spark, ck)).collect())
    assert got == sorted([*range(0, 60, 3), 99, 100]) and closed.count() < len(got)


def test_substring_aliases_need_no_join_on_contains(spark):
    from eventlens.operators import graph as G
    assets = spark.createDataFrame([("S1", "Zeta Corp"), ("aa", "Alpha+Works (x)"), ("S12", "beta"), ("Q", "\U0001F600z beta")], "ticker string, name string")
    f = spark.createDataFrame([(1, "q", "our major customer s12s1 and supplier aaaaa"), (2, "s1", "\U0001F600 \U0001F600z beta supplier alpha+works (x)"),
                               (3, "s1", None), (4, "zz", "s"), (4, "zz", "zeta customer beta")], "fid int, source_ticker string, text string")
    edges = G.filing_edges(f, assets, key="fid", substring=True)
    got = {(r.source_key[6:], r.target_key[6:]): r.mentions for r in edges.collect()}
    # s1 in s12 and s1; s12 once; "aa" twice in aaaaa: each both ways in text 1
    want = {("S1", "Q"): 2, ("Q", "S1"): 2, ("S12", "Q"): 1, ("Q", "S12"): 1, ("AA", "Q"): 2, ("Q", "AA"): 2,
            ("AA", "S1"): 1, ("Q", "S1x"): 0, ("ZZ", "S1"): 1, ("ZZ", "S12"): 1}
    want.pop(("Q", "S1x"))
    want[("S12", "S1")] = 1   # beta in text 2
    want[("Q", "S1")] += 1    # the name that holds a character outside the BMP
    assert got == want
    assert "NestedLoop" not in edges._jdf.queryExecution().toString()


def test_similar_events_meet_in_classes(spark):
    from eventlens.operators import mapping as MP
    rows = [(i, "conflict", "auto_approved", f"conflict {'alpha' if i % 2 else 'beta'}", "war offensive continues") for i in range(200)]
    events = spark.createDataFrame([(*r, None, None) for r in rows], "event_id bigint, event_type string, status string, title string, description string, "
                                   "published_at timestamp, created_at timestamp")
    impacts = spark.createDataFrame([(i, i % 40, (i % 37) / 40) for i in range(200)], "event_id bigint, asset_id bigint, confidence_score double")
    assets = spark.createDataFrame([(i, f"S{i}") for i in range(40)], "asset_id bigint, ticker string")
    docs = spark.createDataFrame([(1, "conflict", "alpha war offensive"), (2, "conflict", "beta conflict continues"), (3, "conflict", "nothing")],
                                 "doc_id int, event_type string, text string")
    direct = spark.createDataFrame([(1, "s36"), (1, "S35"), (2, "S34")], "doc_id int, ticker string")
    plain = MP.similarity_corpus(events, impacts, assets, lookback=1000)
    classes = MP.similarity_corpus(events, impacts, assets, lookback=None)
    assert classes[0].select("c_event").distinct().count() == 2 < plain[0].select("c_event").distinct().count()
    pick = lambda c, **k: sorted((r.doc_id, r.ticker, round(r.score, 9)) for r in MP.expand_similar(docs, c, direct, **k).collect())
    got = pick(classes, prefix_filter=True)
    assert got == pick(plain) and len(got) == 10
