"""As-of lookup against brute force; properties of the price operators."""
import random

import pandas as pd
from pyspark.sql import functions as F

from eventlens.operators import market as M


def brute_nearest(prices, asset, t):
    p = prices[prices.asset_id == asset]
    after = p[p.ts >= t].sort_values("ts")
    if len(after):
        return after.close.iloc[0]
    before = p[p.ts <= t].sort_values("ts")
    return before.close.iloc[-1] if len(before) else None


def test_asof_matches_brute_force(spark):
    rnd = random.Random(7)
    base = pd.Timestamp("2024-01-01")
    prices = pd.DataFrame([(a, base + pd.Timedelta(minutes=rnd.randrange(0, 60 * 24 * 20)), float(i))
                           for i, a in enumerate(rnd.choice([1, 2, 3]) for _ in range(300))],
                          columns=["asset_id", "ts", "close"]).drop_duplicates(["asset_id", "ts"])
    targets = pd.DataFrame([(i, rnd.choice([1, 2, 3, 4]), base + pd.Timedelta(minutes=rnd.randrange(-600, 60 * 24 * 22)))
                            for i in range(200)], columns=["tid", "asset_id", "target_at"])
    sp = spark.createDataFrame(prices)
    st = spark.createDataFrame(targets)
    for bucket in (3600, 86400, 7 * 86400):
        got = {r.tid: r.price for r in M.asof_price(st, sp, bucket_seconds=bucket).collect()}
        for r in targets.itertuples():
            want = brute_nearest(prices, r.asset_id, r.target_at)
            assert got[r.tid] == want, (bucket, r)


def test_asof_null_target_and_partition_invariance(spark):
    p = spark.createDataFrame([(1, "2024-01-01 00:00:00", 10.0), (1, "2024-01-03 00:00:00", 30.0)],
                              "asset_id int, ts string, close double").withColumn("ts", F.col("ts").cast("timestamp"))
    t = spark.createDataFrame([(1, 1, None), (2, 1, "2024-01-02 00:00:00"), (3, 1, "2024-01-05 00:00:00")],
                              "tid int, asset_id int, target_at string").withColumn("target_at", F.col("target_at").cast("timestamp"))
    a = {r.tid: r.price for r in M.asof_price(t, p).collect()}
    b = {r.tid: r.price for r in M.asof_price(t.repartition(5), p.repartition(3)).collect()}
    assert a == b == {1: None, 2: 30.0, 3: 30.0}
    fwd = {r.tid: r.price for r in M.asof_price(t, p, direction="forward").collect()}
    assert fwd[3] is None


def test_last_bars_plans_group_limit(spark):
    p = spark.range(1000).select((F.col("id") % 3).alias("asset_id"), F.timestamp_seconds("id").alias("ts"))
    plan = M.last_bars(p, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert M.last_bars(p, 5).count() == 15
