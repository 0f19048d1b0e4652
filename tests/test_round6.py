"""Work done once, and parts that keep their size whatever the table's."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from eventlens.operators import corpora as C
from eventlens.operators import features as X
from eventlens.operators import ml as ML
from eventlens.operators import signals as SG


def _counted(spark, rows, schema):
    """The rows, and an accumulator of how many were read."""
    read = spark.sparkContext.accumulator(0)

    def seen(r):
        read.add(1)
        return r
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), schema), read


def test_class_report_reads_its_rows_once(spark):
    rows = [(1, 1), (1, 0), (0, 0), (0, 0), (None, 1), (2, None)]
    df, read = _counted(spark, rows, "label int, prediction int")
    got = {r["cls"]: r for r in SG.class_report(df).collect()}
    assert read.value == len(rows)
    assert got["1"]["precision"] == 0.5 and got["1"]["recall"] == 0.5 and got["1"]["support"] == 2
    assert got["0"]["precision"] == pytest.approx(2 / 3) and got["0"]["recall"] == 1.0
    assert got["2"]["support"] == 1 and got["2"]["f1"] == 0.0
    assert got[None]["support"] == 0 and got["macro avg"]["support"] == 5
    empty = SG.class_report(spark.createDataFrame([], "label int, prediction int")).collect()
    assert [(r["cls"], r["support"]) for r in empty] == [("macro avg", None)]


def test_filter_signals_reads_its_rows_once(spark):
    rows = [(i, (i % 100) / 100.0, i % 2, (i // 7) % 2) for i in range(400)]
    df, read = _counted(spark, rows, "row_id bigint, prob double, target int, event_spike int")
    got = SG.filter_signals(df).collect()
    assert read.value == len(rows)
    top = sorted((r for r in rows if r[1] > 0.6), key=lambda r: (-r[1], -r[0]))[:60]
    fired = [r for r in top if r[3] == 1]
    assert got[0]["trades"] == len(fired) and got[0]["coverage"] == pytest.approx(len(fired) / 400)
    assert got[0]["precision"] == pytest.approx(sum(r[2] for r in fired) / len(fired))


def test_dataset_parts_grow_with_the_rows(spark, monkeypatch):
    day = dt.date(2024, 1, 1)
    prices = spark.createDataFrame([(s, day + dt.timedelta(days=d), 100.0 + (s * 7 + d * d) % 13) for s in range(40) for d in range(20)],
                                   "symbol bigint, date date, close double")
    events = spark.createDataFrame([(dt.datetime(2024, 1, 1 + d), 0.1 * d, 2.0, 6) for d in range(20)],
                                   "published_at timestamp, sentiment double, goldstein double, num_articles int")
    monkeypatch.setattr(X, "DATASET_PART_ROWS", 25)
    fine = X.build_dataset(prices, events)
    assert fine.rdd.getNumPartitions() >= 800 // 25
    # The rank that is taken early equals the one taken among the joined rows.
    daily = X.daily_events(X.filter_high_impact(events))
    plain = X.label_breakout(X.event_features(X.market_features(X.join_calendar(prices, daily))))
    assert fine.columns == plain.columns
    cols = ["symbol", "date", *[F.round(c, 9).alias(c) for c in fine.columns if c not in ("symbol", "date")]]
    assert not fine.select(cols).exceptAll(plain.select(cols)).count() and fine.count() == plain.count()


def test_forest_reads_its_rows_once(spark):
    rows = [(i, float(i % 7), float(i % 3), "up" if i % 7 > 3 else "down") for i in range(200)]
    df, read = _counted(spark, rows, "k bigint, a double, b double, label string")
    _, _, metrics = ML.train_forest(df, ["k"], ["a", "b"], num_trees=2)
    got = metrics.first()
    assert read.value == len(rows)
    assert (got["train_rows"], got["test_rows"]) == (160, 40)


HISTORY = ("canonical_id string, title string, description string, published_at string, event_date string, event_type string, "
           "sentiment_score string, country string, location_name string, actor1 string, actor2 string, sub_event_type string")


def test_weak_tags_need_no_positions_when_every_row_has_an_id(spark, monkeypatch):
    row = lambda i, key: (key, f"title {i}", "text", f"2024-01-0{i}T00:00:00Z", None, "Conflict", "0.7", "IR", " a  b ", "IR", None, "x")
    ids = spark.createDataFrame([row(i, f"id{i}") for i in range(1, 5)], HISTORY)
    mixed = spark.createDataFrame([row(1, "id1"), row(2, None), row(3, "id3")], HISTORY)
    got = {r["id"]: r["tags"] for r in C.corpora_from_history(mixed, ["weak_ner"])["weak_ner"].collect()}
    assert set(got) == {"id1", "hist-1", "id3"} and got["id1"] == ["IR", "a b", "Conflict", "x"]
    monkeypatch.setattr(SG, "row_index", lambda *a, **k: pytest.fail("positions computed"))
    assert {r["id"] for r in C.corpora_from_history(ids, ["weak_ner"])["weak_ner"].collect()} == {"id1", "id2", "id3", "id4"}
