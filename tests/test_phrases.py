"""Phrase search inside rows against plain versions."""
import random

from pyspark.sql import functions as F

from eventlens.functions.phrases import PhraseFilter, let, running_sums
from eventlens.operators.graph import filing_edges


def test_running_sums_over_many_pieces(spark):
    rows = [([],), ([5],), (list(range(700)),), (None,)]
    got = spark.createDataFrame(rows, "v array<bigint>").select(running_sums(F.col("v"), 64).alias("s")).collect()
    plain = [[sum(v[:i + 1]) for i in range(len(v))] if v is not None else None for (v,) in rows]
    assert [r.s for r in got] == plain


def test_grams_hold_every_phrase(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    phrases = [rng.sample(words, rng.randint(1, 3)) for _ in range(30)]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 60))] for _ in range(50)]
    known = PhraseFilter.of(spark.createDataFrame([(p,) for p in phrases] + [([],), (None,)], "words array<string>"))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, w array<string>")
    got = {r.id: {(g.at, g.gram) for g in r.g} for r in df.select("id", let(F.col("w"), known.grams).alias("g")).collect()}
    for i, t in enumerate(texts):
        want = {(k + 1, " ".join(p)) for p in phrases for k in range(len(t)) if t[k:k + len(p)] == p}
        assert want <= got[i] and len(got[i]) <= len(want) + 0.1 * 3 * len(t) + 2
    nothing = PhraseFilter.of(spark.createDataFrame([], "words array<string>"))
    assert all(r.g == [] for r in df.select(let(F.col("w"), nothing.grams).alias("g")).collect())


def test_filing_words_do_not_leave_the_row(spark):
    f = spark.createDataFrame([("A", "filler " * 5000 + "major customer beta corp. " + "filler " * 5000), ("A", ""), ("B", None)],
                              "source_ticker string, text string").withColumn("filing_id", F.monotonically_increasing_id())
    assets = spark.createDataFrame([("A", "Alpha"), ("B", "Beta Corp")], "ticker string, name string")
    edges = filing_edges(f, assets)
    assert [(r.source_key, r.target_key, r.mentions) for r in edges.collect()] == [("ASSET:A", "ASSET:B", 2)]
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "Window" not in plan
