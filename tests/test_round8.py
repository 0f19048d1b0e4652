"""Occurrences leave a filing counted, and an alias is looked for by its places."""
from pyspark.sql import functions as F

from eventlens.functions.phrases import PhraseFilter
from eventlens.operators import graph as G


def test_a_hit_leaves_its_row_without_its_window(spark):
    # An alias of three companies: its window used to be copied to each of them.
    assets = spark.createDataFrame([("S1", "twin mills"), ("S2", "twin mills"), ("S3", "twin mills"), ("T9", "nine")], "ticker string, name string")
    filings = spark.createDataFrame([(i, "T9", "our supplier twin mills and " + "x" * 400 + " customer twin mills twin mills") for i in range(5)]
                                    + [(9, None, "supplier twin mills"), (10, "T9", None)], "fid int, source_ticker string, text string")
    for substring, find in ((False, G._word_hits), (True, G._substring_hits)):
        f = filings.select(F.upper("source_ticker").alias("src"), F.coalesce("text", F.lit("")).alias("_x"))
        hits, al = find(f, G.filing_aliases(assets))
        assert sorted(hits.dtypes) == [("cus", "boolean"), ("gram", "string"), ("src", "string"), ("sup", "boolean")]
        edges = G.filing_edges(filings, assets, key="fid", substring=substring)
        got = {(r["source_key"][6:], r["target_key"][6:]): r["mentions"] for r in edges.collect()}
        assert got == {**{(f"S{k}", "T9"): 5 for k in (1, 2, 3)}, **{("T9", f"S{k}"): 10 for k in (1, 2, 3)}}


def test_substrings_are_found_at_every_place_and_apart(spark):
    assets = spark.createDataFrame([("abab", "x"), ("Z", "abcdefghijk")], "ticker string, name string")
    text = "supplier ababababab " + "é" * 30 + "abcdefghijk" + "abab"
    f = spark.createDataFrame([(1, "Q", text)], "fid int, source_ticker string, text string")
    hits, _ = G._substring_hits(f.select(F.col("source_ticker").alias("src"), F.col("text").alias("_x")), G.filing_aliases(assets))
    found = hits.groupBy("gram").count().where("gram is not null")
    assert {r["gram"]: r["count"] for r in found.collect()} == {"abab": 3, "abcdefghijk": 1}


def test_a_sparse_bitmap_holds_several_places_of_a_phrase(spark):
    known = PhraseFilter.of(spark.range(2000).select(F.array(F.concat(F.lit("phrase"), F.col("id"))).alias("words")))
    probe = spark.range(20000).select(F.concat(F.lit("phrase"), F.col("id")).alias("p"))
    kept = probe.where(known.may_be(F.col("p")))
    assert known.places > 1
    assert probe.limit(2000).join(kept, "p").count() == 2000
    assert kept.count() < 2000 + 400   # one place a phrase lets 1 in 16 others pass


def test_a_gate_does_not_compute_its_score_again(spark, t01):
    from eventlens.functions import text as T
    from eventlens.operators import filters as FL
    prepared = T.prepare_text(t01.article, T.article_text("title", "content"))
    scored = prepared.select("article_id", T.relevance_score(norm="_t_norm", nlow="_t_nlow", source="source").alias("relevance_score"))
    plan = FL.relevance_gate(scored)._jdf.queryExecution().optimizedPlan().toString()
    # The filter used to hold the squeezed text once for each of 54 keywords and more.
    assert plan.count("regexp_replace") == 1


def test_scores_cut_their_text_once(spark):
    from eventlens.functions import text as T
    df = spark.createDataFrame([("The war and the strike",), ("",), ("é é é war",), (None,)], "x string")
    lang = T.prepare_text(df, F.col("x")).withColumn("_lang", T.language_score(norm="_t_norm")).select("_lang.code", "_lang.confidence")
    assert lang._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    got = [(r["code"], round(r["confidence"], 6)) for r in lang.collect()]
    # 3 stop words of 5; nothing; 1 token, 6 of 9 characters ASCII
    assert got == [("en", 0.92), ("unknown", 0.0), ("en", round(0.52 + 6 / 9 * 0.18, 6)), ("unknown", 0.0)]
    low = F.lower(F.coalesce("x", F.lit("")))
    signal = df.select(T.impact_signal(low=low).alias("s"), T.infer_event_type(low=low).alias("t")).select("s.polarity", "s.intensity", "t.event_type", "t._h")
    assert signal._jdf.queryExecution().optimizedPlan().toString().count("missile") == df.select(
        T.impact_signal(low=low), T.infer_event_type(low=low))._jdf.queryExecution().optimizedPlan().toString().count("missile")
