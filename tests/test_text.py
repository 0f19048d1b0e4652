"""Hand-computed rows for the text scorers (expected values worked out by hand)."""
import pytest
from pyspark.sql import functions as F

from eventlens.functions import text as T


def one(spark, col, **vals):
    cols = ", ".join(f"{k} string" for k in vals)
    df = spark.createDataFrame([tuple(vals.values())], cols)
    return df.select(col.alias("x")).first()["x"]


def test_news_category_ties_go_to_earlier_group(spark):
    # "attack" (conflict, 1 hit) and "sanction" (sanction, 1 hit): tie -> conflict (earlier group)
    assert one(spark, T.news_category(), title="Attack and sanction", content="") == "conflict"
    assert one(spark, T.news_category(), title="Gardening club", content="roses") == "general"
    # two sanction hits beat one conflict hit
    assert one(spark, T.news_category(), title="war", content="sanction embargo") == "sanction"


def test_relevance_score_formula(spark):
    # "China sanction and embargo on chip exports" (< 80 chars, source Reuters):
    # 0.16 + geo min(0.18, 2*0.09)=0.18 + markets min(0.08, 1*0.04)=0.04 + upper-token 0
    # + trusted source 0.05 - short 0.06 = 0.37
    v = one(spark, T.relevance_score(F.col("t"), F.col("s")), t="China sanction and embargo on chip exports",
            s="Reuters")
    assert v == pytest.approx(0.37)
    assert one(spark, T.relevance_score(F.col("t"), F.col("s")), t="   ", s="x") == 0.0


def test_extract_countries_order_and_word_boundaries(spark):
    # 'us' inside 'business' is no match; order by first position; alias order picks the position.
    v = one(spark, T.extract_countries(F.col("t")), t="Business in Japan; later the US and China talk")
    assert v == ["Japan", "United States", "China"]
    assert one(spark, T.extract_country(F.col("t")), t="ukraine and uk") == "Ukraine"


def test_source_and_recency_scores(spark):
    assert one(spark, T.source_score(F.col("s")), s="AP News") == 0.90
    assert one(spark, T.source_score(F.col("s")), s="") == 0.68
    assert one(spark, T.source_score(F.col("s")), s="Local Gazette") == 0.70
    df = spark.createDataFrame([("2024-01-01 10:00:00",)], "ts string").select(F.col("ts").cast("timestamp").alias("ts"))
    for as_of, want in [("2024-01-01 11:00:00", 0.95), ("2024-01-01 21:00:00", 0.88), ("2024-01-02 09:00:00", 0.80),
                        ("2024-01-03 10:00:00", 0.70), ("2024-01-07 10:00:00", 0.62), ("2024-02-01 00:00:00", 0.52)]:
        assert df.select(T.recency_score("ts", as_of)).first()[0] == want


def test_sentiment_and_labels(spark):
    assert one(spark, T.sentiment(F.col("t")), t="deal approved despite tariff") == pytest.approx((2 - 1) / 3)
    assert one(spark, T.sentiment(F.col("t")), t="quiet day") == 0.0
    assert one(spark, T.sentiment(F.col("t")), t="  ") is None
    assert one(spark, T.sentiment_label(F.col("x").cast("double"), 1.0), x="-1.0") == "negative"


def test_html_strip_and_host(spark):
    html = "<html><script>var a='<p>'</script><style>p{}</style><p>A &amp; B &#233;t&#xE9;</p></html>"
    assert one(spark, T.strip_html(F.col("h")), h=html).strip() == "a & b été"
    assert one(spark, T.url_host(F.col("u")), u="HTTPS://Example.COM:8080/x?y") == "example.com:8080"
    assert one(spark, T.url_host(F.col("u")), u="example.com/x") is None


def test_parse_enum_and_symbols(spark):
    assert one(spark, T.parse_enum(F.col("s"), ["pending_review"]), s=" Pending-Review ") == "pending_review"
    assert one(spark, T.parse_enum(F.col("s"), ["pending_review"]), s="nope") is None
    assert one(spark, T.crypto_symbol(F.col("s")), s="btc-usd") == "BTCUSDT"
    assert one(spark, T.forex_symbol(F.col("s")), s="EURUSD") == "EUR/USD"
