"""Text, scoring and date scalar functions as native column expressions
(TXT-01..21 except the lookups in operators). No Python UDFs: every
function returns a ``Column`` that runs inside whole-stage codegen.

Keyword tests are substring tests on lower-cased text, as in the reference.
Scorers take the whole text; the reference's 5,000-character cut is only
applied by ``normalize_text`` (TXT-02), whose result is that cut text.
"""
from __future__ import annotations

import html
import json
import re
from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions.common import col, contains_count, seconds_between, ts_lit
from eventlens.functions.phrases import let

TEXT_CUT = 5000


def article_text(title="title", content="content") -> Column:
    """``title + "\\n" + content`` with NULLs as empty strings."""
    return F.concat(F.coalesce(col(title), F.lit("")), F.lit("\n"), F.coalesce(col(content), F.lit("")))


def prepare_text(df, text: Column, prefix: str = "_t"):
    """Add the three text forms the scorers read, each computed once per row:
    ``{prefix}_low`` (lower-cased raw text), ``{prefix}_norm`` (whitespace
    squeezed) and ``{prefix}_nlow`` (squeezed, lower-cased). Score functions
    take these columns so long documents are lower-cased and squeezed once,
    not once per keyword."""
    return (df.withColumn(f"{prefix}_low", F.lower(text))
            .withColumn(f"{prefix}_norm", squeeze(F.coalesce(text, F.lit(""))))
            .withColumn(f"{prefix}_nlow", F.lower(F.col(f"{prefix}_norm"))))


def drop_prepared(df, prefix: str = "_t"):
    return df.drop(f"{prefix}_low", f"{prefix}_norm", f"{prefix}_nlow")


def squeeze(c) -> Column:
    """Runs of whitespace -> one space, trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def normalize_text(c, max_chars: int | None = None) -> Column:
    """TXT-02: whitespace squeeze, trim, cut at ``max_chars`` (None: whole text)."""
    s = squeeze(F.coalesce(col(c), F.lit("")))
    return F.substring(s, 1, max_chars) if max_chars else s


def content_hash(title="title", description="content") -> Column:
    """TXT-01: SHA-256 of ``title::description`` (NULL description -> '')."""
    return F.sha2(F.concat(F.coalesce(col(title), F.lit("")), F.lit("::"),
                           F.coalesce(col(description), F.lit(""))), 256)


def strip_html(c) -> Column:
    """TXT-03: drop script/style blocks and tags, decode entities
    (``unescape_html``), squeeze, lower-case."""
    s = F.regexp_replace(col(c), r"(?is)<script.*?>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style.*?>.*?</style>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    return F.lower(F.regexp_replace(unescape_html(s), r"(?U)\s+", " "))


def _entity_tables() -> tuple[str, str, str]:
    """From Python's table of the HTML5 names: names with a semicolon by their
    first letter (JSON), those that may stand without one (an expression, the
    longest first), and all of these by name (JSON)."""
    by_letter: dict[str, dict[str, str]] = {}
    bare = {}
    for name, text in html.entities.html5.items():
        if name.endswith(";"):
            by_letter.setdefault(name[0], {})[name] = text
        else:
            bare[name] = text
    return json.dumps(by_letter), "^(?:" + "|".join(sorted(bare, key=lambda n: (-len(n), n))) + ")", json.dumps(bare)


#: What the first 160 numeric references stand for (control characters have replacements of their own).
_LOW_REFERENCES = [html.unescape(f"&#{n};") for n in range(160)]


def unescape_html(c) -> Column:
    """Named and numeric character references as ``html.unescape`` decodes
    them: with or without the semicolon where HTML5 allows it, the longest name
    that fits, U+FFFD for what is no character. The text is split at ``&``, so
    each reference costs one look at its own part."""
    by_letter, bare, bare_table = _entity_tables()
    named = F.from_json(F.lit(by_letter), "map<string,map<string,string>>")
    short = F.from_json(F.lit(bare_table), "map<string,string>")

    def decoded(p):
        digits, hexa = F.regexp_extract(p, "^#([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        # More than ten digits (or eight hex ones) without leading zeros are beyond any character.
        plain, plain16 = F.regexp_replace(digits, "^0+(?=.)", ""), F.regexp_replace(hexa, "^0+(?=.)", "")
        number = (F.when(digits != "", F.when(F.length(plain) > 10, F.lit(1 << 40)).otherwise(plain.try_cast("bigint")))
                  .when(hexa != "", F.when(F.length(plain16) > 8, F.lit(1 << 40)).otherwise(F.conv(plain16, 16, 10).try_cast("bigint"))))
        none = number.between(0xFDD0, 0xFDEF) | (F.pmod(number, F.lit(0x10000)) >= 0xFFFE)
        char = (F.when(number < 160, F.get(F.array(*[F.lit(x) for x in _LOW_REFERENCES]), number.cast("int")))
                .when(number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd").when(none, "")
                .otherwise(F.decode(F.unhex(F.lpad(F.hex(F.least(number, F.lit(0x10FFFF))), 8, "0")), "UTF-32")))
        used = F.length(F.regexp_extract(p, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0))
        whole = F.regexp_extract(p, "^[A-Za-z][A-Za-z0-9]{0,31};", 0)
        of_name = F.element_at(F.element_at(named, F.substring(whole, 1, 1)), whole)
        start = F.regexp_extract(p, bare, 0)
        rest = lambda n: F.substring(p, n + 1, F.lit(1 << 30))
        return (F.when(number.isNotNull(), F.concat(char, rest(used)))
                .when((whole != "") & of_name.isNotNull(), F.concat(of_name, rest(F.length(whole))))
                .when(start != "", F.concat(F.element_at(short, start), rest(F.length(start))))
                .otherwise(F.concat(F.lit("&"), p)))

    parts = F.split(col(c), "&", -1)
    return F.when(~F.contains(col(c), F.lit("&")), col(c)).otherwise(
        F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 1 << 30), decoded), "")))


def language_score(text=None, *, norm=None) -> Column:
    """TXT-04: fallback language guess -> struct(code, confidence).
    ``norm``: the squeezed text when already prepared."""
    norm = col(norm) if norm is not None else normalize_text(text, None)

    # Tokens and counts are bound once: a struct of plain expressions is taken apart by
    # the optimizer, and each of its fields cuts the text again.
    def counted(n):
        nchar = F.length(n)
        ascii_n = F.when(F.octet_length(n) == nchar, nchar).otherwise(F.length(F.regexp_replace(n, r"[^\x00-\x7F]", "")))
        return let(F.regexp_extract_all(F.lower(n), F.lit("[A-Za-z]+"), 0), lambda toks: F.struct(
            F.size(toks).alias("ntok"), F.size(F.filter(toks, lambda t: t.isin(L.ENGLISH_STOPWORDS))).alias("stop"),
            nchar.alias("nchar"), ascii_n.alias("ascii")))

    def scored(m):
        ratio = m["ascii"] / F.greatest(F.lit(1), m["nchar"])
        conf = F.least(F.lit(0.92), 0.52 + m["stop"] / F.greatest(F.lit(1), m["ntok"]) * 1.6 + ratio * 0.18)
        conf = F.when((ratio >= 0.95) & (m["ntok"] >= 3), F.greatest(conf, F.lit(0.82))).otherwise(conf)
        unknown = (m["nchar"] == 0) | (m["ntok"] == 0)
        return F.struct(F.when(unknown, "unknown").otherwise("en").alias("code"),
                        F.when(unknown, 0.0).otherwise(conf).alias("confidence"))

    return let(let(norm, counted), scored)


UPPER_TOKEN = r"(?U)\b[A-Z]{2,5}\b"


def relevance_score(text=None, source=None, *, norm=None, nlow=None) -> Column:
    """TXT-05: keyword relevance in 0..1 (``norm``/``nlow``: prepared forms)."""
    raw = col(norm) if norm is not None else normalize_text(text, None)
    low = col(nlow) if nlow is not None else F.lower(raw)
    score = F.lit(0.16)
    for weight, kws in L.RELEVANCE_GROUPS:
        score = score + F.least(F.lit(weight), contains_count(low, kws) * (weight / 2))
    score = score + F.when(raw.rlike(UPPER_TOKEN), 0.05).otherwise(0.0)
    src = F.lower(F.coalesce(col(source), F.lit(""))) if source is not None else F.lit("")
    score = score + F.when(contains_count(src, L.TRUSTED_SOURCE_TOKENS) > 0, 0.05).otherwise(0.0)
    neg = contains_count(low, L.IRRELEVANT_TERMS)
    score = score - F.when(neg > 0, F.least(F.lit(0.30), neg * 0.10)).otherwise(0.0)
    score = score - F.when(F.length(low) < 80, 0.06).otherwise(0.0)
    return F.when(F.length(low) == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def relevance_label(score) -> Column:
    return F.when(col(score) >= L.RELEVANCE_THRESHOLD, "relevant").otherwise("irrelevant")


def _best_group(low: Column, groups, default=None) -> Column:
    """Name of the group with the most hits (ties: the earlier group); a
    sentinel entry with 0 hits and the highest order wins when nothing hits,
    so the result is one ``array_max`` referenced once."""
    items = [F.struct(contains_count(low, kws).alias("h"), F.lit(-i).alias("o"),
                      F.lit(name).alias("n")) for i, (name, kws) in enumerate(groups)]
    items.append(F.struct(F.lit(0).alias("h"), F.lit(1).alias("o"),
                          F.lit(default).cast("string").alias("n")))
    return F.array_max(F.array(*items))


def news_category(title="title", content="content", *, low=None) -> Column:
    """TXT-06: most keyword hits over the 8 news groups, ``general`` on none."""
    low = col(low) if low is not None else F.lower(article_text(title, content))
    return _best_group(low, L.NEWS_CATEGORY_KEYWORDS, "general")["n"]


def matched_event_type(category) -> Column:
    return F.when(col(category).isin(L.EVENT_TYPES), col(category))


def snippet(content="content", n: int = 220) -> Column:
    """TXT-06: whitespace-squeezed content cut at ``n`` chars (+ '...')."""
    s = squeeze(col(content))
    cut = F.regexp_replace(F.substring(s, 1, n), r"(?U)\s+$", "")
    return F.when(F.coalesce(F.length(col(content)), F.lit(0)) == 0, F.lit(None).cast("string")) \
        .otherwise(F.when(F.length(s) > n, F.concat(cut, F.lit("..."))).otherwise(cut))


def infer_event_type(text=None, *, low=None) -> Column:
    """TXT-07: struct(event_type, confidence); NULL type / 0.0 on no hit."""
    best = _best_group(col(low) if low is not None else F.lower(col(text)), L.EVENT_KEYWORDS)
    return let(best, lambda b: F.struct(b["n"].alias("event_type"), F.least(F.lit(0.92), 0.45 + b["h"] * 0.11).alias("_c"),
                                        b["h"].alias("_h"))).alias("_best")


def event_type_fields(s) -> list[Column]:
    """Expand an ``infer_event_type`` struct into (event_type, confidence)."""
    s = col(s)
    return [s["event_type"].alias("event_type"),
            F.when(s["_h"] > 0, s["_c"]).otherwise(F.lit(0.0)).alias("confidence")]


def sentiment(text=None, *, norm=None, nlow=None) -> Column:
    """TXT-08: lexicon sentiment in -1..1 (NULL on empty text, 0 on no hit)."""
    norm = col(norm) if norm is not None else normalize_text(text, None)
    low = col(nlow) if nlow is not None else F.lower(norm)
    hits = F.struct(contains_count(low, L.SENTIMENT_POSITIVE).alias("pos"), contains_count(low, L.SENTIMENT_NEGATIVE).alias("neg"))
    val = let(hits, lambda h: F.when((h["pos"] == 0) & (h["neg"] == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (h["pos"] - h["neg"]) / F.greatest(F.lit(1), h["pos"] + h["neg"])))))
    return F.when(F.length(norm) == 0, F.lit(None).cast("double")).otherwise(val)


def impact_signal(text=None, *, low=None) -> Column:
    """TXT-09: struct(polarity in -1..1, intensity in 0.35..1)."""
    low = col(low) if low is not None else F.lower(col(text))
    hits = F.struct(contains_count(low, L.NEGATIVE_IMPACT_TERMS).alias("neg"), contains_count(low, L.POSITIVE_IMPACT_TERMS).alias("pos"))
    total = lambda h: F.greatest(F.lit(1), h["neg"] + h["pos"])
    return let(hits, lambda h: F.struct(((h["pos"] - h["neg"]) / total(h)).alias("polarity"),
                                        F.least(F.lit(1.0), 0.35 + 0.15 * total(h)).alias("intensity")))


def _alias_pos(low: Column, alias: str, short: bool) -> Column:
    """1-based position of the alias (0 when absent); short aliases need word boundaries."""
    # The cheap byte search gates the position search (both are whole-text scans).
    if short:
        pos = F.regexp_instr(low, F.lit(r"(?U)\b" + re.escape(alias) + r"\b"))
    else:
        pos = F.instr(low, alias)
    return F.when(low.contains(alias), pos).otherwise(F.lit(0))


def extract_country(text=None, *, low=None) -> Column:
    """TXT-10: canonical country of the first alias (in list order) present."""
    low = col(low) if low is not None else F.lower(col(text))
    short = set(L.EVENT_SHORT_ALIASES)
    return F.coalesce(*[F.when(_alias_pos(low, a, a in short) > 0, F.lit(c))
                        for a, c in L.EVENT_COUNTRY_ALIASES])


def extract_countries(text=None, *, low=None) -> Column:
    """TXT-11: every country mentioned, in order of first position. A country's
    position is that of its first alias (in list order) found in the text."""
    low = col(low) if low is not None else F.lower(col(text))
    short = set(L.NEWS_SHORT_ALIASES)
    by_country: dict[str, list[tuple[int, str]]] = {}
    for i, (a, c) in enumerate(L.NEWS_COUNTRY_ALIASES):
        by_country.setdefault(c, []).append((i, a))
    items = []
    for c, aliases in by_country.items():
        cands = [(i, _alias_pos(low, a, a in short)) for i, a in aliases]
        pos = F.coalesce(*[F.when(p > 0, p) for _, p in cands])
        idx = F.coalesce(*[F.when(p > 0, F.lit(i)) for i, p in cands])
        items.append(F.struct(pos.alias("p"), idx.alias("i"), F.lit(c).alias("c")))
    found = F.filter(F.array(*items), lambda s: s["p"].isNotNull())
    return F.transform(F.array_sort(found), lambda s: s["c"])


def source_score(source) -> Column:
    """TXT-13: credibility of the first contained key; 0.70 default, 0.68 when empty."""
    low = F.lower(col(source))
    chain = F.coalesce(*[F.when(F.instr(low, k) > 0, F.lit(v)) for k, v in L.SOURCE_CREDIBILITY],
                       F.lit(0.70))
    return F.when(col(source).isNull() | (col(source) == ""), F.lit(0.68)).otherwise(chain)


def recency_score(ts, as_of) -> Column:
    """TXT-14: step function of the age at ``as_of`` (0.65 when unknown)."""
    age = seconds_between(ts_lit(as_of) if not isinstance(as_of, Column) else as_of, col(ts))
    return (F.when(col(ts).isNull(), 0.65).when(age <= 2 * 3600, 0.95).when(age <= 12 * 3600, 0.88)
            .when(age <= 86400, 0.80).when(age <= 3 * 86400, 0.70).when(age <= 7 * 86400, 0.62)
            .otherwise(0.52))


def market_context(text, n_tickers, *, low=None, hits=None) -> Column:
    """TXT-15: 0.42 + 0.07 per market term + 0.2 per ticker (capped at 1).
    ``hits``: the number of market terms when already counted."""
    hits = col(hits) if hits is not None else contains_count(col(low) if low is not None else F.lower(col(text)), L.MARKET_CONTEXT_TERMS)
    n = col(n_tickers) if not isinstance(n_tickers, int) else F.lit(n_tickers)
    return F.least(F.lit(1.0), 0.42 + hits * 0.07 + F.least(F.lit(1.0), n * 0.2))


def normalize_entity(c) -> Column:
    """TXT-16: lower-case, non-alphanumeric runs -> one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", " "))


def sim_tokens(c) -> Column:
    """TXT-17: ``[a-z0-9]{3,}`` tokens minus stopwords (duplicates kept)."""
    toks = F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]{3,}"), 0)
    return F.filter(toks, lambda t: ~t.isin(L.SIMILARITY_STOPWORDS))


def sentiment_label(c, threshold: float = 1.0,
                    names: Sequence[str] = ("negative", "neutral", "positive")) -> Column:
    """TXT-18: <= -t -> names[0], >= t -> names[2], else names[1]; NULL stays NULL."""
    x = col(c)
    return (F.when(x.isNull(), F.lit(None).cast("string")).when(x <= -threshold, names[0])
            .when(x >= threshold, names[2]).otherwise(names[1]))


def news_severity(category, title="title", content="content", *, low=None) -> Column:
    """TXT-20: category base + intensity lifts, capped at 5."""
    low = col(low) if low is not None else F.lower(article_text(title, content))
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.NEWS_CATEGORY_SEVERITY.items()
                                                  for x in kv]), col(category)),
                      F.lit(L.NEWS_CATEGORY_SEVERITY["general"]))
    lift = sum(F.when(contains_count(low, terms) > 0, w).otherwise(0.0)
               for terms, w in L.NEWS_SEVERITY_TERMS)
    return F.least(F.lit(5.0), base + lift)


def url_host(c) -> Column:
    """TXT-21: network location of a URL (host[:port]), lower-cased; NULL if none."""
    h = F.lower(F.regexp_extract(col(c), r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))
    return F.when(h == "", F.lit(None).cast("string")).otherwise(h)


def is_reuters(*cols) -> Column:
    """FLT-04: 'reuters' (or the Reuters wire path) in the URL or actor fields."""
    conds = []
    for c in cols:
        low = F.lower(F.coalesce(col(c), F.lit("")))
        conds.append((F.instr(low, "reuters") > 0) | (F.instr(low, "/ultime-notizie-reuters/") > 0))
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def parse_enum(c, values: Sequence[str]) -> Column:
    """FLT-11: case/hyphen/space-insensitive enum parse; unknown -> NULL."""
    norm = F.lower(F.regexp_replace(F.trim(col(c)), "[- ]", "_"))
    return F.when(norm.isin(list(values)), norm)


# ---------------------------------------------------------------------------
# TXT-19 symbol normalisation and provider routing
# ---------------------------------------------------------------------------
# TwelveData interval names
TWELVEDATA_INTERVALS = {"1m": "1min", "5m": "5min", "15m": "15min", "30m": "30min", "1h": "1hour",
                        "2h": "2hours", "4h": "4hours", "1d": "1day", "1w": "1week", "1mo": "1month",
                        "1M": "1month"}


def forex_symbol(c) -> Column:
    """Six-letter forex ticker -> AAA/BBB (others unchanged)."""
    t = col(c)
    return F.when(F.length(t) == 6, F.concat(F.substring(t, 1, 3), F.lit("/"), F.substring(t, 4, 3))).otherwise(t)


def crypto_symbol(c) -> Column:
    """Crypto ticker -> exchange pair: upper, '-' and '/' removed, trailing USD dropped, + USDT."""
    t = F.regexp_replace(F.upper(col(c)), "[-/]", "")
    t = F.when(t.endswith("USD"), F.substring(t, F.lit(1), F.length(t) - 3)).otherwise(t)
    return F.concat(t, F.lit("USDT"))


def twelve_symbol(c, asset_type) -> Column:
    """Forex AAA/BBB or crypto XXX/USD notation for the time-series provider."""
    n = F.regexp_replace(F.upper(col(c)), "/", "")
    at = col(asset_type)
    return (F.when((at == "forex") & (F.length(n) == 6) & n.rlike("^[A-Z]+$"),
                   F.concat(F.substring(n, 1, 3), F.lit("/"), F.substring(n, 4, 3)))
            .when((at == "crypto") & (F.length(n) <= 5) & n.rlike("^[A-Z0-9]+$"), F.concat(n, F.lit("/USD")))
            .otherwise(F.upper(col(c))))


def provider_symbol(c, provider: str) -> Column:
    """Per-provider spelling: binance '-USD' -> 'USDT', polygon class shares '.' -> '-'."""
    if provider == "binance":
        return F.replace(col(c), F.lit("-USD"), F.lit("USDT"))
    if provider == "polygon":
        return F.replace(col(c), F.lit("."), F.lit("-"))
    return col(c)


def route_provider(c) -> Column:
    """Symbols ending in USDT/BUSD go to the crypto exchange, others to the equity provider."""
    u = F.upper(col(c))
    return F.when(u.endswith("USDT") | u.endswith("BUSD"), "binance").otherwise("polygon")


def provider_interval(interval: str, provider: str) -> str:
    """Interval name for a provider (TwelveData spells them out)."""
    return TWELVEDATA_INTERVALS.get(interval, interval) if provider.lower() == "twelvedata" else interval
