"""Event-to-asset mapping in four layers (MAP-01..07).

Every layer is an equi-join: phrase matching sifts document n-grams by bitmaps
of the aliases and joins what is left, the graph spread is two self-joins of
the edge list, sector spread joins on sector, and similarity joins tokens of
the same event type. No cross joins, no per-document loops, no broadcast
hints: the planner decides by bytes.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.functions.phrases import PhraseFilter, let
from eventlens.session import cut_lineage


# ---------------------------------------------------------------------------
# MAP-01 aliases
# ---------------------------------------------------------------------------

def _is_upper(c: Column) -> Column:
    """Python ``str.isupper``: has a cased character and none in lower case."""
    return (c == F.upper(c)) & (c != F.lower(c))


def asset_aliases(assets: DataFrame) -> DataFrame:
    """MAP-01: alias -> ticker. Aliases are the upper-case ticker, the
    normalised name, the name without legal suffixes and its first 2 and 3
    words; one-word aliases shorter than 5 characters or generic are dropped.
    An alias claimed by several tickers is dropped, except ticker aliases,
    which resolve to the smallest ticker. Columns: alias, ticker, is_ticker,
    n_tokens."""
    name = T.normalize_entity(F.coalesce(F.col("name"), F.lit("")))
    a = assets.select(F.upper("ticker").alias("ticker"), name.alias("_n"))
    toks = F.filter(F.split("_n", " "), lambda t: t != "")
    stripped = F.filter(toks, lambda t: ~t.isin(L.ASSET_SUFFIX_TOKENS))
    cands = F.array(F.col("_n"), F.array_join(stripped, " "),
                    F.when(F.size(stripped) >= 2, F.array_join(F.slice(stripped, 1, 2), " ")),
                    F.when(F.size(stripped) >= 3, F.array_join(F.slice(stripped, 1, 3), " ")))
    names = (a.where(F.col("_n") != "")
             .select("ticker", F.explode(cands).alias("alias"))
             .select("ticker", F.trim("alias").alias("alias"))
             .where(F.col("alias").isNotNull() & (F.col("alias") != "")))
    one_word = F.size(F.split("alias", " ")) == 1
    names = names.where(~(one_word & ((F.length("alias") < 5)
                                      | F.col("alias").isin(L.GENERIC_SINGLE_TOKEN_ALIASES))))
    allc = names.unionByName(a.select("ticker", F.col("ticker").alias("alias"))).distinct()
    g = allc.groupBy("alias").agg(F.min("ticker").alias("ticker"),
                                  F.count_distinct("ticker").alias("_n"))
    up = _is_upper(F.col("alias"))
    return (g.where(up | (F.col("_n") == 1))
            .select("alias", "ticker", up.alias("is_ticker"),
                    F.size(F.split("alias", " ")).alias("n_tokens")))


# ---------------------------------------------------------------------------
# MAP-02 direct mentions
# ---------------------------------------------------------------------------

TICKER_TOKEN = r"(?U)\b[A-Z][A-Z0-9]{0,9}\b"


@dataclass(frozen=True)
class AliasIndex:
    """An alias table (written once: is_ticker, alias, ticker) with the bitmaps of its tickers and phrases."""
    entries: DataFrame
    known_tickers: PhraseFilter
    known_phrases: PhraseFilter

    @classmethod
    def of(cls, aliases: DataFrame) -> "AliasIndex":
        entries = cut_lineage(aliases.where(F.col("is_ticker").isNotNull()).select(F.col("is_ticker").alias("_is_ticker"), F.col("alias").alias("_alias"), "ticker"))
        return cls(entries, PhraseFilter.of(entries.where("_is_ticker").select(F.array("_alias").alias("words"))),
                   PhraseFilter.of(entries.where("not _is_ticker").select(F.split("_alias", " ").alias("words"))))

    def candidates(self, text: Column, norm: Column | None = None) -> Column:
        """struct(toks, grams): the ticker-shaped tokens and the n-grams of the
        normalised text that may be aliases, each once. ``norm``: the
        normalised text when already prepared."""
        body = F.coalesce(text, F.lit(""))
        toks = F.filter(F.array_distinct(F.regexp_extract_all(F.upper(body), F.lit(TICKER_TOKEN), 0)), self.known_tickers.may_be)
        words = F.filter(F.split(T.normalize_entity(body) if norm is None else norm, " "), lambda t: t != "")
        grams = let(words, lambda w: F.array_distinct(F.transform(self.known_phrases.grams(w), lambda g: g["gram"])))
        return F.struct(toks.alias("toks"), grams.alias("grams"))

    def mentions(self, rows: DataFrame, key: str, candidates: str) -> DataFrame:
        """(key, ticker) of the candidates that are aliases. Both kinds leave a
        row together, so what the candidates are read from is read once; the
        outer explode keeps the optimizer from testing an array's size first,
        which would find the candidates of a row twice."""
        kind = lambda name, is_ticker: F.transform(f"{candidates}.{name}", lambda x: F.struct(F.lit(is_ticker).alias("_is_ticker"), x.alias("_alias")))
        found = rows.select(key, F.explode_outer(F.concat(kind("toks", True), kind("grams", False))).alias("_c"))
        return found.select(key, "_c.*").join(self.entries, ["_is_ticker", "_alias"]).select(key, "ticker").distinct()


def extract_mentions(docs: DataFrame, aliases: DataFrame, *, key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """MAP-02: (key, ticker) for every ticker-shaped token that is a ticker and
    every alias phrase present as whole words in the normalised text.

    A phrase ``a`` occurs in ``" " + normalised + " "`` exactly when it equals
    an n-gram of the normalised tokens. N-grams and ticker tokens are sifted
    inside the row by bitmaps of the aliases (``PhraseFilter``); only what may
    be an alias leaves the row and is joined to the alias table by equality.
    The texts are read once, however often the mentions are used: they are
    checkpointed.
    """
    index = AliasIndex.of(aliases)
    return cut_lineage(index.mentions(docs.select(key, index.candidates(F.col(text)).alias("_cand")), key, "_cand"))


# ---------------------------------------------------------------------------
# MAP-03 entity tags
# ---------------------------------------------------------------------------

def text_tags(text: Column | None = None, *, norm: Column | None = None) -> Column:
    """MAP-03, the part read from the text: countries named in it (whole
    words) and topic tags (substrings of the normalised text). ``norm``: the
    normalised text when already prepared."""
    def tags(norm, padded):
        named = lambda aliases: F.greatest(*[padded.contains(" " + _norm_alias(a) + " ") for a in aliases], F.lit(False))
        ctags = [F.when(named(aliases), F.lit(country)) for country, aliases in L.TAG_COUNTRY_TERMS]
        ttags = [F.when(F.greatest(*[norm.contains(k) for k in kws], F.lit(False)), F.lit(tag)) for tag, kws in L.TOPIC_TAGS]
        return F.array_compact(F.array(*ctags, *ttags))

    norm = T.normalize_entity(F.coalesce(text, F.lit(""))) if norm is None else norm
    return let(norm, lambda n: let(F.concat(F.lit(" "), n, F.lit(" ")), lambda padded: tags(n, padded)))


def merge_tags(own: DataFrame, mentions: DataFrame, assets: DataFrame, *, key: str = "doc_id",
               most: int | None = L.MAX_TAGS) -> DataFrame:
    """MAP-03: (key, tags) — the text's tags (``own``: key, text_tags) with
    ticker, first three name words capitalised, sector and country of every
    mention; sorted, first 12 (``most`` None: all)."""
    a = assets.select(
        F.upper("ticker").alias("ticker"),
        F.initcap(F.array_join(F.slice(F.split(T.normalize_entity(F.coalesce(F.col("name"), F.lit(""))), " "),
                                       1, 3), " ")).alias("_label"),
        "sector", "country")
    per = (mentions.select(key, F.upper("ticker").alias("ticker")).join(a, "ticker")
           .select(key, F.array_compact(F.array("ticker", F.when(F.col("_label") != "", F.col("_label")),
                                                "sector", "country")).alias("_t")))
    mtags = per.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_mt"))
    allt = F.array_union(F.col("text_tags"), F.coalesce(F.col("_mt"), F.array().cast("array<string>")))
    tags = F.array_sort(F.filter(allt, lambda x: x != ""))
    return own.join(mtags, key, "left").select(key, (tags if most is None else F.slice(tags, 1, most)).alias("tags"))


def entity_tags(docs: DataFrame, mentions: DataFrame, assets: DataFrame, *,
                key: str = "doc_id", text: str = "text") -> DataFrame:
    """MAP-03: ``merge_tags`` of the tags in each row's text."""
    return merge_tags(docs.select(key, text_tags(F.col(text)).alias("text_tags")), mentions, assets, key=key)


def _norm_alias(a: str) -> str:
    import re
    return re.sub(r"[^a-z0-9]+", " ", a.lower()).strip()


#: Words of the longest term that ``text_tags`` looks for.
TAG_WORDS = max(len(w.split()) for w in [*(_norm_alias(a) for _, aliases in L.TAG_COUNTRY_TERMS for a in aliases),
                                         *(k for _, kws in L.TOPIC_TAGS for k in kws)])


# ---------------------------------------------------------------------------
# MAP-04 knowledge-graph spread
# ---------------------------------------------------------------------------

def directed_edges(edges: DataFrame) -> DataFrame:
    """Adjacency as rows (src, dst, w): every supported edge forward with
    strength (0 or NULL -> 0.5), the symmetric kinds also backwards at 0.9x."""
    e = (edges.where(F.col("relationship").isin(L.KG_RELATIONSHIPS))
         .select(F.col("source_key").alias("src"), F.col("target_key").alias("dst"), "relationship",
                 F.coalesce(F.when(F.col("strength") != 0, F.col("strength")),
                            F.lit(L.KG_DEFAULT_STRENGTH)).alias("w")))
    back = (e.where(F.col("relationship").isin(L.KG_BIDIRECTIONAL))
            .select(F.col("dst").alias("src"), F.col("src").alias("dst"), "relationship",
                    (F.col("w") * L.KG_REVERSE_FACTOR).alias("w")))
    return e.unionByName(back).select("src", "dst", "w")


def expand_graph(mentions: DataFrame, edges: DataFrame, *, key: str = "doc_id",
                 asset_prefix: str = "ASSET:") -> DataFrame:
    """MAP-04: (key, ticker, score) two hops out from the mentioned assets:
    hop 1 scores ``w * 0.60``, hop 2 ``w1 * w2 * 0.35``, max over paths;
    mentioned assets are excluded. Hop-1 paths are reduced to the best weight
    per (key, node) before the second hop (max distributes over the product),
    so hub nodes do not multiply rows."""
    adj = directed_edges(edges)
    roots = mentions.select(key, F.upper("ticker").alias("ticker")).distinct()
    r = roots.select(key, F.concat(F.lit(asset_prefix), F.col("ticker")).alias("src"))
    h1 = r.join(adj, "src").groupBy(key, F.col("dst").alias("n1")).agg(F.max("w").alias("w1"))
    s1 = h1.select(key, F.col("n1").alias("node"), (F.col("w1") * L.L2_HOP1_WEIGHT).alias("score"))
    h2 = (h1.join(adj.withColumnRenamed("src", "n1"), "n1")
          .select(key, F.col("dst").alias("node"), (F.col("w1") * F.col("w") * L.L2_HOP2_WEIGHT).alias("score")))
    cand = (s1.unionByName(h2).where(F.col("node").startswith(asset_prefix))
            .select(key, F.substring("node", len(asset_prefix) + 1, 1 << 20).alias("ticker"), "score"))
    best = cand.groupBy(key, "ticker").agg(F.max("score").alias("score"))
    return best.join(roots, [key, "ticker"], "left_anti")


# ---------------------------------------------------------------------------
# MAP-05 sector spread
# ---------------------------------------------------------------------------

def sector_members(assets: DataFrame, cap: int = L.L3_MAX_ASSETS_PER_SECTOR,
                   order: str = "asset_id") -> DataFrame:
    """First ``cap`` members of each sector in asset order (top-k per sector)."""
    w = Window.partitionBy("sector").orderBy(order)
    return (assets.where(F.col("sector").isNotNull())
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap)
            .select("sector", F.upper("ticker").alias("ticker")))


def expand_sector(mentions: DataFrame, assets: DataFrame, relevance: DataFrame, *,
                  key: str = "doc_id") -> DataFrame:
    """MAP-05: (key, ticker, score) — the first 6 members of every mentioned
    asset's sector (capped before excluding the mentioned ones), score
    ``min(1, 0.45 * clamp(relevance, 0.25, 1))``. ``relevance``: (key, relevance)."""
    a = assets.select(F.upper("ticker").alias("ticker"), "sector")
    roots = mentions.select(key, F.upper("ticker").alias("ticker")).distinct()
    secs = roots.join(a, "ticker").where(F.col("sector").isNotNull()).select(key, "sector").distinct()
    mem = sector_members(assets)
    rel = F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.col("relevance")))
    cand = (secs.join(mem, "sector").join(relevance.select(key, "relevance"), key)
            .select(key, "ticker", F.least(F.lit(1.0), L.L3_BASE_WEIGHT * rel).alias("score")))
    best = cand.groupBy(key, "ticker").agg(F.max("score").alias("score"))
    return best.join(roots, [key, "ticker"], "left_anti")


# ---------------------------------------------------------------------------
# MAP-06 similarity spread
# ---------------------------------------------------------------------------

def tf_vectors(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, token, weight): L2-normalised term counts of the similarity tokens."""
    # Outer: the size test that the optimizer derives from a plain explode would cut the text twice.
    toks = df.select(key, F.explode_outer(T.sim_tokens(text)).alias("token")).where(F.col("token").isNotNull())
    cnt = toks.groupBy(key, "token").agg(F.count(F.lit(1)).cast("double").alias("c"))
    norm = cnt.groupBy(key).agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("_n"))
    return cnt.join(norm, key).select(key, "token", (F.col("c") / F.col("_n")).alias("weight"))


def recent_published(events: DataFrame, n: int | None = L.L4_LOOKBACK_EVENTS) -> DataFrame:
    """The last ``n`` published events: newest published first, NULLs last,
    then newest created (None: all of them)."""
    published = events.where(F.col("status").isin(L.PUBLISHED_STATUSES))
    if n is None:
        return published
    return (published.orderBy(F.col("published_at").desc_nulls_last(), F.col("created_at").desc(), F.col("event_id").desc()).limit(n))


def similarity_corpus(events: DataFrame, impacts: DataFrame, assets: DataFrame,
                      lookback: int | None = L.L4_LOOKBACK_EVENTS) -> tuple[DataFrame, DataFrame]:
    """The last ``lookback`` approved events that have impacts: (vectors, asset
    priors). None: all of them, events of the same type and tokens as one, under
    the smallest id and with the largest priors (a score is a largest product)."""
    recent = recent_published(events, lookback).select(
        F.col("event_id").alias("c_event"), F.col("event_type").alias("c_type"), "title", "description")
    a = assets.select("asset_id", F.upper("ticker").alias("ticker"))
    prior = (impacts.join(a, "asset_id")
             .select(F.col("event_id").alias("c_event"), "ticker",
                     F.coalesce(F.when(F.col("confidence_score") != 0, F.col("confidence_score")),
                                F.lit(L.L4_DEFAULT_PRIOR)).alias("prior"))
             .join(recent.select("c_event"), "c_event", "left_semi")
             .groupBy("c_event", "ticker").agg(F.max("prior").alias("prior")))
    text = F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("description", F.lit("")))
    if lookback is None:
        same = cut_lineage(_same_tokens(recent.join(prior.select("c_event").distinct(), "c_event", "left_semi"), text))
        prior = (prior.join(same, "c_event").groupBy("_class", "ticker").agg(F.max("prior").alias("prior"))
                 .withColumnRenamed("_class", "c_event"))
        recent = recent.join(same.select(F.col("_class").alias("c_event")).distinct(), "c_event", "left_semi")
    vec = (tf_vectors(recent.join(prior.select("c_event").distinct(), "c_event", "left_semi"),
                      "c_event", text)
           .join(recent.select("c_event", "c_type"), "c_event"))
    return vec, prior


def _same_tokens(events: DataFrame, text: Column) -> DataFrame:
    """(c_event, _class): the smallest id among the events of the same type and tokens."""
    sign = F.sha2(F.to_json(F.struct("c_type", F.sort_array(T.sim_tokens(text)).alias("toks"))), 256)
    each = events.select("c_event", sign.alias("_s")).groupBy("c_event").agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    return (each.join(each.groupBy("_s").agg(F.min("c_event").alias("_class")), "_s").select("c_event", "_class"))


def _leading_priors(prior: DataFrame, direct: DataFrame, key: str) -> DataFrame:
    """The priors that can reach a document's top: within a corpus event's
    ranking a document leaves out no more than its direct assets, so what comes
    after as many more is behind enough others with at least the same score."""
    own = direct.groupBy(key).agg(F.count_distinct(F.upper("ticker")).alias("n"))
    most = own.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0] + L.L4_MAX_ASSET_CANDIDATES
    w = Window.partitionBy("c_event").orderBy(F.col("prior").desc(), F.col("ticker"))
    return prior.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).drop("_rn")


def _all_sharing(dv: DataFrame, vec: DataFrame, key: str) -> DataFrame:
    """(key, c_event, sim) of all pairs that share a token of the same type."""
    return (dv.join(vec.withColumnRenamed("weight", "cw"), ["c_type", "token"])
            .groupBy(key, "c_event").agg(F.sum(F.col("weight") * F.col("cw")).alias("sim")))


def _prefix_pairs(dv: DataFrame, vec: DataFrame, key: str, least: float) -> DataFrame:
    """(key, c_event, sim) of the pairs with cosine >= ``least``, and few others.

    Tokens are ordered from the corpus's rarest to its most frequent. A
    vector's prefix ends where the norm of what follows falls below ``least``;
    two vectors whose prefixes share no token have all their common tokens in
    the rest of one of them, so their dot product is below that norm. Only
    prefix tokens meet, and the whole vectors of the pairs found."""
    seen = vec.groupBy("c_type", "token").agg(F.count(F.lit(1)).alias("df"))

    def prefix(v: DataFrame, by: str) -> DataFrame:
        after = Window.partitionBy(by).orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
        rest = F.sum(F.col("weight") * F.col("weight")).over(after)
        return (v.join(seen, ["c_type", "token"]).withColumn("_rest", rest)
                .where(F.col("_rest") >= least * least - 1e-9).select(by, "c_type", "token"))

    pairs = (prefix(dv, key).join(prefix(vec, "c_event"), ["c_type", "token"]).select(key, "c_event").distinct())
    return (pairs.join(dv.select(key, "token", "weight"), key)
            .join(vec.select("c_event", "token", F.col("weight").alias("cw")), ["c_event", "token"])
            .groupBy(key, "c_event").agg(F.sum(F.col("weight") * F.col("cw")).alias("sim")))


def expand_similar(docs: DataFrame, corpus: tuple[DataFrame, DataFrame], direct: DataFrame, *,
                   key: str = "doc_id", text: str = "text", event_type: str = "event_type",
                   prefix_filter: bool = False) -> DataFrame:
    """MAP-06: (key, ticker, score) — cosine of the document's TF vector with
    every corpus event of the same type; at >= 0.38 each prior asset scores
    ``sim * prior``; max per asset, direct assets excluded, top 5 per document.
    The dot product is an equi-join on (event type, token) and a grouped sum.
    That suits the bounded corpus of the newest events; for a corpus of all
    events ``prefix_filter`` joins rare tokens only, with the same result."""
    vec, prior = corpus
    # ``docs`` may hold several rows per key (e.g. the articles of one event):
    # their token counts add up, which is the vector of the joined text.
    dv = tf_vectors(docs, key, F.col(text)).join(docs.select(key, F.col(event_type).alias("c_type")).distinct(), key)
    if prefix_filter:
        dv, vec, direct = cut_lineage(dv), cut_lineage(vec), cut_lineage(direct)
        prior = _leading_priors(prior, direct, key)
        found = _prefix_pairs(dv, vec, key, L.L4_MIN_SIMILARITY)
    else:
        found = _all_sharing(dv, vec, key)
    sim = (found.withColumn("sim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("sim"))))
           .where(F.col("sim") >= L.L4_MIN_SIMILARITY))
    cand = (sim.join(prior, "c_event")
            .select(key, "ticker", (F.col("sim") * F.col("prior")).alias("score"))
            .join(direct.select(key, F.upper("ticker").alias("ticker")), [key, "ticker"], "left_anti")
            .groupBy(key, "ticker").agg(F.max("score").alias("score")))
    w = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("ticker"))
    return (cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= L.L4_MAX_ASSET_CANDIDATES)
            .select(key, "ticker", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score")))


# ---------------------------------------------------------------------------
# MAP-07 impact assembly
# ---------------------------------------------------------------------------

def assemble_impacts(layers: dict[int, DataFrame], params: DataFrame, assets: DataFrame,
                     existing: DataFrame | None = None, *, key: str = "doc_id") -> DataFrame:
    """MAP-07: one impact per (key, asset), the lowest layer wins.

    ``layers``: {1: (key, ticker), 2..4: (key, ticker, score)}; ``params``:
    (key, confidence, relevance, impact_strength, impact_direction). Layer 1
    impacts take the article strength and ``(conf + rel) / 2``; derived layers
    take ``score`` and ``(conf + rel) / 2 * score``, all clamped to 0..1.
    Tickers that are not assets are skipped; pairs in ``existing`` are kept.
    """
    rows = []
    for layer, df in sorted(layers.items()):
        sc = F.col("score") if layer > 1 else F.lit(None).cast("double")
        rows.append(df.select(key, F.upper("ticker").alias("ticker"), sc.alias("score"),
                              F.lit(layer).alias("layer")))
    u = rows[0]
    for r in rows[1:]:
        u = u.unionByName(r)
    first = (u.groupBy(key, "ticker")
             .agg(F.min_by(F.struct("layer", "score"), "layer").alias("_f"))
             .select(key, "ticker", "_f.layer", "_f.score"))
    a = assets.select("asset_id", F.upper("ticker").alias("ticker"))
    base = (F.col("confidence") + F.col("relevance")) / 2
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = (first.join(a, "ticker").join(params, key)
           .select(key, "asset_id", "ticker", "layer", "impact_direction",
                   clamp(F.when(F.col("layer") == 1, F.col("impact_strength")).otherwise(F.col("score")))
                   .alias("impact_strength"),
                   clamp(F.when(F.col("layer") == 1, base).otherwise(base * F.col("score")))
                   .alias("confidence_score")))
    if existing is not None:
        out = out.join(existing.select(key, "asset_id"), [key, "asset_id"], "left_anti")
    return out
