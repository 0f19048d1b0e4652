"""Article -> event building: scores, gates, merge, backfills, event cards
(EVT-01..07, QG-01).

The reference walks articles one at a time; here one lazy plan annotates all
articles, maps them to assets (``operators.mapping``), applies the gates and
merges them into events keyed by (title, type, country, day) with grouped
aggregates. The row loop's "later article updates the event when its
confidence is higher" becomes a max-by over the group.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.functions.common import col, contains_count, seconds_between, ts_lit
from eventlens.operators import filters as FL
from eventlens.operators import mapping as MP
from eventlens.session import cut_lineage


def clamp(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


# ---------------------------------------------------------------------------
# EVT-01 / EVT-02 / EVT-03 scoring expressions
# ---------------------------------------------------------------------------

def confidence_expr(base, source, published_at, low, n_tickers, as_of, market_hits=None) -> Column:
    """EVT-01: 0.46 base + 0.20 source + 0.16 recency + 0.18 market context,
    + 0.02 per asset (max 3), clamped to 0..0.95."""
    n = col(n_tickers)
    blended = (0.46 * col(base) + 0.20 * T.source_score(source) + 0.16 * T.recency_score(published_at, as_of)
               + 0.18 * T.market_context(None, n, low=low, hits=market_hits))
    return clamp(blended + 0.02 * F.least(F.lit(3), n), 0.0, 0.95)


def status_expr(conf) -> Column:
    c = col(conf)
    return (F.when(c >= L.AUTO_APPROVE_THRESHOLD, "auto_approved")
            .when(c >= L.HUMAN_REVIEW_THRESHOLD, "pending_review").otherwise("rejected"))


def score_confidence(df: DataFrame, as_of, *, base="base_confidence", source="source",
                     published_at="published_at", low="_t_low", n_tickers="n_tickers", market_hits=None) -> DataFrame:
    """EVT-01 on a frame: ``confidence`` and ``status`` columns."""
    return (df.withColumn("confidence", confidence_expr(base, source, published_at, low, n_tickers, as_of, market_hits))
            .withColumn("status", status_expr("confidence")))


def severity_expr(event_type, low, conf, n_tickers, hits=None) -> Column:
    """EVT-02: type bias + min(2, high-impact hits // 2) + confidence and
    multi-asset lifts, clamped to 1..5. ``hits``: the number of high-impact
    terms when already counted."""
    hits = col(hits) if hits is not None else contains_count(col(low), L.HIGH_IMPACT_TERMS)
    bias = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in L.SEVERITY_TYPE_BIAS.items()
                                                  for x in kv]), col(event_type)), F.lit(3))
    score = (bias + F.least(F.lit(2), F.floor(hits / 2).cast("int"))
             + (col(conf) >= 0.80).cast("int") + (col(n_tickers) >= 3).cast("int"))
    return F.greatest(F.lit(1), F.least(F.lit(5), score)).cast("int")


def direction_expr(event_type, polarity) -> Column:
    """EVT-03: impact direction from the event type and text polarity."""
    t, p = col(event_type), col(polarity)
    neg_type = t.isin(L.NEGATIVE_TYPES)
    return (F.when(neg_type & (p < 0.35), "negative")
            .when(t.isin(L.SIGNED_TYPES) & (p >= 0.20), "positive")
            .when(t.isin(L.SIGNED_TYPES) & (p <= -0.20), "negative")
            .when((t == "election") & (F.abs(p) >= 0.35), F.when(p > 0, "positive").otherwise("negative"))
            .when(neg_type, "negative").otherwise("neutral"))


def base_direction(event_type) -> Column:
    return F.when(col(event_type).isin(L.NEGATIVE_TYPES), "negative").otherwise("neutral")


def strength_expr(conf, intensity) -> Column:
    return clamp(0.55 * col(conf) + 0.45 * col(intensity))


# ---------------------------------------------------------------------------
# QG-01 quality gates
# ---------------------------------------------------------------------------

def _blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def quality_gates(df: DataFrame, assets: DataFrame, proposed: DataFrame | None = None,
                  events: DataFrame | None = None, links: DataFrame | None = None, *,
                  key: str = "article_id", event_time: str = "event_time",
                  article_time: str = "published_at") -> DataFrame:
    """QG-01: ``errors`` array per row — confidence_threshold,
    schema_validation, temporal_consistency (|event time - article time| >
    48 h), asset_validation (a proposed ticker is not an asset) and
    duplicate_detection (the article is already linked to an event of the
    same type, country (NULL equals NULL) and day)."""
    out = df
    if proposed is not None:
        known = assets.select(F.upper("ticker").alias("ticker")).distinct()
        bad = (proposed.select(key, F.upper("ticker").alias("ticker"))
               .join(known, "ticker", "left_anti").select(key).distinct()
               .withColumn("_bad_asset", F.lit(True)))
        out = out.join(bad, key, "left")
    else:
        out = out.withColumn("_bad_asset", F.lit(None).cast("boolean"))
    if events is not None and links is not None:
        ev = events.select(F.col("event_id").alias("_eid"), F.col("event_type").alias("_et"),
                           F.col("country").alias("_ec"), F.to_date("published_at").alias("_ed"))
        lk = links.select(F.col("event_id").alias("_eid"), F.col(key).alias("_aid"))
        linked = lk.join(ev, "_eid")
        probe = out.select(key, "event_type", "country", F.to_date(event_time).alias("_d"))
        dup = (probe.join(linked, (probe[key] == linked["_aid"]) & (probe["event_type"] == linked["_et"])
                          & probe["country"].eqNullSafe(linked["_ec"]) & (probe["_d"] == linked["_ed"]))
               .select(key).distinct().withColumn("_dup", F.lit(True)))
        out = out.join(dup, key, "left")
    else:
        out = out.withColumn("_dup", F.lit(None).cast("boolean"))
    delta = F.abs(seconds_between(F.col(event_time), F.col(article_time)))
    errors = F.array_compact(F.array(
        F.when(F.col("confidence") < L.QUALITY_MIN_CONFIDENCE, F.lit("confidence_threshold")),
        F.when(_blank(F.col("title")) | F.col("event_type").isNull() | _blank(F.col("source"))
               | _blank(F.col("url")), F.lit("schema_validation")),
        F.when(F.col(article_time).isNotNull() & (delta > L.QUALITY_TEMPORAL_MAX_HOURS * 3600),
               F.lit("temporal_consistency")),
        F.when(F.coalesce(F.col("_bad_asset"), F.lit(False)), F.lit("asset_validation")),
        F.when(F.coalesce(F.col("_dup"), F.lit(False)), F.lit("duplicate_detection"))))
    return out.withColumn("errors", errors).drop("_bad_asset", "_dup")


def gate_counts(gated: DataFrame) -> DataFrame:
    """QG-01 counts: rows failing each gate code."""
    return (gated.select(F.explode("errors").alias("code"))
            .groupBy("code").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------------------
# EVT-04 build events
# ---------------------------------------------------------------------------

def annotate(articles: DataFrame, as_of, aliases: MP.AliasIndex) -> DataFrame:
    """All that the event build reads from an article's text, row by row: NLP
    columns, the first gate it fails, and for articles that pass these gates
    term counts, impact signal, country, text tags and alias candidates. The
    text itself is not kept."""
    a = articles.withColumn("_text", T.article_text("title", "content"))
    a = T.prepare_text(a, F.col("_text")).withColumn("_entity", T.normalize_entity("_text"))
    a = (a.withColumn("_lang", T.language_score(norm="_t_norm"))
         .withColumn("relevance_score", T.relevance_score(norm="_t_norm", nlow="_t_nlow", source="source"))
         .withColumn("_et", T.infer_event_type(low="_t_low")))
    lang_ok = F.col("_lang.code").isin(L.ALLOWED_LANGUAGES) & (F.col("_lang.confidence") >= L.MIN_LANGUAGE_CONFIDENCE)
    reason = (F.when(~lang_ok, "language").when(F.col("relevance_score") < L.RELEVANCE_THRESHOLD, "relevance")
              .when(F.col("_et.event_type").isNull(), "no_event_type"))
    a = a.withColumn("_reject", reason)
    passed = lambda c: F.when(F.col("_reject").isNull(), c)
    return a.select(
        "article_id", "title", "source", "url", "published_at", "created_at",
        F.col("_lang.code").alias("language_code"), F.col("_lang.confidence").alias("language_confidence"),
        "relevance_score", T.relevance_label("relevance_score").alias("relevance_label"),
        T.sentiment(norm="_t_norm", nlow="_t_nlow").alias("sentiment_score"), ts_lit(as_of).alias("nlp_processed_at"),
        F.col("_et.event_type").alias("event_type"), F.when(F.col("_et._h") > 0, F.col("_et._c")).otherwise(0.0).alias("base_confidence"),
        "_reject",
        passed(contains_count(F.col("_t_low"), L.MARKET_CONTEXT_TERMS)).alias("_market"),
        passed(contains_count(F.col("_t_low"), L.HIGH_IMPACT_TERMS)).alias("_high"),
        passed(T.impact_signal(low="_t_low")).alias("_sig"), passed(T.extract_country(low="_t_low")).alias("country"),
        passed(MP.text_tags(norm=F.col("_entity"))).alias("text_tags"),
        passed(aliases.candidates(F.col("_text"), F.col("_entity"))).alias("_cand"))


def build_events(articles: DataFrame, assets: DataFrame, edges: DataFrame, as_of, *,
                 existing_events: DataFrame | None = None, existing_links: DataFrame | None = None,
                 existing_impacts: DataFrame | None = None, corpus=None) -> dict[str, DataFrame]:
    """EVT-04: articles -> (events, event_articles, impacts, tags, rejections).

    Order of gates as in the reference: language, relevance, event type,
    confidence status, quality gates. Accepted articles are grouped by
    (title, type, country, day); the earliest article (created_at, id) gives
    title/description/source/url/time, the highest confidence (earliest on
    ties) gives confidence/severity/status. Against an existing event with the
    same key, those three are replaced only when the new confidence is
    higher. An article without a time forms its own event (a NULL day never
    matches). Impacts: first article, then lowest layer, wins per (event, asset).

    Layer 4 compares with ``corpus`` (``mapping.similarity_corpus``); without
    one it is made from the existing events and impacts, if there are any.
    What is checkpointed between the steps holds scores and short arrays; the
    text is read once for them, and the body joined back to the new events.
    """
    key = "article_id"
    aliases = MP.AliasIndex.of(MP.asset_aliases(assets))
    a = cut_lineage(annotate(articles, as_of, aliases))
    s1 = a.where(F.col("_reject").isNull())

    l1 = cut_lineage(aliases.mentions(s1, key, "_cand"))
    nt = l1.groupBy(key).agg(F.count(F.lit(1)).alias("n_tickers"))
    s2 = (s1.drop("_cand").join(nt, key, "left").fillna(0, subset=["n_tickers"]))
    s2 = score_confidence(s2, as_of, market_hits="_market")
    s2 = s2.withColumn("_reject", F.when(F.col("status") == "rejected", "low_confidence"))
    low_conf = s2.where(F.col("_reject").isNotNull())
    s2 = s2.where(F.col("_reject").isNull())
    mc = T.market_context(None, F.col("n_tickers"), hits="_market")
    s2 = (s2.withColumn("relevance", clamp((F.col("confidence") + mc) / 2))
          .withColumn("impact_direction", direction_expr("event_type", "_sig.polarity"))
          .withColumn("impact_strength", strength_expr("confidence", "_sig.intensity"))
          .withColumn("severity", severity_expr("event_type", None, "confidence", "n_tickers", hits="_high"))
          .withColumn("event_time", F.coalesce(F.col("published_at"), ts_lit(as_of)))
          .drop("_sig", "_market", "_high"))
    s2 = cut_lineage(s2)

    l1s = l1.join(s2.select(key), key, "left_semi")
    tags = MP.merge_tags(s2.select(key, "text_tags"), l1s, assets, key=key)
    l2 = MP.expand_graph(l1s, edges, key=key)
    l3 = MP.expand_sector(l1s, assets, s2.select(key, "relevance"), key=key)
    direct = (l1s.select(key, "ticker").unionByName(l2.select(key, "ticker"))
              .unionByName(l3.select(key, "ticker")).distinct())
    if corpus is None and existing_events is not None and existing_impacts is not None:
        corpus = MP.similarity_corpus(existing_events, existing_impacts, assets)
    if corpus is not None:
        texts = articles.select(key, T.article_text("title", "content").alias("text")).join(s2.select(key, "event_type"), key)
        l4 = cut_lineage(MP.expand_similar(texts, corpus, direct, key=key))
    else:
        l4 = l3.limit(0)
    proposed = direct.unionByName(l4.select(key, "ticker")).distinct()
    gated = cut_lineage(quality_gates(s2.drop("text_tags"), assets, proposed, existing_events, existing_links, key=key))
    gate_fail = gated.where(F.size("errors") > 0)
    ok = gated.where(F.size("errors") == 0)

    # -- merge into events --------------------------------------------------
    ok = ok.withColumn("_day", F.to_date("published_at"))
    # Articles without a time never match: each forms its own group.
    grp_day = F.coalesce(F.col("_day").cast("string"), F.concat(F.lit("article:"), F.col(key).cast("string")))
    ok = ok.withColumn("_gkey", F.sha2(F.to_json(F.struct("title", "event_type", "country",
                                                          grp_day.alias("d"))), 256))
    first_o = F.struct(F.col("created_at"), F.col(key))
    g = (ok.groupBy("_gkey")
         .agg(F.min_by(F.struct("title", "event_type", "country", "_day", F.col(key).alias("first_article"),
                                "source", "url", "published_at", "created_at"), first_o).alias("_f"),
              F.max_by(F.struct("confidence", "severity", "status"),
                       F.struct("confidence", F.unix_micros(F.col("created_at")) * -1, F.col(key) * -1)).alias("_m")))
    g = g.select("_gkey", "_f.*", "_m.confidence", "_m.severity", "_m.status")
    if existing_events is not None:
        ex = existing_events.select(F.col("event_id").alias("_xid"), F.col("title").alias("_xt"),
                                    F.col("event_type").alias("_xe"), F.col("country").alias("_xc"),
                                    F.to_date("published_at").alias("_xd"),
                                    F.col("confidence_score").alias("_xconf"),
                                    F.col("severity").alias("_xsev"), F.col("status").alias("_xst"))
        # The first existing match per group (smallest id), as a lookup returning one row.
        g = g.withColumn("_pday", F.coalesce(F.col("_day"), F.to_date(ts_lit(as_of))))
        cond = ((g["title"] == ex["_xt"]) & (g["event_type"] == ex["_xe"]) & g["country"].eqNullSafe(ex["_xc"])
                & (g["_pday"] == ex["_xd"]))
        gx = g.join(ex, cond, "left")
        g = (gx.groupBy("_gkey").agg(F.min_by(F.struct(*[c for c in gx.columns if c != "_gkey"]),
                                              F.struct(F.col("_xid").isNull(), F.col("_xid"))).alias("_r"))
             .select("_gkey", "_r.*").drop("_pday"))
    else:
        g = g.withColumn("_xid", F.lit(None).cast("string")).withColumn("_xconf", F.lit(None).cast("double")) \
             .withColumn("_xsev", F.lit(None).cast("int")).withColumn("_xst", F.lit(None).cast("string"))
    newer = F.col("_xconf").isNull() | (F.col("confidence") > F.col("_xconf"))
    is_new = F.col("_xid").isNull()
    merged = cut_lineage(g.select(
        "_gkey",
        F.coalesce(F.col("_xid").cast("string"), F.concat(F.lit("a"), F.col("first_article").cast("string")))
        .alias("event_id"),
        "title", "event_type", "country", "source", "url", "published_at", "created_at",
        F.when(is_new | newer, F.col("confidence")).otherwise(F.col("_xconf")).alias("confidence_score"),
        F.when(is_new | newer, F.col("severity")).otherwise(F.col("_xsev")).alias("severity"),
        F.when(is_new | newer, F.col("status")).otherwise(F.col("_xst")).alias("status"),
        is_new.alias("is_new"), "first_article"))
    body = articles.select(F.col(key).alias("first_article"), F.col("content").alias("description"))
    events = merged.drop("_gkey").join(body, "first_article").select(
        "event_id", "title", "description", *[c for c in merged.columns if c not in ("_gkey", "event_id", "title")])
    links = (ok.select("_gkey", key, F.col("relevance").alias("relevance_score"), "created_at")
             .join(merged.select("_gkey", "event_id"), "_gkey").drop("_gkey"))
    params = ok.select(key, "confidence", "relevance", "impact_strength", "impact_direction")
    per_article = MP.assemble_impacts({1: l1s.join(ok.select(key), key, "left_semi"),
                                       2: l2, 3: l3, 4: l4}, params, assets, key=key)
    imp = per_article.join(links.select("event_id", key, "created_at"), key)
    impacts = (imp.groupBy("event_id", "asset_id")
               .agg(F.min_by(F.struct("ticker", "layer", "impact_direction", "impact_strength", "confidence_score"),
                             F.struct("created_at", F.col(key), "layer")).alias("_i"))
               .select("event_id", "asset_id", "_i.*"))
    if existing_impacts is not None:
        impacts = impacts.join(existing_impacts.select(F.col("event_id").cast("string").alias("event_id"),
                                                       "asset_id"), ["event_id", "asset_id"], "left_anti")
    ev_tags = (tags.join(links.select("event_id", key), key)
               .select("event_id", F.explode("tags").alias("tag")).distinct())
    rejections = (a.where(F.col("_reject").isNotNull()).select(F.col("_reject").alias("reason"))
                  .unionByName(low_conf.select(F.col("_reject").alias("reason")))
                  .unionByName(gate_fail.select(F.lit("quality").alias("reason")))
                  .groupBy("reason").agg(F.count(F.lit(1)).alias("n")))
    annotated = a.select(key, "language_code", "language_confidence", "relevance_score", "relevance_label",
                         "sentiment_score", "nlp_processed_at")
    return {"events": events, "event_articles": links.select("event_id", key, "relevance_score"),
            "impacts": impacts, "tags": ev_tags, "rejections": rejections,
            "gate_counts": gate_counts(gate_fail), "annotated": annotated}


# ---------------------------------------------------------------------------
# EVT-05 / EVT-06 backfills
# ---------------------------------------------------------------------------

def backfill_metadata(articles: DataFrame, as_of, n: int | None = None) -> DataFrame:
    """EVT-05: NLP columns for the articles never processed (the oldest ``n``
    as one batch, as the reference's task; None: all of them)."""
    todo = articles.where(F.col("nlp_processed_at").isNull())
    if n is not None:
        todo = todo.orderBy(F.col("created_at").asc_nulls_first(), F.col("article_id")).limit(n)
    return FL.annotate_articles(todo.drop("nlp_processed_at")).withColumn("nlp_processed_at", ts_lit(as_of))


def article_boundaries(links: DataFrame, articles: DataFrame, reach: int) -> DataFrame:
    """(event_id, next_article, text): for each two neighbouring articles of an
    event (newest published first, no time before all) the last ``reach``
    words of the one and the first ``reach`` words that follow, over more than
    one article where they are that short. A phrase of up to ``reach`` + 1
    words that the joined text holds and no article alone stands in one of
    these. Neighbours are found by row position, so the articles of a large
    event are never in one task."""
    return _boundaries(links, articles.select("article_id", "published_at", text_ends(T.article_text("title", "content"), reach).alias("_ends")), reach)


def text_ends(text: Column, reach: int) -> Column:
    """struct(words, head, tail): the number of a text's words, the first and the last ``reach`` of them."""
    return MP.let(F.filter(F.split(T.normalize_entity(text), " "), lambda t: t != ""), lambda w: F.struct(
        F.size(w).alias("words"), F.slice(w, 1, reach).alias("head"), F.slice(w, F.greatest(F.size(w) - reach + 1, F.lit(1)), reach).alias("tail")))


def _boundaries(links: DataFrame, ends: DataFrame, reach: int) -> DataFrame:
    """``article_boundaries`` of articles whose ends (``text_ends``) are known: article_id, published_at, _ends."""
    ends = (ends.where(F.col("_ends.words") > 0)
            .select("article_id", F.col("published_at").isNotNull().alias("_timed"), (-F.unix_micros("published_at")).alias("_late"),
                    "_ends.head", "_ends.tail"))
    from eventlens.operators.signals import row_index
    placed = cut_lineage(row_index(links.select("event_id", "article_id").distinct().join(ends, "article_id"),
                                   ["event_id", "_timed", "_late", "article_id"], out="at"))
    # Each head goes to the articles up to ``reach`` places before it; the next ones of the same event follow the tail.
    sent = placed.select(F.col("event_id").alias("_e"), F.col("article_id").alias("_a"), F.col("at").alias("_from"), "head",
                         F.explode(F.sequence(F.lit(1), F.lit(max(reach, 1)))).alias("_step")).withColumn("_to", F.col("_from") - F.col("_step"))
    after = (placed.drop("head").join(sent, (F.col("at") == F.col("_to")) & (F.col("event_id") == F.col("_e")))
             .groupBy("event_id", "article_id").agg(F.first("tail").alias("tail"), F.min_by("_a", "_step").alias("next_article"),
                                                    F.sort_array(F.collect_list(F.struct("_step", "head"))).alias("heads")))
    following = F.slice(F.flatten(F.transform("heads", lambda h: h["head"])), 1, max(reach, 1))
    return after.select("event_id", "next_article", F.array_join(F.concat("tail", following), " ").alias("text"))


def backfill_entities(events: DataFrame, links: DataFrame, articles: DataFrame, assets: DataFrame,
                      edges: DataFrame, impacts: DataFrame | None = None, n: int | None = None,
                      corpus=None) -> dict[str, DataFrame]:
    """EVT-06: re-map the newest ``n`` events from the text of all their
    articles, with the fixed 0.7 relevance / 0.6 strength of the reference,
    the base direction of the event type and the event confidence (0 or NULL
    -> 0.6). Returns tags and new impacts.

    The reference concatenates every article of an event into one string.
    Here mentions, tags and term counts are computed per article and merged
    per event (sets and summed counts), and the places where one article ends
    and the next begins are searched as short texts of their own
    (``article_boundaries``): the same result without one unbounded string per
    event. Each text is read once, for all of these together, and not shuffled;
    what is checkpointed holds its candidates, tags and first and last words."""
    ev = events
    if n is not None:
        ev = ev.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)
    text = T.article_text("title", "content")
    linked = links.select("event_id", "article_id").join(ev.select("event_id"), "event_id", "left_semi").distinct()
    aliases = MP.AliasIndex.of(MP.asset_aliases(assets))
    reach = max(MP.TAG_WORDS, *aliases.known_phrases.lengths, 1) - 1
    todo = articles if n is None else articles.join(linked.select("article_id"), "article_id", "left_semi")
    own = cut_lineage(todo.select("article_id", "published_at", text.alias("text")).select(
        "article_id", "published_at", text_ends(F.col("text"), reach).alias("_ends"),
        aliases.candidates(F.col("text")).alias("_cand"), MP.text_tags(F.col("text")).alias("text_tags")))
    edges_of = _boundaries(linked, own, reach)
    read = cut_lineage(own.select("article_id", "_cand", "text_tags").join(linked, "article_id").select("event_id", "_cand", "text_tags")
                       .unionByName(edges_of.select("event_id", aliases.candidates(F.col("text")).alias("_cand"),
                                                    MP.text_tags(F.col("text")).alias("text_tags"))))
    l1 = cut_lineage(aliases.mentions(read, "event_id", "_cand"))
    w = Window.partitionBy("event_id").orderBy("tag")
    text_tags = read.select("event_id", F.explode("text_tags").alias("tag"))
    asset_tags = MP.merge_tags(l1.select("event_id").distinct().withColumn("text_tags", F.array().cast("array<string>")), l1, assets,
                               key="event_id", most=None).select("event_id", F.explode("tags").alias("tag"))
    tags = (text_tags.unionByName(asset_tags).distinct()
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= L.MAX_TAGS).drop("_rn"))
    key = "event_id"
    docs = ev.select(key, "event_type", "confidence_score")
    rel = docs.select(key, F.lit(0.7).alias("relevance"))
    l2 = MP.expand_graph(l1, edges, key=key)
    l3 = MP.expand_sector(l1, assets, rel, key=key)
    layers = {1: l1, 2: l2, 3: l3}
    if corpus is not None:
        texts = (links.select(key, "article_id").join(ev.select(key, "event_type"), key)
                 .join(articles.select("article_id", text.alias("text")), "article_id"))
        layers[4] = MP.expand_similar(texts.select(key, "text", "event_type"), corpus, l1, key=key)
    conf = F.coalesce(F.when(F.col("confidence_score") != 0, F.col("confidence_score")), F.lit(0.6))
    params = docs.select(key, conf.alias("confidence"), F.lit(0.7).alias("relevance"),
                         F.lit(0.6).alias("impact_strength"), base_direction("event_type").alias("impact_direction"))
    imps = MP.assemble_impacts(layers, params, assets, impacts, key=key)
    return {"tags": tags, "impacts": imps}


# ---------------------------------------------------------------------------
# EVT-07 event cards
# ---------------------------------------------------------------------------

def event_cards(events: DataFrame, impacts: DataFrame, assets: DataFrame, tags: DataFrame,
                top_assets: int = 5, top_tags: int = 8) -> DataFrame:
    """EVT-07 list view: impact count, top-5 assets by impact confidence
    (NULL confidence last... as PostgreSQL DESC puts NULL first, it is first
    here too) and the first 8 tags alphabetically — one pass, no per-event
    query. Per-event top-k uses ``row_number`` (a partial WindowGroupLimit)."""
    a = assets.select("asset_id", "ticker", "name")
    imp = impacts.join(a, "asset_id")
    w = Window.partitionBy("event_id").orderBy(F.col("confidence_score").desc_nulls_first(), F.col("ticker"))
    top = (imp.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top_assets)
           .groupBy("event_id")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct(
               "_rn", "ticker", "name", "impact_direction", "impact_strength", "confidence_score"))),
               lambda s: s.dropFields("_rn")).alias("affected_assets")))
    cnt = impacts.groupBy("event_id").agg(F.count(F.lit(1)).alias("impact_count"))
    wt = Window.partitionBy("event_id").orderBy("tag")
    tg = (tags.withColumn("_rn", F.row_number().over(wt)).where(F.col("_rn") <= top_tags)
          .groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "tag"))),
                                               lambda s: s["tag"]).alias("tags")))
    return (events.select("event_id", "title", "event_type", "country", "severity", "confidence_score",
                          "published_at")
            .join(cnt, "event_id", "left").join(top, "event_id", "left").join(tg, "event_id", "left")
            .fillna(0, subset=["impact_count"]))
