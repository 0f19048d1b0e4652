"""Registered queries: asset mapping layers, knowledge graph, event scoring,
quality gates and event cards."""
from __future__ import annotations

from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.operators import events as EV
from eventlens.operators import graph as G
from eventlens.operators import mapping as MP
from eventlens.plans.base import ARTICLE_AS_OF, plan
from eventlens.plans.text_plans import _country_sql as _country_sql_l
from eventlens.plans.text_plans import _strip_sql
from eventlens.plans.text_sql import TEXT, best_group, hits, inlist, q

# ---------------------------------------------------------------------------
# Spark inputs
# ---------------------------------------------------------------------------


def _docs(t):
    return t.article.select("article_id", T.article_text("title", "content").alias("text"))


def _mentions(t):
    return MP.extract_mentions(_docs(t), MP.asset_aliases(t.asset), key="article_id")


def _relevance(t):
    return t.article.select("article_id", ((F.col("article_id") % 10) / 10.0).alias("relevance"))


# ---------------------------------------------------------------------------
# DuckDB chain
# ---------------------------------------------------------------------------

def _norm_alias(a: str) -> str:
    import re
    return re.sub(r"[^a-z0-9]+", " ", a.lower()).strip()


def _ctags_sql(pad: str, norm: str) -> str:
    arms = []
    for country, aliases in L.TAG_COUNTRY_TERMS:
        cond = " OR ".join(f"contains({pad}, {q(' ' + _norm_alias(a) + ' ')})" for a in aliases)
        arms.append(f"CASE WHEN {cond} THEN {q(country)} END")
    for tag, kws in L.TOPIC_TAGS:
        cond = " OR ".join(f"contains({norm}, {q(k)})" for k in kws)
        arms.append(f"CASE WHEN {cond} THEN {q(tag)} END")
    return "[" + ", ".join(arms) + "]"


NORM_ENT = "trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"

CHAIN = {
    "o_alias0": f"""
        SELECT upper(ticker) AS ticker, {NORM_ENT.format(x="coalesce(name, '')")} AS n, asset_id FROM f_asset""",
    "o_alias1": f"""
        SELECT ticker, n, list_filter(list_filter(string_split(n, ' '), lambda t: t <> ''),
                                      lambda t: t NOT IN {inlist(L.ASSET_SUFFIX_TOKENS)}) AS st
        FROM o_alias0 WHERE n <> ''""",
    "o_cands": f"""
        SELECT ticker, alias FROM (
          SELECT ticker, trim(c) AS alias FROM (
            SELECT ticker, unnest([n, array_to_string(st, ' '),
                                   CASE WHEN len(st) >= 2 THEN array_to_string(st[1:2], ' ') END,
                                   CASE WHEN len(st) >= 3 THEN array_to_string(st[1:3], ' ') END]) AS c
            FROM o_alias1)
          WHERE c IS NOT NULL AND trim(c) <> '')
        WHERE NOT (len(string_split(alias, ' ')) = 1
                   AND (length(alias) < 5 OR alias IN {inlist(L.GENERIC_SINGLE_TOKEN_ALIASES)}))
        UNION SELECT ticker, ticker FROM o_alias0""",
    "o_alias": """
        SELECT alias, min(ticker) AS ticker, (alias = upper(alias) AND alias <> lower(alias)) AS is_ticker,
               CAST(len(string_split(alias, ' ')) AS INTEGER) AS n_tokens
        FROM o_cands GROUP BY alias
        HAVING (alias = upper(alias) AND alias <> lower(alias)) OR count(DISTINCT ticker) = 1""",
    "o_docs": f"SELECT article_id, {TEXT} AS text FROM f_article",
    "o_norm": f"""
        SELECT article_id, {NORM_ENT.format(x="text")} AS norm,
               ' ' || {NORM_ENT.format(x="text")} || ' ' AS pad FROM o_docs""",
    "o_mentions": """
        SELECT DISTINCT d.article_id, a.ticker FROM
          (SELECT article_id, unnest(regexp_extract_all(upper(text), '\\b[A-Z][A-Z0-9]{0,9}\\b')) AS tok FROM o_docs) d
          JOIN o_alias a ON a.alias = d.tok AND a.is_ticker
        UNION
        SELECT n.article_id, a.ticker FROM o_norm n JOIN o_alias a
          ON NOT a.is_ticker AND contains(n.pad, ' ' || a.alias || ' ')""",
    "o_adj": f"""
        SELECT source_key AS src, target_key AS dst,
               coalesce(CASE WHEN strength <> 0 THEN strength END, {L.KG_DEFAULT_STRENGTH}) AS w
        FROM f_kg_edge WHERE relationship IN {inlist(L.KG_RELATIONSHIPS)}
        UNION ALL
        SELECT target_key, source_key,
               coalesce(CASE WHEN strength <> 0 THEN strength END, {L.KG_DEFAULT_STRENGTH}) * {L.KG_REVERSE_FACTOR}
        FROM f_kg_edge WHERE relationship IN {inlist(L.KG_BIDIRECTIONAL)}""",
    "o_l2": f"""
        SELECT p.article_id, p.ticker, max(p.score) AS score FROM (
          SELECT article_id, substr(node, 7) AS ticker, score FROM (
            SELECT r.article_id, a.dst AS node, a.w * {L.L2_HOP1_WEIGHT} AS score
            FROM o_mentions r JOIN o_adj a ON a.src = 'ASSET:' || r.ticker
            UNION ALL
            SELECT r.article_id, b.dst, a.w * b.w * {L.L2_HOP2_WEIGHT}
            FROM o_mentions r JOIN o_adj a ON a.src = 'ASSET:' || r.ticker JOIN o_adj b ON b.src = a.dst)
          WHERE starts_with(node, 'ASSET:')) p
        LEFT JOIN o_mentions m ON m.article_id = p.article_id AND m.ticker = p.ticker
        WHERE m.ticker IS NULL GROUP BY 1, 2""",
    "o_members": f"""
        SELECT sector, upper(ticker) AS ticker FROM (
          SELECT *, row_number() OVER (PARTITION BY sector ORDER BY asset_id) AS rn FROM f_asset WHERE sector IS NOT NULL)
        WHERE rn <= {L.L3_MAX_ASSETS_PER_SECTOR}""",
    "o_l3": f"""
        SELECT s.article_id, mb.ticker, max(least(1.0, {L.L3_BASE_WEIGHT} * greatest(0.25, least(1.0, (s.article_id % 10) / 10.0::DOUBLE)))) AS score
        FROM (SELECT DISTINCT r.article_id, a.sector FROM o_mentions r JOIN f_asset a ON upper(a.ticker) = r.ticker
              WHERE a.sector IS NOT NULL) s
        JOIN o_members mb ON mb.sector = s.sector
        LEFT JOIN o_mentions m ON m.article_id = s.article_id AND m.ticker = mb.ticker
        WHERE m.ticker IS NULL GROUP BY 1, 2""",
}


def mplan(name, sql=None):
    return plan(name, oracle=sql, extra_ctes=CHAIN)


@mplan("map01_asset_aliases", "SELECT * FROM o_alias")
def map01(t):
    """MAP-01: alias table of every asset."""
    return MP.asset_aliases(t.asset)


@mplan("map02_extract_mentions", "SELECT * FROM o_mentions")
def map02(t):
    """MAP-02: direct asset mentions in every article (whole texts)."""
    return _mentions(t)


_TAGS_SQL = f"""
    SELECT x.article_id,
           list_slice(list_sort(list_distinct(list_concat(x.xt, coalesce(m.mt, [])))), 1, {L.MAX_TAGS}) AS tags
    FROM (SELECT article_id, list_filter({_ctags_sql('pad', 'norm')}, lambda v: v IS NOT NULL) AS xt FROM o_norm) x
    LEFT JOIN (
      SELECT article_id, list(DISTINCT tg) AS mt FROM (
        SELECT m.article_id, unnest([a.ticker,
               nullif(array_to_string(list_transform(list_slice(string_split(a.n, ' '), 1, 3),
                                                     lambda w: upper(w[1]) || w[2:]), ' '), ''),
               f.sector, f.country]) AS tg
        FROM o_mentions m JOIN o_alias0 a ON a.ticker = m.ticker JOIN f_asset f ON f.asset_id = a.asset_id)
      WHERE tg IS NOT NULL AND tg <> '' GROUP BY 1) m
    ON m.article_id = x.article_id"""


@mplan("map03_entity_tags", _TAGS_SQL)
def map03(t):
    """MAP-03: entity tags of every article."""
    return MP.entity_tags(_docs(t), _mentions(t), t.asset, key="article_id")


@mplan("map04_expand_graph", "SELECT * FROM o_l2")
def map04(t):
    """MAP-04: two-hop knowledge-graph spread from each article's mentions."""
    return MP.expand_graph(_mentions(t), t.kg_edge, key="article_id")


@mplan("map05_expand_sector", "SELECT * FROM o_l3")
def map05(t):
    """MAP-05: sector spread (first 6 members per sector)."""
    return MP.expand_sector(_mentions(t), t.asset, _relevance(t), key="article_id")


_SIM_CHAIN = f"""
    WITH corpus AS (
        SELECT event_id AS c_event, event_type AS c_type,
               coalesce(title, '') || chr(10) || coalesce(description, '') AS txt
        FROM f_event WHERE status IN ('auto_approved', 'human_approved')
        ORDER BY published_at DESC NULLS LAST, created_at DESC, event_id DESC LIMIT {L.L4_LOOKBACK_EVENTS}),
    prior AS (
        SELECT i.event_id AS c_event, upper(a.ticker) AS ticker,
               max(coalesce(CASE WHEN i.confidence_score <> 0 THEN i.confidence_score END, 0.5)) AS prior
        FROM f_impact i JOIN f_asset a ON a.asset_id = i.asset_id
        WHERE i.event_id IN (SELECT c_event FROM corpus) GROUP BY 1, 2),
    ctok AS (
        SELECT c_event, c_type, tok, count(*) AS c FROM (
          SELECT c_event, c_type, unnest(list_filter(regexp_extract_all(lower(txt), '[a-z0-9]{{3,}}'),
                                                     lambda x: x NOT IN {inlist(L.SIMILARITY_STOPWORDS)})) AS tok
          FROM corpus WHERE c_event IN (SELECT c_event FROM prior))
        GROUP BY 1, 2, 3),
    cvec AS (SELECT c_event, c_type, tok, c / sqrt(sum(c * c) OVER (PARTITION BY c_event)) AS cw FROM ctok),
    dtyp AS (SELECT article_id, {best_group('lower(text)', L.EVENT_KEYWORDS)} AS d_type FROM o_docs),
    dtok AS (
        SELECT article_id, tok, count(*) AS c FROM (
          SELECT article_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}'),
                                                lambda x: x NOT IN {inlist(L.SIMILARITY_STOPWORDS)})) AS tok
          FROM o_docs) GROUP BY 1, 2),
    dvec AS (SELECT d.article_id, d.tok, d.c / sqrt(sum(d.c * d.c) OVER (PARTITION BY d.article_id)) AS w, t.d_type
             FROM dtok d JOIN dtyp t USING (article_id)),
    sim AS (SELECT article_id, c_event, greatest(0.0, least(1.0, sum(w * cw))) AS sim
            FROM dvec JOIN cvec ON cvec.c_type = dvec.d_type AND cvec.tok = dvec.tok GROUP BY 1, 2),
    cand AS (
        SELECT s.article_id, p.ticker, max(s.sim * p.prior) AS score
        FROM sim s JOIN prior p USING (c_event)
        LEFT JOIN o_mentions m ON m.article_id = s.article_id AND m.ticker = p.ticker
        WHERE s.sim >= {L.L4_MIN_SIMILARITY} AND m.ticker IS NULL GROUP BY 1, 2)
    """


@mplan("map06_expand_similar", _SIM_CHAIN + f"""
    SELECT article_id, ticker, greatest(0.0, least(1.0, score)) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, ticker) AS rn FROM cand)
    WHERE rn <= {L.L4_MAX_ASSET_CANDIDATES}""")
def map06(t):
    """MAP-06: similarity spread against the last 300 approved events of the same type."""
    docs = _docs(t).withColumn("_s", T.infer_event_type(low=F.lower("text")))
    docs = docs.select("article_id", "text", F.col("_s.event_type").alias("event_type"))
    corpus = MP.similarity_corpus(t.event, t.impact, t.asset)
    return MP.expand_similar(docs, corpus, _mentions(t), key="article_id")


@mplan("map06_expand_similar_all", _SIM_CHAIN.replace(f"DESC LIMIT {L.L4_LOOKBACK_EVENTS}", "DESC") + f"""
    SELECT article_id, ticker, round(greatest(0.0, least(1.0, score)), 9) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY round(score, 9) DESC, ticker) AS rn FROM cand)
    WHERE rn <= {L.L4_MAX_ASSET_CANDIDATES}""")
def map06b(t):
    """MAP-06: similarity spread against all approved events of the same type (rare tokens joined first)."""
    docs = _docs(t).withColumn("_s", T.infer_event_type(low=F.lower("text")))
    docs = docs.select("article_id", "text", F.col("_s.event_type").alias("event_type"))
    corpus = MP.similarity_corpus(t.event, t.impact, t.asset, lookback=None)
    out = MP.expand_similar(docs, corpus, _mentions(t), key="article_id", prefix_filter=True)
    return out.withColumn("score", F.round("score", 9))


@mplan("map07_assemble_impacts", """
    WITH u AS (
        SELECT article_id, ticker, CAST(NULL AS DOUBLE) AS score, 1 AS layer FROM o_mentions
        UNION ALL SELECT article_id, ticker, score, 2 FROM o_l2
        UNION ALL SELECT article_id, ticker, score, 3 FROM o_l3),
    f AS (SELECT article_id, ticker, arg_min(score, layer) AS score, min(layer) AS layer FROM u GROUP BY 1, 2),
    p AS (SELECT article_id, (article_id % 100) / 100.0::DOUBLE AS confidence, (article_id % 10) / 10.0::DOUBLE AS relevance,
                 0.6::DOUBLE AS impact_strength, 'neutral' AS impact_direction FROM f_article)
    SELECT f.article_id, a.asset_id, f.ticker, f.layer, p.impact_direction,
           greatest(0.0, least(1.0, CASE WHEN f.layer = 1 THEN p.impact_strength ELSE f.score END)) AS impact_strength,
           greatest(0.0, least(1.0, CASE WHEN f.layer = 1 THEN (p.confidence + p.relevance) / 2
                                         ELSE (p.confidence + p.relevance) / 2 * f.score END)) AS confidence_score
    FROM f JOIN f_asset a ON upper(a.ticker) = f.ticker JOIN p USING (article_id)""")
def map07(t):
    """MAP-07: first-layer-wins impact assembly of layers 1-3."""
    m = _mentions(t)
    params = t.article.select("article_id", ((F.col("article_id") % 100) / 100.0).alias("confidence"),
                              ((F.col("article_id") % 10) / 10.0).alias("relevance"),
                              F.lit(0.6).alias("impact_strength"), F.lit("neutral").alias("impact_direction"))
    layers = {1: m, 2: MP.expand_graph(m, t.kg_edge, key="article_id"),
              3: MP.expand_sector(m, t.asset, _relevance(t), key="article_id")}
    return MP.assemble_impacts(layers, params, t.asset, key="article_id")


# ---------------------------------------------------------------------------
# knowledge graph
# ---------------------------------------------------------------------------

_SEED_EDGES = """
    SELECT 'ASSET:' || upper(ticker) AS source_key, 'SECTOR:' || sector AS target_key, 'PART_OF' AS relationship,
           0.9::DOUBLE AS strength, 'MANUAL' AS data_source, CAST(NULL AS DATE) AS last_verified
    FROM f_asset WHERE sector IS NOT NULL
    UNION
    SELECT 'ASSET:' || upper(ticker), 'COUNTRY:' || country, 'PART_OF', 0.9::DOUBLE, 'MANUAL', CAST(NULL AS DATE)
    FROM f_asset WHERE country IS NOT NULL"""


@mplan("kg01_seed_graph_nodes", """
    SELECT 'ASSET:' || upper(ticker) AS entity_key, 'ASSET' AS entity_type, upper(ticker) AS name FROM f_asset
    UNION ALL SELECT DISTINCT 'SECTOR:' || sector, 'SECTOR', sector FROM f_asset WHERE sector IS NOT NULL
    UNION ALL SELECT DISTINCT 'COUNTRY:' || country, 'COUNTRY', country FROM f_asset WHERE country IS NOT NULL""")
def kg01a(t):
    """KG-01: baseline graph nodes."""
    nodes, _ = G.seed_graph(t.asset)
    return nodes.drop("metadata")


@mplan("kg01_seed_graph_edges", _SEED_EDGES)
def kg01b(t):
    """KG-01: baseline PART_OF edges."""
    return G.seed_graph(t.asset)[1]


@mplan("kg02_apply_profiles", _SEED_EDGES + """
    UNION
    SELECT 'ASSET:' || upper(ticker), 'SECTOR:' || industry, 'PART_OF', 0.78::DOUBLE, 'WIKIDATA', CAST(NULL AS DATE)
    FROM f_profile WHERE industry IS NOT NULL AND industry <> '' AND ticker IS NOT NULL AND ticker <> ''
    UNION
    SELECT 'ASSET:' || upper(ticker), 'COUNTRY:' || country, 'PART_OF', 0.86::DOUBLE, 'WIKIDATA', CAST(NULL AS DATE)
    FROM f_profile WHERE country IS NOT NULL AND country <> '' AND ticker IS NOT NULL AND ticker <> ''""")
def kg02(t):
    """KG-02: seed graph enriched with company profiles (edges)."""
    nodes, edges = G.seed_graph(t.asset)
    return G.apply_profiles(nodes, edges, t.profile)[1]


@mplan("kg02_profile_nodes", """
    SELECT entity_key, entity_type, name, display_name FROM (
      SELECT 'ASSET:' || upper(a.ticker) AS entity_key, 'ASSET' AS entity_type, upper(a.ticker) AS name,
             coalesce(p.company, a.name) AS display_name
      FROM f_asset a LEFT JOIN f_profile p ON upper(p.ticker) = upper(a.ticker)
      UNION ALL
      SELECT DISTINCT 'SECTOR:' || x, 'SECTOR', x, NULL FROM (
        SELECT sector AS x FROM f_asset WHERE sector IS NOT NULL
        UNION SELECT industry FROM f_profile WHERE industry IS NOT NULL AND industry <> '')
      UNION ALL
      SELECT DISTINCT 'COUNTRY:' || x, 'COUNTRY', x, NULL FROM (
        SELECT country AS x FROM f_asset WHERE country IS NOT NULL
        UNION SELECT country FROM f_profile WHERE country IS NOT NULL AND country <> ''))""")
def kg02b(t):
    """KG-02: node set after profile enrichment with merged display names."""
    nodes, edges = G.seed_graph(t.asset)
    n = G.apply_profiles(nodes, edges, t.profile)[0]
    return n.select("entity_key", "entity_type", "name",
                    F.when(F.col("entity_type") == "ASSET", F.col("metadata")["display_name"]).alias("display_name"))


@mplan("kg03_upsert_edges", """
    WITH old AS (SELECT source_key, target_key, relationship, 'MANUAL' AS data_source, strength FROM f_kg_edge),
         new AS (SELECT source_key, target_key, relationship, 'MANUAL' AS data_source, strength + 0.05 AS strength
                 FROM f_kg_edge WHERE relationship = 'SUPPLIES_TO')
    SELECT * FROM new
    UNION ALL
    SELECT o.* FROM old o WHERE NOT EXISTS (
      SELECT 1 FROM new n WHERE n.source_key = o.source_key AND n.target_key = o.target_key
        AND n.relationship = o.relationship AND n.data_source = o.data_source)""")
def kg03(t):
    """KG-03: upsert of re-scored supply edges into the fixture graph."""
    old = t.kg_edge.withColumn("data_source", F.lit("MANUAL"))
    new = (t.kg_edge.where(F.col("relationship") == "SUPPLIES_TO")
           .withColumn("strength", F.col("strength") + 0.05).withColumn("data_source", F.lit("MANUAL")))
    return G.upsert_edges(old, new).select("source_key", "target_key", "relationship", "data_source", "strength")


def _filing_sql() -> str:
    text = f"({_strip_sql('html')} || tail)"
    return f"""
    WITH al AS (
        SELECT DISTINCT ticker, alias FROM (
          SELECT upper(ticker) AS ticker, unnest([lower(ticker), lower(trim(name)),
                 lower(trim(replace(replace(name, 'Corp', ''), 'Corporation', '')))]) AS alias FROM f_asset)
        WHERE alias IS NOT NULL AND alias <> ''),
    f AS (SELECT upper(source_ticker) AS src, {text} AS x FROM f_filing),
    pr AS (SELECT f.src, al.ticker, al.alias, f.x, string_split(f.x, al.alias) AS parts
           FROM f JOIN al ON contains(f.x, al.alias) AND f.src <> al.ticker),
    occ AS (SELECT src, ticker, alias, x, i,
                   CAST(list_sum(list_transform(parts[1:i], lambda p: length(p))) + (i - 1) * length(alias) AS BIGINT) AS st
            FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM pr)),
    w AS (SELECT src, ticker,
                 substr(x, greatest(0, st - {L.FILING_WINDOW}) + 1,
                        least(length(x), st + length(alias) + {L.FILING_WINDOW}) - greatest(0, st - {L.FILING_WINDOW})) AS win
          FROM occ),
    e AS (SELECT ticker AS s, src AS t FROM w WHERE {hits('win', L.SUPPLIER_TERMS)} > 0
          UNION ALL SELECT src, ticker FROM w WHERE {hits('win', L.CUSTOMER_TERMS)} > 0)
    SELECT 'ASSET:' || s AS source_key, 'ASSET:' || t AS target_key, 'SUPPLIES_TO' AS relationship,
           CAST(least(0.95, 0.45 + 0.08 * count(*)) AS DOUBLE) AS strength, 'SEC_FILING' AS data_source,
           count(*) AS mentions
    FROM e GROUP BY s, t"""


@mplan("kg04_filing_edges", _filing_sql())
def kg04(t):
    """KG-04: supply edges mined from filing texts (substring alias matches)."""
    f = t.filing.select("page_id", "source_ticker", F.concat(T.strip_html("html"), F.col("tail")).alias("text"))
    return G.filing_edges(f, t.asset, key="page_id", substring=True)


def _filing_words_sql() -> str:
    text, word = f"({_strip_sql('html')} || tail)", "'[\\p{L}\\p{N}_]+'"
    run = "OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {} FOLLOWING)"
    grams = " UNION ALL ".join(  # the fixture's names have up to four words
        f"SELECT * FROM (SELECT page_id, {n} AS n, e - length(w) AS st, max(e) {run.format(n - 1)} AS stop,"
        f" string_agg(w, ' ') {run.format(n - 1)} AS gram, count(*) {run.format(n - 1)} AS k FROM wd) WHERE k = {n}" for n in range(1, 5))
    return f"""
    WITH al AS (
        SELECT DISTINCT ticker, array_to_string(ws, ' ') AS gram, len(ws) AS n FROM (
          SELECT ticker, regexp_extract_all(alias, {word}) AS ws FROM (
            SELECT upper(ticker) AS ticker, unnest([lower(ticker), lower(trim(name)),
                   lower(trim(replace(replace(name, 'Corp', ''), 'Corporation', '')))]) AS alias FROM f_asset)
          WHERE alias IS NOT NULL AND alias <> '') WHERE len(ws) > 0),
    f AS (SELECT page_id, upper(source_ticker) AS src, {text} AS x FROM f_filing),
    fw AS (SELECT page_id, regexp_extract_all(x, {word}) AS ws, string_split_regex(x, {word}) AS gs FROM f),
    un AS (SELECT page_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w, unnest(gs[1:len(ws)]) AS g FROM fw),
    wd AS (SELECT page_id, i, w, sum(length(g) + length(w)) OVER (PARTITION BY page_id ORDER BY i) AS e FROM un),
    gr AS ({grams}),
    w AS (SELECT f.src, al.ticker,
                 substr(f.x, CAST(greatest(0, st - {L.FILING_WINDOW}) AS BIGINT) + 1,
                        CAST(least(length(f.x), stop + {L.FILING_WINDOW}) - greatest(0, st - {L.FILING_WINDOW}) AS BIGINT)) AS win
          FROM gr JOIN al USING (n, gram) JOIN f USING (page_id) WHERE f.src <> al.ticker),
    e AS (SELECT ticker AS s, src AS t FROM w WHERE {hits('win', L.SUPPLIER_TERMS)} > 0
          UNION ALL SELECT src, ticker FROM w WHERE {hits('win', L.CUSTOMER_TERMS)} > 0)
    SELECT 'ASSET:' || s AS source_key, 'ASSET:' || t AS target_key, 'SUPPLIES_TO' AS relationship,
           CAST(least(0.95, 0.45 + 0.08 * count(*)) AS DOUBLE) AS strength, 'SEC_FILING' AS data_source,
           count(*) AS mentions
    FROM e GROUP BY s, t"""


@mplan("kg04_filing_edges_words", _filing_words_sql())
def kg04w(t):
    """KG-04: supply edges mined from filing texts (whole-word alias matches)."""
    f = t.filing.select("page_id", "source_ticker", F.concat(T.strip_html("html"), F.col("tail")).alias("text"))
    return G.filing_edges(f, t.asset, key="page_id")


@mplan("kg05_gazetteer", f"""
    SELECT DISTINCT * FROM (
      SELECT 'ORG' AS label, upper(trim(ticker)) AS pattern FROM f_asset WHERE upper(trim(ticker)) <> ''
      UNION ALL SELECT 'ORG', trim(name) FROM f_asset WHERE trim(name) <> ''
      UNION ALL SELECT 'GPE', country FROM f_asset WHERE country IS NOT NULL
      UNION ALL SELECT 'ORG', unnest({'[' + ', '.join(q(x) for x in L.GAZETTEER_EXTRA) + ']'}))""")
def kg05(t):
    """KG-05: gazetteer patterns from assets plus the fixed macro entities."""
    return G.gazetteer(t.asset)


# ---------------------------------------------------------------------------
# event scoring, gates, cards
# ---------------------------------------------------------------------------

_NT = "(SELECT article_id, count(*) AS n FROM o_mentions GROUP BY 1)"
_LOW = f"lower({TEXT})"


def _conf_sql() -> str:
    src = ("CASE WHEN source IS NULL OR source = '' THEN 0.68 "
           + " ".join(f"WHEN contains(lower(source), {q(k)}) THEN {v}" for k, v in L.SOURCE_CREDIBILITY)
           + " ELSE 0.70 END")
    age = f"(epoch_us(TIMESTAMP '{ARTICLE_AS_OF}') - epoch_us(published_at)) / 1e6"
    rec = (f"CASE WHEN published_at IS NULL THEN 0.65 WHEN {age} <= 7200 THEN 0.95 WHEN {age} <= 43200 THEN 0.88 "
           f"WHEN {age} <= 86400 THEN 0.80 WHEN {age} <= 259200 THEN 0.70 WHEN {age} <= 604800 THEN 0.62 ELSE 0.52 END")
    mc = f"least(1.0, 0.42 + {hits(_LOW, L.MARKET_CONTEXT_TERMS)} * 0.07 + least(1.0, n * 0.2))"
    best = "greatest(" + ", ".join(hits(_LOW, kws) for _, kws in L.EVENT_KEYWORDS) + ")"
    base = f"CASE WHEN {best} > 0 THEN least(0.92, 0.45 + {best} * 0.11) ELSE 0.0 END"
    return (f"greatest(0.0, least(0.95, 0.46 * {base} + 0.20 * {src} + 0.16 * {rec} + 0.18 * {mc}"
            f" + 0.02 * least(3, n)))")


def _sev_sql() -> str:
    bias = ("CASE event_type " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in L.SEVERITY_TYPE_BIAS.items())
            + " ELSE 3 END")
    return (f"CAST(greatest(1, least(5, {bias} + least(2, floor({hits(_LOW, L.HIGH_IMPACT_TERMS)} / 2))"
            f" + CAST(confidence >= 0.80 AS INTEGER) + CAST(n >= 3 AS INTEGER))) AS INTEGER)")


def _dir_sql() -> str:
    neg, pos = hits(_LOW, L.NEGATIVE_IMPACT_TERMS), hits(_LOW, L.POSITIVE_IMPACT_TERMS)
    pol = f"(({pos} - {neg}) / greatest(1, {pos} + {neg}))"
    negt, signed = inlist(L.NEGATIVE_TYPES), inlist(L.SIGNED_TYPES)
    return (f"CASE WHEN event_type IN {negt} AND {pol} < 0.35 THEN 'negative' "
            f"WHEN event_type IN {signed} AND {pol} >= 0.20 THEN 'positive' "
            f"WHEN event_type IN {signed} AND {pol} <= -0.20 THEN 'negative' "
            f"WHEN event_type = 'election' AND abs({pol}) >= 0.35 THEN CASE WHEN {pol} > 0 THEN 'positive' ELSE 'negative' END "
            f"WHEN event_type IN {negt} THEN 'negative' ELSE 'neutral' END")


_SCORED = f"""
    SELECT article_id, event_type, n, CAST(confidence AS DOUBLE) AS confidence,
           CASE WHEN confidence >= 0.72 THEN 'auto_approved' WHEN confidence >= 0.55 THEN 'pending_review'
                ELSE 'rejected' END AS status,
           {_sev_sql()} AS severity, {_dir_sql()} AS impact_direction
    FROM (SELECT a.*, coalesce(nt.n, 0) AS n, {best_group(_LOW, L.EVENT_KEYWORDS)} AS event_type,
                 {_conf_sql().replace('least(3, n)', 'least(3, coalesce(nt.n, 0))').replace('n * 0.2', 'coalesce(nt.n, 0) * 0.2')} AS confidence
          FROM f_article a LEFT JOIN {_NT} nt USING (article_id))"""


@mplan("evt01_score_events", _SCORED)
def evt01(t):
    """EVT-01/02/03: composite confidence, status, severity and impact direction of every article."""
    a = t.article.withColumn("_text", T.article_text("title", "content"))
    a = T.prepare_text(a, F.col("_text"))
    nt = _mentions(t).groupBy("article_id").agg(F.count(F.lit(1)).alias("n"))
    a = a.join(nt, "article_id", "left").fillna(0, subset=["n"])
    a = (a.withColumn("_et", T.infer_event_type(low="_t_low"))
         .withColumn("event_type", F.col("_et.event_type"))
         .withColumn("base_confidence", F.when(F.col("_et._h") > 0, F.col("_et._c")).otherwise(0.0)))
    a = EV.score_confidence(a, ARTICLE_AS_OF, n_tickers="n")
    a = (a.withColumn("severity", EV.severity_expr("event_type", "_t_low", "confidence", "n"))
         .withColumn("_sig", T.impact_signal(low="_t_low"))
         .withColumn("impact_direction", EV.direction_expr("event_type", "_sig.polarity")))
    return a.select("article_id", "event_type", "n", "confidence", "status", "severity", "impact_direction")


@mplan("qg01_quality_gates", f"""
    WITH sc AS (SELECT s.*, a.title, a.source, a.url, a.published_at, a.created_at, e.country
                FROM ({_SCORED}) s JOIN f_article a USING (article_id)
                LEFT JOIN (SELECT article_id, {_country_sql_l()} AS country FROM f_article) e USING (article_id)),
         prop AS (SELECT article_id, ticker FROM o_mentions UNION SELECT article_id, ticker FROM o_l2),
         bad AS (SELECT DISTINCT article_id FROM prop WHERE ticker NOT IN (SELECT upper(ticker) FROM f_asset)),
         dup AS (SELECT DISTINCT sc.article_id FROM sc JOIN f_event_article l ON l.article_id = sc.article_id
                 JOIN f_event ev ON ev.event_id = l.event_id
                 WHERE ev.event_type = sc.event_type AND ev.country IS NOT DISTINCT FROM sc.country
                   AND CAST(ev.published_at AS DATE) = CAST(sc.created_at AS DATE))
    SELECT article_id, list_filter([
             CASE WHEN confidence < 0.55 THEN 'confidence_threshold' END,
             CASE WHEN title IS NULL OR title = '' OR event_type IS NULL OR source IS NULL OR source = ''
                       OR url IS NULL OR url = '' THEN 'schema_validation' END,
             CASE WHEN published_at IS NOT NULL AND abs(epoch_us(created_at) - epoch_us(published_at)) / 1e6 > 172800
                  THEN 'temporal_consistency' END,
             CASE WHEN article_id IN (SELECT article_id FROM bad) THEN 'asset_validation' END,
             CASE WHEN article_id IN (SELECT article_id FROM dup) THEN 'duplicate_detection' END],
             lambda x: x IS NOT NULL) AS errors
    FROM sc""")
def qg01(t):
    """QG-01: quality gates per article (event time = created_at, so the
    temporal gate compares two real columns)."""
    s = evt01(t).join(t.article.select("article_id", "title", "source", "url", "published_at", "created_at"),
                      "article_id")
    low = t.article.select("article_id", F.lower(T.article_text("title", "content")).alias("_low"))
    s = s.join(low.select("article_id", T.extract_country(low="_low").alias("country")), "article_id")
    m = _mentions(t)
    proposed = m.unionByName(MP.expand_graph(m, t.kg_edge, key="article_id").select("article_id", "ticker"))
    g = EV.quality_gates(s, t.asset, proposed, t.event, t.event_article, key="article_id",
                         event_time="created_at", article_time="published_at")
    return g.select("article_id", "errors")


@mplan("evt07_event_cards", """
    WITH imp AS (SELECT i.*, a.ticker, a.name FROM f_impact i JOIN f_asset a USING (asset_id)),
         top AS (SELECT event_id, list(ticker ORDER BY rn) AS affected_tickers,
                        list(confidence_score ORDER BY rn) AS affected_confidence
                 FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence_score DESC NULLS FIRST,
                                                    ticker) AS rn FROM imp) WHERE rn <= 5 GROUP BY 1),
         cnt AS (SELECT event_id, count(*) AS impact_count FROM f_impact GROUP BY 1),
         tg AS (SELECT event_id, list(tag ORDER BY tag) AS tags FROM (
                  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tag) AS rn FROM f_tag) WHERE rn <= 8
                GROUP BY 1)
    SELECT e.event_id, e.title, e.event_type, e.country, e.severity, e.confidence_score, e.published_at,
           coalesce(cnt.impact_count, 0) AS impact_count, top.affected_tickers, top.affected_confidence, tg.tags
    FROM f_event e LEFT JOIN cnt USING (event_id) LEFT JOIN top USING (event_id) LEFT JOIN tg USING (event_id)""")
def evt07(t):
    """EVT-07: list cards of every event (impact count, top-5 assets, first 8 tags)."""
    c = EV.event_cards(t.event, t.impact, t.asset, t.tag)
    return c.select("event_id", "title", "event_type", "country", "severity", "confidence_score", "published_at",
                    "impact_count", F.col("affected_assets.ticker").alias("affected_tickers"),
                    F.col("affected_assets.confidence_score").alias("affected_confidence"), "tags")


# ---------------------------------------------------------------------------
# event build and backfills
# ---------------------------------------------------------------------------

def gates_sql() -> str:
    """CTEs ``lg`` (language and relevance) and ``sc`` (scores) of every article."""
    from eventlens.plans.text_plans import _ASCII_RATIO, _TOKS, NORM, _relevance_sql
    return f"""
    WITH lg AS (
      SELECT article_id, CASE WHEN nchar = 0 OR ntok = 0 THEN 'unknown' ELSE 'en' END AS code,
             CASE WHEN nchar = 0 OR ntok = 0 THEN 0.0
                  WHEN ratio >= 0.95 AND ntok >= 3 THEN greatest(c, 0.82) ELSE c END AS lconf,
             rel
      FROM (SELECT *, least(0.92, 0.52 + stop / greatest(1, ntok) * 1.6 + ratio * 0.18) AS c
            FROM (SELECT article_id, length({NORM}) AS nchar, len({_TOKS}) AS ntok,
                         len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) AS stop,
                         {_ASCII_RATIO} AS ratio, CAST({_relevance_sql()} AS DOUBLE) AS rel FROM f_article))),
         sc AS ({_SCORED})"""


def _annot_sql() -> str:
    from eventlens.plans.text_plans import _ASCII_RATIO, _TOKS, NORM, _relevance_sql
    from eventlens.plans.text_sql import hits as h
    nlow = f"lower({NORM})"
    pos, neg = h(nlow, L.SENTIMENT_POSITIVE), h(nlow, L.SENTIMENT_NEGATIVE)
    sent = (f"CASE WHEN length({NORM}) = 0 THEN NULL WHEN {pos} = 0 AND {neg} = 0 THEN 0.0 "
            f"ELSE greatest(-1.0, least(1.0, ({pos} - {neg}) / greatest(1, {pos} + {neg}))) END")
    return f"""
    SELECT article_id, CASE WHEN nchar = 0 OR ntok = 0 THEN 'unknown' ELSE 'en' END AS language_code,
           CAST(CASE WHEN nchar = 0 OR ntok = 0 THEN 0.0
                     WHEN ratio >= 0.95 AND ntok >= 3 THEN greatest(c, 0.82) ELSE c END AS DOUBLE) AS language_confidence,
           rel AS relevance_score, CASE WHEN rel >= 0.58 THEN 'relevant' ELSE 'irrelevant' END AS relevance_label,
           sent AS sentiment_score, TIMESTAMP '{ARTICLE_AS_OF}' AS nlp_processed_at
    FROM (SELECT *, least(0.92, 0.52 + stop / greatest(1, ntok) * 1.6 + ratio * 0.18) AS c FROM (
            SELECT article_id, length({NORM}) AS nchar, len({_TOKS}) AS ntok,
                   len(list_filter({_TOKS}, lambda x: x IN {inlist(L.ENGLISH_STOPWORDS)})) AS stop,
                   {_ASCII_RATIO} AS ratio, CAST({_relevance_sql()} AS DOUBLE) AS rel, {sent} AS sent
            FROM (SELECT * FROM f_article WHERE nlp_processed_at IS NULL)))"""


@mplan("evt05_backfill_metadata", _annot_sql())
def evt05(t):
    """EVT-05: NLP backfill of every unprocessed article."""
    b = EV.backfill_metadata(t.article, ARTICLE_AS_OF, None)
    return b.select("article_id", "language_code", "language_confidence", "relevance_score",
                    "relevance_label", "sentiment_score", "nlp_processed_at")


@mplan("evt06_backfill_entities", f"""
    WITH art_tags AS ({_TAGS_SQL}),
         et AS (SELECT DISTINCT l.event_id, unnest(a.tags) AS tag
                FROM art_tags a JOIN f_event_article l USING (article_id))
    SELECT event_id, tag FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tag) AS rn FROM et)
    WHERE rn <= {L.MAX_TAGS}""")
def evt06(t):
    """EVT-06: re-mapped tags of every event from all its articles."""
    ev = t.event.withColumn("event_id", F.col("event_id"))
    return EV.backfill_entities(ev, t.event_article, t.article, t.asset, t.kg_edge, t.impact, n=None)["tags"]


@mplan("evt06_backfill_impacts", f"""
    WITH em AS (SELECT DISTINCT l.event_id, m.ticker FROM o_mentions m JOIN f_event_article l USING (article_id)),
         l2 AS (
           SELECT p.event_id, p.ticker, max(p.score) AS score FROM (
             SELECT event_id, substr(node, 7) AS ticker, score FROM (
               SELECT r.event_id, a.dst AS node, a.w * {L.L2_HOP1_WEIGHT} AS score
               FROM em r JOIN o_adj a ON a.src = 'ASSET:' || r.ticker
               UNION ALL
               SELECT r.event_id, b.dst, a.w * b.w * {L.L2_HOP2_WEIGHT}
               FROM em r JOIN o_adj a ON a.src = 'ASSET:' || r.ticker JOIN o_adj b ON b.src = a.dst)
             WHERE starts_with(node, 'ASSET:')) p
           LEFT JOIN em m ON m.event_id = p.event_id AND m.ticker = p.ticker
           WHERE m.ticker IS NULL GROUP BY 1, 2),
         l3 AS (
           SELECT s.event_id, mb.ticker, max(least(1.0, {L.L3_BASE_WEIGHT} * 0.7)) AS score
           FROM (SELECT DISTINCT r.event_id, a.sector FROM em r JOIN f_asset a ON upper(a.ticker) = r.ticker
                 WHERE a.sector IS NOT NULL) s
           JOIN o_members mb ON mb.sector = s.sector
           LEFT JOIN em m ON m.event_id = s.event_id AND m.ticker = mb.ticker
           WHERE m.ticker IS NULL GROUP BY 1, 2),
         u AS (SELECT event_id, ticker, CAST(NULL AS DOUBLE) AS score, 1 AS layer FROM em
               UNION ALL SELECT event_id, ticker, score, 2 FROM l2
               UNION ALL SELECT event_id, ticker, score, 3 FROM l3),
         f AS (SELECT event_id, ticker, arg_min(score, layer) AS score, min(layer) AS layer FROM u GROUP BY 1, 2),
         p AS (SELECT event_id, coalesce(CASE WHEN confidence_score <> 0 THEN confidence_score END, 0.6) AS conf,
                      CASE WHEN event_type IN {inlist(L.NEGATIVE_TYPES)} THEN 'negative' ELSE 'neutral' END AS dir
               FROM f_event)
    SELECT f.event_id, a.asset_id, f.ticker, f.layer, p.dir AS impact_direction,
           greatest(0.0, least(1.0, CASE WHEN f.layer = 1 THEN 0.6 ELSE f.score END)) AS impact_strength,
           greatest(0.0, least(1.0, CASE WHEN f.layer = 1 THEN (p.conf + 0.7) / 2
                                         ELSE (p.conf + 0.7) / 2 * f.score END)) AS confidence_score
    FROM f JOIN f_asset a ON upper(a.ticker) = f.ticker JOIN p USING (event_id)
    WHERE NOT EXISTS (SELECT 1 FROM f_impact x WHERE x.event_id = f.event_id AND x.asset_id = a.asset_id)""")
def evt06b(t):
    """EVT-06: new impacts of every event from all its articles."""
    return EV.backfill_entities(t.event, t.event_article, t.article, t.asset, t.kg_edge, t.impact, n=None)["impacts"]
