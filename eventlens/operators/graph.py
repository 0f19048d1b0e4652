"""Knowledge-graph construction (KG-01..05): nodes and edges as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import lexicons as L
from eventlens.functions import text as T
from eventlens.functions.phrases import PhraseFilter, let, running_sums


def node_key(entity_type, name):
    return F.concat(F.lit(entity_type) if isinstance(entity_type, str) else entity_type, F.lit(":"), name)


def seed_graph(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG-01: ASSET (named by upper ticker), SECTOR and COUNTRY nodes and
    PART_OF edges asset -> sector / country at 0.9 (data source MANUAL)."""
    a = assets.select(F.upper("ticker").alias("ticker"), "name", "asset_type", "sector", "country")
    asset_nodes = a.select(node_key("ASSET", F.col("ticker")).alias("entity_key"), F.lit("ASSET").alias("entity_type"),
                           F.col("ticker").alias("name"),
                           F.create_map(F.lit("display_name"), F.col("name"), F.lit("asset_type"),
                                        F.col("asset_type")).alias("metadata"))
    other = []
    for kind, c in (("SECTOR", "sector"), ("COUNTRY", "country")):
        other.append(a.where(F.col(c).isNotNull()).select(
            node_key(kind, F.col(c)).alias("entity_key"), F.lit(kind).alias("entity_type"), F.col(c).alias("name"))
            .distinct().withColumn("metadata", F.create_map(F.lit("source"), F.lit("assets_table"))))
    nodes = asset_nodes.unionByName(other[0]).unionByName(other[1])
    edges = None
    for kind, c in (("SECTOR", "sector"), ("COUNTRY", "country")):
        e = a.where(F.col(c).isNotNull()).select(
            node_key("ASSET", F.col("ticker")).alias("source_key"), node_key(kind, F.col(c)).alias("target_key"),
            F.lit("PART_OF").alias("relationship"), F.lit(L.KG_SEED_STRENGTH).alias("strength"),
            F.lit("MANUAL").alias("data_source"), F.lit(None).cast("date").alias("last_verified"))
        edges = e if edges is None else edges.unionByName(e)
    return nodes, edges.distinct()


def merge_metadata(old, new):
    """KG-02 metadata merge: keys of ``new`` with non-NULL values override."""
    empty = F.create_map().cast("map<string,string>")
    newf = F.coalesce(F.map_filter(new, lambda k, v: v.isNotNull()), empty)
    keep = F.map_filter(F.coalesce(old, empty), lambda k, v: ~F.array_contains(F.map_keys(newf), k))
    return F.map_concat(keep, newf)


def apply_profiles(nodes: DataFrame, edges: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KG-02: enrich the graph from company profiles (ticker, company,
    industry, country): ASSET nodes get display_name/source merged (NULLs
    ignored) or are created, SECTOR/COUNTRY nodes are created, PART_OF edges at
    0.78 (industry) and 0.86 (country) with data source WIKIDATA are upserted."""
    p = profiles.where(F.col("ticker").isNotNull() & (F.col("ticker") != "")).select(
        F.upper("ticker").alias("ticker"), "company", "industry", "country")
    patch = p.select(node_key("ASSET", F.col("ticker")).alias("entity_key"), F.col("ticker").alias("name"),
                     F.create_map(F.lit("display_name"), F.col("company"), F.lit("source"), F.lit("wikidata"))
                     .alias("_patch"))
    # one patch per ticker; several profile rows for a ticker resolve to the
    # largest company label (a deterministic stand-in for "last row wins")
    patch = patch.groupBy("entity_key", "name").agg(F.max_by("_patch", F.col("_patch")["display_name"]).alias("_patch"))
    n = nodes.alias("n").join(patch.alias("p"), "entity_key", "full_outer")
    merged = n.select("entity_key",
                      F.coalesce(F.col("n.entity_type"), F.lit("ASSET")).alias("entity_type"),
                      F.coalesce(F.col("n.name"), F.col("p.name")).alias("name"),
                      F.when(F.col("p._patch").isNull(), F.col("n.metadata"))
                       .otherwise(merge_metadata(F.col("n.metadata"), F.col("p._patch"))).alias("metadata"))
    extra_nodes = []
    new_edges = []
    for kind, c, w in (("SECTOR", "industry", L.KG_PROFILE_SECTOR_STRENGTH),
                       ("COUNTRY", "country", L.KG_PROFILE_COUNTRY_STRENGTH)):
        q = p.where(F.col(c).isNotNull() & (F.col(c) != ""))
        extra_nodes.append(q.select(node_key(kind, F.col(c)).alias("entity_key"), F.lit(kind).alias("entity_type"),
                                    F.col(c).alias("name")).distinct()
                           .withColumn("metadata", F.create_map(F.lit("source"), F.lit("wikidata"))))
        new_edges.append(q.select(node_key("ASSET", F.col("ticker")).alias("source_key"),
                                  node_key(kind, F.col(c)).alias("target_key"), F.lit("PART_OF").alias("relationship"),
                                  F.lit(w).alias("strength"), F.lit("WIKIDATA").alias("data_source"),
                                  F.lit(None).cast("date").alias("last_verified")))
    allnodes = (merged.withColumn("_pr", F.lit(0)).unionByName(extra_nodes[0].withColumn("_pr", F.lit(1)))
                .unionByName(extra_nodes[1].withColumn("_pr", F.lit(1))))
    # existing (merged) nodes keep their metadata; new ones are added once
    allnodes = (allnodes.groupBy("entity_key")
                .agg(F.min_by(F.struct("entity_type", "name", "metadata"), "_pr").alias("_n"))
                .select("entity_key", "_n.*"))
    return allnodes, upsert_edges(edges, new_edges[0].unionByName(new_edges[1]))


def upsert_edges(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """KG-03: edge upsert on (source, target, relationship, data_source):
    the new row replaces strength and last_verified (last write wins;
    ``order`` ranks several new rows for one key, newest last)."""
    k = ["source_key", "target_key", "relationship", "data_source"]
    o = old.withColumn("_v", F.lit(0)).withColumn("_o", F.lit(0))
    n = new.withColumn("_v", F.lit(1)).withColumn("_o", F.col(order) if order else F.lit(0))
    u = o.unionByName(n, allowMissingColumns=True)
    cols = [c for c in old.columns if c not in k]
    last = (u.groupBy(*k).agg(F.max_by(F.struct(*cols), F.struct("_v", "_o")).alias("_r"))
            .select(*k, "_r.*"))
    return last


def filing_aliases(assets: DataFrame) -> DataFrame:
    """KG-04 alias list per ticker: ticker, name, name without Corp/Corporation
    (lower-cased, trimmed, distinct)."""
    a = assets.select(F.upper("ticker").alias("ticker"), "name")
    cands = F.array(F.lower("ticker"), F.lower(F.trim("name")),
                    F.lower(F.trim(F.replace(F.replace("name", F.lit("Corp"), F.lit("")),
                                             F.lit("Corporation"), F.lit("")))))
    return (a.select("ticker", F.explode(cands).alias("alias"))
            .where(F.col("alias").isNotNull() & (F.col("alias") != "")).distinct())


# A word of a filing or an alias.
WORD = r"[\p{L}\p{N}_]+"


def filing_edges(filings: DataFrame, assets: DataFrame, *, text: str = "text",
                 source: str = "source_ticker", key: str = "filing_id", substring: bool = False) -> DataFrame:
    """KG-04: supply-chain edges from filing text (already HTML-stripped and
    lower-cased). Every occurrence of another company's alias opens a +-180
    character window; supplier terms add (target -> source), customer terms
    add (source -> target); strength = min(0.95, 0.45 + 0.08 * count).

    An occurrence is a run of whole words equal to the alias's words: the
    filing's word n-grams that may be aliases are joined to them by equality.
    ``substring=True`` also matches inside words (left to right,
    non-overlapping), with substrings in the place of n-grams."""
    find = _substring_hits if substring else _word_hits
    f = filings.select(F.col(key).alias("_fid"), F.upper(source).alias("src"), F.coalesce(F.col(text), F.lit("")).alias("_x"))
    hits, al = find(f, filing_aliases(assets))
    # An alias may be many companies': a filing company's hits are counted before they meet them.
    per = hits.groupBy("src", "gram").agg(F.sum(F.col("sup").cast("bigint")).alias("sup"), F.sum(F.col("cus").cast("bigint")).alias("cus"))
    occ = per.join(al, "gram").where("src <> ticker")
    both = F.filter(F.array(F.struct(F.col("ticker").alias("s"), F.col("src").alias("t"), F.col("sup").alias("n")),
                            F.struct(F.col("src").alias("s"), F.col("ticker").alias("t"), F.col("cus").alias("n"))), lambda e: e["n"] > 0)
    cnt = occ.select(F.explode(both).alias("e")).groupBy("e.s", "e.t").agg(F.sum("e.n").alias("mentions"))
    return cnt.select(node_key("ASSET", F.col("s")).alias("source_key"), node_key("ASSET", F.col("t")).alias("target_key"),
                      F.lit("SUPPLIES_TO").alias("relationship"),
                      F.least(F.lit(0.95), 0.45 + 0.08 * F.col("mentions")).alias("strength"),
                      F.lit("SEC_FILING").alias("data_source"), "mentions")


def _window_text(start, end):
    lo = F.greatest(F.lit(0), start - L.FILING_WINDOW).cast("int")
    return F.substring("_x", lo + 1, F.least(F.length("_x"), end + L.FILING_WINDOW).cast("int") - lo)


def _hit(gram, win):
    """An occurrence as it leaves its row: what its window says, not the window."""
    named = lambda terms: F.greatest(*[win.contains(t) for t in terms])
    return F.struct(gram.alias("gram"), named(L.SUPPLIER_TERMS).alias("sup"), named(L.CUSTOMER_TERMS).alias("cus"))


def _leaving(f: DataFrame, hits) -> DataFrame:
    """(src, gram, sup, cus). The outer explode has no filter that the optimizer
    would derive from a plain one, so a row's hits are found once; the join
    with the aliases drops the rows without a hit."""
    return f.select("src", F.explode_outer(F.filter(hits, lambda h: h["sup"] | h["cus"])).alias("h")).select("src", "h.*")


def _word_hits(f: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, gram, sup, cus) of whole-word occurrences, and (gram, ticker). A
    filing's words, their places and the n-grams that may be aliases are found
    inside its row; only those leave it."""
    words = F.regexp_extract_all("alias", F.lit(WORD), F.lit(0))
    al = aliases.select("ticker", words.alias("words")).where(F.size("words") > 0).distinct()
    known = PhraseFilter.of(al)
    kind = "array<struct<gram:string,sup:boolean,cus:boolean>>"

    def found(w):
        gaps = F.slice(F.split("_x", WORD, -1), F.lit(1), F.size(w))
        lengths = F.zip_with(gaps, w, lambda gap, word: (F.length(gap) + F.length(word)).cast("bigint"))
        start = lambda ends, g: F.get(ends, g["at"] - 1) - F.length(F.get(w, g["at"] - 1))
        stop = lambda ends, g: F.get(ends, g["at"] + g["n"] - 2)
        placed = lambda gs: let(running_sums(lengths), lambda ends: F.transform(gs, lambda g: let(
            _window_text(start(ends, g), stop(ends, g)), lambda win: _hit(g["gram"], win))))
        return let(known.grams(w), lambda gs: F.when(F.size(gs) > 0, placed(gs)).otherwise(F.array().cast(kind)))

    # Each step is bound once inside the row: a filter that the optimizer derives from it can't repeat it per word.
    hits = _leaving(f, let(F.regexp_extract_all("_x", F.lit(WORD), F.lit(0)), found))
    return hits, al.select("ticker", F.array_join("words", " ").alias("gram"))


#: Code points of an alias's head: longer aliases are looked for only where a known head stands.
HEAD = 4


def _substring_hits(f: DataFrame, al: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, gram, sup, cus) of occurrences anywhere, and (gram, ticker). The
    aliases that may occur in a text are found inside its row with their
    places: its substrings of an alias's length are sifted by bitmaps, from
    ``HEAD`` code points on only where an alias's head stands. A longer
    substring is put together from those of ``HEAD`` code points, so that it
    costs the same at the end of a long text as at its beginning."""
    known = PhraseFilter.of(al.select(F.array("alias").alias("words")))
    heads = PhraseFilter.of(al.where(F.length("alias") >= HEAD).select(F.array(F.substring("alias", 1, HEAD)).alias("words")))
    lengths = sorted(r[0] for r in al.select(F.length("alias")).distinct().collect())
    # The substrings of n code points, one from each place (the last n - 1 places have none).
    cut = lambda n: F.regexp_extract_all("_x", F.lit(f"(?s)(?=(.{{{n}}})).")  , F.lit(1))
    places = lambda c: F.when(F.size(c) > 0, F.sequence(F.lit(1), F.size(c))).otherwise(F.array().cast("array<int>"))
    at = lambda gram, i, n: F.struct(gram.alias("gram"), i.alias("at"), F.lit(n).alias("n"))

    def whole(h, i, n):
        rest = n % HEAD
        parts = [F.get(h, i + (HEAD * k - 1)) for k in range(n // HEAD)]
        return F.concat(*parts, *([F.substring(F.get(h, i + (n - HEAD - 1)), HEAD - rest + 1, rest)] if rest else []))

    def at_heads(h):
        starts = F.filter(places(h), lambda i: heads.may_be(F.get(h, i - 1)))
        return F.flatten(F.transform(starts, lambda i: F.filter(F.array(*[at(whole(h, i, n), i, n) for n in long]), lambda p: known.may_be(p["gram"]))))

    def at_all(n):
        return let(cut(n), lambda c: F.transform(F.filter(places(c), lambda i: known.may_be(F.get(c, i - 1))), lambda i: at(F.get(c, i - 1), i, n)))

    found = [at_all(n) for n in lengths if n < HEAD]
    long = [n for n in lengths if n >= HEAD]
    if long:
        found.append(let(cut(HEAD), at_heads))
    if not found:
        return f.select("src", F.lit("").alias("gram"), F.lit(False).alias("sup"), F.lit(False).alias("cus")).limit(0), al.withColumnRenamed("alias", "gram")
    hits = let(_apart(F.concat(*found)), lambda ps: F.transform(ps, lambda p: let(
        _window_text(p["at"] - 1, p["at"] + p["n"] - 1), lambda win: _hit(p["gram"], win))))
    return _leaving(f, hits), al.withColumnRenamed("alias", "gram")


def _apart(found):
    """Of occurrences (gram, at, n) that overlap one of the same alias the first
    from the left, as a split on the alias finds them."""
    near = lambda ps, i: (F.get(ps, i)["gram"] == F.get(ps, i - 1)["gram"]) & (F.get(ps, i)["at"] < F.get(ps, i - 1)["at"] + F.get(ps, i)["n"])
    kind = "array<struct<gram:string,at:int,n:int>>"

    def step(kept, p):
        return let(F.get(kept, F.size(kept) - 1), lambda last: F.when((last["gram"] == p["gram"]) & (p["at"] < last["at"] + p["n"]), kept)
                   .otherwise(F.concat(kept, F.array(p))))

    def of(ps):
        places = F.when(F.size(ps) > 1, F.sequence(F.lit(1), F.size(ps) - 1)).otherwise(F.array().cast("array<int>"))
        return F.when(F.exists(places, lambda i: near(ps, i)), F.aggregate(ps, F.array().cast(kind), step)).otherwise(ps)

    return let(F.array_sort(found.cast(kind)), of)


def gazetteer(assets: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """KG-05: (label, pattern) entity patterns — ORG for tickers and names,
    GPE for countries; ``extra`` rows are appended; distinct."""
    a = assets.select(F.upper(F.trim("ticker")).alias("t"), F.trim("name").alias("name"), "country")
    g = (a.where(F.col("t") != "").select(F.lit("ORG").alias("label"), F.col("t").alias("pattern"))
         .unionByName(a.where(F.col("name") != "").select(F.lit("ORG").alias("label"), F.col("name").alias("pattern")))
         .unionByName(a.where(F.col("country").isNotNull()).select(F.lit("GPE").alias("label"),
                                                                   F.col("country").alias("pattern"))))
    if extra is None:
        extra = assets.sparkSession.createDataFrame([("ORG", t) for t in L.GAZETTEER_EXTRA],
                                                    "label string, pattern string")
    g = g.unionByName(extra.select("label", "pattern"))
    return g.distinct()
