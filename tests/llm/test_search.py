"""Ranked lexical search (13) against a plain version and SQL."""
import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from conftest_paths import SF001, SF01

from eventlens.llm.lexical_search import Treap, build_index, ranked_search, search, statistics


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=20):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b, b.total()) for i, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for i, b, size in bags:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if b[t])
            if s > 0 and i is not None:
                scored.append((-s, i))
        out += [(item, k + 1, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_cells_round_trip_and_descent():
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (5, 300), (700, 9), (64, 64)):
        place = rng.choice(shape[0] * shape[1], min(shape[0] * shape[1], 400), replace=False)
        r, c, v = place // shape[1], place % shape[1], rng.integers(1, 1 << 20, len(place))
        treap = Treap.decode(*Treap.encode(r, c, v))
        full = np.zeros(shape, np.int64)
        full[r, c] = v
        assert treap.maxima[0] == v.max()
        for _ in range(5):
            asked = rng.choice(shape[0], min(shape[0], 3), replace=False)
            w = rng.integers(1, 5, len(asked))
            want = np.sort((full[asked] * w[:, None]).sum(0))[::-1][:7]
            best = []

            def offer(s, _):
                best[:] = sorted(best + s.tolist(), reverse=True)[:7]
                return best[-1] if len(best) == 7 else 1
            treap.best(asked, w, 1, offer)
            assert best == [x for x in want.tolist() if x]


def test_documents_match_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("item_id", F.lit(1)).withColumn("rank", F.lit("k"))
    items = spark.read.parquet(f"{SF001}/benchmark.parquet").withColumn("doc_id", F.lit(1))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert rows(ranked_search(docs, items)) == want
    n, total = statistics(docs)
    index = build_index(docs, n, total, block_bytes=20_000, block_docs=7)  # many small blocks, and groups of items
    assert index.count() > 10
    assert rows(search(index, items, n, max_item_bytes=2000)) == want


def test_cases_match_plain_version(spark):
    rng = random.Random(8)
    words = ["Über", "a1", "x", "the", "éé", "日本", "zz" * 30]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(60)]
    docs += [(5, "the x"), (5, "the x"), (None, "x the a1"), (7, None), (8, ""), (9, ",.;"), (70, "b" * 3_000_000 + " x"), (71, "x, " * 1_200_000)]
    items = [(1, "THE x the"), (1, "THE x the"), (2, None), (3, "nothing here"), (4, "über Über éé 日本"), (None, "a1 " * 50), (5, ""), (6, "b" * 3_000_000)]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert rows(ranked_search(d, b)) == plain(docs, items)
    assert ranked_search(d.limit(0), b).count() == 0 and ranked_search(d, b.limit(0)).count() == 0


def test_sql_gives_the_same_rows(spark):
    from eventlens.llm.registry import oracle_sql, queries
    from eventlens.plans.check import compare
    r = compare(spark, SF01, "op13_search", queries()["op13_search"], oracle_sql()["op13_search"])
    assert r["status"] == "match", r


def test_row_groups_of_the_index_are_bounded(spark, monkeypatch):
    """A reader decodes a row group together: a file of one large group took more than an executor's heap."""
    import glob

    import pyarrow.parquet as pq
    from eventlens.llm import lexical_search as LS
    monkeypatch.setattr(LS, "GROUP_BYTES", 1 << 15)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 200), i -> hex(xxhash64(id, i)))) AS text")
    n_docs, terms = LS.statistics(docs)
    index = LS.build_index(docs, n_docs, terms, block_bytes=1 << 15)
    assert (n_docs, terms) == (400, 80000)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert sum(m.num_rows for m in groups) > 20
    assert max(m.row_group(k).num_rows for m in groups for k in range(m.num_row_groups)) == 1
