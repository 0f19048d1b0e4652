"""Token files (2), packing (6), archives (7), embeddings (10), and the pipeline."""
import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001

from eventlens.llm.embedding_links import MultiIndex, embedding_links
from eventlens.llm.packing import WINDOW, deal, differencing, pack_report
from eventlens.llm.token_files import pack_ranks, token_file_report, unpack_ranks
from eventlens.llm.token_ids import ChunkEncoder
from eventlens.llm.warc import archive_report, index_captures, lookup, read_archives, write_archives

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_chunks_give_the_librarys_ids(path):
    rng = random.Random(0)
    marks = list("ab .,\n\t'#é1s!<|> 　İ")
    texts = ["", "  a  b", "a\n\nb", "a \n b", "The.\nTo x ", "\n", "a\tb c", "don't it's we'LL, x's.,", "<|endoftext|> a<|endoftext|>b",
             "Σας ΟΔΟΣ. İstanbul", "a\x1cb \x85 c", "é ́x", "日本 語。 ー", "x\r\ny z\r\n\r\n w", "ﬁ ǅ ẞ", "tail  \n"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["A" * 40 + ", " + "long" * 30 + ".", "<|ENDOFTEXT|> Ab", None, "x" * 5000, "ÀÉ., é, ×. a\x01 b"]
    enc = ChunkEncoder(path, max_chunks=700, piece=300)  # a memory that is emptied often
    whole = [e.ids for e in enc.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    got = []
    for row, end, ids, ends in enc.encode(pa.array(texts, pa.string()), max_bytes=3000):
        assert row == len(got) and end - row == len(ends)
        got += [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == whole


def test_ranks_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = rng.integers(0, 1 << rng.integers(1, 31), n).astype(np.uint32)
        assert (unpack_ranks(*pack_ranks(ranks), n) == ranks).all()


def _ids(path, text, end):
    from tokenizers import Tokenizer
    return np.array(Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").withColumn("path", F.lit("x")).withColumn("ids", F.lit(1))


def test_token_files_documents(spark, docs):
    at = 0
    got = {r.doc_id: r for r in token_file_report(docs, WORD).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = _ids(WORD, r.text, 2)
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


ODD = "select * from values (2,null),(1,''),(cast(null as bigint),'x y'),(1,'b') as t(doc_id,text)"


def test_token_files_odd_rows(spark):
    got = sorted(((r.start, r.doc_id, r.n_tokens) for r in token_file_report(spark.sql(ODD), WORD).collect()), key=str)
    assert got == [(0, None, 3), (3, 1, 1), (4, 1, 2), (6, 2, 1)]
    assert token_file_report(spark.sql(ODD).limit(0), WORD).count() == 0


def test_packing_documents(spark, docs):
    rows = pack_report(docs, BYTE).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids, at = _ids(BYTE, texts[d], 1), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= WINDOW
    tokens = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.03 * tokens / WINDOW + 8 * 2


def test_packing_odd_rows(spark):
    assert sorted(r.length for r in pack_report(spark.sql(ODD), BYTE).collect()) == [1, 1, 2, 3]
    assert pack_report(spark.sql(ODD).limit(0), BYTE).count() == 0


def test_packing_very_many_tiny_texts(spark):
    import time
    df = spark.range(600_000, numPartitions=1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b").otherwise("").alias("text"))
    began = time.time()
    r = pack_report(df, BYTE).agg(F.sum("length").alias("n"), F.count_distinct("sequence_id").alias("k"), F.count_distinct("doc_id").alias("d")).first()
    assert r.n == 1_000_000 and r.d == 600_000 and r.k <= 1.01 * r.n / WINDOW + 2
    assert time.time() - began < 120


def test_differencing_balances_and_capacity_raises_windows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 600)
    sums = np.bincount(differencing(sizes, 16), sizes, 16)
    assert sums.max() - sums.min() <= 16 and sums.sum() == sizes.sum()
    to, windows = deal(np.full(3, 2000))
    assert windows == 3 and sorted(to) == [0, 1, 2]


def _captures(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    return sorted(((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                    "response" if i is None or i == first[h or ""] else "revisit",
                    None if i is None or i == first[h or ""] else first[h or ""]) for i, _, h in rows), key=str)


def test_archives_read_back(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    want = _captures([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert sorted((tuple(r) for r in archive_report(pages).collect()), key=str) == want


def test_archives_odd_rows_and_lookup(spark):
    rows = [(1, "http://a.com/x", "q"), (2, None, "q"), (3, "junk", None), (4, "", ""), (5, "https://B.a.com:80/z?1#f", "é" * 100),
            (5, "https://B.a.com:80/z?1#f", "é" * 100), (6, "http://a.com/x", "w\r\n\r\nw"), (7, "http://a.com/\r\ny", "w" * 300_000), (None, "u", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit(2))
    directory = index_captures(write_archives(df))
    assert sorted((tuple(r) for r in read_archives(directory).collect()), key=str) == _captures(rows)
    found = {(r.page_id, bytes(r.payload)) for r in lookup(directory, ["http://a.com/x", "https://b.a.com/z?1", "http://none"]).collect()}
    assert found == {(1, b"q"), (6, b"w\r\n\r\nw"), (5, ("é" * 100).encode())}
    assert {r.record_type for r in archive_report(df, min_bytes=10_000_000).collect()} == {"response"}
    assert archive_report(df.limit(0)).count() == 0


def _linked(ids, x, cosine=0.9):
    s = x @ x.T >= cosine
    np.fill_diagonal(s, False)
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(s, label[None, :], 1 << 60).min(1))
        if (low == label).all():
            return s.sum(1), label
        label = low


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16))
    x[:400] = x[0] + rng.standard_normal((400, 16)) * 0.12 * np.linalg.norm(x[0]) / 4   # a group about the threshold
    x[400:600] = x[400]
    rows = [(i * 3, v.tolist(), 0) for i, v in enumerate(x)]
    got = {r.vec_id: r for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    links, label = _linked(np.arange(1500) * 3, x / np.linalg.norm(x, axis=1)[:, None])
    found = np.array([got[i * 3].n_links for i in range(1500)])
    assert found.sum() >= 0.98 * links.sum() and (found <= links).all()
    assert np.mean([got[i * 3].component_id == label[i] for i in range(1500)]) > 0.98


def test_embeddings_of_several_lengths(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for k, (n, d) in enumerate([(900, 16), (700, 8), (3, 1)]):
        x = rng.standard_normal((n, d))
        x[n // 2:n // 2 + n // 3] = x[0]
        ids = np.arange(n) * 3 + k
        links, label = _linked(ids, x / np.linalg.norm(x, axis=1)[:, None])
        rows += [(int(i), v.tolist()) for i, v in zip(ids, x)]
        want |= {int(i): (int(a), int(b)) for i, a, b in zip(ids, links, label)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    for k, low in enumerate([0.98, 0.98, 1.0]):
        ids = [i for i in want if i % 3 == k]
        assert sum(got[i][0] for i in ids) >= low * sum(want[i][0] for i in ids) and all(got[i][0] <= want[i][0] for i in ids)
        assert np.mean([got[i][1] == want[i][1] for i in ids]) >= low


def test_traversal_visits_the_nearest_cells():
    rng = np.random.default_rng(6)
    index = MultiIndex(rng.standard_normal((9, 4)), rng.standard_normal((9, 4)), 20)
    x = rng.standard_normal((50, 8))
    grid = index.grid(x)
    for cells, d in zip(index.traverse(x), grid):
        assert np.allclose(d[cells], np.sort(d)[:20])


def test_embeddings_odd_rows(spark):
    rows = [(1, [1., 0., 0.]), (2, [1., 0., 0.]), (2, [1., 0., 0.]), (3, [2., 0., 0.]), (4, None), (5, [0., 0., 0.]), (6, [float("nan"), 1., 0.]),
            (7, [1., None, 0.]), (8, [.9, .435, 0.]), (9, [1., 0.]), (None, [1., 0., 0.]), (10, [0., 0., 1e-200]), (11, [0., 0., 1e200]), (12, []),
            (13, [float("inf"), 0., 0.])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("copies", F.lit(1)).withColumn("id", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_links(df).collect()}
    assert got[1] == (3, 1, True) and got[2] == got[3] == got[8] == (3, 1, False)
    assert got[10] == (1, 10, True) and got[11] == (1, 10, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 9, 12, 13))
    assert embedding_links(df.limit(0)).count() == 0
    assert embedding_links(df.filter("vec_id = 4")).count() == 1


def test_pipeline_keeps_clean_documents(spark, tmp_path):
    import corpus_pipeline
    src = spark.read.parquet(f"{SF001}/documents.parquet")
    src.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF001}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    import brute
    rows = [(r.doc_id, r.text) for r in src.collect()]
    kept = {i for i, c in brute.classes(rows).items() if i == c}
    items = [r.text for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = {i for i, t in rows if i in kept and not any(v in (t or "") for v in items) and any(c.isalpha() for c in t or "")}
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert got == want
