"""Spelling variants (11) against plain versions."""
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001

from eventlens.llm.spelling import PositionIndex, corpus_words, near_words, variant_groups


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)):] == b[p + 1:]


def counted(rows, every=31):
    total = {}
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc}:{w}".encode())
            if doc is not None and h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            total[w] = total.get(w, 0) + 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def grouped(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w
    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def rows_of(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_index_sets_match_plain_comparison():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randint(1, 5))) for _ in range(150)})
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    index = PositionIndex(letters, np.append(0, np.cumsum([len(w) for w in words])))
    replaced, inside, at_end, less = (np.unpackbits(x.view(np.uint8), axis=1, bitorder="little")[:, :len(words)].astype(bool)
                                      for x in index.one_error(np.arange(len(words))))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            near = one_apart(a, b)
            assert replaced[i, j] == (near and len(a) == len(b))
            assert (inside | at_end)[i, j] == (near and len(a) + 1 == len(b))
            assert at_end[i, j] == (near and len(a) + 1 == len(b) and b.startswith(a))
            assert less[i, j] == (near and len(a) - 1 == len(b))


@pytest.mark.parametrize("block", [4096, 4])
def test_near_words_each_pair_once(spark, block):
    rng = random.Random(5)
    words = sorted({"comm" * (k % 3 == 0) + "".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for k in range(600)})
    got = near_words(spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n bigint"), block).collect()
    want = {(a, b, j) for a in words for j, b in enumerate(words) if one_apart(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_variants_of_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("word", F.lit("k")).withColumn("n", F.lit(1))
    words = counted([(r.doc_id, r.text) for r in docs.collect()])
    assert rows_of(variant_groups(corpus_words(docs, 31))) == grouped(words)


def test_chains_nulls_repeats_and_long_texts(spark):
    texts = ["corrections " * 1000 + "Corection " * 100, "corecton " * 10 + "correction " * 1000, "coreton " * 2, None, "", "éÉ×÷ÿÀÀ " * 3,
             "x" * 3_000_000 + " " + "x" * 3_000_000, ("letters " * 300_000) + "letterz", "letterz", "Ångström ångström ANGSTRÖM"]
    rows = [(i if i != 1 else None, t) for i, t in enumerate(texts)] + [(2, texts[2])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(variant_groups(corpus_words(df, 31))) == grouped(counted(rows))
    got = {r.word: r for r in variant_groups(spark.createDataFrame(
        [("correction", 1000), ("corection", 100), ("corecton", 10), ("coreton", 1)], "word string, n bigint")).collect()}
    assert {w: r.root for w, r in got.items()} == dict.fromkeys(got, "correction") and got["coreton"].form == "corecton"
    assert variant_groups(corpus_words(df.limit(0))).count() == 0
