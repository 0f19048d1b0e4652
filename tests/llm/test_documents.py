"""Whole-text operators: decontamination (3), near copies (5), language (8), repeats (9)."""
import random

from pyspark.sql import functions as F

import brute
from conftest_paths import SF001, SF01

from eventlens.llm.decontaminate import banded_alignment, drop_leaked, find_leaks
from eventlens.llm.language import identify, keep_identified
from eventlens.llm.near_copies import drop_near_copies, near_copies
from eventlens.llm.repeats import repeats_report


def _edited(text, n, rng):
    s = list(text)
    for _ in range(n):
        p, k = rng.randrange(len(s)), rng.random()
        if k < 1 / 3:
            s[p] = rng.choice("abcdefgh")
        elif k < 2 / 3:
            del s[p]
        else:
            s.insert(p, rng.choice("abcdefgh"))
    return "".join(s)


def test_leaks_exact_and_edited(spark):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    bench = spark.read.parquet(f"{SF01}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    items = {r.item_id: r.text for r in bench.collect()}
    exact = {(d, i) for d, t in texts.items() for i, v in items.items() if v in (t or "")}
    got = {(r.doc_id, r.item_id): r for r in find_leaks(docs, bench).collect()}
    assert set(got) == exact and all(r.edits == 0 for r in got.values())
    planted = [(k, texts[rng.randrange(900)][:2000] + " " + _edited(v, int(len(v) * rate), rng) + " tail", i)
               for k, (i, v, rate) in enumerate((i, v, rate) for i, v in items.items() for rate in (0.02, 0.05))]
    found = {(r.doc_id, r.item_id) for r in find_leaks(spark.createDataFrame(planted, "doc_id long, text string, item_id long"), bench).collect()}
    assert {(k, i) for k, _, i in planted} <= found


def test_leaks_odd_rows(spark):
    item = "The quick brown fox jumps over the lazy dog while the band plays on and on"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "short"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item.upper().replace(" ", "  ") + "! y"), (1, item), (2, None), (3, ""), (None, item + " " * 9), (5, "y" * 50_000)],
                                 "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = [(r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(d, i, 0) for d in (1, 1, None) for i in (1, None)], key=str)
    assert {r.doc_id for r in drop_leaked(docs, bench).collect()} == {2, 3, 5}
    assert find_leaks(docs, bench.limit(0)).count() == 0 and find_leaks(docs.limit(0), bench).count() == 0


def test_banded_alignment():
    import numpy as np
    rng = random.Random(4)
    arr = lambda s: np.frombuffer(s.encode(), np.uint8)

    def plain(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for _ in range(60):
        p = "".join(rng.choice("abc") for _ in range(30))
        t = "".join(rng.choice("abc") for _ in range(8)) + _edited(p, rng.randrange(7), rng) + "".join(rng.choice("abc") for _ in range(8))
        got, best = banded_alignment(arr(p), arr(t), 5), plain(p, t)
        assert (got is None) == (best > 5) and (got is None or got[2] == best)


def _sf(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.collect()]


def test_near_copies_match_brute_force(spark):
    docs, rows = _sf(spark)
    rng = random.Random(2)
    words = ["w%d" % i for i in range(200)]
    base = [rng.choice(words) for _ in range(200)]
    for k in range(60):                     # a chain of copies around the threshold
        new = list(base)
        for _ in range(rng.randrange(9)):
            new[rng.randrange(200)] = "z%d" % k
        rows.append((10_000 + k, " ".join(new)))
    rows += [(20_000, " ".join(base * 3)), (20_001, " ".join(base * 3 + base[:20]))]
    got = {r.doc_id: r.class_id for r in near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.classes(rows)


def test_near_copies_odd_rows(spark):
    df = spark.sql("""select * from values (1,'a b c d e f','x'),(cast(null as bigint),'a b c d e f','y'),(2,'A, b c d e f','z'),(2,'A, b c d e f','z'),
        (3,null,''),(4,'',''),(5,'...',''),(6,'a',''),(7,'a','') as t(doc_id,text,class_id)""")
    got = {(r.doc_id, r.class_id, r.kept) for r in near_copies(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (None, None, True), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False)}
    kept = drop_near_copies(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "None"]
    assert near_copies(df.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98


def test_language_odd_rows(spark):
    texts = [None, "", "123 ...", "a", "é", "日本語のテキスト", "thereon the with " * 5000]
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts * 2)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in identify(df).collect()}
    assert len(got) == 14 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 7, 8, 9))
    assert all(got[i].lang_pred == "en" for i in (3, 4, 5, 6)) and all(0 <= r.score <= 1 for r in got.values())
    assert keep_identified(df).columns == df.columns
    assert {r.lang_pred for r in identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0


def test_repeats_match_brute_force(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh \n") for _ in range(400))
    texts = []
    for _ in range(200):
        k = rng.random()
        junk = lambda n: "".join(rng.choice("ab") for _ in range(rng.randrange(n)))
        texts.append(base[rng.randrange(100):rng.randrange(100, 400)] if k < .2
                     else junk(20) + base[rng.randrange(200):][:rng.randrange(40, 120)] + junk(80) if k < .5
                     else "a" * rng.randrange(200) if k < .6 else rng.choice(["", None, "é" * 30, "x\0" * 40, "\0" * 70]) if k < .7
                     else "ab" * rng.randrange(10, 80) + "c" + "ab" * rng.randrange(80) if k < .8 else junk(300))
    rows = [(rng.choice([i * 7, i * 1000, -i]), t) for i, t in enumerate(texts)] + [(14, texts[2]), (14, texts[2]), (14, "other " + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert sorted(tuple(r) for r in repeats_report(df).collect()) == brute.repeats(rows)


def test_repeats_documents_and_odd_rows(spark):
    docs, rows = _sf(spark)
    assert sorted(tuple(r) for r in repeats_report(docs).collect()) == brute.repeats(rows)
    odd = spark.createDataFrame([(None, "x" * 200), (1, None), (2, "x" * 200), (3, "x" * 49)], "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in repeats_report(odd).collect()}
    assert got == {None: (200, 0), 1: (0, 0), 2: (200, 0), 3: (49, 0)}
    assert repeats_report(odd.limit(0)).count() == 0


def test_texts_that_share_an_id_keep_their_links(spark):
    rng = random.Random(12)
    text = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    a, b = text(), text()
    rows = [(5, a), (5, b), (3, b.replace(" ", "  ", 1) + " tail"), (9, a + " end"), (7, text())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.class_id, r.kept) for r in near_copies(df).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (9, 5, False)]
    assert sorted(r.text for r in drop_near_copies(df).collect()) == sorted([a, rows[2][1], rows[4][1]])


def test_short_items_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "so The capital of Peru? it is Lima"), (2, "xthe capital of peru"), (3, "the capital of perus"),
                                  (4, "the capital, of\nPERU"), (5, "a capital of peru")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "The capital of Peru"), (8, "short")], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id, r.edits) for r in find_leaks(docs, items).collect())
    assert got == [(1, 7, 0), (4, 7, 0)]


def test_very_many_languages(spark):
    rng = random.Random(4)
    sound = {f"l{k:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(12)] for k in range(130)}
    rows = [(i, " ".join(rng.choice(sound[name]) for _ in range(60)), name) for i, name in enumerate([n for n in sound for _ in range(8)])]
    rows += [(None, "abc def", None)]
    got = identify(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()
    truth = {i: n for i, _, n in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(right) > 100 and sum(right) >= 0.95 * len(right)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    once = identify(spark.createDataFrame([(1, "mein haus", "de"), (3, "", "de")], "doc_id bigint, text string, lang string")).collect()
    assert {(r.doc_id, r.lang_pred) for r in once} == {(1, "de"), (3, "und")}


def test_filters_say_what_plain_sets_say(spark):
    """The bit-sliced filters against exact sets of each language's n-grams."""
    import numpy as np

    from eventlens.llm.language import LanguageFilters
    rng = np.random.default_rng(3)
    for n in (3, 64, 100):
        gram = rng.choice(1 << 31, 3000, replace=False).astype(np.int64)
        lang = rng.integers(0, n, 3000)
        f = LanguageFilters.build([f"l{k:03d}" for k in range(n)], lang, gram, np.full(3000, 2))
        bits = np.iinfo(f.masks.dtype).bits
        mask = f.languages_of(gram.astype(np.uint32))
        held = lambda l: (mask[:, l // bits] >> f.masks.dtype.type(l % bits)) & f.masks.dtype.type(1) == 1
        for k in range(n):
            assert held(k)[lang == k].all()                       # nothing is forgotten
            assert held(k)[lang != k].mean() <= 0.01              # and few are taken for it
