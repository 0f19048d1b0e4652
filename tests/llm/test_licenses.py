"""License scan (12) against a plain version."""
import re

import pytest
from pyspark.sql import functions as F

from conftest_paths import SF001, SF01

from eventlens.llm.license_rules import rules
from eventlens.llm.licenses import PHRASES, find_licenses, license_report

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text):
    return re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def all_matches(words, compiled):
    flat = " ".join(words)
    return [(flat[:m.start()].count(" "), flat[:m.end()].count(" ") + 1, r.priority, r.label, r.weight, k)
            for k, (r, x) in enumerate(compiled) for m in x.finditer(flat)]


def staying(found):
    def holds(e, d):
        if e[0] > d[0] or e[1] < d[1]:
            return False
        return e[2] < d[2] or (e[2] == d[2] and e[1] - e[0] > d[1] - d[0])
    return [d for d in found if not any(holds(e, d) for e in found)]


def plain(rows, compiled):
    out = []
    for i, text in rows:
        w = words_of(text)
        places, base = [], set()
        for phrase, label in PHRASES.items():
            p = phrase.split(" ")
            here = [k for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p]
            places += here
            base |= {label} if here else set()
        kept = staying(all_matches(w, compiled))
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {d[3] for d in kept})), max((d[4] for d in kept), default=0.0)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def compiled():
    return [(r, re.compile(f"(?<![^ ])(?:{r.expression})(?![^ ])")) for r in rules()]


def test_rules_are_many_and_hold_the_words_they_need():
    assert len(rules()) > 300 and all(r.needs and 1 <= r.priority <= 5 for r in rules())


def test_documents_match_plain_version(spark, compiled):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("labels", F.lit(1)).withColumn("_words", F.lit("k"))
    got = sorted((tuple(r) for r in license_report(docs).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], compiled)


TEXTS = [None, "", "  ,. ", "MIT\n-License mit license MIT LICENSES", "Licensed under the Apache License, Version 2.0.",
         "SPDX-License-Identifier: GPL-2.0-or-later", "see https://creativecommons.org/licenses/by-nc-sa/4.0/ and CC BY-NC 4.0",
         "This work is licensed under the GNU Lesser General Public License, version 2.1 or later.",
         "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")",
         "you can redistribute it and/or modify it under the terms of the GNU General Public License as published",
         "Alle Rechte vorbehalten. all rights reserved É License mit", "mit einer Lizenz", "the three-clause BSD license and 3-clause BSD, or Apache-2.0",
         "Apache Licence 2.0 " * 700, "x" * 200_000, "w " * 100_000 + "The MIT License", "\U0001F600 mit license x"]


def test_cases_match_plain_version(spark, compiled):
    df = spark.createDataFrame([(i % 15, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4])] * 2, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in license_report(df).collect()), key=str)
    assert got == plain([(r.doc_id, r.text) for r in df.collect()], compiled)
    assert license_report(df.limit(0)).count() == 0
    kept = {d.label for d in find_licenses(df.filter("doc_id = 4 and text like 'Lic%'")).first().detections}
    assert kept == {"apache-2.0"}


def test_sql_gives_the_same_rows(spark):
    from eventlens.llm.registry import oracle_sql, queries
    from eventlens.plans.check import compare
    r = compare(spark, SF01, "op12_licenses", queries()["op12_licenses"], oracle_sql()["op12_licenses"])
    assert r["status"] == "match", r
