"""License scan (operator 12), native: ordered signature rules.

A text is read as words (A-Z lower-cased, runs of letters, digits and
non-ASCII characters) with one space between. Some hundred regular expressions
(``license_rules``) run over them, each only where the words it needs are all
there. Of overlapping detections one that lies within another is dropped if
the other's rule has the higher priority, or the same priority and a longer
interval; detections that only cross, or cover the same words with the same
priority, stay.

Beside the rules three plain phrases are counted (``PHRASES``); their labels
always stand. The score is the largest weight of a detection that stays.

Defined results: null counts as an empty text (no words, no detection, score
0, empty labels); repeated rows give repeated rows; an empty table gives an
empty result; positions count words from 0, ends are exclusive. Other columns
are ignored.
"""
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.license_rules import LEVELS, WEIGHTS, Rule, rules

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Elements that are folded into one array before it is put aside.
CHUNK = 256

SPAN = "struct<start:bigint,end:bigint>"
DETECTION = "struct<start:bigint,end:bigint,priority:int,label:string,weight:double,rule:int>"
_RULE = "struct<needs:array<string>,label:string,priority:int,weight:double,rule:int,pattern:string>"


def word_text(text: Column) -> Column:
    """The words of a text with one space between."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def _folded(items: Column, state: Column, step: Callable, out: str) -> Column:
    """Elements that ``step(state, item)`` puts out (a struct ``state``, ``out``
    with an array of none or one), in order. The result grows in pieces of
    ``CHUNK`` elements, so a long array isn't copied at each step."""
    none = lambda kind: F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        return _let(step(acc["state"], x), lambda s: F.struct(s["state"].alias("state"), F.concat(acc["out"], s["out"]).alias("out")))

    def piece(all_: Column):
        def go(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(all_, k * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["state"].alias("state"), none(out).alias("out")), one)
            return _let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["parts"], F.array(p["out"])).alias("parts")))
        return go

    start = F.struct(state.alias("state"), none(f"array<{out}>").alias("parts"))
    return _let(items, lambda all_: F.flatten(F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(all_) / CHUNK).cast("int") - 1, F.lit(0))), start, piece(all_), lambda acc: acc["parts"])))


def _spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("bigint")


def word_spans(words: Column, pattern: Column) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` (whole words) in the
    word text, as (start, end) in words: the spaces before a match count the
    words before it."""
    def spans(found: Column) -> Column:
        gaps = F.slice(F.split(words, pattern, F.lit(-1)), F.lit(1), F.size(found))

        def step(at: Column, x: Column) -> Column:
            return _let(at["at"] + _spaces(x["gap"]), lambda begin: _let(begin + _spaces(x["match"]), lambda last: F.struct(
                F.struct(last.alias("at")).alias("state"),
                F.array(F.struct(begin.alias("start"), (last + 1).alias("end"))).alias("out"))))

        pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
        return F.when(F.size(found) > 0, _folded(pairs, F.struct(F.lit(0).cast("bigint").alias("at")), step, SPAN)).otherwise(
            F.array().cast(f"array<{SPAN}>"))

    return _let(F.regexp_extract_all(words, pattern, F.lit(0)), spans)


def _whole(expression: str) -> str:
    return f"(?<![^ ])(?:{expression})(?![^ ])"


def _detections(words: Column, hits: Column, signature: list[Rule]) -> Column:
    """All matches of the rules whose words are among ``hits``."""
    by_word: dict[str, list] = {}
    for k, r in enumerate(signature):
        by_word.setdefault(r.needs[0], []).append(
            {"needs": list(r.needs[1:]), "label": r.label, "priority": r.priority, "weight": r.weight, "rule": k, "pattern": _whole(r.expression)})
    table = F.from_json(F.lit(json.dumps(by_word)), f"map<string,array<{_RULE}>>")
    tried = F.filter(F.flatten(F.transform(hits, lambda w: F.coalesce(F.element_at(table, w), F.array().cast(f"array<{_RULE}>")))),
                     lambda r: F.forall(r["needs"], lambda w: F.array_contains(hits, w)))
    return F.flatten(F.transform(tried, lambda r: F.transform(word_spans(words, r["pattern"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"),
        r["weight"].alias("weight"), r["rule"].alias("rule")))))


def _outstanding(found: Column) -> Column:
    """The detections that lie in none of higher rank. In order of start (the
    longest first) only an earlier one can hold a later one; for each priority
    the farthest end so far, and the first start that had it, are enough."""
    ordered = F.array_sort(F.transform(found, lambda d: F.struct(
        d["start"].alias("start"), (-d["end"]).alias("back"), d["priority"].alias("priority"), d["rule"].alias("rule"),
        d["label"].alias("label"), d["weight"].alias("weight"))))
    levels = sorted(WEIGHTS)
    state = F.struct(*[F.lit(-1).cast("bigint").alias(f"{c}{p}") for p in levels for c in ("end", "from")])

    def step(seen: Column, d: Column) -> Column:
        end = -d["back"]
        held = F.lit(False)
        for p in levels:
            held = held | (F.lit(p) < d["priority"]) & (seen[f"end{p}"] >= end)
            held = held | (F.lit(p) == d["priority"]) & ((seen[f"end{p}"] > end) | (seen[f"end{p}"] == end) & (seen[f"from{p}"] < d["start"]))
        farther = {p: (F.lit(p) == d["priority"]) & (end > seen[f"end{p}"]) for p in levels}
        now = F.struct(*[F.when(farther[p], end if c == "end" else d["start"]).otherwise(seen[f"{c}{p}"]).alias(f"{c}{p}")
                         for p in levels for c in ("end", "from")])
        kept = F.array(F.struct(d["start"].alias("start"), end.alias("end"), d["priority"].alias("priority"), d["label"].alias("label"),
                                d["weight"].alias("weight"), d["rule"].alias("rule")))
        return F.struct(now.alias("state"), F.when(held, F.array().cast(f"array<{DETECTION}>")).otherwise(kept).alias("out"))

    return _folded(ordered, state, step, DETECTION)


def find_licenses(docs: DataFrame, signature: list[Rule] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, phrases (the places of
    each of ``PHRASES``, in its order) and detections (those that stay: start,
    end, priority, label, weight, rule)."""
    signature = rules() if signature is None else signature
    if any(not 1 <= r.priority <= LEVELS for r in signature):
        raise ValueError(f"priorities are 1 to {LEVELS}")
    known = sorted({w for r in signature for w in r.needs})
    words = F.col("_words")
    every = F.split(words, " ")
    hits = F.array_intersect(every, F.lit(known) if known else F.array().cast("array<string>"))
    plain = F.array(*[F.when(F.contains(words, F.lit(p)), word_spans(words, F.lit(_whole(p)))).otherwise(F.array().cast(f"array<{SPAN}>")) for p in PHRASES])
    found = F.when(F.size("_hits") > 0, _let(_detections(words, F.col("_hits"), signature), lambda d: F.when(
        F.size(d) > 0, _outstanding(d)).otherwise(F.array().cast(f"array<{DETECTION}>")))).otherwise(F.array().cast(f"array<{DETECTION}>"))
    rows = docs.select("doc_id", word_text(F.col("text")).alias("_words")).withColumn("_hits", hits)
    return rows.select("doc_id", F.when(words == "", 0).otherwise(_spaces(words) + 1).alias("n_words"), plain.alias("phrases"), found.alias("detections"))


def license_report(docs: DataFrame) -> DataFrame:
    """Counts, places, labels and score of each row of ``docs``."""
    places = F.transform(F.flatten("phrases"), lambda s: s["start"])
    base = F.filter(F.array(*[F.when(F.size(F.col("phrases")[k]) > 0, label) for k, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    own = F.transform("detections", lambda d: d["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return find_licenses(docs).select(
        "doc_id", "n_words", F.size(F.flatten("phrases")).cast("bigint").alias("n_base"),
        F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"), F.coalesce(F.array_max(F.transform("detections", lambda d: d["weight"])), F.lit(0.0)).alias("score"))
