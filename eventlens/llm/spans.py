"""Native span finding: positions of regular-expression matches by built-in functions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,value:string>"


def regex_spans(text: Column, pattern: str, present: Column) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (start,
    end, value); code points, end exclusive. ``present`` is a cheap necessary
    condition; texts that fail it aren't searched. The text between matches
    (``split``) and the matches give the offsets by a running sum."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc, x):
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["match"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found,
                       lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    spans = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(present, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_ok(digits: Column) -> Column:
    """Luhn checksum of a string of ASCII digits."""
    def step(acc, d):
        v = d.cast("int")
        twice = F.when(v > 4, v * 2 - 9).otherwise(v * 2)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(v)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    return F.aggregate(F.split(F.reverse(digits), ""), start, step, lambda acc: acc["sum"] % 10 == 0)
