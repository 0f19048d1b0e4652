"""Small column-expression helpers used across the library."""
from __future__ import annotations

import re
import sys
from functools import reduce
from operator import and_
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(value) -> Column:
    """A timestamp literal (``as_of`` arguments are strings or datetimes)."""
    return F.lit(value).cast("timestamp")


def elem(values: Sequence, idx: Column) -> Column:
    """``values[idx]`` (0-based) as a column expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx + 1).cast("int"))


def lookup(mapping: dict, key: Column) -> Column:
    """Map-literal lookup; missing key gives NULL."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]),
                        key)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def plus_seconds(ts: Column, secs) -> Column:
    secs = col(secs) if not isinstance(secs, (int, float)) else F.lit(secs)
    return F.timestamp_micros(F.unix_micros(ts) + (secs.cast("double") * F.lit(1_000_000)).cast("long"))


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A fixed small lookup table (size bounded by the code, safe to broadcast)."""
    return F.broadcast(spark.createDataFrame(list(rows), schema=schema))


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows; a filter on ``columns`` sees their values and is not pushed
    down to their expressions, which it would compute again for each use (a
    filter's common parts are not shared)."""
    rest = [c for c in df.columns if c not in columns]
    one = df.select(*rest, F.explode_outer(F.array(F.struct(*columns))).alias("_settled"))
    return one.select(*[F.col("_settled")[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def contains_count(text: Column, terms: Iterable[str]) -> Column:
    """Number of terms that occur as substrings of ``text`` (each counted once)."""
    terms = list(terms)
    if not terms:
        return F.lit(0)
    # ``contains`` is a byte search, several times faster than ``instr``.
    return sum(text.contains(t).cast("int") for t in terms)


def contains_any(text: Column, terms: Iterable[str]) -> Column:
    out = None
    for t in terms:
        c = text.contains(t)
        out = c if out is None else (out | c)
    return out if out is not None else F.lit(False)


def like_escape(term: str) -> str:
    """Escape a literal for LIKE/ILIKE (used where user text must not be a pattern)."""
    return re.sub(r"([\\%_])", r"\\\1", term)


def ieee_ratio(x: Column, y: Column) -> Column:
    """``x / y`` of doubles as IEEE 754 has it: over 0 infinite, or NaN for 0 / 0
    (ANSI mode raises). NULL stays NULL."""
    over_zero = (F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).when(x > 0, F.lit(float("inf")))
                 .when(x < 0, F.lit(float("-inf"))))
    return F.when(y == 0, over_zero).otherwise(F.try_divide(x, y))


def complete_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without a NULL in ``cols`` (``dropna`` drops NaN too)."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in cols]))


def finite(x: Column) -> Column:
    """Infinities and NaN as the largest (smallest) double."""
    top = sys.float_info.max
    return F.when(F.isnan(x), F.lit(top)).otherwise(F.greatest(F.lit(-top), F.least(F.lit(top), x)))
