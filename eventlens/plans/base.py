"""Registry of runnable queries: one Spark plan and (where SQL can say it) one
independent DuckDB oracle per operator ID."""
from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.fixtures import Tables
from eventlens.plans.oracle_fixtures import with_fixtures


@dataclass
class Plan:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    oracle: Optional[str]


REGISTRY: dict[str, Plan] = {}

# Common parameters for the registered queries (fixture time ranges).
EVENT_AS_OF = "1999-12-01 00:00:00"      # events published 1998-01-01 .. 1999-12-01
ARTICLE_AS_OF = "2024-02-15 00:00:00"


@functools.lru_cache(maxsize=8)
def _tables(spark_id: int, sf_dir: str, spark: SparkSession) -> Tables:
    return Tables(spark, sf_dir)


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    return _tables(id(spark), sf_dir, spark)


def finish(df: DataFrame) -> DataFrame:
    """Zone-less output timestamps, matching DuckDB's TIMESTAMP."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            cols.append(F.col(f.name).cast("timestamp_ntz").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def plan(name: str, oracle: Optional[str] = None, extra_ctes: Optional[dict] = None):
    """Register ``fn(t: Tables) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return finish(fn(tables(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        sql = with_fixtures(oracle, extra_ctes) if oracle else None
        REGISTRY[name] = Plan(name, run, sql)
        return fn
    return deco
