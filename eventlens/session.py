"""Spark session factory and cluster-level helpers.

Everything in the library is lazy DataFrame work; the session only pins the
settings that change results (UTC, ANSI) and the ones that matter at scale
(AQE, skew join, shuffle partitions, file split size).
"""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings that change results: keep them identical in tests and on a cluster.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for scale. AQE re-plans joins from runtime sizes, coalesces small
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    # Broadcast only what is below this bound; AQE demotes/promotes at runtime.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "eventlens") -> SparkSession:
    """Build or fetch the session. Local runs get a small shuffle count."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # Local mode runs everything in the driver JVM.
            b = b.config("spark.driver.memory", os.environ.get("EVENTLENS_DRIVER_MEMORY", "16g"))
    for k, v in {**RESULT_CONF, **SCALE_CONF}.items():
        b = b.config(k, v)
    b = b.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    for k, v in RESULT_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is. Only a local master gets a scratch folder when it is unset.
    """
    cur = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not cur:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        cur = tempfile.mkdtemp(prefix="eventlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", cur)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cur)
    return cur


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet under the shared checkpoint folder and read
    back, for narrow rows that several parts of a plan read."""
    path = scratch_path(df.sparkSession, os.path.join("kept", f"{name}-{uuid.uuid4().hex[:12]}"))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal_count(df: DataFrame, min_partitions: int | None = None) -> int | None:
    """Into how many parts the rows of a scan should be dealt; None when its
    splits will do: there are as many as task slots, and none holds more than
    twice a slot's share of the rows. (A file is split by bytes, but a row group
    is read whole by the split that holds its middle: of a file of one row group
    all splits but one are empty.) Rows are counted from the files' footers."""
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= want:
        per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
        most, rows = per.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if most * want <= 2 * rows:
            return None
    return max(want, splits)


def spread(df: DataFrame, keys: Sequence[str] = (), min_partitions: int | None = None) -> DataFrame:
    """Deal the rows of a scan over the cluster (``deal_count``), so the
    CPU-heavy per-row work that follows runs in parallel. Inputs that are split
    finely and evenly (the normal case on a large table) are left alone, so no
    shuffle is added at scale. ``keys`` deal the rows without the sort that
    round-robin dealing needs."""
    n = deal_count(df, min_partitions)
    return df if n is None else df.repartition(n, *keys)
