"""Helpers shared by the training-data operators."""
from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from eventlens.session import ensure_checkpoint_dir

DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the
    lineage is cut, and a lost executor loses nothing that was finished."""
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs that run inside hand Python tasks at most ``rows`` rows at a time
    (for rows of megabytes)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_slices(texts: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string column into runs of whole texts of about
    ``max_bytes`` (one longer text makes its own run). Yields (first row, end
    row, UTF-8 bytes, offsets of each text in them); null counts as empty."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, off_buf, data_buf = texts.buffers()
    off = np.frombuffer(off_buf, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, data[off[row]:off[end]], off[row:end + 1] - off[row]
        row = end


#: What a task leaves in its worker for the next task of the same operator (encoders with their tables).
WORKER_MEMORY: dict[str, object] = {}


def drop_worker_memory() -> None:
    """Forget what another operator's tasks left in this worker, and give the
    pages back: workers live on through the stages of a pipeline. It is made
    again where it is needed, with the same results."""
    if WORKER_MEMORY:
        WORKER_MEMORY.clear()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def polynomial_hashes(codes: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every window of ``length`` values of the
    uint64 array ``codes``, by doubling: H(2p)[i] = H(p)[i] * base^p + H(p)[i+p].
    Only the parts that ``length`` is made of are kept."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        parts, p, power, h = {}, 1, base, codes
        while True:
            if length & p:
                parts[p] = (h, power)
            if p * 2 > length:
                break
            h = h[:len(h) - p] * power + h[p:]
            power, p = power * power, 2 * p
        out, done = None, 0
        for p in sorted(parts, reverse=True):
            if done + p > length:
                continue
            h, power = parts[p]
            out = h if out is None else out[:n] * power + h[done:done + n]
            done += p
    return out[:n]


def byte_codes(seed: int) -> np.ndarray:
    """256 random odd 64-bit codes, the same in every task."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply): spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
