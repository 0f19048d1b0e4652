"""Near-duplicate embeddings (operator 10) by an inverted multi-index.

Vectors are scaled to length one. Each half of the vector space has its own
codebook (k-means on a bounded sample); the pairs of codewords form a product
grid, and a vector lies in one cell of it. For each vector a multi-sequence
traversal visits the cells of the grid in order of their distance, nearest
first. How many cells are visited is calibrated before: partners are made at
exactly the threshold cosine in random directions, and the traversal from one
side or the other must reach ``TARGET`` of them. Vectors found in visited cells are verified in
double precision.

A pair is compared if either vector visits the other's cell, so links are
symmetric. Equal vectors are one row with a count from the start. Cells are
compared in blocks, and a block pair gives counts per vector and a spanning
set of its links, never all pairs.

Defined results: null, zero and empty vectors and those with null or
non-finite parts link with nothing; vectors are compared among those of their
own length, each length with an index of its own; rows without vec_id take no part;
repeated rows of a vec_id with the same vector count once; an empty table
gives no row. Other columns (labels) are not read.
"""
from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written
from eventlens.llm.components import components

COSINE = 0.9
#: Rows of the sample that the codebooks are fitted on, at most about so many.
SAMPLE = 20_000
TARGET = 0.995
#: Vectors that a cell should hold on average, and the largest codebook.
CELL_ROWS = 128
MAX_CODES = 512
#: Vectors of a block; a group compares two blocks at most.
BLOCK = 1024


def _kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1), 0.0)


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and the number of cells that a traversal visits."""
    left: np.ndarray
    right: np.ndarray
    visits: int

    @classmethod
    def fit(cls, sample: np.ndarray, rows: int, cosine: float, target: float = TARGET) -> "MultiIndex":
        half = sample.shape[1] // 2
        k = int(np.clip(np.sqrt(rows / CELL_ROWS), 1, MAX_CODES))
        index = cls(_kmeans(sample[:, :half], k), _kmeans(sample[:, half:], k), 0)
        # Partners at the threshold: cos * x + sin * (a random direction orthogonal to x).
        rng = np.random.default_rng(11)
        x = sample[rng.choice(len(sample), min(len(sample), 1000), replace=False)]
        d = rng.standard_normal(x.shape)
        d -= (d * x).sum(1, keepdims=True) * x
        norm = np.linalg.norm(d, axis=1, keepdims=True)
        y = cosine * x + np.sqrt(1 - cosine * cosine) * d / np.where(norm > 0, norm, 1)
        # A pair is compared if either visits the other's cell: the nearer of the two ranks counts.
        rank = np.minimum(index.ranks(x, index.cells(y)), index.ranks(y, index.cells(x)))
        return cls(index.left, index.right, int(np.quantile(rank, target, method="higher")) + 1)

    def ranks(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells lie nearer to each vector than its ``cell`` (calibration only)."""
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), 32):
            grid = self.grid(x[i:i + 32])
            out[i:i + 32] = (grid < grid[np.arange(len(grid)), cell[i:i + 32]][:, None]).sum(1)
        return out

    def grid(self, x: np.ndarray) -> np.ndarray:
        """Distance to every cell of the grid (calibration only)."""
        half = x.shape[1] // 2
        return (_distances(x[:, :half], self.left)[:, :, None] + _distances(x[:, half:], self.right)[:, None, :]).reshape(len(x), -1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return _distances(x[:, :half], self.left).argmin(1) * len(self.right) + _distances(x[:, half:], self.right).argmin(1)

    def traverse(self, x: np.ndarray) -> np.ndarray:
        """Multi-sequence traversal: for each vector the ``visits`` nearest
        cells, its own first. Both codebooks are sorted by distance; a heap
        holds the frontier of pairs (i-th left, j-th right), and a pair enters
        once both pairs before it have been visited."""
        half = x.shape[1] // 2
        dl, dr = _distances(x[:, :half], self.left), _distances(x[:, half:], self.right)
        ol, orr = dl.argsort(1, kind="stable"), dr.argsort(1, kind="stable")
        n_visits = min(self.visits, dl.shape[1] * dr.shape[1])
        out = np.empty((len(x), n_visits), np.int64)
        for v in range(len(x)):
            a, b = dl[v, ol[v]].tolist(), dr[v, orr[v]].tolist()
            done = [0] * (len(a) + 1)          # visited pairs of each left rank: a prefix of the right ranks
            frontier = [(a[0] + b[0], 0, 0)]
            for t in range(n_visits):
                _, i, j = heapq.heappop(frontier)
                out[v, t] = ol[v, i] * len(b) + orr[v, j]
                done[i] = j + 1
                if i + 1 < len(a) and done[i + 1] == j:
                    heapq.heappush(frontier, (a[i + 1] + b[j], i + 1, j))
                if j + 1 < len(b) and (i == 0 or done[i - 1] > j + 1):
                    heapq.heappush(frontier, (a[i] + b[j + 1], i, j + 1))
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) if n else np.empty((0, 0))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that can link."""
    e = F.col("embedding").cast("array<double>")
    return vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))


def _unit(vectors: DataFrame) -> DataFrame:
    """Adds ``unit``: scaled by the largest part first, so no square is lost."""
    most = F.array_max(F.transform("embedding", F.abs))
    scaled = vectors.withColumn("_s", F.transform("embedding", lambda x: x / most))
    norm = F.sqrt(F.aggregate("_s", F.lit(0.0), lambda a, x: a + x * x))
    return scaled.withColumn("unit", F.transform("_s", lambda x: x / norm)).drop("_s")


def fit_index(distinct: DataFrame, rows: int, cosine: float = COSINE, sample: int = SAMPLE) -> MultiIndex:
    """Fit on about ``sample`` rows, all of one length, chosen by a hash of the id."""
    share = min(1.0, sample / max(1, rows))
    picked = distinct.filter(F.pmod(F.xxhash64("vec_id", F.lit(10)), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)
    return MultiIndex.fit(_matrix(picked.orderBy("vec_id").select("unit").toArrow().column("unit")), rows, cosine)


def _indexes(distinct: DataFrame, cosine: float) -> dict[int, MultiIndex]:
    """An index for each vector length. Where the rows make one cell, there is
    nothing to fit, so rare lengths cost no job."""
    out = {}
    for r in distinct.groupBy(F.size("unit").alias("d")).agg(F.count("*").alias("n")).collect():  # one row per length
        if r["n"] < 4 * CELL_ROWS:
            out[r["d"]] = MultiIndex(np.zeros((1, r["d"] // 2)), np.zeros((1, r["d"] - r["d"] // 2)), 1)
        else:
            out[r["d"]] = fit_index(distinct.filter(F.size("unit") == r["d"]), r["n"], cosine)
    return out


def _placed(distinct: DataFrame, indexes: dict[int, MultiIndex]) -> DataFrame:
    """Adds the cell and the cells to visit, by the index of the vector's length."""
    shared = distinct.sparkSession.sparkContext.broadcast(indexes)

    def run(batches):
        for b in batches:
            sizes = b.column("unit").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                part, index = b.filter(pa.array(sizes == size)), shared.value[size]
                x = _matrix(part.column("unit"))
                visits = index.traverse(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * visits.shape[1], pa.int32()), pa.array(visits.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("copies"), part.column("unit"),
                                                  pa.array(np.full(len(x), size, np.int32)), pa.array(index.cells(x)), lists],
                                                 ["vec_id", "copies", "unit", "size", "cell", "visits"])

    return distinct.select("vec_id", "copies", "unit").mapInArrow(
        run, "vec_id bigint, copies bigint, unit array<double>, size int, cell bigint, visits array<bigint>")


def _compare(table: pa.Table, cosine: float) -> pa.Table:
    """One group: queries and members of a cell, a block of each. Counts go to
    the query, and to the member if it does not visit the query's cell; of the
    links, a spanning forest is kept."""
    kind = table.column("member").to_numpy()
    ids, copies, cells = (table.column(c).to_numpy() for c in ("vec_id", "copies", "home"))
    q, m = np.flatnonzero(~kind.astype(bool)), np.flatnonzero(kind.astype(bool))
    out = {"a": [], "b": [], "n": []}
    if len(q) and len(m):
        x = _matrix(table.column("unit"))
        linked = x[q] @ x[m].T >= cosine
        linked &= ids[q][:, None] != ids[m][None, :]
        if linked.any():
            visits = table.column("visits").take(pa.array(m)).to_pylist()
            sees = np.zeros(linked.shape, bool)
            home = cells[q]
            for j, v in enumerate(visits):
                sees[:, j] = np.isin(home, v)
            to_q = linked @ copies[m]
            to_m = (linked & ~sees).T @ copies[q]
            # a forest over queries and members: smallest labels run along the links until they rest
            label_q, label_m = ids[q].copy(), ids[m].copy()
            big = np.iinfo(np.int64).max
            while True:
                new_m = np.minimum(label_m, np.where(linked, label_q[:, None], big).min(0))
                new_q = np.minimum(label_q, np.where(linked, new_m[None, :], big).min(1))
                if (new_m == label_m).all() and (new_q == label_q).all():
                    break
                label_q, label_m = new_q, new_m
            for index, label, count in ((q, label_q, to_q), (m, label_m, to_m)):
                keep = (count > 0) | (label != ids[index])
                out["a"] += ids[index][keep].tolist()
                out["b"] += label[keep].tolist()
                out["n"] += count[keep].tolist()
    return pa.table({k: pa.array(v, pa.int64()) for k, v in out.items()})


def find_links(placed: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b, n): ``n`` links found for ``a`` (with copies counted), and ``b``
    reachable from ``a`` by links of the same block pair (b = a if none)."""
    asked = placed.select("vec_id", "copies", "unit", "size", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    load = (asked.groupBy("size", "cell").agg(F.count("*").alias("asks"))
            .join(placed.groupBy("size", "cell").agg(F.count("*").alias("holds")), ["size", "cell"])
            .select("size", "cell", F.ceil(F.col("asks") / BLOCK).cast("int").alias("q_blocks"),
                    F.ceil(F.col("holds") / BLOCK).cast("int").alias("m_blocks")))
    load = written(load, "cell-load")
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["size", "cell", "qb", "mb", "member", "vec_id", "copies", "unit", "home", "visits"]
    queries = (asked.join(load, ["size", "cell"]).withColumn("qb", own("q_blocks")).withColumn("mb", every("m_blocks"))
               .withColumns({"member": F.lit(0), "visits": F.lit(None).cast("array<bigint>")}).select(columns))
    members = (placed.withColumn("home", F.col("cell")).join(load, ["size", "cell"]).withColumn("mb", own("m_blocks"))
               .withColumn("qb", every("q_blocks")).withColumn("member", F.lit(1)).select(columns))
    return queries.union(members).groupBy("size", "cell", "qb", "mb").applyInArrow(
        lambda t: _compare(t, cosine), "a bigint, b bigint, n bigint")


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    units = _unit(usable(vectors).distinct())
    by_vector = units.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count_distinct("vec_id").alias("copies"),
                                               F.first("unit").alias("unit"))
    distinct = written(by_vector.select("vec_id", "copies", "unit", "embedding"), "distinct-vectors")
    indexes = _indexes(distinct, cosine)
    if indexes:
        found = written(find_links(written(_placed(distinct, indexes), "placed-vectors"), cosine), "links")
        counts = found.groupBy("a").agg(F.sum("n").alias("others"))
        comp = components(found.select("a", "b"))
    else:
        counts = distinct.select(F.col("vec_id").alias("a"), F.col("copies").alias("others"))
        comp = distinct.select(F.col("vec_id").alias("node"), F.col("vec_id").alias("component"))
    reps = (distinct.join(counts, distinct.vec_id == counts.a, "left").join(comp, distinct.vec_id == comp.node, "left")
            .select("embedding", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id")))
    named = units.select(F.col("vec_id").alias("id"), "embedding").join(reps, "embedding").groupBy("id").agg(
        F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return ids.join(named, F.col("vec_id") == F.col("id"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
