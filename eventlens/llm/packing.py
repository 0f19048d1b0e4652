"""Packing (operator 6) by Karmarkar-Karp multiway differencing.

Documents' ids are cut into pieces and laid into windows of ``WINDOW`` tokens.
A document's whole windows need no packing; what is left of it is cut into
pieces of at most ``PIECE`` tokens. Batches of pieces are dealt to windows by
largest differencing: every piece starts as a partial partition (one window
holds it, the others are empty); the two partitions with the largest imbalance
are merged with opposing order, until one partition with near-equal windows is
left. If a window is over capacity, the batch is dealt anew to one window
more. Batches end where the tokens fill their windows but for a small slack,
so a piece may be cut there and go on in the next batch; a batch of very many
small pieces ends earlier, with fewer windows.

Defined results: null text counts as empty (one piece with the end id only);
equal texts and repeated ids are packed each on its own; an empty table gives
no row. Extra columns are not read. Windows never cross task boundaries: a
task's last batch may be padded.
"""
from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.token_ids import encoder

WINDOW = 2048
PIECE = 256
BATCH_WINDOWS = 256
#: Pieces dealt at once, a bound for the memory of a batch of tiny documents.
BATCH_PIECES = 4096
SLACK = 1  # tokens a window that a batch leaves free


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window number of each piece: Karmarkar-Karp largest differencing over
    ``windows``-way partial partitions (sums in falling order)."""
    n = len(sizes)
    sums = np.zeros((n, windows), np.int64)
    sums[:, 0] = sizes
    nodes = [sums[i] for i in range(n)]
    merges: list[tuple[int, int, np.ndarray]] = []
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        merged = nodes[a] + nodes[b][::-1]     # the fullest window of one meets the emptiest of the other
        order = np.argsort(-merged, kind="stable")
        merged = merged[order]
        nodes[a] = nodes[b] = None
        nodes.append(merged)
        merges.append((a, b, order))
        heapq.heappush(heap, (int(merged[-1] - merged[0]), len(nodes) - 1))
    # From the last partition down: which window each place of a partition has become.
    place: list[np.ndarray | None] = [None] * len(nodes)
    place[-1] = np.arange(windows)
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        became = np.empty(windows, np.int64)
        became[order] = place[n + k]
        place[a], place[b] = became, became[::-1]
        place[n + k] = None
    return np.array([place[i][0] for i in range(n)], np.int64)


def deal(sizes: np.ndarray, capacity: int = WINDOW) -> tuple[np.ndarray, int]:
    """Windows for pieces of at most ``capacity``: as few as hold the tokens,
    one more whenever the capacity is exceeded."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        to = differencing(sizes, windows)
        if np.bincount(to, sizes, windows).max() <= capacity:
            return to, windows
        windows += 1


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = WINDOW, piece: int = PIECE,
         batch_windows: int = BATCH_WINDOWS, batch_pieces: int = BATCH_PIECES) -> DataFrame:
    """One row per piece: doc_id, start (ids of its document before it),
    length, ids (little-endian uint32), doc_tokens, sequence_id, offset. Each
    task packs the documents of its split: no shuffle, and never more than a
    batch of pieces and one run of texts in memory."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]

    def run(batches):
        from pyspark import TaskContext
        enc = encoder(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []      # (doc_id, start, ids, doc_tokens)
        held = 0
        target = batch_windows * (window - SLACK)
        rows: list[tuple] = []

        def place(pieces, to, windows):
            nonlocal sequence
            filled = [0] * windows
            for (doc_id, start, ids, total), w in zip(pieces, to.tolist()):
                rows.append((doc_id, start, len(ids), ids.tobytes(), total, sequence + w, filled[w]))
                filled[w] += len(ids)
            sequence += windows

        def flush(tokens):
            """Deal the first ``tokens`` tokens that wait; a piece is cut where they end."""
            nonlocal held
            n, filled = 0, 0
            while n < len(waiting) and filled + len(waiting[n][2]) <= tokens:
                filled += len(waiting[n][2])
                n += 1
            now = waiting[:n]
            del waiting[:n]
            if filled < tokens:
                doc_id, at, ids, total = waiting[0]
                cut = tokens - filled
                now.append((doc_id, at, ids[:cut], total))
                waiting[0] = (doc_id, at + cut, ids[cut:], total)
            held -= tokens
            place(now, *deal(np.array([len(p[2]) for p in now], np.int64), window))

        def take():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], [f for f, _ in fields])
            rows.clear()
            return out

        for b in batches:
            doc_ids = b.column("doc_id").to_pylist()
            for row, end, flat, ends in enc.encode(b.column("text")):
                flat = np.insert(flat, ends, end_id).astype("<u4")        # after each document's ids
                ends = (ends + np.arange(1, end - row + 1)).tolist()
                begin = 0
                for doc_id, stop in zip(doc_ids[row:end], ends):
                    ids, total, at = flat[begin:stop], stop - begin, 0
                    begin = stop
                    while total - at >= window:
                        place([(doc_id, at, ids[at:at + window], total)], np.zeros(1, np.int64), 1)
                        at += window
                    while at < total:
                        n = min(piece, total - at)
                        waiting.append((doc_id, at, ids[at:at + n], total))
                        at, held = at + n, held + n
                        if held >= target:
                            flush(target)
                        elif len(waiting) >= batch_pieces and held >= window - SLACK:
                            flush(held // (window - SLACK) * (window - SLACK))
                waiting = [(i, at, ids.copy(), total) for i, at, ids, total in waiting]  # what waits doesn't hold the run's ids
                if rows:
                    yield take()
        if waiting:
            flush(held)
        if rows:
            yield take()

    schema = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def pack_report(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                                        "doc_tokens", "sequence_id", "offset")
