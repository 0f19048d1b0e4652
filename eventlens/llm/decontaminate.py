"""Benchmark decontamination (operator 3) by q-gram lemma filtering.

Texts are normalised (lower case, runs of other characters as one space). An
item of n characters that occurs in a document with at most e edits shares at
least n + 1 - q (e + 1) of its q-grams with it, all on diagonals (document
position minus item position) no more than e apart on either side. So every
document q-gram that some item holds is counted in the diagonal band of the
item; two neighbouring bands together hold all diagonals of an occurrence.
Bands that reach the bound are verified by banded alignment.

Items of ``MIN_ITEM`` to ``SHORT_ITEM`` normalised bytes are found by the same
count, exactly and as whole words only.

Defined results: null or empty texts and items match nothing; items shorter
than ``MIN_ITEM`` normalised bytes are left out (too short to be told
from chance); repeated documents and repeated items each give their rows; an
empty benchmark or table gives no rows. Where an item occurs several times in a document, each
region is reported once (neighbouring bands that verify to the same best end
are one region). Item ids may be null. Other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import byte_codes, drop_worker_memory, mix64, polynomial_hashes, text_slices

Q = 8
EDIT_RATE = 0.08
MIN_ITEM, SHORT_ITEM = 2 * Q, 40
#: Entries (q-gram of a text, item that holds it) that are counted together.
PIECE = 1 << 21
#: Items are read by every task; a larger benchmark is checked group by group.
MAX_ITEM_BYTES = 16 << 20

_CODES = byte_codes(31)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_GAP = 32
_CLASS = np.full(256, _GAP, np.uint8)
_CLASS[48:58] = np.arange(48, 58)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes of each text, their offsets, and for each kept byte
    its place in ``data``."""
    c = _CLASS[data]
    first = np.zeros(len(c), bool)
    first[offsets[:-1][offsets[:-1] < len(c)]] = True
    keep = c != _GAP
    if len(c):
        keep[1:] |= (c[:-1] != _GAP) & ~first[1:]  # the first of a run of gaps stays, except at a text's start
    count = np.append(0, np.cumsum(keep))
    return c[keep], count[offsets], np.flatnonzero(keep)


def edits_allowed(length: int, rate: float = EDIT_RATE) -> int:
    """The edit budget: a share of the length, and small enough that the
    q-gram lemma still asks for some shared q-grams."""
    return max(0, min(int(length * rate), (length + 1 - Q) // Q - 2))


def banded_alignment(pattern: np.ndarray, text: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Best occurrence of the whole ``pattern`` in ``text`` with at most
    ``budget`` edits: (start, end, edits) in ``text``, else None. One row per
    pattern byte; cells beyond the budget are dropped, so the live band of
    columns stays as wide as the candidate diagonals."""
    n = len(text)
    big = budget + 1
    cost = np.zeros(n + 1, np.int32)
    start = np.arange(n + 1)
    cols = np.arange(n + 1)
    for i, ch in enumerate(pattern, 1):
        live = np.flatnonzero(cost <= budget)
        if not len(live):
            return None
        lo, hi = int(live[0]), min(int(live[-1]) + 1, n)
        prev, prev_start = cost[lo:hi + 1], start[lo:hi + 1]
        now, now_start = prev + 1, prev_start.copy()
        diag = prev[:-1] + (text[lo:hi] != ch)
        better = diag <= now[1:]
        now[1:][better] = diag[better]
        now_start[1:][better] = prev_start[:-1][better]
        # insertions run along the row: running minimum of cost - column
        level = now - cols[:len(now)]
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, cols[:len(now)], 0))
        cost = np.full(n + 1, big, np.int32)
        cost[lo:hi + 1] = np.minimum(low + cols[:len(now)], big)
        start = np.zeros(n + 1, start.dtype)
        start[lo:hi + 1] = now_start[source]
    end = int(cost.argmin())
    return (int(start[end]), end, int(cost[end])) if cost[end] <= budget else None


@dataclass(frozen=True)
class BenchmarkIndex:
    """Q-grams of all items, sorted, with the items and places that hold them."""
    ids: list
    data: np.ndarray          # normalised bytes of all items
    offsets: np.ndarray
    budget: np.ndarray
    need: np.ndarray          # shared q-grams that the lemma asks for
    shift: np.ndarray         # log2 of the width of a diagonal band
    grams: np.ndarray         # distinct q-gram hashes, sorted
    first: np.ndarray         # where the holders of each begin
    item: np.ndarray
    place: np.ndarray
    seen: np.ndarray          # bitmap of the q-grams' low bits, to skip the rest

    @classmethod
    def build(cls, ids: list, texts: pa.Array) -> "BenchmarkIndex":
        data, offsets = np.empty(0, np.uint8), np.zeros(1, np.int64)
        for _, _, d, o in text_slices(pc.utf8_lower(texts), 1 << 62):
            data, offsets, _ = normalise(d, o)
        ends = offsets[1:].copy()
        trail = (ends > offsets[:-1]) & (data[np.maximum(ends, 1) - 1] == _GAP) if len(data) else np.zeros(len(ends), bool)
        length = ends - trail - offsets[:-1]
        budget = np.array([edits_allowed(int(n)) if n >= SHORT_ITEM else 0 for n in length], np.int64)
        need = length + 1 - Q * (budget + 1)
        use = length >= MIN_ITEM
        h = mix64(polynomial_hashes(_CODES[data], Q, _BASE))
        items, places = [], []
        for i in np.flatnonzero(use):
            p = np.arange(length[i] - Q + 1)
            items.append(np.full(len(p), i))
            places.append(p)
        item = np.concatenate(items) if items else np.empty(0, np.int64)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        key = h[offsets[item] + place] if len(item) else np.empty(0, np.uint64)
        order = np.argsort(key, kind="stable")
        grams, first = np.unique(key[order], return_index=True)
        bits = max(16, int(np.ceil(np.log2(max(1, 16 * len(grams))))))
        seen = np.zeros(1 << bits, bool)
        seen[(grams & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        bounds = np.stack([offsets[:-1], offsets[:-1] + length], 1) if len(length) else np.empty((0, 2), np.int64)
        return cls(ids, data, bounds, budget, need, np.ceil(np.log2(2 * budget + 1)).astype(np.int64) if len(budget) else budget,
                   grams, np.append(first, len(order)), item[order], place[order], seen)

    def _counted(self, hit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(item, band) keys and how many q-grams each shares, for hits at
        places ``hit`` of the q-grams numbered ``at``. A q-gram that many items
        hold gives an entry for each of them: entries are made and counted about
        ``PIECE`` at a time."""
        count = self.first[at + 1] - self.first[at]
        ends = np.cumsum(count)
        # diagonals counted from the slice's start; texts lie one after another, so bands of two texts are told
        # apart by checking the text of the region later
        back = int(self.offsets[:, 1].max()) if len(self.offsets) else 0
        keys, counts, begin = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        while begin < len(hit):
            done = int(ends[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
            c = count[begin:end]
            which = np.repeat(self.first[at[begin:end]] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            item = self.item[which]
            band = (np.repeat(hit[begin:end], c) - self.place[which] + back) >> self.shift[item]
            k, n = np.unique((item.astype(np.int64) << 40) | band, return_counts=True)
            keys.append(k), counts.append(n)
            begin = end
        key, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, number, np.concatenate(counts))
        return key, total

    def regions(self, data: np.ndarray, offsets: np.ndarray):
        """(text number, item number, start, end, edits) in normalised bytes."""
        if len(data) < Q or not len(self.grams):
            return
        h = mix64(polynomial_hashes(_CODES[data], Q, _BASE))
        hit = np.flatnonzero(self.seen[(h & np.uint64(len(self.seen) - 1)).astype(np.int64)])
        at = np.searchsorted(self.grams, h[hit])
        at[at == len(self.grams)] = 0
        real = self.grams[at] == h[hit]
        hit, at = hit[real], at[real]
        number = np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + Q <= offsets[number + 1]
        hit, at, number = hit[inside], at[inside], number[inside]
        key, n = self._counted(hit, at)
        if not len(key):
            return
        follows = np.append((key[1:] == key[:-1] + 1), False)
        both = n + np.where(follows, np.append(n[1:], 0), 0)
        found = np.flatnonzero(both >= self.need[key >> 40])
        back = int(self.offsets[:, 1].max())
        reported = set()
        for k in found:
            i, b = int(key[k] >> 40), int(key[k] & ((1 << 40) - 1))
            e, width = int(self.budget[i]), 1 << int(self.shift[i])
            p0, p1 = self.offsets[i]
            pattern = self.data[p0:p1]
            lo = b * width - back - e
            hi = (b + 2) * width - back + len(pattern) + e
            for t in range(max(0, int(np.searchsorted(offsets, lo, side="right")) - 1), len(offsets) - 1):
                if offsets[t] >= hi:
                    break
                left, right = max(lo, int(offsets[t])), min(hi, int(offsets[t + 1]))
                if right - left < len(pattern) - e:
                    continue
                region = data[left:right]
                exact = region.tobytes().find(pattern.tobytes())
                if len(pattern) < SHORT_ITEM:
                    first, last = left + exact, left + exact + len(pattern)
                    whole = exact >= 0 and (first == offsets[t] or data[first - 1] == _GAP) and (last == offsets[t + 1] or data[last] == _GAP)
                    got = (exact, exact + len(pattern), 0) if whole else None
                else:
                    got = (exact, exact + len(pattern), 0) if exact >= 0 else banded_alignment(pattern, region, e)
                if got and (t, i, left + got[1]) not in reported:
                    reported.add((t, i, left + got[1]))
                    yield t, i, left + got[0], left + got[1], got[2]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per occurrence of a benchmark item in a document: doc_id,
    item_id, start and end (bytes of the lower-cased UTF-8 text), edits.

    The items are sent to every task after their size is checked; a benchmark
    above ``MAX_ITEM_BYTES`` is cut by item hash into groups below it, each
    checked in its own pass."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // MAX_ITEM_BYTES) or 1
    out = None
    for g in range(groups):
        part = items if groups == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        found = _leaks_of(docs, part.toArrow())
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(docs: DataFrame, items: pa.Table) -> DataFrame:
    texts = items.column("text").combine_chunks()
    ids = items.column("item_id").to_pylist()
    shared = docs.sparkSession.sparkContext.broadcast(BenchmarkIndex.build(ids, texts))

    def run(batches):
        drop_worker_memory()
        index = shared.value
        for b in batches:
            doc_ids = b.column("doc_id")
            rows = []
            for row, _, data, off in text_slices(pc.utf8_lower(b.column("text"))):
                flat, flat_off, origin = normalise(data, off)
                for t, i, start, end, edits in index.regions(flat, flat_off):
                    rows.append((doc_ids[row + t].as_py(), index.ids[i],
                                 int(origin[start] - off[t]), int(origin[end - 1] + 1 - off[t]), edits))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "item_id", "start", "end", "edits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, item_id bigint, start bigint, end bigint, edits bigint")


def drop_leaked(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item occurs."""
    leaked = find_leaks(docs, benchmark).select(F.col("doc_id").alias("_leaked")).distinct()
    return docs.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col("_leaked")), "left_anti")
