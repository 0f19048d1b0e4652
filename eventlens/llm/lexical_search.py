"""Ranked lexical search (operator 13) over K2-treaps.

Documents are cut into blocks of about ``BLOCK_BYTES`` of text. A block's
term-document grid (rows: its terms, frequent ones first; columns: its
documents) holds the impact of each term in each document, before the term's
weight. It is stored as a quadtree: a square of the grid is one cell with the
largest impact in it, and is cut into four until it is a single place; empty
quarters are left out. A cell takes four bits (which quarters are there) and
its maximum as the difference to the cell it lies in.

A search follows the row of each of an item's terms down through the cells,
for all of them at once, over ranges of documents. Weights times maxima bound
the score of every document in a range; the ranges of the highest bound are
cut first, until no bound reaches the last place of the ranking so far. A task
carries that ranking from block to block. At a single document the bound is
its score. The score is that of ``impact`` and ``weight``, in whole numbers.

Terms are maximal runs of ASCII letters, digits and non-ASCII characters with
A-Z lower-cased; they are told apart by 64-bit hashes (among V distinct terms
and Q terms asked for, a mix-up has a chance of about Q V / 2^64).

Defined results: null and empty texts and items have no term; an item without
a term, or whose terms no document holds, has no row; a row without doc_id
counts in the statistics and is not ranked; repeated documents are ranked each
on its own, repeated items give their rows each; without a document that holds
a term there is no row. Other columns are not read.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import arrow_rows, text_slices, written
from eventlens.llm.near_copies import word_hashes

TOP = 20
BLOCK_BYTES = 4 << 20
BLOCK_DOCS = 1 << 16
#: Items are read by every task; more are searched group by group.
MAX_ITEM_BYTES = 16 << 20
#: Ranges of documents that are cut together.
BEAM = 64
WINDOW_BYTES = 1 << 20
#: Bytes of a row group of the index: readers decode all rows of one together.
GROUP_BYTES = 8 << 20
#: Texts handed to a task at a time.
TEXT_ROWS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.zeros(256, bool)
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
_ONES = np.array([bin(m).count("1") for m in range(16)], np.int64)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    return 75 + (25 * n_terms * n_docs) // all_terms


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


def term_runs(data: np.ndarray, offsets: np.ndarray, size: int = WINDOW_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(term hashes, text number of each) of a run of texts; a text longer
    than ``size`` comes in parts that end between terms."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and _TERM[data[end]] and _TERM[data[end - 1]]:
            end += 1
        part = _LOWER[data[at:end]]
        edges = np.clip(offsets, at, end) - at
        hashes, before = word_hashes(part, edges)
        yield hashes, np.repeat(np.arange(len(offsets) - 1), np.diff(before))
        at = end


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms with repeats, of all texts."""
    def count(batches):
        n_docs = n_terms = 0
        for b in batches:
            for _, _, data, offsets in text_slices(b.column("text")):
                begins = _TERM[data]
                if len(data):
                    inner = begins.copy()
                    inner[1:] &= ~begins[:-1]
                    edge = offsets[1:-1][offsets[1:-1] < len(data)]
                    inner[edge] = begins[edge]
                    terms = np.diff(np.append(0, np.cumsum(inner))[offsets])
                    n_docs, n_terms = n_docs + int((terms > 0).sum()), n_terms + int(terms.sum())
        yield pa.RecordBatch.from_pydict({"docs": pa.array([n_docs], pa.int64()), "terms": pa.array([n_terms], pa.int64())})

    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        row = docs.select("text").mapInArrow(count, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def _spread(x: np.ndarray) -> np.ndarray:
    """Bits of 32-bit numbers at the even places of 64-bit ones."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers as four byte planes: the high ones are nearly all zero and pack well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


@dataclass(frozen=True)
class Treap:
    """Cells numbered from the top, those of one cell side by side; the last
    number stands for an empty quarter."""
    height: int
    masks: np.ndarray        # quarters that are there (0 for single places)
    first: np.ndarray        # number of the first quarter
    maxima: np.ndarray

    @staticmethod
    def encode(row: np.ndarray, column: np.ndarray, value: np.ndarray) -> tuple[int, bytes, bytes]:
        """Height, masks and maxima of the places (row, column, value)."""
        side = max(int(row.max()), int(column.max())) + 1
        height = max(1, (side - 1).bit_length())
        code = (_spread(row) << np.uint64(1)) | _spread(column)
        order = np.argsort(code)
        code, top = code[order], value[order]
        masks, drops = [], []
        for _ in range(height):
            above = code >> np.uint64(2)
            begin = np.flatnonzero(np.append(True, above[1:] != above[:-1]))
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), begin))
            highest = np.maximum.reduceat(top, begin)
            drops.append(np.repeat(highest, np.diff(np.append(begin, len(code)))) - top)
            code, top = above[begin], highest
        quad = np.concatenate(masks[::-1])
        quad = np.append(quad, np.zeros(len(quad) % 2, np.uint8))
        return height, (quad[::2] | quad[1::2] << 4).tobytes(), _planes(np.concatenate([top, *drops[::-1]]))

    @classmethod
    def decode(cls, height: int, masks: bytes, maxima: bytes) -> "Treap":
        pairs = np.frombuffer(masks, np.uint8)
        quad = np.stack([pairs & 15, pairs >> 4], 1).reshape(-1)
        drop = _unplaned(maxima).astype(np.int32)
        first = 1 + np.append(0, np.cumsum(_ONES[quad]))
        top = np.zeros(len(drop) + 1, np.int32)         # an impact is below 10^6
        top[0] = drop[0]
        low, high = 0, 1
        for _ in range(height):
            inside = slice(int(first[low]), int(first[high]))
            top[inside] = np.repeat(top[low:high], _ONES[quad[low:high]]) - drop[inside]
            low, high = inside.start, inside.stop
        inner = low                                      # cells above the single places
        all_masks = np.zeros(len(drop) + 1, np.uint8)
        all_masks[:inner] = quad[:inner]
        starts = np.zeros(len(drop) + 1, np.int32)
        starts[:inner] = first[:inner]
        return cls(height, all_masks, starts, top)

    def best(self, rows: np.ndarray, weights: np.ndarray, at_least: int, offer) -> None:
        """Offer (scores, columns) of all columns whose score may matter: the
        joint descent of the paths of ``rows``. ``offer`` gives back the score
        below which nothing matters any more."""
        empty = len(self.maxima) - 1
        column, level = np.zeros(1, np.int64), np.zeros(1, np.int64)
        cells = np.zeros((1, len(rows)), np.int64)
        bound = np.array([int((weights * self.maxima[0]).sum())])
        while True:
            live = bound >= at_least
            if not live.all():
                column, level, cells, bound = column[live], level[live], cells[live], bound[live]
            if not len(bound):
                return
            if len(bound) > BEAM:
                pick = np.argpartition(-bound, BEAM)[:BEAM]
                rest = np.ones(len(bound), bool)
                rest[pick] = False
                now = column[pick], level[pick], cells[pick], bound[pick]
                column, level, cells, bound = column[rest], level[rest], cells[rest], bound[rest]
            else:
                now = column, level, cells, bound
                column, level, cells, bound = column[:0], level[:0], cells[:0], bound[:0]
            c, l, x, b = now
            single = l == self.height
            if single.any():
                at_least = max(at_least, offer(b[single], c[single]))
                c, l, x = c[~single], l[~single], x[~single]
            if not len(c):
                continue
            mask, first = self.masks[x].astype(np.int64), self.first[x].astype(np.int64)
            row_half = (rows[None, :] >> (self.height - 1 - l)[:, None]) & 1
            for half in (0, 1):
                quarter = 2 * row_half + half
                there = (mask >> quarter) & 1 == 1
                child = np.where(there, first + _ONES[mask & ((1 << quarter) - 1)], empty)
                score = self.maxima[child].astype(np.int64) @ weights
                good = np.flatnonzero(score >= at_least)
                if len(good):
                    column, level = np.append(column, 2 * c[good] + half), np.append(level, l[good] + 1)
                    cells, bound = np.concatenate([cells, child[good]]), np.append(bound, score[good])


INDEX = ("doc_ids binary, terms binary, rows binary, df binary, height int, masks binary, maxima binary")


def build_index(docs: DataFrame, n_docs: int, all_terms: int, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per block of documents: ids of its documents, the hashes of its
    terms (sorted) with each one's row and number of documents, and the treap.
    ``n_docs`` and ``all_terms`` are the ``statistics`` of all documents."""
    def build(batches):
        ids: list[np.ndarray] = []
        valid: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        size = count = 0

        def block():
            h, doc = np.concatenate(hashes), np.concatenate(owners)
            order = np.argsort(h, kind="stable")        # texts come in order, so terms are sorted by text as well
            h, doc = h[order], doc[order]
            new_term = np.append(True, h[1:] != h[:-1])
            new = np.flatnonzero(new_term | np.append(True, doc[1:] != doc[:-1]))
            tf = np.diff(np.append(new, len(h)))
            term, doc_at = (np.cumsum(new_term) - 1)[new], doc[new]
            terms, df = h[new_term], np.bincount(term)
            rows = np.empty(len(df), np.int64)
            rows[np.argsort(-df, kind="stable")] = np.arange(len(df))
            norm = length_norm(np.bincount(doc, minlength=count), n_docs, all_terms)
            named = np.concatenate(valid)
            use = np.flatnonzero(named[doc_at])
            if len(use):
                height, masks, maxima = Treap.encode(rows[term[use]], doc_at[use], impact(tf[use], norm[doc_at[use]]))
            else:
                height, masks, maxima = 0, b"", b""
            out = [np.concatenate(ids).astype("<i8").tobytes(), terms.astype("<u8").tobytes(), rows.astype("<u4").tobytes(),
                   df.astype("<u4").tobytes(), height, masks, maxima]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for x in out],
                                              ["doc_ids", "terms", "rows", "df", "height", "masks", "maxima"])

        for b in batches:
            numbers = b.column("doc_id")
            known = numbers.is_valid().to_numpy(zero_copy_only=False)
            numbers = numbers.fill_null(0).to_numpy()
            for row, end, data, offsets in text_slices(b.column("text"), min(WINDOW_BYTES, block_bytes)):
                for h, owner in term_runs(data, offsets):
                    hashes.append(h)
                    owners.append(owner + count)
                ids.append(numbers[row:end])
                valid.append(known[row:end])
                size, count = size + len(data), count + end - row
                if size >= block_bytes or count >= block_docs:
                    if any(map(len, hashes)):
                        yield block()
                    ids, valid, hashes, owners, size, count = [], [], [], [], 0, 0
        if any(map(len, hashes)):
            yield block()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows are megabytes long: the writer looks at its buffers after each of them, not after a hundred.
    checks = {"parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1,
              "parquet.block.size": GROUP_BYTES}
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return written(rows.mapInArrow(build, INDEX), "lexical-index", compression="zstd", **checks)


@dataclass(frozen=True)
class Items:
    """Terms of the items: distinct hashes of all, sorted; for each item the
    numbers of its own and how often it has each."""
    ids: list
    terms: np.ndarray
    begin: np.ndarray
    term: np.ndarray
    times: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: pa.Array) -> "Items":
        hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for row, _, data, offsets in text_slices(texts):
            for h, owner in term_runs(data, offsets):
                hashes.append(h)
                owners.append(owner + row)
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        terms, number = np.unique(h, return_inverse=True)
        pair, times = np.unique(owner * max(1, len(terms)) + number, return_counts=True)
        item, term = np.divmod(pair, max(1, len(terms)))
        return cls(ids, terms, np.searchsorted(item, np.arange(len(ids) + 1)), term, times)


def _places(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ``wanted`` that are among the sorted ``terms``, and where."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    found = np.flatnonzero(terms[at] == wanted)
    return found, at[found]


def document_frequencies(index: DataFrame, items: Items) -> np.ndarray:
    """Documents that hold each of the items' terms (one number a term reaches the driver)."""
    shared = index.sparkSession.sparkContext.broadcast(items.terms)

    def count(batches):
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for terms, df in zip(b.column("terms"), b.column("df")):
                found, at = _places(np.frombuffer(terms.as_buffer(), "<u8"), wanted)
                total[found] += np.frombuffer(df.as_buffer(), "<u4")[at]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], ["term", "df"])

    with arrow_rows(index.sparkSession, 8):
        counts = index.select("terms", "df").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(items.terms), np.int64)
    out[counts.column("term").to_numpy()] = counts.column("df").to_numpy()
    return out


def search(index: DataFrame, items: DataFrame, n_docs: int, top: int = TOP, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item.

    Items are sent to every task after their size is checked; more than
    ``max_item_bytes`` are cut by hash into groups below it, each searched in
    its own pass over the index."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // max_item_bytes) or 1
    out = None
    for g in range(groups):
        part = asked if groups == 1 else asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        found = _search(index, part.toArrow(), n_docs, top)
        out = found if out is None else out.unionByName(found)
    return out


def _search(index: DataFrame, asked: pa.Table, n_docs: int, top: int) -> DataFrame:
    items = Items.build(asked.column("item_id").to_pylist(), asked.column("text").combine_chunks())
    df = document_frequencies(index, items)
    weights = np.array([weight(int(k), n_docs) if k else 0 for k in df], np.int64)
    shared = index.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        n = len(items.ids)
        scores, docs = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
        for b in batches:
            for k in range(len(b)):
                height = b.column("height")[k].as_py()
                if not height:
                    continue
                block = {c: b.column(c)[k].as_buffer() for c in ("doc_ids", "terms", "rows", "masks", "maxima")}
                treap = Treap.decode(height, block["masks"], block["maxima"])
                ids = np.frombuffer(block["doc_ids"], "<i8")
                found, at = _places(np.frombuffer(block["terms"], "<u8"), items.terms)
                row = np.full(len(items.terms), -1, np.int64)
                row[found] = np.frombuffer(block["rows"], "<u4")[at]
                for i in range(n):
                    own = slice(items.begin[i], items.begin[i + 1])
                    term = items.term[own]
                    here = (row[term] >= 0) & (weights[term] > 0)
                    if not here.any():
                        continue
                    term, times = term[here], items.times[own][here]

                    def offer(score, column, i=i):
                        s, d = np.append(scores[i], score), np.append(docs[i], ids[column])
                        keep = np.lexsort((d, -s))[:top]
                        scores[i], docs[i] = s[keep], d[keep]
                        return int(scores[i][-1]) if len(keep) == top else 1

                    treap.best(row[term], weights[term] * times, int(scores[i][-1]) if len(scores[i]) == top else 1, offer)
        count = np.array([len(s) for s in scores], np.int64)
        item = np.repeat(np.arange(n), count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int64()), pa.array([items.ids[i] for i in item.tolist()], pa.int64()),
             pa.array(np.concatenate([*docs, np.empty(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*scores, np.empty(0, np.int64)]), pa.int64())],
            ["item", "item_id", "doc_id", "score"])

    blocks = index.select("doc_ids", "terms", "rows", "height", "masks", "maxima")
    with arrow_rows(index.sparkSession, 1):  # a block at a time
        hits = written(blocks.mapInArrow(run, "item bigint, item_id bigint, doc_id bigint, score bigint"), "search-hits")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """Index all documents and rank them for each item."""
    n_docs, all_terms = statistics(docs)
    index = build_index(docs, n_docs, max(all_terms, 1))
    return search(index, items, n_docs, top)
