"""Removal of repeated byte strings (operator 9) by a hash-compared suffix sort.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a
document with a smaller id. Every such string holds an anchor: the 16-byte
gram with the smallest hash in it, which depends on the string alone. So only
suffixes at anchors are sorted, and of those only the ones whose gram occurs
in several documents.

1. Anchors of every text go to buckets by gram; grams that occur in two
   documents or more come back to their documents.
2. Those occurrences send their context (what a string with this anchor can
   hold: 34 bytes before, 50 from the anchor on) to the gram's bucket. Equal
   contexts travel once per chunk of documents, with their places.
3. In the bucket the contexts of each gram are sorted by suffix: merge sort,
   compared by prefix hashes, common extensions verified on the bytes. A
   string that reaches t bytes left of the anchor is repeated if a context of
   a smaller document shares 50 - t bytes to the right (a run of the sorted
   suffixes) and t bytes to the left.
4. Spans go back to the documents, where they are united and cut out.

A gram that a third of all documents hold is one context per chunk and
distinct surrounding, not one per pair. Texts travel compressed; a task holds
one bucket of anchors (about ``BUCKET_BYTES`` of text) or one chunk of
``CHUNK_DOCS`` documents.

Defined results: null text counts as empty; texts shorter than ``LENGTH``
lose nothing; rows without doc_id are neither compared nor cut; rows that
share a doc_id aren't smaller than one another; an empty table gives no row.
Other columns are not read.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import byte_codes, mix64, polynomial_hashes, text_slices
from eventlens.llm.suffix_sort import prefix_hashes, row_hashes, sort_suffixes, verified_extensions

LENGTH = 50
GRAM = 16
REACH = LENGTH - GRAM             # bytes that a string can hold before its anchor
CONTEXT = REACH + LENGTH
CHUNK_DOCS = 256
BUCKET_BYTES = 8 << 20
_WINDOWS = 1 << 19                # windows whose minimum is taken at a time
_SORT_ROWS = 20_000               # contexts sorted at a time (whole groups)

_CODES = byte_codes(17)
_BASE = np.uint64(0xD1342543DE82EF95)


def _pack(*arrays: np.ndarray) -> bytes:
    head = struct.pack("<B", len(arrays)) + b"".join(struct.pack("<3sQ", a.dtype.str[1:].ljust(3).encode(), a.size) for a in arrays)
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, at, out = raw[0], 1 + 11 * raw[0], []
    for i in range(n):
        kind, size = struct.unpack_from("<3sQ", raw, 1 + 11 * i)
        dtype = np.dtype("<" + kind.decode().strip())
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out


def gram_hashes(data: np.ndarray) -> np.ndarray:
    return mix64(polynomial_hashes(_CODES[data], GRAM, _BASE))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of all strings inside the texts, and their gram
    hashes. The minimum over each window is taken by doubling; hash ties go to
    the first place."""
    places = []
    grams = gram_hashes(data)
    span = REACH + 1
    for begin in range(0, max(0, len(data) - LENGTH + 1), _WINDOWS):
        h = grams[begin:begin + _WINDOWS + REACH]
        x = (h >> np.uint64(22) << np.uint64(22)) | np.arange(len(h), dtype=np.uint64)
        p = 1
        low = x
        while p * 2 <= span:
            low = np.minimum(low[:len(low) - p], low[p:])
            p *= 2
        n = len(h) - span + 1
        if n <= 0:
            continue
        low = np.minimum(low[:n], low[span - p:span - p + n])
        at = (low & np.uint64((1 << 22) - 1)).astype(np.int64) + begin
        window = np.arange(begin, begin + n)
        text = np.searchsorted(offsets, window, side="right") - 1 if len(offsets) > 2 else np.zeros(n, np.int64)
        at = at[window + LENGTH <= offsets[text + 1]]
        if len(at):
            places.append(at[np.append(True, at[1:] != at[:-1])])
    place = np.concatenate(places) if places else np.empty(0, np.int64)
    if len(place):
        place = place[np.append(True, place[1:] != place[:-1])]
    return place, grams[place]


def _buckets(gram: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of grams; mixed once more, since anchors have small hashes."""
    return (mix64(gram ^ _BASE) >> np.uint64(64 - bits)).astype(np.int64)


class _Refs:
    """Documents of a packed table: id, checksum of the text (rows may share an
    id), and how many entries each has."""

    def __init__(self, ids: np.ndarray, crcs: np.ndarray):
        self.ids, self.crcs = ids, crcs

    def of(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, checksums and counts of the sorted document numbers of entries."""
        used, count = np.unique(number, return_counts=True)
        return self.ids[used], self.crcs[used], count.astype(np.uint32)


def _named(texts: pa.Array, ids: pa.Array, row: int, end: int, data: np.ndarray, off: np.ndarray) -> _Refs:
    raw, at = memoryview(np.ascontiguousarray(data)), off.tolist()
    crcs = np.array([zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])], np.uint32)
    return _Refs(ids.slice(row, end - row).to_numpy(zero_copy_only=False).astype(np.int64), crcs)


def _anchor_blobs(rows: DataFrame, bits: int) -> DataFrame:
    """(bucket, blob): anchors of each run of texts by bucket of the gram."""
    def run(batches):
        for b in batches:
            for row, end, data, off in text_slices(b.column("text"), 1 << 20):
                place, gram = anchors(data, off)
                if not len(place):
                    continue
                refs = _named(b.column("text"), b.column("doc_id"), row, end, data, off)
                text = np.searchsorted(off, place, side="right") - 1
                bucket = _buckets(gram, bits)
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) > 0))
                blobs = []
                for s, e in zip(cuts.tolist(), cuts[1:].tolist() + [len(order)]):
                    part = order[s:e]
                    ids, crcs, count = refs.of(text[part])
                    pos = place[part] - off[text[part]]
                    delta = np.diff(pos, prepend=0)
                    first = np.append(0, np.cumsum(count)[:-1]).astype(np.int64)
                    delta[first] = pos[first]
                    low = gram[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    blobs.append(_pack(ids, crcs, count, delta.astype("<u2" if delta.max() < 1 << 16 else "<u4"), low.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return rows.mapInArrow(run, "bucket bigint, blob binary")


def _by_chunk(ids: np.ndarray, crcs: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Entries as rows (chunk, blob), one per chunk of documents."""
    order = np.lexsort((crcs, ids))
    ids, crcs = ids[order], crcs[order]
    chunk = np.floor_divide(ids, CHUNK_DOCS)
    cuts = np.flatnonzero(np.append(len(ids) > 0, np.diff(chunk) > 0))
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(crcs.astype(np.int64)) != 0)) if len(ids) else np.empty(0, bool)
    blobs = []
    for s, e in zip(cuts.tolist(), cuts[1:].tolist() + [len(ids)]):
        first = np.flatnonzero(new[s:e]) + s
        blobs.append(_pack(ids[first], crcs[first], np.diff(np.append(first, e)).astype(np.uint32), *[v[order[s:e]] for v in values]))
    return pa.table({"chunk": pa.array(chunk[cuts], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _entries(blobs: list[bytes]) -> list[np.ndarray]:
    """Ids and checksums per entry, then the other arrays, of several blobs."""
    parts = [_unpack(x) for x in blobs]
    out = [np.concatenate([np.repeat(p[k], p[2]) for p in parts]) for k in (0, 1)]
    return out + [np.concatenate([p[k] for p in parts]) for k in range(3, len(parts[0]))]


def _shared_places(table: pa.Table) -> pa.Table:
    """Step 1 in a bucket: the places of grams that several documents hold."""
    ids, crcs, pos, grams = [], [], [], []
    for raw in table.column("blob").to_pylist():
        d, c, count, delta, low = _unpack(raw)
        total = np.cumsum(delta, dtype=np.int64)
        first = np.append(0, np.cumsum(count)[:-1]).astype(np.int64)
        base = np.repeat(total[first] - delta[first], count)
        ids.append(np.repeat(d, count)), crcs.append(np.repeat(c, count)), pos.append((total - base).astype(np.uint32))
        wide = np.zeros((len(total), 8), np.uint8)
        wide[:, :6] = low.reshape(-1, 6)
        grams.append(wide.view("<u8").reshape(-1))
    doc, crc, place, gram = map(np.concatenate, (ids, crcs, pos, grams))
    order = np.argsort(gram, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(gram[order]) != 0))
    sorted_doc = doc[order]
    several = np.minimum.reduceat(sorted_doc, cuts) != np.maximum.reduceat(sorted_doc, cuts)
    keep = order[np.repeat(several, np.diff(np.append(cuts, len(order))))]
    return _by_chunk(doc[keep], crc[keep], place[keep])


def _text_blobs(rows: DataFrame) -> DataFrame:
    """(chunk, texts): the texts of each chunk in a run, compressed together."""
    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for row, end, data, off in text_slices(b.column("text"), 4 << 20):
                ids = b.column("doc_id").slice(row, end - row).to_numpy(zero_copy_only=False).astype(np.int64)
                chunk = np.floor_divide(ids, CHUNK_DOCS)
                order = np.argsort(chunk, kind="stable")
                cuts = np.flatnonzero(np.append(True, np.diff(chunk[order]) > 0))
                blobs = []
                for s, e in zip(cuts.tolist(), cuts[1:].tolist() + [len(order)]):
                    part = order[s:e]
                    body = data[off[part[0]]:off[part[-1] + 1]] if part[-1] - part[0] == len(part) - 1 else np.concatenate(
                        [data[off[i]:off[i + 1]] for i in part])
                    blobs.append(packer.compress(_pack(ids[part], (off[part + 1] - off[part]).astype(np.int64), body)))
                yield pa.RecordBatch.from_arrays([pa.array(chunk[order[cuts]]), pa.array(blobs, pa.binary())], ["chunk", "texts"])

    return rows.mapInArrow(run, "chunk bigint, texts binary")


def _texts(table: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    unpacker = zstandard.ZstdDecompressor()
    for raw in table.column("texts").to_pylist():
        ids, lengths, body = _unpack(unpacker.decompress(raw))
        at = np.append(0, np.cumsum(lengths)).tolist()
        for i, doc in enumerate(ids.tolist()):
            yield doc, body[at[i]:at[i + 1]]


def _places_of(blobs: list[bytes]) -> dict[tuple[int, int], list[np.ndarray]]:
    """Per document (id, checksum) the other arrays of its entries."""
    out: dict[tuple[int, int], list] = {}
    for raw in blobs:
        ids, crcs, count, *values = _unpack(raw)
        at = np.append(0, np.cumsum(count, dtype=np.int64)).tolist()
        for i, key in enumerate(zip(ids.tolist(), crcs.tolist())):
            out.setdefault(key, []).append([v[at[i]:at[i + 1]] for v in values])
    return {k: [np.concatenate(c) for c in zip(*v)] for k, v in out.items()}


def _differ(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and ``b`` differ, a slice at a time."""
    out = np.empty(len(a), bool)
    for i in range(0, len(a), _SORT_ROWS):
        out[i:i + _SORT_ROWS] = (rows[a[i:i + _SORT_ROWS]] != rows[b[i:i + _SORT_ROWS]]).any(1)
    return out


def _contexts(texts: pa.Table, shared: pa.Table, bits: int) -> pa.Table:
    """Step 2 in a chunk: (bucket, blob) of distinct contexts and their places."""
    places = _places_of(shared.column("blob").to_pylist())
    rows, left, right, doc_no, pos, ids, crcs = [], [], [], [], [], [], []
    reach = np.arange(-REACH, LENGTH)
    for doc, data in _texts(texts) if places else ():
        crc = zlib.crc32(np.ascontiguousarray(data))
        if (doc, crc) not in places:
            continue
        (p,) = places.pop((doc, crc))      # a row that repeats another has the same places
        p = p.astype(np.int64)
        at = p[:, None] + reach
        inside = (at >= 0) & (at < len(data))
        rows.append(np.where(inside, data[np.clip(at, 0, len(data) - 1)].astype(np.uint16) + 1, 0).astype(np.uint16))
        left.append(np.minimum(p, REACH).astype(np.uint8))
        right.append(np.minimum(len(data) - p, LENGTH).astype(np.uint8))
        doc_no.append(np.full(len(p), len(ids), np.uint16 if len(ids) < 1 << 16 else np.uint32))
        pos.append(p.astype(np.uint32))
        ids.append(doc), crcs.append(crc)
    empty = pa.table({"bucket": pa.array([], pa.int64()), "blob": pa.array([], pa.binary())})
    if not rows:
        return empty
    m, l, r, d, p = map(np.concatenate, (rows, left, right, doc_no, pos))
    gram = gram_hashes((m[:, REACH:REACH + GRAM] - 1).astype(np.uint8).reshape(-1))[::GRAM] if len(m) else np.empty(0, np.uint64)
    whole = row_hashes(m)
    order = np.lexsort((d, whole, gram))
    g, w = gram[order], whole[order]
    new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
    new[1:] |= _differ(m, order[1:], order[:-1])  # equal hashes of other bytes are contexts of their own
    bucket = _buckets(g, bits)
    by = np.argsort(bucket, kind="stable")   # equal contexts stay together
    order, new, bucket = order[by], new[by], bucket[by]
    context = np.cumsum(new) - 1
    cuts = np.flatnonzero(np.append(True, np.diff(bucket) > 0))
    packer = zstandard.ZstdCompressor(level=1)
    id_table, crc_table = np.array(ids, np.int64), np.array(crcs, np.uint32)
    blobs = []
    for s, e in zip(cuts.tolist(), cuts[1:].tolist() + [len(order)]):
        part = order[s:e]
        first = part[new[s:e]]
        used, number = np.unique(d[part], return_inverse=True)
        wide = m[first]
        blobs.append(packer.compress(_pack(
            id_table[used], crc_table[used], (wide - (wide > 0)).astype(np.uint8).reshape(-1), l[first], r[first],
            np.bincount(context[s:e] - context[s]).astype(np.uint32), number.astype(np.uint16), p[part])))
    return pa.table({"bucket": pa.array(bucket[cuts], pa.int64()), "blob": pa.array(blobs, pa.binary())})


def repeated_strings(rows: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, start: np.ndarray,
                     size: np.ndarray) -> np.ndarray:
    """Step 3: for each context and each t, whether the string that begins t
    bytes before the anchor is also in a context of a smaller document.
    Contexts (byte codes, 0 beyond the text) lie together by gram."""
    out = np.zeros((len(rows), REACH + 1), bool)
    suffix = rows[:, REACH:]
    prefix = prefix_hashes(suffix)
    order = sort_suffixes(suffix, prefix, start, size)
    common = verified_extensions(suffix, prefix, order, start)
    if common is None:                      # a hash collision: sort by the bytes themselves
        group = np.repeat(np.arange(len(np.unique(start))), np.unique(start, return_counts=True)[1])
        order = np.lexsort((*suffix.T[::-1], group))
        differs = suffix[order[1:]] != suffix[order[:-1]]
        common = np.append(0, np.where(differs.any(1), differs.argmax(1), LENGTH))
        common[np.arange(len(order)) == start] = 0
    back = prefix_hashes(rows[:, REACH - 1::-1])
    d, l, r = doc[order], left[order], right[order]
    common = np.minimum(common, np.minimum(r, np.append(0, r[:-1])))
    first = np.arange(len(order)) == start
    for t in range(REACH + 1):
        run = np.cumsum(first | (common < LENGTH - t)) - 1
        usable = (l >= t) & (r >= LENGTH - t) & (np.bincount(run)[run] > 1)
        at = np.flatnonzero(usable)
        if not len(at):
            continue
        h = back[order[at], t]
        by = np.lexsort((d[at], h, run[at]))
        at, h = at[by], h[by]
        new = np.append(True, (np.diff(run[at]) != 0) | (h[1:] != h[:-1]))
        lead = at[new][np.cumsum(new) - 1]             # the smallest document of each class
        again = d[at] > d[lead]
        who, like = order[at[again]], order[lead[again]]
        if t:
            who = who[(rows[who, REACH - t:REACH] == rows[like, REACH - t:REACH]).all(1)]
        out[who, t] = True
    return out


def _spans(table: pa.Table) -> pa.Table:
    """Step 3 in a bucket: (chunk, blob) of the spans to remove."""
    unpacker = zstandard.ZstdDecompressor()
    codes, left, right, context, ids, crcs, pos, n = [], [], [], [], [], [], [], 0
    for raw in table.column("blob").to_pylist():
        d, c, m, l, r, count, number, p = _unpack(unpacker.decompress(raw))
        m = m.reshape(-1, CONTEXT).astype(np.uint16) + 1
        col = np.arange(CONTEXT)
        m[(col < REACH - l.astype(int)[:, None]) | (col >= REACH + r.astype(int)[:, None])] = 0
        codes.append(m), left.append(l.astype(np.int64)), right.append(r.astype(np.int64))
        context.append(np.repeat(np.arange(n, n + len(l)), count))
        ids.append(d[number]), crcs.append(c[number]), pos.append(p.astype(np.int64))
        n += len(l)
    rows = np.concatenate(codes)
    codes.clear()
    left, right, context, doc, crc, pos = map(np.concatenate, (left, right, context, ids, crcs, pos))
    # equal contexts of several chunks are one, owned by the smallest document
    gram = gram_hashes((rows[:, REACH:REACH + GRAM] - 1).astype(np.uint8).reshape(-1))[::GRAM]
    whole = row_hashes(rows)
    by = np.lexsort((whole, gram))
    g, w = gram[by], whole[by]
    new = np.append(True, (g[1:] != g[:-1]) | (w[1:] != w[:-1]))
    new[1:] |= _differ(rows, by[1:], by[:-1])
    number = np.empty(len(by), np.int64)
    number[by] = np.cumsum(new) - 1
    one = by[new]
    rows, left, right, gram = rows[one], left[one], right[one], gram[one]
    context = number[context]
    owner = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(owner, context, doc)
    cuts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    size = np.repeat(np.diff(np.append(cuts, len(one))), np.diff(np.append(cuts, len(one))))
    start = np.repeat(cuts, np.diff(np.append(cuts, len(one))))
    partly = np.zeros((len(one), REACH + 1), bool)
    begin = 0
    while begin < len(one):                 # whole groups, about _SORT_ROWS contexts at a time
        end = min(begin + _SORT_ROWS, len(one))
        end = len(one) if end == len(one) else max(int(start[end]), begin + int(size[begin]))
        part = np.arange(begin, end)[size[begin:end] > 1]
        if len(part):
            s = size[part]
            heads = np.flatnonzero(np.append(True, start[part][1:] != start[part][:-1]))
            partly[part] = repeated_strings(rows[part], left[part], right[part], owner[part],
                                            np.repeat(heads, s[heads]), s)
        begin = end
    # all strings of a context are repeated where a smaller document owns it
    t = np.arange(REACH + 1)
    valid = (t <= left[:, None]) & (t >= LENGTH - right[:, None])
    out = []
    for mask, who in ((valid, np.flatnonzero(doc > owner[context])), (partly, np.flatnonzero(doc == owner[context]))):
        edge = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        count = np.bincount(row, minlength=len(one))
        have = count[context[who]]
        rep = np.repeat(who, have)
        base = np.append(0, np.cumsum(count))[context[rep]]
        k = base + np.arange(len(rep)) - np.repeat(np.cumsum(have) - have, have)
        out.append((doc[rep], crc[rep], pos[rep] - (last[k] - 1), pos[rep] - first[k] + LENGTH))
    d, c, a, b = (np.concatenate(x) for x in zip(*out))
    return _by_chunk(d, c, a.astype(np.uint32), (b - a).astype(np.uint8))


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    """Step 4 in a chunk: what remains of each text."""
    removed = _places_of(spans.column("blob").to_pylist())
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept")}
    for doc, data in _texts(texts):
        data = np.ascontiguousarray(data)
        found = removed.get((doc, zlib.crc32(data)))
        n_removed = n_spans = 0
        kept = data
        if found:
            begin = found[0].astype(np.int64)
            depth = np.bincount(begin, minlength=len(data) + 1) - np.bincount(begin + found[1], minlength=len(data) + 1)
            gone = np.cumsum(depth[:len(data)]) > 0
            n_removed = int(np.count_nonzero(gone))
            n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
            kept = data[~gone]
        for k, v in zip(out, (doc, len(data), n_removed, n_spans, kept.tobytes())):
            out[k].append(v)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and ``kept``,
    the bytes that remain."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    named, loose = rows.filter("doc_id IS NOT NULL"), rows.filter("doc_id IS NULL")
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(-(-total // BUCKET_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits = max(1, (wanted - 1).bit_length())
    shared = (_anchor_blobs(named, bits).groupBy("bucket")
              .applyInArrow(lambda t: _shared_places(t), "chunk bigint, blob binary"))
    contexts = (_text_blobs(named).groupBy("chunk").cogroup(shared.groupBy("chunk"))
                .applyInArrow(lambda a, b: _contexts(a, b, bits), "bucket bigint, blob binary"))
    spans = contexts.groupBy("bucket").applyInArrow(lambda t: _spans(t), "chunk bigint, blob binary")
    cut = (_text_blobs(named).groupBy("chunk").cogroup(spans.groupBy("chunk"))
           .applyInArrow(lambda a, b: _cut(a, b), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"))
    whole = loose.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                         F.lit(0).cast("long").alias("n_spans"), F.col("text").cast("binary").alias("kept"))
    return cut.union(whole)


def repeats_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
