"""Near-duplicate documents (operator 5) by BagMinHash.

A text is a multiset of shingles of five words. Each (shingle, weight strip)
is a Poisson process on the line: strips [0,1), [1,2), [2,4), [4,8) ... have
their width as rate; in a strip that the weight covers in part, points carry
a random level and those above the weight are dropped. The points are thrown
into the signature's registers; each keeps its smallest. Two texts agree in a
register with probability equal to their weighted Jaccard similarity. Strips
grow by doubling, so a weight w costs O(log w) processes, and processes are
followed only up to the level that fills all registers.

Bands of registers give candidates; the overlap of the whole multisets
verifies them.

Links: texts with the same words are one class from the start. Each bucket's
members are compared with one member (its pivot), not with one another; in
buckets still spread over several components after two pivots, the members
outside the largest component are compared with all, in blocks. Components of the links are the classes.

Words are runs of letters, digits and non-ASCII characters, lower-cased.
Defined results: a text of one to four words has one shingle of all of them;
a text without words (null, empty, marks only) is its own class; rows without
doc_id have no class and stay; repeated rows of a document share its class;
rows that share a doc_id but not the words are documents of their own, each with
its class; an empty table gives no row. Other columns are not read.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import byte_codes, drop_worker_memory, mix64, text_slices, written
from eventlens.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
BLOCK = 128  # members of a bucket that are compared in one group

_CODES = byte_codes(57)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)
_STRIP = np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a run of texts, and where each text's words begin
    (one more entry than texts)."""
    word = _IS_WORD[data]
    begins = word.copy()
    if len(data):
        begins[1:] &= ~word[:-1]
        edge = offsets[1:-1]
        edge = edge[edge < len(data)]
        begins[edge] |= word[edge]
    first = np.flatnonzero(begins)
    words_before = np.append(0, np.cumsum(begins))[offsets]
    if not len(first):
        return np.empty(0, np.uint64), words_before
    place = np.arange(len(data)) - np.repeat(first, np.diff(np.append(first, len(data)))) if first[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), np.int64)
        place[first[0]:] = np.arange(first[0], len(data)) - np.repeat(first, np.diff(np.append(first, len(data))))
    with np.errstate(over="ignore"):
        value = np.where(word, _CODES[data] * _powers(int(place.max()) + 1)[place], np.uint64(0))
        return mix64(np.add.reduceat(value, first)), words_before


def shingles(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and the number of the text of each."""
    n_texts = len(begin) - 1
    count = np.diff(begin)
    hashes, owners = [], []
    with np.errstate(over="ignore"):
        def rolled(at, k):
            h = np.zeros(len(at), np.uint64)
            for i in range(k):
                h = h * _BASE + words[at + i]
            return mix64(h + np.uint64(k))

        for k in range(1, WORDS):                         # short texts: all words are one shingle
            texts = np.flatnonzero(count == k)
            hashes.append(rolled(begin[texts], k))
            owners.append(texts)
        long = np.maximum(count - WORDS + 1, 0)
        owner = np.repeat(np.arange(n_texts), long)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(long) - long, long) + begin[owner]
        hashes.append(rolled(at, WORDS))
        owners.append(owner)
    return np.concatenate(hashes), np.concatenate(owners)


def weighted(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, shingle) with its number of occurrences."""
    order = np.lexsort((hashes, owners))
    h, o = hashes[order], owners[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def bag_signatures(h: np.ndarray, owner: np.ndarray, weight: np.ndarray, n_texts: int, m: int = REGISTERS) -> np.ndarray:
    """Signature of each text: the smallest point in each of ``m`` registers
    (texts without shingles keep infinity)."""
    sig = np.full((n_texts, m), np.inf)
    total = np.bincount(owner, weight, n_texts)
    limit = m * (np.log(m) + 4) / np.maximum(total, 1)
    todo = total > 0
    with np.errstate(over="ignore"):
        while todo.any():
            chosen = todo[owner]
            base, own, w = h[chosen], owner[chosen], weight[chosen]
            strip = 0
            while len(base):
                low = 0 if strip == 0 else 1 << (strip - 1)
                rate = 1.0 if strip == 0 else float(low)
                seed, o, ww = base ^ mix64(np.full(1, strip + 1, np.uint64) * _STRIP), own, w
                x, k = np.zeros(len(seed)), 0
                while len(seed):
                    k += 1
                    z = mix64(seed + np.uint64(k) * _STEP)
                    x = x - np.log(((z >> np.uint64(11)).astype(float) + 1) * 2.0 ** -53) / rate
                    live = x <= limit[o]
                    seed, o, ww, x, z = seed[live], o[live], ww[live], x[live], z[live]
                    z = mix64(z ^ _STRIP)
                    register = ((z >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                    keep = slice(None) if strip < 2 else low + (z & np.uint64(low - 1)).astype(np.int64) < ww
                    np.minimum.at(sig.reshape(-1), (o * m + register.astype(np.int64))[keep], x[keep])
                strip += 1
                more = w > (1 << (strip - 1))
                base, own, w = base[more], own[more], w[more]
            todo &= np.isinf(sig).any(1)
            limit = limit * 3
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), BANDS, ROWS)
    out = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64)), (len(sig), BANDS)).copy()
    with np.errstate(over="ignore"):
        for r in range(ROWS):
            out = mix64(out * _BASE + bits[:, :, r])
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, digest, keys): a hash of the text, a digest of its
    words and the band keys; a text without words has neither of the last two."""
    def run(batches):
        drop_worker_memory()
        for b in batches:
            for row, end, data, off in text_slices(pc.utf8_lower(b.column("text"))):
                words, begin = word_hashes(data, off)
                n = end - row
                keys = band_keys(bag_signatures(*weighted(*shingles(words, begin)), n))
                has = np.diff(begin) > 0
                raw, at = memoryview(words.tobytes()), (8 * begin).tolist()
                digest = [hashlib.md5(raw[at[i]:at[i + 1]]).digest() if has[i] else None for i in range(n)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has * BANDS)), pa.int32()), pa.array(keys[has].reshape(-1)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(row, n), b.column("text_hash").slice(row, n),
                                                  pa.array(digest, pa.binary()), lists], ["doc_id", "text_hash", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id bigint, text_hash bigint, digest binary, keys array<bigint>")


def multisets(docs: DataFrame) -> DataFrame:
    """(doc, bag): sorted hashes of (shingle, occurrence), so the overlap of
    two multisets is the intersection of their bags."""
    def run(batches):
        drop_worker_memory()
        for b in batches:
            ids = b.column("doc_id")
            for row, end, data, off in text_slices(pc.utf8_lower(b.column("text"))):
                h, o, w = weighted(*shingles(*word_hashes(data, off)))
                occurrence = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                with np.errstate(over="ignore"):
                    each = mix64(np.repeat(h, w) + occurrence.astype(np.uint64) * _STEP)
                owner = np.repeat(o, w)
                each = each[np.lexsort((each, owner))]
                at = np.append(0, np.cumsum(np.bincount(owner, minlength=end - row)))
                bags = [each[at[i]:at[i + 1]].tobytes() for i in range(end - row)]
                yield pa.RecordBatch.from_arrays([ids.slice(row, end - row), pa.array(bags, pa.binary())], ["doc", "bag"])

    return docs.mapInArrow(run, "doc bigint, bag binary")


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    shared = int(np.count_nonzero(b[at] == a))
    return shared / (len(a) + len(b) - shared)


def verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose multisets are similar enough. The second
    join is on pivots that very many rows may share; Spark splits it."""
    both = (pairs.join(bags.select(F.col("doc").alias("a"), F.col("bag").alias("bag_a")), "a")
            .join(bags.select(F.col("doc").alias("b"), F.col("bag").alias("bag_b")), "b"))

    def run(batches):
        for batch in batches:
            good = [_similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least
                    for x, y in zip(batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a bigint, b bigint")


def _blockwise(members: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """Links between members (key, doc, component, ...) of an open bucket that
    are in different components. Those outside the bucket's largest component
    are compared with all members, a block of each at a time; members of the
    largest one never meet each other."""
    own = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "qb", "mb", "asks", "doc", "component"]
    asking = (members.filter("component <> main").withColumn("qb", own("q_blocks")).withColumn("mb", every("m_blocks"))
              .withColumn("asks", F.lit(True)).select(columns))
    asked = (members.withColumn("mb", own("m_blocks")).withColumn("qb", every("q_blocks"))
             .withColumn("asks", F.lit(False)).select(columns))

    def run(table: pa.Table) -> pa.Table:
        docs, comp = (table.column(c).to_numpy() for c in ("doc", "component"))
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        bag = [np.frombuffer(x, np.uint64) for x in table.column("bag").to_pylist()]
        out = [(docs[x], docs[y]) for x in np.flatnonzero(asks) for y in np.flatnonzero(~asks & (comp != comp[x]))
               if min(len(bag[x]), len(bag[y])) >= least * max(len(bag[x]), len(bag[y])) and _similarity(bag[x], bag[y]) >= least]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    placed = asking.union(asked).join(bags, "doc")
    return placed.groupBy("key", "qb", "mb").applyInArrow(run, "a bigint, b bigint")


def _with_nodes(reps: DataFrame) -> tuple[DataFrame, bool]:
    """``reps`` (digest, doc, keys) with a node number each, and whether some
    differs from its doc. Where texts of several words share their smallest
    doc_id, one keeps it as its node; the others get numbers above all ids."""
    shared = written(reps.groupBy("doc").agg(F.count(F.lit(1)).alias("texts"), F.min("digest").alias("own")).filter("texts > 1"), "shared-ids")
    if shared.isEmpty():
        return reps.withColumn("node", F.col("doc")), False
    other = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("digest"), 2)
    named = reps.join(shared.select("doc", "own"), "doc", "left")
    return named.withColumn("node", F.when(F.col("own").isNull() | (F.col("own") == F.col("digest")), F.col("doc")).otherwise(other)).drop("own"), True


def _classes(docs: DataFrame, least: float) -> DataFrame:
    """One row per row: doc_id, text_hash, class_id."""
    sketched = written(sketches(docs), "sketches")
    reps = (sketched.filter("doc_id IS NOT NULL AND digest IS NOT NULL").groupBy("digest")
            .agg(F.min("doc_id").alias("doc"), F.first("keys").alias("keys"), F.min("text_hash").alias("text_hash")))
    reps, apart_ids = _with_nodes(reps)
    buckets = reps.select(F.explode("keys").alias("key"), F.col("node").alias("doc"))
    shared = (buckets.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high"))
    members = written(buckets.join(shared, "key"), "bucket-members")
    wanted = members.select("doc").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if apart_ids:  # the text of a node is told by its hash beside the id
        named = written(reps.select("node", F.col("doc").alias("_id"), "digest").join(wanted, F.col("node") == F.col("doc"), "left_semi"), "node-ids")
        rows = sketched.select("doc_id", "text_hash", "digest").distinct().join(named, (F.col("doc_id") == F.col("_id")) & (
            sketched["digest"] == named["digest"])).select(F.col("node").alias("doc"), "_id", "text_hash")
        texts = texts.withColumn("_hash", F.xxhash64("text")).join(
            rows, (F.col("doc_id") == F.col("_id")) & F.col("_hash").eqNullSafe(F.col("text_hash"))).select("text", "doc")
    else:
        texts = texts.join(wanted, F.col("doc_id") == F.col("doc"), "left_semi").select("text", F.col("doc_id").alias("doc"))
    bags = written(multisets(texts.withColumnRenamed("doc", "doc_id")).dropDuplicates(["doc"]), "bags")

    first = written(verified(members.filter("doc <> low").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct(),
                             bags, least), "links")
    apart = members.filter("doc <> low AND doc <> high").join(
        first, (F.col("doc") == F.col("a")) & (F.col("low") == F.col("b")), "left_anti")
    second = verified(apart.select(F.col("doc").alias("a"), F.col("high").alias("b")).distinct(), bags, least)
    comp = written(components(first.union(second)), "classes")
    last = written(_blockwise(_still_open(members, comp), bags, least), "links")
    if not last.isEmpty():
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).union(last))
    if apart_ids:  # a class is named by the smallest id of its documents
        ids = reps.select("node", F.col("doc").alias("_id"))
        named = comp.join(ids, "node").groupBy("component").agg(F.min("_id").alias("_name"))
        comp = comp.join(named, "component").select("node", F.col("_name").alias("component"))

    found = (sketched.join(reps.select("digest", "node", F.col("doc").alias("own")), "digest", "left")
             .join(comp, "node", "left"))
    class_id = F.coalesce("component", "own", "doc_id")
    return found.select("doc_id", "text_hash", F.when(F.col("doc_id").isNotNull(), class_id).alias("class_id")).withColumn(
        "kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)))


def near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class)
    and kept (it is that document)."""
    return _classes(docs, least).drop("text_hash")


def _still_open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, doc, component, main, q_blocks, m_blocks) of the buckets that are
    spread over several components; ``main`` is the largest one."""
    named = (members.select("key", "doc").join(comp.withColumnRenamed("node", "doc"), "doc", "left")
             .withColumn("component", F.coalesce("component", "doc")))
    spread = (named.groupBy("key", "component").agg(F.count("*").alias("n"))
              .groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"),
                                  F.sum("n").alias("total"), F.max("n").alias("most")).filter("total > most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    load = spread.select("key", "main", blocks(F.col("total") - F.col("most")).alias("q_blocks"), blocks(F.col("total")).alias("m_blocks"))
    return written(named.join(load, "key"), "open-buckets")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One document of each class stays; a repeated row of it goes too."""
    kept = _classes(docs, least).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    same = (F.col("doc_id").cast("long") == F.col("_kept_id")) & F.xxhash64("text").eqNullSafe(F.col("_kept_hash"))
    named = docs.filter("doc_id IS NOT NULL").join(kept, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return named.unionByName(docs.filter("doc_id IS NULL"))
