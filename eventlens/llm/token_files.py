"""Token-ID files (operator 2): frequency-ranked ids in byte-aligned
variable-length coding with separate control bytes.

Within a block of documents the distinct ids are ranked by how often they
occur; an id is stored as its rank in one to four bytes. The lengths stand
apart, two bits each, four to a control byte, so decoding is a table lookup
per control byte and one gather per byte place, all in numpy.

File: blocks one after another. Block: magic ``FRV1``, the numbers of
documents, ids and distinct ids (uint32 each), the length of the data bytes
(uint32), document ids (int64, null as the smallest), ids per document (uint32), distinct ids by
falling frequency (uint32), control bytes, data bytes. Little-endian.

Defined results: null text counts as empty (only the end id); documents are in
ascending order of id, null ids first, equal ids by text; an empty table gives
no file and no row. Other columns are not read.
"""
from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import shared_path, written
from eventlens.llm.files import opened, published
from eventlens.llm.token_ids import encoder

MAGIC = b"FRV1"
#: Ids of a block (one longer document makes its own block).
BLOCK_IDS = 2_000_000
NULL_ID = -(1 << 63)

_LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + 1  # control byte -> four lengths


def pack_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned ranks."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = size - 1
    quad = padded.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    data = np.empty(int(end[-1]) if n else 0, np.uint8)
    for place in range(int(size.max()) if n else 0):
        has = size > place
        data[at[has] + place] = (ranks[has] >> (8 * place)) & 0xFF
    return control.tobytes(), data.tobytes()


def unpack_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(n, np.uint32)
    for place in range(int(size.max()) if n else 0):
        has = np.flatnonzero(size > place)
        out[has] |= raw[at[has] + place].astype(np.uint32) << np.uint32(8 * place)
    return out


def encode_block(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    count = np.bincount(ids)
    distinct = np.flatnonzero(count)
    by_rank = distinct[np.lexsort((distinct, -count[distinct]))]
    rank = np.zeros(len(count), np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    control, data = pack_ranks(rank[ids])
    return b"".join((MAGIC, struct.pack("<4I", len(doc_ids), len(ids), len(by_rank), len(data)),
                     doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), by_rank.astype("<u4").tobytes(),
                     control, data))


def decode_blocks(f) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document ids, ids per document, ids) of each block of an open file."""
    while head := f.read(20):
        if bytes(head[:4]) != MAGIC:
            raise ValueError("not a token file")
        docs, n, distinct, size = struct.unpack("<4I", head[4:])
        doc_ids = np.frombuffer(f.read(8 * docs), "<i8")
        lengths = np.frombuffer(f.read(4 * docs), "<u4")
        by_rank = np.frombuffer(f.read(4 * distinct), "<u4")
        control = f.read(-(-n // 4))
        yield doc_ids, lengths, by_rank[unpack_ranks(control, f.read(size), n)]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write the documents in
    ascending order of id, one file per range of ids. Returns the directory:
    file_no, path, n_docs, n_ids."""
    folder = shared_path(docs.sparkSession, "token-files")

    def write(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        enc = encoder(tokenizer)
        uri = f"{folder}/tokens-{task:06d}.frv"
        n_docs = n_ids = 0
        first = next(batches, None)
        if first is None:
            return

        with published(uri) as out:
            doc_ids, lengths, parts, held = [], [], [], 0

            def flush():
                nonlocal held
                out.write(encode_block(np.concatenate(doc_ids), np.concatenate(lengths), np.concatenate(parts)))
                doc_ids.clear(), lengths.clear(), parts.clear()
                held = 0

            for b in itertools.chain([first], batches):
                numbers = pc.fill_null(b.column("doc_id"), NULL_ID).to_numpy()
                for row, end, ids, ends in enc.encode(b.column("text")):
                    ids = np.insert(ids, ends, end_id)                    # after each document's ids
                    ends = ends + np.arange(1, end - row + 1)
                    n_docs, n_ids = n_docs + end - row, n_ids + len(ids)
                    here, begin = 0, 0
                    while here < end - row:                               # as many documents as the block has room for
                        stop = int(np.searchsorted(ends, begin + block_ids - held, side="right"))
                        if stop == here:
                            if held:
                                flush()
                                continue
                            stop += 1
                        doc_ids.append(numbers[row + here:row + stop])
                        lengths.append(np.diff(np.append(begin, ends[here:stop])))
                        parts.append(ids[begin:ends[stop - 1]])
                        held += int(ends[stop - 1]) - begin
                        here, begin = stop, int(ends[stop - 1])
            if parts:
                flush()
        yield pa.RecordBatch.from_pydict({"file_no": pa.array([task], pa.int64()), "path": [uri],
                                          "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(write, "file_no bigint, path string, n_docs bigint, n_ids bigint"), "token-directory")


def read_token_files(directory: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents
    before it), n_tokens and the ids as little-endian uint32 bytes' crc32.
    The running sum over files is over one row per file."""
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = directory.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def read(batches):
        for b in batches:
            for uri, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                with opened(uri) as f:
                    for doc_ids, lengths, ids in decode_blocks(f):
                        ends = np.cumsum(lengths, dtype=np.int64)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(doc_ids, mask=doc_ids == NULL_ID), pa.array(base + ends - lengths),
                            pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])
                        base += int(ends[-1])

    spread = files.select("path", "base").repartition(max(1, directory.count()))  # a file a task
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_file_report(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer, end_id))
