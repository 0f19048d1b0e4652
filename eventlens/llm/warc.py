"""WARC archives with a two-level capture index (operator 7).

Each task writes its pages to one archive, a gzip member per record. The
captures are then sorted by reversed-host URL key (``com,example,www)/path``)
into index files of compressed blocks: only keys and places move, no payload.
The block directory, one row per block, is the sparse upper level. A lookup
binary-searches the directory, reads one block by its range, binary-searches
the block and reads the record by its range.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
smallest page_id is a response, the others are revisits of it; smaller
payloads are all responses.

Defined results: null html is an empty payload; a null or odd url gives an
empty host in the key; rows without page_id are responses; repeated rows are
archived each (rows with the smallest id and equal payload are all responses);
an empty table gives no archive. Other columns are not read.
"""
from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import shared_path, written
from eventlens.llm.files import opened, published

BLOCK_CAPTURES = 256
LEVEL = 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = "key string, page_id bigint, archive string, at bigint, length bigint"
DIRECTORY = "first_key string, last_key string, index string, block_at bigint, block_length bigint, captures bigint"


def url_key(url: Column) -> Column:
    """Reversed-host sort key: ``https://www.Example.com:80/a?b#c`` gives
    ``com,example,www)/a?b``. White space and control characters become ``_``."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)
    return F.regexp_replace(key, r"[\x00-\x20\x7f]", "_")


def capture_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, digest, refers_to) of the revisits. Only ids and digests are
    grouped; a payload that a third of all pages share is reduced before the
    shuffle."""
    ids = pages.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return ids.join(first, "digest").filter("page_id <> refers_to").distinct()


def _clean(value: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def _uri(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """One WARC record: an HTTP response, or a revisit with its head only."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _uri(page_id)),
              ("WARC-Date", date), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _uri(refers_to))]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a record, checked: lengths must fit, and a response's payload
    must have the digest that its head gives."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (
            len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(v) if (v := fields.get(name, "")[10:-1]) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length,
            "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"),
            "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write all pages as archives; returns the captures: key, page_id,
    archive, at, length. Payloads are shuffled once, by page_id."""
    folder = shared_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "key": url_key(F.col("url"))})
    placed = rows.join(capture_roles(rows, min_bytes), ["page_id", "digest"], "left").select("key", "page_id", "url", "html", "refers_to")

    def write(batches):
        from pyspark import TaskContext
        archive = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz"
        first = next(batches, None)
        if first is None:
            return
        keys, ids, places, lengths, at = [], [], [], [], 0
        with published(archive) as out:
            for b in itertools.chain([first], batches):
                for key, page_id, url, html, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    member = coder.compress(record(page_id, url, html.encode(), refers_to, date)) + coder.flush()
                    out.write(member)
                    keys.append(key), ids.append(page_id), places.append(at), lengths.append(len(member))
                    at += len(member)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(ids, pa.int64()), pa.array([archive] * len(keys), pa.string()),
                                          pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                                         ["key", "page_id", "archive", "at", "length"])

    return written(placed.mapInArrow(write, CAPTURES), "captures")


def index_captures(captures: DataFrame) -> DataFrame:
    """Sort the captures by key into index files of compressed blocks;
    returns the block directory."""
    folder = shared_path(captures.sparkSession, "cdx")
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def write(batches):
        from pyspark import TaskContext
        index = f"{folder}/captures-{TaskContext.get().partitionId():06d}.cdx.z"
        first = next(batches, None)
        if first is None:
            return
        blocks, at = [], 0
        with published(index) as out:
            rows = (r for b in itertools.chain([first], batches) for r in zip(*(c.to_pylist() for c in b.columns)))
            while block := list(itertools.islice(rows, BLOCK_CAPTURES)):
                packed = zlib.compress("\n".join("\t".join("" if v is None else str(v) for v in r) for r in block).encode(), LEVEL)
                out.write(packed)
                blocks.append((block[0][0], block[-1][0], index, at, len(packed), len(block)))
                at += len(packed)
        names = [c.split()[0] for c in DIRECTORY.split(", ")]
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*blocks)))))

    return written(ordered.mapInArrow(write, DIRECTORY), "cdx-directory")


def _index_block(entry: dict) -> list[tuple[str, str, int, int]]:
    """(key, archive, at, length) of each capture of a block, read by its range."""
    with opened(entry["index"]) as f:
        f.seek(entry["block_at"])
        lines = zlib.decompress(f.read(entry["block_length"])).decode().split("\n")
    return [(k, archive, int(at), int(n)) for k, _, archive, at, n in (line.split("\t") for line in lines)]


def _records(captures: Iterable[tuple[str, str, int, int]]) -> Iterator[dict]:
    """Records of captures, each by its range; an archive stays open while
    captures of it follow one another."""
    for archive, part in itertools.groupby(captures, key=lambda c: c[1]):
        with opened(archive) as f:
            for key, _, at, n in part:
                f.seek(at)
                yield {"key": key} | parse_record(zlib.decompress(f.read(n), 31))


_OUT = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
        "refers_to": pa.int64()}
_SCHEMA = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))


def read_archives(directory: DataFrame) -> DataFrame:
    """Every capture of the index, read from its archive in order of place."""
    def captures(batches):
        for b in batches:
            for entry in b.to_pylist():
                keys, archives, places, lengths = zip(*_index_block(entry))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(archives), pa.array(places, pa.int64()), pa.array(lengths, pa.int64())],
                                                 ["key", "archive", "at", "length"])

    def read(batches):
        for b in batches:
            found = _records(zip(*(c.to_pylist() for c in b.columns)))
            while rows := list(itertools.islice(found, BLOCK_CAPTURES)):
                yield _batch(rows, _OUT)

    tasks = int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = directory.mapInArrow(captures, "key string, archive string, at bigint, length bigint")
    return listed.repartition(tasks, "archive").sortWithinPartitions("archive", "at").mapInArrow(read, _SCHEMA)


def lookup(directory: DataFrame, urls: list[str]) -> DataFrame:
    """The captures of some urls (a short list): key, url, payload and the
    columns of ``read_archives``."""
    spark = directory.sparkSession
    wanted = sorted({r["k"] for r in spark.createDataFrame([(u,) for u in urls], "u string")
                    .select(url_key(F.col("u")).alias("k")).collect()})
    kinds = {"key": pa.string(), "url": pa.string(), "payload": pa.binary()} | _OUT

    def find(batches):
        for b in batches:
            rows = sorted(b.to_pylist(), key=lambda r: r["first_key"])
            firsts = [r["first_key"] for r in rows]
            for key in wanted:
                at = bisect.bisect_right(firsts, key) - 1       # the last block that begins at or before the key
                while at >= 0 and rows[at]["last_key"] >= key:
                    captures = _index_block(rows[at])
                    lo = bisect.bisect_left(captures, key, key=lambda c: c[0])
                    hi = bisect.bisect_right(captures, key, key=lambda c: c[0])
                    found = list(_records(captures[lo:hi]))
                    if found:
                        yield _batch(found, kinds)
                    at -= 1

    return directory.mapInArrow(find, "key string, url string, payload binary, " + _SCHEMA)


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    return read_archives(index_captures(write_archives(pages, min_bytes)))
