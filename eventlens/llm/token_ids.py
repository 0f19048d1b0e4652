"""Token ids of whole texts by a public tokenizer, with remembered chunks.

Both kinds of tokenizer split a text into pre-tokens before they merge, and
none crosses a single space or line break between other characters, or the
place between a letter and a mark. So a text is cut there, each distinct chunk
is encoded once by the tokenizers library, and a text's ids are its chunks'
ids put together.

All of it is done for many chunks at a time: cuts are found on the bytes, a
chunk of up to 32 bytes is looked up by its bytes themselves (four 64-bit
words and the length) in an open-addressing table of numpy arrays, and the ids
are gathered from one pool. Only chunks that are not in the table, and longer
ones, become Python strings.
"""
from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from eventlens.llm.common import WORKER_MEMORY, mix64, text_slices

#: Chunks remembered in a worker (about 50 bytes each); a full memory is emptied.
MAX_CHUNKS = 3 << 19
#: Chunks looked up together; below the memory's size.
PIECE = 1 << 18
#: Chunks encoded in one call.
CALL_CHUNKS = 512
LANES = 4

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LATIN = np.zeros(256, bool)         # second bytes of the letters U+00C0 to U+00FF (the first is 0xC3)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_MARK = np.zeros(256, bool)
_MARK[list(b".,#*&%$!;:?")] = True
_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[28:33] = True
# White space beyond ASCII in UTF-8, by first byte: the bytes that may follow.
_WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80", b"\xa0\x8e"], 0xE3: [b"\x80\x80"],
         0xE2: [b"\x81\x9f", *(bytes((0x80, x)) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF))]}


def _white(data: np.ndarray) -> np.ndarray:
    """Marks of the bytes that belong to white space."""
    white = _SPACE[data]
    for lead, follow in _WIDE.items():
        at = np.flatnonzero(data == lead)
        for tail in follow if len(at) else ():
            here = at[at + len(tail) < len(data)]
            for k, byte in enumerate(tail, 1):
                here = here[data[here + k] == byte]
            for k in range(len(tail) + 1):
                white[here + k] = True
    return white


def _before_marks(data: np.ndarray) -> np.ndarray:
    """Places of marks that follow a letter."""
    at = np.flatnonzero(_MARK[data])
    at = at[at > 1]
    return at[_LETTER[data[at - 1]] | (data[at - 2] == 0xC3) & _LATIN[data[at - 1]]]


class ChunkTable:
    """Ids by a chunk's bytes: keys, lengths and places in a pool, found
    through slots by open addressing."""

    def __init__(self, dtype: np.dtype, capacity: int):
        self.capacity = capacity
        self.slots = np.full(1 << max(4, (2 * capacity - 1).bit_length()), -1, np.int32)
        self.keys = [np.zeros(capacity, np.uint64) for _ in range(LANES)]
        self.length = np.zeros(capacity, np.int8)
        self.start, self.count = np.zeros(capacity, np.int32), np.zeros(capacity, np.int32)
        self.pool = np.empty(4 * capacity, dtype)
        self.size = self.used = 0

    def clear(self) -> None:
        self.slots.fill(-1)
        self.size = self.used = 0

    def find(self, lanes: list[np.ndarray], wide: np.ndarray, length: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each chunk, -1 if it isn't known. ``wide`` numbers the
        chunks that need the last two lanes (which hold those alone)."""
        out = np.full(len(h), -1, np.int32)
        slot = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        live = None  # all
        place = np.full(len(h), -1)
        place[wide] = np.arange(len(wide))
        while True:
            at = self.slots[slot]
            pick = (lambda x: x) if live is None else (lambda x: x[live])
            same = (at >= 0) & (self.length[at] == pick(length)) & (self.keys[0][at] == pick(lanes[0])) & (self.keys[1][at] == pick(lanes[1]))
            w = np.flatnonzero(same & (pick(place) >= 0))
            if len(w):
                p = pick(place)[w]
                same[w] = (self.keys[2][at[w]] == lanes[2][p]) & (self.keys[3][at[w]] == lanes[3][p])
            go_on = np.flatnonzero(~same & (at >= 0))
            hit = np.flatnonzero(same)
            out[hit if live is None else live[hit]] = at[hit]
            if not len(go_on):
                return out
            live = go_on if live is None else live[go_on]
            slot = (slot[go_on] + 1) & (len(self.slots) - 1)

    def add(self, lanes: list[np.ndarray], length: np.ndarray, h: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Chunks that aren't known yet, each once; all four lanes are given."""
        n, new = len(h), np.arange(self.size, self.size + len(h), dtype=np.int32)
        for k in range(LANES):
            self.keys[k][new] = lanes[k]
        self.length[new], self.count[new] = length, count
        self.start[new] = self.used + np.cumsum(count) - count
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:self.used], np.empty(max(len(ids), len(self.pool)), self.pool.dtype)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.size, self.used = self.size + n, self.used + len(ids)
        slot = (h & np.uint64(len(self.slots) - 1)).astype(np.int64)
        while len(new):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]            # of several for one slot the last stays
            left = np.flatnonzero(self.slots[slot] != new)
            new, slot = new[left], (slot[left] + 1) & (len(self.slots) - 1)


class ChunkEncoder:
    """``encode(texts)`` gives the ids of each text, the same as the library
    gives for the whole text."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS, piece: int = PIECE):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # A special token cuts a text before anything else looks at it, so it can stand between chunks.
        added = self.tokenizer.get_added_tokens_decoder()
        self.cut_id, self.cut = next((i, t.content) for i, t in sorted(added.items()) if t.special)
        # A tokenizer that drops white space sees no difference between "a" and " a".
        self.drops_space = not self._ids([" "])[0]
        self.folds_case = self._ids(["A"]) == self._ids(["a"])
        # There a control character between spaces is a token of its own, and quicker than a special one.
        a, joined = self._ids(["a", "a \x01 a"])
        if self.drops_space and len(joined) == 2 * len(a) + 1:
            self.cut, self.cut_id, self.join = "\x01", joined[len(a)], " \x01 "
        else:
            self.join = self.cut
        self.table = ChunkTable(self.dtype, max_chunks)
        self.piece = min(piece, max_chunks)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has: many
        chunks in one call, with the cut between."""
        out: list[np.ndarray | None] = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if self.cut not in c]
        odd = [i for i, c in enumerate(chunks) if self.cut in c] if len(plain) < len(chunks) else []
        parts = [plain[i:i + CALL_CHUNKS] for i in range(0, len(plain), CALL_CHUNKS)]
        for part, ids in zip(parts, self._ids([self.join.join(chunks[i] for i in p) for p in parts])):
            ids = np.array(ids, self.dtype)
            cuts = np.flatnonzero(ids == self.cut_id)
            for i, a, b in zip(part, [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]):
                out[i] = ids[a:b]
        for i, ids in zip(odd, self._ids([chunks[i] for i in odd])):
            out[i] = np.array(ids, self.dtype)
        return (np.concatenate(out) if out else np.empty(0, self.dtype)), np.array([len(x) for x in out], np.int64)

    def _chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the chunks of a run of texts begin, and their lengths."""
        n = len(data)
        mark = np.zeros(n + 1, bool)
        gap = (data == 32) | (data == 10)
        marks = _before_marks(data)
        if self.drops_space:
            mark[:n] = ~gap
            mark[1:n] &= gap[:-1]
            edge = offsets[1:-1][offsets[1:-1] < n]
            mark[edge] = ~gap[edge]
            mark[marks] = True
            starts = np.flatnonzero(mark)
            ends = np.zeros(n + 1, bool)
            ends[1:n] = gap[1:] & ~gap[:-1]
            ends[edge] |= (edge > 0) & ~gap[edge - 1]
            ends[marks] = True
            if n and not gap[-1]:
                ends[n] = True
            return starts, np.flatnonzero(ends) - starts
        white = _white(data)
        full = np.flatnonzero(np.diff(offsets) > 0)
        first, last = offsets[full], offsets[full + 1] - 1
        gap[first] = gap[last] = False
        at = np.flatnonzero(gap)
        at = at[~white[at - 1] & ~white[at + 1]]
        mark[first] = mark[at] = mark[marks] = True
        mark[at[data[at] == 10] + 1] = True               # a line break is a chunk of its own
        starts = np.flatnonzero(mark)
        return starts, np.diff(np.append(starts, n))

    def _looked_up(self, data: np.ndarray, buffer: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after another, and how many each has."""
        words = np.ndarray((len(buffer) - 7,), "<u8", buffer=buffer, strides=(1,))
        lane = lambda at, k, size: words[at + 8 * k] & _MASK[np.clip(size - 8 * k, 0, 8)]
        long = np.flatnonzero(lengths > 8 * LANES)
        fits = np.flatnonzero(lengths <= 8 * LANES) if len(long) else slice(None)
        at, size = starts[fits], lengths[fits]
        wide = np.flatnonzero(size > 16)
        lanes = [lane(at, 0, size), lane(at, 1, size), lane(at[wide], 2, size[wide]), lane(at[wide], 3, size[wide])]
        with np.errstate(over="ignore"):
            h = lanes[0] * _MIX[0] ^ (lanes[1] + size.astype(np.uint64)) * _MIX[1]
            h[wide] ^= lanes[2] * _MIX[2] ^ lanes[3] * _MIX[3]
        h = mix64(h)
        table, size8 = self.table, size.astype(np.int8)
        number = table.find(lanes, wide, size8, h)
        while True:
            missing = np.flatnonzero(number < 0)
            if not len(missing):
                break
            new = missing[np.unique(h[missing], return_index=True)[1]]
            if table.size + len(new) > table.capacity:
                table.clear()
                missing = np.arange(len(number))
                new = np.unique(h, return_index=True)[1]
            ids, count = self._encoded([data[a:a + n].tobytes().decode() for a, n in zip(at[new].tolist(), size[new].tolist())])
            table.add([lane(at[new], k, size[new]) for k in range(LANES)], size8[new], h[new], ids, count)
            some = np.zeros(len(h), bool)
            some[missing] = True
            place = np.flatnonzero(some[wide])
            renumbered = np.cumsum(some) - 1
            number[missing] = table.find([lanes[0][missing], lanes[1][missing], lanes[2][place], lanes[3][place]],
                                         renumbered[wide[place]], size8[missing], h[missing])
        begin, count, pool = table.start[number].astype(np.int64), table.count[number].astype(np.int64), table.pool
        if len(long):  # longer chunks are encoded as they come, after the table's pool
            ids, n = self._encoded([data[a:a + k].tobytes().decode() for a, k in zip(starts[long].tolist(), lengths[long].tolist())])
            begins, counts = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
            begins[fits], counts[fits] = begin, count
            begins[long], counts[long] = table.used + np.cumsum(n) - n, n
            begin, count, pool = begins, counts, np.concatenate([table.pool[:table.used], ids])
        end = np.cumsum(count)
        total = int(end[-1]) if len(end) else 0
        return pool[np.repeat(begin - end + count, count) + np.arange(total)], count

    def encode(self, texts: pa.Array, max_bytes: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of rows of a string column: first row, end row, the ids of
        all texts one after another, and where each text's ids end (null
        counts as empty)."""
        for row, end, data, offsets in text_slices(texts, max_bytes):
            if self.folds_case and not (data == 124).any():  # a special token (with bars) is one in lower case only
                data = _LOWER[data]
            starts, lengths = self._chunks(data, offsets)
            buffer = np.zeros(len(data) + 8 * LANES + 8, np.uint8)
            buffer[:len(data)] = data
            parts = [self._looked_up(data, buffer, starts[i:i + self.piece], lengths[i:i + self.piece]) for i in range(0, len(starts), self.piece)]
            ids = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, self.dtype)
            ends = np.append(0, np.cumsum(np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.int64)))
            yield row, end, ids, ends[np.searchsorted(starts, offsets[1:])]


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder of a tokenizer file (kept between tasks, until a
    task of another operator wants the memory)."""
    key = f"encoder {path}"
    if key not in WORKER_MEMORY:
        WORKER_MEMORY[key] = ChunkEncoder(path)
    return WORKER_MEMORY[key]
