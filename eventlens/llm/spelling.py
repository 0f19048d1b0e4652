"""Spelling variants (operator 11) by a bit-sliced position index.

For every (position, letter) the index holds a bitset over its words: the
words that have that letter there. A query word is read letter by letter. One
set holds the words that agree so far; three more hold those that agree up to
one replaced letter, one letter more (positions shifted by one to the right)
or one letter less (shifted to the left). Each letter costs a few ANDs and ORs
that treat 64 words at a time; many queries are read at once.

The vocabulary is spread by the places where the one edit may lie. Let L be the
length of the shorter word and p the length of the common beginning. If p is
before the middle, the two words share the last L - L/2 letters, otherwise the
first L/2. So each word is dealt twice for each of the two lengths it can have
the role of, and a pair meets in exactly one block. A block above ``BLOCK`` words is
halved the same way until it is small or only one place is left open; then
the alphabet bounds it (90 letters: at most 90 words and 8,100 longer ones).
Blocks of a task are indexed together, about ``CHUNK`` words at a time.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z are
lower-cased. Defined results: null and empty texts have no words; repeated
rows count again; a null doc_id leaves every run as it is (no slips); words
shorter than ``MIN_LENGTH`` or with fewer than ``MIN_COUNT`` occurrences are
left out; ties go to the word that is smallest in code-point order; an empty
table gives no row. Other columns are not read.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import written

MIN_LENGTH = 7
MIN_COUNT = 2
RATIO = 10          # a form has at least so many times the word's occurrences
BLOCK = 4096        # words of a block that is not halved further
CHUNK = 1024        # words indexed together
#: Words a task counts before it passes the counts on; code points of a text that are read at a time.
FLUSH = 200_000
PIECE = 1 << 20

_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % MIN_LENGTH)
_GAP = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str):
    """Whole texts, or parts of very long ones cut after a character that is in no word."""
    at = 0
    while len(text) - at > PIECE:
        gap = _GAP.search(text, at + PIECE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _slip(run: str, prefix: int | None, every: int) -> str:
    """The lower-cased run; one of ``every`` loses a code point, chosen by the checksum that ``prefix`` begins."""
    raw = run.encode().lower()
    if prefix is not None:
        h = zlib.crc32(raw, prefix)
        if not h % every:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
            raw = run.encode().lower()
    return raw.decode()


def corpus_words(docs: DataFrame, slip_every: int | None = None) -> DataFrame:
    """(word, n): words of at least ``MIN_LENGTH`` code points with at least
    ``MIN_COUNT`` occurrences in all texts. With ``slip_every`` a run whose
    crc32 of ``<doc_id>:<run>`` is divisible by it is counted without the code
    point at that checksum modulo its length."""
    def run(batches):
        total: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc, text in zip(b.column("doc").to_pylist(), b.column("text")):
                for piece in _pieces(text.as_py() or ""):
                    found: dict[str, int] = {}
                    for w in _RUN.findall(piece):
                        found[w] = found.get(w, 0) + 1
                    prefix = zlib.crc32(f"{doc}:".encode()) if slip_every and doc is not None else None
                    for w, k in found.items():
                        w = _slip(w, prefix, slip_every)
                        if len(w) >= MIN_LENGTH:
                            total[w] = total.get(w, 0) + k
                    if len(total) >= FLUSH:
                        yield out()
                        total.clear()
        if total:
            yield out()

    counts = docs.select(F.col("doc_id").cast("string").alias("doc"), "text").mapInArrow(run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT)


class PositionIndex:
    """Bitsets over words for each position and letter; ``letters`` are the
    words' code points one after another, ``offsets`` where each word begins."""

    def __init__(self, letters: np.ndarray, offsets: np.ndarray):
        self.letters, self.offsets = letters, offsets
        self.lengths = np.diff(offsets)
        n, longest = len(self.lengths), int(self.lengths.max(initial=0))
        self.width = -(-n // 64)
        alphabet, code = np.unique(letters, return_inverse=True)
        self.code = np.full((n, longest + 1), len(alphabet), np.int16)  # the last letter is "none"
        word = np.repeat(np.arange(n), self.lengths)
        self.code[word, np.arange(len(letters)) - offsets[word]] = code
        self.bits = np.zeros((longest + 2, len(alphabet) + 1, self.width), np.uint64)
        for p in range(longest):
            self.bits[p, :-1] = self._packed(self.code[:, p] == np.arange(len(alphabet))[:, None])
        self.of_length = np.zeros((longest + 3, self.width), np.uint64)
        self.of_length[:longest + 2] = self._packed(self.lengths == np.arange(longest + 2)[:, None])

    def _packed(self, marks: np.ndarray) -> np.ndarray:
        raw = np.zeros((len(marks), self.width * 8), np.uint8)
        packed = np.packbits(marks, axis=1, bitorder="little")
        raw[:, :packed.shape[1]] = packed
        return raw.view(np.uint64)

    def one_error(self, queries: np.ndarray):
        """Bitsets for each of the index's words numbered in ``queries``:
        words with one letter replaced; with one letter more, inside; with one
        more at the end; with one letter less."""
        length, code = self.lengths[queries], self.code[queries]
        shape = (len(queries), self.width)
        same = np.full(shape, ~np.uint64(0))
        replaced, more, less = (np.zeros(shape, np.uint64) for _ in range(3))
        out = [np.zeros(shape, np.uint64) for _ in range(4)]
        for p in range(int(length.max(initial=0)) + 1):
            done = np.flatnonzero(length == p)
            if len(done):
                out[0][done] = replaced[done] & self.of_length[p]
                out[1][done] = more[done] & ~same[done] & self.of_length[p + 1]
                out[2][done] = same[done] & self.of_length[p + 1]
                out[3][done] = less[done] & self.of_length[p - 1] if p else 0
            if p == len(self.bits) - 2:
                break
            letter = code[:, p]
            here, right = self.bits[p, letter], self.bits[p + 1, letter]
            less = (less & self.bits[p - 1, letter] if p else less) | same
            more = (more | same) & right
            replaced = (replaced & here) | (same & ~here)
            same = same & here
        return out


def _set_bits(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of the bits that are set: only the words that hold any are opened."""
    row, word = np.nonzero(bits)
    opened = np.unpackbits(bits[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(opened)
    return row[at], word[at] * 64 + bit


def _pairs_of(rests: list[str], block: np.ndarray, asks: np.ndarray, closed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (shorter or equal, other) of the same block. ``asks`` marks words
    in the role of the shorter one, ``closed`` blocks whose open part ends
    before the word's end: there a letter more at the end is another block's."""
    letters = np.frombuffer("".join(rests).encode("utf-32-le"), np.uint32)
    index = PositionIndex(letters, np.append(0, np.cumsum([len(r) for r in rests])))
    queries = np.flatnonzero(asks)
    replaced, inside, at_end, _ = index.one_error(queries)
    at_end[closed[queries]] = 0
    blocks, number = np.unique(block, return_inverse=True)
    own = index._packed(number == np.arange(len(blocks))[:, None])
    row, other = _set_bits((replaced | inside | at_end) & own[number[queries]])
    return queries[row], other


def _near_rows(batches):
    """Rows (word, near, n of near) for the blocks of rows that come sorted by key; memory holds a chunk of whole blocks."""
    def solved(t: pa.Table):
        t = t.combine_chunks()
        key = t.column("key")
        starts = np.append(True, pc.not_equal(key[1:], key[:-1]).to_numpy().astype(bool)) if len(t) > 1 else np.ones(len(t), bool)
        block = np.cumsum(starts)
        alone = np.bincount(block)[block] == 1
        t, block = t.filter(pa.array(~alone)), block[~alone]
        asks, closed = (t.column(c).to_numpy().astype(bool) for c in ("asks", "closed"))
        if not asks.any():
            return
        a, b = _pairs_of(t.column("rest").to_pylist(), block, asks, closed)
        back = ~asks[b]  # a longer word doesn't ask: its answers are sent from here
        first, second = np.append(a, b[back]), np.append(b, a[back])
        if len(first):
            words, n = t.column("word").combine_chunks(), t.column("n").combine_chunks()
            yield pa.RecordBatch.from_arrays([words.take(pa.array(first)), words.take(pa.array(second)), n.take(pa.array(second))],
                                             ["word", "near", "n"])

    held: list[pa.Table] = []
    rows = 0
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        rows += len(b)
        if rows < CHUNK:
            continue
        t = pa.concat_tables(held).combine_chunks()
        key = t.column("key")
        change = np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy().astype(bool)) + 1
        at = 0
        while True:  # whole blocks, at least CHUNK rows; the last block may go on in the next batch
            cut = change[np.searchsorted(change, at + CHUNK):][:1]
            if not len(cut):
                break
            yield from solved(t.slice(at, int(cut[0]) - at))
            at = int(cut[0])
        held, rows = [t.slice(at)], len(t) - at
    if rows:
        yield from solved(pa.concat_tables(held))


_KEY = ["span", "low", "high", "head", "tail"]


def _placed(rows: DataFrame) -> DataFrame:
    """The key columns of rows (word, n, span, low, high): the edit lies after
    the first ``low`` and before the last ``high`` letters."""
    return rows.withColumn("head", F.substring("word", F.lit(1), F.col("low"))).withColumn(
        "tail", F.when(F.col("high") > 0, F.substring("word", -F.col("high"), F.col("high"))).otherwise(""))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: the edit lies before, or not before, the middle of its open part."""
    middle = F.floor((F.col("low") + F.col("span") - F.col("high")) / 2).cast("int")
    sides = F.array(F.struct(F.col("low").alias("low"), (F.col("span") - middle).alias("high")),
                    F.struct(middle.alias("low"), F.col("high").alias("high")))
    return rows.select("word", "n", "span", F.explode(sides).alias("side")).select("word", "n", "span", "side.low", "side.high")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, near, n of near): all ordered pairs of ``words`` (word, n) that
    differ by one inserted, deleted or replaced code point, each once."""
    length = F.length("word")
    roles = words.filter(length > 1).select("word", "n", F.explode(F.array(length, length - 1)).alias("span"), F.lit(0).alias("low"), F.lit(0).alias("high"))
    rows, done = _placed(_halved(roles)), None
    while True:
        rows = written(rows, "word-places")
        large = written(rows.filter(F.col("span") - F.col("low") - F.col("high") >= 2).groupBy(*_KEY)
                        .agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block), "large-blocks")
        split = not large.isEmpty()
        small = rows.join(large, _KEY, "left_anti") if split else rows
        done = small if done is None else done.unionByName(small)
        if not split:
            break
        rows = _placed(_halved(rows.join(large, _KEY, "left_semi")))
    keyed = done.select(
        F.concat_ws("/", *_KEY).alias("key"), "word", "n", (F.length("word") == F.col("span")).alias("asks"), (F.col("high") > 0).alias("closed"),
        F.expr("substring(word, low + 1, length(word) - low - high)").alias("rest"))
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_near_rows, "word string, near string, n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form: the last of their chain.
    Occurrences grow tenfold at each step, so chains are short; a round
    doubles the steps that are followed."""
    step = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(step.join(onward, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        step = step.drop("moved")


def variant_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """One row per word of ``words`` (word, n): its near words' number, its
    form (the near word of largest n, if that is at least ``ratio`` times its
    own) with the form's n, and the root its forms lead to."""
    words = written(words.select("word", "n"), "words")
    best = near_words(words, block).withColumnRenamed("n", "m").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    told = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n")), "forms")
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
