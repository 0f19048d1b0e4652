"""Phrase search inside a row: word n-grams with their places, behind bitmaps.

A phrase table (names, aliases) is turned into two bitmaps of bounded size,
one of the phrases' first words and one of whole phrases. They are literals of
the plan, so a text's n-grams are cut and sifted where the text is read: only
n-grams that start with a known first word are put together, and only those
whose bit is set leave the row. What leaves is joined to the phrase table by
equality, which removes the bitmaps' false positives.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a phrase, places of a phrase in a bitmap, and the bounds of a bitmap (2^22 bits are 512 KB).
BITS_PER_PHRASE = 16
MAX_PLACES = 3
MIN_BITS, MAX_BITS = 1 << 10, 1 << 22


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def running_sums(values: Column, chunk: int = 256) -> Column:
    """Sums of an array of longs up to and with each element. The result grows
    in pieces of ``chunk``, so long arrays are not copied at every step."""
    longs = lambda kind: F.array().cast(f"array<{kind}>")

    def one(acc, x):
        return let(acc["total"] + x, lambda t: F.struct(t.alias("total"), F.concat(acc["out"], F.array(t)).alias("out")))

    def whole(v):
        def piece(acc, k):
            part = F.aggregate(F.slice(v, k * chunk + 1, F.lit(chunk)), F.struct(acc["total"].alias("total"), longs("bigint").alias("out")), one)
            return let(part, lambda p: F.struct(p["total"].alias("total"), F.concat(acc["parts"], F.array(p["out"])).alias("parts")))

        start = F.struct(F.lit(0).cast("bigint").alias("total"), longs("array<bigint>").alias("parts"))
        pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(v) / chunk).cast("int") - 1, F.lit(0)))
        return F.flatten(F.aggregate(pieces, start, piece, lambda acc: acc["parts"]))

    return let(values, whole)


def _slot(hashed: Column, k: int, bits: int) -> Column:
    """The ``k``-th place of a hash: each from 21 bits further up."""
    return F.shiftrightunsigned(hashed, 21 * k).bitwiseAND(F.lit(bits - 1))


@dataclass(frozen=True)
class PhraseFilter:
    """Bitmaps of a phrase table's first words and whole phrases, and the
    numbers of words that its phrases have."""
    bits: int
    first: str
    whole: str
    lengths: tuple[int, ...]
    places: int = 1

    @classmethod
    def of(cls, phrases: DataFrame, words: str = "words") -> "PhraseFilter":
        """From a column of word arrays (empty and NULL ones are left out).
        What reaches the driver is bounded: the bitmaps and the lengths."""
        p = phrases.select(F.col(words).alias("w")).where(F.size("w") > 0).distinct()
        n = p.count()
        bits = min(MAX_BITS, max(MIN_BITS, 1 << (BITS_PER_PHRASE * max(1, n) - 1).bit_length()))
        keyed = p.select(F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("w")[0].alias("v")),
                                           F.struct(F.lit(1).alias("kind"), F.array_join("w", " ").alias("v")))).alias("s"))
        # A full bitmap holds one place of a phrase, a sparse one several: fewer n-grams are taken for phrases.
        places = max(1, min(MAX_PLACES, round(0.69 * bits / max(1, n))))
        slots = F.array(*[_slot(F.xxhash64("s.v"), k, bits) for k in range(places)])
        cells = (keyed.select("s.kind", F.explode(slots).alias("slot"))
                 .select("kind", F.shiftright("slot", 6).alias("cell"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
                 .groupBy("kind", "cell").agg(F.bit_or("bit").alias("bit")).collect())
        maps = [[0] * (bits >> 6), [0] * (bits >> 6)]
        for r in cells:
            maps[r["kind"]][r["cell"]] = r["bit"]
        lengths = tuple(r[0] for r in p.select(F.size("w")).distinct().orderBy(F.size("w")).collect())
        return cls(bits, json.dumps(maps[0]), json.dumps(maps[1]), lengths, places)

    def _holds(self, bitmap: str, value: Column) -> Column:
        cells = F.from_json(F.lit(bitmap), "array<bigint>")

        def at(k):
            slot = _slot(F.xxhash64(value), k, self.bits)
            return F.getbit(F.element_at(cells, (F.shiftright(slot, 6) + 1).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1

        return reduce(and_, [at(k) for k in range(self.places)])

    def may_start(self, word: Column) -> Column:
        return self._holds(self.first, word)

    def may_be(self, phrase: Column) -> Column:
        return self._holds(self.whole, phrase)

    def grams(self, words: Column) -> Column:
        """The n-grams of a word array that may be phrases: (at, n, gram),
        ``at`` counted from 1. ``words`` is used many times: bind it (``let``)."""
        kind = "array<struct<at:int,n:int,gram:string>>"
        if not self.lengths:
            return F.array().cast(kind)
        size = F.size(words)
        starts = F.filter(F.sequence(F.lit(1), size), lambda i: self.may_start(F.get(words, i - 1)))
        cut = F.flatten(F.transform(starts, lambda i: F.array_compact(F.array(*[
            F.when(i + n - 1 <= size, F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i, n), " ").alias("gram")))
            for n in self.lengths]))))
        return F.when(size > 0, F.filter(cut, lambda g: self.may_be(g["gram"]))).otherwise(F.array().cast(kind))
