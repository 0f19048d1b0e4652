"""Language identification (operator 8) by language-bitmask n-gram filters.

For every language the n-grams that are typical of it go into one Bloom
filter. The filters are bit-sliced: one table of masks, bit *l* of a cell is
cell's bit in the filter of language *l*, so a single pass of lookups returns
the set of all languages that contain an n-gram. A document's popcount per
language, corrected for the filter's false positives, decides.

An n-gram is four bytes of lower-cased UTF-8 with every ASCII non-letter as a
space; all-space n-grams are left out.

Defined results: null text, or text without a letter, is ``und`` with score 0;
ties go to the alphabetically first language; text of an unseen script gets
the language with the highest (possibly zero) count and a score near 0; with
no labelled row to learn from, every row is ``und``. Repeated rows repeat.
Other columns are not read.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import drop_worker_memory, mix64, text_slices

UNDETERMINED = "und"
GRAM = 4
#: Bound of the labelled sample: about so many documents of each language.
SAMPLE_DOCS_PER_LANG = 3000
#: An n-gram is typical of a language if its relative frequency there is at
#: least this share of its relative frequency in any language ...
TYPICAL_SHARE = 0.3
#: ... and it was seen at least this often there.
MIN_COUNT = 2
#: Filter cells per n-gram (power of two above) and probes.
CELLS_PER_GRAM = 8
PROBES = 3
#: Bytes of text whose n-grams are looked up together.
SLICE_BYTES = 1 << 19
#: Below this share of n-grams known to the language a document is rejected.
REJECT_BELOW = 0.2

# ASCII letters stay, bytes of other characters stay, all else is a space.
_CLASS = np.full(256, 32, np.uint8)
_CLASS[97:123] = np.arange(97, 123)
_CLASS[65:91] = np.arange(97, 123)
_CLASS[128:] = np.arange(128, 256)


def held_out(doc_id: Column) -> Column:
    """Documents that no model learns from: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes (uint32) of each document and their document numbers. The
    documents are laid out with spaces between them, so none crosses."""
    n_docs, pad = len(offsets) - 1, GRAM - 1
    buf = np.full(len(data) + pad * (n_docs + 1), 32, np.uint8)
    doc = np.repeat(np.arange(n_docs), np.diff(offsets))
    buf[np.arange(len(data)) + pad * (doc + 1)] = _CLASS[data]
    wide = buf.astype(np.uint32)
    code = (wide[:-3] << 24) | (wide[1:-2] << 16) | (wide[2:-1] << 8) | wide[3:]
    starts = offsets[:-1] + pad * np.arange(1, n_docs + 1) - pad
    owner = np.repeat(np.arange(n_docs), np.diff(np.append(starts, len(code))))
    real = code != 0x20202020
    return code[real], owner[real]


def _lower(texts: pa.Array) -> pa.Array:
    return pc.utf8_lower(texts)


def gram_counts(labelled: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(lang, gram, n) over whole texts of n-grams seen ``least`` times; counted per batch, then added up."""
    def count(batches):
        drop_worker_memory()
        for b in batches:
            for row, end, data, off in text_slices(_lower(b.column("text"))):
                code, owner = _grams(data, off)
                lang = b.column("lang").slice(row, end - row).dictionary_encode()
                names, number = lang.dictionary.to_pylist(), lang.indices.to_numpy(zero_copy_only=False)
                key, n = np.unique((number[owner].astype(np.uint64) << np.uint64(32)) | code, return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.string()).take(pa.array((key >> np.uint64(32)).astype(np.int64))),
                    pa.array((key & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n.astype(np.int64))],
                    ["lang", "gram", "n"])

    rows = labelled.select("lang", "text").mapInArrow(count, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def bounded_sample(labelled: DataFrame, per_lang: int = SAMPLE_DOCS_PER_LANG) -> DataFrame:
    """About ``per_lang`` documents of each language (all, where fewer), chosen
    by a hash of the id: no shuffle, and the same rows in every run."""
    share = {r["lang"]: min(1.0, per_lang / r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return labelled.limit(0)
    limit = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(share.items()) for x in kv]), F.col("lang"))
    return labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < limit * (1 << 20))


@dataclass(frozen=True)
class LanguageFilters:
    """Bit-sliced Bloom filters. ``masks[cell]`` is one or more words; bit l of
    them is set if the cell is set in the filter of ``langs[l]``."""
    langs: tuple[str, ...]
    masks: np.ndarray
    false_positive: np.ndarray

    @classmethod
    def build(cls, langs: list[str], lang_no: np.ndarray, gram: np.ndarray, n: np.ndarray) -> "LanguageFilters":
        totals = np.bincount(lang_no, n, len(langs))
        share = n / totals[lang_no]
        distinct, at = np.unique(gram, return_inverse=True)
        most = np.zeros(len(distinct))
        np.maximum.at(most, at, share)
        typical = share >= TYPICAL_SHARE * most[at]
        size = 1 << max(10, int(np.ceil(np.log2(max(1, CELLS_PER_GRAM * len(distinct))))))
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(t).bits), np.uint64)
        bits = np.iinfo(kind).bits
        masks = np.zeros((size, -(-len(langs) // bits)), kind)
        word, bit = np.divmod(lang_no[typical], bits)
        for cell in cls._cells(gram[typical].astype(np.uint32), size):
            np.bitwise_or.at(masks, (cell.astype(np.int64), word), kind(1) << bit.astype(kind))
        fill = np.array([np.count_nonzero(masks[:, l // bits] & (kind(1) << kind(l % bits))) / size for l in range(len(langs))])
        return cls(tuple(langs), masks, fill ** PROBES)

    @staticmethod
    def _cells(code: np.ndarray, size: int):
        h = mix64(code.astype(np.uint64))
        bits = np.uint64(size.bit_length() - 1)
        for p in range(PROBES):
            yield ((h >> np.uint64(p * 21)) & np.uint64((1 << 21) - 1) if bits <= 21 else mix64(h + np.uint64(p))) & np.uint64(size - 1)

    def languages_of(self, code: np.ndarray) -> np.ndarray:
        """Mask words of all languages whose filter contains each n-gram."""
        out = None
        for cell in self._cells(code, len(self.masks)):
            hit = self.masks[cell.astype(np.int64)]
            out = hit if out is None else out & hit
        return out

    def decide(self, code: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Per document: number of the language and the corrected share of its
        n-grams that the language's filter contains."""
        mask = self.languages_of(code)
        total = np.bincount(owner, minlength=n_docs).astype(float)
        known = np.empty((len(self.langs), n_docs))
        kind = self.masks.dtype.type
        bits = np.iinfo(kind).bits
        for l, p in enumerate(self.false_positive):
            hits = np.bincount(owner[(mask[:, l // bits] >> kind(l % bits)) & kind(1) != 0], minlength=n_docs)
            known[l] = np.maximum(0.0, (hits - total * p) / max(1e-9, 1 - p))
        best = known.argmax(0)
        return best, np.clip(known[best, np.arange(n_docs)] / np.maximum(total, 1), 0.0, 1.0)


def train(labelled: DataFrame, per_lang: int = SAMPLE_DOCS_PER_LANG) -> LanguageFilters | None:
    """Learn the filters from (doc_id, text, lang) rows; rows without language
    or text are left out. The sample is bounded by ``per_lang``; its n-gram
    counts (bounded with it) come to the driver as one Arrow table."""
    rows = labelled.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sample = bounded_sample(rows, per_lang)
    counts = gram_counts(sample).toArrow()
    if not counts.num_rows:
        counts = gram_counts(sample, 1).toArrow()
    if not counts.num_rows:
        return None
    lang = counts.column("lang").combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist()
    order = np.argsort(names)
    number = np.empty(len(names), np.int64)
    number[order] = np.arange(len(names))
    return LanguageFilters.build(sorted(names), number[lang.indices.to_numpy()],
                                 counts.column("gram").to_numpy(), counts.column("n").to_numpy())


def _has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def predict(docs: DataFrame, model: LanguageFilters | None) -> DataFrame:
    """The columns of ``docs`` with ``lang_pred`` and ``score`` (share of the
    document's n-grams known to that language, corrected) after them."""
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ascii_letters = np.zeros(256, bool)
    ascii_letters[65:91] = ascii_letters[97:123] = True

    def run(batches):
        drop_worker_memory()
        m = shared.value
        names = np.array(m.langs, dtype=object)
        for b in batches:
            texts = b.column("text")
            langs, scores = [], []
            for row, end, data, off in text_slices(_lower(texts), SLICE_BYTES):
                code, owner = _grams(data, off)
                best, score = m.decide(code, owner, end - row)
                lang = names[best]
                sums = np.append(0, np.cumsum(ascii_letters[data]))
                for i in np.flatnonzero(sums[off[1:]] == sums[off[:-1]]):  # no ASCII letter: look at the characters
                    if not _has_letter(texts[row + int(i)].as_py()):
                        lang[i], score[i] = UNDETERMINED, 0.0
                langs.append(pa.array(lang, pa.string()))
                scores.append(pa.array(score, pa.float64()))
            if langs:
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.concat_arrays(langs), pa.concat_arrays(scores)],
                    [*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Predict every document with a model learned from the documents that
    aren't held out."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.filter(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents whose language is known: ``und`` and texts of which less
    than ``REJECT_BELOW`` of the n-grams are known to any language go."""
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    cols = docs.columns
    marked = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("doc"), "text"), model)
    return marked.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= REJECT_BELOW)).select("doc.*")
