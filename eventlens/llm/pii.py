"""Personal data (operator 4), native: regular expressions propose spans,
checksums confirm them, nearby context words adjust the score.

Kinds email, ip, card and phone are the base kinds. ``iban`` (mod-97) and
``national_id`` (three-two-four digits, kept only when a context word stands
near) are added by the method; they never replace base spans.

Defined results: null text counts as empty (no spans); an empty table gives an
empty result; repeated rows give repeated rows; other columns of the input
are ignored. Per kind, matches are leftmost and non-overlapping; a match that
fails its check is dropped and not retried.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.spans import SPAN, digits_of, luhn_ok, regex_spans

# Possessive forms of the kinds' patterns. They match the same spans: no
# character class overlaps what follows it, and a start inside a run cannot
# succeed where the run's first character failed (``\G`` keeps the case of a
# match that ended right before). They keep long junk linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str          # a cheap necessary condition (regular expression or literal)
    base_score: float
    context: tuple[str, ...]
    min_score: float = 0.0


KINDS = (
    Kind("email", EMAIL, "@", 0.9, ("mail", "contact", "write", "correo", "kontakt")),
    Kind("ip", IP, ".", 0.6, ("ip", "address", "host", "server")),
    Kind("card", CARD, "[0-9]", 0.7, ("card", "visa", "payment", "credit", "tarjeta", "carte")),
    Kind("phone", PHONE, "+", 0.6, ("phone", "tel", "call", "mobile", "fax")),
    Kind("iban", IBAN, r"[A-Z]{2}[0-9]{2}", 0.8, ("iban", "account", "bank", "konto", "compte")),
    Kind("national_id", NATIONAL_ID, r"[0-9]-[0-9]", 0.2, ("ssn", "social", "security", "identity"), 0.5),
)
BASE = ("email", "ip", "card", "phone")
CONTEXT_BONUS = 0.4
CONTEXT_CHARS = 40


def _mod97(value: Column) -> Column:
    """ISO 7064 mod-97 of an IBAN, folded digit by digit."""
    flat = F.regexp_replace(value, " ", "")
    moved = F.concat(F.substring(flat, 5, 100), F.substring(flat, 1, 4))

    def fold(acc, c):
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + (code - 48)) % 97).otherwise((acc * 100 + (code - 55)) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), fold)


def _confirmed(kind: str, span: Column) -> Column:
    v = span["value"]
    n = F.length(digits_of(v))
    if kind == "ip":
        # a part of four or more digits may still be small: compare without leading zeros
        return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3)
                        & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(13, 19), luhn_ok(digits_of(v))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return _mod97(v) == 1
    return F.lit(True)


def _present(text: Column, needs: str) -> Column:
    return text.contains(needs) if len(needs) == 1 else text.rlike(needs)


def _score(text: Column, span: Column, kind: Kind) -> Column:
    first = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    before = F.substring(text, (first + 1).cast("int"), (span["start"] - first).cast("int"))
    after = F.substring(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT_CHARS))
    near = F.lower(F.concat_ws(" ", before, after)).rlike(r"\b(?:" + "|".join(kind.context) + r")")
    return F.least(F.lit(1.0), F.lit(kind.base_score) + F.when(near, CONTEXT_BONUS).otherwise(0.0))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``found``, an array of (kind, start,
    end, value, score) by kind as in ``KINDS``, then start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    for k in KINDS:
        spans = F.filter(regex_spans(F.col("text"), k.pattern, _present(F.col("text"), k.needs)),
                         lambda s: _confirmed(k.name, s))
        scored = F.transform(spans, lambda s: F.struct(
            F.lit(k.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            _score(F.col("text"), s, k).alias("score")))
        out = out.withColumn(k.name, F.filter(scored, lambda s: s["score"] >= k.min_score))
    return out.select("doc_id", F.concat(*[F.col(k.name) for k in KINDS]).alias("found"))


def span_digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Digest columns per document: counts by base kind, the hash of the base
    spans, and all spans."""
    out = find_pii(docs)
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return out.select(
        "doc_id",
        *[F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("found")).alias("spans"))
