"""Queries and SQL of the training-data operators."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventlens.llm import oracles
from eventlens.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.secrets import find_secrets
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from eventlens.llm.token_files import token_file_report
    return token_file_report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.decontaminate import find_leaks
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.pii import pii_report
    return pii_report(table(spark, sf_dir, "documents"))


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.near_copies import near_copies
    return near_copies(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from eventlens.llm.packing import pack_report
    return pack_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.warc import archive_report
    return archive_report(table(spark, sf_dir, "pages"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.language import identify
    return identify(table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.repeats import repeats_report
    return repeats_report(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.embedding_links import embedding_links
    return embedding_links(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.spelling import corpus_words, variant_groups
    return variant_groups(corpus_words(table(spark, sf_dir, "documents"), slip_every=31))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.licenses import license_report
    return license_report(table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from eventlens.llm.lexical_search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_token_files": op2_token_files,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_near_copies": op5_near_copies,
    "op6_packing": op6_packing,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_repeats": op9_repeats,
    "op10_embedding_links": op10_embedding_links,
    "op11_spelling": op11_spelling,
    "op12_licenses": op12_licenses,
    "op13_search": op13_search,
}

_ORACLES: dict[str, Callable[[], str]] = {
    "op7_warc": oracles.archives,
    "op12_licenses": oracles.licenses,
    "op13_search": oracles.search,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: sql() for k, sql in _ORACLES.items()}
