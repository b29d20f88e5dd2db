"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm import alignment, decontam, htmltext, langid, licenses, packing, pii, quality, simhash, spelling, substrings, toxicity, urlrules
from tallymark.llm._common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), urlrules.rule_table(spark))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_table(spark), digests=licenses.digest_table(spark))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_simhash": op2_simhash,
    "op3_url_rules": op3_url_rules,
    "op4_licenses": op4_licenses,
    "op5_html_text": op5_html_text,
    "op6_quality": op6_quality,
    "op7_decontam": op7_decontam,
    "op8_pii": op8_pii,
    "op9_substrings": op9_substrings,
    "op10_langid": op10_langid,
    "op11_spelling": op11_spelling,
    "op12_toxicity": op12_toxicity,
    "op13_alignment": op13_alignment,
}
ORACLES: dict[str, str] = {
    "op3_url_rules": urlrules.SQL,
    "op4_licenses": licenses.SQL,
    "op7_decontam": decontam.SQL,
    "op9_substrings": substrings.SQL,
}
