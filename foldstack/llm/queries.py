"""Registered queries of the operators with their production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact, hosts, lexical, mixing, packing, passages, periodic, personal, quality, simhash, units, warc, winnowing
from .common import table

DOMAINS = 4
LANG_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 1.0}
MIX_EPOCHS, MIX_SEED = 4, 7


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domain_of(source: str) -> Column:
    """Sources are dealt to domains by their number; a source without one is of domain 0."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("domain"), F.when(number == "", 0).otherwise(F.try_to_number(number, F.lit("999999999"))).cast("int") % DOMAINS)


def mix_weights() -> dict[str, Column]:
    lang = F.lit(1.0)
    for name, weight in LANG_WEIGHTS.items():
        lang = F.when(F.col("lang") == name, weight).otherwise(lang)
    return {"domain": F.substring("domain", 7, 1).cast("double") + 1.0, "lang": lang, "source": F.lit(1.0)}


def mix_input(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("id"), domain_of("source").alias("domain"), "lang", "source", mixing.words(F.coalesce("text", F.lit(""))).alias("tokens")
    )


def op1_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the corpus has, dealt by domain, language and source, from up to four epochs."""
    docs = mix_input(table(spark, sf_dir, "documents"))
    budget = docs.agg(F.sum("tokens")).first()[0] or 0
    rows = mixing.mix(docs, F.lit(budget), mix_weights(), MIX_EPOCHS, MIX_SEED)
    return rows.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "tokens", "epoch", "take", "leaf_take")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.report(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.report(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.report(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(table(spark, sf_dir, "documents"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.report(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixture,
        op2_quality,
        op3_winnowing,
        op4_line_dedup,
        op5_exact_dedup,
        op6_warc,
        op7_simhash,
        op8_packing,
        op9_personal,
        op10_passages,
        op11_periodic_runs,
        op12_url_filter,
        op13_lexical_search,
    )
}

ORACLE = {
    "op1_mixture": mixing.ORACLE,
    "op4_line_dedup": units.ORACLE,
    "op5_exact_dedup": exact.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_url_filter": hosts.ORACLE,
    "op13_lexical_search": lexical.ORACLE,
}
