"""A corpus pipeline of the training-data operators.

``STAGES`` lists (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``:

1. ``quality`` scores whole texts with the convolutional network; rejected documents go.
2. ``exact`` keeps the row of the largest id of each set of equal texts.
3. ``near`` keeps the row of the smallest id of each group of near copies: five-word Jaccard similarity of 0.8 or more
   between texts whose SimHash fingerprints differ in at most 11 bits (near copies are up to 11 apart).
4. ``mix`` brings sources nearer to their target weights: the kept tokens are shared out over the tree of domains,
   languages and sources, no document is read twice, and the document in which a leaf's budget ends keeps its first
   tokens.
5. ``pack`` lays all token ids into sequences of at most 4,096.

Nulls: a missing text is empty, missing ids and levels are values of their own; an empty table passes through empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foldstack.llm import exact, mixing, packing, quality, queries, simhash
from foldstack.llm.common import store, table

#: Differing bits up to which two texts are compared; subtrees of fingerprints up to this size are compared directly.
NEAR_BITS, NEAR_SUBTREE = 11, 1 << 18
#: Share of the tokens that the mixture keeps, and its seed.
MIX_SHARE, MIX_SEED = 0.95, 7


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_latest(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first_alike(docs, NEAR_BITS, subtree=NEAR_SUBTREE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, queries.domain_of("source"), MIX_SHARE, queries.mix_weights(), MIX_SEED)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.report(docs, queries.vocabulary("word_bpe_49k.json"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("exact", drop_copies),
    ("near", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: A trained network and a tokenizer are no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
