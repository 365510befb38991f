"""A corpus pipeline: each stage works on what the stage before kept.

Language identification drops texts without a language, toxicity drops toxic ones, the
Jaccard join keeps one document (the smallest id) of each group of near copies,
decontamination drops documents that hold too much of a benchmark, and what is left is
packed into token sequences. Rows of one ``doc_id`` are one document; a row without an id
cannot be named as a copy or as contaminated and stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import decontamination, jaccard_join, language, packing, toxicity
from gaugeline.llm.queries import fold
from gaugeline.llm.support import ARROW_BYTES, give_back, materialize, ship, table

# Below this pooled probability no language is accepted.
LEAST_LANGUAGE = 0.35
# Stages return whole texts, and workers live on from stage to stage, so batches on the way to
# and from them are small: an executor holds each several times, in the JVM and in the worker.
BATCH = str(1 << 20)


def _bound(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, unless its configuration does; every stage may run alone."""
    ship(spark)
    if not spark.sparkContext.getConf().contains(ARROW_BYTES):
        spark.conf.set(ARROW_BYTES, BATCH)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound(spark)
    model = language.train(docs, use=fold("id", 3) != 1)
    give_back()  # what training held on the driver
    return language.with_language(docs, model, LEAST_LANGUAGE)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), use=fold("id", 5) != 0)
    give_back()
    return toxicity.without_toxic(docs, model)


def copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound(spark)
    return _without(docs, jaccard_join.jaccard_components(docs).filter("doc_id <> component_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound(spark)
    judged = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, materialize(judged.filter("contaminated").select("doc_id"), "contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("copies", copies_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]
# Learned stages have no SQL; the tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
