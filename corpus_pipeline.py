"""A training corpus from the documents table, in five stages.

Each stage takes what its predecessor kept, as written to Parquet and read again. Stages decide by doc_id: of rows that
share an id, all go or all stay, except that the near-duplicate stage drops repeated rows. Null is an id like any other.
Empty tables stay empty; columns beside doc_id, text, lang and source pass through, whatever they are called. The last
stage says what the mixed corpus takes of each document; lautwerk.llm.mixing.mixed_blocks writes its words out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lautwerk.llm.common import materialize
from lautwerk.llm.decontaminate import clean_documents
from lautwerk.llm.jaccard_join import jaccard_components
from lautwerk.llm.language_id import identify
from lautwerk.llm.mixing import mix_sources
from lautwerk.llm.quality_rules import quality_rules

#: A text is taken for a language when no other fits about as well.
LEAST_LANGUAGE_SCORE = 0.4


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids; null counts as a value."""
    ids = ids.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, quality_rules(docs).where("kept"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, identify(docs).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id. Of rows repeated with id and text, one stays."""
    kept = _keep(docs, jaccard_components(docs).where("component_id <=> doc_id"))
    twice = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice_id"))
    if twice.isEmpty():
        return kept
    kept = materialize(kept)
    on = kept["doc_id"].eqNullSafe(twice["twice_id"])
    return kept.join(twice, on, "left_anti").unionByName(kept.join(twice, on, "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing)]

#: Expectation-maximisation, kernels and exact set joins are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
