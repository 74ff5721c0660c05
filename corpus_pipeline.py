"""Corpus pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. Part of the training-data operators.

Stages judge rows, not ids: rows that repeat an id, or have none, are judged each by
its own text. Columns of docs beyond those of documents are handed on, whatever
their names. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from seqloom.llm import bpe_fold, host_rules, near_dedup, ordinal_quality, poisson_mix
from seqloom.llm.common import stored
from seqloom.llm.queries import MIX_WEIGHTS

#: SQL can't express the classifier, so the rows of run() are tested otherwise.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """Rows with a number of their own, stored so that it never changes, and the number's name."""
    key = poisson_mix.free_name("row", docs.columns)
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), "pipeline-rows"), key


def _without(rows: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    return rows.join(rejected.select(key), key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is likelier than not; a toxic or poor one goes.

    Learned from the labelled rows of ``docs``. Null and empty texts have no features
    and get the thresholds' own verdict; texts of any length are read whole.
    """
    grades = ordinal_quality.grades_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = ordinal_quality.train(docs, grades)
    return ordinal_quality.keep(docs, model)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    Null and empty texts have too few words and go; a null source is no host, so that
    such rows are judged by themselves.
    """
    rows = docs.select(F.struct("*").alias("row"), "text", "source")  # whole rows stand for their ids: none is joined back
    return host_rules.host_rules(rows, id_col="row").filter("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8): the least doc_id.

    Of rows that repeat that id with a text of the group one stays; a row without an id
    stays only if no row of its group has one. Null and empty texts are nobody's copy.
    """
    rows, key = _numbered(docs)
    classes = near_dedup.near_duplicates(rows, id_col=key, order_col="doc_id").select(key, "component_id", "n_shingles")
    grouped = stored(classes.filter("n_shingles > 0").join(rows.select(key, "doc_id"), key), "pipeline-groups")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", key)).alias("first"))
    return _without(rows, key, grouped.join(first.select(F.col(f"first.{key}").alias(key)), key, "left_anti"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows replicated to target weights of sources, in a global random order.

    Null, empty and long texts are rows like others; a null source is a source of its
    own; rows that repeat an id come equally often.
    """
    return poisson_mix.replicate(docs, weights=MIX_WEIGHTS).select(docs.columns)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of ids and of the decoded bytes.

    A null or empty text has no ids and the digests of no bytes; repeated rows are
    encoded each.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_fold.encode(docs, ranks, public_tokenizers.PATTERN)
    return bpe_fold.decode(encoded, ranks).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup_stage),
    ("mixing sources", source_mix),
    ("byte-level BPE", byte_level_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each kept is stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
