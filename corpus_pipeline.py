"""From raw documents to packed token ids, in stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  Every stage
works on all that the one before it kept; all but the last return the columns
of documents.

Columns beyond ``COLUMNS`` pass through unchanged, whatever their names: a
stage sees them under names that no operator uses.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import decontaminate, langid, mixing, simhash
from calibra.llm.common import written
from calibra.llm.queries import language_model, token_table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _own_names(stage: Stage) -> Stage:
    """The stage with columns beyond ``COLUMNS`` renamed while it works."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = {c if c in COLUMNS else f"extra_{k}_": c for k, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*own), sf_dir)
        return out.toDF(*[own[c] for c in out.columns])

    return run_stage


@_own_names
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; a missing ``lang`` is filled in."""
    found = langid.predict(docs, language_model(docs)).where(F.col("lang_pred") != langid.UNKNOWN)
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


@_own_names
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.deduplicate(docs, shingle=3, radius=3, seed=42)


@_own_names
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_own_names
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents repeat or go."""
    return mixing.mixed(docs, weights=(5, 2, 1), total=1.5, repeat=2)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_table(spark, docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix_sources),
    ("token ids", token_ids),
]

# language ID and token ids have no SQL form; tests/llm holds the stages
# against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
