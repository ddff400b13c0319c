"""Corpus pipeline over `documents`: language ID, near-dedup, decontamination, secret scan, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it
kept.  All but the last return the columns of `documents`; the last returns what the mix
takes of each document it takes anything of.  Models are trained on the stage's own input.

Nulls and repeats: a null or empty text is rejected by language ID; rows without an id pass
near-dedup and are checked like others by the rest; repeated rows count each, but near-dedup
keeps one row of an id.  Other columns may have any name and pass as they are.  An empty
table gives an empty result.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import decontam, langid, secrets
from vigil.llm.common import fresh, read
from vigil.llm.mixing import mix
from vigil.llm.near_dedup import keep_one
from vigil.llm.queries import quality_of
from vigil.session import checkpoint_dir


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model places; the ones that it rejects go."""
    names = tuple(fresh(c, docs.columns) for c in ("lang_pred", "score", "rejected"))
    placed = langid.identify(docs, langid.train(docs), docs.columns, names)
    return placed.where(~F.col(names[2])).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their text replaced."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(docs)))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes words of, with how many."""
    return (mix(docs, quality=quality_of(spark, sf_dir)).where("taken > 0")
            .select("doc_id", "source", "size", "source_size", "target", "taken"))


STAGES = [("language_id", language_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("secret_scan", secrets_stage), ("mixing", mixing_stage)]

#: Learned models and hash-based sampling have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/vigil-pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
