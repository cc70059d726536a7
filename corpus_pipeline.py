"""Corpus pipeline: language ID, near-dedup, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes each
stage's result as Parquet to the shared folder and rereads it.  Extra columns pass through every stage, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, decontaminate, language, pii, simhash
from marketloom.llm.tables import own_name, remove_folder, shared_dir, table, with_result


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop null texts and texts without letters (``und``); lang becomes the language found.

    Learned from the stage's own rows, so a null lang is filled; without any lang to learn from all rows go, as no
    language can be told.  Repeated rows stay; an empty table gives an empty table.
    """
    found = own_name(docs, "_found")
    named = language.identify(docs, language.train(docs), into=found)
    kept = named.where(F.col(f"{found}.lang") != language.UNKNOWN)
    return kept.withColumn("lang", F.col(f"{found}.lang")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group of near-duplicates (null ids last).

    Rows equal in doc_id and text count as one, whichever it is; of rows equal in doc_id alone one stays in each
    group.  Null and word-free texts are one group.
    """
    return simhash.keep_one_of_each(docs).select(docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; documents of which a cut leaves nothing but white space go.

    Null, empty and blank texts have nothing to cut and stay, as do repeated rows.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate.without_contamination(docs, benchmark, keep_emptied=False).select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets.  Every row stays; null and empty texts as they are."""
    return pii.redacted(docs).select(docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The identifiers of each text as ``ids``, their number as ``n_tokens``, and the text that they decode to.

    Every row stays; a null text becomes an empty one.  Columns of docs with these names are kept with ``_`` before them.
    """
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    into = own_name(docs, "_coded")
    coded = bpe.round_trip(docs, path, into=into)
    ids = F.col(f"{into}.ids")
    out = coded.withColumn("text", F.decode(F.col(f"{into}.decoded"), "UTF-8"))
    out = with_result(with_result(out, "ids", ids), "n_tokens", F.size(ids).cast("long"))
    return out.drop(into)


STAGES = [
    ("language_id", identify_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("pii", redact_personal_data),
    ("byte_bpe", encode_texts),
]

#: SQL can express neither the trained stages nor the graph stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove_folder(spark, before)  # the stage after it has been written
        before = path
    return docs
