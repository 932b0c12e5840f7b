"""The corpus pipeline: documents to token ids, in five stages.

Every stage gets what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents; the last returns each kept document's token ids. Null and empty texts go at the first stage, as texts without
a letter do; given to a later stage they stay, with an end id alone at the last. Repeated rows are copies: one stays at
the second stage. Empty tables give empty results. Further columns pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import decontaminate, jaccard_join, langid, pieces, secret_scan
from sluice.llm.common import Stage, fold, mark, release, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier does not reject."""
    model = langid.train(docs, fold("doc_id", 5) != 0)
    return langid.predict(docs, model).filter("NOT rejected").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and similar texts, the document with the least id."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a tag; n_chars follows the text. A run of hex digits alone is not taken for
    a secret here, because digests and numbers are such runs; one that is assigned or decodes to a key is."""
    return secret_scan.redact(docs, [k for k in secret_scan.KINDS if k != "hex"])


def sentencepiece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids (the end id last) of every document, and whether they decode to its text."""
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("sentencepiece", sentencepiece_ids),
]

ORACLE_SQL = None
"""Trained, approximate and tokenizer stages have no SQL; tests hold the stages against brute force."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage has read and made on the way goes when its result is written."""
    stage, docs = Stage(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        at = mark()
        docs = stage.write(step(spark, docs, sf_dir), name)
        release(at)
        if k:
            stage.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)
