"""The queries of the operators, under the names that the entry module registers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, decontaminate, hmm, jaccard_join, knn_quality, langid, line_rules, pieces, secret_scan, warc
from .common import Stage, fold, table


def op1_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.attribute(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Stage(spark, "warc").path
    warc.write(table(spark, sf_dir, "pages"), path)
    warc.export(warc.read(spark, path), f"{path}/warc")  # every record is rebuilt
    return warc.pages(warc.parse(spark, f"{path}/warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2, fold("doc_id", 7) == 2)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("secrets")
    base = F.filter(found, lambda x: x["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
    return secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.joined(base), 256).alias("base_sha256"),
        secret_scan.joined(found).alias("spans"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold("doc_id", 5) != 0)
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[n for n in line_rules.OUT if n != "cleaned"], F.length("cleaned").alias("cleaned_chars"))


def op10_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = knn_quality.train(docs, labels.filter(fold("doc_id", 4) != 2))
    out = knn_quality.score(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_attribution,
        op2_warc_archive,
        op3_sentencepiece,
        op4_hidden_markov,
        op5_jaccard_join,
        op6_decontamination,
        op7_secret_scan,
        op8_language_id,
        op9_line_rules,
        op10_knn_quality,
    )
}
