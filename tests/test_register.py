from __future__ import annotations

import random

from pyspark.sql import functions as F

from sluice.functions.register import Scanner, register
from sluice.operators import detect, rewrite
from sluice.plans import policy as P
from tests.test_engine import POSITIVE


def test_sql_functions_equal_columns(spark):
    register(spark)
    rng = random.Random(8)
    bits = [*POSITIVE.values(), " ", " é ", "x", ", ", "\n"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(60)] + ["", None]
    spark.createDataFrame(list(enumerate(texts)), "k int, text string").createOrReplaceTempView("sql_texts")
    rows = spark.table("sql_texts")
    plain = lambda ds: [(d.category, d.start, d.end, d.matched_text, d.confidence, d.detector) for d in ds or []]
    want = {r.k: plain(r.d) for r in rows.select("k", detect.detect(F.col("text")).alias("d")).collect()}
    got = {r.k: plain(r.d) for r in spark.sql("SELECT k, pii_detect(text) AS d FROM sql_texts").collect()}
    assert got == want
    spans = spark.sql("SELECT k, s.* FROM sql_texts, LATERAL pii_spans(text) s").collect()
    assert sorted((r.k, r.start, r.detector) for r in spans) == sorted((k, d[1], d[5]) for k, ds in want.items() for d in ds)
    masked = {r.k: r.rewritten_text for r in rewrite.apply(detect.settle(rows, detections=detect.detect(F.col("text"))), P.MASK_ALL).collect()}
    assert {r.k: r.m for r in spark.sql("SELECT k, pii_mask(text) AS m FROM sql_texts").collect()} == masked
    assert spark.sql("SELECT pii_normalize('a&#64;b.co') AS n").first().n == "a@b.co"


def test_anchors_heed_case_as_their_pattern_does():
    for name, text in POSITIVE.items():
        assert f"regex:{name}" in {d[5] for d in Scanner().detect(text)}, name
    assert [d[5] for d in Scanner().detect(POSITIVE["aws_secret_access_key"].swapcase())] == ["regex:aws_secret_access_key"]
