"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the shorter of two runs, after
one at a small scale that warms up. Prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sluice import queries  # noqa: E402
from sluice.functions.catalogue import PATTERNS  # noqa: E402
from sluice.operators import detect, rewrite  # noqa: E402
from sluice.plans import policy as P  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


SMALL = "/root/testdata/sf0.001"


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(int(CPUS))


def detect_documents(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(detect.detect(F.col("text"), PATTERNS)).alias("n"))


def detect_and_audit(spark, sf):
    rows = documents(spark, sf).withColumn("detections", detect.detect(F.col("text"))).withColumn("request_id", F.col("doc_id").cast("string"))
    return rewrite.audit_events(rewrite.apply(rows, P.AUDIT_ALL), "request_id", "request_id", queries.NOW, queries.HASH)


NAMES = ("engine_default", "engine_mask", "detection_counts", "suspicious_counts", "restore_roundtrip", "request_rewrite", "conversation_segments", "normalized_detections", "latency_summary")
HEADLINES = {"detect_documents": detect_documents, "detect_and_audit": detect_and_audit, "flagship": queries.flagship, **{n: queries.QUERIES[n] for n in NAMES}}


def seconds(spark, make, sf: str) -> float:
    began = time.time()
    make(spark, sf).write.format("noop").mode("overwrite").save()
    return time.time() - began


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/documents.parquet").count()
    took = {}
    for name, make in HEADLINES.items():
        if os.path.isdir(SMALL):
            seconds(spark, make, SMALL)
        took[name] = round(min(seconds(spark, make, SF) for _ in range(2)), 3)
    n = spark.read.parquet(f"{SF}/documents.parquet").agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    rates = {k: {"ms_per_document": round(took[k] * 1000 / n[0], 4), "mb_per_s": round(n[1] / 1e6 / took[k], 1)} for k in ("detect_documents", "detect_and_audit", "flagship", "engine_default")}
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF, "cpus": CPUS, "rates": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
