"""Scoring of detections against labelled spans, latency summaries and leak checks.

gold and pred: doc_id, category, start, end and an order (`ord`) within the document.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sluice.functions.catalogue import PRIVATE_PREFIX


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap by hull; 0 if the spans do not meet."""
    inside = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, inside / hull).otherwise(0.0)


def match_iou(gold: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, category, tp, fp, fn. Gold spans take, in order, the first free prediction of their category, in the
    predictions' order, that overlaps by the threshold at least. One document's spans of a category are folded in a row."""
    g = gold.groupBy("doc_id", "category").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("g"))
    p = pred.groupBy("doc_id", "category").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("p"))
    both = g.join(p, ["doc_id", "category"], "full_outer")
    none = F.array().cast("array<int>")

    def step(used: Column, x: Column) -> Column:
        fits = F.transform("p", lambda y, k: F.when((iou(x["start"], x["end"], y["start"], y["end"]) >= threshold) & ~F.array_contains(used, k), k))
        return F.concat(used, F.array_compact(F.array(F.array_min(fits))))

    n_g = F.when(F.col("g").isNull(), 0).otherwise(F.size("g"))
    n_p = F.when(F.col("p").isNull(), 0).otherwise(F.size("p"))
    tp = F.when(F.col("g").isNull() | F.col("p").isNull(), 0).otherwise(F.size(F.aggregate("g", none, step)))
    return both.select("doc_id", "category", tp.cast("long").alias("tp"), (n_p - tp).cast("long").alias("fp"), (n_g - tp).cast("long").alias("fn"))


def in_scope(pred: DataFrame, categories: Iterable[str] | None) -> DataFrame:
    """Predictions of the categories that a corpus labels; all if it labels every one."""
    return pred if categories is None else pred.filter(F.col("category").isin(*categories))


def match_overlap(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """doc_id, category, tp, fp, fn: a prediction that meets a gold span of its category is right, also when others meet
    the same one; a gold span that none meets is missed."""
    g = gold.select("doc_id", "category", F.col("ord").alias("g"), F.col("start").alias("gs"), F.col("end").alias("ge"))
    on = ["doc_id", "category"]
    meet = (F.col("start") < F.col("ge")) & (F.col("gs") < F.col("end"))
    pairs = pred.join(g, on).filter(meet)
    right = pairs.select(*on, "ord").distinct().groupBy(*on).agg(F.count("*").alias("tp"))
    hit = pairs.select(*on, "g").distinct().groupBy(*on).agg(F.count("*").alias("hit"))
    n = pred.groupBy(*on).agg(F.count("*").alias("n_pred")).join(gold.groupBy(*on).agg(F.count("*").alias("n_gold")), on, "full_outer")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return n.join(right, on, "left").join(hit, on, "left").select(
        *on, zero("tp").alias("tp"), (zero("n_pred") - zero("tp")).alias("fp"), (zero("n_gold") - zero("hit")).alias("fn")
    )


def metrics(counts: DataFrame, digits: int | None = None) -> DataFrame:
    """precision, recall and f1 by category; 0 where nothing is predicted, labelled or right."""
    total = counts.groupBy("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    out = total.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1", ratio(2 * p * r, p + r))
    return out if digits is None else out.withColumns({c: F.round(c, digits) for c in ("precision", "recall", "f1")})


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """size, positive_examples and negative_examples of record_id, text, spans."""
    some = F.size("spans") > 0
    return corpus.agg(F.count("*").alias("size"), F.count_if(some).alias("positive_examples"), F.count_if(~some).alias("negative_examples"))


def listing(found: DataFrame) -> DataFrame:
    """The categories that occur, in order, each once."""
    return found.select("category").distinct().orderBy("category")


def summary(rows: DataFrame, value: str, quantiles=(0.5, 0.95, 0.99)) -> DataFrame:
    """n, mean and the values at sorted position rint((n - 1) * q). Equal values are counted first, so that what is sorted
    and numbered is a row for each different value; a position's value is the one whose running count reaches it. Running
    counts need the counts of the ranges before: a range-partitioned sort, whose ranges' sums are small."""
    counts = rows.select(F.col(value).alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("c"))
    total = counts.agg(F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    cuts = counts.select(F.percentile_approx("v", F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)]), F.lit(10_000)).alias("cuts"))
    ranged = counts.crossJoin(F.broadcast(cuts)).withColumn("part", F.size(F.filter("cuts", lambda x: x < F.col("v")))).drop("cuts")  # one row
    before = ranged.groupBy("part").agg(F.sum("c").alias("size"))
    before = before.withColumn("before", F.sum("size").over(W.orderBy("part")) - F.col("size"))  # a row for each range
    within = ranged.withColumn("upto", F.sum("c").over(W.partitionBy("part").orderBy("v")))
    at = within.join(F.broadcast(before.select("part", "before")), "part").withColumn("upto", F.col("before") + F.col("upto"))
    picks = F.array(*[F.struct(F.lit(q).alias("q"), F.rint((F.col("n") - 1) * F.lit(q)).cast("long").alias("rank")) for q in quantiles])
    wanted = total.select("n", "mean", F.explode(picks).alias("x")).select("n", "mean", F.col("x.q").alias("q"), F.col("x.rank").alias("rank"))
    found = at.join(F.broadcast(wanted), (F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("c")))
    return found.groupBy("n", "mean").agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"p{round(q * 100)}") for q in quantiles])


RANGES = 64

# What a capture is searched for.
SUSPICIOUS = {
    "raw_ipv4_rfc1918": (
        r"\b(?:"
        r"10\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)"
        r"|172\.(?:1[6-9]|2\d|3[01])\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)"
        r"|192\.168\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)"
        r")\b"
    ),
    "raw_email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "raw_pem_marker": r"-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----",
    "raw_aws_access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
}
# End of fixed values.


def suspicious_counts(text: Column) -> Column:
    """Map of the patterns that occur to how often."""
    entries = [F.struct(F.lit(k), F.regexp_count(text, F.lit(f"(?U){p}"))) for k, p in SUSPICIOUS.items()]
    return F.map_filter(F.map_from_entries(F.array(*entries)), lambda k, v: v > 0)


def private_address(text: Column) -> Column:
    """Whether a string begins like a private IPv4 address; octets are not checked."""
    return F.trim(text).rlike(PRIVATE_PREFIX)


def leaks(payload: Column, original: Column, shape: str) -> Column:
    """Whether a payload still holds the original, or has no sign of the rewriting."""
    return F.contains(payload, original) | ~payload.rlike(shape)


def echoes(envelope: Column, original: Column, width: int = 6) -> Column:
    """Whether any window of the original, the last one left out, occurs in the envelope. Windows of white space or of
    punctuation alone do not count."""
    n = F.length(original) - width
    window = lambda i: F.substring(original, i, width)
    real = F.filter(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), window), lambda x: ~x.rlike(r"^(?:\s*|[^\p{L}\p{N}\s]*)$"))
    return F.exists(real, lambda x: F.contains(envelope, x))


def redact_header(value: Column) -> Column:
    """A header that carries a credential with all but its last 4 signs hidden; of a shorter one nothing is shown."""
    return F.concat(F.lit("<redacted last 4: "), F.when(F.length(value) >= 4, F.right(value, F.lit(4))).otherwise("?"), F.lit(">"))


def redact_headers(headers: Column, secret: Iterable[str] = ("authorization", "x-api-key")) -> Column:
    """A map of headers with the credentials among them, whatever the case of their names, hidden."""
    return F.transform_values(headers, lambda k, v: F.when(F.lower(k).isin(*secret), redact_header(v)).otherwise(v))
