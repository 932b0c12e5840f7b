"""The whole path of a request: its strings, normalised, searched, decided on and rewritten under a policy, and put back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.catalogue import PATTERNS
from sluice.operators import detect, messages, normalize, rewrite, tokens
from sluice.plans.policy import Policy


def normalised_rows(rows: DataFrame, text: str, patterns=PATTERNS, find=None) -> DataFrame:
    """rows with norm (null if unchanged) and detections, found in the normalised text, with offsets of the original. find:
    detections of a text column, those of the patterns if not given."""
    rows = detect.settle(rows.withColumn("norm", normalize.normalized(F.col(text))), __seen=F.coalesce(F.col("norm.normalized"), F.col(text)))
    rows = detect.settle(rows, __found=detect.detect(F.col("__seen"), patterns) if find is None else find(F.col("__seen")))
    return detect.settle(rows, detections=normalize.remap(F.col("__found"), F.col("norm"), F.col(text))).drop("__seen", "__found")


def detectors_of(policy: Policy, models: Mapping[str, detect.Detector] | None = None) -> list[detect.Detector]:
    """The detectors that the policy turns on, ready to run. A model that is on must be given by name, and a detector must
    be on; else this fails, before anything is read."""
    models, on = models or {}, [n for n in ("opf", "presidio") if policy.detectors[n]]
    if missing := [n for n in on if n not in models]:
        raise RuntimeError(f"policy {policy.name} turns on {', '.join(missing)}, but no such model is given")
    found = [detect.RegexDetector(policy.patterns())] if policy.detectors["regex"] else []
    found += [models[n] for n in on]
    for d in found:
        d.validate()
    if not found:
        raise ValueError(f"policy {policy.name} turns on no detector")
    return found


def detected(rows: DataFrame, text: str, policy: Policy, models: Mapping[str, detect.Detector] | None = None, on_error: str = "closed") -> DataFrame:
    """rows with the detections of the policy's detectors, in the normalised text if it turns that on. on_error: `closed`
    fails the query where a detector fails on a text, `open` goes on with what the others find."""
    detectors = detectors_of(policy, models)
    plain = len(detectors) == 1 and isinstance(detectors[0], detect.RegexDetector)
    find = lambda x: detect.detect(x, policy.patterns()) if plain else detect.detect_all(x, detectors, on_error)["detections"]
    if policy.detectors["normalization"]:
        return normalised_rows(rows, text, find=find).drop("norm")
    return detect.settle(rows, detections=find(F.col(text)))


def process(requests: DataFrame, policy: Policy, secret: bytes, models=None, key: str = "request_id", body: str = "body", conversation: str = "conversation_id") -> DataFrame:
    """requests (one row for each key) with blocked, violations, policy_name, policy_version and new_body: the body with all
    its strings rewritten. If any string is blocked the request is: its body stays as it is and is not to be sent, and
    `rewrite.envelope` makes the reply. A request without strings passes. Strings are searched in their own rows; one
    shuffle by key brings a request's strings together again."""
    strings = messages.flatten(requests.select(key, conversation, body), body).drop(body)
    rows = tokens.with_key(detected(strings, "segment", policy, models), requests.sparkSession, secret)
    done = rewrite.apply(rows, policy, text="segment", token=lambda c, t: tokens.token(c, t, F.col(conversation)))
    found = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment_no", "violations"))), lambda x: x["violations"]))
    out = messages.rebuild(requests, done, key, body, also={"blocked": F.max("blocked"), "violations": found})
    blocked = F.coalesce("blocked", F.lit(False))
    return out.withColumns({
        "new_body": F.when(blocked, F.col(body)).otherwise(F.col("new_body")),
        "blocked": blocked,
        "violations": F.coalesce("violations", F.array()),
        "policy_name": F.lit(policy.name),
        "policy_version": F.lit(policy.version),
    })


def answer(out: DataFrame, request_id: str = "request_id") -> Column:
    """The JSON reply of a blocked request; null of others."""
    return F.when(F.col("blocked"), rewrite.envelope(out, request_id))
