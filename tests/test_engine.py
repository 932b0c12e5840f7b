"""Detection, decisions, rewriting, tokens, normalisation, messages, scoring."""

from __future__ import annotations

import base64
import json
import random
import re
import time
import urllib.parse
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import queries
from sluice.functions.catalogue import BASELINE, CATEGORIES, PATTERNS
from sluice.operators import detect, messages, normalize, rewrite, score, tokens
from sluice.plans import policy as P
from sluice.plans.engine import answer, process
from sluice.queries import normalised_rows
from sluice.sources.corpora import chunks, markdown, privacy_corpus, secrets_corpus, synthetic, write_capture, write_results

HEX = "0123456789abcdef" * 8
POSITIVE = {
    "pem_private_key": "-----BEGIN OPENSSH PRIVATE KEY-----",
    "aws_access_key_id": "AKIA" + "A1" * 8,
    "aws_secret_access_key": "aws_secret_key = " + "a" * 40,
    "gcp_service_account_json": '"type": "service_account",\n "x": 1, "private_key": ',
    "gcp_api_key": "AIza" + "b" * 35,
    "azure_storage_connection_string": "DefaultEndpointsProtocol=https;AccountName=abc;AccountKey=" + "k" * 44 + "==;",
    "azure_ad_client_secret": "abcQ" + "d" * 33,
    "postgres_url": "postgres://u:p@h:5432/db",
    "mysql_url": "mysql://u:p@h/db",
    "mongodb_url": "mongodb+srv://u:p@h/db",
    "redis_url": "rediss://:p@h:6379",
    "jwt": "eyJ" + HEX[:12] + ".eyJ" + HEX[:12] + "." + HEX[:14],
    "rfc1918_ipv4": "172.31.255.1",
    "email": "jane.doe+x@mail.example.org",
    "domain": "Build.Example.CO",
    "slack_token": "xoxb-" + "1a" * 8,
    "github_pat": "ghp_" + "a" * 36,
    "github_fine_grained_pat": "github_pat_" + "a" * 82,
}
NEGATIVE = ["8.8.8.8 and 172.245.203.187 and 253.10.218.129", "AKIA too short", "é10.0.0.1", "eyJ.eyJ.x", "plain words only", ""]


def found(spark, texts, patterns=PATTERNS, dedupe=True):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return {r.k: r.d for r in frame.select("k", detect.detect(F.col("text"), patterns, dedupe).alias("d")).collect()}


def test_each_pattern_finds_its_sample_with_offsets(spark):
    names = list(POSITIVE)
    texts = [f"é\U0001f600 {POSITIVE[n]} tail" for n in names]
    got = found(spark, texts, dedupe=False)
    for k, n in enumerate(names):
        hits = [d for d in got[k] if d.detector == f"regex:{n}"]
        assert hits, n
        for d in got[k]:
            assert texts[k][d.start : d.end] == d.matched_text and d.category in CATEGORIES
    assert set(names) == {p.name for p in PATTERNS}


def test_negative_texts(spark):
    assert all(not d for d in found(spark, NEGATIVE).values())


def python(pattern):
    flags = (re.I if "(?i)" in pattern.regex else 0) | (re.S if "(?s)" in pattern.regex else 0)
    return re.compile(pattern.regex.replace("(?i)", "").replace("(?s)", ""), flags)


def test_matches_equal_finditer_on_mixed_texts(spark):
    rng = random.Random(3)
    bits = [*POSITIVE.values(), " ", " ", ", ", "é", "\n", "x", ".", "\U0001f600", "10.0.0.300", "a@b.co", "\r", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(150)]
    got = found(spark, texts, (*PATTERNS, *BASELINE), dedupe=False)
    for k, t in enumerate(texts):
        for p in (*PATTERNS, *BASELINE):
            want = [(m.start(), m.end()) for m in python(p).finditer(t)]
            assert [(d.start, d.end) for d in got[k] if d.detector == p.detector] == want, (p.name, t)


def test_many_matches_take_no_square_time(spark):
    """Also through deciding, selecting and replacing; each against the text itself."""
    took = []
    for n in (2000, 20_000):
        text = "".join(f"a{k}@x.com 10.0.0.{k % 256} " for k in range(n))
        rows = spark.createDataFrame([(text,)], "text string")
        began = time.time()
        r = rewrite.apply(rows.withColumn("detections", detect.detect(F.col("text"))), P.MASK_ALL).select(F.size("detections").alias("n"), "rewritten_text").first()
        took.append(time.time() - began)
        assert r.n == 3 * n and r.rewritten_text == "[EMAIL_REDACTED] [INTERNAL_IP_REDACTED] " * n
    assert took[1] < 15 * took[0], took


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1500])
def test_folds_and_slices_do_not_depend_on_blocks(spark, n):
    rng = random.Random(n)
    text = "".join(rng.choices("abé\U0001f600 ", k=4000))
    cuts = sorted(rng.sample(range(4000), 2 * n))
    pairs = list(zip(cuts[::2], cuts[1::2], strict=True))
    rows = spark.createDataFrame([(text, pairs)], "text string, s array<struct<start:int,end:int>>")
    longer = detect.folded(F.col("s"), F.lit(0), lambda at, x: (F.greatest(at, x["end"] - x["start"]), F.when(x["end"] - x["start"] > at, F.array(x["end"])).otherwise(F.array().cast("array<int>"))), "int")
    r = rows.select(detect.slices(F.col("text"), F.col("s")).alias("t"), longer.alias("f")).first()
    want, most = [], 0
    for a, b in pairs:
        if b - a > most:
            want, most = [*want, b], b - a
    assert r.t == [text[a:b] for a, b in pairs] and r.f == want


def test_letters_that_fold_to_ascii_pass_the_anchors(spark):
    text = "a\u017f.B\u0131g.u\u017f and aw\u017f secret = " + "a" * 40 + " and x.co\u212a.\u0130o"
    assert {d.detector for d in found(spark, [text], dedupe=False)[0]} >= {d for p in PATTERNS if p.name in ("domain", "aws_secret_access_key") for d in [p.detector] if python(p).search(text)}


def test_null_text_has_no_detections(spark):
    frame = spark.createDataFrame([(None,)], "text string")
    assert frame.select(F.coalesce(detect.detect(F.col("text")), detect.empty()).alias("d")).first().d == []


def detections(rows):
    return [(c, s, e, "x" * (e - s), conf, f"t:{c}", k) for k, (c, s, e, conf) in enumerate(rows)]


def frame_of(spark, text, rows):
    return spark.createDataFrame([(text, detections(rows))], f"text string, detections {detect.NONE}")


def test_overlaps_within_a_category_only(spark):
    rows = [("secret", 0, 5, 0.5), ("secret", 0, 9, 0.4), ("secret", 8, 12, 0.9), ("email", 2, 6, 0.9), ("secret", 9, 11, 0.1)]
    one = frame_of(spark, "", rows).select(detect.overlap_free(F.filter("detections", lambda d: d["category"] == "secret")).alias("d")).first().d
    assert [(d.start, d.end) for d in one] == [(0, 9), (9, 11)]


# ---- decisions ----


def test_rules_fall_through_to_later_ones(spark):
    policy = P.Policy("p", rules=(P.Rule("email", "BLOCK", 0.9), P.Rule("email", "MASK", 0.5, True), P.Rule("email", "TOKENIZE")))
    rows = spark.createDataFrame([("email", c) for c in (0.95, 0.7, 0.2)] + [("jwt", 1.0)], "c string, p double")
    got = [tuple(r) for r in rows.select(policy.action(F.col("c"), F.col("p")), policy.audit(F.col("c"), F.col("p"))).collect()]
    assert got == [("BLOCK", False), ("MASK", True), ("TOKENIZE", False), ("ALLOW", False)]


def test_pruned_patterns_change_nothing(spark):
    texts = [f"{a} and {b}" for a in POSITIVE.values() for b in list(POSITIVE.values())[:4]]
    policy = P.FLOORS
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    full = rows.select(rewrite.decide(detect.detect(F.col("text")), policy).alias("d")).collect()
    less = rows.select(rewrite.decide(detect.detect(F.col("text"), policy.patterns()), policy).alias("d")).collect()
    plain = lambda xs: [[(d.category, d.start, d.action, d.audit) for d in x.d] for x in xs]
    assert plain(full) == plain(less)


def test_block_leaves_the_text_and_reports(spark):
    text = f"mail a@b.co key {POSITIVE['aws_access_key_id']}"
    rows = spark.createDataFrame([("r1", text)], "request_id string, text string").withColumn("detections", detect.detect(F.col("text")))
    out = rewrite.apply(rows, P.REGEX_ONLY)
    r = out.select("*", rewrite.envelope(out).alias("e")).first()
    assert r.blocked and r.rewritten_text == text and [v.category for v in r.violations] == ["cloud_api_key"]
    body = json.loads(r.e)
    assert body["error"]["detail"]["violation_count"] == 1 and body["error"]["detail"]["categories"] == ["cloud_api_key"]
    assert body["error"]["param"] is None and "AKIA" not in r.e and "1 violation in 1 category" in body["error"]["message"]
    assert list(body) == sorted(body) and [a.action for a in r.audit] == ["BLOCK"]


def plain_rewrite(text, spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[3], s[4])):
        if all(not (s[0] < k[1] and k[0] < s[1]) for k in kept):
            kept.append(s)
    out, at = [], 0
    for a, b, r, *_ in sorted(kept):
        out += [text[at:a], r]
        at = b
    return "".join(out) + text[at:]


def test_longest_first_rewriting_equals_a_plain_fold(spark):
    rng = random.Random(5)
    text = "".join(chr(97 + k % 26) for k in range(60)) + "é\U0001f600"
    cases = []
    for k in range(80):
        rows = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randrange(55)
            rows.append((rng.choice(["email", "domain", "internal_ip"]), a, a + rng.randint(1, 7), rng.choice([0.7, 0.9])))
        cases.append(rows)
    frame = spark.createDataFrame([(k, text, detections(r)) for k, r in enumerate(cases)], f"k int, text string, detections {detect.NONE}")
    got = {r.k: r.rewritten_text for r in rewrite.apply(frame, P.REGEX_ONLY, token=lambda c, t: F.concat(F.lit("<"), c, F.lit(">"))).collect()}
    for k, rows in enumerate(cases):
        masks = [(a, b, "[EMAIL_REDACTED]", p, i) for i, (c, a, b, p) in enumerate(r for r in rows if r[0] == "email")]
        toks = [(a, b, f"<{c}>", p, 100 + i) for i, (c, a, b, p) in enumerate(r for r in rows if r[0] != "email")]
        assert got[k] == plain_rewrite(text, masks + toks)


def test_rightmost_first_rule(spark):
    spans = [(0, 5, "A", "c", 0.9, "d", "MASK", 0), (4, 9, "B", "c", 0.9, "d", "MASK", 1), (8, 10, "C", "c", 0.9, "d", "MASK", 2)]
    frame = spark.createDataFrame([("0123456789", spans)], f"text string, s array<{rewrite.SPAN}>")
    assert frame.select(rewrite.substitute(F.col("text"), rewrite.rightmost_first(F.col("s"))).alias("r")).first().r == "A567C"


def test_audit_events_hold_no_text(spark, tmp_path):
    rows = spark.createDataFrame([("r", "write a@b.co now")], "request_id string, text string").withColumn("detections", detect.detect(F.col("text")))
    events = rewrite.audit_events(rewrite.apply(rows, P.AUDIT_ALL), "request_id", "request_id", "2024-01-01T00:00:00Z", "sha256:x")
    r = events.filter("category = 'email'").first()
    assert (r.rule, r.span.offset, r.span.length, r.would_have_been_action) == ("email -> MASK", 6, 6, "MASK")
    assert not set(events.columns) & set(rewrite.FORBIDDEN)
    rewrite.write_audit(events, f"file://{tmp_path}/audit")
    assert spark.read.json(f"file://{tmp_path}/audit").count() == events.count()
    with pytest.raises(ValueError):
        rewrite.write_audit(events.withColumn("text", F.lit("")), f"file://{tmp_path}/audit")
    assert rewrite.audit_events(rewrite.apply(rows, P.REGEX_ONLY), "request_id", "request_id", "t", "h").count() == 0


def test_rewriting_is_idempotent(spark):
    rows = spark.createDataFrame([(f"mail a@b.co at 10.0.0.1 see x.example.com {k}",) for k in range(3)], "text string")
    once = rewrite.apply(rows.withColumn("detections", detect.detect(F.col("text"))), P.MASK_ALL).select(F.col("rewritten_text").alias("text"))
    twice = rewrite.apply(once.withColumn("detections", detect.detect(F.col("text"))), P.MASK_ALL)
    assert twice.filter("rewritten_text <> text").count() == 0


# ---- detectors ----


class Broken(detect.Detector):
    name = "broken"

    def column(self, text):
        return F.struct(detect.empty().alias("detections"), F.lit("down").alias("error"))


def test_a_failing_detector_keeps_the_others(spark):
    rows = spark.createDataFrame([("a@b.co",)], "text string")
    r = rows.select(detect.detect_all(F.col("text"), [Broken(), detect.RegexDetector()]).alias("x")).first().x
    assert r.errors == ["down"] and r.detections
    with pytest.raises(Exception, match="down"):
        rows.select(detect.detect_all(F.col("text"), [Broken()], on_error="closed").alias("x")).collect()
    with pytest.raises(ValueError):
        detect.detect_all(F.col("text"), [])


def test_model_labels_map_to_categories(spark):
    reply = lambda text: F.array(*[F.struct(F.lit(x).alias("label"), F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit(0.8).alias("score")) for x in ("PRIVATE_EMAIL", "novel")])
    rows = spark.createDataFrame([("abcdef",)], "text string")
    r = rows.select(detect.privacy_model(reply).column(F.col("text")).alias("x")).first().x
    assert [(d.category, d.detector, d.matched_text) for d in r.detections] == [("email", "opf:private_email", "abc"), ("other", "opf:novel", "abc")]
    with pytest.raises(RuntimeError):
        detect.entity_model(reply, ready=lambda: "no connection").validate()


# ---- tokens ----


def test_token_is_an_hmac(spark):
    import hashlib
    import hmac

    rows = tokens.with_key(spark.createDataFrame([("c1", "é@b.co"), ("c2", "é@b.co"), ("c1", "é@b.co")], "c string, o string"), spark, b"k" * 100)
    got = [r.t for r in rows.select(tokens.token(F.lit("email"), F.col("o"), F.col("c")).alias("t")).collect()]
    field = lambda x: f"{len(x.encode())}:{x}"
    want = hmac.new(b"k" * 100, "".join(map(field, ("0", "c1", "email", "é@b.co"))).encode(), hashlib.sha256).hexdigest()[:16]
    assert got[0] == got[2] == f"[EMAIL_{want}]" and got[1] != got[0]
    assert rows.select(tokens.token(F.lit("email"), F.col("o"), F.col("c"), "1").alias("t")).first().t != got[0]


def ledger(spark):
    rows = [("a", "[EMAIL_0123456789abcdef]", "email", "x@y.co", 100), ("b", "[EMAIL_0123456789abcdef]", "email", "other", 5000), ("a", "[DOMAIN_00000000000000ff]", "domain", "$1\\d.org", 90)]
    return spark.createDataFrame(rows, "conversation_id string, token string, category string, original string, s long").withColumn("last_access", F.timestamp_seconds("s")).drop("s")


def test_restore_is_isolated_by_conversation(spark):
    texts = [("a", "hi [EMAIL_0123456789abcdef] [DOMAIN_00000000000000ff][EMAIL_ffffffffffffffff]"), ("b", "hi [EMAIL_0123456789abcdef]!"), ("c", "[EMAIL_0123456789abcdef]"), ("a", None), ("a", "")]
    rows = spark.createDataFrame(texts, "conversation_id string, text string")
    got = {(r.conversation_id, r.text): r.restored for r in tokens.restore(rows, ledger(spark)).collect()}
    assert [got[t] for t in texts] == ["hi x@y.co $1\\d.org[EMAIL_ffffffffffffffff]", "hi other!", "[EMAIL_0123456789abcdef]", None, ""]
    anyone = {r.conversation_id: r.restored for r in tokens.restore(rows.filter("conversation_id = 'c'"), ledger(spark), conversation=None).collect()}
    assert anyone == {"c": "x@y.co"}


def test_idle_conversations_expire_as_a_whole(spark):
    now = F.timestamp_seconds(F.lit(3700))
    assert {r.conversation_id for r in tokens.expire(ledger(spark), now).collect()} == {"a", "b"}
    assert {r.conversation_id for r in tokens.expire(ledger(spark), F.timestamp_seconds(F.lit(3701))).collect()} == {"b"}
    accesses = spark.createDataFrame([("a", 3600)], "conversation_id string, s long").select("conversation_id", F.timestamp_seconds("s").alias("at"))
    moved = tokens.touch(ledger(spark), accesses)
    assert tokens.expire(moved, F.timestamp_seconds(F.lit(7000))).count() == 3
    assert {r.conversation_id for r in tokens.most_recent(ledger(spark), 1).collect()} == {"b"}
    shot = {r.conversation_id: r.n_tokens for r in tokens.snapshot(ledger(spark)).collect()}
    assert shot == {"a": 2, "b": 1}


# ---- normalisation ----


@pytest.mark.parametrize(
    "text, want, flags",
    [
        ("plain", "plain", []),
        ("Ⅴ ＡＢ", "V AB", ["nfkc"]),
        ("a​b­c͏", "abc", ["default_ignorable"]),
        ("x&#64;y.co &amp &lt;", "x@y.co &amp <", ["html_entity"]),
        ("a%40b.co %zz +", "a@b.co %zz +", ["url_encoded"]),
        ("%ff bad", "%ff bad", []),
        (base64.b64encode(b"mail me at a@b.co").decode(), "mail me at a@b.co", ["base64_nested"]),
        (base64.b64encode(urllib.parse.quote("é@x.co is the mail", safe="").encode()).decode(), "é@x.co is the mail", ["base64_nested", "url_encoded"]),
        ("internationalization", "internationalization", []),
    ],
)
def test_normalisation_steps(text, want, flags):
    t, got = normalize.normalize(text)
    assert t.text == want and got == flags


@given(st.text(alphabet="aé​&#64;%40Ⅴﬁ=QUJDREVGR0hJSktMTU5P日", max_size=60))
@settings(max_examples=300, deadline=None)
def test_maps_stay_in_the_original(text):
    t, _ = normalize.normalize(text)
    assert len(t.text) == len(t.start) == len(t.end) == len(t.kind)
    assert all(0 <= a < b <= len(text) for a, b in zip(t.start, t.end, strict=True))
    assert list(t.start) == sorted(t.start)
    for k, c in enumerate(t.text):
        if t.kind[k] == normalize.IDENTITY:
            assert text[t.start[k]] == c


def test_composed_maps_equal_one_chain():
    text = "x​&#64;y.co and %41%26"
    first = normalize.normalize(text, normalize.Options(html_entities=False, url_decode=False, base64=False))[0]
    second = normalize.normalize(first.text, normalize.Options(nfkc=False, strip_ignorable=False))[0]
    whole = normalize.normalize(text)[0]
    both = normalize.compose(first, second)
    assert both.text == whole.text and both.start.tolist() == whole.start.tolist() and both.end.tolist() == whole.end.tolist()


def test_detections_map_back_to_the_original(spark):
    hidden = base64.b64encode(b"the mail is jane@example.org ok").decode()
    texts = ["to j&#97;ne&#64;example.org now", f"see {hidden} end", "ja​ne@example.org", "plain jane@example.org", None]
    rows = normalised_rows(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string"), "text")
    got = {r.k: [d for d in r.detections or [] if d.category == "email"] for r in rows.collect()}
    assert [[d.matched_text for d in got[k]] for k in range(4)] == [["j&#97;ne&#64;example.org"], [hidden], ["ja​ne@example.org"], ["jane@example.org"]]
    assert all(texts[k][d.start : d.end] == d.matched_text for k in range(4) for d in got[k])


def hidden_documents(spark, path):
    """Documents (of ids to which nothing is added) with encoded secrets and addresses: text, encoded part, category."""
    key, url, mail = "AKIA" + "B7" * 8, "postgresql://u:pw12345@db.corp:5432/app", "jane@example.org"
    wide = "".join(chr(ord(c) + 0xFEE0) for c in key)
    made = [
        (base64.b64encode(f"use key {key} now".encode()).decode(), "cloud_api_key"),
        (url.replace("postgresql:", "postgresql%3A").replace("@", "%40"), "database_url"),
        (wide, "cloud_api_key"),
        (mail.replace("@", "&#64;"), "email"),
        (mail.replace("@", "\u200b@"), "email"),
    ]
    rows = [(19 + 20 * k, "en", f"see {x} end", x, c) for k, (x, c) in enumerate(made)]
    spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, text string").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    return {r[0]: r[2:] for r in rows}


def test_every_rewriting_query_reads_encoded_texts(spark, tmp_path):
    hidden = hidden_documents(spark, tmp_path)
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    secret = {k for k, (_, _, c) in hidden.items() if c != "email"}
    for rows in (run("engine_default"), queries.flagship(spark, str(tmp_path)).collect()):
        assert {r.doc_id for r in rows if r.blocked} == secret
        assert all(r.rewritten_text == "see [EMAIL_REDACTED] end nothing".removesuffix("" if "n_detections" not in r else " nothing") for r in rows if not r.blocked)
    assert {r.doc_id: r.rewritten_text for r in run("engine_mask")} == {k: f"see [{c.upper()}_REDACTED] end nothing" for k, (_, _, c) in hidden.items()}
    assert all(hidden[r.doc_id][1] not in r.rewritten_text for r in run("engine_tokenize"))
    assert {r.doc_id for r in run("blocked_documents")} == secret
    spans = {(r.request_id, r.category, r.offset, r.length) for r in run("audit_events")}
    assert {(str(k), c, 4, len(x)) for k, (_, x, c) in hidden.items()} <= spans
    assert {(k, c, x) for k, (_, x, c) in hidden.items()} <= {(r.conversation_id, r.category, r.original) for r in run("token_ledger")}
    assert {r.doc_id: r.restored for r in run("restore_roundtrip")} == {k: f"{t} nothing" for k, (t, _, _) in hidden.items()}
    acts = {(r.doc_id, r.policy) for r in run("policy_actions") if r.category != "domain"}
    plain = {k for k, (t, _, _) in hidden.items() if any(re.search(p.regex, t) for p in PATTERNS if p.category != "domain")}
    assert acts == {(k, p) for p in ("regex-only", "audit-all") for k in hidden} | {(k, "floors") for k in plain}


def test_leak_check_looks_for_each_text_s_own_secret(spark, tmp_path):
    key = "AKIA" + "B7" * 8
    rows = [(19, "en", f"key {key} beside x{key}"), (39, "en", f"key {key} only"), (59, "en", "made of nothing")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.leaked for r in queries.leak_check(spark, str(tmp_path)).collect()}
    assert got == {19: True, 39: False, 59: True}  # the second copy has no word boundary; the last text has no mask


def test_a_failing_detector_s_error_stays_in_its_row(spark):
    def call(text):
        if "bad" in text:
            raise KeyError("no")
        return {"detections": [{"entity_type": "PERSON", "start": 0, "end": 3, "score": 1}, {"entity_type": "", "start": 1, "end": 2, "score": 0.5}, {"entity_type": "URL", "start": 1, "end": 2, "score": 0.5}]}

    model = detect.entity_model(detect.guarded(call, ["person", ""]), tells=True)
    rows = spark.createDataFrame([(0, "ann a@b.co"), (1, "bad a@b.co"), (2, None)], "k int, text string")
    got = {r.k: r.x for r in rows.select("k", detect.detect_all(F.col("text"), [detect.RegexDetector(), model]).alias("x")).collect()}
    assert [d.detector for d in got[0].detections] == ["regex:email", "regex:domain", "presidio:PERSON", "presidio:unknown"] and got[0].errors == []
    assert [d.detector for d in got[1].detections] == ["regex:email", "regex:domain"] and got[1].errors == ["KeyError: 'no'"]
    assert got[2].errors == []
    with pytest.raises(Exception, match="KeyError"):
        queries.detected(rows, "text", replace(P.MASK_ALL, detectors=P.MASK_ALL.detectors | {"presidio": True}), {"presidio": model}).collect()


def test_tokens_become_entities(spark):
    tokens = [("B-PER", 0, 3, 0.9, False), ("I-LOC", 3, 5, 0.95, True), ("I-PER", 6, 9, 0.5, False), ("B-PER", 10, 12, 0.8, False), ("O", 13, 15, 0.9, False), ("LOC", 16, 18, 0.7, False)]
    rows = spark.createDataFrame([(tokens,), ([],)], "t array<struct<label:string,start:int,end:int,score:double,inside:boolean>>")
    for strategy, want in {
        "simple": [("PER", 0, 3, 0.9), ("LOC", 3, 5, 0.95), ("PER", 6, 9, 0.5), ("PER", 10, 12, 0.8), ("LOC", 16, 18, 0.7)],
        "first": [("PER", 0, 9, 0.7), ("PER", 10, 12, 0.8), ("LOC", 16, 18, 0.7)],
        "max": [("LOC", 0, 5, 0.95), ("PER", 6, 9, 0.5), ("PER", 10, 12, 0.8), ("LOC", 16, 18, 0.7)],
        "average": [("LOC", 0, 5, 0.475), ("PER", 6, 9, 0.5), ("PER", 10, 12, 0.8), ("LOC", 16, 18, 0.7)],
    }.items():
        got = [[(x.label, x.start, x.end, round(x.score, 6)) for x in r.e] for r in rows.select(detect.entities(F.col("t"), strategy).alias("e")).collect()]
        assert got == [want, []], strategy
    with pytest.raises(ValueError, match="strategy"):
        detect.entities(F.col("t"), "most")


def test_texts_that_cannot_change_are_not_sent_to_python(spark):
    rows = spark.createDataFrame([("plain text of words",), ("one &amp; two",), ("caf\u00e9",)], "text string")
    run = normalize.normalized(F.col("text"))
    assert [r.n for r in rows.select(run["normalized"].alias("n")).collect()] == [None, "one & two", None]
    plan = rows.select(run.alias("n"))._jdf.queryExecution().executedPlan().toString()
    sent = re.search(r"ArrowEvalPython \[run\((.*?)\)#", plan)[1]
    assert sent.startswith("CASE WHEN RLIKE(") and sent.endswith("END") or re.search(r"Project .*CASE WHEN RLIKE\(", plan)


def test_detector_switches_are_heeded(spark):
    rows = spark.createDataFrame([("j&#97;ne&#64;example.org and bob@example.org",)], "text string")
    found = lambda **on: [d.matched_text for d in queries.detected(rows, "text", replace(P.MASK_ALL, detectors=P.MASK_ALL.detectors | on), {"opf": model}).first().detections if d.category in ("email", "private_name")]
    model = detect.privacy_model(lambda text: F.array(F.struct(F.lit("private_name").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit(0.9).alias("score"))))
    assert found() == ["j&#97;ne&#64;example.org", "bob@example.org"] and found(normalization=False) == ["bob@example.org"]
    assert found(regex=False, opf=True) == ["j&#97;ne"]
    with pytest.raises(ValueError, match="no detector"):
        found(regex=False)
    with pytest.raises(RuntimeError, match="presidio"):
        found(presidio=True)
    with pytest.raises(RuntimeError, match="opf, presidio"):
        queries.detected(rows, "text", P.DEFAULT)


def plain_detections(text):
    """Normalise, match, drop overlaps in a category, map back."""
    t, _ = normalize.normalize(text)
    out = []
    for c in CATEGORIES:
        hits = [(m.start(), -m.end(), -p.confidence, k, p.detector) for k, p in enumerate(PATTERNS) if p.category == c for m in re.finditer(p.regex, t.text)]
        last = 0
        for s, e, _, _, name in sorted(hits):
            if s >= last:
                last = -e
                out.append((name, int(t.start[s]), int(t.end[last - 1]), text[t.start[s] : t.end[last - 1]]))
    return sorted(out)


def test_pages_are_searched_for_every_pattern(spark, tmp_path):
    rows = [(2 * k, x) for k, x in enumerate(POSITIVE.values())] + [(2 * k + 1, f"<p>{base64.b64encode(x.encode()).decode()}</p>") for k, x in enumerate(POSITIVE.values())]
    rows += [(100, f"<p>{urllib.parse.quote('postgres://u:p@h:5432/db', safe='')}</p>"), (101, "".join(f"&#{ord(c)};" for c in POSITIVE["aws_access_key_id"]))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got: dict[int, list] = {}
    for r in queries.normalized_detections(spark, str(tmp_path)).collect():
        got.setdefault(r.page_id, []).append((r.detector, r.start, r.end, r.matched_text))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, x in rows if (v := plain_detections(x))}
    assert {d for v in got.values() for d, *_ in v} == {p.detector for p in PATTERNS}
    raw = {r.detector for r in queries.detect_pages(spark, str(tmp_path)).collect()}
    assert raw == {p.detector for p in PATTERNS}


def test_projection_refuses_spans_outside(spark):
    rows = spark.createDataFrame([("a&amp;b",)], "text string").withColumn("norm", normalize.normalized(F.col("text")))
    pick = lambda a, b: rows.select(*normalize.project(F.col("norm"), F.lit(a), F.lit(b))).first()
    assert tuple(pick(1, 2)) == (1, 6) and tuple(pick(1, 1)) == (1, 1) and tuple(pick(3, 3)) == (7, 7)
    with pytest.raises(Exception, match="outside"):
        pick(2, 4)


# ---- messages ----

BODY = {
    "model": "m", "system": [{"type": "text", "text": "s1"}, {"type": "image"}],
    "messages": [
        {"role": "user", "content": "first"},
        {"role": "user", "content": [{"type": "text", "text": "b1"}, {"type": "tool_result", "content": [{"type": "text", "text": "n1"}, {"x": 1}]}, "odd"]},
        {"role": "assistant", "content": None}, "odd", {"role": "user"},
    ],
    "tools": [{"description": "not read a@b.co"}],
}


def test_bodies_flatten_in_order_and_come_back(spark):
    rows = spark.createDataFrame([("r", json.dumps(BODY)), ("s", '{"system": "top", "messages": []}'), ("n", None), ("x", "no json"), ("e", "{}")], "request_id string, body string")
    flat = messages.flatten(rows)
    got = [(r.request_id, r.segment_no, r.path, r.segment) for r in flat.orderBy("request_id", "segment_no").collect()]
    assert got == [("r", 0, "system[0].text", "s1"), ("r", 1, "messages[0].content", "first"), ("r", 2, "messages[1].content[0].text", "b1"), ("r", 3, "messages[1].content[1].content[0].text", "n1"), ("s", 0, "system", "top")]
    back = messages.rebuild(rows, flat.withColumn("rewritten_text", F.concat(F.lit("<"), "segment", F.lit(">"))))
    new = {r.request_id: r.new_body for r in back.collect()}
    want = json.loads(json.dumps(BODY).replace('"s1"', '"<s1>"').replace('"first"', '"<first>"').replace('"b1"', '"<b1>"').replace('"n1"', '"<n1>"'))
    assert json.loads(new["r"]) == want and new["n"] is None and new["x"] == "no json" and json.loads(new["s"])["system"] == "<top>"


def test_a_lost_string_fails_the_rebuild(spark):
    rows = spark.createDataFrame([("r", json.dumps(BODY))], "request_id string, body string")
    flat = messages.flatten(rows).withColumn("rewritten_text", F.col("segment"))
    for bad in (flat.filter("segment_no <> 1"), flat.limit(0), flat.union(flat.limit(1))):
        with pytest.raises(Exception, match="strings, rewritten are"):
            messages.rebuild(rows, bad).collect()


def test_requests_pass_the_whole_path(spark):
    key = "AKIA" + "B7" * 8
    bodies = {
        "block": {"system": "mail a@b.org", "messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": f"key {base64.b64encode(f'the key {key}'.encode()).decode()}"}]}]}]},
        "mask": {"model": "m", "system": [{"type": "text", "text": "to j&#97;ne&#64;example.org"}], "messages": [{"role": "user", "content": "host h.example.org and h.example.org"}, {"role": "user", "content": [{"type": "image", "source": 1}, {"type": "text", "text": "plain"}]}]},
        "none": {"model": "m"},
    }
    rows = spark.createDataFrame([(k, "c1", json.dumps(b)) for k, b in bodies.items()], "request_id string, conversation_id string, body string")
    out = process(rows, P.REGEX_ONLY, b"k")
    got = {r.request_id: r for r in out.withColumn("reply", answer(out)).collect()}
    assert got["block"].blocked and json.loads(got["block"].new_body) == bodies["block"] and json.loads(got["block"].reply)["error"]["detail"]["categories"] == ["cloud_api_key"]
    assert key not in got["block"].reply and not got["mask"].blocked and got["mask"].reply is None
    new = json.loads(got["mask"].new_body)
    assert new["system"][0]["text"] == "to [EMAIL_REDACTED]" and new["messages"][1] == bodies["mask"]["messages"][1]
    first, second = re.findall(r"\[DOMAIN_[0-9a-f]{16}\]", new["messages"][0]["content"])
    assert first == second and new["messages"][0]["content"] == f"host {first} and {second}" and new["model"] == "m"
    assert not got["none"].blocked and json.loads(got["none"].new_body) == bodies["none"]
    with pytest.raises(RuntimeError, match="opf, presidio"):
        process(rows, P.DEFAULT, b"k")


def test_requests_are_read_from_json_lines(spark, tmp_path):
    lines = [{"metadata": {"conversation_id": "c9"}, "messages": []}, {"messages": []}, {"metadata": {"conversation_id": ""}}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.json").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    at = F.lit("2024-06-01T00:00:00Z").cast("timestamp")
    got = messages.requests(spark, f"file://{tmp_path}/in", at=at).collect()
    assert all(re.fullmatch(r"pg_1717200000_[0-9a-f]{8}", r.request_id) for r in got) and len({r.request_id for r in got}) == 4
    assert [r.conversation_id == r.request_id for r in got] == [False, True, True, True] and got[0].conversation_id == "c9"
    query = messages.requests(spark, f"file://{tmp_path}/in", stream=True, at=at).writeStream.format("memory").queryName("lines").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("lines").collect())) == sorted(map(tuple, got))


# ---- scoring ----


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, category string, start int, end int, ord int")


def test_greedy_overlap_match(spark):
    gold = spans(spark, [(1, "email", 0, 10, 0), (1, "email", 20, 30, 1), (2, "jwt", 0, 5, 0), (4, "email", 0, 10, 0), (4, "email", 3, 9, 1)])
    pred = spans(spark, [(1, "email", 0, 6, 0), (1, "email", 0, 9, 1), (1, "email", 27, 40, 2), (3, "jwt", 0, 5, 0), (4, "email", 0, 7, 0), (4, "email", 0, 9, 1)])
    got = {(r.doc_id, r.category): (r.tp, r.fp, r.fn) for r in score.match_iou(gold, pred).collect()}
    assert got == {(1, "email"): (1, 2, 1), (2, "jwt"): (0, 0, 1), (3, "jwt"): (0, 1, 0), (4, "email"): (2, 0, 0)}  # the first that fits, not the best
    got = {(r.doc_id, r.category): (r.tp, r.fp, r.fn) for r in score.match_overlap(gold, pred).collect()}
    assert got == {(1, "email"): (3, 0, 0), (2, "jwt"): (0, 0, 1), (3, "jwt"): (0, 1, 0), (4, "email"): (2, 0, 0)}
    m = {r.category: (r.precision, r.recall, r.f1) for r in score.metrics(score.match_iou(gold, pred)).collect()}
    assert m["jwt"] == (0.0, 0.0, 0.0) and m["email"] == (pytest.approx(3 / 5), 0.75, pytest.approx(2 / 3))
    assert [r.category for r in score.listing(pred).collect()] == ["email", "jwt"] and score.in_scope(pred, {"jwt"}).count() == 1 and score.in_scope(pred, None).count() == 6


def test_nearest_rank_summary(spark):
    values = random.Random(1).choices(range(1000), k=101)
    r = score.summary(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v").first()
    ordered = sorted(values)
    assert (r.n, r.p50, r.p95, r.p99) == (101, ordered[50], ordered[95], ordered[99]) and r["mean"] == pytest.approx(sum(values) / 101)


def test_leak_checks(spark):
    rows = spark.createDataFrame([("secret value 12", "ok secret no"), ("      ------", "has       here"), ("abc", "abc"), ("", "x")], "o string, e string")
    assert [r[0] for r in rows.select(score.echoes(F.col("e"), F.col("o"))).collect()] == [True, False, False, False]
    one = spark.createDataFrame([({"Authorization": "Bearer abcd1234", "X-Api-Key": "ab", "accept": "x"},)], "h map<string,string>")
    assert one.select(score.redact_headers(F.col("h")).alias("h")).first().h == {"Authorization": "<redacted last 4: 1234>", "X-Api-Key": "<redacted last 4: ?>", "accept": "x"}


def test_suspicious_counts(spark):
    rows = [("10.999.1.1 192.168.300.400 172.31.1.2", {"raw_ipv4_rfc1918": 1}), ("-----BEGIN PGP PRIVATE KEY BLOCK-----", {"raw_pem_marker": 1}), ("a@b.co, AKIA" + "A1" * 8, {"raw_email": 1, "raw_aws_access_key": 1}), ("", {})]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "k int, t string").select("k", score.suspicious_counts(F.col("t")).alias("m")).collect()
    assert {r.k: r.m for r in got} == {k: m for k, (_, m) in enumerate(rows)}


# ---- corpora ----


def test_corpora(spark, tmp_path):
    lines = [
        {"id": "1", "source_text": "mail a@b.co at 10.1.2.3", "language": "English", "privacy_mask": [{"label": "EMAIL", "start": 5, "end": 11, "value": "a@b.co"}, {"label": "IP", "start": 15, "end": 23, "value": "10.1.2.3"}, {"label": "IP", "start": 0, "end": 4, "value": "8.8.8.8"}, {"label": "SEX", "start": 0, "end": 1, "value": "m"}]},
        {"id": "2", "source_text": "none", "language": "English", "privacy_mask": []},
        {"id": "3", "source_text": "autre", "language": "French", "privacy_mask": []},
    ]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.record_id: [(s.category, s.start, s.end) for s in r.spans] for r in privacy_corpus(spark, f"file://{tmp_path}/p.json").collect()}
    assert got == {"1": [("email", 5, 11), ("internal_ip", 15, 23)], "2": []}
    assert privacy_corpus(spark, f"file://{tmp_path}/p.json", limit=1).count() == 1
    (tmp_path / "s.csv").write_text('Issue,text,candidate_string,label,source\n7,"my key\nis abc",abc,1,s\n8,x,x,0,s\n9,x,x,bad,s\n9,x,x,1.0,s\n1,y no,z, 1 ,s\n')
    got = [(r.text, [(s.start, s.end) for s in r.spans]) for r in secrets_corpus(spark, f"file://{tmp_path}/s.csv").collect()]
    assert got == [("my key\nis abc", [(10, 13)]), ("x", []), ("y no", [])]
    first = secrets_corpus(spark, f"file://{tmp_path}/s.csv", limit=2)
    assert [r.text for r in first.collect()] == ["my key\nis abc", "x"] and first.columns == ["record_id", "text", "spans"]
    assert tuple(score.corpus_stats(first).first()) == (2, 1, 1)
    made = synthetic(spark).collect()
    assert len(made) == 220 and sum(not r.spans for r in made) == 60
    assert made == synthetic(spark).collect()
    pieces = chunks(spark.createDataFrame([(1, "abcdefghi"), (2, ""), (3, None)], "id int, text string")).orderBy("id", "seq").collect()
    assert [r.chunk for r in pieces] == ["abcd", "efgh", "i"]
    write_capture(spark.createDataFrame([({"authorization": "secret-token-9876"}, {"X-API-Key": "k-4321"}, "b")], "request map<string,string>, response map<string,string>, body string"), f"file://{tmp_path}/cap")
    sent = spark.read.json(f"file://{tmp_path}/cap").first()
    assert sent.request.authorization == "<redacted last 4: 9876>" and sent.response["X-API-Key"] == "<redacted last 4: 4321>" and sent.body == "b"
    write_results(score.metrics(score.match_overlap(*(spans(spark, [(1, "email", 0, 5, 0)]),) * 2)), f"file://{tmp_path}/results")
    assert spark.read.json(f"file://{tmp_path}/results").first().f1 == 1.0
    assert markdown([{"a": 1, "b": 2}]) == "| a | b |\n| --- | --- |\n| 1 | 2 |\n" and markdown([]) == ""


def test_synthetic_corpus_is_found(spark):
    corpus = synthetic(spark).withColumnRenamed("record_id", "doc_id")
    gold = corpus.select("doc_id", F.posexplode("spans").alias("ord", "s")).select("doc_id", "s.category", "s.start", "s.end", "ord")
    pred = corpus.select("doc_id", F.posexplode(detect.detect(F.col("text"))).alias("ord", "d")).select("doc_id", "d.category", "d.start", "d.end", "ord")
    got = {r.category: r.f1 for r in score.metrics(score.match_overlap(gold, pred), 3).collect()}
    assert all(got[c] == 1.0 for c in ("cloud_api_key", "database_url", "internal_ip", "jwt", "private_key", "secret"))
