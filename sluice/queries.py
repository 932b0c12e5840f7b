"""The library's queries over the driver's tables, and their DuckDB SQL.

INJECTED adds to every document one made secret or address, chosen by its id, because the documents hold few. It is one
text that Spark and DuckDB both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions.catalogue import BASELINE, PATTERNS, TOKEN, Pattern
from sluice.operators import detect, messages, normalize, rewrite, score, tokens
from sluice.plans import policy as P
from sluice.plans.engine import detected, normalised_rows, process
from sluice.sources.corpora import pieces, synthetic
from sluice.streaming import restore as streaming

KEY, NOW, HASH = b"an example key", "2024-06-01T00:00:00Z", "sha256:unknown"
_ID = "CAST(doc_id AS STRING)"
_H = lambda salt, n: f"substr(md5(concat('{salt}', {_ID})), 1, {n})"
MADE = f"""CASE CAST(doc_id % 20 AS INT)
 WHEN 0 THEN concat('key AKIA', upper({_H('a', 16)}), ' used')
 WHEN 1 THEN concat('at 10.', CAST(doc_id % 250 AS STRING), '.7.', CAST(doc_id % 9 AS STRING), ' now')
 WHEN 2 THEN concat('db postgresql://u', {_H('b', 5)}, ':p', {_H('c', 9)}, '@db.corp:5432/app end')
 WHEN 3 THEN concat('jwt eyJ', {_H('d', 20)}, '.eyJ', {_H('e', 22)}, '.', {_H('f', 24)}, ' end')
 WHEN 4 THEN '-----BEGIN RSA PRIVATE KEY-----'
 WHEN 5 THEN concat('pat ghp_', {_H('g', 32)}, {_H('h', 8)}, ' end')
 WHEN 6 THEN concat('mail ', {_H('i', 8)}, '@mail.example.com please')
 WHEN 7 THEN concat('see host', {_H('j', 6)}, '.example.org and 192.168.', CAST(doc_id % 200 AS STRING), '.1 ok')
 WHEN 8 THEN concat('xoxb-', {_H('k', 20)}, ' slack')
 WHEN 9 THEN concat('AIza', {_H('l', 32)}, 'abc gcp')
 WHEN 10 THEN concat('redis://:', {_H('m', 9)}, '@cache.local:6379/0 end')
 WHEN 11 THEN concat('DefaultEndpointsProtocol=https;AccountName=acc', CAST(doc_id AS STRING), ';AccountKey=', {_H('n', 32)}, {_H('o', 12)}, ';EndpointSuffix=core.example end')
 WHEN 12 THEN concat('write to ', {_H('p', 6)}, '@sub.example.co.uk or 172.16.', CAST(doc_id % 99 AS STRING), '.4 end')
 WHEN 13 THEN concat('mysql://root:', {_H('q', 8)}, '@10.1.2.3/db end')
 WHEN 14 THEN concat('mongodb+srv://u:', {_H('r', 8)}, '@cluster.example.net/x end')
 WHEN 15 THEN concat('aws secret = ', {_H('s', 32)}, {_H('t', 8)}, ' end')
 WHEN 16 THEN concat('"type": "service_account", "id": ', CAST(doc_id AS STRING), ', "private_key": x')
 WHEN 17 THEN concat('github_pat_', {_H('u', 32)}, {_H('v', 32)}, {_H('w', 32)}, ' end')
 WHEN 18 THEN concat('id abcQ-AKIA', upper({_H('x', 16)}), '-', {_H('y', 10)}, ' end')
 ELSE 'nothing' END"""
INJECTED = f"SELECT doc_id, lang, length(text) AS n, concat(text, ' ', {MADE}) AS text FROM documents"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.length("text").alias("n"), F.concat("text", F.lit(" "), F.expr(MADE)).alias("text"))


def _rows(df: DataFrame, found, *keys: str) -> DataFrame:
    d = F.explode(found).alias("d")
    names = ("category", "detector", "start", "end", "matched_text", "confidence")
    return df.select(*keys, d).select(*keys, *[F.col(f"d.{n}").alias(n) for n in names])


# ---- SQL building blocks ----


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_matches(source: str, patterns: tuple[Pattern, ...] = PATTERNS, key: str = "doc_id", text: str = "text") -> str:
    """Rows key, category, detector, start, end, matched_text, confidence, ord of every match."""
    parts = []
    for k, p in enumerate(patterns):
        q = _quote(p.sql)
        parts.append(
            f"SELECT {key}, '{p.category}' AS category, '{p.detector}' AS detector,"
            f" CAST(list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS INT) AS start,"
            f" hits[k] AS matched_text, CAST({p.confidence} AS DOUBLE) AS confidence, {k} AS ord"
            f" FROM (SELECT {key}, gaps, hits, unnest(range(1, len(hits) + 1)) AS k FROM"
            f" (SELECT {key}, regexp_extract_all({text}, {q}) AS hits, string_split_regex({text}, {q}) AS gaps FROM ({source}) WHERE regexp_matches({text}, {q})))"
        )
    return "SELECT *, start + CAST(length(matched_text) AS INT) AS \"end\" FROM (" + " UNION ALL ".join(parts) + ")"


def sql_deduped(source: str, patterns: tuple[Pattern, ...] = PATTERNS) -> str:
    """The detections that stay within their category, greedily by start."""
    return f"""SELECT doc_id, unnest(kept, recursive := true) FROM (
 SELECT doc_id, list_reduce(list_transform(sorted, lambda d: {{'last': d.e, 'kept': [d.v]}}),
   lambda a, x: CASE WHEN x.kept[1].start >= a.last THEN {{'last': x.last, 'kept': list_concat(a.kept, x.kept)}} ELSE a END).kept AS kept FROM (
  SELECT doc_id, category, list({{'e': "end", 'v': {{'category': category, 'detector': detector, 'start': start, 'end': "end", 'matched_text': matched_text, 'confidence': confidence, 'ord': ord}}}}
   ORDER BY start, start - "end", -confidence, ord) AS sorted FROM ({sql_matches(source, patterns)}) GROUP BY doc_id, category))"""


def sql_rules(policy: P.Policy) -> str:
    flag = lambda v: "NULL" if v is None else str(v).upper()
    rows = ", ".join(f"({k}, '{r.category}', '{r.action}', {r.min_confidence}, CAST({flag(r.audit_only)} AS BOOLEAN))" for k, r in enumerate(policy.rules))
    return f"(VALUES {rows}) AS r(ordinal, rule_category, rule_action, floor, rule_audit)"


def sql_decided(source: str, policy: P.Policy, deduped: str | None = None) -> str:
    """Detections with the first fitting rule's action and audit flag; ALLOW where none fits."""
    return f"""SELECT d.*, coalesce(m.m.action, 'ALLOW') AS action, coalesce(m.m.audit, {str(policy.audit_only).upper()}) AS audit
 FROM ({deduped or sql_deduped(source)}) d LEFT JOIN (
  SELECT doc_id, start, detector, arg_min({{'action': rule_action, 'audit': coalesce(rule_audit, {str(policy.audit_only).upper()})}}, ordinal) AS m
  FROM ({deduped or sql_deduped(source)}) JOIN {sql_rules(policy)} ON rule_category = category AND confidence >= floor GROUP BY doc_id, start, detector) m
 ON d.doc_id = m.doc_id AND d.start = m.start AND d.detector = m.detector"""


def _blob(raw: bytes) -> str:
    return f"unhex('{raw.hex()}')"


def sql_token(category: str, original: str, conversation: str, epoch: str = "0") -> str:
    inner, outer = tokens.key_blocks(KEY)
    field = lambda x: f"CAST(octet_length(encode({x})) AS STRING) || ':' || {x}"
    message = " || ".join(field(x) for x in (f"'{epoch}'", f"CAST({conversation} AS STRING)", category, original))
    return f"'[' || upper({category}) || '_' || substr(sha256({_blob(outer)} || unhex(sha256({_blob(inner)} || encode({message})))), 1, 16) || ']'"


def sql_spans(source: str, policy: P.Policy, conversation: str = "doc_id") -> str:
    """CTEs: decided, flags (doc_id, blocked), kept (doc_id, kept: the longest-first disjoint spans with r, what replaces
    them)."""
    replacement = f"CASE WHEN action = 'MASK' THEN '[' || upper(category) || '_REDACTED]' ELSE {sql_token('category', 'matched_text', conversation)} END"
    return f"""decided AS MATERIALIZED ({sql_decided(source, policy)}),
 flags AS (SELECT doc_id, bool_or(action = 'BLOCK' AND NOT audit) AS blocked FROM decided GROUP BY doc_id),
 kept AS (SELECT doc_id, list_sort(list_reduce(list_transform(sorted, lambda d: [d]), lambda a, x:
   CASE WHEN len(list_filter(a, lambda k: x[1].start < k."end" AND k.start < x[1]."end")) > 0 THEN a ELSE list_concat(a, x) END)) AS kept FROM (
   SELECT doc_id, list({{'start': start, 'end': "end", 'r': {replacement}, 'category': category, 'detector': detector, 'action': action, 'confidence': confidence}} ORDER BY start - "end", -confidence, action = 'TOKENIZE', start, "end", ord) AS sorted
   FROM decided WHERE action IN ('MASK', 'TOKENIZE') AND NOT audit GROUP BY doc_id))"""


def sql_rewritten(source: str, policy: P.Policy, conversation: str = "doc_id") -> str:
    """doc_id, blocked, rewritten_text: longest-first disjoint spans replaced, unless the text is blocked."""
    return f"""WITH {sql_spans(source, policy, conversation)},
 pieces AS (SELECT s.doc_id, list_transform(range(1, len(kept) + 1), lambda i:
   substr(s.text, CASE WHEN i = 1 THEN 0 ELSE kept[i - 1]."end" END + 1, kept[i].start - CASE WHEN i = 1 THEN 0 ELSE kept[i - 1]."end" END) || kept[i].r) AS p, kept[len(kept)]."end" AS last
   FROM ({source}) s JOIN kept USING (doc_id))
 SELECT s.doc_id, coalesce(f.blocked, FALSE) AS blocked,
  CASE WHEN coalesce(f.blocked, FALSE) OR p.p IS NULL THEN s.text ELSE array_to_string(p.p, '') || substr(s.text, p.last + 1) END AS rewritten_text
 FROM ({source}) s LEFT JOIN flags f USING (doc_id) LEFT JOIN pieces p USING (doc_id)"""


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_COLUMNS = 'doc_id, category, detector, start, "end", matched_text, confidence'
_REGEX = P.REGEX_ONLY


@query(f"SELECT {_COLUMNS} FROM ({sql_matches(INJECTED)})")
def detect_all(spark, sf_dir):
    docs = injected(spark, sf_dir)
    return _rows(docs, detect.detect(F.col("text"), dedupe=False), "doc_id")


@query(f"SELECT {_COLUMNS} FROM ({sql_deduped(INJECTED)})")
def detect_deduped(spark, sf_dir):
    docs = injected(spark, sf_dir)
    return _rows(docs, detect.detect(F.col("text")), "doc_id")


@query(f"SELECT {_COLUMNS} FROM ({sql_matches('SELECT doc_id, text FROM documents', BASELINE)})")
def detect_baseline(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return _rows(docs, detect.detect(F.col("text"), BASELINE, dedupe=False), "doc_id")


@query(f"SELECT {_COLUMNS.replace('doc_id', 'page_id')} FROM ({sql_matches('SELECT page_id, html FROM pages', PATTERNS, 'page_id', 'html')})")
def detect_pages(spark, sf_dir):
    return _rows(read(spark, sf_dir, "pages"), detect.detect(F.col("html"), dedupe=False), "page_id")


@query(f"SELECT lang, category, count(*) AS n_detections, count(DISTINCT doc_id) AS n_documents FROM ({sql_deduped(INJECTED)}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang, category")
def detection_counts(spark, sf_dir):
    found = _rows(injected(spark, sf_dir), detect.detect(F.col("text")), "doc_id", "lang")
    return found.groupBy("lang", "category").agg(F.count("*").alias("n_detections"), F.countDistinct("doc_id").alias("n_documents"))


def decided(spark, sf_dir, policy):
    return detected(injected(spark, sf_dir), "text", policy)


_POLICIES = (P.REGEX_ONLY, P.FLOORS, P.AUDIT_ALL)


@query(" UNION ALL ".join(f"SELECT doc_id, '{p.name}' AS policy, category, detector, start, action, audit FROM ({sql_decided(INJECTED, p)})" for p in _POLICIES))
def policy_actions(spark, sf_dir):
    docs = normalised_rows(injected(spark, sf_dir), "text")
    docs = detect.settle(docs, plain=F.when(F.col("norm").isNull(), F.col("detections")).otherwise(detect.detect(F.col("text"))))
    c, p = F.col("d.category"), F.col("d.confidence")
    both = F.array(*[F.struct(F.lit(on).alias("on"), F.col(n).alias("found")) for on, n in ((True, "detections"), (False, "plain"))])
    rows = docs.select("doc_id", F.explode(both).alias("s")).select("doc_id", "s.on", F.explode("s.found").alias("d"))
    results = [F.struct(F.lit(x.detectors["normalization"]).alias("on"), F.lit(x.name).alias("policy"), x.action(c, p).alias("action"), x.audit(c, p).alias("audit")) for x in _POLICIES]
    out = rows.select("doc_id", "d", F.explode(F.filter(F.array(*results), lambda r: r["on"] == F.col("on"))).alias("r"))
    return out.select("doc_id", "r.policy", "d.category", "d.detector", "d.start", "r.action", "r.audit")


@query(f"SELECT doc_id, blocked, rewritten_text FROM ({sql_rewritten(INJECTED, P.REGEX_ONLY)})")
def engine_default(spark, sf_dir):
    docs = tokens.with_key(decided(spark, sf_dir, _REGEX), spark, KEY)
    return rewrite.apply(docs, _REGEX, token=lambda c, t: tokens.token(c, t, F.col("doc_id"))).select("doc_id", "blocked", "rewritten_text")


@query(f"SELECT doc_id, blocked, rewritten_text FROM ({sql_rewritten(INJECTED, P.MASK_ALL)})")
def engine_mask(spark, sf_dir):
    return rewrite.apply(decided(spark, sf_dir, P.MASK_ALL), P.MASK_ALL).select("doc_id", "blocked", "rewritten_text")


@query(f"SELECT doc_id, blocked, rewritten_text FROM ({sql_rewritten(INJECTED, P.TOKENIZE_ALL)})")
def engine_tokenize(spark, sf_dir):
    docs = tokens.with_key(decided(spark, sf_dir, P.TOKENIZE_ALL), spark, KEY)
    return rewrite.apply(docs, P.TOKENIZE_ALL, token=lambda c, t: tokens.token(c, t, F.col("doc_id"))).select("doc_id", "blocked", "rewritten_text")


@query(f"""SELECT doc_id, count(*) AS violation_count, string_agg(DISTINCT category, ',' ORDER BY category) AS categories,
 string_agg(DISTINCT detector, ',' ORDER BY detector) AS detectors FROM ({sql_decided(INJECTED, P.REGEX_ONLY)}) WHERE action = 'BLOCK' AND NOT audit GROUP BY doc_id""")
def blocked_documents(spark, sf_dir):
    rows = rewrite.apply(decided(spark, sf_dir, _REGEX), _REGEX).filter("blocked")
    names = lambda n: F.array_join(F.sort_array(F.array_distinct(F.transform("violations", lambda v: v[n]))), ",")
    return rows.select("doc_id", F.size("violations").cast("long").alias("violation_count"), names("category").alias("categories"), names("detector").alias("detectors"))


_ENVELOPE = """'{"error":{"code":"policy_violation","detail":{"categories":[' || cs || '],"detectors":[' || ds || '],"policy_name":"regex-only","policy_version":"1","request_id":"req_' || doc_id
 || '","violation_count":' || n || ',"violations":[' || vs || ']},"message":"Blocked by policy \'\'regex-only\'\' v1: ' || n || CASE WHEN n = 1 THEN ' violation in ' ELSE ' violations in ' END
 || nc || CASE WHEN nc = 1 THEN ' category: ' ELSE ' categories: ' END || plain || '. Request req_' || doc_id || '; its text is not repeated here.","param":null,"type":"invalid_request_error"},"type":"error"}'"""
_CUT = lambda x: f"CAST(round_even({x}, 2) AS VARCHAR)"


@query(f"""SELECT doc_id, {_ENVELOPE} AS envelope FROM (SELECT doc_id, count(*) AS n, count(DISTINCT category) AS nc, string_agg(DISTINCT '"' || category || '"', ',' ORDER BY '"' || category || '"') AS cs,
 string_agg(DISTINCT category, ', ' ORDER BY category) AS plain, string_agg(DISTINCT '"' || detector || '"', ',' ORDER BY '"' || detector || '"') AS ds,
 string_agg('{{"category":"' || category || '","confidence":' || {_CUT('confidence')} || ',"detector":"' || detector || '"}}', ',' ORDER BY start, "end", ord) AS vs
 FROM ({sql_decided(INJECTED, P.REGEX_ONLY)}) WHERE action = 'BLOCK' AND NOT audit GROUP BY doc_id)""")
def block_envelopes(spark, sf_dir):
    rows = rewrite.apply(decided(spark, sf_dir, _REGEX), _REGEX).filter("blocked")
    rows = rows.withColumn("request_id", F.concat(F.lit("req_"), F.col("doc_id").cast("string")))
    return rows.select("doc_id", rewrite.envelope(rows).alias("envelope"))


_AUDITED = 'doc_id, category, detector, action, start, "end", confidence'


@query(f"""WITH {sql_spans(INJECTED, P.REGEX_ONLY)} SELECT {_AUDITED}, '' AS replacement FROM decided WHERE action = 'BLOCK' AND NOT audit
 UNION ALL SELECT doc_id, x.category, x.detector, x.action, x.start, x."end", x.confidence, x.r FROM (SELECT doc_id, unnest(kept) AS x FROM kept JOIN flags USING (doc_id) WHERE NOT blocked)
 UNION ALL SELECT {_AUDITED}, '' FROM decided WHERE audit AND action <> 'ALLOW'""")
def result_audit(spark, sf_dir):
    """What was done to every document: enforced blocks, or what was rewritten and how, and what rules only audit."""
    docs = tokens.with_key(decided(spark, sf_dir, _REGEX), spark, KEY)
    rows = rewrite.apply(docs, _REGEX, token=lambda c, t: tokens.token(c, t, F.col("doc_id"))).select("doc_id", F.explode("audit").alias("a"))
    return rows.select("doc_id", *[F.col(f"a.{n}").alias(n) for n in ("category", "detector", "action", "start", "end", "confidence", "replacement")])


@query(f"""SELECT CAST(doc_id AS STRING) AS request_id, category || ' -> ' || action AS rule, detector, category, start AS "offset", "end" - start AS length,
 action AS would_have_been_action, round(confidence, 4) AS confidence FROM ({sql_decided(INJECTED, P.AUDIT_ALL)}) WHERE audit AND action <> 'ALLOW'""")
def audit_events(spark, sf_dir):
    rows = rewrite.apply(decided(spark, sf_dir, P.AUDIT_ALL), P.AUDIT_ALL).withColumn("request_id", F.col("doc_id").cast("string"))
    out = rewrite.audit_events(rows, "request_id", "request_id", NOW, HASH)
    return out.select("request_id", "rule", "detector", "category", F.col("span.offset").alias("offset"), F.col("span.length").alias("length"), "would_have_been_action", "confidence")


def _ledger(spark, sf_dir):
    docs = tokens.with_key(decided(spark, sf_dir, P.TOKENIZE_ALL), spark, KEY)
    rows = rewrite.apply(docs, P.TOKENIZE_ALL, token=lambda c, t: tokens.token(c, t, F.col("doc_id")))
    return rows, tokens.ledger(rows, "doc_id", F.lit(NOW).cast("timestamp"))


@query(f"""SELECT DISTINCT doc_id AS conversation_id, {sql_token('category', 'matched_text', 'doc_id')} AS token, category, matched_text AS original
 FROM ({sql_decided(INJECTED, P.TOKENIZE_ALL)}) WHERE action = 'TOKENIZE' AND NOT audit""")
def token_ledger(spark, sf_dir):
    return _ledger(spark, sf_dir)[1].drop("last_access")


@query(f"SELECT doc_id, text AS restored FROM ({INJECTED})")
def restore_roundtrip(spark, sf_dir):
    rows, entries = _ledger(spark, sf_dir)
    sent = rows.select("doc_id", "rewritten_text")
    return tokens.restore(sent, entries, "rewritten_text", "doc_id").select("doc_id", "restored")


def _accesses(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    return events.select(F.col("user_id").alias("conversation_id"), F.col("ts").alias("last_access"), F.col("event_id").cast("string").alias("token"))


@query("""SELECT conversation_id, count(*) AS n FROM (SELECT user_id AS conversation_id FROM events) JOIN
 (SELECT user_id AS conversation_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 100) USING (conversation_id) GROUP BY conversation_id""")
def ledger_most_recent(spark, sf_dir):
    return tokens.most_recent(_accesses(spark, sf_dir)).groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS conversation_id, count(*) AS n FROM events GROUP BY user_id
 HAVING epoch((SELECT max(ts) FROM events)) - epoch(max(ts)) <= 86400""")
def ledger_alive(spark, sf_dir):
    rows = _accesses(spark, sf_dir)
    now = rows.agg(F.max("last_access")).first()[0]
    return tokens.expire(rows, F.lit(now), 86400).groupBy("conversation_id").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, CAST(rank - 1 AS INT) AS segment_no, 'messages[' || CAST(rank - 1 AS STRING) || '].content' AS path, text AS segment
 FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)""")
def conversation_segments(spark, sf_dir):
    bodies = messages.conversation_bodies(read(spark, sf_dir, "conversations"))
    return messages.flatten(bodies).select("conv_id", "segment_no", "path", "segment")


@query("""SELECT conv_id, string_agg(replace(text, 'e', '3'), '|' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id""")
def conversation_rebuild(spark, sf_dir):
    bodies = messages.conversation_bodies(read(spark, sf_dir, "conversations"))
    rows = messages.flatten(bodies).withColumn("rewritten_text", F.replace("segment", F.lit("e"), F.lit("3")))
    back = messages.rebuild(bodies, rows, "conv_id").select("conv_id", messages.segments(F.col("new_body")).alias("s"))
    return back.select("conv_id", F.array_join(F.transform("s", lambda x: x["segment"]), "|").alias("joined"))


_IN_CONVERSATION = MADE.replace("doc_id", "(conv_id + {0})")
_TEXTS = f"""SELECT conv_id, -1 AS pos, 'system[0].text' AS path, {_IN_CONVERSATION.format(0)} AS text FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv_id, pos, 'messages[' || CAST(pos AS STRING) || '].content', text FROM (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)
 UNION ALL SELECT conv_id, pos + k, 'messages[' || CAST(pos AS STRING) || '].content[' || CAST(k AS STRING) || ']' || CASE k WHEN 1 THEN '.content[0]' ELSE '' END || '.text', CASE k WHEN 0 THEN {_IN_CONVERSATION.format(6)} ELSE {_IN_CONVERSATION.format(11)} END
 FROM (SELECT conv_id, count(*) AS pos, unnest([0, 1]) AS k FROM conversations GROUP BY conv_id)"""
_STRINGS = f"SELECT conv_id, path, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS segment_no FROM ({_TEXTS}) WHERE text IS NOT NULL"


def _bodies(spark, sf_dir):
    """A chat body for each conversation: system blocks, its turns, and a message of a text block and a tool's result; the
    blocks hold made secrets."""
    talk = messages.conversation_bodies(read(spark, sf_dir, "conversations"))
    made = lambda k: F.expr(_IN_CONVERSATION.format(k))
    text = lambda k: F.struct(F.lit("text").alias("type"), made(k).alias("text"))
    result = F.struct(F.lit("tool_result").alias("type"), F.array(text(11)).alias("content"))
    last = F.concat(F.lit('{"role":"user","content":['), F.to_json(text(6)), F.lit(","), F.to_json(result), F.lit("]}]}"))
    start = F.concat(F.lit('{"model":"m","system":['), F.to_json(text(0)), F.lit("],"))
    body = F.concat(start, F.expr("substring(body, 2, length(body) - 3)"), F.lit(","), last)
    return talk.select("conv_id", F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("request_id"), body.alias("body"))


@query(f"""WITH strings AS MATERIALIZED ({_STRINGS}), rewritten AS MATERIALIZED ({sql_rewritten('SELECT conv_id * 100000 + segment_no AS doc_id, text FROM strings', P.REGEX_ONLY, 'doc_id // 100000')}),
 whole AS (SELECT doc_id // 100000 AS conv_id, bool_or(blocked) AS request_blocked FROM rewritten GROUP BY 1)
 SELECT conv_id, CAST(segment_no AS INT) AS segment_no, path, request_blocked AS blocked, CASE WHEN request_blocked THEN text ELSE rewritten_text END AS segment
 FROM strings JOIN rewritten ON doc_id = conv_id * 100000 + segment_no JOIN whole USING (conv_id)""")
def request_rewrite(spark, sf_dir):
    """Chat requests through the whole path under the rules of the shipped default policy: every string of the body that goes
    on, in order, and whether the request is blocked."""
    out = process(_bodies(spark, sf_dir), _REGEX, KEY, key="request_id", conversation="conv_id")
    rows = messages.flatten(out.select("conv_id", "blocked", "new_body"), "new_body")
    return rows.select("conv_id", "segment_no", "path", "blocked", "segment")


_GOLD_KIND = {0: "cloud_api_key", 1: "internal_ip", 3: "jwt", 5: "secret", 6: "email", 8: "secret"}
_GOLD_SKIP = {0: 4, 1: 3, 3: 4, 5: 4, 6: 5, 8: 0}
_GOLD_CUT = {0: 5, 1: 4, 3: 4, 5: 4, 6: 7, 8: 6}
_case = lambda table: "CASE CAST(doc_id % 20 AS INT) " + " ".join(f"WHEN {k} THEN {v!r}" for k, v in table.items()) + " END"
_GOLD = f"SELECT doc_id, {_case(_GOLD_KIND)} AS category, CAST(n + 1 + {_case(_GOLD_SKIP)} AS INT) AS start, CAST(length(text) - {_case(_GOLD_CUT)} AS INT) AS \"end\", 0 AS ord FROM ({INJECTED}) WHERE CAST(doc_id % 20 AS INT) IN (0, 1, 3, 5, 6, 8)"
_PRED = sql_deduped(INJECTED)


def _gold_pred(spark, sf_dir):
    docs = injected(spark, sf_dir)
    kind, skip, cut = (F.expr(_case(t)) for t in (_GOLD_KIND, _GOLD_SKIP, _GOLD_CUT))
    gold = docs.select("doc_id", kind.alias("category"), (F.col("n") + 1 + skip).cast("int").alias("start"), (F.length("text") - cut).cast("int").alias("end"), F.lit(0).alias("ord")).filter("category IS NOT NULL")
    found = docs.select("doc_id", F.posexplode(detect.detect(F.col("text"))).alias("ord", "d"))
    return gold, found.select("doc_id", "d.category", "d.start", "d.end", "ord")


_METRICS = """SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM (SELECT category, tp, fp, fn,
 CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM {0})"""
_IOU = 'greatest(0, least(g."end", p."end") - greatest(g.start, p.start)) / (greatest(g."end", p."end") - least(g.start, p.start))'


@query(f"""WITH gold AS ({_GOLD}), pred AS ({_PRED}), hits AS (SELECT category, count(*) AS tp FROM (SELECT DISTINCT g.doc_id, g.category FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.category = p.category WHERE {_IOU} >= 0.5) GROUP BY category)
 {_METRICS.format("""(SELECT category, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(np, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(ng, 0) - coalesce(tp, 0) AS BIGINT) AS fn
 FROM (SELECT category, count(*) AS ng FROM gold GROUP BY category) FULL JOIN (SELECT category, count(*) AS np FROM pred GROUP BY category) USING (category) LEFT JOIN hits USING (category))""")}""")
def score_iou(spark, sf_dir):
    return score.metrics(score.match_iou(*_gold_pred(spark, sf_dir)))


@query(f"""WITH gold AS ({_GOLD}), pred AS ({_PRED}), pairs AS (SELECT g.doc_id, g.category, p.start AS ps, p.detector FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.category = p.category AND p.start < g."end" AND g.start < p."end")
 {_METRICS.format("""(SELECT category, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(np, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(ng, 0) - coalesce(hit, 0) AS BIGINT) AS fn
 FROM (SELECT category, count(*) AS ng FROM gold GROUP BY category) FULL JOIN (SELECT category, count(*) AS np FROM pred GROUP BY category) USING (category)
 LEFT JOIN (SELECT category, count(DISTINCT (doc_id, ps, detector)) AS tp, count(DISTINCT doc_id) AS hit FROM pairs GROUP BY category) USING (category))""")}""")
def score_overlap(spark, sf_dir):
    return score.metrics(score.match_overlap(*_gold_pred(spark, sf_dir)))


_SPANS = lambda start, end, n: f"SELECT doc_id, 'email' AS category, k AS ord, CAST({start} AS INT) AS start, CAST({start} + 4 + {end} AS INT) AS \"end\" FROM (SELECT doc_id, unnest(range({n})) AS k FROM documents)"
_MANY_GOLD = ("(doc_id * 7 + k * 5) % 23", "(doc_id + k * 3) % 9", 4)
_MANY_PRED = ("(doc_id * 5 + k * 6) % 23", "(doc_id * 2 + k) % 9", 5)
_MEET = '(least(x.g[1]."end", p[k]."end") - greatest(x.g[1].start, p[k].start)) / (greatest(x.g[1]."end", p[k]."end") - least(x.g[1].start, p[k].start)) >= 0.5'


@query(f"""WITH spans AS (SELECT doc_id, g, p FROM (SELECT doc_id, list({{'start': start, 'end': "end"}} ORDER BY ord) AS g FROM ({_SPANS(*_MANY_GOLD)}) GROUP BY doc_id)
  JOIN (SELECT doc_id, list({{'start': start, 'end': "end"}} ORDER BY ord) AS p FROM ({_SPANS(*_MANY_PRED)}) GROUP BY doc_id) USING (doc_id)),
 hits AS (SELECT doc_id, len(list_reduce(list_concat([{{'g': g[1:0], 'used': CAST([] AS BIGINT[])}}], list_transform(g, lambda y: {{'g': [y], 'used': CAST([] AS BIGINT[])}})),
  lambda a, x: {{'g': x.g, 'used': list_concat(a.used, list_filter(range(1, len(p) + 1), lambda k: NOT list_contains(a.used, k) AND {_MEET})[1:1])}}).used) AS tp FROM spans)
 {_METRICS.format("(SELECT 'email' AS category, CAST(sum(tp) AS BIGINT) AS tp, CAST(5 * count(*) - sum(tp) AS BIGINT) AS fp, CAST(4 * count(*) - sum(tp) AS BIGINT) AS fn FROM hits)")}""")
def score_greedy(spark, sf_dir):
    """Several gold and predicted spans in every document, where the order of the greedy choice decides."""
    docs = read(spark, sf_dir, "documents").select("doc_id")

    def made(start: str, end: str, n: int) -> DataFrame:
        rows = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
        at = F.expr(start)
        return rows.select("doc_id", F.lit("email").alias("category"), F.col("k").alias("ord"), at.cast("int").alias("start"), (at + 4 + F.expr(end)).cast("int").alias("end"))

    return score.metrics(score.match_iou(made(*_MANY_GOLD), made(*_MANY_PRED)))


def _quantiles_sql(table, column):
    pick = lambda q: f"max(CASE WHEN k = CAST(round_even((n - 1) * {q}, 0) AS BIGINT) THEN v END)"
    return f"SELECT n, round(avg(v), 2) AS mean, {pick(0.5)} AS p50, {pick(0.95)} AS p95, {pick(0.99)} AS p99 FROM (SELECT {column} AS v, row_number() OVER (ORDER BY {column}) - 1 AS k, count(*) OVER () AS n FROM {table} WHERE {column} IS NOT NULL) GROUP BY n"


@query(_quantiles_sql("lineitem", "l_extendedprice"))
def latency_summary(spark, sf_dir):
    return score.summary(read(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("mean", F.round("mean", 2))


@query(rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '\b(?:10\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)|172\.(?:1[6-9]|2\d|3[01])\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d)|192\.168\.(?:25[0-5]|2[0-4]\d|1?\d?\d)\.(?:25[0-5]|2[0-4]\d|1?\d?\d))\b')) AS INT) AS n_raw_ipv4_rfc1918,
 CAST(len(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b')) AS INT) AS n_raw_email, CAST(len(regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY[A-Z ]*-----')) AS INT) AS n_raw_pem_marker,
 CAST(len(regexp_extract_all(text, '\b(AKIA|ASIA)[0-9A-Z]{{16}}\b')) AS INT) AS n_raw_aws_access_key FROM ({INJECTED})""")
def suspicious_counts(spark, sf_dir):
    docs = injected(spark, sf_dir).withColumn("m", score.suspicious_counts(F.col("text")))
    return docs.select("doc_id", *[F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)).alias(f"n_{k}") for k in score.SUSPICIOUS])


@query(f"""WITH sent AS ({sql_rewritten(INJECTED, P.MASK_ALL)}) SELECT s.doc_id, contains(rewritten_text, 'made') OR NOT regexp_matches(rewritten_text, '\\[[A-Z_]+_REDACTED\\]') AS leaked FROM sent s""")
def leak_check(spark, sf_dir):
    """Whether a rewritten text still holds any of its own originals, or has no mask."""
    rows = rewrite.apply(decided(spark, sf_dir, P.MASK_ALL), P.MASK_ALL)
    originals, sent, shape = F.filter("decided", lambda d: ~d["audit"]), F.col("rewritten_text"), r"\[[A-Z_]+_REDACTED\]"
    held = F.exists(originals, lambda d: score.leaks(sent, d["matched_text"], shape))
    return rows.select("doc_id", (held | ~sent.rlike(shape)).alias("leaked"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '&(?:#x?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);')) AS INT) AS n_entities,
 CAST(len(regexp_extract_all(html, '(?:%[0-9a-fA-F]{2})+')) AS INT) AS n_percent, CAST(len(list_filter(regexp_extract_all(html, '[A-Za-z0-9+/]+'), lambda x: length(x) >= 16)) AS INT) AS n_base64 FROM pages""")
def encoded_candidates(spark, sf_dir):
    html = F.col("html")
    runs = F.size(F.filter(F.regexp_extract_all(html, F.lit("[A-Za-z0-9+/]+"), F.lit(0)), lambda x: F.length(x) >= 16))
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit(normalize.ENTITY.pattern)).alias("n_entities"), F.regexp_count(html, F.lit(normalize.PERCENT.pattern)).alias("n_percent"), runs.alias("n_base64"))


@query()
def normalized_detections(spark, sf_dir):
    return _rows(normalised_rows(read(spark, sf_dir, "pages"), "html"), F.col("detections"), "page_id")


@query("SELECT page_id, replace(replace(replace(replace(html, '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&') AS normalized FROM pages")
def normalized_entities(spark, sf_dir):
    """Pages with one round of entities decoded, nothing else; SQL knows the four kinds that occur."""
    options = normalize.Options(nfkc=False, strip_ignorable=False, url_decode=False, base64=False, rounds=1)
    rows = read(spark, sf_dir, "pages").withColumn("norm", normalize.normalized(F.col("html"), options))
    return rows.select("page_id", F.coalesce("norm.normalized", "html").alias("normalized"))


@query("SELECT page_id, TRUE AS sound FROM pages")
def normalization_keeps_original(spark, sf_dir):
    """Whether every span of a page's map lies in the page, and spans that stand for themselves hold the same signs."""
    rows = read(spark, sf_dir, "pages").withColumn("norm", normalize.normalized(F.col("html")))
    inside = F.forall(F.arrays_zip("norm.os", "norm.oe"), lambda x: (x["os"] >= 0) & (x["os"] < x["oe"]) & (x["oe"] <= F.length("html")))
    own = F.filter(F.transform("norm.kind", lambda k, i: F.struct(k.alias("kind"), i.alias("i"), F.get("norm.os", i).alias("o"))), lambda x: x["kind"] == normalize.IDENTITY)
    same = F.array_join(F.transform(own, lambda x: F.get("norm.signs", x["i"])), "") == F.array_join(F.transform(own, lambda x: F.get("signs", x["o"])), "")
    split = lambda c: F.split(c, "")
    rows = rows.withColumn("signs", split(F.col("html"))).withColumn("norm", F.col("norm").withField("signs", split(F.col("norm.normalized"))))
    return rows.select("page_id", F.coalesce(inside & same, F.lit(True)).alias("sound"))


def _values(policy: P.Policy) -> str:
    return f"SELECT rule_category AS category, CAST(floor AS DOUBLE) AS min_confidence, max_by(rule_action, ordinal) AS action, max_by(coalesce(CAST(rule_audit AS STRING), ''), ordinal) AS audit FROM {sql_rules(policy)} GROUP BY 1, 2"


@query(f"""WITH o AS ({_values(P.REGEX_ONLY)}), n AS ({_values(P.FLOORS)}), b AS (SELECT category, min_confidence, o.action AS oa, n.action AS na, o.audit AS ou, n.audit AS nu FROM o FULL JOIN n USING (category, min_confidence))
 SELECT category, min_confidence, 'added' AS change, oa AS old_action, na AS new_action FROM b WHERE oa IS NULL
 UNION ALL SELECT category, min_confidence, 'removed', oa, na FROM b WHERE na IS NULL
 UNION ALL SELECT category, min_confidence, 'action', oa, na FROM b WHERE oa <> na UNION ALL SELECT category, min_confidence, 'audit_only', oa, na FROM b WHERE ou <> nu""")
def policy_diff(spark, sf_dir):
    out = P.diff(P.rules_frame(spark, P.REGEX_ONLY), P.rules_frame(spark, P.FLOORS))
    return out.select("category", "min_confidence", "change", "old_action", "new_action")


@query("SELECT conv_id, turn, text AS restored FROM conversations")
def chunked_restore(spark, sf_dir):
    """Turns with a made secret behind them, tokenised, cut to 4-sign chunks and restored chunk by chunk under the tokens of
    their conversation. The made part is taken off again if it came back whole; else it stays and the turn differs."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("said"))
    made = F.concat(F.lit(" "), F.expr(MADE))
    turns = turns.withColumn("doc_id", (F.col("conv_id") * 20 + F.col("turn")).cast("long")).withColumn("made", made).drop("doc_id")
    docs = detected(turns.withColumn("text", F.concat("said", "made")), "text", P.TOKENIZE_ALL)
    rows = rewrite.apply(tokens.with_key(docs, spark, KEY), P.TOKENIZE_ALL, token=lambda c, t: tokens.token(c, t, F.col("conv_id")))
    known = tokens.snapshot(tokens.ledger(rows, "conv_id", F.lit(NOW).cast("timestamp"))).select(F.col("conversation_id").alias("conv_id"), "tokens")
    back = rows.select("conv_id", "turn", "made", F.col("rewritten_text").alias("sent")).join(known, "conv_id", "left")
    back = detect.settle(back, chunks=pieces(F.col("sent")))
    back = back.withColumn("whole", streaming.restored_chunks(F.col("chunks"), F.col("tokens")))
    off = F.when(F.endswith("whole", "made"), F.expr("left(whole, length(whole) - length(made))")).otherwise(F.col("whole"))
    return back.select("conv_id", "turn", off.alias("restored"))


_EVENT = """'data: {"delta":{"type":"text_delta","text":' || to_json({0}) || '}}' || chr(10) || chr(10)""".replace("{0}", "%s")


@query(f"""WITH sent AS ({sql_rewritten(INJECTED, P.TOKENIZE_ALL)}) SELECT doc_id, CASE WHEN rewritten_text = text
 THEN array_to_string(list_transform(range(CAST(ceil(length(text) / 4) AS BIGINT)), lambda k: {_EVENT % 'substr(text, 4 * k + 1, 4)'}), '')
 ELSE {_EVENT % 'text'} || repeat({_EVENT % "''"}, CAST(ceil(length(rewritten_text) / 4) AS BIGINT) - 1) END AS sse FROM sent JOIN ({INJECTED}) USING (doc_id)""")
def event_stream_restore(spark, sf_dir):
    """Each tokenised document as a buffered event stream of 4-sign deltas, restored."""
    rows, entries = _ledger(spark, sf_dir)
    known = tokens.snapshot(entries).select(F.col("conversation_id").alias("doc_id"), "tokens")
    event = lambda x: F.concat(F.lit("data: "), F.to_json(F.struct(F.struct(F.lit("text_delta").alias("type"), x.alias("text")).alias("delta"))), F.lit("\n\n"))
    stream = rows.select("doc_id", F.array_join(F.transform(pieces(F.col("rewritten_text")), event), "").alias("sse"))
    return stream.join(known, "doc_id", "left").select("doc_id", streaming.restored_events(F.col("sse").cast("binary"), F.col("tokens")).cast("string").alias("sse"))


_SYNTHETIC = """SELECT doc_id, kind, 'note ' || doc_id || ': ' AS prefix, CASE kind WHEN 'cloud_api_key' THEN 'AKIA' || substr(upper(md5('a' || doc_id)), 1, 16)
 WHEN 'jwt' THEN 'eyJ' || md5('b' || doc_id) || '.eyJ' || md5('c' || doc_id) || '.' || md5('d' || doc_id)
 WHEN 'database_url' THEN 'postgres://u' || substr(md5('e' || doc_id), 1, 6) || ':p' || substr(md5('f' || doc_id), 1, 10) || '@db.example/app'
 WHEN 'internal_ip' THEN '10.' || (doc_id % 250) || '.' || (doc_id * 7 % 250) || '.9' WHEN 'email' THEN 'user' || substr(md5('g' || doc_id), 1, 8) || '@example.org'
 WHEN 'domain' THEN 'host' || substr(md5('h' || doc_id), 1, 8) || '.internal' WHEN 'secret' THEN 'ghp_' || md5('i' || doc_id) || substr(md5('j' || doc_id), 1, 8)
 WHEN 'private_key' THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE 'nothing to see' END AS value FROM (SELECT range AS doc_id, CASE WHEN range < 160 THEN
 ['cloud_api_key', 'jwt', 'database_url', 'internal_ip', 'email', 'domain', 'secret', 'private_key'][range % 8 + 1] END AS kind FROM range(220))"""
_SYNTHETIC_GOLD = f"SELECT doc_id, kind AS category, length(prefix) AS start, length(prefix) + length(value) AS \"end\" FROM ({_SYNTHETIC}) WHERE kind IS NOT NULL"
_SYNTHETIC_PRED = sql_deduped(f"SELECT doc_id, prefix || value || ' end' AS text FROM ({_SYNTHETIC})")


@query(f"""WITH gold AS ({_SYNTHETIC_GOLD}), pred AS ({_SYNTHETIC_PRED}), pairs AS (SELECT g.doc_id, g.category, p.start AS ps, p.detector FROM gold g JOIN pred p ON g.doc_id = p.doc_id AND g.category = p.category AND p.start < g."end" AND g.start < p."end")
 SELECT * REPLACE (round(precision, 3) AS precision, round(recall, 3) AS recall, round(f1, 3) AS f1) FROM ({_METRICS.format("""(SELECT category, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(np, 0) - coalesce(tp, 0) AS BIGINT) AS fp, CAST(coalesce(ng, 0) - coalesce(hit, 0) AS BIGINT) AS fn
 FROM (SELECT category, count(*) AS ng FROM gold GROUP BY category) FULL JOIN (SELECT category, count(*) AS np FROM pred GROUP BY category) USING (category)
 LEFT JOIN (SELECT category, count(DISTINCT (doc_id, ps, detector)) AS tp, count(DISTINCT doc_id) AS hit FROM pairs GROUP BY category) USING (category))""")})""")
def synthetic_scores(spark, sf_dir):
    corpus = synthetic(spark).withColumnRenamed("record_id", "doc_id")
    gold = corpus.select("doc_id", F.posexplode("spans").alias("ord", "s")).select("doc_id", "s.category", "s.start", "s.end", "ord")
    found = corpus.select("doc_id", F.posexplode(detect.detect(F.col("text"))).alias("ord", "d")).select("doc_id", "d.category", "d.start", "d.end", "ord")
    return score.metrics(score.match_overlap(gold, found), 3)


@query(f"SELECT doc_id, regexp_matches(text, {_quote(TOKEN)}) AS has_token, regexp_full_match(text, {_quote(TOKEN)}) AS is_token FROM documents")
def token_shapes(spark, sf_dir):
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", text.rlike(TOKEN).alias("has_token"), text.rlike(f"^{TOKEN}\\z").alias("is_token"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection, decision and rewriting of the documents under the rules of the shipped default policy, by the detectors
    that need no model (DEFAULT itself turns on two models, which are not here, and fails)."""
    docs = detected(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", _REGEX)
    docs = rewrite.apply(tokens.with_key(docs, spark, KEY), _REGEX, token=lambda c, t: tokens.token(c, t, F.col("doc_id")))
    return docs.select("doc_id", "blocked", F.size("detections").alias("n_detections"), "rewritten_text")
