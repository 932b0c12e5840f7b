"""Policy sources, differences, the command line, and restoring streams."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sluice import cli
from sluice.plans import policy as P
from sluice.sources import policies as S
from sluice.streaming import restore as R

TOKEN = "[EMAIL_0123456789abcdef]"
TABLE = {TOKEN: 'jane "x" \\ é@b.co'}


def test_policies_survive_their_yaml(tmp_path):
    for name, policy in P.SHIPPED.items():
        file = tmp_path / f"{name}.yaml"
        file.write_text(S.dump(policy))
        assert S.YamlPolicy(file).load() == policy


@pytest.mark.parametrize(
    "text, wanted",
    [
        ("name: p\nrules:\n  - category: email\n    action: HIDE\n", ["line 4, column 13", "rules.0.action", "'HIDE'"]),
        ("name: p\nextra: 1\n", ["line 2, column 1", "unknown field"]),
        ("name: p\nrules:\n  - category: email\n    action: MASK\n    min_confidence: 2\n", ["line 5", "from 0 to 1"]),
        ("name: p\ndetectors:\n  regex:\n    enabled: maybe\n", ["line 4", "detectors.regex.enabled"]),
        ("rules: []\n", ["name", "missing"]),
        ("- a\n", ["mapping"]),
        ("", ["mapping"]),
        ("name: [\n", ["policy file"]),
        ("name: p\nrules:\n  - action: MASK\n", ["rules.0.category", "missing"]),
    ],
)
def test_schema_errors_say_where(tmp_path, text, wanted):
    file = tmp_path / "p.yaml"
    file.write_text(text)
    with pytest.raises(S.PolicySchemaError) as e:
        S.YamlPolicy(file).load()
    assert all(x in str(e.value) for x in wanted), str(e.value)


def test_sources(tmp_path, monkeypatch):
    with pytest.raises(FileNotFoundError):
        S.policy_source(path=str(tmp_path / "none")).load()
    assert isinstance(S.policy_source("LOCAL_YAML", "x"), S.YamlPolicy)
    monkeypatch.setenv("SLUICE_POLICY_SOURCE", "Git_Manifest")
    with pytest.raises(NotImplementedError):
        S.policy_source().load()
    for name in ("icap", "purview_dlp"):
        with pytest.raises(NotImplementedError):
            S.policy_source(name)
    with pytest.raises(ValueError):
        S.policy_source("other")
    (tmp_path / "p").write_text("x")
    assert len(S.policy_hash(tmp_path / "p")) == 71 and S.policy_hash(tmp_path / "q") == "sha256:unknown"


def test_difference_counts_the_last_of_equal_keys(spark):
    old = P.Policy("a", rules=(P.Rule("email", "MASK"), P.Rule("email", "BLOCK"), P.Rule("jwt", "BLOCK"), P.Rule("domain", "MASK")))
    new = P.Policy("b", rules=(P.Rule("email", "MASK"), P.Rule("jwt", "BLOCK", audit_only=True), P.Rule("secret", "BLOCK", 0.5)))
    got = {(r.category, r.change) for r in P.diff(P.rules_frame(spark, old), P.rules_frame(spark, new)).collect()}
    assert got == {("email", "action"), ("jwt", "audit_only"), ("domain", "removed"), ("secret", "added")}
    assert P.diff(P.rules_frame(spark, old), P.rules_frame(spark, old)).count() == 0


def test_strict_policy_blocks_credentials():
    strict = {r.category: r.action for r in P.TOKENIZE_ALL.strict().rules}
    assert all(strict[c] == "BLOCK" for c in P.STRICT) and strict["email"] == "TOKENIZE"


def test_command_line(tmp_path, capsys):
    a, b = str(tmp_path / "a.yaml"), str(tmp_path / "b.yaml")
    assert cli.main(["init", a]) == 0 and cli.main(["init", a]) == 1 and cli.main(["init", b, "--strict", "--template", "tokenize-all"]) == 0
    assert cli.main(["validate-policy", a]) == 0 and cli.main(["validate-policy", str(tmp_path / "no")]) == 2
    (tmp_path / "bad.yaml").write_text("name: 1\n")
    assert cli.main(["validate-policy", str(tmp_path / "bad.yaml")]) == 1
    capsys.readouterr()
    assert cli.main(["policy-diff", a, a]) == 0 and "equivalent" in capsys.readouterr().out
    assert cli.main(["policy-diff", a, b]) == 0
    out = capsys.readouterr().out
    assert "action" in out and "email" in out
    assert cli.main(["policy-diff", a, str(tmp_path / "no")]) == 2


# ---- streams ----


@pytest.mark.parametrize("at", range(1, len(TOKEN) + 6))
def test_every_split_restores(at):
    text = f"hi {TOKEN} end"
    r = R.TextRestorer(TABLE)
    assert r.feed(text[:at]) + r.feed(text[at:]) + r.flush() == f"hi {TABLE[TOKEN]} end"


def test_held_back_text():
    r = R.TextRestorer(TABLE)
    assert r.feed("see [EMA") == "see " and r.feed("x") == "[EMAx" and r.flush() == ""
    assert r.feed("[" + "A" * 300) == "[" + "A" * 300
    assert r.feed("[EMAIL_0") == "" and r.flush() == "[EMAIL_0"
    assert "".join(map(R.TextRestorer({}).feed, "a [b] c")) == "a [b] c"


def event(text, end="\n\n"):
    return ("event: d" + end[: len(end) // 2] + "data: " + json.dumps({"index": 1, "delta": {"type": "text_delta", "text": text}}) + end).encode()


@pytest.mark.parametrize("end", ["\n\n", "\r\n\r\n"])
def test_events_byte_by_byte(end):
    raw = event(f"x {TOKEN}", end) + b": note" + end.encode() + b"data: [DONE]" + end.encode() + b"\xff\xfe" + end.encode()
    r = R.EventRestorer(TABLE)
    out = b"".join(r.feed(bytes([b])) for b in raw) + r.flush()
    whole = R.EventRestorer(TABLE)
    assert out == whole.feed(raw) + whole.flush()
    assert json.loads(out.split(b"data: ")[1].split(end.encode())[0])["delta"]["text"] == f"x {TABLE[TOKEN]}"
    assert out.endswith(b"\xff\xfe" + end.encode()) and b"data: [DONE]" in out


def test_buffered_events_join_their_pieces():
    text = f"a {TOKEN} b"
    raw = b"event: start\ndata: {\"type\": \"start\"}\n\n" + b"".join(event(text[k : k + 4]) for k in range(0, len(text), 4)) + b"data: [DONE]\n\n"
    out = R.restore_events(raw, TABLE)
    pieces = [json.loads(x.split(b"data: ")[1]) for x in out.split(b"\n\n") if b"delta" in x]
    assert [p["delta"]["text"] for p in pieces][0] == f"a {TABLE[TOKEN]} b" and not any(p["delta"]["text"] for p in pieces[1:])
    assert all(p["index"] == 1 for p in pieces) and out.startswith(b"event: start\ndata: {\"type\": \"start\"}\n\n") and out.endswith(b"data: [DONE]\n\n")
    assert R.restore_events(raw, {}) == raw and R.restore_events(b"\xff", TABLE) == b"\xff"
    other = b'data: {"choices": [{"delta": {"content": "' + TOKEN.encode() + b'"}}]}\n\n'
    assert TABLE[TOKEN] in json.loads(R.restore_events(other, TABLE)[6:])["choices"][0]["delta"]["content"]


def test_json_documents_restore_values_only(spark):
    body = json.dumps({TOKEN: [TOKEN, {"k": f"x{TOKEN}"}], "n": 1})
    rows = spark.createDataFrame([(body, TABLE), ("no json", TABLE), (None, TABLE), (body, None)], "b string, t map<string,string>")
    got = [r.r for r in rows.select(R.restored_json(F.col("b"), F.col("t")).alias("r")).collect()]
    assert json.loads(got[0]) == {TOKEN: [TABLE[TOKEN], {"k": "x" + TABLE[TOKEN]}], "n": 1} and got[1:] == ["no json", None, body]


def test_structured_stream_restores_unordered_chunks(spark, tmp_path):
    text = f"hello {TOKEN} and [x] {TOKEN}"
    parts = [(c, "r1", k, text[3 * k : 3 * k + 3], 3 * k + 3 >= len(text), TABLE if c == "a" else {}) for c in ("a", "b") for k in range((len(text) + 2) // 3)]
    schema = "conversation_id string, response_id string, seq long, chunk string, last boolean, tokens map<string,string>"
    for n, some in enumerate((parts[::-1][1::2] + [], parts[::-1][::2])):
        some = [p for p in parts if p[2] < 7] if n == 0 else [p for p in parts[::-1] if p[2] >= 7]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        q = R.restore_stream(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.parquet(f"file://{tmp_path}/out").orderBy("seq").collect()
    got = {c: "".join(r.text for r in rows if r.conversation_id == c) for c in ("a", "b")}
    assert got == {"a": f"hello {TABLE[TOKEN]} and [x] {TABLE[TOKEN]}", "b": text}


def test_structured_stream_restores_event_bytes(spark, tmp_path):
    event = b'data: {"delta":{"text":"see ' + TOKEN.encode() + b' ok"}}\n\n'
    data = event + b": note\r\n\r\n" + event[:-1]
    rows = [("c", "r", k, bytearray(data[i : i + 5]), i + 5 >= len(data), {TOKEN: "it"}) for k, i in enumerate(range(0, len(data), 5))]
    schema = "conversation_id string, response_id string, seq long, chunk binary, last boolean, tokens map<string,string>"
    spark.createDataFrame(rows[::-1], schema).write.parquet(f"{tmp_path}/in")
    stream = R.restore_event_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("events").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = b"".join(bytes(r.text) for r in spark.table("events").orderBy("seq").collect())
    assert got == data.replace(TOKEN.encode(), b"it")


def test_pieces_are_routed_by_kind(spark):
    event = f'data: {{"delta":{{"text":"{TOKEN}"}}}}\n\n'
    rows = [("bytes", event, "c"), ("text", event, "c"), ("object", f'{{"a":["{TOKEN}"]}}', "c"), ("object", f'{{"a":"{TOKEN}"}}', None), ("bytes", event, None)]
    frame = spark.createDataFrame([(k, kind, bytearray(x.encode()), c, {TOKEN: "it"}) for k, (kind, x, c) in enumerate(rows)], "k int, kind string, data binary, conversation string, tokens map<string,string>")
    out = frame.select("k", R.routed(*map(F.col, ("kind", "data", "conversation", "tokens"))).cast("string").alias("x"))
    assert {r.k: r.x for r in out.collect()} == {k: x.replace(TOKEN, "it") if c else x for k, (_, x, c) in enumerate(rows)}


def test_doctor_says_what_is_missing(tmp_path, capsys):
    path = tmp_path / "p.yaml"
    path.write_text(S.dump(P.REGEX_ONLY))
    assert cli.main(["doctor", "--policy", str(path)]) == 0 and "FAIL" not in capsys.readouterr().out
    path.write_text("name: x\ndetectors: {regex: {enabled: false}, opf: {enabled: false}, presidio: {enabled: false}}\n")
    assert cli.main(["doctor", "--policy", str(path)]) == 1 and "no detector" in capsys.readouterr().out


def test_reloading_keeps_the_last_good_policy(spark):
    clock, content, seen = [1], ["one"], []

    def load(path):
        if content[0] == "bad":
            raise ValueError("bad")
        return content[0]

    r = R.Reloader("p", load, lambda p: clock[0], lambda batch, epoch, policy: seen.append(policy))
    frame = spark.range(1)
    r(frame, 0)
    content[0] = "two"
    r(frame, 1)
    clock[0] = 2
    r(frame, 2)
    content[0], clock[0] = "bad", 3
    r(frame, 3)
    content[0] = "three"
    r(frame, 4)
    clock[0] = 4
    r(frame, 5)
    assert seen == ["one", "one", "two", "two", "two", "three"] and r.refused is None


def test_chunked_restore_restores_tokens_and_keeps_null_turns(spark, tmp_path, monkeypatch):
    from sluice import queries

    rows = [(1, 0, "mail jane@example.org"), (1, 1, None), (1, 2, ""), (2, 0, "at 10.0.0.1"), (2, 0, "at 10.0.0.1")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    run = lambda: sorted(map(tuple, queries.chunked_restore(spark, str(tmp_path)).collect()), key=str)
    assert run() == sorted(rows, key=str)
    empty = lambda e: e.groupBy("conversation_id").agg(F.create_map().cast("map<string,string>").alias("tokens"))
    monkeypatch.setattr(queries.tokens, "snapshot", empty)
    assert all("[" in text for _, _, text in run() if text is not None)  # without the ledger tokens stay
