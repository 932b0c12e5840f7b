"""Operator 7, secret scans with structural confirmation.

Three base patterns (BASE) find assignments, access keys and hex runs. Beyond them, candidates are decoded and
reported only if their content parses:
  jwt   three base64url parts; header and payload decode to JSON objects, the header names its algorithm
  pem   a BEGIN and the END after it, of one private key, whose base64 body is a key encoding; the body may hold line
        ends, slashes and signs as JSON and source code escape them
  der   in a run of base64 or base64url, from its start or after one of `/+_-` in it: a key encoding to the run's end or,
        by its own length, to another such sign; or (outside of pem) one that is cut to lines by plain or escaped line ends
  hexder  the same in a hex run
A key encoding is DER whose nested lengths fill the value exactly and whose fields are those of a PKCS#1, PKCS#8 (also
encrypted by a password scheme) or SEC 1 private key, or the OpenSSH container, whose length-prefixed fields are walked
to the end; it has at most MOST bytes. Encodings that only look alike (public keys, certificates, random runs) are not
reported.

Spans are code points, end exclusive. Within a kind they do not overlap; kinds do not suppress each other. Patterns
run over bytes, so letters in either case are ASCII letters, and only a text that could hold a match is searched.

Null and empty texts have no spans. Texts of any length are read whole. Repeated rows are scanned alike; an empty
table gives an empty result. Other columns pass through; a column named secrets, in any case, is replaced.
"""

from __future__ import annotations

import base64
import binascii
import itertools
import json
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Opened, split_batches

KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "hexder")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
"""Runs of 16 or more: the base pattern's runs are maximal, so leaving shorter ones out first is the same."""
JWT = re.compile(rb"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{3,}\.[A-Za-z0-9_-]*")
"""The least header, {"alg":""}, has 14 signs, the least payload 3."""
MARK = re.compile(rb"-----(BEGIN|END) ([A-Z ]{0,30}PRIVATE KEY)-----")
BODY = re.compile(rb"[A-Za-z0-9+/=\s:,\\-]*")
BASE64 = re.compile(rb"[A-Za-z0-9+/_-]{40,}={0,2}")
START = re.compile(rb"(?:^|(?<=[/+_-]))(?=M[A-P]|b3BlbnNzaC1r)")
MOST = 1 << 16
"""Bytes of the longest key encoding: an RSA key of 16384 bits has 9.5 thousand."""
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))  # of PKCS#5, of PKCS#12
_BREAK = rb"(?:[ \t]*+(?:\r\n?|\n|\\++r(?:\\++n)?|\\++n)[ \t]*+)++"
_RUN = rb"[A-Za-z0-9+/_-]++"
LINES = re.compile(rb"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\)(?![nrt])|(?<=\\[nrt]))" + _RUN + rb"(?:" + _BREAK + _RUN + rb")++")
"""Runs that plain or escaped line ends part. A run begins at an edge or after an escape, never with the escape's letter."""
RUN, NEXT, PAD = re.compile(_RUN), re.compile(_BREAK + rb"(" + _RUN + rb")"), re.compile(rb"={0,2}")
FIRST = re.compile(rb"(?:M[A-P][A-Za-z0-9+/_-]{2}|b3Bl)[A-Za-z0-9+/_-]{12}")
"""How the first line of a wrapped DER sequence or OpenSSH container begins."""
HEXRUN = re.compile(rb"(?:[0-9a-fA-F]{2}){24,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_RUNS = bytearray(b" " * 256)
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-":
    _RUNS[_c] = ord("b")
_RUNS = bytes(_RUNS)
_HEXES = bytes(ord("h") if chr(i) in "0123456789abcdef" else ord(" ") for i in range(256))


def der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER value at `at`; None if its length is malformed or too long."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return (tag, at, at + size) if at + size <= len(data) else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill start to end exactly."""
    out, at = [], start
    while at < end:
        v = der(data[:end], at)
        if v is None:
            return None
        out.append(v)
        at = v[2]
    return out


def key_encoding(data: bytes) -> str | None:
    """The name of the private-key encoding that data is, from first to last byte."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh" if _openssh(data) else None
    top = der(data)
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    inner = children(data, top[1], top[2])
    if not inner:
        return None
    tags = [v[0] for v in inner]
    if tags == [0x30, 0x04] and inner[1][2] > inner[1][1]:
        scheme = children(data, inner[0][1], inner[0][2])
        return "pkcs8 encrypted" if scheme and scheme[0][0] == 0x06 and data[scheme[0][1] : scheme[0][2]].startswith(PASSWORD_SCHEMES) else None
    if tags[0] != 0x02:
        return None
    version = int.from_bytes(data[inner[0][1] : inner[0][2]], "big")
    if len(tags) >= 9 and set(tags[:9]) == {0x02} and version <= 1:
        return "pkcs1"
    if tags[:3] == [0x02, 0x30, 0x04] and version <= 1:
        algorithm = children(data, inner[1][1], inner[1][2])
        return "pkcs8" if algorithm and algorithm[0][0] == 0x06 and inner[2][2] > inner[2][1] else None
    if tags[:2] == [0x02, 0x04] and version == 1 and inner[1][2] - inner[1][1] in (20, 24, 28, 32, 48, 66):
        return "sec1" if set(tags[2:]) <= {0xA0, 0xA1} else None
    if len(tags) == 6 and set(tags) == {0x02} and version == 0:
        return "dsa"
    return None


def _openssh(data: bytes) -> bool:
    return _openssh_end(data) == len(data)


def _openssh_end(data: bytes) -> int | None:
    """Where the container's last field ends; None if data ends before, -1 if a field cannot be as long as it says."""
    at = 15

    def field() -> int | None:
        """The length of a field that data holds."""
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if n > MOST:
            return -1
        at += 4 + n
        return n if at <= len(data) else None

    def walk(count: int) -> int | None:
        for _ in range(count):
            if (n := field()) is None or n < 0:
                return n
        return n

    if (n := walk(3)) is None or n < 0:
        return n
    if at + 4 > len(data):
        return None
    keys, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    if not 1 <= keys <= 16:
        return -1
    if (n := walk(keys + 1)) is None or n < 0:
        return n
    return at if n else -1


def _openssh_size(run: bytes) -> int | None:
    """The length of the container that a run of base64 begins with."""
    for n in (400, 8000, 2 * MOST):
        part = run[:n]
        raw = _base64(part[: len(part) - (len(part) % 4 == 1)])
        end = _openssh_end(raw) if raw else -1
        if end is not None or n >= len(run):
            return end if end and end > 0 else None
    return None


def _base64(run: bytes) -> bytes | None:
    run = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if len(run) % 4 == 1:
        return None
    try:
        return base64.b64decode(run + b"=" * (-len(run) % 4), validate=True)
    except binascii.Error:
        return None


def _json_object(part: bytes) -> dict | None:
    raw = _base64(part)
    try:
        value = json.loads(raw) if raw else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _jwt(run: bytes) -> bool:
    header, payload, _ = run.split(b".")
    head = _json_object(header)
    return bool(head) and isinstance(head.get("alg"), str) and _json_object(payload) is not None


def _jwts(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of tokens. Where a candidate is none, its second part may begin one."""
    at = 0
    while m := JWT.search(text, at):
        if _jwt(m[0]):
            yield m.span()
            at = m.end()
        else:
            at = m.start() + m[0].index(b".") + 1


def _pem(body: bytes) -> bool:
    """Whether a PEM body, with line ends, slashes and signs escaped or not, is a key encoding."""
    body = re.sub(rb"\\+u00([0-7][0-9a-fA-F])", lambda m: bytes([int(m[1], 16)]), body)
    body = re.sub(rb"\\+(?=[/\s])", b"", re.sub(rb"\\+[nrt]", b"\n", body))
    raw = _base64(b"".join(re.sub(rb"^[A-Za-z-]+: .*$", b"", body, flags=re.M).split()))
    return bool(raw) and key_encoding(raw) is not None


def _pems(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of pairs: an END and the last BEGIN before it."""
    begin = None
    for m in MARK.finditer(text):
        if m[1] == b"BEGIN":
            begin = m
        elif begin is not None:
            if begin[2] == m[2] and BODY.fullmatch(text, begin.end(), m.start()) and _pem(text[begin.end() : m.start()]):
                yield begin.start(), m.end()
            begin = None


def _ders(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of key encodings in unbroken runs."""
    for m in BASE64.finditer(text):
        run, at = m[0].rstrip(b"="), 0
        while s := START.search(run, at):
            at = s.start() + 1
            rest = run[s.start() :]
            size = _openssh_size(rest) if rest.startswith(b"b3Bl") else _size(_base64(rest[:16]) or b"")
            need = 0 if size is None else -(-size * 8 // 6)
            if 40 <= need <= len(rest) and rest[need : need + 1] in (b"", b"/", b"+", b"_", b"-") and key_encoding(_base64(rest[:need]) or b""):
                at = s.start() + need
                yield m.start() + s.start(), m.end() if at == len(run) else m.start() + at


def _size(head: bytes) -> int | None:
    """The length that a DER sequence, beginning with a version of one byte or with another sequence, says it has."""
    if len(head) < 2 or head[0] != 0x30:
        return None
    n = head[1] & 0x7F if head[1] >= 0x80 else 0
    size = int.from_bytes(head[2 : 2 + n], "big") if head[1] >= 0x80 else head[1]
    begins = head[2 + n : 4 + n] == b"\x02\x01" or head[2 + n : 3 + n] == b"\x30"
    return 2 + n + size if n <= 4 and begins and size <= MOST else None


def _wrapped(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of key encodings in base64 that is cut to lines, as long as the encoding says."""
    for m in LINES.finditer(text):
        runs, end = [RUN.match(text, m.start()).span()], 0
        while (end := runs[-1][1]) < m.end():
            runs.append(NEXT.match(text, end).span(1))
        likely = [k for k, (s, _) in enumerate(runs) if FIRST.match(text, s)]
        if not likely:
            continue
        whole = b"".join(text[s:e] for s, e in runs)
        before, past = list(itertools.accumulate((e - s for s, e in runs), initial=0)), 0
        for k in likely:
            start, at = runs[k][0], before[k]
            if start < past:
                continue
            own = whole[at : at + 2 * MOST]
            size = _openssh_size(own) if own.startswith(b"b3BlbnNzaC1r") else _size(_base64(own[:16]) or b"")
            need = 0 if size is None else -(-size * 8 // 6)
            if not before[k + 1] - at < need <= len(own):
                continue
            j = bisect_left(before, at + need) - 1
            stop = runs[j][0] + at + need - before[j]
            if stop == runs[j][1] and key_encoding(_base64(own[:need]) or b""):
                past = PAD.match(text, stop).end()
                yield start, past


def byte_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), in bytes, ascending."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"h" * 16 in text.translate(_HEXES):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    runs = text.translate(_RUNS)
    if b"b" * 14 in runs and b"." in text:
        out += [(s, 3, e) for s, e in _jwts(text)]
    pems = list(_pems(text)) if b"PRIVATE KEY-----" in text else []
    out += [(s, 4, e) for s, e in pems]
    ders = []
    if b"b" * 40 in runs:
        ders += _ders(text)
        for m in HEXRUN.finditer(text):
            if m.end() - m.start() <= 2 * MOST and key_encoding(bytes.fromhex(m[0].decode())):
                out.append((m.start(), 6, m.end()))
    if b"b" * 16 in runs:
        taken = sorted([*pems, *ders])
        ders += [(s, e) for s, e in _wrapped(text) if not any(a < e and s < b for a, b in taken)]
    out += [(s, 5, e) for s, e in ders]
    return sorted(out)


def scan(text: bytes) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end), in code points, by start and kind."""
    found = byte_spans(text)
    if not found or text.isascii():
        return found
    cuts = sorted({x for s, _, e in found for x in (s, e)})
    inner = [0, *cuts]
    sizes = [len(text[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(inner, inner[1:], strict=False)]
    at = np.cumsum(sizes).tolist()
    place = lambda x: at[bisect_left(cuts, x)]
    return [(place(s), k, place(e)) for s, k, e in found]


SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
)
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def secrets(docs: DataFrame) -> DataFrame:
    """docs with `secrets`: array<struct<kind, start, end>> by start, then kind in the order of KINDS."""
    t = Opened(docs, ["secrets"])
    names = t.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            found = [
                [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] if t else []
                for t in b.column("raw").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(found, _ARROW)], [*names, "secrets"])

    out = t.rows.select(*names, t.column("text").cast("binary").alias("raw")).mapInArrow(run, t.schema(T.StructField("secrets", SPANS)))
    return t.closed(out, "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, kinds: Iterable[str] = KINDS, tag: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with the union of the spans of these kinds replaced in `text`; overlapping spans become one tag.
    A null text stays null; an integer column n_chars, if there is one, follows the texts that change."""
    wanted = {KINDS.index(k) for k in kinds}
    t = Opened(docs)
    names, place, size = t.names, t.place("text"), [f"c{k}" for k, f in enumerate(t.fields) if f.name == "n_chars" and isinstance(f.dataType, T.IntegralType)]

    def clean(text: bytes) -> bytes:
        out, at = [], 0
        for s, k, e in byte_spans(text):
            if k in wanted:
                if s >= at:
                    out += [text[at:s], tag.encode()]
                at = max(at, e)
        return b"".join([*out, text[at:]]) if at else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            old = b.column("raw").to_pylist()
            new = [x and clean(x) for x in old]
            made = {place: pa.array(new, pa.binary()).cast(b.schema.field(place).type)}
            for n in size:
                kept = b.column(n).to_pylist()
                made[n] = pa.array([k if x == y else len(y.decode()) for k, x, y in zip(kept, old, new, strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays([made.get(n, b.column(n)) for n in names], names)

    return t.closed(t.rows.select(*names, t.column("text").cast("binary").alias("raw")).mapInArrow(run, t.schema()))
