"""Normalisation before detection: compatibility forms, invisible signs, entities, percent and base64 runs, with a map
from every sign of the result to the part of the original that it came from.

Spark has no such function, so this is an Arrow UDF. Texts that it cannot change (ASCII, without entities, percent runs
or base64 candidates) are not sent to Python: a Column test makes them null there, and they carry no map.
"""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.operators.detect import bound, slices

# The default-ignorable signs beside Unicode's category Cf; decoding candidates.
IGNORABLE = (
    "\u00ad"  # soft hyphen
    "\u034f"  # combining grapheme joiner
    "\u115f"  # hangul choseong filler
    "\u1160"  # hangul jungseong filler
    "\u17b4"  # khmer vowel inherent aq
    "\u17b5"  # khmer vowel inherent aa
    "\u180b"  # mongolian free variation selector one
    "\u180c"  # mongolian free variation selector two
    "\u180d"  # mongolian free variation selector three
    "\u180e"  # mongolian vowel separator
    "\u200b"  # zero width space
    "\u200c"  # zero width non-joiner
    "\u200d"  # zero width joiner
    "\u200e"  # left-to-right mark
    "\u200f"  # right-to-left mark
    "\u202a"  # left-to-right embedding
    "\u202b"  # right-to-left embedding
    "\u202c"  # pop directional formatting
    "\u202d"  # left-to-right override
    "\u202e"  # right-to-left override
    "\u2060"  # word joiner
    "\u2061"  # function application
    "\u2062"  # invisible times
    "\u2063"  # invisible separator
    "\u2064"  # invisible plus
    "\u2066"  # left-to-right isolate
    "\u2067"  # right-to-left isolate
    "\u2068"  # first strong isolate
    "\u2069"  # pop directional isolate
    "\u206a"  # inhibit symmetric swapping
    "\u206b"  # activate symmetric swapping
    "\u206c"  # inhibit arabic form shaping
    "\u206d"  # activate arabic form shaping
    "\u206e"  # national digit shapes
    "\u206f"  # nominal digit shapes
    "\ufeff"  # zero width no-break space
)
ENTITY = re.compile(r"&(?:#x?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
PERCENT = re.compile(r"(?:%[0-9a-fA-F]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/]{16,2048}={0,2}")
# End of fixed values.

GATE = r"[^\x00-\x7F]|&[#A-Za-z]|%[0-9a-fA-F]{2}|[A-Za-z0-9+/]{16}"
RESULT = "struct<normalized:string,os:array<int>,oe:array<int>,kind:array<int>,flags:array<string>>"
IDENTITY, REPLACE, DECODE = 0, 1, 2


@dataclass(frozen=True)
class Options:
    nfkc: bool = True
    strip_ignorable: bool = True
    html_entities: bool = True
    url_decode: bool = True
    base64: bool = True
    rounds: int = 3


class Traced:
    """A text and, for each sign, start and end of its origin and how it came about."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = np.arange(len(text), dtype=np.int32)
        self.end = self.start + 1
        self.kind = np.zeros(len(text), np.int8)

    def take(self, text: str, index: np.ndarray, kind: np.ndarray) -> None:
        """Each new sign comes from the old sign at its index."""
        self.text, self.start, self.end, self.kind = text, self.start[index], self.end[index], np.maximum(self.kind[index], kind)

    def replace(self, pattern: re.Pattern[str], decode) -> bool:
        """Replaces matches for which decode gives another text; each of its signs comes from the whole match."""
        parts, last, edits = [], 0, []
        for m in pattern.finditer(self.text):
            new = decode(m[0])
            if new is not None and new != m[0]:
                edits.append((m.start(), m.end(), new))
        if not edits:
            return False
        starts, ends, kinds, at = [], [], [], 0
        for s, e, new in edits:
            parts += [self.text[at:s], new]
            starts += [self.start[at:s], np.full(len(new), self.start[s], np.int32)]
            ends += [self.end[at:s], np.full(len(new), self.end[e - 1], np.int32)]
            kinds += [self.kind[at:s], np.full(len(new), DECODE, np.int8)]
            at = last = e
        self.text = "".join(parts) + self.text[last:]
        self.start = np.concatenate([*starts, self.start[last:]])
        self.end = np.concatenate([*ends, self.end[last:]])
        self.kind = np.concatenate([*kinds, self.kind[last:]])
        return True


def _percent(run: str) -> str | None:
    try:
        return urllib.parse.unquote(run, errors="strict")
    except UnicodeDecodeError:
        return None


def printable(data: bytes) -> bool:
    """Nine in ten bytes are printable ASCII, tab, line feed or carriage return; nothing is not."""
    good = sum(0x20 <= b < 0x7F or b in (9, 10, 13) for b in data)
    return bool(data) and good / len(data) >= 0.9


def _base64(run: str) -> str | None:
    try:
        data = base64.b64decode(run + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    if not printable(data):
        return None
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def normalize(text: str, o: Options = Options()) -> tuple[Traced, list[str]]:
    t, flags = Traced(text), []
    if o.nfkc and not unicodedata.is_normalized("NFKC", text):
        signs = [unicodedata.normalize("NFKC", x) for x in text]
        index = np.repeat(np.arange(len(text)), [len(x) for x in signs])
        other = np.array([x != y for x, y in zip(signs, text, strict=True)])
        t.take("".join(signs), index, np.where(other[index], REPLACE, IDENTITY).astype(np.int8))
        if other.any():
            flags.append("nfkc")
    if o.strip_ignorable:
        keep = np.array([x not in IGNORABLE and unicodedata.category(x) != "Cf" for x in t.text], bool) if not t.text.isascii() else None
        if keep is not None and not keep.all():
            index = np.flatnonzero(keep)
            t.take("".join(t.text[i] for i in index), index, np.zeros(len(index), np.int8))
            flags.append("default_ignorable")
    for _ in range(max(1, o.rounds)):
        changed = False
        for on, pattern, decode, flag in ((o.html_entities, ENTITY, html.unescape, "html_entity"), (o.url_decode, PERCENT, _percent, "url_encoded"), (o.base64, BASE64, _base64, "base64_nested")):
            if on and t.replace(pattern, decode):
                changed = True
                if flag not in flags:
                    flags.append(flag)
        if not changed:
            break
    return t, flags


def normalized(text: Column, options: Options = Options()) -> Column:
    """Struct RESULT where the text changed, else null."""

    @F.pandas_udf(RESULT)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in texts:
            rows = []
            for x in series:
                t, flags = normalize(x, options) if x is not None else (Traced(""), [])
                same = x is None or t.text == x
                rows.append((None, [], [], [], []) if same else (t.text, t.start, t.end, t.kind.astype(np.int32), flags))
            yield pd.DataFrame(rows, columns=["normalized", "os", "oe", "kind", "flags"])

    made = run(F.when(F.regexp_like(text, F.lit(GATE)), text))  # Spark calls the function for every row; null costs nothing
    return F.when(made["normalized"].isNotNull(), made)


def project(norm: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """A span of the normalised text in the original: from the first sign's origin to the last one's; an empty span is
    anchored at its place; a span beyond the text fails."""
    n = F.size(norm["os"])
    check = F.when((start < 0) | (end < start) | (end > n), F.raise_error(F.lit("span outside the text")).cast("int"))
    anchor = F.when(start < n, F.get(norm["os"], start)).when(n > 0, F.get(norm["oe"], n - 1)).otherwise(0)
    return F.coalesce(check, F.when(end > start, F.get(norm["os"], start)).otherwise(anchor)), F.when(end > start, F.get(norm["oe"], end - 1)).otherwise(anchor)


def remap(found: Column, norm: Column, text: Column) -> Column:
    """Detections in the normalised text as detections in the original, whose text becomes matched_text."""

    def place(d: Column) -> Column:
        s, e = project(norm, d["start"], d["end"])
        return d.withField("start", s).withField("end", e)

    def fill(moved: Column) -> Column:
        return F.zip_with(moved, slices(text, moved), lambda d, t: d.withField("matched_text", t))

    return F.when(norm.isNull(), found).otherwise(bound(F.transform(found, place), fill))


def compose(first: Traced, second: Traced) -> Traced:
    """The map through two steps: second's text back to first's original."""
    out = Traced(second.text)
    out.start = first.start[second.start]
    out.end = first.end[second.end - 1]
    out.kind = np.maximum(second.kind, first.kind[second.start])
    return out
