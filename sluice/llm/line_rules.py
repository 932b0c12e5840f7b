"""Operator 9, quality rules: line-first cleaning.

Every line that has a word is judged alone; the first rule that it breaks is its fault:
  repeated     equal to an earlier line of the text, or half its words (of 4 or more) equal the word before
  symbols      more than one of `#*$%&|<>` for every `symbol_every` characters of its words
  navigation   3 or more `|`, one for every 4 words at least
  shouting     of 5 words or more: an exclamation mark for every 3 words, or 6 in 10 ASCII letters are capitals
  boilerplate  a phrase of BOILERPLATE in either case
  punctuation  fewer than `short_words` words and no mark of TERMINAL at its end
Failing lines are removed; lines without a word stay. A text is rejected if the removed lines held more than
`max_loss` of its words' characters, or if the base rules fail: fewer than `min_words` words, or more than
`max_repeat` percent of its words lie in 5-word windows that the text has twice or more.

Null: no words, cleaned is null, base_failed. Empty text: the same with an empty cleaned text. Texts of any length
are read whole. Repeated rows are judged alike; an empty table gives an empty result. Other columns pass through; a
column named like one of this operator's, in any case, is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Opened, split_batches, windows, words

SYMBOLS = b"#*$%&|<>"
TERMINAL = (b".", b"!", b"?", b":", b";", b'"', b"'", b")", b"\xe2\x80\xa6", b"\xe2\x80\x9d", b"\xc2\xbb", b"\xe3\x80\x82")
"""Ends of sentences and quotations, in ASCII and of U+2026, U+201D, U+00BB and U+3002; other scripts' marks do not count."""
BOILERPLATE = re.compile(
    rb"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings|consent)|accept (?:all )?cookies"
    rb"|copyright (?:\(c\)|\xc2\xa9|[0-9]{4})|(?:licensed|released) under|subscribe to our newsletter|enable javascript",
    re.IGNORECASE,
)
FAULTS = ("repeated", "symbols", "navigation", "shouting", "boilerplate", "punctuation")
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_NOT_CONTINUATION = bytes(range(0x80, 0xC0))
_WHITE = b" \t\n\r\x0b\x0c"


@dataclass(frozen=True)
class Config:
    min_words: int = 10
    max_repeat: int = 20
    symbol_every: int = 10
    short_words: int = 3
    max_loss: float = 0.3


def chars(text: bytes) -> int:
    """Code points other than white space."""
    return len(text.translate(None, _NOT_CONTINUATION + _WHITE))


def count_of(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


def fault(line: bytes, tokens: list[bytes], seen: set[bytes], c: Config) -> str | None:
    """The first rule that a line with words breaks. seen: the earlier lines."""
    n = len(tokens)
    if line in seen or n >= 4 and 2 * sum(map(eq, tokens, tokens[1:])) >= n:
        return "repeated"
    if count_of(line, SYMBOLS) * c.symbol_every > chars(line):
        return "symbols"
    if (pipes := line.count(b"|")) >= 3 and 4 * pipes >= n:
        return "navigation"
    if n >= 5 and (3 * line.count(b"!") >= n or 10 * count_of(line, UPPER) > 6 * max(1, count_of(line, LETTERS))):
        return "shouting"
    if BOILERPLATE.search(line):
        return "boilerplate"
    if n < c.short_words and not line.rstrip(_WHITE).endswith(TERMINAL):
        return "punctuation"
    return None


def repeat_words(hashes: np.ndarray) -> int:
    """Words in 5-word windows found twice or more, the first included."""
    if len(hashes) < 6:
        return 0
    w = windows(hashes, 5)
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    twice = np.zeros(len(w), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(twice)
    cover[at] += 1
    cover[at + 5] -= 1
    return int((np.cumsum(cover) > 0).sum())


def judge(text: bytes | None, c: Config) -> tuple:
    """The values of OUT for one text."""
    raw = text or b""
    hashes = words(raw)[0]
    seen: set[bytes] = set()
    faults = dict.fromkeys(FAULTS, 0)
    kept, duplicates, total, lost = [], 0, 0, 0
    for line in raw.split(b"\n"):
        tokens = line.split()
        if not tokens:
            kept.append(line)
            continue
        size = chars(line)
        total += size
        duplicates += line in seen
        if found := fault(line, tokens, seen, c):
            faults[found] += 1
            lost += size
        else:
            kept.append(line)
        seen.add(line)
    repeats = repeat_words(hashes)
    failed = len(hashes) < c.min_words or 100 * repeats > c.max_repeat * len(hashes)
    loss = lost / total if total else 0.0
    cleaned = None if text is None else b"\n".join(kept)
    return len(hashes), total, count_of(raw, SYMBOLS), duplicates, repeats, failed, not failed and loss <= c.max_loss, loss, sum(faults.values()), cleaned


OUT = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(), "lost_share": T.DoubleType(),
    "n_lines_removed": T.LongType(), "cleaned": T.StringType(),
}
_ARROW = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.binary()]


def clean(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs with the columns of OUT."""
    t = Opened(docs, OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            found = list(zip(*(judge(t, config) for t in b.column("raw").to_pylist()), strict=True))
            made = [pa.array(v, kind) for v, kind in zip(found, _ARROW, strict=True)]
            made[-1] = made[-1].cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *made], [*names, *OUT])

    names = t.names
    schema = t.schema(*(T.StructField(n, k) for n, k in OUT.items()))
    return t.closed(t.rows.select(*names, t.column("text").cast("binary").alias("raw")).mapInArrow(run, schema), *OUT)
