"""Operator 1, token counts by offset-mapped attribution.

A whole document is encoded once with a byte-level vocabulary. The tokens' byte lengths give their spans in code
points (a token that holds a part of a character covers that character), and an interval join within the document
assigns tokens to sections, spans [start, end) in code points, by the sections' order. A token that crosses a
boundary is allocated by an explicit rule:
  start     to the section that holds its first code point
  end       to the section that holds its last code point
  majority  to the section that holds most of its code points, of equals the earliest
token_share always allocates by code points: each token gives each section the share of its code points there.
Sections must not overlap; tokens outside all sections count nowhere.

The join needs no shuffle: sections and tokens of a document meet in its row; two binary searches for each section.

Null and empty texts: with line sections, one section [0, 0) without tokens. Empty sections have no token. Texts of
any length are encoded whole. Repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import split_batches

RULES = ("start", "end", "majority")
Sections = Callable[[str], tuple[np.ndarray, np.ndarray]]


class Tokens:
    """A byte-level vocabulary and its tokens' lengths in bytes."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.lengths = np.zeros(max(table.values()) + 1, np.int64)
        self.lengths[list(table.values())] = [len(t) for t in table]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token, in code points."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if len(text) == (ends[-1] if len(ends) else 0):
            return starts, ends
        at = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
        return at[starts] - 1, at[ends - 1]


_tokens: dict[tuple, Tokens] = {}


def tokens(ranks: bytes, pattern: str) -> Tokens:
    """One for each worker process."""
    key = (len(ranks), hash(ranks), pattern)
    if key not in _tokens:
        _tokens[key] = Tokens(ranks, pattern)
    return _tokens[key]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines, each with its line feed; a text without one is a line."""
    ends = np.cumsum([len(x) + 1 for x in text.split("\n")])
    ends[-1] -= 1
    if len(ends) > 1 and ends[-1] == ends[-2]:
        ends = ends[:-1]
    return np.append(0, ends[:-1]), ends


def allocate(ts: np.ndarray, te: np.ndarray, ss: np.ndarray, se: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each section: tokens by the rule, tokens that cross its boundary, sum of shares. Spans ascend."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    first = np.searchsorted(te, ss, side="right")  # the first token that ends after the section's start
    last = np.searchsorted(ts, se, side="left")  # one past the last that starts before its end
    last = np.where(se > ss, np.maximum(last, first), first)
    section = np.repeat(np.arange(len(ss)), last - first)
    token = np.arange(len(section)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[section]
    a, b = ts[token], te[token]
    inside = np.minimum(b, se[section]) - np.maximum(a, ss[section])
    crossing = inside < b - a
    if rule == "start":
        own = a >= ss[section]
    elif rule == "end":
        own = b <= se[section]
    else:
        own, part = ~crossing, np.flatnonzero(crossing)
        part = part[np.lexsort((part, -inside[part], token[part]))]  # a token's most of it first, of equals the earliest
        own[part[np.append(True, token[part[1:]] != token[part[:-1]])[: len(part)]]] = True
    n = len(ss)
    return (
        np.bincount(section[own], minlength=n),
        np.bincount(section[crossing], minlength=n),
        np.bincount(section, weights=inside / (b - a), minlength=n),
    )


OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section_no", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
        T.StructField("token_share", T.DoubleType()),
    ]
)


def attribute(docs: DataFrame, ranks_path: str, pattern: str, sections: Sections | str = line_sections, rule: str = "majority") -> DataFrame:
    """A row for each document and section. sections: a function of the text, or the name of a column
    array<struct<start, end>> in ascending order. ranks_path: a file on the driver."""
    if rule not in RULES:
        raise ValueError(f"unknown rule {rule!r}")
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: fixed size
    given = isinstance(sections, str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(ranks.value, pattern)
        for b in split_batches(batches):
            out, number, ids = [], [], []
            spans = b.column("sections").to_pylist() if given else None
            for i, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                text = text or ""
                if given:
                    ss, se = (np.array([x[k] for x in spans[i] or []], np.int64) for k in ("start", "end"))
                else:
                    ss, se = sections(text)
                out.append((ss, se, *allocate(*t.spans(text), ss, se, rule)))
                number.append(np.arange(len(ss), dtype=np.int32))
                ids += [doc] * len(ss)
            columns = [np.concatenate(x) for x in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(np.concatenate(number)),
                    *(pa.array(c, pa.int64()) for c in columns[:-1]),
                    pa.array(columns[-1], pa.float64()),
                ],
                OUT.names,
            )

    columns = ["doc_id", "text", *([docs[sections].alias("sections")] if given else [])]
    return docs.select(*columns).mapInArrow(run, OUT)
