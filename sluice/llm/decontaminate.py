"""Operator 6, benchmark decontamination by pigeonhole edit matching.

Texts are normalised: lower case, any run of white space one space, none at the ends. A test item of n signs may
occur with `budget` = floor(n * error) edits (insertions, deletions, substitutions). It is split into budget + 1
pieces of near-equal length; an occurrence within the budget holds at least one of them unchanged. One automaton
finds all pieces of all items in a document; every hit gives the window where its item can lie, overlapping windows
of an item merge, and Myers' bit-parallel distance decides in each.

Items are read in blocks of at most `block_signs` signs; each block is broadcast and scanned by itself, so memory is
bounded for a benchmark of any size. When there are several blocks, each one's hits are written to the shared
folder before the next block is read.

A result row is a document, an item and its best occurrence: least distance, then earliest end. start is the
leftmost start of an occurrence with that end and distance; both are signs of the normalised text. Null or empty
documents and items match nothing. Items with equal texts each match. Items of less than 1/error signs match
exactly. Repeated rows give repeated rows; empty tables give an empty result. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Opened, Stage, split_batches

SCHEMA = "doc_id long, item_id long, distance int, start int, end int"


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces, with their places."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def columns(pattern: str, text: str, anchored: bool) -> Iterator[tuple[int, int]]:
    """(j, distance between pattern and the best part of text that ends after j signs), for every j from 1; anchored:
    the part must begin where text does. Myers' bit vectors, one Python integer for a column of differences."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    more, less, score, carry = full, 0, len(pattern), int(anchored)
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        down = eq | less
        across = (((eq & more) + more) ^ more) | eq
        rise, fall = less | full & ~(across | more), more & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = rise << 1 | carry, fall << 1
        more, less = (fall | ~(down | rise)) & full, rise & down & full
        yield j, score


def occurrence(pattern: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best part of text within the budget, or None."""
    best, end = budget + 1, 0
    for j, d in columns(pattern, text, False):
        if d < best:
            best, end = d, j
            if not d:
                return 0, end - len(pattern), end
    if best > budget:
        return None
    back = text[max(0, end - len(pattern) - best) : end][::-1]
    return best, end - max(j for j, d in columns(pattern[::-1], back, True) if d == best), end


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error: float) -> None:
        self.items = [(i, t, int(len(t) * error)) for i, t in items if t]
        self.places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                self.places.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece in self.places:
            self.automaton.add_word(piece, piece)
        if self.places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item_id, distance, start, end) of each item that occurs in the normalised text."""
        windows: dict[int, list[list[int]]] = {}
        if not self.places:
            return []
        for last, piece in self.automaton.iter(text):
            for k, at in self.places[piece]:
                _, item, budget = self.items[k]
                begin = last + 1 - len(piece) - at
                window = [max(0, begin - budget), min(len(text), begin + len(item) + budget)]
                spans = windows.setdefault(k, [])
                if spans and window[0] <= spans[-1][1]:
                    spans[-1][0] = min(spans[-1][0], window[0])
                    spans[-1][1] = max(spans[-1][1], window[1])
                else:
                    spans.append(window)
        out = []
        for k, spans in windows.items():
            item_id, item, budget = self.items[k]
            found = [(d, e + a, s + a) for a, b in spans if (o := occurrence(item, text[a:b], budget)) for d, s, e in [o]]
            if found:
                d, e, s = min(found)
                out.append((item_id, d, s, e))
        return out


_matchers: dict[tuple, Matcher] = {}


def matcher(items: list[tuple[int | None, str]], error: float) -> Matcher:
    """The last block's, one for each worker process."""
    key = (hash(tuple(items)), error)
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, error)
    return _matchers[key]


def scan(docs: DataFrame, items: list[tuple[int | None, str]], error: float) -> DataFrame:
    """Hits of one block of normalised items."""
    block = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = matcher(block.value, error)
        for b in split_batches(batches):
            rows = [
                (doc, *hit)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for hit in m.find(normalise(text))
            ]
            if rows:
                doc, item, distance, start, end = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(item, pa.int64())] + [pa.array(x, pa.int32()) for x in (distance, start, end)],
                    ["doc_id", "item_id", "distance", "start", "end"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int | None, str]]]:
    """Normalised items in blocks of at most `most` signs, or one item."""
    block, size = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        text = normalise(r["text"])
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((r["item_id"], text))
        size += len(text)
    yield block


def matches(docs: DataFrame, items: DataFrame, error: float = 0.05, block_signs: int = 2_000_000) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Rows of SCHEMA."""
    if not 0 <= error < 0.5:
        raise ValueError("error must be from 0 to below 0.5")
    stage, written, queue = None, [], blocks(items, block_signs)
    block = next(queue)
    for later in queue:
        stage = stage or Stage(docs.sparkSession, "decontaminate")
        written.append(stage.write(scan(docs, block, error), f"block{len(written)}"))
        block = later
    out = scan(docs, block, error)
    for hits in written:
        out = out.unionByName(hits)
    return out


def remove(docs: DataFrame, items: DataFrame, error: float = 0.05, block_signs: int = 2_000_000) -> DataFrame:
    """docs, all columns, without those that hold an item. No join: each block of items filters in a scan."""
    t = Opened(docs)
    rows, names = t.rows, t.names
    for block in blocks(items, block_signs):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = matcher(sent.value, error)
            for b in split_batches(batches):
                clean = pa.array([not m.find(normalise(t)) for t in b.column("raw").to_pylist()], pa.bool_())
                yield b.filter(clean).select(names)

        rows = rows.select(*names, t.column("text").alias("raw")).mapInArrow(run, t.schema())
    return t.closed(rows)
