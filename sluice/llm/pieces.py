"""Operator 3, SentencePiece encoding and decoding with a distinct-chunk table.

In the vocabularies that this operator takes, no piece holds a white-space marker after another sign, so no merge
crosses from a word into the marker before the next. A text is cut there; each worker keeps a table from marked word
to ids, segments a word when it first meets it, and joins ids back by position. The ids are those that the library
gives for the whole text. The table has two generations of `table_size` words: when the young one is full the old
one goes, and words longer than `longest` are segmented without being kept, which bounds memory and changes no result.
Decoding gathers the surfaces of the ids in one vector operation; ids whose bytes are no valid text go to the library.

`encode` keeps that table in each worker. `encode_by_table` makes one of the corpus: every different marked word is counted
and segmented once and written to the shared folder; its most frequent words, of at most LONGEST signs, are broadcast, and
the others' ids are joined back by text and position. It gives the same ids, and moves every text and every uncommon word
through a shuffle for it. That took 1089 CPU seconds a GB and disk of 3.4 times the input, beyond the limits of 900 and 1.5,
where the worker's table takes 444 and none; so the query and the pipeline use `encode`.

Null and empty texts have the end id only and decode to the empty text. Texts of any length are encoded whole.
Repeated rows are encoded alike; an empty table gives an empty result. Other columns pass through; a column named
ids or decoded, in any case, is replaced.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Opened, Stage, split_batches

MARK = "▁"
_NO_PREFIX = b"\x1a\x02\x18\x00"
"""Appended to a serialised model: normalizer_spec (field 3) with add_dummy_prefix (field 3) false."""
_PROBE = "  a  word\n\n\t next▁ ▁x ﬁ Å ① é \U0001f600​ \r\n end  "


class Codec:
    """Encodes and decodes whole texts by chunks."""

    def __init__(self, model: bytes, table_size: int = 400_000, longest: int = 100) -> None:
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        self.end, self.table_size, self.longest = self.whole.eos_id(), table_size, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        n = self.whole.get_piece_size()
        pieces = ["" if self.whole.is_control(i) else self.whole.id_to_piece(i) for i in range(n)]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece crosses a white-space marker")
        surface = [
            bytes([int(p[3:5], 16)]) if self.whole.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.size = np.array([len(x) for x in surface], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.odd = np.array([self.whole.is_unknown(i) for i in range(n)])
        ids = [np.frombuffer(x, np.int32) for x in self.encode([_PROBE, _PROBE[2:]])]
        if [x.tolist() for x in ids] != [self.whole.encode(t) + [self.end] for t in (_PROBE, _PROBE[2:])]:
            raise ValueError("the model's normalisation is not the identity, so chunks do not give its ids")
        if self.decode(ids) != [self.whole.decode(x.tolist()) for x in ids]:
            raise ValueError("the model's surfaces do not give its texts")

    def words(self, text: str) -> list[str]:
        """The text's words without the marker before each; a word that follows n markers begins with n-1 spaces."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [x[1:] for x in re.findall(" +[^ ]+| +", " " + text)]
        return text.split(" ") if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as 32-bit numbers, the end id last."""
        if len(self.young) >= self.table_size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        cut = [self.words(t) for t in texts]
        have = [list(map(young.get, c)) for c in cut]
        new = set()
        for c, h in zip(cut, have, strict=True):
            if None in h:
                new.update(w for w, x in zip(c, h, strict=True) if x is None)
        for w in new & old.keys() if len(new) < len(old) else old.keys() & new:
            young[w] = old[w]
        fresh = [w for w in new if w not in young]
        made = self.bare.encode([" " + w for w in fresh], num_threads=1)
        young.update(zip(fresh, (array("i", x).tobytes() for x in made), strict=True))
        end, out = array("i", [self.end]).tobytes(), []
        for c, h in zip(cut, have, strict=True):
            if None in h:
                h = [young[w] if x is None else x for w, x in zip(c, h, strict=True)]
            h.append(end)
            out.append(b"".join(h))
        for w in fresh:
            if len(w) > self.longest:
                del young[w]
        return out

    def segment(self, words: list[str]) -> list[bytes]:
        """The ids of marked words, without an end."""
        return [array("i", x).tobytes() for x in self.bare.encode([" " + w for w in words], num_threads=1)]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """What the library's decode gives for each."""
        out = []
        for x in ids:
            size = self.size[x]
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(x) else 0
            raw = self.surface[np.repeat(self.at[x] - ends + size, size) + np.arange(total)].tobytes()
            try:
                if self.odd[x].any():
                    raise ValueError
                out.append(raw[raw[:1] == b" " :].decode())
            except ValueError:
                out.append(self.whole.decode(x.tolist()))
        return out


_codecs: dict[tuple, Codec] = {}


def codec(model: bytes, *options: int) -> Codec:
    """One for each worker process."""
    key = (len(model), hash(model), *options)
    if key not in _codecs:
        _codecs[key] = Codec(model, *options)
    return _codecs[key]


ADDED = ("ids", "decoded")
LONGEST = 64
"""Signs of the longest word that is broadcast."""


def _encoded(c: Codec, kept: list[pa.Array], names: list[str], flat: list[bytes]) -> pa.RecordBatch:
    offsets = np.zeros(len(flat) + 1, np.int32)
    np.cumsum([len(x) // 4 for x in flat], out=offsets[1:])
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(flat), np.int32)))
    decoded = c.decode([np.frombuffer(x, np.int32) for x in flat])
    return pa.RecordBatch.from_arrays([*kept, ids, pa.array(decoded, pa.string())], [*names, *ADDED])


def encode(docs: DataFrame, model_path: str, table_size: int = 400_000, longest: int = 100) -> DataFrame:
    """docs with ids (array of int, the end id last) and decoded (text). model_path: a file on the driver."""
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: fixed size
    t = Opened(docs, ADDED)
    names = t.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value, table_size, longest)
        for b in split_batches(batches, 256, 2 << 20):
            flat = c.encode([x or "" for x in b.column("raw").to_pylist()])
            yield _encoded(c, [b.column(n) for n in names], names, flat)

    schema = t.schema(T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()))
    return t.closed(t.rows.select(*names, t.column("text").alias("raw")).mapInArrow(run, schema), *ADDED)


class Ranks:
    """The broadcast part of the corpus's table: words by rank, and their ids."""

    def __init__(self, words: list[str], ids: list[bytes]) -> None:
        self.rank, self.ids = {w: k for k, w in enumerate(words)}, ids

    def split(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """For each word its rank, or -1 - k for the k-th different one of the others; these others."""
        ranks = np.fromiter(map(self.rank.get, words, repeat(-1)), np.int32, len(words))
        seen: dict[str, int] = {}
        for at in np.flatnonzero(ranks < 0).tolist():
            ranks[at] = -1 - seen.setdefault(words[at], len(seen))
        return ranks, list(seen)


def encode_by_table(docs: DataFrame, model_path: str, common: int = 200_000, flush: int = 300_000, keep_text: bool = True) -> DataFrame:
    """As `encode`, with one table of the corpus's different words. Without keep_text the column text is left out of the
    result, and of the shuffle. Equal texts share what is joined, under the first half
    of their SHA-256; the join is a plain equi-join whose skewed partitions Spark splits."""
    spark = docs.sparkSession
    with open(model_path, "rb") as file:
        model = spark.sparkContext.broadcast(file.read())  # a vocabulary: fixed size
    t, stage = Opened(docs, ADDED if keep_text else (*ADDED, "text")), Stage(spark, "pieces")
    names, text = t.names, F.coalesce(t.column("text"), F.lit(""))
    keyed = t.rows.select(*names, text.alias("raw"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("key"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, seen = codec(model.value), Counter()
        for b in split_batches(batches):
            for x in b.column("raw").to_pylist():
                seen.update(c.words(x))
            if len(seen) > flush:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), pa.array(c.segment(b.column("word").to_pylist()), pa.binary())], ["word", "n", "ids"])

    counts = keyed.select("raw").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    chunks = stage.write(counts.mapInArrow(segment, "word string, n long, ids binary"), "chunks")
    level = F.when(F.length("word") <= LONGEST, F.floor(F.log2("n") * 64).cast("int")).otherwise(-1)
    cut = reach = 0
    for r in chunks.select(level.alias("level")).groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 rows for a doubling
        reach += r["count"]
        if reach > common:
            cut = r["level"] + 1
            break
    top = chunks.filter(level >= cut).select("word", "ids").toArrow()  # at most `common` rows
    ranks = spark.sparkContext.broadcast(Ranks(top["word"].to_pylist(), top["ids"].to_pylist()))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, asked = codec(model.value), set()
        for b in split_batches(batches):
            rows: tuple[list, list, list] = ([], [], [])
            for x, key in zip(b.column("raw").to_pylist(), b.column("key").to_pylist(), strict=True):
                if key not in asked:
                    asked.add(key)
                    others = ranks.value.split(c.words(x))[1]
                    for column, values in zip(rows, ([key] * len(others), range(len(others)), others), strict=True):
                        column.extend(values)
            if len(asked) > flush:
                asked.clear()
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, (pa.binary(), pa.int32(), pa.string()), strict=True)], ["key", "k", "word"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model.value)
        for b in split_batches(batches):
            sent = []
            for x in b.column("raw").to_pylist():
                own = np.ascontiguousarray(ranks.value.split(c.words(x))[0], "<i4")
                sent.append(zlib.compress(own.view(np.uint8).reshape(-1, 4).T.tobytes(), 1))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("key"), pa.array(sent, pa.binary())], [*names, "key", "ranks"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(model.value), array("i", [codec(model.value).end]).tobytes()
        for b in split_batches(batches, 256, 2 << 20):
            flat = []
            for sent, found in zip(b.column("ranks").to_pylist(), b.column("found").to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(sent), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().tolist()
                rest = {x["k"]: x["ids"] for x in found or ()}
                flat.append(b"".join([*(ranks.value.ids[r] if r >= 0 else rest[-1 - r] for r in own), end]))
            yield _encoded(c, [b.column(n) for n in names], names, flat)

    rest = chunks.filter(level < cut).select("word", "ids")
    asked = keyed.select("raw", "key").mapInArrow(ask, "key binary, k int, word string").join(rest, "word")
    found = asked.groupBy("key").agg(F.collect_list(F.struct("k", "ids")).alias("found"))
    sent = keyed.mapInArrow(split, t.schema(T.StructField("key", T.BinaryType()), T.StructField("ranks", T.BinaryType())))
    schema = t.schema(T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()))
    return t.closed(sent.join(found, "key", "left").mapInArrow(join, schema), *ADDED)
