"""Operator 4, language-model scoring with a hidden Markov model.

Tokens are words `[^\\x20\\x09-\\x0D]+` of the text with A-Z in lower case, then one end. The vocabulary is all tokens
of the training texts with their exact counts (N tokens, V different). Every word has an emission in every state. The
`head` most frequent words and the end have it directly; every other word is emitted in two steps, by a class (a hash
of its last 3 bytes, `classes` of them) and within the class by its own table row:

    P(w | state) = P(class | state) * (E(w, state) / share(class, state) + 1) / (N_class + V_class + 1)

E(w, state) is how often the state is expected to have emitted w, and share(class, state) the part of the class's
tokens that is the state's; so the words of a class and one unseen word have probability 1 in every state. States emit
head, classes and the end, smoothed by `smooth` times the corpus shares.

Baum-Welch: each of `rounds` passes over all training texts runs scaled forward and backward recursions in the tasks
and sums the expected counts by symbol and state in a shuffle: (head + classes + 1) * states numbers, a fixed size.
The last pass sums them by word too, which makes the table of E: a row for each word of the corpus beyond the head,
written to the shared folder, with the word's distribution over states in steps of 1/248. Start: states emit random
multiples of the corpus shares. Recursions of the training run in single precision and are summed in double; scoring
runs in double.

The common words, the head and those above a count that at most `common` words reach (a histogram of the counts'
logarithms gives it), are looked up in a broadcast; the others' counts and emissions are joined by a shuffle, one row
for each text and different uncommon word. Which way a word goes changes no result.

Null and empty texts have the end only. Texts of any length are scored whole: recursions run in blocks of tokens whose
boundary states are kept, and blocks are recomputed for the backward pass. Repeated rows train and score each; a null
id trains and is not held out. No training text: the base score is of c = 0, N = 0, V = 0, and score is equal to it.
An empty table gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stage, split_batches

LEVELS = 248
"""Steps of a word's distribution over states: one byte for each of at most 8 states."""


@dataclass(frozen=True)
class Config:
    states: int = 8
    head: int = 10_000
    common: int = 200_000
    classes: int = 1024
    rounds: int = 4
    smooth: float = 0.1
    cells: int = 300_000
    block: int = 2048
    together: int = 2_000_000
    flush: int = 300_000
    every: int = 8
    piece: int = 20_000
    seed: int = 4

    def __post_init__(self) -> None:
        if not 1 <= self.states <= 8:
            raise ValueError("states must be from 1 to 8")


@dataclass(frozen=True)
class Model:
    first: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def words_of(text: bytes) -> list[bytes]:
    """ASCII letters in lower case; split at the six ASCII white-space signs."""
    return text.lower().split()


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of each of the texts as `words_of` gives them, and row offsets. A null text has none."""
    raw = texts.cast(pa.binary())
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.Array.from_buffers(pa.string(), len(raw), raw.buffers(), offset=raw.offset)))
    words, at = cut.flatten(), cut.offsets.to_numpy()
    words, at = pa.Array.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset), at - at[0]
    full = pc.binary_length(words).to_numpy() > 0  # white space at a text's edge leaves an empty word
    if not full.all():
        words, at = words.filter(pa.array(full)), np.append(0, np.cumsum(full))[at]
    return words, at


def counted(texts: pa.Array) -> pa.Table:
    """How often each word occurs; b"" stands for the ends."""
    found = pc.value_counts(all_words(texts)[0])
    return pa.table({"word": pa.concat_arrays([found.field("values"), pa.array([b""], pa.binary())]), "n": pa.concat_arrays([found.field("counts"), pa.array([len(texts)], pa.int64())])})


def class_of(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


_STEP = np.array([zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)], np.uint32)
"""The table of crc32: of a byte alone, without what the function does before and after."""


def classes_of(words: pa.Array, classes: int) -> np.ndarray:
    """`class_of` each of the words."""
    if not len(words):
        return np.zeros(0, np.int16)
    _, at, data = words.buffers()
    at, data = np.frombuffer(at, np.int32)[words.offset : words.offset + len(words) + 1], np.frombuffer(data or b"", np.uint8)
    crc = np.full(len(words), 0xFFFFFFFF, np.uint32)
    for k in (3, 2, 1):
        on = np.flatnonzero(np.diff(at) >= k)
        crc[on] = _STEP[(crc[on] ^ data[at[1:][on] - k]) & 0xFF] ^ (crc[on] >> 8)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % classes).astype(np.int16)


def padded(seqs: list[np.ndarray], c: Config) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences of near-equal length together: their indices, lengths (descending), symbols (time x sequence). A block
    of times of one group has at most `cells` symbols, or one sequence's."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    at = 0
    while at < len(order):
        longest = len(seqs[order[at]])
        some = order[at : at + max(1, c.cells // min(longest, c.block))]
        n = np.array([len(seqs[i]) for i in some])
        out = np.zeros((longest, len(some)), np.int32)
        for k, i in enumerate(some):
            out[: n[k], k] = seqs[i]
        yield np.array(some), n, out
        at += len(some)


def lengths_left(n: np.ndarray, t0: int, times: int) -> np.ndarray:
    """How many sequences reach each of the times from t0; lengths descend, so these are the first ones."""
    return np.searchsorted(-n, -(t0 + np.arange(times)), side="left")


def cut_out(obs: np.ndarray, n: np.ndarray, t0: int, block: int) -> tuple[np.ndarray, list[int]]:
    """A block of times from t0 of the sequences that reach t0, and how many reach each time."""
    live = lengths_left(n, t0, min(block, len(obs) - t0)).tolist()
    return obs[t0 : t0 + block, : live[0]].astype(np.intp), live


class Recursion:
    """Forward and backward variables of blocks of times (time x sequence x state) in buffers that all blocks share.
    Emissions are divided by their mean over the states, which keeps products of `every` of them in range; variables are
    scaled to sum 1 at every `every`-th time of a block."""

    def __init__(self, m: Model, c: Config, kind: type) -> None:
        self.states, self.every, self.kind = len(m.first), c.every, kind
        self.level = m.emit.mean(axis=1)
        self.emit = np.ascontiguousarray(m.emit / np.where(self.level > 0, self.level, 1)[:, None], kind)
        self.first, self.move, self.back = m.first.astype(kind), m.move.astype(kind), np.ascontiguousarray(m.move.T, kind)
        self.one, self.buffers = np.ones(self.states, kind), {}

    def buffer(self, name: str, shape: tuple[int, int]) -> np.ndarray:
        size = shape[0] * shape[1] * self.states
        if len(self.buffers.get(name, ())) < size:
            self.buffers[name] = np.empty(size, self.kind)
        return self.buffers[name][:size].reshape(*shape, self.states)

    def given(self, part: np.ndarray) -> np.ndarray:
        return np.take(self.emit, part, axis=0, out=self.buffer("given", part.shape), mode="clip")

    def forward(self, given: np.ndarray, live: list[int], start: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Variables, 0 beyond a sequence's end, and the scales. start: the variables before the block."""
        alpha, scales = self.buffer("alpha", given.shape[:2]), []
        for t, k in enumerate(live):
            a = alpha[t, :k]
            if start is None:
                np.multiply(self.first, given[t, :k], out=a)
            else:
                np.matmul(start[:k], self.move, out=a)
                np.multiply(a, given[t, :k], out=a)
            if t % self.every == 0:
                scales.append(a @ self.one)
                a /= scales[-1][:, None]
            alpha[t, k:] = 0
            start = alpha[t]
        return alpha, scales

    def backward(self, given: np.ndarray, live: list[int], after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Variables, and the product of variables and emissions (in given's place); both 0 beyond a sequence's end. after:
        the variables at the block's end, which become those at its start."""
        beta = self.buffer("beta", given.shape[:2])
        for t in range(len(live) - 1, -1, -1):
            k = live[t]
            b, x = after[:k], given[t, :k]
            beta[t, :k] = b
            beta[t, k:] = given[t, k:] = 0
            np.multiply(x, b, out=x)
            np.matmul(x, self.back, out=b)
            if t % self.every == 0:
                scale = (1 / (b @ self.one))[:, None]
                b *= scale
                x *= scale
        return beta, given


def likelihood(m: Model, seqs: list[np.ndarray], c: Config) -> np.ndarray:
    """log10 P of each sequence of symbols."""
    out, r = np.zeros(len(seqs)), Recursion(m, c, np.float64)
    level = np.log10(np.where(r.level > 0, r.level, 1))
    for some, n, obs in padded(seqs, c):
        start, total = None, np.zeros(len(n))
        for t in range(0, len(obs), c.block):
            part, live = cut_out(obs, n, t, c.block)
            alpha, scales = r.forward(r.given(part), live, start)
            for s in scales:
                total[: len(s)] += np.log10(s)
            ends = alpha.sum(axis=2)  # what the last scaling left, at a sequence's last time
            last = (n > t) & (n <= t + len(part))
            total[last] += np.log10(ends[n[last] - 1 - t, np.flatnonzero(last)])
            start = alpha[-1].copy()
        out[some] = total
    return out + np.array([level[s].sum() for s in seqs])


def expect(m: Model, seqs: list[np.ndarray], c: Config, kind: type = np.float32, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of first states, moves and emissions. of: the sequences hold places, each with a symbol, and emissions
    are counted by place."""
    r, k = Recursion(m, c, kind), len(m.first)
    first, move, emit, least = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(m.emit if of is None else of))), np.finfo(kind).tiny
    given_of = r.given if of is None else lambda part: r.given(of[part])
    for _, n, obs in padded(seqs, c):
        starts, start, cuts = [], None, range(0, len(obs), c.block)
        for t0 in cuts:
            starts.append(start)
            if t0 + c.block < len(obs):
                part, live = cut_out(obs, n, t0, c.block)
                start = r.forward(given_of(part), live, start)[0][-1].copy()
        after = np.ones((len(n), k), kind)
        for t0, start in zip(reversed(cuts), reversed(starts), strict=True):
            part, live = cut_out(obs, n, t0, c.block)
            given = given_of(part)
            alpha, _ = r.forward(given, live, start)
            beta, ahead = r.backward(given, live, after)
            if start is not None:
                x, y = start[: live[0]], ahead[0, : live[0]]
                move += m.move * ((x / (((x @ r.move) * y) @ r.one)[:, None]).T @ y)
            z = np.einsum("tks,tks->tk", alpha, beta)
            alpha *= np.reciprocal(np.maximum(z, least, out=z), out=z)[:, :, None]
            move += m.move * (alpha[:-1].reshape(-1, k).T @ ahead[1:].reshape(-1, k))
            beta *= alpha  # from here on the states' probabilities
            if start is None:
                first += beta[0].sum(axis=0)
            flat = part.ravel()
            for s in range(0, k, 2):
                for x, own in enumerate(beta.reshape(-1, k)[:, s : s + 2].T.astype(np.float64, order="C")):
                    emit[s + x] += np.bincount(flat, weights=own, minlength=emit.shape[1])
    return first, move, emit.T


def initial(shares: np.ndarray, c: Config) -> Model:
    rng = np.random.default_rng(c.seed)
    emit = shares[:, None] * rng.uniform(0.2, 1.8, (len(shares), c.states))
    move = np.full((c.states, c.states), 0.1 / max(1, c.states - 1))
    np.fill_diagonal(move, 0.9 if c.states > 1 else 1.0)
    return Model(np.full(c.states, 1 / c.states), move, emit / emit.sum(axis=0))


def improve(first: np.ndarray, move: np.ndarray, emit: np.ndarray, shares: np.ndarray, c: Config) -> Model:
    """Parameters from expected counts. Smoothing mixes each state's emissions with the corpus shares."""
    emit = emit / np.maximum(emit.sum(axis=0), 1e-300)
    emit = (1 - c.smooth) * emit + c.smooth * shares[:, None]
    move = move + 1e-3
    return Model((first + 1) / (first + 1).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


@dataclass(frozen=True)
class Classes:
    """The emissions of words by their classes. emit: class x state; share, tokens, kinds: the class's tokens by state, in
    all, and its different words."""

    emit: np.ndarray
    share: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray

    def emissions(self, kind: np.ndarray, count: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """P(w | state) of words of the classes `kind`, each with its count (0 if unseen) and packed distribution."""
        steps = np.ascontiguousarray(packed, "<i8").view(np.uint8).reshape(-1, 8)[:, : self.emit.shape[1]].astype(np.float64)
        own = steps * (count / np.maximum(steps.sum(axis=1), 1))[:, None]
        return self.emit[kind] * (own / np.maximum(self.share[kind], 1e-300) + 1) / (self.tokens + self.kinds + 1)[kind][:, None]


def pack(counts: np.ndarray) -> np.ndarray:
    """Words' expected counts by state as their distributions: a byte for each state, from 1 to LEVELS."""
    steps = np.zeros((len(counts), 8), np.uint8)
    steps[:, : counts.shape[1]] = np.round((LEVELS - 1) * counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-300)) + 1
    return steps.view("<i8").ravel().astype(np.int64)


def _class(word: Column, classes: int) -> Column:
    raw = word.cast("binary")
    return (F.crc32(F.when(F.length(raw) > 3, F.substring(raw, -3, 3)).otherwise(raw)) % classes).cast("int")


CODED = "doc_id long, teach boolean, held_out boolean, seq binary, words array<binary>, kinds binary"
"""seq and kinds: the bytes of 4- and 2-byte integers, which Spark passes on whole; an array's elements it takes one by one."""


class Vocabulary:
    """The common words. A text's tokens are their ranks, then `end`, or -1 - k for the k-th of its other words."""

    def __init__(self, words: list[bytes], c: Config, head: int) -> None:
        self.words, self.end, self.head, self.classes = pa.array(words, pa.binary()), len(words), head, c.classes
        kind = classes_of(self.words[head:], c.classes).astype(np.int32)
        self.symbol = np.concatenate([np.arange(head), head + kind, [head + c.classes]]).astype(np.int32)

    def encode(self, texts: pa.Array | list[bytes]) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray]:
        """For each text its tokens, its different uncommon words and their classes. Each different word is looked up once."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
        cut, at = all_words(texts)
        coded, n = cut.dictionary_encode(), len(texts)
        names, id_ = coded.dictionary, coded.indices.to_numpy()
        tokens = pc.index_in(names, value_set=self.words).fill_null(-1).to_numpy()[id_]
        where = np.flatnonzero(tokens < 0)
        row = np.searchsorted(at, where, side="right") - 1
        pairs, place = np.unique(row * max(1, len(names)) + id_[where], return_inverse=True)  # of a text and a word
        of, word = np.divmod(pairs, max(1, len(names)))
        own = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
        tokens[where] = own[row] - 1 - place
        seq, ends = np.full(len(tokens) + n, self.end, np.int32), at + np.arange(n + 1)
        inner = np.ones(len(seq), bool)
        inner[ends[1:] - 1] = False
        seq[inner] = tokens
        words = names.take(pa.array(word))
        lists = [(ends, pa.array(seq)), (own, words), (own, pa.array(classes_of(words, self.classes)))]
        return tuple(pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), x) for o, x in lists)


@dataclass(frozen=True)
class Ranks:
    """What the training needs of the vocabulary: the symbols of the ranks and the end, and the names beyond the head."""

    symbol: np.ndarray
    head: int
    names: pa.BinaryArray


def _lists(column: pa.Array, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """Values and row offsets, from 0, of lists or of the bytes of numbers."""
    if not pa.types.is_binary(column.type):
        offsets = column.offsets.to_numpy()
        return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    values = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind)
    return values, (offsets - offsets[0]) // values.itemsize


def _bytes(lists: pa.ListArray) -> pa.Array:
    """Lists of numbers as the bytes of these."""
    values, offsets = _lists(lists)
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets * np.int32(values.itemsize)), pa.py_buffer(np.ascontiguousarray(values))])


def gather(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, together of up to `most` tokens or one row: long sequences then share their steps."""
    some, room = [], most
    for b in batches:
        at, (_, offsets) = 0, _lists(b.column("seq"))
        while at < b.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + room, side="right")) - 1
            end = max(end, at + (not some))
            if end > at:
                some.append(b.slice(at, end - at))
                room -= int(offsets[end] - offsets[at])
                at = end
            if at < b.num_rows or room <= 0:
                yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
                some, room = [], most
    if some:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _split(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _dense(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from 0 to n-1 that occur in x, and the place of each of x among them."""
    place = np.zeros(n, np.int32)
    place[x] = 1
    used = np.flatnonzero(place)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, place[x]


def _uncommon(tokens: np.ndarray, offsets: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where uncommon words stand, and the places of these words among all rows' uncommon words. own: their row offsets."""
    at = np.flatnonzero(tokens < 0)
    row = np.searchsorted(offsets, at, side="right") - 1
    return at, own[row] - 1 - tokens[at]


def score(docs: DataFrame, train_when: Column, held_out: Column, config: Config = Config()) -> DataFrame:
    """docs: doc_id, text. A row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    c, spark = config, docs.sparkSession
    stage = Stage(spark, "hmm")
    texts = docs.select("doc_id", train_when.alias("teach"), held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, rows = [], 0
        for b in split_batches(batches, 1 << 14):
            some.append(counted(b.column("text")))
            rows += some[-1].num_rows
            if rows > c.flush:
                some = [pa.concat_tables(some).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])]
                rows = some[0].num_rows
            if rows > c.flush:
                yield from some.pop().to_batches()
                rows = 0
        for t in some:
            yield from t.to_batches()

    counts = texts.filter("teach").select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = stage.write(counts, "counts")
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    total, different, ends = size["n"] or 0, size["v"], size["ends"] or 0
    words = counts.filter(F.length("word") > 0).withColumn("level", F.floor(F.log2("c") * 64).cast("int"))
    level = reach = 0
    for r in words.groupBy("level").count().orderBy(F.desc("level")).collect():  # 64 rows for a doubling of counts
        reach += r["count"]
        if reach > c.common:
            level = r["level"] + 1
            break
    first = words.orderBy(F.desc("c"), "word").limit(c.head).select("word", "c").toArrow()
    more = words.filter(F.col("level") >= level).select("word", "c").toArrow()  # at most `common` rows
    count_of = {w: n for t in (more, first) for w, n in zip(t["word"].to_pylist(), t["c"].to_pylist(), strict=True)}
    top = sorted(count_of, key=lambda w: (-count_of[w], w))
    head = first.num_rows
    sums, kinds = np.zeros(c.classes), np.zeros(c.classes)
    for r in words.groupBy(_class(F.col("word"), c.classes).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # `classes` rows
        sums[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    for w in top[:head]:
        k = class_of(w, c.classes)
        sums[k], kinds[k] = sums[k] - count_of[w], kinds[k] - 1
    shares = np.concatenate([[count_of[w] for w in top[:head]], sums + 1, [max(ends, 1)]])
    shares /= shares.sum()
    gain = np.log10(np.array([*(count_of[w] for w in top), ends], float) + 1)
    known = Vocabulary(top, c, head)
    vocabulary = spark.sparkContext.broadcast(known)  # `common` + `head` words at most

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches, 1 << 14):
            seqs, own, kind = vocabulary.value.encode(b.column("text"))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "teach", "held_out")), _bytes(seqs), own, _bytes(kind)], [x.split()[0] for x in CODED.split(", ")])

    ranks = spark.sparkContext.broadcast(Ranks(known.symbol, head, pa.array(top[head:], pa.binary())))
    coded = stage.write(texts.mapInArrow(encode, CODED).withColumn("row", F.monotonically_increasing_id()), "coded")

    model, learned = initial(shares, c), None
    for round_ in range(c.rounds if total else 0):
        last = round_ == c.rounds - 1
        taught = coded.filter("teach").select("seq", "kinds", *(["words"] if last else []))
        model, learned = _round(taught, model, shares, ranks, c, stage if last else None)
    unknown = words.select("word", "c", F.lit(0).cast("long").alias("q")).limit(0) if learned is None else learned
    states = range(c.states)
    step = [F.shiftrightunsigned("q", 8 * s).bitwiseAND(F.lit(255)).cast("double") for s in states]
    by_class = unknown.groupBy(_class(F.col("word"), c.classes).alias("k")).agg(*(F.sum(F.col("c") * step[s] / sum(step[1:], step[0])).alias(f"s{s}") for s in states))
    share = np.full((c.classes, c.states), 1 / c.states)
    for r in by_class.collect():  # `classes` rows
        own = np.array([r[f"s{s}"] for s in states])
        share[r["k"]] = own / own.sum()
    by = Classes(model.emit[head : head + c.classes], share, sums, kinds)
    table = _common_emissions(unknown.filter(F.floor(F.log2("c") * 64) >= level), top, head, count_of, by, model)
    common = spark.sparkContext.broadcast((model, table, by, gain, known.end))
    base_unit = float(np.log10(total + different + 1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table, by, gain, end = common.value
        for t in _documents(batches, c.together // 2):
            k = t.column("k").to_numpy()
            text = k < 0
            docs = t.filter(pa.array(text)).combine_chunks().to_batches()[0]
            (tokens, at), (kind, own) = _lists(docs.column("seq")), _lists(docs.column("kinds"), np.int16)
            count, packed = np.zeros(len(kind)), np.zeros(len(kind), np.int64)
            place = (np.repeat(own[:-1], np.diff(np.append(np.flatnonzero(text), len(k)))) + k)[~text]
            count[place], packed[place] = (t.column(x).to_numpy()[~text] for x in ("c", "q"))
            where, which = _uncommon(tokens, at, own)
            gains = gain[np.where(tokens < 0, 0, tokens)]
            gains[where] = np.log10(count[which] + 1)
            length = np.diff(at)
            base = np.add.reduceat(gains, at[:-1]) - base_unit * length
            del gains
            seen = np.ones(len(tokens), np.int64)
            seen[where] = count[which] > 0
            seen[tokens == end] = ends > 0
            n_known = np.add.reduceat(seen, at[:-1])
            del seen
            used, seqs = _dense(np.where(tokens < 0, end, tokens), len(table))
            seqs[where] = len(used) + which
            emit = np.empty((len(used) + len(kind), len(model.first)))
            emit[: len(used)] = table[used]
            for x in range(0, len(kind), c.piece):
                some = slice(x, x + c.piece)
                emit[len(used) :][some] = by.emissions(kind[some], count[some], packed[some])
            p = likelihood(Model(model.first, model.move, emit), _split(seqs, at), c) if total else base
            made = [pa.array(length.astype(np.int64)), pa.array(n_known), pa.array(np.full(docs.num_rows, total)), pa.array(base), pa.array(p)]
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), *made], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rest = unknown.filter(F.floor(F.log2("c") * 64) < level).select("word", "c", "q")
    asked = coded.select("row", F.posexplode("words").alias("k", "word"))
    found = asked.join(rest, "word").select("row", "k", "c", "q")
    zero = F.lit(0).cast("long")
    whole = coded.select("row", F.lit(-1).alias("k"), zero.alias("c"), zero.alias("q"), "doc_id", "held_out", "seq", "kinds")
    whole = whole.unionByName(found, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "k").drop("row")
    return whole.mapInArrow(judge, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _documents(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """Rows of whole documents, each one's text (k = -1) before its words, together of up to `most` tokens."""
    some, size = [], 0
    for b in batches:
        some.append(b)
        size += len(_lists(b.column("seq"))[0])
        if size >= most:
            t = pa.Table.from_batches(some)
            last = int(np.flatnonzero(t.column("k").to_numpy() < 0)[-1])  # its words may go on in the next batch
            if last:
                yield t.slice(0, last)
            some = t.slice(last).combine_chunks().to_batches()
            size = len(_lists(some[0].column("seq").slice(0, 1))[0])
    if some and (t := pa.Table.from_batches(some)).num_rows:
        yield t


def _common_emissions(rows: DataFrame, top: list[bytes], head: int, count_of: dict[bytes, int], by: Classes, model: Model) -> np.ndarray:
    """Emissions of the common words by rank, then the end's."""
    found = rows.select("word", "q").toArrow()  # at most `common` rows
    packed = dict(zip(found["word"].to_pylist(), found["q"].to_pylist(), strict=True))
    kind = np.array([class_of(w, len(by.emit)) for w in top[head:]], np.int64)
    count, q = (np.array([x[w] if w in x else 0 for w in top[head:]], np.int64) for x in (count_of, packed))
    return np.concatenate([model.emit[:head], by.emissions(kind, count.astype(float), q), model.emit[-1:]])


def _round(taught: DataFrame, model: Model, shares: np.ndarray, ranks, c: Config, stage: Stage | None) -> tuple[Model, DataFrame | None]:
    """One pass of Baum-Welch. Tasks send (symbol, expected count by state); negative symbols hold the rest. With a stage,
    they send (word, its count, expected count by state) of the words beyond the head too, of uncommon ones for each group
    of rows; their table is written and returned as word, c, q."""
    m = taught.sparkSession.sparkContext.broadcast(model)
    k, symbols, by_word = c.states, len(model.emit), stage is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = ranks.value, m.value
        first, move, emit, any_ = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emit), False
        common = _Common(k, v.names, c.piece) if by_word else None
        for b in gather(batches, c.together // (2 if by_word else 1)):
            (tokens, at), (kind, rows) = _lists(b.column("seq")), _lists(b.column("kinds"), np.int16)
            where, which = _uncommon(tokens, at, rows)
            seqs = v.symbol[np.where(tokens < 0, 0, tokens)]
            seqs[where] = v.head + kind[which]
            if by_word:
                beyond = np.flatnonzero((tokens >= v.head) & (tokens < len(v.symbol) - 1))
                used, place = _dense(tokens[beyond] - v.head, len(v.names))
                own = b.column("words").flatten().dictionary_encode()
                ids, id_ = own.dictionary, own.indices.to_numpy()[which]
                mid = symbols + len(used)
                of = np.arange(mid + len(ids), dtype=np.int32)
                of[symbols + place], of[mid + id_] = seqs[beyond], seqs[where]
                seqs[beyond], seqs[where] = symbols + place, mid + id_
                f, a, e = expect(model, _split(seqs, at), c, of=of)
                common.add(used, np.bincount(place, minlength=len(used)), e[symbols:mid])
                yield from _sent_words(ids, np.bincount(id_, minlength=len(ids)), e[mid:], c.piece)
                for s in range(k):
                    emit[:, s] += np.bincount(of, weights=e[:, s], minlength=symbols)
                if common.tokens >= 1 << 23:
                    yield from common.take()
            else:
                f, a, e = expect(model, _split(seqs, at), c)
                emit += e
            first, move, any_ = first + f, move + a, True
        if any_:
            if by_word:
                yield from common.take()
            used = np.flatnonzero(emit.any(axis=1))
            rows = np.concatenate([first[None], move, emit[used]])
            yield _sent(np.concatenate([-1 - np.arange(k + 1), used]), None, rows)

    sent = taught.mapInArrow(run, SENT)
    if by_word:
        sums = sent.repartition("symbol", "word").sortWithinPartitions("word", "symbol").mapInArrow(_summed(k), "symbol long, word binary, c long, q long, v binary")
        sums = stage.write(sums, "learned")
    else:
        sums = sent
    parts = sums.filter("symbol IS NOT NULL")
    if not by_word:
        parts = parts.repartition("symbol").sortWithinPartitions("symbol").mapInArrow(_summed(k), "symbol long, word binary, c long, q long, v binary")
    summed = parts.select("symbol", "v").toArrow()  # symbols + states rows
    symbol = summed["symbol"].to_numpy()
    values = np.frombuffer(b"".join(summed["v"].to_pylist())).reshape(-1, k)
    emit = np.zeros_like(model.emit)
    emit[symbol[symbol >= 0]] = values[symbol >= 0]
    rest = {int(s): v for s, v in zip(symbol, values, strict=True) if s < 0}
    learned = sums.filter("symbol IS NULL").select("word", "c", "q") if by_word else None
    return improve(rest[-1], np.stack([rest[-2 - s] for s in range(k)]), emit, shares, c), learned


SENT = "symbol long, word binary, v binary"
"""v: expected counts by state of a symbol, in double precision; or a word's count and then its expected counts, in single
precision, in which a task's counts, of fewer than 2**24 tokens of a word, are exact."""


def _sent(symbol: np.ndarray | None, word: pa.Array | list[bytes] | None, rows: np.ndarray) -> pa.RecordBatch:
    rows = np.ascontiguousarray(rows, np.float64 if word is None else np.float32)
    size = rows.shape[1] * rows.itemsize
    v = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)), pa.py_buffer(rows)])
    columns = [pa.nulls(len(rows), kind) if x is None else pa.array(x, kind) for x, kind in ((symbol, pa.int64()), (word, pa.binary()))]
    return pa.RecordBatch.from_arrays([*columns, v], ["symbol", "word", "v"])


def _sent_words(words: pa.Array, count: np.ndarray, expected: np.ndarray, piece: int) -> Iterator[pa.RecordBatch]:
    for x in range(0, len(words), piece):
        yield _sent(None, words[x : x + piece], np.column_stack([count[x : x + piece], expected[x : x + piece]]))


class _Common:
    """A task's counts and expected counts of the common words beyond the head, by rank."""

    def __init__(self, states: int, names: pa.BinaryArray, piece: int) -> None:
        self.names, self.piece, self.tokens = names, piece, 0
        self.count, self.sums = np.zeros(len(names), np.int64), np.zeros((len(names), states))

    def add(self, used: np.ndarray, count: np.ndarray, expected: np.ndarray) -> None:
        self.tokens += int(count.sum())
        self.count[used] += count
        self.sums[used] += expected

    def take(self) -> Iterator[pa.RecordBatch]:
        used = np.flatnonzero(self.count)
        for x in range(0, len(used), self.piece):
            some = used[x : x + self.piece]
            yield from _sent_words(self.names.take(pa.array(some)), self.count[some], self.sums[some], self.piece)
        self.tokens, self.count[:], self.sums[:] = 0, 0, 0


def _summed(states: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums of rows that are sorted by word and symbol: symbols with v, words with c and q. One key's sum is held, whatever
    the number of its rows. The word comes first because Spark's sort compares the first column's first 8 bytes before it
    looks at the rows themselves, and nearly all rows are words'."""

    def out(symbol, word, rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        if word is None:
            columns = [symbol, pa.nulls(len(rows), pa.binary()), none, none, _sent(None, None, rows).column("v")]
        else:
            columns = [none, word, pa.array(np.rint(rows[:, 0]).astype(np.int64)), pa.array(pack(rows[:, 1:])), pa.nulls(len(rows), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["symbol", "word", "c", "q", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # key column of one row, sums, whether it is a word
        for b in batches:
            words = b.column("symbol").is_null().to_numpy(zero_copy_only=False)
            for is_word in (False, True):  # nulls come first
                part = b.filter(pa.array(words == is_word))
                if not part.num_rows:
                    continue
                key = part.column("word" if is_word else "symbol")
                rows = np.frombuffer(b"".join(part.column("v").to_pylist()), np.float32 if is_word else np.float64).reshape(-1, states + is_word).astype(np.float64)
                if held is not None and held[2] == is_word:
                    key, rows = pa.concat_arrays([held[0], key]), np.concatenate([held[1], rows])
                elif held is not None:
                    yield out(*((None, held[0]) if held[2] else (held[0], None)), held[1])
                code = key.dictionary_encode().indices.to_numpy()
                starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
                sums, keys = np.add.reduceat(rows, starts), key.take(pa.array(starts))
                held = (keys.slice(len(keys) - 1), sums[-1:], is_word)
                if len(sums) > 1:
                    yield out(*((None, keys[:-1]) if is_word else (keys[:-1], None)), sums[:-1])
        if held is not None:
            yield out(*((None, held[0]) if held[2] else (held[0], None)), held[1])

    return run
