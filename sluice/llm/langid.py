"""Operator 8, language ID: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed byte n-grams (2 to 4 bytes, ASCII letters lower-cased, any
run of white space as one space) and of `neutral` zero vectors, so that a few letters prove little; a linear layer and a
softmax give the languages' probabilities. Embeddings and layer are trained by stochastic gradient descent in numpy. A
temperature, fitted on rows that training leaves aside, calibrates the probability; a text whose probability is below
`floor` is rejected, where `floor` is the `reject` quantile of the probabilities of rightly predicted calibration rows,
and `floor_cap` at most.

Training sees a bounded sample of the labelled texts: `per_lang` different texts of each language in expectation, and
`examples` in all where the languages are many, chosen by a hash of the text, so that copies, repeated ids and null ids
count once. Every language that labels name is learned. Prediction sees every whole text. Because mean and linear layer
commute, prediction needs one score per language and n-gram bucket: its model is `buckets` x languages floats, whatever
the corpus.

Null texts and texts without a letter: `und`, score 0, rejected. Repeated rows are predicted alike. Empty table:
empty result; no labelled row: everything is `und` and rejected. Other columns pass through; those that clash with
lang_pred, score or rejected, in any case, are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Opened, doc_bytes, split_batches

ORDERS = (2, 3, 4)
UND = "und"


@dataclass(frozen=True)
class Config:
    buckets: int = 1 << 13
    dim: int = 16
    per_lang: int = 600
    examples: int = 6000
    steps: int = 900
    batch: int = 32
    rate: float = 10.0
    neutral: float = 8.0
    decay: float = 1e-6
    holdout: float = 0.25
    reject: float = 0.001
    floor_cap: float = 0.4
    seed: int = 8


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    scores: np.ndarray  # buckets x languages, embeddings times layer
    bias: np.ndarray
    temperature: float
    floor: float
    neutral: float


def grams(text: bytes, buckets: int) -> np.ndarray:
    """How often each bucket occurs among the text's n-grams."""
    data = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", np.uint8)
    shift, counts = np.uint32(33 - buckets.bit_length()), np.zeros(buckets, np.int64)
    for at in range(0, len(data), SLICE_BYTES):
        part = data[at : at + SLICE_BYTES + max(ORDERS) - 1].astype(np.uint32)
        code = part
        for order in range(2, max(ORDERS) + 1):
            code = code[:-1] * np.uint32(0x01000193) + part[order - 1 :]
            if order in ORDERS:
                own = code[: max(0, min(SLICE_BYTES, len(data) - at - order + 1))]
                counts += np.bincount((own * np.uint32(0x9E3779B1)) >> shift, minlength=buckets)
    return counts


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Rows:
    """Sparse rows: row k has the buckets and shares from at[k] to at[k + 1]."""

    at: np.ndarray
    bucket: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> Rows:
        bucket, share = (np.concatenate([x.flatten().to_numpy() for x in rows[n].chunks]) for n in ("bucket", "share"))
        size = np.concatenate([x.value_lengths().to_numpy() for x in rows["bucket"].chunks])
        return cls(np.append(0, np.cumsum(size)), bucket.astype(np.min_scalar_type(int(bucket.max()))), share)

    def taken(self, order: np.ndarray) -> Rows:
        size = np.diff(self.at)[order]
        at = np.append(0, np.cumsum(size))
        place = np.arange(at[-1]) - np.repeat(at[:-1] - self.at[order], size)
        return Rows(at, self.bucket[place], self.share[place])

    def dense(self, some: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros((len(some), buckets), np.float32)
        for k, i in enumerate(some):
            own = slice(self.at[i], self.at[i + 1])
            out[k, self.bucket[own]] = self.share[own]
        return out


def fit(x: Rows, y: np.ndarray, aside: np.ndarray, langs: tuple[str, ...], c: Config) -> Model:
    """x: n-gram shares by row; y: index of the language; aside: rows kept for calibration."""
    rng = np.random.default_rng(c.seed)
    emb = rng.normal(0, 0.5, (c.buckets, c.dim)).astype(np.float32)
    layer, bias = np.zeros((c.dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    rows = np.flatnonzero(~aside)
    if not len(rows):
        rows = np.arange(len(y))
    queue = np.zeros(0, np.int64)
    for step in range(c.steps):
        if len(queue) < c.batch:
            queue = np.concatenate([queue, rng.permutation(rows)])
        some, queue = queue[: c.batch], queue[c.batch :]
        rate, part = c.rate * (1 - step / c.steps), x.dense(some, c.buckets)
        mean = part @ emb
        err = _softmax(mean @ layer + bias)
        err[np.arange(len(some)), y[some]] -= 1
        err /= len(some)
        down = mean.T @ err
        used = np.flatnonzero(part.any(axis=0))
        emb[used] -= rate * (part[:, used].T @ (err @ layer.T))
        layer -= 0.05 * rate * (down + c.decay * layer)
        bias -= 0.01 * rate * err.sum(axis=0)
    scores = emb @ layer
    kept = np.flatnonzero(aside) if aside.any() else rows
    z = np.concatenate([x.dense(kept[k : k + 256], c.buckets) @ scores + bias for k in range(0, len(kept), 256)])
    heats = np.geomspace(0.05, 20, 60)
    doubt = 1 / (len(kept) + len(langs))  # as if one more row had been wrong
    loss = []
    for t in heats:
        p = np.log(np.maximum(_softmax(z / t), 1e-30))
        loss.append(-(doubt * p.sum(axis=1) + (1 - doubt * len(langs)) * p[np.arange(len(kept)), y[kept]]).mean())
    heat = float(heats[int(np.argmin(loss))])
    p = _softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[kept]]
    floor = min(c.floor_cap, float(np.quantile(right, c.reject))) if len(right) else c.floor_cap
    return Model(langs, scores.astype(np.float32), bias, heat, floor, c.neutral)


def train(docs: DataFrame, train_when: Column, config: Config = Config()) -> Model:
    """docs: doc_id, text, lang; only rows of `train_when` with a language and a text teach."""
    c = config
    key = F.xxhash64("text", F.lit(c.seed))
    labelled = docs.filter(train_when & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", key.alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row for each language
    langs = tuple(sorted(r["lang"] for r in sizes))
    if not langs:
        return Model((), np.zeros((c.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, c.floor_cap, c.neutral)
    each = min(c.per_lang, max(1, c.examples // len(langs)))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, each / max(1, r["n"])))])
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.filter(unit < share[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    aside = F.pmod(F.xxhash64("h", F.lit(c.seed + 1)), F.lit(1 << 30)) / float(1 << 30) < c.holdout
    buckets, neutral = c.buckets, c.neutral

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            found = [grams(t, buckets) for t in doc_bytes(b.column("text"))]
            used = [np.flatnonzero(f) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(n) for n in ("lang", "h", "aside")),
                    pa.array([u.astype(np.int32) for u in used], pa.list_(pa.int32())),
                    pa.array([(f[u] / (f.sum() + neutral)).astype(np.float32) for f, u in zip(found, used, strict=True)], pa.list_(pa.float32())),
                ],
                ["lang", "h", "aside", "bucket", "share"],
            )

    rows = (
        picked.select(F.col("text").cast("binary").alias("text"), "lang", "h", aside.alias("aside"))
        .mapInArrow(featurise, "lang string, h long, aside boolean, bucket array<int>, share array<float>")
        .toArrow()
    )
    if not rows.num_rows:
        return Model((), np.zeros((c.buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, c.floor_cap, c.neutral)
    x = Rows.of(rows)
    sort = np.lexsort((rows["h"].to_numpy(), rows["lang"].to_pylist()))  # the same order however tasks end
    x = x.taken(sort)
    rows = rows.select(["lang", "aside"]).take(pa.array(sort))
    pa.default_memory_pool().release_unused()
    order = {v: i for i, v in enumerate(langs)}
    y = np.array([order[v] for v in rows["lang"].to_pylist()], np.int64)
    return fit(x, y, np.array(rows["aside"].to_pylist(), bool), langs, c)


ADDED = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and rejected; the text alone decides."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    t = Opened(docs, ADDED)
    names = t.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        buckets, langs = len(model.scores), np.array([*model.langs, UND], object)
        for b in split_batches(batches):
            ok = np.array(b.column("letter").to_pylist(), bool) & bool(model.langs)
            z = np.zeros((b.num_rows, max(1, len(model.langs))))
            if model.langs:
                for i, t in enumerate(doc_bytes(b.column("raw"))):
                    if ok[i]:
                        n = grams(t, buckets)
                        z[i] = (n @ model.scores) / (n.sum() + model.neutral) + model.bias
            p = _softmax(z / model.temperature)
            best = np.where(ok, p.argmax(axis=1), len(model.langs))
            score = np.where(ok, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(n) for n in names),
                    pa.array(langs[best], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(~ok | (score < model.floor)),
                ],
                [*names, *ADDED],
            )

    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    text = t.column("text")
    rows = t.rows.select(*names, text.cast("binary").alias("raw"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return t.closed(rows.mapInArrow(run, t.schema(*map(T.StructField, ADDED, kinds))), *ADDED)
