"""Operator 10, quality classifier: nearest-neighbour voting over latent-semantic vectors.

A text's terms are hashed words, hashed 2- and 3-grams of its shape (runs of letters, capitals, digits and white
space as one sign each, other signs as they are), and its share of words that repeat the word before. Term shares
are square-rooted and weighted by inverse document frequency, and projected on the leading right singular vectors
of the labelled rows' matrix. The labelled rows' vectors are broadcast: `examples` x `dim` floats at most, whatever
the corpus. Each block of documents is multiplied with all of them (exact cosines, no index), and the `neighbours`
largest vote with weight cosine**`power`; the score is label 1's share, shrunk towards label 1's share of the
examples by `prior` votes.

Learning takes a bounded sample of the labelled ids, `examples` in expectation, split evenly between the labels
where each has enough and chosen by a hash of the id; votes are re-weighted by the labels' true shares. An id with two
labels is two examples; one with several texts, or the same text often, teaches with the least of them, so repeated rows
do not add to the sample. Scoring sees every whole text.

Null and empty texts have no term, so the prior is their score. Which of equal cosines make the last neighbours
depends on the examples' order alone, which labels and hashes fix. No example: score 0.5. Repeated rows are scored
alike. Other columns pass through; a clashing score or predicted, in any case, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, Opened, doc_bytes, split_batches, unit_hash, words


@dataclass(frozen=True)
class Config:
    word_buckets: int = 512
    shape_buckets: int = 1024
    dim: int = 24
    examples: int = 2000
    neighbours: int = 25
    power: float = 4.0
    prior: float = 0.5
    threshold: float = 0.7
    seed: int = 10


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    basis: np.ndarray  # terms x dim
    vectors: np.ndarray  # examples x dim, unit length
    votes: np.ndarray  # examples x (weight, weight where the label is 1)
    base: float
    config: Config


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("a") : ord("z") + 1] = _SHAPE[128:] = ord("a")
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[[9, 10, 11, 12, 13]] = ord(" ")
_RUN = np.zeros(256, bool)
_RUN[[ord(x) for x in "aA0 "]] = True


def terms(text: bytes, c: Config) -> np.ndarray:
    """Square roots of term shares, by kind of term: words, shape, repeats."""
    out = np.zeros(c.word_buckets + c.shape_buckets + 1, np.float32)
    hashes = words(text)[0]
    if not len(hashes):
        return out
    out[: c.word_buckets] = np.bincount(hashes % np.uint64(c.word_buckets), minlength=c.word_buckets) / len(hashes)
    counts, last = np.zeros(c.shape_buckets), np.zeros(0, np.uint8)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, len(data), SLICE_BYTES):
        part = np.concatenate([last, _SHAPE[data[at : at + SLICE_BYTES]]])
        part = part[np.append(True, (part[1:] != part[:-1]) | ~_RUN[part[1:]])].astype(np.uint32)
        for order in (2, 3):
            if len(part) < order:
                continue
            code = np.zeros(len(part) - order + 1, np.uint32)
            for k in range(order):
                code = code * np.uint32(0x01000193) + part[k : k + len(code)]
            code = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
            counts += np.bincount(code % np.uint32(c.shape_buckets), minlength=c.shape_buckets)
        last = part[-1:].astype(np.uint8)
    out[c.word_buckets : -1] = counts / max(1.0, counts.sum())
    out[-1] = (hashes[1:] == hashes[:-1]).sum() / len(hashes)
    return np.sqrt(out)


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: Config) -> Model:
    """x: terms by example; y: labels; weight: how many labelled rows each example stands for."""
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 0.1
    idf[-1] = 2.0
    z = x * idf
    dim = min(c.dim, *z.shape)
    rng = np.random.default_rng(c.seed)
    q = np.linalg.qr(z @ rng.normal(size=(z.shape[1], min(z.shape[0], z.shape[1], dim + 16))))[0]
    for _ in range(4):
        q = np.linalg.qr(z @ np.linalg.qr(z.T @ q)[0])[0]
    basis = np.linalg.svd(q.T @ z, full_matrices=False)[2][:dim].T
    v = z @ basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    base = float((weight * y).sum() / weight.sum())
    votes = np.stack([weight, weight * y], axis=1)
    return Model(idf.astype(np.float32), basis.astype(np.float32), v.astype(np.float32), votes, base, c)


def vote(x: np.ndarray, m: Model) -> np.ndarray:
    """Scores of a block of documents, from their terms."""
    v = (x * m.idf) @ m.basis
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    near = v @ m.vectors.T
    k = min(m.config.neighbours, near.shape[1])
    best = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
    w = np.maximum(np.take_along_axis(near, best, axis=1), 0).astype(np.float64) ** m.config.power
    scale = m.votes[:, 0].mean()
    all_, ones = (w * m.votes[best, 0]).sum(axis=1) / scale, (w * m.votes[best, 1]).sum(axis=1) / scale
    return (ones + m.config.prior * m.base) / (all_ + m.config.prior)


def train(docs: DataFrame, labels: DataFrame, config: Config = Config()) -> Model | None:
    """docs: doc_id, text; labels: doc_id, label (0 or 1), already restricted to rows that may teach."""
    c = config
    sizes = {r["label"]: r["count"] for r in labels.filter("label in (0, 1)").groupBy("label").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, c.examples / len(sizes) / n))])
    picked = labels.filter(F.col("label").isin(*sizes) & (unit_hash("doc_id", c.seed) < share[F.col("label")]))
    picked = picked.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id IS NOT NULL").distinct()
    few = picked.limit(4 * c.examples + 1).count() <= 4 * c.examples
    small = F.broadcast(picked) if few else picked  # `examples` rows expected

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in split_batches(batches):
            found = [terms(t, c).tobytes() for t in doc_bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("h"), pa.array(found, pa.binary())], ["label", "h", "x"])

    rows = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(small, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
        .select("text", "label", unit_hash("doc_id", c.seed).alias("h"))
        .mapInArrow(featurise, "label int, h double, x binary")
        .toArrow()
    )
    if not rows.num_rows:
        return None
    rows = rows.sort_by([("label", "ascending"), ("h", "ascending"), ("x", "ascending")])
    x = np.stack([np.frombuffer(b, np.float32) for b in rows["x"].to_pylist()])
    y = np.array(rows["label"].to_pylist(), np.float64)
    weight = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
    return fit(x, y, weight, c)


ADDED = ("score", "predicted")


def score(docs: DataFrame, model: Model | None, config: Config = Config()) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score reaches the threshold)."""
    t = Opened(docs, ADDED)
    names = t.names
    if model is None:
        return t.closed(t.rows.select(*names, F.lit(0.5).alias("score"), (F.lit(0.5) >= config.threshold).cast("int").alias("predicted")), *ADDED)
    m = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = m.value
        for b in split_batches(batches, 256):
            s = vote(np.stack([terms(t, model.config) for t in doc_bytes(b.column("raw"))]), model)
            s = np.clip(s, 0, 1)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in names), pa.array(s, pa.float64()), pa.array((s >= model.config.threshold).astype(np.int32))],
                [*names, *ADDED],
            )

    schema = t.schema(T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()))
    return t.closed(t.rows.select(*names, t.column("text").cast("binary").alias("raw")).mapInArrow(run, schema), *ADDED)
