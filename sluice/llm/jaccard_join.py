"""Operator 5, n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of `width`-word windows (words `[^\\x20\\x09-\\x0D]+`, as they are; a shorter text is one window).
The join finds all pairs of different texts with Jaccard similarity of at least `threshold`.

1. Equal texts are a class, found by SHA-256; everything below sees each class once.
2. A scan takes bands * rows MinHash values of every text; texts that share a band are joined to the bucket's least
   node (a star, never all pairs), and connected components of the stars hold all candidate pairs.
3. A component is dealt into blocks of bounded count and bytes; each pair of blocks is a task's group. A component of
   several blocks may instead be dealt by its buckets, each into its own blocks, where that sends fewer texts: similar
   texts share most buckets, and one component is the shorter way; texts that only chains of chance hits hold together
   share few, and then no text is sent more often than `bands` times, however large the component. In a group all pairs
   (of a bucket: those that share no earlier bucket, so a pair counts once) are compared by `step` MinHash values at a
   time. With a uniform prior, after n values with m equal the similarity reaches the threshold with probability
   P(Binomial(n + 1, threshold) <= m); a pair below `tolerance` is dropped.
4. The rest are verified exactly on their sets of windows (64-bit hashes of the words). A group gives each text's
   number of links and its least linked node, so output is linear in texts, however many pairs link.
5. Components of the verified links are the groups.

Words are hashed to 64 bits; two windows of one component are confused with probability 2**-64 each.

Null texts are alone in their class. Texts without words share a class if they are equal and have no links. Rows that
repeat an id and a text are copies; an id with different texts has a row for each. A null id is kept; class and group
ids are the least non-null id, or null. An empty table gives an empty result. Other columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Opened, Stage, mix64, split_batches, windows, words


@dataclass(frozen=True)
class Config:
    width: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5
    step: int = 25
    tolerance: float = 1e-6
    block_docs: int = 512
    block_bytes: int = 4 << 20
    seed: int = 5


def family(c: Config) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(c.seed)
    a, b = rng.integers(0, 1 << 63, (2, c.bands * c.rows), np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minhash(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """32-bit MinHash values of a non-empty set."""
    out = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        x = shingles[at : at + 2048, None] * a
        x += b
        np.minimum(out, x.min(axis=0) >> np.uint64(32), out=out)
    return out.astype(np.uint32)


def band_keys(sig: np.ndarray, c: Config) -> np.ndarray:
    rows = sig.reshape(c.bands, c.rows).astype(np.uint64)
    key = np.arange(1, c.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(c.rows):
        key = mix64(key ^ rows[:, k])
    return key.view(np.int64)


def least_matches(c: Config) -> dict[int, int]:
    """After n values compared, the number of equal ones that keeps a pair."""
    out = {}
    for n in range(c.step, c.bands * c.rows + 1, c.step):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * c.threshold**m * (1 - c.threshold) ** (n + 1 - m)
            if tail >= c.tolerance:
                break
            m += 1
        out[n] = m
    return out


def candidates(sig: np.ndarray, left: np.ndarray, right: np.ndarray, c: Config, bucket: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs left[k], right[k], those that no comparison drops; in a bucket, of those whose first common one it is."""
    need, kept = least_matches(c), []
    keys = None if bucket is None else np.stack([band_keys(x, c) for x in sig])
    for at in range(0, len(left), 1 << 15):
        i, j = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
        if keys is not None:
            first = (keys[i] == keys[j]).argmax(axis=1)
            own = (keys[i, first] == bucket) & (keys[j, first] == bucket)
            i, j = i[own], j[own]
        same = np.zeros(len(i), np.int64)
        for n in sorted(need):
            part = slice(n - c.step, n)
            same += (sig[i, part] == sig[j, part]).sum(axis=1)
            alive = same >= need[n]
            i, j, same = i[alive], j[alive], same[alive]
        kept.append((i, j))
    return tuple(np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (left, right)


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one by one if few, else by blocked matrix products."""
    if len(left) <= 20 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    total = np.zeros((len(sets), len(sets)), np.float32)  # counts below 2**24 are exact
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        a, b = np.searchsorted(column, (first, first + 2048))
        m = np.zeros((len(sets), 2048), np.float32)
        m[owner[a:b], column[a:b] - first] = 1
        total += m @ m.T
    return total[left, right].astype(np.int64)


def links(nodes: np.ndarray, side: np.ndarray | None, texts: list[bytes], c: Config, bucket: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of a group of texts: each one's number of links and the least node that links lead to. side: in a group of two
    blocks, whether a text is of the first; only pairs across count then. bucket: the band's key that made the group, if
    one did."""
    sets = [np.unique(windows(words(t)[0], c.width)) for t in texts]
    a, b = family(c)
    sig = np.stack([minhash(s, a, b) for s in sets])
    if side is None:
        left, right = np.triu_indices(len(sets), 1)
    else:
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        left, right = np.repeat(one, len(two)), np.tile(two, len(one))
    left, right = candidates(sig, left, right, c, bucket)
    size = np.array([len(s) for s in sets])
    both = common_counts(sets, left, right)
    ok = both >= c.threshold * (size[left] + size[right] - both) - 1e-9
    left, right = left[ok], right[ok]
    n = np.bincount(left, minlength=len(sets)) + np.bincount(right, minlength=len(sets))
    least = nodes.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, left, before[right])
        np.minimum.at(least, right, least[left])
        if (least == before).all():
            return n, least


def _dealt_anew(centres: DataFrame) -> DataFrame:
    """u, m as they are, but planned without the partitioning of the aggregate below: the join then has an exchange on
    either side, and Spark can split the partition of a large star among tasks."""
    return centres.select(F.bitwise_not(F.bitwise_not("u")).alias("u"), "m")


def components(stage: Stage, edges: DataFrame, name: str) -> DataFrame:
    """node, root (the component's least node) of every node of the edges a, b, by alternating large and small stars.
    Each round is a written table; a star's centre is joined, not grouped, so that no task must hold its members."""
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    now, round_, last = stage.write(ends, f"{name}0"), 0, None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last, round_ = state, round_ + 1
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(_dealt_anew(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(_dealt_anew(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage.write(small.union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), f"{name}{round_}")
        stage.drop(f"{name}{round_ - 1}")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def classes(docs: DataFrame, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. First doc_id and key (SHA-256, null for a null text) of every document; then a row for each key:
    class_id (least id of the equal texts), n_copies (their number), n_links (other texts that are similar), group_id
    (least id that links and copies lead to)."""
    c, spark = config, docs.sparkSession
    stage = Stage(spark, "jaccard")
    if c.bands * c.rows % c.step:
        raise ValueError("step must divide bands * rows")
    keyed = docs.select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("key", F.unhex(F.sha2("text", 256)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = family(c)
        for batch in split_batches(batches):
            keys, sizes = [], []
            for t in batch.column("text").to_pylist():
                s = windows(words(t)[0], c.width) if t else ()
                keys.append(band_keys(minhash(s, a, b), c) if len(s) else np.zeros(0, np.int64))
                sizes.append(len(t or b""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc_id", "key", "size", "bands"],
            )

    sketches = stage.write(keyed.mapInArrow(sketch, "doc_id long, key binary, size long, bands array<long>"), "sketches")
    nodes = (
        sketches.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = stage.write(nodes, "nodes")  # from here on a node's number is fixed

    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.min("node").alias("root"), F.max("node").alias("last")).filter("root < last").drop("last")
    stars = bands.join(buckets, "band").select(F.col("node").alias("a"), F.col("root").alias("b"))
    members = components(stage, stars, "candidates")

    def blocks(n: str, size: str) -> Column:
        return F.greatest(F.ceil(F.col(n) / c.block_docs), F.ceil(F.col(size) / c.block_bytes), F.lit(1)).cast("int")

    known = members.join(nodes.select("node", "key", "class_id", "size"), "node")
    extent = known.groupBy("root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("blocks", blocks("n", "bytes"))
    large = known.join(extent.filter("blocks > 1").select("root"), "root").join(bands, "node")
    buckets = large.groupBy("root", "band").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).filter("n > 1").withColumn("blocks", blocks("n", "bytes"))
    sent = buckets.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("sent"))
    extent = stage.write(extent.join(sent, "root", "left").select("root", "blocks", (F.col("sent") < F.col("n") * F.col("blocks")).alias("by_bucket")), "extent")
    whole = known.join(extent.filter("NOT coalesce(by_bucket, FALSE)"), "root").withColumn("bucket", F.lit(None).cast("long"))
    parts = large.join(extent.filter("by_bucket").select("root"), "root").join(buckets.select("root", "band", "blocks"), ["root", "band"])
    dealt_nodes = whole.select("node", "root", "bucket", "blocks", "key", F.col("class_id").alias("doc_id")).unionByName(
        parts.select("node", "root", F.col("band").alias("bucket"), "blocks", "key", F.col("class_id").alias("doc_id"))
    )
    placed = dealt_nodes.withColumn("block", F.pmod(F.xxhash64("node", F.lit(c.seed)), "blocks").cast("int"))
    both = (placed["key"] == keyed["key"]) & placed["doc_id"].eqNullSafe(keyed["doc_id"])
    dealt = (
        placed.join(keyed, both)
        .select("node", "root", "bucket", "block", "blocks", "text")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("root", "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "text")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            nodes = np.array([r[0] for r in group], np.int64)
            _, bucket, lo, hi = key
            side = None if lo == hi else np.array([r[1] == lo for r in group])
            n, least = links(nodes, side, [r[2] for r in group], c, bucket)
            some = n > 0
            return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (nodes, n, least)], ["node", "n_links", "least"])

        group, key = [], None
        for batch in batches:
            for *k, block, node, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if k != key:
                    if len(group) > 1:
                        yield done()
                    group, key = [], k
                if not group or group[-1][0] != node:
                    group.append((node, block, text))
        if len(group) > 1:
            yield done()

    order = ["root", "bucket", "lo", "hi"]
    found = dealt.repartition(*order).sortWithinPartitions(*order, "block", "node")
    found = stage.write(found.mapInArrow(verify, "node long, n_links long, least long"), "links")
    groups = components(stage, found.select(F.col("node").alias("a"), F.col("least").alias("b")), "groups")
    named = groups.join(nodes.select("node", "class_id"), "node")
    first = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
    info = (
        nodes.select("node", "key", "class_id", "n_copies")
        .join(found.groupBy("node").agg(F.sum("n_links").alias("n_links")), "node", "left")
        .join(groups.join(first, "root").select("node", "group_id"), "node", "left")
        .select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )
    return sketches.select("doc_id", "key"), info


def join(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs: doc_id, text. A row for each document: doc_id, class_id, n_copies, n_links, group_id as in `classes`."""
    ids, info = classes(docs, config)
    own = F.col("key").isNull()
    return ids.join(info, "key", "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(own, F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"),
    )


def keep_one(docs: DataFrame, config: Config = Config()) -> DataFrame:
    """docs, all columns: of each group the document with the least id. Null texts all stay. Of rows with equal id and text
    the one stays whose other columns come first as JSON."""
    t = Opened(docs)
    id_, text = t.column("doc_id"), t.column("text")
    info = classes(t.rows.select(id_.alias("doc_id"), text.alias("text")), config)[1]
    chosen = info.filter(F.col("class_id").eqNullSafe(F.col("group_id"))).select(F.col("class_id").alias("chosen_id"), F.col("key").alias("chosen"), "n_copies")
    keyed = t.rows.filter(text.isNotNull()).withColumn("key", F.unhex(F.sha2(text.cast("binary"), 256)))
    kept = keyed.join(chosen, (F.col("key") == F.col("chosen")) & id_.eqNullSafe(F.col("chosen_id")))
    others = [n for n in t.names if n not in (t.place("doc_id"), t.place("text"))]
    first = F.to_json(F.struct(*others)) if others else F.lit("")
    several = kept.filter("n_copies > 1").groupBy("chosen", "chosen_id").agg(F.min_by(F.struct(*t.names), first).alias("row"))
    out = kept.filter("n_copies = 1").select(*t.names).unionByName(several.select(*[F.col(f"row.{n}").alias(n) for n in t.names]))
    return t.closed(out.unionByName(t.rows.filter(text.isNull())))
