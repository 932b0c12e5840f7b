"""Pieces that the operators share: shared-folder tables, Arrow access, vectorised word hashes."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
"""Bytes hashed at once; a longer run without white space is hashed whole."""

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _local.setdefault(spark.sparkContext.applicationId, f"file://{tempfile.mkdtemp(prefix='sluice-')}")


_local: dict[str, str] = {}
_stages: list[Stage] = []


class Stage:
    """Tables of one run in the shared folder; they cut lineage, and survive a lost executor. They stay while a result may
    still be read from them: until `drop`, `release`, or the end of the driver's process."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if not _stages:
            atexit.register(release)
        _stages.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Deletes a table, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def mark() -> int:
    """A place in the order in which stages began, for `release`."""
    return len(_stages)


def release(since: int = 0, until: int | None = None) -> None:
    """Deletes the tables of the stages that began from one mark to another: what was made of them is written elsewhere, or
    the process ends. A session that has ended leaves its tables to whoever owns the folder."""
    gone, _stages[since:until] = _stages[since:until], []
    for s in gone:
        with contextlib.suppress(Exception):
            s.drop()


class Opened:
    """A table's columns under names of our own, so that no name that an operator makes, and no two names that differ by
    case alone, can clash. `replaced` columns, in any case, are left out. texts: columns that the operator reads, found by
    exact name first, then without regard to case."""

    def __init__(self, docs: DataFrame, replaced: Iterable[str] = ()) -> None:
        gone = {x.lower() for x in replaced}
        self.fields = docs.schema.fields
        self.rows = docs.toDF(*[f"c{k}" for k in range(len(self.fields))])
        self.keep = [k for k, f in enumerate(self.fields) if f.name.lower() not in gone]
        self.names = [f"c{k}" for k in self.keep]

    def place(self, name: str) -> str:
        """Our name of a column of the table."""
        found = [k for k, f in enumerate(self.fields) if f.name == name] or [k for k, f in enumerate(self.fields) if f.name.lower() == name.lower()]
        if len(found) != 1:
            raise ValueError(f"{len(found)} columns are named {name}")
        return f"c{found[0]}"

    def column(self, name: str) -> Column:
        return F.col(self.place(name))

    def schema(self, *added: T.StructField) -> T.StructType:
        return T.StructType([*(T.StructField(f"c{k}", self.fields[k].dataType) for k in self.keep), *added])

    def closed(self, rows: DataFrame, *added: str) -> DataFrame:
        """rows (the kept columns, then others) under the table's own names."""
        return rows.toDF(*(self.fields[k].name for k in self.keep), *added)


def fold(doc_id: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; a null id counts as fold -1, which no split holds out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def unit_hash(doc_id: str, salt: int) -> Column:
    """A number from 0 to 1 that depends on the id alone."""
    return F.pmod(F.xxhash64(F.col(doc_id), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def doc_bytes(column: pa.Array) -> list[bytes]:
    """Each row's bytes; null is empty."""
    return [b"" if x is None else x for x in column.to_pylist()]


def split_batches(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is computed beside a batch stays small whatever Spark sends."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            have[0] = 1
            have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def _hash_slice(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    solid = np.empty(len(data) + 2, bool)
    solid[0] = solid[-1] = False
    np.logical_not(_WHITE[data], out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    n = len(data) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n)[:-1], out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    hashes = (sums[ends] - sums[starts]) * _power(inverse, n)[starts]
    return mix64(hashes ^ ((ends - starts).astype(np.uint64) << np.uint64(48))), starts, ends


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, start and end (bytes) of each word `[^\\x20\\x09-\\x0D]+`, in order."""
    data = np.frombuffer(text, np.uint8)
    if len(data) <= SLICE_BYTES:
        return _hash_slice(data)
    parts, at = [], 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and not _WHITE[data[end]]:
            ahead = np.flatnonzero(_WHITE[data[end : end + SLICE_BYTES]])
            end = end + int(ahead[0]) if len(ahead) else min(len(data), end + SLICE_BYTES)
        h, s, e = _hash_slice(data[at:end])
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` words; a shorter, non-empty text has one of all its words."""
    if len(hashes) == 0:
        return hashes
    width = min(width, len(hashes))
    n = len(hashes) - width + 1
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[k : k + n]
    return mix64(out)
