"""Shared helpers: shared scratch tables, skew-safe joins, byte-level text features, a linear model."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where that is unset and all runs in this one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="catalith-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/catalith/{what}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialise(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` to a table in the shared folder and read it again: lineage ends there, and a lost executor
    costs no recomputation. The shuffle files of this one write are removed as soon as it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The scratch folders written so far and not yet removed, oldest first."""
    return list(_written)


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove scratch folders (all by default). Call it once the results that read them are stored."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for text in written() if paths is None else paths:
        if text in _written:
            _written.remove(text)
            path = jvm.org.apache.hadoop.fs.Path(text)
            path.getFileSystem(conf).delete(path, True)


class Scratch:
    """What is written between the beginning and the end of a `with` block; `release` removes it, but for what is kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.before = set(_written)
        return self

    def __exit__(self, *_) -> None:
        self.paths = [x for x in _written if x not in self.before]

    def release(self) -> None:
        release(self.spark, self.paths)


def stored(spark: SparkSession, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of `build` as a stored table, all other tables that it wrote being removed. For results that are small
    beside the tables they come from."""
    with Scratch(spark) as left:
        out = build()
    out = materialise(out, what)
    left.release()
    return out


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def labelled_ids(labels: DataFrame, label: str, rows: int, where: Callable[[Column], Column] | None = None) -> DataFrame:
    """At most `rows` labelled ids (_id, y), those with the smallest hashes; the greatest of several labels of an id counts."""
    picked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where("_id is not null and y in (0, 1)")
    if where is not None:
        picked = picked.where(where(F.col("_id")))
    return picked.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(rows)


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(doc_id, text, y) of picked ids, one row of each: that whose text has the smallest hash. The ids have a stated bound, so they are broadcast, and only
    their texts are shuffled."""
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "_id")
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")
    return found.groupBy("_id").agg(F.max("y").alias("y"), one).select(F.col("_id").alias("doc_id"), "one.text", "y")


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join of `left` with `right`, whose `key` is unique, when one key may hold a third of left's rows.

    `spread` deals the rows of a key over as many parts as there are shuffle partitions (64 at least). First the few (key, part) pairs meet the unique side,
    then each part of the rows meets its own pair, so no task gets more than a part. `left` is read twice:
    hand in a stored table. Null keys match nothing."""
    salts = max(64, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = left.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    pairs = salted.select(key, "_part").distinct().join(right, key)
    return salted.join(pairs, [key, "_part"], "left").drop("_part")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with one function per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty, without decoding."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    for x in column:
        yield x.as_py() or b""


# --- byte-level features -------------------------------------------------------------------------------------

_rng = np.random.Generator(np.random.PCG64(20240501))
_DEPTH = 16
_CODE = _rng.integers(1, 2**63, size=(256, _DEPTH), dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.ones(256, dtype=bool)
_LETTER[:128] = [chr(c).isalnum() for c in range(128)]
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(raw: bytes, letters: bool = True, heads: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the lower-cased words of a text and, for each number in `heads`, of their first so many bytes.

    Words are runs of letters, digits and non-ASCII bytes, or, without `letters`, runs of non-blanks. A word's
    hash is a sum of random codes by byte and place (places from 16 on share one)."""
    b = _LOWER[np.frombuffer(raw, dtype=np.uint8)]
    inside = _LETTER[b] if letters else ~_BLANK[b]
    at = np.flatnonzero(inside)
    if not len(at):
        none = np.empty(0, dtype=np.uint64)
        return [none] * (1 + len(heads))
    first = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    place = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
    code = _CODE.ravel()[b[at].astype(np.intp) * _DEPTH + np.minimum(place, _DEPTH - 1)]
    return [np.add.reduceat(code, first), *(np.add.reduceat(np.where(place < n, code, np.uint64(0)), first) for n in heads)]


def gram_hashes(raw: bytes, n: int) -> np.ndarray:
    """Hashes of the overlapping n-byte grams of a text as it stands (n up to 8)."""
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint64)
    if len(b) < n:
        return np.empty(0, dtype=np.uint64)
    h = b[: len(b) - n + 1].copy()
    for i in range(1, n):
        h <<= np.uint64(8)
        h |= b[i : len(b) - n + 1 + i]
    return h


def slot(h: np.ndarray, bits: int) -> np.ndarray:
    """Spread 64-bit hashes over 2**bits places."""
    return ((h * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


# --- logistic regression -------------------------------------------------------------------------------------

PART_ROWS = 256


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit_logistic(rows: Iterable[tuple[np.ndarray, np.ndarray]], target: np.ndarray, dims: int, l2: float, steps: int = 60) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse rows (places, values) against probabilities, by L-BFGS.

    Only places that occur get a parameter. Without rows the model is all zero. Rows are read once and kept in parts
    of `PART_ROWS`, so that a gradient needs working memory for one part only."""
    parts, used, rows = [], np.zeros(dims, dtype=bool), iter(rows)
    for lo in range(0, len(target), PART_ROWS):
        own = list(islice(rows, min(PART_ROWS, len(target) - lo)))
        at = np.concatenate([i for i, _ in own])
        used[at] = True
        parts.append((target[lo : lo + len(own)], [len(i) for i, _ in own], at.astype(np.int32), np.concatenate([v for _, v in own])))
    if not parts:
        return np.zeros(dims, dtype=np.float32), 0.0
    places = np.flatnonzero(used)
    d = len(places)
    rank = np.cumsum(used, dtype=np.int32) - 1
    for _, _, at, _ in parts:
        at[:] = rank[at]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        value_of, grad = 0.5 * l2 * (p[:d] @ p[:d]), np.append(l2 * p[:d], 0.0)
        for aim, sizes, at, value in parts:
            of = np.repeat(np.arange(len(aim)), sizes)
            z = np.bincount(of, weights=value * p[at], minlength=len(aim)) + p[d]
            gap = sigmoid(z) - aim
            value_of += np.logaddexp(0, z).sum() - aim @ z
            grad[:d] += np.bincount(at, weights=value * gap[of], minlength=d)
            grad[d] += gap.sum()
        return value_of, grad

    p = np.zeros(d + 1)
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            alphas.append(a)
            q -= a * y
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).sum())
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        slope, t = -(g @ q), 1.0
        if slope >= 0 or np.abs(g).max() < 1e-5 * len(target):
            break
        while True:
            f2, g2 = loss(p - t * q)
            if f2 <= f + 1e-4 * t * slope or t < 1e-8:
                break
            t /= 2
        s, y = -t * q, g2 - g
        p, done, f, g = p + s, f - f2 < 1e-7 * abs(f), f2, g2
        if s @ y > 1e-12:
            past = [*past[-7:], (s, y)]
        if done:
            break
    weights = np.zeros(dims, dtype=np.float32)
    weights[places] = p[:d]
    return weights, float(p[d])
