"""Operator 6: exact duplicates by a tree-merge of sorted digest runs.

Every input partition sorts its (digest, row) entries and becomes one run per digest range, cut into pieces. In rounds, the runs
of `radix` neighbours in a binomial tree (radix = 2**k merges k binary rounds at once) exchange their pieces per digest range. Pieces
arrive in order of their first entries; what lies below the next piece's first entry is final, so a merge holds about one
piece of each run at a time, collapses equal digests to the smallest identifier seen, and passes on a sorted run again, until each range has one run.
Only first entries are compared by the exchange; entries are never sorted anew. No task holds all digests.

Defined cases. Null text counts as empty. Ids sort with nulls last. Rows that repeat an id with an equal text tie;
one of them (the earliest stored) stays. An empty table gives no rows. Columns besides the two named are not read.
Equality is verified at every level by SHA-256 together with the normalised byte length and an independent 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, materialise, stored, table

RADIX = 16
PIECE_ROWS = 8192
_KEY = ["digest", "n_bytes", "check"]
_PIECE = "rng int, run int, first binary, n int, entries binary"
# an entry: 32 bytes of digest as big-endian words, byte length, hash; then whether it has no id, the id, the row, and how many rows it stands for
_DIGEST, _SAME, _WIDTH = 4, 6, 10


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _entries(batch: pa.RecordBatch) -> np.ndarray:
    """Rows of unsigned numbers that compare as the entries do."""
    out = np.empty((batch.num_rows, _WIDTH), dtype=np.uint64)
    out[:, :_DIGEST] = np.frombuffer(b"".join(x.as_py() for x in batch["digest"]), dtype=">u8").reshape(-1, _DIGEST)
    no_id = np.asarray(batch["id"].is_null())
    signed = [batch["n_bytes"], batch["check"], no_id, batch["id"].fill_null(0), batch["rid"], np.ones(batch.num_rows)]
    for k, x in enumerate(signed, _DIGEST):
        out[:, k] = np.asarray(x).astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    return out


def _number(column: np.ndarray) -> np.ndarray:
    return (column ^ np.uint64(1 << 63)).view(np.int64)


def _below(entries: np.ndarray, digest: np.ndarray) -> int:
    """How many of sorted entries have a digest smaller than this one."""
    lo, hi = 0, len(entries)
    for k in range(_DIGEST):
        part = entries[lo:hi, k]
        lo, hi = lo + int(np.searchsorted(part, digest[k], "left")), lo + int(np.searchsorted(part, digest[k], "right"))
    return lo


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a come before those of b."""
    less, same = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    for k in range(_WIDTH - 1):
        less |= same & (a[:, k] < b[:, k])
        same &= a[:, k] == b[:, k]
    return less


def _collapse(runs: list[np.ndarray]) -> np.ndarray:
    """Merge sorted runs; of entries with one key the first stays and counts for all."""
    t = np.concatenate(runs)
    if len(runs) > 1:
        t = t[np.lexsort(t[:, _WIDTH - 2 :: -1].T)]
    if not len(t):
        return t
    first = np.flatnonzero(np.concatenate([[True], (t[1:, :_SAME] != t[:-1, :_SAME]).any(axis=1)]))
    n = np.add.reduceat(_number(t[:, -1].copy()), first)
    t = t[first]
    t[:, -1] = n.view(np.uint64) ^ np.uint64(1 << 63)
    return t


def _pieces(rng: int, run: int, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(entries), PIECE_ROWS):
        part = entries[at : at + PIECE_ROWS]
        row = [[rng], [run], [part[0, :_DIGEST].astype(">u8").tobytes()], [len(part)], [part.tobytes()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()), strict=True)], names=["rng", "run", "first", "n", "entries"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key (and so by range) become pieces of runs; equal keys collapse."""
    now, held = None, np.empty((0, _WIDTH), dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        rng, run, rows = batch["rng"].to_numpy(), batch["run"].to_numpy(), _entries(batch)
        starts = np.flatnonzero(np.concatenate([[True], (rng[1:] != rng[:-1]) | (run[1:] != run[:-1]) | _less(rows[1:], rows[:-1])]))
        for lo, hi in zip(starts, [*starts[1:], len(rng)], strict=True):
            key = int(rng[lo]), int(run[lo])
            # parts of a file may also come in another order; then one is a run of its own
            if now is not None and (key != now or len(held) and _less(rows[lo : lo + 1], held[-1:])[0]):
                yield from _pieces(*now, _collapse([held]))
                held = held[:0]
            now, held = key, np.concatenate([held, rows[lo:hi]])
            if len(held) > 2 * PIECE_ROWS:
                held = _collapse([held])
                done = len(held) - 1  # the last key may go on
                yield from _pieces(*now, held[:done])
                held = held[done:]
    if now is not None:
        yield from _pieces(*now, _collapse([held]))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (range, run, first entry) become pieces of one run for each (range, run)."""
    now, open_, ready, held = None, [], [], 0

    def out() -> Iterator[pa.RecordBatch]:
        if ready:
            yield from _pieces(*now, _collapse(ready))

    for batch in batches:
        for rng, run, first, raw in zip(*(batch[c].to_pylist() for c in ("rng", "run", "first", "entries")), strict=True):
            if (rng, run) != now:
                ready += [x for x in open_ if len(x)]
                yield from out()
                now, open_, ready, held = (rng, run), [], [], 0
            digest = np.frombuffer(first, dtype=">u8").astype(np.uint64)
            for k, x in enumerate(open_):
                n = _below(x, digest)
                if n:
                    ready.append(x[:n])
                    open_[k] = x[n:]
                    held += n
            open_ = [x for x in open_ if len(x)]
            open_.append(np.frombuffer(raw, dtype=np.uint64).reshape(-1, _WIDTH))
            if held >= PIECE_ROWS:
                yield from out()
                ready, held = [], 0
    ready += open_
    yield from out()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for run, raw in zip(batch["run"].to_pylist(), batch["entries"].to_pylist(), strict=True):
            t = np.frombuffer(raw, dtype=np.uint64).reshape(-1, _WIDTH)
            digest = t[:, :_DIGEST].astype(">u8").tobytes()
            n_bytes, check, no_id, i, rid, n = (_number(t[:, k].copy()) for k in range(_DIGEST, _WIDTH))
            columns = [np.full(len(t), run, dtype=np.int32), pa.array([digest[k : k + 32] for k in range(0, len(digest), 32)], pa.binary()), n_bytes.astype(np.int32), check, pa.array(i, mask=no_id.astype(bool)), rid, n]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=["run", *_KEY, "keep_id", "keep_rid", "group_size"])


def _unpacked(pieces: DataFrame) -> DataFrame:
    return pieces.select("run", "entries").mapInArrow(_rows, "run int, digest binary, n_bytes int, check long, keep_id long, keep_rid long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = RADIX, row_col: str | None = None) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and rid (`row_col`, or a number given here)."""
    text = normalised(F.col(text_col))
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), rid.alias("rid")).select(
        "id",
        F.unhex(F.sha2(F.col("t"), 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
        F.spark_partition_id().alias("run"),
        "rid",
    )
    order = [*_KEY, F.col("id").asc_nulls_last(), "rid"]
    rows = materialise(rows.sortWithinPartitions(*order), "digests")  # no exchange: each partition sorts what it has
    left = (rows.agg(F.max("run")).first()[0] or 0) + 1
    ranges = max(1, min(left, 1 << 12))
    # the first two digest bytes choose the range: digests are uniform, so ranges are even
    head = F.conv(F.substring(F.hex("digest"), 1, 4), 16, 10).cast("int")
    leaves = rows.withColumn("rng", (head * F.lit(ranges) / F.lit(65536)).cast("int"))
    leaves = materialise(leaves.mapInArrow(_runs, _PIECE), "runs")
    runs = leaves
    while runs is leaves or left > 1:
        left = -(-left // radix)
        dealt = runs.withColumn("run", (F.col("run") / F.lit(radix)).cast("int")).repartition("rng", "run")
        runs = materialise(dealt.sortWithinPartitions("rng", "run", "first").mapInArrow(_merged, _PIECE), "merged")
    # way back: each run learns the result for its own digests, then each row that of its run; a digest that holds a
    # third of the rows meets the result once a run
    per_run = _unpacked(leaves).select(*_KEY, "run").distinct().join(_unpacked(runs).drop("run"), _KEY)
    return rows.join(per_run, [*_KEY, "run"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), "rid",
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "exact-groups", lambda: exact_groups(table(spark, sf_dir, "documents")).drop("rid"))


SQL = {
    "op6_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
}
