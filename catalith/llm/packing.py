"""Operator 5: packing by optimal length buckets.

The global histogram of document lengths (in words) decides the buckets: dynamic programming over it finds the
boundaries that minimise padding when every document is padded to its bucket's boundary. Inside a bucket, documents
in id order fill batches of as many documents as the token budget allows at that padded length (at least one).

The histogram is exact. Its size is the number of distinct lengths, which the longest document bounds and the number of
documents doesn't; a programme over n lengths takes n log n steps a bucket, since the best split moves one way only. Numbering inside a bucket is exact:
rows are dealt by ranges of (bucket, id), and a document's place is the number of its bucket's documents in the ranges
before its own plus its place in its range. Ties are split by row, so a third of all rows with one id is several ranges.

Defined cases. Null and blank texts have length 0 and are padded to the first boundary. A document longer than the
budget forms a batch of its own; nothing is cut or dropped. Repeated rows are packed once each. Null ids come last; rows with equal ids,
null ids included, follow one another in the order of their lengths. Columns besides doc_id and text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, stored, table

BUCKETS = 16
TOKEN_BUDGET = 32768


def _splits(tail: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """For each j the first i <= j with the least tail[i] - size[j] * before[i].

    The best i never falls as j rises. So the middle of every gap between known places is sought between the best i of
    its neighbours, for all gaps at once."""
    n = len(size)
    pick = np.zeros(n, dtype=np.int64)
    step = 1 << n.bit_length()
    while step := step >> 1:
        j = np.arange(step, n + 1, 2 * step) - 1
        lo = np.where(j >= step, pick[np.maximum(j - step, 0)], 0)
        hi = np.minimum(np.where(j + step < n, pick[np.minimum(j + step, n - 1)], n), j)
        width = hi - lo + 1
        starts = np.cumsum(width) - width
        gap = np.repeat(np.arange(len(j)), width)
        i = np.arange(width.sum()) - starts[gap] + lo[gap]
        cost = tail[i] - size[j][gap] * before[i]
        least = np.flatnonzero(cost == np.minimum.reduceat(cost, starts)[gap])
        pick[j] = i[least[np.searchsorted(gap[least], np.arange(len(j)))]]
    return pick


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """The upper bounds of at most `buckets` groups of neighbouring lengths with the least total padded length."""
    n = len(lengths)
    if n == 0:
        return []
    size = lengths.astype(np.int64)
    before = np.concatenate([[0], np.cumsum(counts.astype(np.int64))])
    best = size * before[1:]
    choice = [np.zeros(n, dtype=np.int64)]
    for _ in range(1, min(buckets, n)):
        # the last bucket holds lengths i..j; the ones before it hold 0..i-1
        tail = np.concatenate([[0], best[:-1]])
        pick = _splits(tail, size, before)
        best = tail[pick] + size * (before[1:] - before[pick])
        choice.append(pick)
    out, j = [], n - 1
    for pick in reversed(choice):
        out.append(int(lengths[j]))
        if (i := int(pick[j])) == 0:
            break
        j = i - 1
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_tokens, batch and slot for every row."""
    n = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = materialise(docs.select(F.col("doc_id").cast("long"), n.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    seen = rows.groupBy("n_tokens").agg(F.count("*").alias("n")).orderBy("n_tokens").toArrow()
    bounds = boundaries(seen["n_tokens"].to_numpy(), seen["n"].to_numpy(), buckets) or [0]
    shapes = F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(b).cast("long").alias("padded_tokens"), F.lit(max(1, budget // max(1, b))).cast("long").alias("capacity")) for k, b in enumerate(bounds)])
    place = F.aggregate(F.array(*[F.lit(b).cast("long") for b in bounds]), F.lit(0), lambda k, b: k + (b < F.col("n_tokens")).cast("int"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("n_tokens"), F.col("row")]
    rows = rows.withColumn("shape", F.element_at(shapes, place + 1)).select("doc_id", "n_tokens", "row", "shape.*")
    dealt = materialise(rows.repartitionByRange(F.col("bucket"), *order).withColumn("range", F.spark_partition_id()), "ranges")
    # ranges follow one another, so there are at most as many (bucket, range) pairs as partitions and buckets together
    sizes = dealt.groupBy("bucket", "range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("bucket").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("bucket", "range").orderBy(*order)))
    ranked = ranked.join(F.broadcast(offsets), ["bucket", "range"]).withColumn("index", F.col("before") + F.col("rank") - 1)
    return ranked.select("doc_id", "n_tokens", "bucket", "padded_tokens", F.expr("index div capacity").alias("batch"), F.expr("index % capacity").alias("slot"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "packed", lambda: pack(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """The same programme, split by split, over all pairs of lengths."""
    levels = ["k1 AS (SELECT j, 0 AS i, size * upto AS cost FROM s)"]
    for k in range(2, BUCKETS + 1):
        levels.append(f"""k{k} AS MATERIALIZED (SELECT j, best.i AS i, best.cost AS cost FROM (SELECT s.j, min({{'cost': coalesce(p.cost, 0) + s.size * (s.upto - b.before), 'i': b.j}}) AS best
  FROM s JOIN s b ON b.j <= s.j LEFT JOIN k{k - 1} p ON p.j = b.j - 1 GROUP BY s.j))""")
    back = [f"e{BUCKETS} AS (SELECT max(j) AS j FROM s)"]
    for k in range(BUCKETS, 1, -1):
        back.append(f"e{k - 1} AS (SELECT k.i - 1 AS j FROM k{k} k JOIN e{k} USING (j) WHERE k.i > 0)")
    ends = " UNION ".join(f"SELECT j FROM e{k}" for k in range(1, BUCKETS + 1))
    newline = ",\n"
    return f"""WITH d AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
h AS (SELECT n_tokens AS size, count(*) AS c FROM d GROUP BY n_tokens),
s AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY size) - 1 AS BIGINT) AS j, size, CAST(sum(c) OVER (ORDER BY size) AS BIGINT) AS upto, CAST(sum(c) OVER (ORDER BY size) - c AS BIGINT) AS before FROM h),
{newline.join(levels)},
{newline.join(back)},
bounds AS (SELECT CAST(row_number() OVER (ORDER BY size) - 1 AS INT) AS bucket, size AS padded_tokens, greatest(1, {TOKEN_BUDGET} // greatest(1, size)) AS capacity, lag(size, 1, -1) OVER (ORDER BY size) AS below FROM s WHERE j IN ({ends})),
p AS (SELECT doc_id, n_tokens, bucket, padded_tokens, capacity, row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS LAST, n_tokens) - 1 AS x FROM d JOIN bounds ON n_tokens > below AND n_tokens <= padded_tokens)
SELECT doc_id, n_tokens, bucket, padded_tokens, x // capacity AS batch, x % capacity AS slot FROM p"""


SQL = {"op5_packing": _sql()}
