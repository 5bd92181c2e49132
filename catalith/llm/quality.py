"""Operator 8: quality rules.

A logistic regression on hashed word and character n-grams, trained on rows labelled for quality, its scores
calibrated to probabilities on rows it was not trained on, and applied in Arrow batches against fixed thresholds.
Besides it stand the base rules: at least 50 words, and at most half of them in repeated three-word windows.

Training reads at most `SAMPLE_ROWS` labelled rows (a documented bound; the smallest hashed ids, one row of an id), so
the data sent to the driver and the broadcast model have fixed sizes. Scoring reads every row and whole texts.

Defined cases. Null text counts as no words (rejected by the base rules). A null label or a label of an absent
document is not used; of conflicting labels of one id the better one counts. Of rows that repeat an id, the one whose text has the smallest hash is
read. Every row is scored, repeated ones too. Columns with other names are not read. With no usable labels, or only one class, every text that passes the base rules is kept.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fit_logistic, gram_hashes, labelled_ids, map_arrow, raw_texts, sigmoid, slot, table, texts_of, word_hashes

SAMPLE_ROWS = 4096
BITS = 16
SCALE = 40.0
L2 = 0.5
KEEP_AT = 0.5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def places(raw: bytes) -> np.ndarray:
    """Hashed places of a text's words, word pairs, and 2- and 4-byte grams (each kind salted)."""
    (w,) = word_hashes(raw, letters=False)
    pairs = w[:-1] * np.uint64(31) + w[1:]
    kinds = [w, pairs ^ np.uint64(0xA5A5A5A5), gram_hashes(raw, 2) + np.uint64(1 << 40), gram_hashes(raw, 4) + np.uint64(1 << 41)]
    return np.concatenate([slot(h, BITS) for h in kinds])


def sparse(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the places in a text, times SCALE."""
    at, n = np.unique(places(raw), return_counts=True)
    return at, (n * (SCALE / max(1, n.sum()))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Weights, bias, and the calibration's slope and offset."""

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [sparse(raw) for raw in raw_texts(batch["text"])]
        return pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "y": batch["y"], "at": pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())), "v": pa.array([v for _, v in rows], pa.list_(pa.float32()))})

    got = map_arrow(texts_of(docs, labelled_ids(labels, "quality", sample_rows)), features, "doc_id long, y int, at array<int>, v array<float>").toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable")
    y = got["y"].to_numpy()[order].astype(float)
    if len(set(y)) < 2:
        return {"w": np.zeros(1 << BITS, dtype=np.float32), "b": 0.0, "slope": 0.0, "offset": 30.0}
    at, v = got["at"], got["v"]
    rows = [(np.asarray(at[i].values), np.asarray(v[i].values)) for i in order.tolist()]
    held = np.arange(len(y)) % 5 == 0
    w, b = fit_logistic((r for r, h in zip(rows, held, strict=True) if not h), y[~held], 1 << BITS, L2)
    z = np.array([w[i] @ x + b for (i, x), h in zip(rows, held, strict=True) if h])
    # Platt's targets keep the calibration finite when the classes are separated
    pos, neg = y[held].sum(), (1 - y[held]).sum()
    aim = np.where(y[held] == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    cal, offset = fit_logistic([(np.array([0]), np.array([x])) for x in z], aim, 1, 1e-3)
    return {"w": w, "b": b, "slope": max(float(cal[0]), 1e-3), "offset": offset}


def probability(raw: bytes, model: dict) -> float:
    at = places(raw)
    z = model["b"] + (SCALE * float(model["w"][at].mean()) if len(at) else 0.0)
    return float(sigmoid(np.array(model["slope"] * z + model["offset"])))


def base_counts(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = raw.split()  # bytes.split() cuts at \x20 and \x09-\x0D
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen: dict = {}
    if len(set(windows)) == len(windows):
        return n, chars, symbols, dup, 0
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    twice = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    inside = np.zeros(n, dtype=bool)
    for k in range(3):
        inside[k : k + len(twice)] |= twice
    return n, chars, symbols, dup, int(inside.sum())


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def score(docs: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, p = [], []
        for raw in raw_texts(batch["text"]):
            counts.append(base_counts(raw))
            p.append(probability(raw, shared.value))
        c = np.array(counts, dtype=np.int64)
        failed = np.array([base_failed(x[0], x[4]) for x in counts])
        p = np.array(p)
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c[:, k]) for k in range(5)), pa.array(failed), pa.array(~failed & (p >= keep_at)), pa.array(p)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), judge, SCHEMA)


def keep_good(docs: DataFrame, model: dict, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of `docs`, all columns as they are, that pass the base rules and the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = []
            for raw in raw_texts(batch["text"]):
                n, _, _, _, rep = base_counts(raw)
                mask.append(not base_failed(n, rep) and probability(raw, shared.value) >= keep_at)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
