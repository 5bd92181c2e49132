"""Operator 2: toxicity by weak supervision.

Voters, each of which fires on a text or not: the words of a fixed lexicon of insults; words and word beginnings whose document
frequency differs most between the labelled classes, whatever the language; patterns (shouting, repeated punctuation, direct
address); and one that fires where no word does. A generative label model is fitted by expectation maximisation to the votes of labelled and unlabelled texts alike: the class prior, how often each
voter fires in each class (its accuracy follows), and a tree of correlations, in which a voter's firing also depends on its parent's,
so that voters that repeat each other are not counted twice. Only voters that fire are evidence: each language has insults of its own, so a
silent voter mostly shows that a text is in another one. Given labels choose the mined words, begin the
iteration, and stand behind each rate as `SEED_ROWS` rows of prior. On its own row a given label is evidence too, right as often as the model
finds, at most `TRUST`: without it, words that only some toxic texts of a language share are lost (README has the figures). The
posterior labels train a linear classifier on hashed words and word beginnings, which scores every whole text.

Training reads at most `SAMPLE_ROWS` labelled and `UNLABELLED_ROWS` other rows (documented bounds: the smallest hashed ids, one row of an
id), never those whose crc32(doc_id) mod 5 is 0. No score reads labels, lang, source or doc_id.

Defined cases. Null and empty texts have no words and get the classifier's bias. Null labels and labels of absent
documents are not used; of conflicting labels of one id, or of equal texts, toxic counts. Of rows that repeat an id, the one whose text has the smallest
hash is read; equal texts are one observation. Every row is scored, repeated ones too. Columns with other names are not read. With no
usable labels, or only one class, the fixed lexicon alone decides. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, fit_logistic, labelled_ids, map_arrow, materialise, raw_texts, sigmoid, slot, table, texts_of, word_hashes

SAMPLE_ROWS = 8192
UNLABELLED_ROWS = 4096
SEED_ROWS = 100.0
TRUST = 0.98
MINED = 200
MIN_G = 12.0
LEAST_PRECISION = 0.9
HEADS = (4, 6)
BITS = 18
L2 = 0.05
LEAST_TEXTS = 3
VOTER_SCALE = 5.0
FOLDS = 5
LEXICON = frozenset("bastard bitch clown damn disgusting dumb fool freak garbage idiot imbecile jerk loser moron pathetic pig scum stupid trash ugly worthless".split())
PATTERNS = (
    ("shouted words", re.compile(rb"(?:\b[A-Z]{3,}\b[^a-z]{0,3}){3}")),
    ("repeated exclamation marks", re.compile(rb"!{2,}")),
    ("direct address", re.compile(rb"(?i)\byou (?:are|re|all)\b")),
    ("symbols for letters", re.compile(rb"[A-Za-z][*$@#]{2,}")),
)
_CUT = re.compile(rb"[^0-9a-z\x80-\xff]+")


def tokens(raw: bytes) -> set[str]:
    """The distinct lower-cased words of a text, and their beginnings marked with a star."""
    words = {w.decode("utf-8", "ignore") for w in set(_CUT.split(raw.lower())) if w}
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in HEADS))


WORDS = sorted(LEXICON)


def voters(mined: list[str]) -> list[str]:
    return [*WORDS, *(name for name, _ in PATTERNS), *mined, "no word"]


def votes(raw: bytes, mined: list[str]) -> np.ndarray:
    """The voters that fire on a text."""
    have = tokens(raw)
    words = [*(w in have for w in WORDS)], [*(t in have for t in mined)]
    fired = [*words[0], *(p.search(raw) is not None for _, p in PATTERNS), *words[1], not any(words[0]) and not any(words[1])]
    return np.flatnonzero(fired).astype(np.int32)


def places(raw: bytes) -> np.ndarray:
    kinds = word_hashes(raw, heads=HEADS)
    return np.unique(slot(np.concatenate([h + np.uint64(k << 40) for k, h in enumerate(kinds)]), BITS))


def voter_places(found: list[str]) -> np.ndarray:
    """Where the classifier keeps words and, where it keeps them at all, word beginnings."""
    out = []
    for t in found:
        raw = t.rstrip("*").encode()
        kinds = word_hashes(raw, heads=HEADS)
        out += [h + np.uint64(k << 40) for k, h in enumerate(kinds) if (k == 0) != t.endswith("*") and (k == 0 or len(raw) == HEADS[k - 1])]
    return slot(np.concatenate(out), BITS)


def mine(sample: DataFrame, count: int = MINED) -> list[str]:
    """The tokens whose document frequencies differ most between toxic and other rows, by the log-likelihood ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, y in zip(raw_texts(batch["text"]), batch["y"].to_pylist(), strict=True):
                if found := sorted(tokens(raw)):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([y] * len(found), pa.int32())], names=["token", "y"])

    size = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    if not size["n"] or size["t"] in (0, size["n"]):
        return []
    t, n = float(size["t"]), float(size["n"])
    seen = sample.select("text", "y").mapInArrow(run, "token string, y int").groupBy("token").agg(F.sum("y").cast("double").alias("a"), F.count("*").cast("double").alias("d"))
    a, d = F.col("a"), F.col("d")

    def term(got, expected):
        return F.when(got > 0, got * F.log(got / expected)).otherwise(0.0)

    # log-likelihood ratio (G squared) of the two-by-two table of token and class
    g = 2 * (term(a, d * t / n) + term(d - a, d * (n - t) / n) + term(t - a, (n - d) * t / n) + term(n - t - d + a, (n - d) * (n - t) / n))
    top = seen.where("a >= 2").withColumn("g", g).where((F.col("g") > MIN_G) & (a / d > LEAST_PRECISION)).orderBy(F.desc("g"), "token").limit(count)
    return [r["token"] for r in top.collect() if r["token"] not in LEXICON]


class LabelModel:
    """The class prior, and each voter's rate of firing by class and by whether its parent fires.

    The tree of parents is a maximum spanning forest of the mutual information between voters given the class; a voter without
    a parent has the same rate whatever others do."""

    LEAST_INFORMATION = 20.0

    def __init__(self, v: np.ndarray, given: np.ndarray, alone: tuple[int, ...] = (), rounds: int = 50) -> None:
        """Votes (rows x voters, 0 or 1), given labels (1, 0, or nan), and the voters that stay out of the tree."""
        seed = ~np.isnan(given)
        start = np.where(seed, np.where(given == 1, TRUST, 1 - TRUST), np.nanmean(given))
        self.right = np.array([TRUST, TRUST])  # how often a given label is right, by class
        self.parent = self._tree(v, start, alone)
        up = self._parents(v)
        self.behind = self._rates(v[seed], up[seed], start[seed], 0.5)
        self.share = float(np.clip(given[seed].mean(), 0.01, 0.99))
        p = start
        for _ in range(rounds):
            self.prior = float((p.sum() + SEED_ROWS * self.share) / (len(p) + SEED_ROWS))
            self.rate = self._rates(v, up, p, self.behind, SEED_ROWS)
            same = [((p if y else 1 - p)[seed] * (given[seed] == y)).sum() for y in (0, 1)]
            total = [(p if y else 1 - p)[seed].sum() for y in (0, 1)]
            self.right = np.minimum((np.array(same) + TRUST * SEED_ROWS) / (np.array(total) + SEED_ROWS), TRUST)
            new = self.posterior(v, given)
            done = np.abs(new - p).max() < 1e-4
            p = new
            if done:
                break

    def _parents(self, v: np.ndarray) -> np.ndarray:
        """Whether the parent of each voter fires."""
        return np.where(self.parent >= 0, v[:, np.maximum(self.parent, 0)], 0)

    @staticmethod
    def _rates(v: np.ndarray, up: np.ndarray, p: np.ndarray, behind, rows: float = 2.0) -> np.ndarray:
        """P(fires | class, parent) with `rows` rows of prior at the rates `behind`."""
        out = np.empty((2, 2, v.shape[1]))
        for y, w in enumerate((1 - p, p)):
            for state in (0, 1):
                held = w[:, None] * (up == state)
                prior = behind if np.isscalar(behind) else behind[y, state]
                out[y, state] = ((held * v).sum(axis=0) + rows * prior) / (held.sum(axis=0) + rows)
        return np.clip(out, 1e-5, 1 - 1e-5)

    def _tree(self, v: np.ndarray, start: np.ndarray, alone: tuple[int, ...]) -> np.ndarray:
        m = v.shape[1]
        info = np.zeros((m, m))
        states = [(v == a).astype(float) for a in (0, 1)]
        for weight in (start, 1 - start):
            n = weight.sum() + 4
            ones = [(weight @ x + 2) / n for x in states]
            for x, px in zip(states, ones, strict=True):
                for z, pz in zip(states, ones, strict=True):
                    q = ((x * weight[:, None]).T @ z + 1) / n
                    info += n * q * np.log(q / (px[:, None] * pz[None, :]))
        info[list(alone), :] = info[:, list(alone)] = -1.0
        parent, best, origin, inside = np.full(m, -1), np.full(m, -1.0), np.full(m, -1), np.zeros(m, dtype=bool)
        for _ in range(m):
            k = int(np.argmax(np.where(inside, -np.inf, best)))
            parent[k] = origin[k] if best[k] > self.LEAST_INFORMATION else -1
            inside[k] = True
            better = ~inside & (info[k] > best)
            best[better], origin[better] = info[k][better], k
        return parent

    def posterior(self, v: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
        """How likely each row is toxic by its votes and, if handed in, its given label."""
        up = self._parents(v)
        logs = []
        for y, prior in enumerate((1 - self.prior, self.prior)):
            rate = np.where(up == 1, self.rate[y, 1], self.rate[y, 0])
            logs.append(np.log(prior) + np.where(v == 1, np.log(rate), 0.0).sum(axis=1))
            if given is not None:
                logs[-1] = logs[-1] + np.where(np.isnan(given), 0.0, np.log(np.where(given == y, self.right[y], 1 - self.right[y])))
        return sigmoid(logs[1] - logs[0])

    def accuracy(self, v: np.ndarray) -> np.ndarray:
        """How likely a text is toxic if a voter fires, over the given votes."""
        p = self.posterior(v)
        return (p @ v + self.prior) / (v.sum(axis=0) + 1)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int, unlabelled_rows: int) -> DataFrame:
    """(doc_id, text, y), y being null for rows without a label: each text once."""
    picked = labelled_ids(labels, "toxic", sample_rows, lambda c: crc_mod(c, FOLDS) != 0)
    known = labels.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null")
    others = docs.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").where(crc_mod(F.col("_id"), FOLDS) != 0)
    others = others.join(known, "_id", "left_anti").distinct().orderBy(F.xxhash64("_id"), "_id").limit(unlabelled_rows)
    sample = texts_of(docs, picked.unionByName(others.withColumn("y", F.lit(None).cast("int"))))
    return sample.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y"), F.first("text").alias("text")).drop("digest")


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> dict:
    """The classifier (w, b), with the voters, the label model behind it, and its posteriors beside the given labels."""
    with Scratch(docs.sparkSession) as left:
        sample = materialise(training_rows(docs, labels, sample_rows, unlabelled_rows), "toxic-sample")
    mined = mine(sample.where("y is not null"))

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        raws = list(raw_texts(batch["text"]))
        lists = [[f(raw) for raw in raws] for f in (lambda r: votes(r, mined), lambda r: places(r).astype(np.int32))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["y"], *(pa.array(x, pa.list_(pa.int32())) for x in lists)], names=["doc_id", "y", "fired", "at"])

    got = map_arrow(sample.select("doc_id", "text", "y"), features, "doc_id long, y int, fired array<int>, at array<int>").toArrow()
    left.release()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable").tolist()
    given = got["y"].to_pandas().to_numpy(dtype=float)[order]
    seed = ~np.isnan(given)
    if not mined or len(set(given[seed])) < 2:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[voter_places(WORDS)] = 8.0
        return {"w": w, "b": -4.0, "voters": WORDS, "model": None}
    v = np.zeros((len(order), len(voters(mined))), dtype=np.int8)
    for row, i in enumerate(order):
        v[row, np.asarray(got["fired"][i].values)] = 1
    model = LabelModel(v, given, alone=(v.shape[1] - 1,))
    posterior = model.posterior(v, given)
    at = [np.asarray(got["at"][i].values) for i in order]
    # words of one or two texts say nothing about others; what a voter looks for may weigh more than any other word
    texts = np.zeros(1 << BITS, dtype=np.int32)
    for a in at:
        texts[a] += 1  # a text names a place once
    often = texts >= LEAST_TEXTS
    scale = np.ones(1 << BITS, dtype=np.float32)
    scale[voter_places([*WORDS, *mined])] = VOTER_SCALE
    often |= scale > 1
    w, b = fit_logistic(((x := a[often[a]], scale[x]) for a in at), posterior, 1 << BITS, L2)
    w *= scale
    return {"w": w, "b": b, "voters": voters(mined), "model": model, "given": given, "posterior": posterior, "accuracy": model.accuracy(v)}


def probability(raw: bytes, w: np.ndarray, b: float) -> float:
    return float(sigmoid(np.array(b + float(w[places(raw)].sum()))))


def score(docs: DataFrame, model: dict) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((model["w"], model["b"]))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        p = np.array([probability(raw, *shared.value) for raw in raw_texts(batch["text"])])
        return pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string"))
    return map_arrow(rows, judge, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: dict, at: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score below `at`."""
    shared = docs.sparkSession.sparkContext.broadcast((model["w"], model["b"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([probability(raw, *shared.value) < at for raw in raw_texts(batch["text"])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
