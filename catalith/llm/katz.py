"""Operator 3: language-model scores by Katz back-off, over trigrams unless told otherwise.

Counts come from all training texts. Discounts are Good-Turing for counts up to `TURING`, at every order by its own counts
of counts; the mass they free is handed to unseen events by back-off weights that make every history sum to one exactly. With
h the history and h' the history without its first word:

    P(w | h) = d(c(h, w)) c(h, w) / c(h)                         if (h, w) was seen
             = a(h) P(w | h'),  a(h) = (1 - sum P(seen | h)) / (1 - sum P(seen | h'))   if only h was seen
             = P(w | h')                                         otherwise
    P(w)     = d(c(w)) c(w) / N;  all unknown words share the mass that is left.

A text's beginning stands before its first token as a word that is never predicted.

How it is spread. Texts become blocks: a list of the block's words and the tokens as places in that list. Words are
counted from the block lists and get dense numbers, and each block is told its words' numbers and counts. Then, order by
order, blocks ask for their distinct n-grams whose history was seen. Asked n-grams are dealt by a hash of the history over
buckets, those of frequent histories by the whole n-gram, so that no task gets a whole one. A bucket adds up the training
counts and stores, for each block, the counts of what it asked and, for histories of its unseen n-grams, how their counts are spread: that
table (`lm-grams-n`) is all that the next order and the scoring read. What buckets know of a frequent history is added up in a table by history
and joined back to the blocks that hold it. Blocks evaluate their tokens recursively, lowest order first. Nothing
reaches the driver but sums; every table is stored in the shared folder, and removed once it has been read for the last time.

An exchange sends one piece per block and bucket; blocks and buckets each number with the input, so pieces shrink as it grows. Up to
about a terabyte of text they hold hundreds of n-grams; far beyond, larger blocks (`block_bytes`) keep them so.

Defined cases. Null text is empty: only the end token is scored. Null ids train or are held out like the empty text
id. Repeated rows count and are scored each. Without training texts every token has probability one. Columns other than doc_id and text are not read. A class of
counts for which Good-Turing gives no discount strictly between 0 and 1 is discounted by half a count instead; a
history of which nothing was seen TURING times or less (which thus frees no mass) gives up half a count, and so does a corpus. Word numbers have 32 bits; more distinct
words raise an error.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, join_hot, map_arrow, materialise, raw_texts, stored, table

ORDER = 3
TURING = 5
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 2_000_000
HELD_OUT = (7, 2)
END = b""
UNKNOWN, BEGIN, FIRST = 0, 1, 2  # codes of words: those in training follow by number
MAX_WORDS = 2**32 - FIRST

_BLOCK = "block long, ids array<long>, held array<boolean>, lens array<int>, words array<binary>, counts array<int>, stream binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bigrams long, n_longest long"
# what a block is told. kind 0: itself; 1: its words' numbers and counts; 2: by order and bucket, counts (a) and spreads (b);
# 3: by order, the spreads of its frequent histories (b)
_PART = "block long, kind int, gram int, bucket int, a binary, b binary, ids array<long>, held array<boolean>, lens array<int>"
_PART_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
_SPREAD = TURING + 2  # followers seen 1 .. TURING times, the counts of the others, the mass of all at the order below


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _pack(x: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.ravel().view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_spreads(x: np.ndarray) -> bytes | None:
    """Rows of _SPREAD numbers, all but the last of them whole."""
    if not len(x):
        return None
    whole = _pack(np.ascontiguousarray(x[:, :-1].T).astype(np.int64))
    return len(whole).to_bytes(8, "little") + whole + _pack(np.ascontiguousarray(x[:, -1]))


def _unpack_spreads(raw: bytes | None) -> np.ndarray:
    if raw is None:
        return np.empty((0, _SPREAD))
    n = 8 + int.from_bytes(raw[:8], "little")
    return np.column_stack([_unpack(raw[8:n], np.int64).reshape(_SPREAD - 1, -1).T, _unpack(raw[n:], np.float64)])


def _part(block: int, kind: int, gram: int, bucket: int, a: bytes | None, b: bytes | None) -> tuple:
    return block, kind, gram, bucket, a, b, None, None, None


def _parts(rows: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_PART_TYPES)
    return pa.table([pa.array(x, t) for x, t in zip(columns, _PART_TYPES, strict=True)], names=_names(_PART))


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokenised texts in blocks of about `block_bytes`; place 0 of a block's words is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def new() -> tuple:
            places = _Places()
            places[END] = 0
            return places, [], [], [], []

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(streams)
            train = np.repeat(~np.array(held), lens)
            counts = np.bincount(tokens[train], minlength=len(places))
            row = {"block": [secrets.randbits(62)], "ids": [ids], "held": [held], "lens": [lens], "words": [list(places)], "counts": [counts.tolist()], "stream": [_pack(tokens)]}
            types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row.values(), types, strict=True)], names=list(row))

        places, ids, held, lens, streams = new()
        size = 0
        for batch in batches:
            for i, h, raw in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), raw_texts(batch["text"]), strict=True):
                words = raw.lower().split()  # bytes: A-Z only, and blanks \x20 and \x09-\x0D only
                tokens = np.zeros(len(words) + 1, dtype=np.int32)
                tokens[:-1] = list(map(places.__getitem__, words))
                streams.append(tokens)
                ids.append(i)
                held.append(h)
                lens.append(len(tokens))
                size += len(raw) + 1
                if size >= block_bytes:
                    yield out()
                    places, ids, held, lens, streams = new()
                    size = 0
        if ids:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), (crc_mod(F.col("doc_id"), HELD_OUT[0]) == HELD_OUT[1]).alias("held"), F.col("text").cast("string"))
    return materialise(rows.mapInArrow(run, _BLOCK), "lm-blocks")


def turing(n: list[int]) -> np.ndarray:
    """Discount ratios of counts 0..TURING+1 (0 and TURING+1 are dummies: 0 and 1) from the numbers of events seen
    1..TURING+1 times."""
    d = np.ones(TURING + 2)
    d[0] = 0.0
    cut = (TURING + 1) * n[TURING] / n[0] if n[0] else 1.0
    for r in range(1, TURING + 1):
        good = (((r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 1.0) - cut) / (1 - cut) if cut < 1 else 1.0
        d[r] = good if 0 < good < 1 else (r - 0.5) / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, TURING + 1)] * c


class Unigrams:
    """P(w) as a function of c(w)."""

    def __init__(self, total: int, kinds: int, n: list[int]) -> None:
        self.total, self.kinds, self.d = total, kinds, turing(n)
        kept = total - sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, TURING + 1))
        self.unknown = max(1 - kept / total, 0.5 / (total + 0.5)) if total else 1.0
        self.scale = (1 - self.unknown) / kept if total else 0.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown)


def _sums_of_counts(c) -> list:
    return [F.coalesce(F.sum((c == r).cast("long")), F.lit(0)) for r in range(1, TURING + 2)]


def unigrams(made: DataFrame) -> DataFrame:
    """(word, c, number, bucket) of every training word: frequent words get small numbers."""
    spark = made.sparkSession
    buckets = min(4096, int(spark.conf.get("spark.sql.shuffle.partitions")))
    words = made.select(F.explode(F.arrays_zip("words", "counts")).alias("x")).select("x.words", "x.counts")
    counted = words.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c")).where("c > 0")
    counted = counted.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("c"), "word"))
    numbered = counted.withColumn("number", (place - 1).cast("long") * buckets + F.col("bucket"))
    return materialise(numbered.select("word", "c", "number", "bucket"), "lm-unigrams", ["bucket"])


def _told(made: DataFrame, uni: DataFrame) -> DataFrame:
    """Per block, the codes and counts of its words by place (kind 1)."""

    def gather(t: pa.Table) -> pa.Table:
        pos = t["pos"].to_numpy()
        code, count = np.empty(len(pos), dtype=np.uint32), np.empty(len(pos), dtype=np.int64)
        code[pos], count[pos] = t["code"].to_numpy(), t["c"].to_numpy()
        return _parts([_part(int(t["block"][0].as_py()), 1, 0, 0, _pack(code), _pack(count))])

    asked = made.select("block", F.posexplode("words").alias("pos", "word"))
    known = uni.select("word", (F.col("number") + FIRST).alias("code"), "c").hint("shuffle_hash")
    told = asked.join(known, "word", "left").select("block", "pos", F.coalesce("code", F.lit(UNKNOWN)).alias("code"), F.coalesce("c", F.lit(0)).alias("c"))
    return materialise(told.groupBy("block").applyInArrow(gather, _PART), "lm-told")


class Grams:
    """The distinct n-grams of one order that a block asks for, sorted by their words, and what it is told about them.

    `at` are the tokens whose history was seen, `of` their n-grams; `ctx` is an n-gram's history, numbered within the block."""

    def __init__(self, ctx_of_token: np.ndarray, ctx_words: list[np.ndarray], ctx_count: np.ndarray, code: np.ndarray, train: np.ndarray, lower: np.ndarray) -> None:
        """By token: its history (-1: not seen), code, whether it is in training, and the count of its n-gram one order lower.
        By history: its words and its count."""
        self.at = np.flatnonzero(ctx_of_token >= 0)
        key = ctx_of_token[self.at].astype(np.uint64) << np.uint64(32) | code[self.at].astype(np.uint64)
        keys, first, self.of = np.unique(key, return_index=True, return_inverse=True)
        self.ctx = (keys >> np.uint64(32)).astype(np.int64)
        word = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        self.words = [*(w[self.ctx] for w in ctx_words), word]
        self.lower = lower[self.at][first]
        self.uses = np.bincount(self.of[train[self.at]], minlength=len(keys))
        self.ctx_words, self.ctx_count = ctx_words, ctx_count
        self.count = np.zeros(len(keys), dtype=np.int64)
        self.spread = np.zeros((len(ctx_count), _SPREAD))
        self.spared = np.zeros(len(ctx_count), dtype=bool)

    def deal(self, buckets: int, hot: float) -> None:
        """Put the n-grams in order of (bucket, is its history frequent)."""
        h = np.zeros(len(self.ctx), dtype=np.uint64)
        for w in self.words[:-1]:
            h = (h + w + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        often = self.ctx_count[self.ctx] > hot
        h = np.where(often, (h + self.words[-1]) * np.uint64(0xBF58476D1CE4E5B9), h)
        piece = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64) * 2 + often
        self.order = np.argsort(piece, kind="stable")
        self.cut = np.searchsorted(piece[self.order], np.arange(2 * buckets + 1))
        self.often = np.unique(self.ctx[often])

    def pieces(self) -> Iterator[tuple[int, np.ndarray]]:
        for k in np.flatnonzero(np.diff(self.cut)):
            yield int(k), self.order[self.cut[k] : self.cut[k + 1]]

    def hear(self, bucket: int, a: bytes, b: bytes | None) -> None:
        """A bucket's answer: for each n-gram of a piece, twice its count and whether its history gave up nothing, and the
        spreads of the histories of those that were not seen."""
        own = self.order[self.cut[bucket] : self.cut[bucket + 1]]
        told = _unpack(a, np.uint64).astype(np.int64)
        self.count[own] = told >> 1
        if bucket % 2 == 0:
            ctx = self.ctx[own]
            self.spared[ctx[told & 1 == 1]] = True
            self.spread[_runs(ctx[told >> 1 == 0])] = _unpack_spreads(b)

    def hear_often(self, b: bytes) -> None:
        rows = _unpack_spreads(b)
        self.spread[self.often] = rows
        self.spared[self.often] = ~rows[:, :TURING].any(axis=1)

    def base(self) -> np.ndarray:
        """What the counts of a history's followers are divided by."""
        return np.maximum(self.ctx_count, 0.5) + 0.5 * self.spared  # a history that was not seen is not asked for

    def logs(self, d: np.ndarray, below: np.ndarray, base_below: np.ndarray) -> np.ndarray:
        """log10 P of the tokens `at`, given by token the logarithms and the histories' bases one order lower."""
        base, r = self.base(), np.arange(1, TURING + 1)
        spent = self.spread[:, :TURING] @ (d[r] * r) + self.spread[:, TURING]
        free = np.log10(np.maximum(1 - spent / base, 1e-300))
        c, ctx = self.count[self.of], self.ctx[self.of]
        known = self.spread[ctx, -1] / base_below[self.at]
        return np.where(c > 0, np.log10(np.maximum(discounted(c, d), 1e-300) / base[ctx]), free[ctx] - np.log10(np.maximum(1 - known, 1e-12)) + below[self.at])


def _runs(x: np.ndarray) -> np.ndarray:
    """The first of each run of equal values."""
    return x[np.flatnonzero(np.diff(x, prepend=-1))]


class Block:
    """A block's tokens, and its n-grams order by order as far as it was told."""

    def __init__(self, t: pa.Table, model: Unigrams, discounts: list[np.ndarray], buckets: int, hot: float, ask: bool) -> None:
        """With `ask`, the last level is the one to be asked for, of which nothing is known yet."""
        rows = t.to_pylist()
        whole = next(r for r in rows if r["kind"] == 0)
        words = next(r for r in rows if r["kind"] == 1)
        self.id, self.ids, self.held, self.lens = whole["block"], whole["ids"], np.array(whole["held"], dtype=bool), np.array(whole["lens"])
        code, count = _unpack(words["a"], np.uint32), _unpack(words["b"], np.int64)
        place = _unpack(whole["a"], np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.lens)[:-1]]).astype(np.int64)
        self.code, self.c = code[place], count[place]
        self.train = np.repeat(~self.held, self.lens)
        first = np.zeros(len(place), dtype=bool)
        first[self.starts] = True
        self.logs = np.log10(model(self.c))
        self.levels: list[Grams] = []
        # histories of the bigrams: the block's words by code, and the beginning, as often as texts ended in training
        alphabet, at = np.unique(np.append(code, BEGIN).astype(np.uint32), return_inverse=True)
        ctx_words, ctx_count = [alphabet], np.zeros(len(alphabet), dtype=np.int64)
        ctx_count[at] = np.append(count, count[0])
        number = at[:-1][place]
        ctx = np.where(first, at[-1], np.roll(number, 1))
        ctx = np.where(ctx_count[ctx] > 0, ctx, -1)
        lower, base_below = self.c, np.ones(len(place))
        for n, d in enumerate([*discounts, None] if ask else discounts, 2):
            level = Grams(ctx, ctx_words, ctx_count, self.code, self.train, lower)
            level.deal(buckets, hot)
            self.levels.append(level)
            if d is None:
                break
            for r in rows:
                if r["gram"] == n and r["kind"] == 2:
                    level.hear(r["bucket"], r["a"], r["b"])
                elif r["gram"] == n and r["kind"] == 3:
                    level.hear_often(r["b"])
            self.logs[level.at] = level.logs(d, self.logs, base_below)
            # a seen n-gram is a history of the next order for the token after it
            gram = np.full(len(place), -1)
            gram[level.at] = level.of
            lower = np.zeros(len(place), dtype=np.int64)
            lower[level.at] = level.count[level.of]
            base_below[level.at] = level.base()[level.ctx[level.of]]
            ctx = np.where(first | (np.roll(lower, 1) == 0), -1, np.roll(gram, 1))
            ctx_words, ctx_count = level.words, level.count


_ASK = "bucket int, block long, often boolean, n long, a binary"


def _grams(parts: DataFrame, gram: int, model: Unigrams, discounts: list[np.ndarray], buckets: int, hot: float) -> tuple[DataFrame, np.ndarray]:
    """What blocks are told about their n-grams of `gram` words, and the discounts of that order."""

    def ask(t: pa.Table) -> pa.Table:
        """Pieces by bucket; and the block's frequent histories (n is null), which pass through some bucket as they are."""
        own = Block(t, model, discounts, buckets, hot, ask=True)
        level, rows = own.levels[-1], []
        for k, at in level.pieces():
            columns = [*(w[at] for w in level.words), level.uses[at].astype(np.uint32), level.lower[at].astype(np.uint64)]
            rows.append((k // 2, own.id, k % 2 == 1, len(at), b"".join(len(p).to_bytes(8, "little") + p for p in map(_pack, columns))))
        if len(level.often):
            rows.append((own.id % buckets, own.id, True, None, np.stack([w[level.often].astype(">u4") for w in level.ctx_words], axis=1).tobytes()))
        types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, ty) for x, ty in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=_names(_ASK))

    def columns_of(raw: bytes) -> list[np.ndarray]:
        out, at = [], 0
        for kind in [np.uint32] * (gram + 1) + [np.uint64]:
            n = int.from_bytes(raw[at : at + 8], "little")
            out.append(_unpack(raw[at + 8 : at + 8 + n], kind))
            at += 8 + n
        return out

    def below(c: np.ndarray) -> np.ndarray:
        """The mass of words at the order below, but for the history's base."""
        return model(c) if gram == 2 else discounted(c, discounts[-1])

    def add_up(t: pa.Table) -> pa.Table:
        """Answers by block (kind 2), spreads of frequent histories as far as this bucket knows (4), a tally of counts (5),
        and the frequent histories that blocks hold (6)."""
        bucket, out = int(t["bucket"][0].as_py()), []
        rows = t.to_pylist()
        tally = np.zeros(TURING + 1, dtype=np.int64)
        for often in (False, True):
            asked = [r for r in rows if r["often"] == often and r["n"] is not None]
            if not asked:
                continue
            *words, uses, lower = (np.concatenate(x) for x in zip(*(columns_of(r["a"]) for r in asked), strict=True))
            history, starts_of = np.zeros(len(uses), dtype=np.uint64), None
            for k, w in enumerate(words):
                if k == gram - 1:
                    starts_of = history
                _, history = np.unique(history << np.uint64(32) | w, return_inverse=True)
                history = history.astype(np.uint64)
            of, ctx_of = history.astype(np.int64), starts_of.astype(np.int64)
            n = int(of.max()) + 1
            total = np.bincount(of, weights=uses, minlength=n).astype(np.int64)
            ctx, mass = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            ctx[of], mass[of] = ctx_of, lower  # all who ask for an n-gram say the same of it
            tally += np.bincount(np.minimum(total, TURING + 2), minlength=TURING + 3)[1 : TURING + 2]
            n_ctx = int(ctx.max()) + 1
            spread = np.zeros((n_ctx, _SPREAD))
            for r in range(1, TURING + 1):
                spread[:, r - 1] = np.bincount(ctx[total == r], minlength=n_ctx)
            high = total > TURING
            spread[:, TURING] = np.bincount(ctx[high], weights=total[high], minlength=n_ctx)
            seen = total > 0
            spread[:, -1] = np.bincount(ctx[seen], weights=below(mass[seen]), minlength=n_ctx)
            spared = ~spread[:, :TURING].any(axis=1)
            at = 0
            for r in asked:
                own = slice(at, at + r["n"])
                at += r["n"]
                told = total[of[own]] * 2 + spared[ctx_of[own]]
                rest = None if often else _pack_spreads(spread[_runs(ctx_of[own][told < 2])])
                out.append(_part(r["block"], 2, gram, 2 * bucket + often, _pack(told.astype(np.uint64)), rest))
            if often:
                where = np.empty(n_ctx, dtype=np.int64)
                where[ctx_of] = np.arange(len(ctx_of))
                out.append(_part(0, 4, gram, bucket, np.stack([w[where].astype(">u4") for w in words[:-1]], axis=1).tobytes(), _pack_spreads(spread)))
        out.append(_part(0, 5, gram, bucket, tally.tobytes(), None))
        out += [_part(r["block"], 6, gram, bucket, r["a"], None) for r in rows if r["n"] is None]
        return _parts(out)

    asked = parts.groupBy("block").applyInArrow(ask, _ASK)
    found = materialise(asked.groupBy("bucket").applyInArrow(add_up, _PART), f"lm-grams-{gram}", ["kind"])

    def tallies(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = sum(np.frombuffer(a.as_py(), dtype=np.int64) for a in batch["a"])
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in rows.tolist()], names=[f"n{r}" for r in range(TURING + 1)])

    tally = map_arrow(found.where("kind = 5").select("a"), tallies, ", ".join(f"n{r} long" for r in range(TURING + 1)))
    sums = tally.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in tally.columns]).first()
    told = found.where("kind = 2").select(*_names(_PART)).unionByName(_often(found, gram))
    return told, turing([int(x) for x in sums])


def _often(found: DataFrame, gram: int) -> DataFrame:
    """The spreads of frequent histories, added up over buckets, for each block in its order of them (kind 3)."""
    width = 4 * (gram - 1)
    fields = [f"s{k}" for k in range(_SPREAD)]

    def histories(a: bytes) -> list[bytes]:
        return [a[k : k + width] for k in range(0, len(a), width)]

    def spreads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch["a"], batch["b"], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(histories(a.as_py())), *(pa.array(x) for x in _unpack_spreads(b.as_py()).T.copy())], names=["history", *fields])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a in zip(batch["block"].to_pylist(), batch["a"], strict=True):
                own = histories(a.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(range(len(own)), pa.int64()), pa.array(own, pa.binary())], names=["block", "pos", "history"])

    def gather(t: pa.Table) -> pa.Table:
        rows = np.zeros((t.num_rows, _SPREAD))
        rows[t["pos"].to_numpy()] = np.column_stack([t[c].to_numpy() for c in fields])
        return _parts([_part(int(t["block"][0].as_py()), 3, gram, 0, None, _pack_spreads(rows))])

    sums = found.where("kind = 4").select("a", "b").mapInArrow(spreads, "history binary, " + ", ".join(f"{c} double" for c in fields))
    sums = sums.groupBy("history").agg(*[F.sum(c).alias(c) for c in fields])
    asked = materialise(found.where("kind = 6").select("block", "a").mapInArrow(held, "block long, pos long, history binary"), f"lm-held-{gram}")
    joined = join_hot(asked, sums, "history", F.col("block"))
    return materialise(joined.groupBy("block").applyInArrow(gather, _PART), f"lm-often-{gram}")


def score(docs: DataFrame, block_bytes: int = BLOCK_BYTES, bucket_tokens: int = BUCKET_TOKENS, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bigrams and n_longest (tokens whose bigram, and
    whose longest n-gram, was seen) for every row. `order` is two or more."""
    if order < 2:
        raise ValueError("the order is two or more")
    spark = docs.sparkSession
    made = blocks(docs, block_bytes)
    with Scratch(spark) as words:
        uni = unigrams(made)
    got = uni.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max("number"), F.lit(0)), *_sums_of_counts(F.col("c"))).first()
    if got[2] >= MAX_WORDS:
        raise ValueError("too many distinct words for 32-bit numbers")
    model = Unigrams(int(got[0]), int(got[1]), [int(x) for x in got[3:]])
    told = _told(made, uni)
    words.release()
    none = {c: F.lit(None).cast(t) for c, t in (x.split() for x in _PART.split(", "))}
    whole = {**none, "block": F.col("block"), "kind": F.lit(0), "gram": F.lit(0), "bucket": F.lit(0), "a": F.col("stream"), **{c: F.col(c) for c in ("ids", "held", "lens")}}
    parts = made.select(*[x.alias(c) for c, x in whole.items()]).unionByName(told)

    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-model.total // bucket_tokens), 1)
    hot = model.total / (2 * buckets)
    discounts: list[np.ndarray] = []
    for n in range(2, order + 1):
        told, d = _grams(parts, n, model, discounts, buckets, hot)
        parts = parts.unionByName(told)
        discounts.append(d)

    def evaluate(t: pa.Table) -> pa.Table:
        own = Block(t, model, discounts, buckets, hot, ask=False)
        add = lambda x: np.add.reduceat(x, own.starts)
        seen = []
        for level in (own.levels[0], own.levels[order - 2]):
            at = np.zeros(len(own.c), dtype=np.int64)
            at[level.at] = level.count[level.of] > 0
            seen.append(add(at))
        plain = add(np.log10(own.c + 1.0)) - own.lens * np.log10(model.total + model.kinds + 1.0)
        made = [own.ids, own.held, own.lens.astype(np.int64), add((own.c > 0).astype(np.int64)), np.full(len(own.lens), model.total), plain, add(own.logs), *seen]
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, ty) for x, ty in zip(made, types, strict=True)], names=_names(_SCORES))

    return parts.groupBy("block").applyInArrow(evaluate, _SCORES)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "lm-scores", lambda: score(table(spark, sf_dir, "documents")))
