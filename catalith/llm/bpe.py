"""Operator 7: byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word, exactly one token can end its encoding: a token that is a suffix of the prefix and whose
boundary with the last token of the rest survives merging. The automaton of the vocabulary lists the suffix matches
of all prefixes in one pass, a pair test picks the token, and back-pointers from the whole word give the exact ids.

Pair test: when the encodings of A and B stand next to each other, the boundary is crossed if some token on A's right
edge and some token on B's left edge, both standing at the same moment, merge before either merges inwards. The edges
rise with the merge ranks, so one walk up both of them decides.

A tokenizer file of the tokenizers library is read (byte-level BPE without normaliser, prefix space, dropout or flags of added tokens; any
other raises ValueError); its path is a parameter. Each
worker keeps the encodings of at most `CACHE` words, refilled when full.

Defined cases. Null text counts as empty: no ids, and the hashes of the empty text. Repeated rows are encoded each, null ids too; columns
besides doc_id and text are not read; an empty table gives no rows. The strings of special tokens in a
text become those tokens, as in the library. Decoding replaces invalid UTF-8, which encoded texts never hold.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

CACHE = 500_000
_FIRST, _SECOND = itemgetter(0), itemgetter(1)
_SPACE = r"\p{White_Space}"
# fixed pattern of byte-level BPE pre-tokenizers
PRETOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|{_SPACE}+(?![^{_SPACE}])|{_SPACE}+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 characters themselves, the rest from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def checked(spec: dict) -> dict:
    """The tokenizer, if it is of the one kind that is encoded here; else ValueError, rather than other ids in silence."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    off = [("normalizer", spec.get("normalizer")), *((k, model.get(k)) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")), ("add_prefix_space", cut.get("add_prefix_space"))]
    off += [(k, any(t.get(k) for t in spec["added_tokens"])) for k in ("single_word", "lstrip", "rstrip", "normalized")]
    wrong = [name for name, on in off if on]
    if wrong or model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not cut.get("use_regex", True):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {wrong or [model['type'], cut]}")
    return spec


class Codec:
    def __init__(self, text: str) -> None:
        """From the text of a tokenizer file."""
        spec = checked(json.loads(text))
        model = spec["model"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        raw = {t: bytes(byte_of[c] for c in t) for t in model["vocab"]}
        self.bytes_of: dict[int, bytes] = {i: raw[t] for t, i in model["vocab"].items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.rank = {(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)}
        parts = {ids[a + b]: (ids[a], ids[b]) for a, b in reversed(merges)}
        born = {i: self.rank[p] for i, p in parts.items()}
        # the edges of each token, from the single byte up: (token, rank of the merge that absorbs it)
        self.right_edge = {i: self._edge(i, parts, born, 1) for i in self.bytes_of}
        self.left_edge = {i: self._edge(i, parts, born, 0) for i in self.bytes_of}
        self.matches = ahocorasick.Automaton()
        for i, b in self.bytes_of.items():
            if len(b) == 1 or i in parts:  # a token that no merge makes never comes out
                self.matches.add_word(b.decode("latin-1"), (i, len(b)))
        self.matches.make_automaton()
        self.token_of = {b: i for i, b in self.bytes_of.items() if len(b) == 1 or i in parts}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["content"] not in ids}
        self.special |= {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.fits = lru_cache(1 << 18)(self._fits)
        self.words: dict[str, tuple[str, bytes]] = {}

    @staticmethod
    def _edge(token: int, parts: dict, born: dict, side: int) -> list[tuple[int, float]]:
        chain, absorbed = [], float("inf")
        while True:
            chain.append((token, absorbed))
            if token not in parts:
                return chain[::-1]
            absorbed, token = born[token], parts[token][side]

    def _fits(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay apart when they stand next to each other."""
        left, right = self.right_edge[a], self.left_edge[b]
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            cross = self.rank.get((x, y))
            # of equal ranks the leftmost merges first
            if cross is not None and cross < x_ends and cross <= y_ends:
                return False
            if x_ends == y_ends == float("inf"):
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def encode_word(self, raw: bytes) -> list[int]:
        """The ids of one pre-token: the last token of each prefix, then the way back."""
        if (whole := self.token_of.get(raw)) is not None:
            return [whole]
        last, size, fits = [0] * len(raw), [0] * len(raw), self.fits
        for end, (token, n) in self.matches.iter(raw.decode("latin-1")):
            if size[end]:
                continue
            start = end - n
            if start < 0 or (size[start] and fits(last[start], token)):
                last[end], size[end] = token, n
        ids, end = [], len(raw) - 1
        while end >= 0:
            if not size[end]:
                raise ValueError("the vocabulary cannot spell this text")
            ids.append(last[end])
            end -= size[end]
        return ids[::-1]

    def _word(self, word: str) -> tuple[str, bytes]:
        ids = self.encode_word(word.encode())
        if len(self.words) >= CACHE:
            self.words.clear()
        got = ",".join(map(str, ids)), b"".join(map(self.bytes_of.__getitem__, ids))
        if len(word) <= 64:
            self.words[word] = got
        return got

    def pieces(self, text: str) -> list[tuple[str, bytes]]:
        """(ids joined by commas, the bytes they decode to) for each pre-token and special token."""
        out, known = [], self.words
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                i = self.special[part]
                out.append((str(i), self.bytes_of[i]))
            else:
                out += [known.get(w) or self._word(w) for w in PRETOKEN.findall(part)]
        return out

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.pieces(text) for i in ids.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def codec(text: str) -> Codec:
    return Codec(text)


def read_file(path: str | None = None) -> str:
    """The text of a tokenizer file, read by the driver; workers get it sent (a few MB, whatever the corpus)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return f.read()


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(shared.value)
        n, ids, texts = [], [], []
        for x in batch["text"]:
            pieces = c.pieces(x.as_py() or "")
            spelled = ",".join(map(_FIRST, pieces))
            n.append(spelled.count(",") + 1 if spelled else 0)
            ids.append(hashlib.sha256(spelled.encode()).hexdigest())
            decoded = b"".join(map(_SECOND, pieces)).decode("utf-8", "replace")
            texts.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids, the operator's plain output."""
    shared = docs.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec(shared.value).encode(x.as_py() or "") for x in batch["text"]]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, ids array<int>")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
