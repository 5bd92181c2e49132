"""Operator 4: near-duplicates by SimHash, with a byte-position inverted index and count filtering.

A fingerprint of 64 * k bits has 8 * k positional bytes. The inverted index posts each distinct fingerprint under
groups of positions and the bytes found there. Within a posting list the shared positional bytes of each pair are
tallied, pairs that reach the minimum are kept, and their differing bits are counted. Lists by single bytes would
each hold 1/256 of the corpus; lists by groups of two or three stay short.

Strict profile (the query): 64 bits, links at 3 or fewer differing bits. Those touch at most 3 bytes, so a linked pair
shares at least 5 of 8 positional bytes: the guaranteed minimum. The position groups are a covering: any 5 positions
contain one of them, so no linked pair is missed.

Similarity profile (`similarity_profile`): for a Jaccard similarity s of sets of five-word shingles. The index posts shingles
instead of bytes, in one order for all texts: a set of n posts its first n - ceil(s * n) + 1. Sets of similarity s or more
share at least ceil(s * n) shingles, so they share a posted one: every such pair meets. Of pairs that meet, those whose
256-bit fingerprints of the sets differ in at most `max_bits` are candidates. The share of differing bits estimates
acos(2s / (1 + s)) / pi; the limit is 4.5 standard errors above that, which a pair at s exceeds in about 6 of a million cases, and
more similar pairs more rarely. Within each component of candidates the sets are compared, and only pairs whose exact
similarity is s or more link (`verified`). Texts with equal sets are one node. The order puts shingles that a
sample finds in many texts last, which keeps lists short; whatever the sample says, no pair is missed for it.

Only links that join two sets unknown to a task as joined leave it, never all pairs of a group. A list longer than `LIST_ROWS`
is split into blocks, and pairs of blocks go to different tasks, so no list is held whole. Partitions contract the links they hold;
the components of the rest grow by alternating large-star and small-star rounds, each round a stored table, and by a union-find once
no more than `TASK_LINKS` links are left.

Defined cases. Null and blank texts have fingerprint zero and link like any other. Texts of fewer words than a
shingle use the whole word sequence as their one shingle. Repeated ids are separate rows. A null id never becomes a
component's smallest id unless it has no other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, map_arrow, materialise, raw_texts, stored, table

LIST_ROWS = 8192
VERIFY_ROWS = 512
POST_ROWS = 1024
SAMPLE = 64  # one row of so many tells which shingles are frequent
SHORT_LIST = 32
TASK_LINKS = 1 << 18
_PAIRS = 1 << 17  # blocks of a list at most
SEED = 42


def covering(n: int, shared: int, size: int) -> tuple[tuple[int, ...], ...]:
    """Few groups of `size` of n positions such that every choice of `shared` positions contains one, found greedily."""
    missing = set(combinations(range(n), shared))
    groups = []
    while missing:
        best = max(combinations(range(n), size), key=lambda g: (sum(set(g) <= set(m) for m in missing), [-x for x in g]))
        groups.append(best)
        missing = {m for m in missing if not set(best) <= set(m)}
    return tuple(groups)


@dataclass(frozen=True)
class Profile:
    shingle: int
    words: int  # fingerprint width in 64-bit words
    max_bits: int  # linked up to so many differing bits
    min_shared: int  # positional bytes that a linked pair must share
    groups: tuple[tuple[int, ...], ...]  # positions posted together
    similarity: float | None = None  # links are verified by this Jaccard similarity of their sets of shingles


STRICT = Profile(shingle=3, words=1, max_bits=3, min_shared=5, groups=covering(8, 5, 3))


def similarity_profile(similarity: float = 0.8, shingle: int = 5, words: int = 4) -> Profile:
    bits = 64 * words
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = int(bits * share + 4.5 * math.sqrt(bits * share * (1 - share)))
    return Profile(shingle, words, limit, max(0, 8 * words - limit), (), similarity)


SIMILAR = similarity_profile()

_STEP = 0x9E3779B97F4A7C15


def _spread(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit word of each hash."""
    x = h + np.uint64(_STEP * k % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def shingles(raw: bytes, n: int) -> np.ndarray:
    """The XXH64 hashes of a text's n-word shingles in order of the text."""
    words = raw.lower().split()  # bytes.lower() changes A-Z only; bytes.split() cuts at \x20 and \x09-\x0D
    if not words:
        return np.empty(0, dtype=">u8")
    parts: Iterator = iter([words]) if len(words) < n else zip(*(words[k:] for k in range(n)), strict=False)
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, map(b" ".join, parts), repeat(SEED))), dtype=">u8")


def fingerprint(raw: bytes, profile: Profile = STRICT) -> bytes:
    """The bytes of a text's fingerprint, highest bit first; the first word is the XXH64 SimHash."""
    return _majority(shingles(raw, profile.shingle), profile)


def _head(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """How many shingles of a set of n suffice to share one with every set of that similarity."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def posted(held: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of a sorted set that the index lists it under; those in `common` (sorted) come last in the order."""
    if not len(held):
        return held
    often = np.isin(held, common) if len(common) else np.zeros(len(held), dtype=bool)
    return np.concatenate([held[~often], held[often]])[: _head(np.int64(len(held)), similarity)]


def frequent(texts: DataFrame, profile: Profile) -> np.ndarray:
    """Shingles of many texts, sorted, from a sample of the rows of `texts` (rid, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.unique(shingles(raw, profile.shingle).astype(np.uint64)) for raw in raw_texts(batch["text"])]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["h"])

    least = max(16, texts.count() // SAMPLE // 4096)
    sample = map_arrow(texts.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLE)) == 0).select("text"), run, "h long")
    found = sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64))


def _majority(h: np.ndarray, profile: Profile) -> bytes:
    width = 8 * profile.words
    if not len(h):
        return bytes(width)
    ones = np.zeros(8 * width, dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        if profile.words > 1:
            part = np.stack([_spread(part.astype(np.uint64), k) if k else part.astype(np.uint64) for k in range(profile.words)], axis=1).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, width), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h)).tobytes()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, profile: Profile, row_col: str | None = None) -> DataFrame:
    """rid, id and fp (binary) for each row; with a similarity, fp is that of the set of shingles, and the set's digest and
    posted shingles follow."""
    rid = F.col(row_col) if row_col else F.monotonically_increasing_id()
    docs = docs.select(rid.alias("rid"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    common = frequent(docs.select("rid", "text"), profile) if profile.similarity is not None else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if profile.similarity is None:
            made = {"fp": [fingerprint(raw, profile) for raw in raw_texts(batch["text"])]}
        else:
            made = {"fp": [], "digest": [], "posted": []}
            for raw in raw_texts(batch["text"]):
                held = np.unique(shingles(raw, profile.shingle).astype(np.uint64))
                made["fp"].append(_majority(held.astype(">u8"), profile))
                made["digest"].append(xxhash.xxh128_digest(held.tobytes()))
                made["posted"].append(posted(held, common, profile.similarity).tobytes())
        return pa.RecordBatch.from_arrays([batch["rid"], batch["id"], *(pa.array(x, pa.binary()) for x in made.values())], names=["rid", "id", *made])

    return map_arrow(docs, run, "rid long, id long, fp binary" + (", digest binary, posted binary" if profile.similarity is not None else ""))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_py() for x in column), dtype=np.uint8).reshape(-1, width)


def near(a: np.ndarray, b: np.ndarray, profile: Profile) -> np.ndarray:
    """Which rows of byte matrices a and b link: the shared positional bytes are tallied, then differing bits counted."""
    diff = a ^ b
    ok = (diff == 0).sum(axis=-1) >= profile.min_shared
    ok[ok] = np.bitwise_count(diff[ok]).sum(axis=-1, dtype=np.int32) <= profile.max_bits
    return ok


def forest(nodes: np.ndarray, fps: np.ndarray, profile: Profile) -> list[tuple[int, int]]:
    """Links that span the components of one long posting list, breadth first: a found row leaves the search."""
    rest, links = np.arange(len(nodes)), []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            step = max(1, (1 << 22) // (len(rest) * fps.shape[1]))
            found = []
            for at in range(0, len(front), step):
                if not len(rest):
                    break
                part = front[at : at + step]
                ok = near(np.repeat(fps[part], len(rest), axis=0), np.tile(fps[rest], (len(part), 1)), profile).reshape(len(part), -1)
                hit = ok.any(axis=0)
                links += zip(nodes[part[ok.argmax(axis=0)[hit]]].tolist(), nodes[rest[hit]].tolist(), strict=True)
                found.append(rest[hit])
                rest = rest[~hit]
            front = np.concatenate(found)
    return links


class Sets:
    """Union-find."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while self.parent.setdefault(top, top) != top:
            top = self.parent[top]
        while self.parent[x] != top:
            self.parent[x], x = top, self.parent[x]
        return top

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(distinct: DataFrame, profile: Profile, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b) links between the nodes of `distinct` (node, fp) that connect all pairs that meet in the index."""
    width = 8 * profile.words

    def post(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = _matrix(batch["fp"], width).astype(np.int64)
        keys = []
        for g, places in enumerate(profile.groups):
            key = np.full(len(fps), g, dtype=np.int64)
            for p in places:
                key = (key << 8) | fps[:, p]
            keys.append(key)
        n = len(profile.groups)
        return pa.RecordBatch.from_arrays([pa.array(np.stack(keys, axis=1).ravel()), batch["node"].take(pa.array(np.repeat(np.arange(len(fps)), n))), batch["fp"].take(pa.array(np.repeat(np.arange(len(fps)), n)))], names=["key", "node", "fp"])

    def post_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, POST_ROWS) for at in range(0, whole.num_rows, POST_ROWS)):
                keys = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch["posted"]]
                of = pa.array(np.repeat(np.arange(len(keys)), [len(x) for x in keys]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch["node"].take(of), batch["fp"].take(of)], names=["key", "node", "fp"])

    if profile.similarity is None:
        posts = map_arrow(distinct.select("node", "fp"), post, "key long, node long, fp binary")
    else:
        posts = distinct.select("node", "fp", "posted").mapInArrow(post_shingles, "key long, node long, fp binary")
    # the lists that need splitting are few (each holds more than `list_rows` rows); stored, their size is known before
    # the join, so that the posts need not be shuffled for it
    sizes = materialise(posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > list_rows), "long-lists")
    posts = posts.join(sizes, "key", "left")
    g = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(list_rows)).cast("long")
    i = F.pmod(F.xxhash64("node"), F.col("g"))
    # a block pair of a list is numbered key, smaller block, larger block
    # (hashed where keys have all 64 bits: lists that clash are only compared with one another in vain)
    if profile.similarity is None:
        number = lambda j: (F.col("key") * _PAIRS + F.least("i", j)) * _PAIRS + F.greatest("i", j)
    else:
        number = lambda j: F.xxhash64("key", F.least("i", j), F.greatest("i", j))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), number)
    posts = posts.withColumn("g", g).withColumn("i", i).select(F.explode(pair).alias("list"), "node", "fp").repartition("list").sortWithinPartitions("list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets()
        held: tuple[np.ndarray, np.ndarray] = np.empty((0, 2), dtype=np.int64), np.empty((0, width), dtype=np.uint8)

        def lists(rows: np.ndarray, fps: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
            """New links of the lists that begin at `starts`."""
            size = np.diff(starts, append=len(rows))
            found = []
            for lo, n in zip(starts[size > SHORT_LIST], size[size > SHORT_LIST], strict=True):
                found += forest(rows[lo : lo + n, 1], fps[lo : lo + n], profile)
            left = np.repeat(np.where(size > SHORT_LIST, 0, size), size) - (np.arange(len(rows)) - np.repeat(starts, size))
            for k in range(1, SHORT_LIST):
                at = np.flatnonzero(left > k)
                if not len(at):
                    break
                at = at[near(fps[at], fps[at + k], profile)]
                found += zip(rows[at, 1].tolist(), rows[at + k, 1].tolist(), strict=True)
            return [(a, b) for a, b in found if sets.join(a, b)]

        for batch in batches:
            rows = np.concatenate([held[0], np.stack([np.asarray(batch[c], dtype=np.int64) for c in ("list", "node")], axis=1)])
            fps = np.concatenate([held[1], _matrix(batch["fp"], width)])
            if not len(rows):
                continue
            starts = np.concatenate([[0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1])
            last = starts[-1]
            if last and (new := lists(rows[:last], fps[:last], starts[:-1])):
                yield _pairs(new)
            held = rows[last:], fps[last:]
        if len(held[0]) and (new := lists(*held, np.array([0]))):
            yield _pairs(new)

    return posts.mapInArrow(run, "a long, b long").distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round: link the larger (large) or smaller-or-equal (small) neighbours of a node to its smallest. `edges` is stored;
    a node with very many neighbours meets its smallest one in parts."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    joined = join_hot(both, least, "a", F.col("b"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one task, each node to the smallest one its links reach."""
    sets = Sets()
    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            sets.join(a, b)
    yield _pairs([(x, y) for x in list(sets.parent) if x != (y := sets.root(x))])


def components(edges: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), root being the smallest node reachable.

    Each partition first contracts the links it has (a union-find over one partition). What is left between partitions goes to
    one task if that is at most `task_links` links, a bounded number; while there are more, they are joined in rounds of stars."""
    now = materialise(edges.mapInArrow(_contract, "a long, b long").distinct(), "links")
    stamp = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new[0] <= task_links:
            now = materialise(now.coalesce(1).mapInArrow(_contract, "a long, b long"), "contracted") if new[0] else now
            break
        if new == stamp:
            break
        stamp = new
        now = materialise(_stars(materialise(_stars(now, True), "stars"), False), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def jaccard_forest(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that span the components of exact Jaccard similarity among sets of shingles, breadth first.

    Shingles are ordered rarest first. Sets that are similar enough share a shingle among the first
    n - ceil(similarity * n) + 1 of each, so only sets that do are compared, in full."""
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, of, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(n), dtype=np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n))
    rank = rank[of]
    rank = rank[np.lexsort((rank, owner))]
    starts = np.concatenate([[0], np.cumsum(size)])
    head = _head(size, similarity)
    in_head = np.arange(len(rank)) - np.repeat(starts[:-1], size) < np.repeat(head, size)

    def index(free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(in_head & free[owner])
        at = at[np.argsort(rank[at], kind="stable")]
        return rank[at], owner[at]

    free, mine, links = np.ones(len(sets), dtype=bool), np.zeros(len(n), dtype=bool), []
    keys, holders = index(free)
    left = indexed = len(sets)
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first], front = False, [first]
        left -= 1
        while front and left:
            if 2 * left < indexed:
                (keys, holders), indexed = index(free), left
            a = front.pop()
            own = rank[starts[a] : starts[a + 1]]
            lo, hi = (np.searchsorted(keys, own[: head[a]], side) for side in ("left", "right"))
            met = [holders[x:y] for x, y in zip(lo, hi, strict=True) if x < y]
            if not met:
                continue
            met = np.unique(np.concatenate(met))
            met = met[free[met] & (np.minimum(size[met], size[a]) >= similarity * np.maximum(size[met], size[a]) - 1e-9)]
            mine[own] = True
            shared = np.array([np.count_nonzero(mine[rank[starts[b] : starts[b + 1]]]) for b in met], dtype=np.int64)
            mine[own] = False
            met = met[shared / (size[met] + size[a] - shared) >= similarity]
            free[met] = False
            left -= len(met)
            links += [(int(nodes[a]), int(nodes[b])) for b in met]
            front += met.tolist()
    return links


def verified(texts: DataFrame, candidates: DataFrame, profile: Profile, list_rows: int = VERIFY_ROWS) -> DataFrame:
    """(a, b) links of exact similarity that connect all similar pairs within each component of `candidates`
    (node, root). `texts` (rid, text) holds the nodes' texts. Large components are dealt in pairs of blocks."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = [np.unique(shingles(raw, profile.shingle).astype(np.uint64)).tobytes() for raw in raw_texts(batch["text"])]
        return pa.RecordBatch.from_arrays([batch["root"], batch["node"], pa.array(held, pa.binary())], names=["root", "node", "held"])

    members = materialise(candidates.union(candidates.select(F.col("root").alias("node"), "root")).distinct(), "members")
    large = materialise(members.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > list_rows), "large-groups")
    held = map_arrow(texts.join(members, texts["rid"] == members["node"]).select("root", "node", "text"), sets, "root long, node long, held binary").join(large, "root", "left")
    g = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(list_rows)).cast("long")
    i = F.pmod(F.xxhash64("node"), F.col("g"))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), F.col("g") - 1), lambda j: F.xxhash64("root", F.least("i", j), F.greatest("i", j)))
    held = held.withColumn("g", g).withColumn("i", i).select(F.explode(pair).alias("list"), "node", "held").repartition("list").sortWithinPartitions("list")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, own = None, [], []

        def out() -> list[tuple[int, int]]:
            return jaccard_forest(np.array(nodes), own, profile.similarity) if len(nodes) > 1 else []

        for batch in batches:
            found = []
            for key, node, raw in zip(batch["list"].to_pylist(), batch["node"].to_pylist(), batch["held"], strict=True):
                if key != now:
                    found += out()
                    now, nodes, own = key, [], []
                nodes.append(node)
                own.append(np.frombuffer(raw.as_py(), dtype=np.uint64))
            if found:
                yield _pairs(found)
        if found := out():
            yield _pairs(found)

    return held.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: Profile = STRICT, row_col: str | None = None) -> DataFrame:
    """One row per input row: rid, id, fp (hex), component_id (smallest id reachable) and kept (the row with that id)."""
    if profile.similarity is not None and row_col is None:
        docs, row_col = materialise(docs.select(F.monotonically_increasing_id().alias("_row"), id_col, text_col), "numbered"), "_row"
    rows = materialise(fingerprints(docs, id_col, text_col, profile, row_col), "fingerprints")
    same = "fp" if profile.similarity is None else "digest"
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
    distinct = materialise(rows.groupBy(same).agg(F.min("rid").alias("node"), first.alias("first"), *([F.first(c).alias(c) for c in ("fp", "posted")] if same != "fp" else [])), "distinct")
    roots = components(links(distinct, profile))
    if profile.similarity is not None:
        texts = docs.select(F.col(row_col).alias("rid"), F.col(text_col).cast("string").alias("text"))
        roots = components(verified(texts, roots, profile))
    known = materialise(distinct.join(roots, "node", "left").select(same, "node", "first", F.coalesce("root", "node").alias("root")), "roots")
    smallest = known.groupBy("root").agg(F.min("first").alias("least"))
    reach = materialise(join_hot(known, smallest, "root", F.col("node")).select(same, F.col("least.id").alias("component_id"), F.col("least.rid").alias("keep_rid")), "components")
    return join_hot(rows, reach, same, F.col("rid")).select(
        "rid", F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), "component_id", (F.col("rid") == F.col("keep_rid")).alias("kept")
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "near-groups", lambda: near_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id"))
