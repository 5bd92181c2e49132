"""Operators 4, 5 and 6 against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from catalith.llm import exact_dedup, packing, simhash
from tests.conftest import SF
from tests.llm.helpers import awkward, empty, prose


def all_documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def plain_fingerprint(text, shingle=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[k : k + shingle]) for k in range(len(words) - shingle + 1)] if len(words) >= shingle else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps, max_bits=3):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[root(i)] = root(j)
    groups = {}
    for k in range(len(ids)):
        groups.setdefault(root(k), []).append(ids[k])
    least = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return [least[root(k)] for k in range(len(ids))]


@pytest.mark.parametrize("which", ["awkward", "driver"])
def test_simhash(spark, which):
    docs = awkward(spark) if which == "awkward" else all_documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    if which == "awkward":
        rows = [(i, t) for i, t in rows]
    fps = [plain_fingerprint(t) for _, t in rows]
    want = sorted(str((i, f"{f:016x}", c)) for (i, _), f, c in zip(rows, fps, plain_components([i for i, _ in rows], fps), strict=True))
    got = simhash.near_groups(docs).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_simhash_links_at_most_three_bits(spark):
    """Pairs at every distance, with equal and different bytes, and lists that are split into blocks."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, size=30, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for bits in (1, 2, 3, 4, 5):
            at = rng.choice(64, size=bits, replace=False)
            fps.append(b ^ np.uint64(sum(1 << int(k) for k in at)))
    nodes = spark.createDataFrame([(k, int(f).to_bytes(8, "big")) for k, f in enumerate(fps)], "node long, fp binary")
    want = plain_components(list(range(len(fps))), [int(f) for f in fps])
    for size in (simhash.LIST_ROWS, 2):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, simhash.STRICT, size), size - 2).collect()}
        assert [roots.get(k, k) for k in range(len(fps))] == want


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "a long, b long").repartition(7)
    for task_links in (0, 10, simhash.TASK_LINKS):
        roots = {r["node"]: r["root"] for r in simhash.components(edges, task_links).collect()}
        assert roots == {**{k: 0 for k in range(1, 201)}, 501: 500}


def test_forest_of_a_long_list():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 256, size=(3, 8), dtype=np.uint8).repeat(40, axis=0)
    fps[np.arange(120), 7] ^= np.arange(120, dtype=np.uint8) % 2
    links = simhash.forest(np.arange(120), fps, simhash.STRICT)
    sets = simhash.Sets()
    for a, b in links:
        sets.join(a, b)
    assert len(links) == 117 and len({sets.root(k) for k in range(120)}) == 3


def test_covering():
    groups = simhash.covering(8, 5, 3)
    from itertools import combinations

    assert all(any(set(g) <= set(c) for g in groups) for c in combinations(range(8), 5))


def test_similar_texts(spark):
    """Copies with a Jaccard similarity of 0.8 or more of their five-word shingles are found; unrelated texts are not."""
    rows, rng = [], np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(5000)]
    for k in range(60):
        words = [vocabulary[i] for i in rng.integers(0, 5000, size=300)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.choice(range(10, 290), size=5, replace=False):
            words[at] = "changed"
        rows.append((2 * k + 1, " ".join(words)))
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), profile=simhash.SIMILAR).collect()
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert all(by_id[2 * k + 1] == 2 * k for k in range(60))  # five changed words leave at least 271 of 321 shingles
    assert all(by_id[2 * k] == 2 * k for k in range(60))
    assert sum(r["kept"] for r in got) == len(set(by_id.values()))


def plain_similar(texts, similarity=0.8):
    """The smallest place reachable by pairs of five-word shingle sets with that Jaccard similarity."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()})
    least = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or shared and shared / (len(sets[i]) + len(sets[j]) - shared) >= similarity:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return least


def altered(similarity_steps, seed=11, length=200):
    """Texts with copies whose tail is other words, so that similarities lie on both sides of 0.8."""
    rng, texts = np.random.default_rng(seed), []
    for k in range(30):
        words = [f"w{i}" for i in rng.integers(0, 5000, size=length)]
        texts.append(" ".join(words))
        for cut in similarity_steps:
            texts.append(" ".join(words[: length - cut] + [f"x{i}" for i in rng.integers(0, 5000, size=cut)]))
    return texts


def test_similar_texts_are_verified(spark):
    """Only texts with a path of exact similarities of 0.8 or more share a component, whatever their fingerprints say."""
    texts = altered((10, 21, 24, 30, 40)) + ["spam eggs " * 40 + f"{k} one two three four five six" for k in range(3)] + [None, "", "one two"]
    got = simhash.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profile=simhash.SIMILAR).collect()
    want = plain_similar(texts)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert all(want[k] == want[c] for k, c in by_id.items())
    assert sum(r["kept"] for r in got) >= len(set(want))


def test_no_similar_pair_is_missed(spark):
    """Isolated pairs just above 0.8 all meet, also where most shingles are frequent ones and groups are split."""
    texts = [x for k in range(8) for x in altered((21,), seed=20 + k)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, profile=simhash.SIMILAR).collect()}
    assert [got[k] for k in range(len(texts))] == plain_similar(texts) == [k // 2 * 2 for k in range(len(texts))]
    ids = spark.createDataFrame([(k, 0) for k in range(1, len(texts))], "node long, root long")
    split = simhash.components(simhash.verified(docs.withColumnRenamed("doc_id", "rid"), ids, simhash.SIMILAR, 100))
    assert {r["node"]: r["root"] for r in split.collect()} == {k: k - 1 for k in range(1, len(texts), 2)}
    sets = [np.unique(simhash.shingles(t.encode(), 5).astype(np.uint64)) for t in texts]
    for common in (np.empty(0, dtype=np.uint64), sets[0], np.unique(np.concatenate(sets))[::3]):
        heads = [simhash.posted(x, common, 0.8) for x in sets]
        assert all(len(np.intersect1d(heads[k], heads[k + 1])) for k in range(0, len(sets), 2))


def test_jaccard_forest():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 10**6, size=50, dtype=np.uint64)
        sets += [np.unique(np.concatenate([base[: 50 - c], rng.integers(0, 10**6, size=c, dtype=np.uint64)])) for c in (0, 3, 5, 6, 8, 12)]
    sets.append(np.empty(0, dtype=np.uint64))
    links = simhash.jaccard_forest(np.arange(len(sets)), sets, 0.8)
    found, want = simhash.Sets(), simhash.Sets()
    for a, b in links:
        assert found.join(a, b)
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if shared and shared / (len(sets[i]) + len(sets[j]) - shared) >= 0.8:
                want.join(i, j)
    assert [found.root(k) for k in range(len(sets))] == [want.root(k) for k in range(len(sets))]


def plain_groups(rows):
    out = []
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for (i, _), t in zip(rows, texts, strict=True):
        same = [j for (j, _), u in zip(rows, texts, strict=True) if t == u]
        out.append((i, min((j for j in same if j is not None), default=None), len(same), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts, radix", [(1, 16), (9, 2), (9, 3)])
def test_exact_dedup(spark, parts, radix):
    docs = awkward(spark).repartition(parts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = exact_dedup.exact_groups(docs, radix=radix).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == sorted(map(str, plain_groups(rows)))
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({r["text_sha256"] for r in got})
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_merge_of_sorted_runs():
    """Pieces of several runs become one sorted run without repeats; a split run and small pieces change nothing."""
    import pyarrow as pa

    rng = np.random.default_rng(6)
    runs = []
    for run in range(5):
        t = np.zeros((400, 10), dtype=np.uint64)
        t[:, 0] = rng.integers(0, 300, size=400)
        t[:, 8] = np.arange(400) + 1000 * run
        t[:, 9] = np.uint64(1 << 63) + np.uint64(1)
        runs.append(t[np.lexsort(t[:, 8::-1].T)])
    pieces = []
    for t in runs:
        t = exact_dedup._collapse([t])
        cut = sorted(rng.choice(len(t), size=6, replace=False))
        pieces += [p for p in np.split(t, cut) if len(p)]
    pieces.sort(key=lambda p: p[0, :4].tolist())
    batch = pa.RecordBatch.from_pydict({"rng": [0] * len(pieces), "run": [0] * len(pieces), "first": [p[0, :4].astype(">u8").tobytes() for p in pieces], "entries": [p.tobytes() for p in pieces]})
    got = np.concatenate([np.frombuffer(x, dtype=np.uint64).reshape(-1, 10) for b in exact_dedup._merged(iter([batch])) for x in b["entries"].to_pylist()])
    everything = np.concatenate(runs)
    keys, n = np.unique(everything[:, 0], return_counts=True)
    assert got[:, 0].tolist() == keys.tolist() and exact_dedup._number(got[:, 9].copy()).tolist() == n.tolist()
    assert got[:, 8].tolist() == [everything[everything[:, 0] == k, 8].min() for k in keys]


def test_one_large_group(spark):
    docs = spark.range(3000).selectExpr("id + 5 as doc_id", "if(id % 3 = 0, 'same  text', concat('text ', id)) as text").repartition(13)
    got = exact_dedup.exact_groups(docs)
    assert got.where("kept").count() == 2001 and got.where("group_size = 1000 and keep_id = 5").count() == 1000


def test_empty(spark):
    for fn in (exact_dedup.exact_groups, simhash.near_groups, packing.pack):
        assert fn(empty(spark)).count() == 0


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        lengths = np.sort(rng.choice(np.arange(0, 60), size=n, replace=False))
        counts = rng.integers(1, 20, size=n)

        def padded(bounds, lengths=lengths, counts=counts):
            return sum(int(c) * min(b for b in bounds if b >= x) for x, c in zip(lengths, counts, strict=True))

        for k in (1, 2, 3):
            best = min(padded([*some, lengths[-1]]) for m in range(k) for some in combinations(lengths[:-1], m))
            found = packing.boundaries(lengths, counts, k)
            assert len(found) <= k and found[-1] == lengths[-1] and padded(found) == best


def plain_packing(rows, buckets, budget):
    """Boundaries by trying all splits with a table, places by sorting."""
    n = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t in rows]
    sizes = sorted({x for _, x in n})
    count = {x: sum(y == x for _, y in n) for x in sizes}
    best = {(0, 0): (0, [])}
    for k in range(1, buckets + 1):
        for j in range(1, len(sizes) + 1):
            found = [(best[k - 1, i][0] + sizes[j - 1] * sum(count[x] for x in sizes[i:j]), best[k - 1, i][1] + [sizes[j - 1]]) for i in range(j) if (k - 1, i) in best]
            if found:
                best[k, j] = min(found, key=lambda f: f[0])
    padded = min((best[k, len(sizes)][0] for k in range(1, buckets + 1) if (k, len(sizes)) in best), default=0)
    return n, padded


def check_packing(got, rows, buckets, budget):
    n, padded = plain_packing(rows, buckets, budget)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=key) == sorted(n, key=key)
    assert sum(r["padded_tokens"] for r in got) == padded
    for bucket in {r["bucket"] for r in got}:
        own = sorted((r for r in got if r["bucket"] == bucket), key=lambda r: key((r["doc_id"], r["n_tokens"])))
        assert len({r["padded_tokens"] for r in own}) == 1 and all(r["n_tokens"] <= r["padded_tokens"] for r in own)
        capacity = max(1, budget // max(1, own[0]["padded_tokens"]))
        places = [(k // capacity, k % capacity) for k in range(len(own))]
        assert sorted((r["batch"], r["slot"]) for r in own) == places
        if len({key((r["doc_id"], r["n_tokens"])) for r in own}) == len(own):
            assert [(r["batch"], r["slot"]) for r in own] == places


def test_packing(spark):
    docs = awkward(spark).unionByName(spark.createDataFrame([(100 + k, prose(k % 50, k), "en", "c", 1) for k in range(300)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    check_packing(packing.pack(docs, buckets=4, budget=200).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 4, 200)


def test_packing_of_many_rows_and_long_texts(spark):
    """Ids are in order at any size, also those of one length; lengths beyond a few thousand words count exactly."""
    rows = [(k, "w " * (3 if k % 3 else 5 + k % 17)) for k in range(5000)] + [(9000 + k, "w " * (5000 + 7 * k)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check_packing(packing.pack(docs, buckets=6, budget=64).collect(), rows, 6, 64)


def test_packing_of_one_id(spark):
    docs = spark.range(4000).selectExpr("if(id % 2 = 0, null, 7) as doc_id", "repeat('w ', cast(id % 3 as int)) as text")
    check_packing(packing.pack(docs, buckets=2, budget=64).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 2, 64)


def test_splits_are_the_best():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 7, 64, 200):
        size = np.sort(rng.choice(10_000, size=n, replace=False)).astype(np.int64)
        before = np.concatenate([[0], np.cumsum(rng.integers(1, 50, size=n))])
        tail = np.concatenate([[0], (size * before[1:])[:-1]])
        want = [min(range(j + 1), key=lambda i, j=j: (tail[i] - size[j] * before[i], i)) for j in range(n)]
        assert packing._splits(tail, size, before).tolist() == want
