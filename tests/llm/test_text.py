"""Operators 1, 2, 3, 7, 8 and 10."""

import collections
import functools
import hashlib
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from catalith.llm import bpe, katz, langid, licenses, quality, toxicity
from catalith.llm.common import fit_logistic, labelled_ids, sigmoid, texts_of
from tests.conftest import SF
from tests.llm.helpers import awkward, empty, prose


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path()), bpe.Codec(bpe.read_file())


def test_bpe_like_the_library(library):
    lib, own = library
    rng = random.Random(3)
    pool = [chr(rng.randrange(0x20, 0x3000)) for _ in range(300)] + list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'sxyzaab!!..  ") + ["\U0001f600", "̀", "²", "Ⅷ", "'ll", "'ve", "<|endoftext|>", "<|endof", "\x00", "​", "﻿"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab aaaa thin ing") for _ in range(rng.randrange(0, 60))) for _ in range(500)] + ["a" * 3000, prose(2000, 1)]
    for text, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == want.ids
        assert own.decode(want.ids) == lib.decode(want.ids, skip_special_tokens=False)


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}])
def test_other_tokenizers_are_refused(change):
    with pytest.raises(ValueError):
        bpe.checked({**json.loads(bpe.read_file()), **change})


def test_bpe_small_cache(library, monkeypatch):
    lib, own = library
    monkeypatch.setattr(bpe, "CACHE", 3)
    text = prose(200, 9)
    assert own.encode(text) == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["awkward", "driver"])
def test_bpe_query(spark, library, which):
    lib, _ = library
    docs = awkward(spark) if which == "awkward" else spark.read.parquet(f"{SF}/documents.parquet")
    want = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in bpe.encode_decode(docs).collect())
    assert bpe.tokenize(docs).count() == docs.count() and bpe.encode_decode(empty(spark)).count() == 0


def plain_turing(counts):
    """Katz's Good-Turing ratios for counts 1 to 5, by the textbook; half a count is taken off where they fail."""
    n = collections.Counter(counts)
    share = 6 * n[6] / n[1] if n[1] else 1.0
    out = {}
    for r in range(1, 6):
        ratio = None
        if share < 1:
            better = (r + 1) * n[r + 1] / n[r] if n[r] else r  # r* of Good and Turing
            ratio = (better / r - share) / (1 - share)
        out[r] = ratio if ratio is not None and 0 < ratio < 1 else (r - 0.5) / r
    return lambda c: c * out.get(c, 1.0)


def plain_katz(rows, order):
    """Scores by definition, and sums over all words (one unknown word included) of some histories of every order."""
    tokens = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    train = [t for t, (i, _) in zip(tokens, rows, strict=True) if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2]
    after = [collections.defaultdict(collections.Counter) for _ in range(order)]
    for t in train:
        s = [None, *t]
        for k in range(1, len(s)):
            for n in range(min(order, k + 1)):
                after[n][tuple(s[k - n : k])][s[k]] += 1
    taken = [plain_turing([c for f in level.values() for c in f.values()]) for level in after]
    uni = after[0][()]
    total = sum(uni.values())
    left = sum(map(taken[0], uni.values()))
    unknown = max(1 - left / total, 0.5 / (total + 0.5)) if total else 1.0

    @functools.cache
    def spread(h):
        f, off = after[len(h)][h], taken[len(h)]
        count = sum(f.values())
        base = count if min(f.values()) <= 5 else count + 0.5
        return base, (1 - sum(map(off, f.values())) / base) / (1 - sum(given(w, h[1:]) for w in f))

    @functools.cache
    def given(w, h):
        if not h:
            return taken[0](uni[w]) / left * (1 - unknown) if uni[w] else unknown
        if h not in after[len(h)]:
            return given(w, h[1:])
        base, weight = spread(h)
        c = after[len(h)][h].get(w, 0)
        return taken[len(h)](c) / base if c else weight * given(w, h[1:])

    scores = [sum(math.log10(given(w, tuple(([None, *t])[max(0, k + 2 - order) : k + 1]))) for k, w in enumerate(t)) for t in tokens]
    plain = [sum(math.log10((uni[w] + 1) / (total + len(uni) + 1)) for w in t) for t in tokens]
    sums = [sum(given(w, h) for w in uni) + given(b"not a word", h) for level in after[1:] for h in list(level)[:4]]
    return [(i, len(t), sum(uni[w] > 0 for w in t), total, b, s) for (i, _), t, b, s in zip(rows, tokens, plain, scores, strict=True)], sums


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[4], 3))
    mine = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=key)
    for a, b in zip(mine, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-6 and abs(a[5] - b[5]) < 1e-6
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 7 == 2) for r in got)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_katz(spark, order):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, sums = plain_katz(rows, order)
    assert all(abs(x - 1) < 1e-9 for x in sums)
    same_scores(katz.score(docs.repartition(3), block_bytes=20_000, bucket_tokens=3000, order=order).collect(), want)


def test_katz_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want, sums = plain_katz(rows, 3)
    assert all(abs(x - 1) < 1e-9 for x in sums)
    same_scores(katz.op3_katz(spark, SF).collect(), want)


def test_katz_frequent_histories(spark):
    """Histories that are dealt by n-gram, one of which has no follower seen five times or less."""
    rows = [(k, "a b " * 40 + f"a c{k} b a z{k % 4}") for k in range(40)]
    want, sums = plain_katz(rows, 3)
    assert all(abs(x - 1) < 1e-9 for x in sums)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same_scores(katz.score(docs, block_bytes=500, bucket_tokens=200).collect(), want)


def test_katz_edges(spark):
    assert katz.score(empty(spark)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.score(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (3, 0, 0, 0.0, 0.0)
    assert all(0 < x < 1 for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 2, 3, 4, 5, 6], [100, 40, 20, 10, 6, 3]) for x in katz.turing(n)[1:6])
    with pytest.raises(ValueError):
        katz.score(empty(spark), order=1)


def test_logistic_regression():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 50, size=(400, 3))
    y = (x == 7).any(axis=1) | (rng.random(400) < 0.02)
    w, b = fit_logistic([(np.unique(r), np.ones(len(np.unique(r)))) for r in x], y.astype(float), 64, 0.1)
    p = sigmoid(np.array([w[np.unique(r)].sum() + b for r in x]))
    assert w.argmax() == 7 and ((p > 0.5) == (x == 7).any(axis=1)).mean() > 0.97
    assert fit_logistic([], np.array([]), 4, 1.0)[1] == 0


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = collections.Counter(windows)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeat = len({k + j for k, w in enumerate(windows) if n[w] > 1 for j in range(3)})
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def test_quality(spark):
    for docs in (awkward(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
        got = quality.score(docs, model).collect()
        want = sorted(str((r["doc_id"], *plain_quality(r["text"]))) for r in docs.collect())
        assert sorted(str(tuple(r)[:7]) for r in got) == want
        assert all(r["kept"] == (not r["base_failed"]) for r in got)
        assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(empty(spark), model).count() == 0


def held_out(spark, label, truth, folder):
    """Predictions for labelled rows that training never saw."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels


def test_quality_learns(spark):
    """On rows never trained on that pass the base rules, the model's verdict is the label; and it alone is right on nearly all rows."""
    docs, labels = held_out(spark, "quality", None, "/root/testdata/sf0.1")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = quality.score(docs, model).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "label"), "doc_id").collect()
    judged = [r for r in rows if not r["base_failed"]]
    assert len(judged) > 500 and sum(r["kept"] == (r["label"] == 1) for r in judged) / len(judged) > 0.98
    assert sum((r["quality"] >= 0.5) == (r["label"] == 1) for r in rows) / len(rows) > 0.9
    assert all(r["kept"] == (not r["base_failed"] and r["quality"] >= quality.KEEP_AT) for r in rows)


def test_one_row_of_an_id_is_read(spark):
    """The bound counts rows: many rows of one id, repeated and conflicting labels give one row each."""
    docs = spark.range(2000).selectExpr("id % 2 as doc_id", "concat('text ', id % 40) as text").unionByName(spark.createDataFrame([(5, None), (5, "b"), (None, "c")], "doc_id long, text string"))
    labels = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 0), (5, None), (5, 7), (5, 1), (None, 1)], "doc_id long, quality int")
    rows = texts_of(docs, labelled_ids(labels, "quality", 10)).collect()
    assert sorted((r["doc_id"], r["y"]) for r in rows) == [(0, 1), (1, 0), (5, 1)]
    assert len(texts_of(docs, labelled_ids(labels, "quality", 2)).collect()) == 2


def test_toxicity_learns(spark):
    docs, labels = held_out(spark, "toxic", None, "/root/testdata/sf0.1")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    hit, said, true = (sum(f(r) for r in rows) for f in (lambda r: r["predicted"] and r["toxic"], lambda r: r["predicted"], lambda r: r["toxic"]))
    assert hit / said > 0.95 and hit / true > 0.8
    everything = toxicity.score(docs, model)
    assert everything.count() == docs.count() and everything.where("score < 0 or score > 1 or predicted <> cast(score >= 0.5 as int)").count() == 0


def test_toxicity_edges(spark):
    docs, none = awkward(spark), spark.createDataFrame([], "doc_id long, toxic int")
    labels = spark.createDataFrame([(1, 1), (10, 0), (None, 1), (9, None), (999, 1), (8, 5)], "doc_id long, toxic int")
    for rows in (none, labels):
        model = toxicity.train(docs, rows)
        assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(empty(spark), model).count() == 0
        assert toxicity.keep_clean(docs, model).columns == docs.columns
    alone = toxicity.train(docs, none)
    assert toxicity.probability(b"You IDIOT!", alone["w"], alone["b"]) > 0.5 > toxicity.probability(b"", alone["w"], alone["b"])


def plain_label_model(v, given, parent, rounds):
    """Expectation maximisation, one row, voter and class at a time."""
    n, m = len(v), len(v[0])

    def rates(rows, p, prior, weight):
        out = {}
        for j in range(m):
            for y in (0, 1):
                for u in (0, 1):
                    fired = held = 0.0
                    for i in rows:
                        if (v[i][parent[j]] if parent[j] >= 0 else 0) == u:
                            share = p[i] if y else 1 - p[i]
                            held += share
                            fired += share * v[i][j]
                    out[j, y, u] = min(max((fired + weight * prior(j, y, u)) / (held + weight), 1e-5), 1 - 1e-5)
        return out

    T, S = toxicity.TRUST, toxicity.SEED_ROWS
    labelled = [i for i in range(n) if given[i] == given[i]]
    share = sum(given[i] for i in labelled) / len(labelled)
    start = [(T if given[i] else 1 - T) if given[i] == given[i] else share for i in range(n)]
    behind = rates(labelled, start, lambda *_: 0.5, 2.0)
    p = list(start)
    for _ in range(rounds):
        prior = (sum(p) + toxicity.SEED_ROWS * share) / (n + toxicity.SEED_ROWS)
        rate = rates(range(n), p, lambda *k: behind[k], S)
        right = []
        for y in (0, 1):
            mass = [(p[i] if y else 1 - p[i], given[i] == y) for i in labelled]
            right.append(min((sum(a for a, ok in mass if ok) + T * S) / (sum(a for a, _ in mass) + S), T))
        new = []
        for i in range(n):
            odds = [1 - prior, prior]
            for y in (0, 1):
                if given[i] == given[i]:
                    odds[y] *= right[y] if given[i] == y else 1 - right[y]
                for j in range(m):
                    if v[i][j]:
                        odds[y] *= rate[j, y, v[i][parent[j]] if parent[j] >= 0 else 0]
            new.append(odds[1] / sum(odds))
        moved, p = max(abs(a - b) for a, b in zip(new, p, strict=True)), new
        if moved < 1e-4:
            break
    return p


def test_label_model_like_brute_force():
    rng = np.random.default_rng(4)
    y = rng.random(300) < 0.3
    v = (rng.random((300, 5)) < np.where(y[:, None], [0.6, 0.5, 0.3, 0.2, 0.1], [0.02, 0.05, 0.1, 0.1, 0.1])).astype(np.int8)
    v[:, 3] = v[:, 2]
    given = np.where(rng.random(300) < 0.4, y ^ (rng.random(300) < 0.05), np.nan)
    model = toxicity.LabelModel(v, given)
    assert (model.parent[[2, 3]] >= 0).any()
    assert np.allclose(model.posterior(v, given), plain_label_model(v.tolist(), given.tolist(), model.parent.tolist(), 50), atol=1e-6)
    assert np.corrcoef(model.posterior(v), y)[0, 1] > 0.5
    accuracy = model.accuracy(v)
    assert accuracy[0] > accuracy[2] > accuracy[4]


def test_posteriors_are_not_the_given_labels(spark):
    """The label model is fitted to unlabelled texts too, and its posteriors stand against labels that are wrong."""
    docs, labels = held_out(spark, "toxic", None, "/root/testdata/sf0.1")
    model = toxicity.train(docs, labels)
    given, posterior = model["given"], model["posterior"]
    assert np.isnan(given).sum() > 1000 and len(model["voters"]) > 30
    known = ~np.isnan(given)
    assert ((posterior > 0.5) != (given == 1))[known].mean() < 0.1
    wrong = labels.withColumn("toxic", F.expr("if(doc_id % 10 = 3, 1 - toxic, toxic)"))
    noisy = toxicity.train(docs, wrong)
    told = ~np.isnan(noisy["given"])
    assert ((noisy["posterior"] > 0.5) != (noisy["given"] == 1))[told].sum() > 10
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.score(docs, noisy).where("held_out").collect()
    judged = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["doc_id"] in truth]
    assert sum(a == b for a, b in judged) / len(judged) > 0.93


def page(lang, text, head=""):
    return f'<html lang="{lang}"><head>{head}</head><body><script>var x = "the the";</script><p>{text}</p><!-- the --></body></html>'


def test_language_id(spark):
    docs = spark.createDataFrame([(k, prose(200, k), "en") for k in range(5)] + [(9 + k, "der die das und nicht wir sie haben werden ist ein eine " * 20, "de") for k in range(5)] + [(50, None, "de"), (51, "x", None)], "doc_id long, text string, lang string")
    rows = [(1, "https://a.example.de/x", page("de", "die das und wir haben eine " * 9)), (2, "http://b.example.com", page("de", prose(80, 77))), (3, None, None), (4, "nonsense", ""), (5, "https://a.example.de/y", "<html><body></body></html>"), (None, "https://u@b.example.com:80/?q", page("xx", prose(50, 8)))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in langid.identify(pages, docs).collect()}
    assert len(got) == 6 and got[1]["lang"] == "de" and got[2]["text_lang"] == got[None]["lang"] == "en" and got[5]["lang"] == "de"
    assert got[None]["host"] == "b.example.com" and got[3]["host"] == "" and got[2]["declared"] == "de" and got[5]["declared"] is None
    assert all(0 < r["probability"] <= 1 + 1e-9 for r in got.values())
    none = langid.identify(pages, docs.where("false")).collect()
    assert len(none) == 6 and all(r["lang"] is None for r in none)
    assert langid.identify(pages.where("false"), docs).count() == 0


def test_registered_domains(spark):
    hosts = ["a.b.example.com", "example.com", "www.shop.co.uk", "co.uk", "10.0.0.1", "localhost", "", "x.com.au.example.org"]
    rows = spark.createDataFrame([(k, h) for k, h in enumerate(hosts)], "k int, host string").select("k", langid.registered(F.col("host")).alias("d")).orderBy("k").collect()
    assert [r["d"] for r in rows] == ["example.com", "example.com", "shop.co.uk", "co.uk", "10.0.0.1", "localhost", "", "example.org"]


def plain_text_model(docs):
    """Trigram counts by language, hashed as the operator's places are, counted one by one."""
    counts = {}
    for lang, text in docs:
        if lang is not None:
            c = counts.setdefault(lang, collections.Counter())
            raw = b" ".join((text or "").encode().lower().split())
            for k in range(len(raw) - 2):
                c[raw[k] << 16 | raw[k + 1] << 8 | raw[k + 2]] += 1
    places = {g: (g * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS) for c in counts.values() for g in c}
    by_place = {}
    for lang, c in counts.items():
        own = by_place.setdefault(lang, collections.Counter())
        for g, n in c.items():
            own[places[g]] += n
    return by_place


def test_language_id_posterior(spark):
    """The fused posterior, recomputed page by page from the texts, with each page's own share taken out of all sums."""
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/pages.parquet")
    model = plain_text_model([(r["lang"], r["text"]) for r in docs.collect()])
    langs = sorted(model)
    size = {x: sum(model[x].values()) + 0.5 * 2**langid.BITS for x in langs}
    P, n, rows = langid.PSEUDO, len(langs), []
    for r in pages.collect():
        text = langid.visible((r["html"] or "").encode())
        likely = np.zeros(n)
        for k in range(len(text) - 2):
            place = ((text[k] << 16 | text[k + 1] << 8 | text[k + 2]) * 0x9E3779B97F4A7C15 % 2**64) >> (64 - langid.BITS)
            likely += [langid.TEMPER * math.log((model[x][place] + 0.5) / size[x]) for x in langs]
        likely -= likely.max()
        post = np.exp(likely) / np.exp(likely).sum()
        host = re.match(r"[a-z]+://([^/:?#]*)", r["url"])[1].lower()
        labels = host.split(".")
        rows.append((r["page_id"], likely, post, host, ".".join(labels[-2:]), labels[-1], langid.declared(r["html"].encode())))
    sums = [collections.defaultdict(lambda: np.zeros(n)) for _ in range(4)]
    total = sum(x[2] for x in rows)
    for x in rows:
        for s, key in zip(sums, x[3:], strict=True):
            s[key] += x[2]
    want = {}
    for i, likely, post, *keys in rows:
        host, domain, suffix, mark = (np.maximum(s[k] - post, 0) for s, k in zip(sums, keys, strict=True))
        rest = total - post
        up = (rest + P / n) / (rest.sum() + P)
        up = (domain + P * up) / (domain.sum() + P)
        z = likely + np.log((host + P * up) / (host.sum() + P)) + np.log((suffix + 0.5) / (rest + 1))
        if keys[3]:
            z = z + np.log((mark + 0.5) / (rest + 1))
        z = np.exp(z - z.max())
        want[i] = (langs[int(z.argmax())], z.max() / z.sum())
    got = langid.identify(pages, docs).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["lang"] == want[r["page_id"]][0] and abs(r["probability"] - want[r["page_id"]][1]) < 1e-4


def test_language_id_awkward_pages(spark):
    """Very long html, columns with clashing names, and one host that holds most pages."""
    docs = spark.createDataFrame([(k, prose(200, k), "en") for k in range(5)] + [(9, "der die das und nicht wir " * 40, "de")], "doc_id long, text string, lang string")
    rows = [(k, "http://one.example.com/", page("en", prose(30, k))) for k in range(90)] + [(900, "http://two.example.com/", page("de", "der die das und wir " * 20_000)), (900, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "suffix", "declared", "post", "z", "lang", "domain", "c")})
    got = langid.identify(pages, docs).collect()
    assert len(got) == 92 and sum(r["lang"] == "en" for r in got) >= 90 and [r["lang"] for r in got if r["host"] == "two.example.com"] == ["de"]
    with pytest.raises(ValueError):
        langid.text_models(spark.range(langid.MAX_LANGS + 1).selectExpr("cast(id as string) as lang", "'x' as text"))


def plain_licenses(text):
    """Licenses of which some stretch of text holds enough of the shingles: a window of any begin, and half a template around it."""
    words, found = licenses.words_of(text or ""), {}
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    for name, t in licenses.TEMPLATES.items():
        own = licenses.words_of(t)
        want = {tuple(own[k : k + 5]) for k in range(len(own) - 4)}
        if not want & set(grams):
            continue
        size = len(own) + max(1, len(own) // 4)
        step = size - len(own) + 1
        for b in range(0, len(grams), step):
            lo = max(0, b - len(own) // 2)
            held = grams[lo : b + size - 4 + len(own) // 2]
            if len(want & set(held)) >= 0.8 * len(want):
                at = lo + next(k for k, g in enumerate(held) if g in want) + 1
                found[name] = min(at, found.get(name, at))
    return found


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT-permission"], licenses.TEMPLATES["GPL-3.0"]
    half = mit.split()
    rows = [(1, prose(300, 1) + "\n" + mit.upper().replace(", ", ",\n  ") + prose(50, 2)), (2, gpl), (3, mit.replace("publish", "PRINT")), (4, " ".join(mit.split()[:20])), (5, None), (6, ""), (7, "Licensed under"), (8, (gpl + " ") * 3), (8, (gpl + " ") * 3), (9, prose(20_000, 3) + " " + licenses.TEMPLATES["CC-BY-NC-4.0"])]
    rows += [(20 + k, prose(k, k) + " " + " ".join(half[:25]) + " " + prose(15, 70 + k) + " " + " ".join(half[25:])) for k in range(0, 40, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(awkward(spark).where("doc_id > 3"), allowMissingColumns=True)
    got = licenses.scan(docs).collect()
    want = sorted((r["doc_id"], x) for r in docs.collect() for x in plain_licenses(r["text"]))
    assert sorted((r["doc_id"], r["license"]) for r in got) == want and {x for _, x in want} >= {"MIT-permission", "GPL-3.0", "CC-BY-NC-4.0"}
    assert {r["doc_id"] for r in got if r["license"] == "MIT-permission"} >= {1, 3, *range(20, 60, 3)}
    assert {r["doc_id"]: r["first_word"] for r in got if r["doc_id"] in (1, 2, 8)} == {1: 301, 2: 1, 8: 1}
    assert licenses.scan(empty(spark)).count() == 0
    plan = licenses.scan(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    with pytest.raises(ValueError):
        licenses.scan(docs, {"short": "too short"})


def test_licenses_across_segments(spark, monkeypatch):
    """Where a text is cut changes nothing."""
    docs = spark.createDataFrame([(k, prose(k, k) + " " + licenses.TEMPLATES["BSD-conditions"] + " " + prose(90, k + 1) + " " + licenses.TEMPLATES["ISC"]) for k in range(60, 90)], "doc_id long, text string")
    whole = sorted(map(tuple, licenses.scan(docs).collect()))
    monkeypatch.setattr(licenses, "SEGMENT", 32)
    assert sorted(map(tuple, licenses.scan(docs).collect())) == whole and len(whole) == 60
