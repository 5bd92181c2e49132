"""Operator 1: language identification of web pages by Bayesian evidence fusion.

Four kinds of evidence meet in one posterior per page: the likelihood of its visible text under byte-trigram models of
each language; the language its markup declares; the suffix of its address; and the languages of its host. The text
models come from all of `documents` (by its lang column). The reliability of declarations and suffixes, and the host
priors, come from grouped aggregates of the text posteriors over all pages. Host priors are smoothed hierarchically:
a host's counts towards its registered domain's, those towards the global ones, each with `PSEUDO` pages of prior. A page's
own text posterior is taken out of every sum that it is judged by, so no evidence counts twice.

Text likelihoods are tempered by `TEMPER`, since trigrams of one text are not independent evidence.

A registered domain is the last two labels of a host, or three where the last two are a public suffix: a country's letters
under one of `SECOND_LEVEL`. A host that is an address of numbers is its own domain.

Defined cases. Null html has no text, no declaration, and is decided by address and host; a null or malformed url has
the empty host, which is one host. Repeated pages count each time. Very long html is read whole. Columns besides page_id, url and html are
not read. Of equally likely languages the first by name is chosen. With no documents, or none with a language, no language is known and lang is null.
Every language of `documents` has a model; more than `MAX_LANGS` raise an error, since the models are held by each task.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import gram_hashes, join_hot, map_arrow, materialise, raw_texts, slot, stored, table

BITS = 15
GRAM = 3
MAX_LANGS = 1024
TEMPER = 0.05
PSEUDO = 5.0

# fixed values: labels that countries register domains under
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "or", "org")

_HIDDEN = re.compile(rb"(?is)<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<[^>]*>")
_DECLARED = re.compile(rb"(?is)<html\b[^>]*?\slang\s*=\s*[\"']?\s*([a-z]{2,3})\b")
_META = re.compile(rb"(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?\s*([a-z]{2,3})\b")


def visible(raw: bytes) -> bytes:
    text = _HIDDEN.sub(b" ", raw)
    if b"&" in text:
        text = htmllib.unescape(text.decode("utf-8", "replace")).encode("utf-8", "replace")
    return b" ".join(text.lower().split())


def declared(raw: bytes) -> str:
    found = _DECLARED.search(raw) or _META.search(raw)
    return found[1].decode().lower() if found else ""


def places(raw: bytes) -> np.ndarray:
    return slot(gram_hashes(raw, GRAM), BITS)


def text_models(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages, and the log probability of every trigram place in each: all texts are counted."""
    known = docs.where("lang is not null").select("lang").distinct().limit(MAX_LANGS + 1)
    langs = sorted(r["lang"] for r in known.collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    number = {x: k for k, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch["lang"].to_pylist(), raw_texts(batch["text"]), strict=True):
                if (k := number.get(lang)) is not None:
                    counts.setdefault(k, np.zeros(1 << BITS, dtype=np.int64))
                    counts[k] += np.bincount(places(b" ".join(raw.lower().split())), minlength=1 << BITS)
        for k, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at])], names=["k", "at", "n"])

    got = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "k int, at int, n long").groupBy("k", "at").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(langs), 1 << BITS), 0.5)
    counts[got["k"].to_numpy(), got["at"].to_numpy()] += got["n"].to_numpy()
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if langs else counts


def read_pages(pages: DataFrame, langs: list[str], logs: np.ndarray) -> DataFrame:
    """page_id, host, domain, suffix, declared, and the tempered log likelihood and text posterior by language."""
    shared = pages.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        likely, marks = np.zeros((batch.num_rows, len(langs))), []
        for i, raw in enumerate(raw_texts(batch["html"])):
            marks.append(declared(raw))
            at = places(visible(raw))
            if len(at):
                use, n = np.unique(at, return_counts=True)
                likely[i] = TEMPER * (n @ shared.value[use])
        likely -= likely.max(axis=1, keepdims=True)
        post = np.exp(likely)
        post /= post.sum(axis=1, keepdims=True)
        lists = [pa.array(list(x), pa.list_(pa.float64())) for x in (likely, post)]
        return pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], pa.array(marks, pa.string()), *lists], names=["page_id", "host", "declared", "likely", "post"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), F.col("html").cast("string"))
    rows = map_arrow(rows, run, "page_id long, host string, declared string, likely array<double>, post array<double>")
    return rows.withColumn("domain", registered(F.col("host"))).withColumn("suffix", F.substring_index("host", ".", -1))


def registered(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    numbers = host.rlike(r"^[0-9.]+$|^\[")
    public = two.rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$")
    return F.when(numbers, host).when(public, F.substring_index(host, ".", -3)).otherwise(two)


def _sums(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[F.sum(F.col("post")[k]) for k in range(n)]).alias("c"))


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, lang, probability, text_lang, declared, suffix, host for every page."""
    langs, logs = text_models(docs)
    n = len(langs)
    if not n:
        return pages.select(F.col("page_id").cast("long"), *[F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"), ("declared", "string"), ("suffix", "string"), ("host", "string"))])
    rows = materialise(read_pages(pages, langs, logs), "page-evidence")
    whole = rows.agg(*[F.sum(F.col("post")[k]).alias(str(k)) for k in range(n)]).first()
    total = F.array(*[F.lit(float(x or 0.0)) for x in whole])
    hosts = materialise(_sums(rows, ["host", "domain"], n), "hosts")
    domains = hosts.groupBy("domain").agg(F.array(*[F.sum(F.col("c")[k]) for k in range(n)]).alias("by_domain"))
    # a domain may have very many hosts, a host or a suffix a third of all pages
    by_host = join_hot(hosts, domains, "domain", F.col("host")).select("host", F.col("c").alias("by_host"), "by_domain")
    by_suffix = _sums(rows, ["suffix"], n).withColumnRenamed("c", "by_suffix")
    # declared languages have two or three letters, so there are few
    by_markup = F.broadcast(_sums(rows, ["declared"], n).withColumnRenamed("c", "by_markup"))
    fused = materialise(join_hot(rows, by_suffix, "suffix", F.col("page_id")), "page-suffix")
    fused = join_hot(fused, by_host, "host", F.col("page_id")).join(by_markup, "declared")

    def rest(c: Column) -> Column:
        """Sums of all other pages; rounding may leave them a little below zero."""
        return F.zip_with(c, "post", lambda x, own: F.greatest(x - own, F.lit(0.0)))

    def smoothed(c: Column, prior: Column) -> Column:
        size = F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(c, prior, lambda x, p: (x + PSEUDO * p) / (size + PSEUDO))

    def reliability(c: Column) -> Column:
        """log P(value | language)."""
        return F.zip_with(rest(c), rest(total), lambda x, t: F.log((x + 0.5) / (t + 1.0)))

    base = smoothed(rest(total), F.array(*[F.lit(1.0 / n)] * n))
    prior = F.transform(smoothed(rest(F.col("by_host")), smoothed(rest(F.col("by_domain")), base)), lambda x: F.log(x))
    # a page without a declaration is no evidence
    markup = F.when(F.col("declared") == "", F.transform("post", lambda x: F.lit(0.0))).otherwise(reliability(F.col("by_markup")))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = fused.withColumn("z", add(add(F.col("likely"), markup), add(reliability(F.col("by_suffix")), prior)))
    best = F.array_max("z")
    spread = F.aggregate("z", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("best")))
    fused = fused.withColumn("best", best)
    names = F.array(*map(F.lit, langs))
    return fused.select(
        "page_id",
        names[(F.array_position("z", F.col("best")) - 1).cast("int")].alias("lang"),
        (1 / spread).alias("probability"),
        names[(F.array_position("post", F.array_max("post")) - 1).cast("int")].alias("text_lang"),
        F.nullif("declared", F.lit("")).alias("declared"), "suffix", "host",
    )


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, "page-languages", lambda: identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")))
