"""Small tables with every awkward row: nulls, blanks, ties, repeats, long texts, clashing columns."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and to in a is that for with was on as it by from at an be this sea wind stone river field cloud paper glass north light".split()


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + (rng.choice(("", "", "", ".", ",\n")) if k % 7 == 6 else "") for k in range(n))


def awkward(spark):
    """Documents with all of it; `keep_id`, `digest` and `row` clash with names the operators use."""
    long = prose(60, 1) + " " + prose(30_000, 2)
    rows = [
        (1, prose(80, 3), "en", "a", 1), (2, prose(80, 3), "en", "a", 1), (2, prose(80, 3), "en", "a", 1), (3, prose(80, 3).replace(" ", "\t \n"), None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, " \n", "de", "a", 2), (None, prose(90, 4), "en", "a", 5), (None, None, None, None, None),
        (7, long, "en", "b", 1), (8, "one two", "en", "b", 1), (9, prose(80, 5) + " ünïcödé 🙂   ", "fr", "b", 1), (10, prose(100, 6), "en", "b", 1),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(1) for c in ("keep_id", "digest", "row", "kept", "rid", "w", "s", "y", "fp", "bucket", "rank", "length", "number", "held")})


def empty(spark):
    return spark.createDataFrame([], DOCS)


def save(df, folder, name):
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
