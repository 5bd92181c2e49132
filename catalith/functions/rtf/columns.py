"""The rich-text functions on columns, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rtf_links, rtf_to_html
from .lexer import tokens

# fixed values: marks in texts, in the order in which they are replaced
PLACEHOLDERS = {"--TYP--": "typ", "--FGSTNR--": "fgstnr", "--MODELL--": "modell", "--MOTOR--": "motor", "--KAROSS--": "kaross"}


def placeholders(**values: str) -> dict[str, str]:
    return {mark: values.get(name, "") for mark, name in PLACEHOLDERS.items()}


def render_html(c: Column, marks: dict[str, str] | None = None, image_base: str = "/api/images") -> Column:
    @F.pandas_udf("string")
    def render(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else rtf_to_html(x, marks, image_base))

    return render(c)


def link_texts(c: Column, marks: dict[str, str] | None = None) -> Column:
    """The texts of a document's links, the first being link 1."""

    @F.pandas_udf("array<string>")
    def texts_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else rtf_links(x, marks))

    return texts_of(c)


def token_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, word, param) for every token."""

    def run(batches):
        for batch in batches:
            found = [(k, n, *t) for k, x in zip(batch[key], batch[text], strict=True) for n, t in enumerate(tokens(x or ""))]
            yield pd.DataFrame(found, columns=[key, "pos", "kind", "word", "param"]).astype({"param": "Int64"})

    return rows.select(key, text).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, pos long, kind string, word string, param long")
