"""Scalar functions of the catalogue, as Column expressions, and the few that parse request parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.schemas import PREFIX, PREFIXED_TYPE

# fixed values: input patterns
VIN = "^[0-9A-HJ-NPR-Z]{17}$"
CODE = "^[A-Za-z0-9.]+$"
TYPED_CODE = "^[A-Za-z0-9]+$"
# fixed values: MIME types by extension
MIME_TYPES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
OTHER_MIME = "application/octet-stream"


def parse_id(text: str | None) -> int | None:
    """The whole number a text begins with."""
    found = re.match(r"\s*([+-]?\d+)", text or "")
    return int(found[1]) if found else None


def parse_id_list(text: str | None) -> list[int]:
    """Whole numbers between commas; empty and malformed parts are dropped."""
    return [int(x) for x in (p.strip() for p in (text or "").split(",")) if re.fullmatch(r"[+-]?\d+", x)]


def id_of(c: Column) -> Column:
    """parse_id for columns."""
    return F.nullif(F.regexp_extract(c, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def ids_of(c: Column) -> Column:
    """parse_id_list for columns."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("bigint")))
    return F.filter(parts, lambda x: x.isNotNull())


def vin_text(c: Column) -> Column:
    """Upper case, without blanks and hyphens."""
    return F.regexp_replace(F.upper(c), r"[\s-]", "")


def base36(c: Column) -> Column:
    """The value of a text of digits and capital letters, null for anything else."""
    return F.when(c.rlike("^[0-9A-Z]+$"), F.conv(c, 36, 10).cast("bigint"))


def vin_area(c: Column) -> Column:
    return F.when(vin_text(c).rlike(VIN), base36(F.substring(vin_text(c), 11, 2)))


def vin_serial(c: Column) -> Column:
    return F.when(vin_text(c).rlike(VIN), base36(F.substring(vin_text(c), 13, 5)))


def code_prefix(doc_type_id: Column) -> Column:
    return F.when(doc_type_id == PREFIXED_TYPE, PREFIX).otherwise("")


def year(c: Column) -> Column:
    return F.substring(c.cast("string"), 1, 4)


def date_text(c: Column, months: bool = False) -> Column:
    """20240131 as 2024-01-31 and, with months, 202401 as 2024-01; anything else stays as it is."""
    s = c.cast("string")
    day = F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))
    out = F.when(F.length(s) == 8, day)
    if months:
        out = out.when(F.length(s) == 6, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2)))
    return out.otherwise(s)


def node_label(code: Column, name: Column, variant: Column) -> Column:
    """Code and name, and the variant in parentheses unless it is blank."""
    base = F.concat_ws(" ", F.nullif(code, F.lit("")), name)
    return F.when(F.length(F.trim(F.coalesce(variant, F.lit("")))) > 0, F.concat(base, F.lit(" ("), variant, F.lit(")"))).otherwise(base)


def vehicle_summary(*names: Column) -> Column:
    return F.concat_ws(" / ", *[F.nullif(n, F.lit("")) for n in names])


def latin1(c: Column) -> Column:
    return F.decode(c, "ISO-8859-1")


def image_path(c: Column) -> Column:
    """The image a reference in a text stands for, null if it holds none."""
    path = F.regexp_extract(c, r"(?i)N:GRAFIK\\([^;]+)\.itw", 1)
    return F.when(path != "", F.concat(F.translate(path, "\\", "/"), F.lit(".png")))


def mime_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    out = F.when(F.lit(False), F.lit(""))
    for known, mime in MIME_TYPES.items():
        out = out.when(ext == known, mime)
    return out.otherwise(OTHER_MIME)


def search_term(text: str | None) -> str:
    return (text or "").strip().lower()


def node_key(node_id: Column, kind: Column, value: Column) -> Column:
    """id.kind.value of a node's variant."""
    return F.concat_ws(".", node_id.cast("string"), kind.cast("string"), value.cast("string"))


def parse_node_key(c: Column) -> Column:
    """The struct of a node key, null if it is malformed."""
    parts = F.split(c, r"\.")
    number = lambda k, name: F.get(parts, F.lit(k)).try_cast("bigint").alias(name)
    return F.when(c.rlike(r"^-?\d+\.-?\d+\.-?\d+$"), F.struct(number(0, "node_id"), number(1, "variant_kind"), number(2, "variant_value")))


def code_search_input(text: str, prefix: str, key_length: int | None, min_length: int | None) -> str | None:
    """The digits to look a code up by, or None while the input does not admit a search."""
    digits = re.sub(r"\D", "", text or "")
    if not key_length or not digits:
        return None
    digits = digits[: max(0, key_length - len(prefix))]
    return digits if len(prefix) + len(digits) >= (min_length or 0) else None


def label_map(c: Column, labels: dict[int, str]) -> Column:
    """A short label for known ids, else the id."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in labels.items():
        out = out.when(c == k, v)
    return out.otherwise(c.cast("string"))
