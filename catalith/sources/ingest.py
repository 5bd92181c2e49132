"""Loading a catalogue: exported tables, document and image files; and getting files out again."""

from __future__ import annotations

import gzip
import os
import zlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.scalars import mime_type
from catalith.plans.stored import exists, names
from catalith.schemas import LOADED, PARTITIONED, SCHEMAS, SOURCE_COLUMNS, source_table

DOCUMENTS = ["rtf"]
IMAGES = ["png", "jpg", "jpeg", "gif", "webp"]


def read_export(spark: SparkSession, path: str, name: str, doc_type_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """An exported table (CSV with a header of source column names), typed; and how many values were rejected per
    column, since the source types nothing."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = {c.upper(): c for c in raw.columns}
    columns, rejected = [], []
    for field in SCHEMAS[name].fields:
        source = SOURCE_COLUMNS[name].get(field.name)
        if source is None:
            continue
        text = F.col(f"`{found[source.upper()]}`") if source.upper() in found else F.lit(None).cast("string")
        value = F.unhex(text) if field.dataType.typeName() == "binary" else text.try_cast(field.dataType)
        columns.append(value.alias(field.name))
        rejected.append(F.count_if(text.isNotNull() & (F.trim(text) != "") & value.isNull()).alias(field.name))
    rows = raw.select(*columns)
    if name in PARTITIONED:
        rows = rows.withColumn("doc_type_id", F.lit(doc_type_id).cast("long"))
    return rows, raw.agg(*rejected)


def load_exports(spark: SparkSession, folder: str, out: str) -> list[tuple[str, str, int]]:
    """Load every `<source table>.csv` of a folder. Returns (source, table, rows) or (source, error, -1): a table that
    cannot be read does not stop the others. Families become one table partitioned by document type."""
    log = []
    loaded = []
    for file in names(spark, folder):
        known = source_table(os.path.splitext(file)[0]) if file.lower().endswith(".csv") else None
        if known is None:
            continue
        name, doc_type_id = known
        try:
            rows, _ = read_export(spark, f"{folder}/{file}", name, doc_type_id)
            # a family's table is replaced partition by partition, so loading again repeats nothing
            # rows lie by key, so that a lookup reads the row groups that may hold it
            key = SCHEMAS[name].fields[0].name
            writer = rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            (writer.partitionBy("doc_type_id") if name in PARTITIONED else writer).parquet(f"{out}/{name}")
            log.append((file, name, rows.count()))
            if name in PARTITIONED:
                loaded.append((name, doc_type_id))
        except Exception as e:  # one bad table is a warning
            log.append((file, f"{type(e).__name__}: {e}"[:200], -1))
    if loaded:
        spark.createDataFrame(loaded, SCHEMAS[LOADED]).write.mode("append").parquet(f"{out}/{LOADED}")
    return log


def file_rows(files: DataFrame, folder: str, extensions: list[str], keep: str | None = None) -> DataFrame:
    """(id, path, content_type, data) from binaryFile rows: the id is the upper-cased relative path, the path its folder."""
    root = folder.rstrip("/").removeprefix("file://").removeprefix("file:")
    plain = F.regexp_replace("path", "^file:/+", "/")
    relative = F.when(plain.startswith(root + "/"), F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root) + 2})")).otherwise(plain)
    rows = files.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    kind = mime_type(F.col("path")) if extensions != DOCUMENTS else F.lit("application/rtf")
    parent = F.when(F.contains(relative, F.lit("/")), F.regexp_replace(relative, "/[^/]*$", "")).otherwise("")
    extra = [keep] if keep else []
    return rows.select(F.upper(relative).alias("id"), parent.alias("path"), kind.alias("content_type"), F.col("content").alias("data"), *extra)


def import_files(spark: SparkSession, folder: str, extensions: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The files below a folder as blob rows, one per id (the first path), without ids that are there already."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    rows = file_rows(files.where(F.col("length") >= 0), folder, extensions)
    rows = rows.groupBy("id").agg(F.min_by(F.struct("path", "content_type", "data"), "path").alias("x")).select("id", "x.*")
    if existing is not None:
        rows = rows.join(existing.select("id"), "id", "left_anti")
    return rows


def append_new(rows: DataFrame, table: str) -> None:
    """Append the rows whose id a stored table of any file system does not have, in order of their ids."""
    spark = rows.sparkSession
    held = spark.read.parquet(table).select("id") if exists(spark, table) else None
    new = rows if held is None else rows.join(held, "id", "left_anti")
    new.repartitionByRange("id").sortWithinPartitions("id").write.mode("append").parquet(table)


def unlzw(data: bytes) -> bytes:
    """Decompress the .Z format: variable-width LZW codes, low bits first, in blocks of eight codes."""
    flags, most = data[2], data[2] & 0x1F
    block = bool(flags & 0x80)
    table: list[bytes] = [bytes([b]) for b in range(256)] + ([b""] if block else [])
    out, width, previous = [], 9, b""
    bit, start = 24, 24
    total = 8 * len(data)
    while bit + width <= total:
        chunk = int.from_bytes(data[bit >> 3 : (bit >> 3) + 4], "little")
        code = (chunk >> (bit & 7)) & ((1 << width) - 1)
        bit += width
        if block and code == 256:
            bit = start + -(-(bit - start) // (8 * width)) * 8 * width
            start, width, previous = bit, 9, b""
            del table[257:]
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("damaged LZW data")
        out.append(entry)
        if previous and len(table) < 1 << most:
            table.append(previous + entry[:1])
            if len(table) == 1 << width and width < most:
                bit = start + -(-(bit - start) // (8 * width)) * 8 * width
                start, width = bit, width + 1
        previous = entry
    return b"".join(out)


def decompress(data: bytes | None) -> bytes | None:
    """gzip or .Z data as plain bytes; anything else as it is, damaged data as null."""
    try:
        if data is None or data[:2] not in (b"\x1f\x8b", b"\x1f\x9d"):
            return data
        return gzip.decompress(data) if data[1] == 0x8B else unlzw(data)
    except (OSError, EOFError, ValueError, zlib.error):
        return None


def decompressed(rows: DataFrame, column: str = "data") -> DataFrame:
    """Rows with their content decompressed; those whose content is damaged are left out."""

    @F.pandas_udf("binary")
    def plain(data: pd.Series) -> pd.Series:
        return data.map(decompress)

    return rows.withColumn(column, plain(F.col(column))).where(F.col(column).isNotNull())


def extract(blobs: DataFrame, out: str, ids: Iterable[str] | None = None) -> DataFrame:
    """Write blobs to files named by their id, from the tasks. Returns (id, bytes) of what was written."""
    if ids is not None:
        blobs = blobs.where(F.col("id").isin(*[i.upper() for i in ids]))

    def run(batches):
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(out if "://" in out else f"file://{os.path.abspath(out)}")
        for batch in batches:
            sizes = []
            for id_, data in zip(batch["id"], batch["data"], strict=True):
                if ".." in id_.split("/"):
                    raise ValueError(f"{id_} leads out of the folder")
                target = f"{root}/{id_.lstrip('/')}"
                fs.create_dir(os.path.dirname(target), recursive=True)
                with fs.open_output_stream(target, compression=None) as f:
                    f.write(data or b"")
                sizes.append(len(data or b""))
            yield pd.DataFrame({"id": batch["id"], "bytes": sizes})

    return blobs.select("id", "data").mapInPandas(run, "id string, bytes long")


def extract_one(blobs: DataFrame, out: str, id_: str) -> int:
    found = extract(blobs, out, [id_]).collect()
    if not found:
        raise LookupError(id_)
    return found[0]["bytes"]


def extract_data(tables: dict[str, DataFrame], what: str, out: str, id_: str | None = None) -> dict[str, int]:
    """`images`, `docs` or `both` (which takes no id). Files written by kind."""
    if what not in ("images", "docs", "both"):
        raise ValueError("images, docs or both")
    if what == "both" and id_ is not None:
        raise ValueError("both takes no id")
    kinds = {"images": "image_blob", "docs": "doc_blob"}
    out_of = {}
    for kind, name in kinds.items():
        if what in (kind, "both"):
            if id_ is not None:
                extract_one(tables[name], f"{out}/{kind}", id_)
                out_of[kind] = 1
            else:
                out_of[kind] = extract(tables[name], f"{out}/{kind}").count()
    return out_of


def ingest(spark: SparkSession, source: str, out: str) -> dict[str, object]:
    """Tables, then images, then documents, from folders named in any case. Missing tables are fatal, missing images or documents a warning."""
    folders = {x.upper(): f"{source}/{x}" for x in names(spark, source)}
    if "DATA" not in folders:
        raise FileNotFoundError(f"{source}/DATA")
    tables = folders["DATA"]
    log: dict[str, object] = {"tables": load_exports(spark, tables, out), "warnings": []}
    for folder, kinds, name in (("GRAFIK", IMAGES, "image_blob"), ("DOCS", DOCUMENTS, "doc_blob")):
        if folder not in folders:
            log["warnings"].append(f"no {folder}")
            continue
        rows = import_files(spark, folders[folder], kinds)
        append_new(decompressed(rows) if name == "doc_blob" else rows, f"{out}/{name}")
        log[name] = spark.read.parquet(f"{out}/{name}").count()
    return log

