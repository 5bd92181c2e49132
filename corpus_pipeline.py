"""The corpus pipeline: quality rules, toxicity, exact duplicates, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the
columns of documents. Models are trained on the labelled rows among the documents a stage is given.

A stage that drops repeated texts stores its documents once, with a number for each row; all else that it writes is removed
before it returns. `run` removes what its stages stored as soon as the next result is; two runs at once don't meet.

Defined cases. Null and blank texts count as empty; the base rules of the first stage drop them. Of rows that repeat an id with an equal text one
stays; rows that repeat an id with other texts are judged each by itself; null ids stay if nothing else drops them. Ties go to the smallest id, then to the row
stored first. An empty table passes all stages as an empty table. Columns beyond those of documents are kept by all stages but the last,
whatever their names. Very long texts are read whole. Labels of absent documents, null labels and missing classes are as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.llm import exact_dedup, packing, quality, simhash, toxicity
from catalith.llm.common import Scratch, materialise, stored, table

ROW = "__pipeline_row"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rules or the quality model reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts that score 0.5 or more."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal after white space is normalised, keep the row with the smallest id."""
    return _without_dropped(docs, lambda rows: exact_dedup.exact_groups(rows, row_col=ROW))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked at a Jaccard similarity of 0.8 or more of their five-word shingles, keep the row with the smallest id."""
    return _without_dropped(docs, lambda rows: simhash.near_groups(rows, profile=simhash.SIMILAR, row_col=ROW))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's bucket, batch and slot."""
    return stored(spark, "packed", lambda: packing.pack(docs))


def _without_dropped(docs: DataFrame, judge) -> DataFrame:
    rows = materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    dropped = stored(docs.sparkSession, "dropped", lambda: judge(rows).where(~F.col("kept")).select(F.col("rid").alias(ROW)))
    return rows.join(dropped, ROW, "left_anti").drop(ROW)


STAGES = [
    ("quality", quality_rules),
    ("toxicity", toxic_texts),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("packing", length_packing),
]

# quality and toxicity are trained models, which SQL cannot express; the tests hold the run against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed documents, a stored table: it is all that is left in the shared folder."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with Scratch(spark) as left:
            result = stage(spark, docs, sf_dir)
        with Scratch(spark) as kept:
            docs = materialise(result, name)
        left.release()
        if before is not None:
            before.release()
        before = kept
    return docs
