"""A corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; every stage but the last keeps
the columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and
gives the next one what it reads back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.jaccard import one_of_each
from panelspark.llm.mixing import mix_sources
from panelspark.llm.packing import pack_by_length, word_count
from panelspark.llm.quality import keep_good
from panelspark.llm.secret_scan import redact_secrets
from panelspark.sources import new_path, scope, stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each judged by its own text.

    Null and empty texts have no words and go. Null and shared ids, repeated rows and null lang
    or source each count as they are. Extra columns are left out; an empty table stays empty.
    """
    return keep_good(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar texts, the one with the smallest id (null ids last).

    Components go by text, never by id: unrelated rows that share an id, or have none, all stay,
    and so do rows without words. An empty table stays empty.
    """
    return one_of_each(docs.select(COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with secrets in its text replaced by a mark and n_chars following.

    Null and empty texts stay as they are; ids and repeated rows play no part.
    """
    return redact_secrets(docs.select(COLUMNS)).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to weights that go with the square root of their source's size.

    A null source is a source of its own. Rows are drawn by their id (by their text, if it is
    null): rows that share one share their draw. An empty table stays empty.
    """
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch and slot of every row; null and empty texts have length 0, repeated rows each a slot."""
    narrow = docs.select("doc_id", "lang", "source", "n_chars", word_count().alias("words"))
    return pack_by_length(narrow, tokens=F.col("words")).drop("words")


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secrets),
    ("mixing sources", mixing),
    ("packing", packing),
]

# The Jaccard components, seeded draws over them and the dynamic program have no plain SQL form;
# tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table ``documents``.

    What a stage stages for itself is deleted when its result is written, what the stages before
    the last but one have written when that one has.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = new_path(spark, "stage")
    with scope(spark):
        for number, (_, step) in enumerate(STAGES[:-1], 1):
            path = last if number == len(STAGES) - 1 else new_path(spark, "stage")
            with scope(spark):
                docs = stage(step(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
