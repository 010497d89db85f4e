"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of every text operator: runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def keyed_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, text) per row, where key orders rows and tells different documents apart.

    The key is the id itself if ids are unique and never null. Otherwise it is (id, hash of the
    text), so rows that share an id but not a text stay apart; null ids come first.
    """
    out = docs.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    unclear = out.groupBy("key").count().where("count > 1 OR key IS NULL")
    if unclear.isEmpty():
        return out
    return out.select(F.struct("key", F.xxhash64("text").alias("version")).alias("key"), "text")


def key_id(df: DataFrame) -> Column:
    """The id inside the key column made by ``keyed_texts``."""
    return F.col("key.key") if df.schema["key"].dataType.typeName() == "struct" else F.col("key")


def attach(rows: DataFrame, small: DataFrame, on: list[str], most: int = 10_000) -> DataFrame:
    """Left join of a table with few rows per group of ``rows``, null keys included.

    ``small`` has one row per key. It is counted: up to ``most`` rows are broadcast. Beyond, it
    is repeated under 64 salts and ``rows`` are dealt out by key and salt, so a key that holds
    a third of them meets in no single task. The optimizer takes the repeated table for as small
    as ``small`` and would send it through the driver, so the join is told to sort and merge.
    Column names of both sides must differ but for ``on``.
    """
    renamed = small.withColumnsRenamed({c: f"_{c}_key" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_{c}_key")) for c in on]
    if small.count() <= most:
        joined = rows.join(F.broadcast(renamed), same, "left")
    else:
        salted = renamed.withColumn("_salt_key", F.explode(F.sequence(F.lit(0), F.lit(63))))
        spread = rows.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)))
        joined = spread.join(salted.hint("merge"), [*same, F.col("_salt") == F.col("_salt_key")], "left")
        joined = joined.drop("_salt", "_salt_key")
    return joined.drop(*[f"_{c}_key" for c in on])


def key_type(df: DataFrame) -> str:
    return df.schema["key"].dataType.simpleString()
