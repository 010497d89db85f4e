"""Packing documents into length buckets that minimise padding.

A batch pads its documents to its bucket's length. The lengths' global histogram (exact below
64 tokens, then 64 bins per doubling, each with count, sum and maximum: at most a few
thousand rows) goes to the driver, where dynamic programming finds the bucket boundaries with
the least total padding. Inside a bucket, batches take ``budget // bucket length`` documents.
Their running numbers come from hash shards of bounded size and the shards' counts, so a bucket
with a third of all documents is numbered by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import WORD
from panelspark.sources import stage

_SHARD_ROWS = 20_000
OUTPUTS = ("n_tokens", "bucket", "bucket_tokens", "batch", "slot", "padding")


def word_count(text: str = "text") -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")


def _histogram(lengths: DataFrame) -> DataFrame:
    spare = "greatest(length(bin(n_tokens)) - 7, 0)"
    return lengths.groupBy(F.expr(f"shiftright(n_tokens, {spare}) * 256 + {spare} * 65536").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"), F.max("n_tokens").alias("longest")
    )


def optimal_boundaries(longest: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding.

    The arguments describe the histogram's bins by rising length. best[k][j] is the least
    padding of the first j bins in k buckets; a last bucket of bins i..j costs
    longest[j] * count - tokens.
    """
    n = len(longest)
    if n == 0:
        return []
    rows = np.r_[0, np.cumsum(counts)].astype(np.float64)
    tokens = np.r_[0, np.cumsum(totals)].astype(np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        after, choice = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(1, n + 1):
            cost = best[:j] + longest[j - 1] * (rows[j] - rows[:j]) - (tokens[j] - tokens[:j])
            choice[j] = int(np.argmin(cost))
            after[j] = cost[choice[j]]
        best = after
        choices.append(choice)
    bounds, j = [], n
    for choice in reversed(choices):
        bounds.append(int(longest[j - 1]))
        j = choice[j]
    return bounds[::-1]


def pack_by_length(
    docs: DataFrame,
    budget: int = 16_384,
    buckets: int = 16,
    seed: int = 17,
    id_column: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Assigns every document to a token-budget batch of its length bucket.

    Adds n_tokens (words by default; ``tokens`` is any other count), bucket (from 0),
    bucket_tokens (length its batches pad to), batch (from 0 inside the bucket), slot (from 0
    inside the batch) and padding. Batches hold ``budget // bucket_tokens`` documents, at least
    one, so a document over the budget has a batch to itself, whole. Documents enter batches by
    a seeded hash of id and text.

    Null and empty texts have 0 tokens. Repeated rows each get a slot; which of two identical
    rows gets which is undefined. Other columns are carried along, but for those with the names
    of the added ones, which these replace. An empty table gives an empty one. Reads the
    lengths once when called.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    count = (word_count() if tokens is None else tokens).cast("bigint")
    text_key = F.xxhash64(F.col("text").cast("string")) if "text" in docs.columns else F.lit(0)
    rows = stage(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), count.alias("n_tokens"),
                    F.xxhash64(F.lit(seed), F.col(f"`{id_column}`"), text_key).alias("order_key"))
    )
    bins = sorted((r.longest, r.n, r.total) for r in _histogram(rows).collect())
    longest, counts, totals = (np.array([b[i] for b in bins], dtype=np.int64) for i in range(3))
    bounds = optimal_boundaries(longest, counts, totals, buckets)

    bucket, size = F.lit(None).cast("int"), F.lit(None).cast("bigint")
    for number in range(len(bounds) - 1, -1, -1):
        inside = F.col("n_tokens") <= bounds[number]
        bucket = F.when(inside, F.lit(number)).otherwise(bucket)
        size = F.when(inside, F.lit(bounds[number]).cast("bigint")).otherwise(size)
    shards = int(counts.sum()) // _SHARD_ROWS + 1
    placed = rows.withColumns(
        {"bucket": bucket, "bucket_tokens": size, "shard": F.pmod(F.col("order_key"), F.lit(shards))}
    )
    sizes = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(sizes.select("bucket", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("bucket", "shard").orderBy("order_key", f"row.`{id_column}`")
    numbered = (
        placed.withColumn("number", F.row_number().over(inside) - 1)
        .join(offsets, ["bucket", "shard"])
        .withColumn("place", F.col("number") + F.col("offset"))
    )
    per_batch = F.greatest(F.lit(budget) / F.greatest("bucket_tokens", F.lit(1)), F.lit(1)).cast("bigint")
    out = numbered.withColumn("per_batch", per_batch).select(
        "row",
        "n_tokens",
        "bucket",
        "bucket_tokens",
        F.expr("place div per_batch").alias("batch"),
        F.expr("place % per_batch").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *OUTPUTS)
