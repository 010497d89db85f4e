"""Mixing sources to target weights by Poisson replication.

Every document is repeated a Poisson number of times whose mean is its source's target rate,
so each document decides alone and totals concentrate around their targets. The draw is the
inverse of the distribution at a hash of (seed, id): the same document and seed always give
the same count, whatever the partitioning, and a lost task repeats it exactly. Only DataFrame
functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import attach
from panelspark.sources import stage

# A mean above this is drawn as a sum of independent parts, so that exp(-mean) stays exact.
LARGEST_MEAN = 256
OUTPUTS = ("mix_rate", "mix_copy", "mix_place")


def _uniform(seed: int, *parts: Column) -> Column:
    """52 hash bits of (seed, parts) as a number in [0, 1)."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")
    return bits / F.lit(float(1 << 52))


def source_rates(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    source_column: str = "source",
) -> DataFrame:
    """(mix_source, mix_rate): mean repetitions per document of each source.

    ``weights`` names target shares (sources not named get 0); without it a source's share
    goes with its size to the power ``alpha``. ``total`` is the expected number of rows of the
    mix, by default that of the input.
    """
    sizes = docs.groupBy(F.col(source_column).cast("string").alias("mix_source")).agg(
        F.count(F.lit(1)).cast("double").alias("n")
    )
    if weights is None:
        share = F.pow("n", F.lit(float(alpha)))
    else:
        share = F.lit(0.0)
        for name, weight in weights.items():
            if weight < 0:
                raise ValueError("weights must not be negative")
            share = F.when(F.col("mix_source") == name, F.lit(float(weight))).otherwise(share)
    shares = sizes.withColumn("share", share)
    sums = shares.agg(F.sum("share").alias("all_shares"), F.sum("n").alias("all_rows"))
    goal = F.col("all_rows") if total is None else F.lit(float(total))
    rate = F.when(F.col("all_shares") > 0, goal * F.col("share") / F.col("all_shares") / F.col("n")).otherwise(0.0)
    return shares.crossJoin(F.broadcast(sums)).select("mix_source", F.round(rate, 9).alias("mix_rate"))


def _cumulative(mean: Column) -> Column:
    """Poisson probabilities P(N <= k), k = 0, 1, ... until they differ from 1 by under 2**-53."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))

    def step(state: Column, k: Column) -> Column:
        p = state["p"] * mean / k
        return F.struct(
            p.alias("p"), F.concat(state["upto"], F.array(F.element_at(state["upto"], -1) + p)).alias("upto")
        )

    return F.aggregate(F.sequence(F.lit(1), last), start, step)["upto"]


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    alpha: float = 0.5,
    total: float | None = None,
    seed: int = 17,
    id_column: str = "doc_id",
    source_column: str = "source",
    shuffled: bool = True,
) -> DataFrame:
    """Rows of ``docs`` repeated to the target weights and shuffled globally.

    Adds mix_rate (mean of the source), mix_copy (0, 1, ... of the repetition) and mix_place
    (hash that orders the mix: rows are dealt to partitions by it and sorted by it inside).
    See ``source_rates`` for ``weights``, ``alpha`` and ``total``. Documents may come out zero
    times: that is the operator's purpose.

    A null source is a source of its own. Rows with equal ids and texts repeat alike (a null id
    draws by its text); other columns are carried along, but for input columns with the
    names of the added ones, which these replace. An empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in OUTPUTS]
    rates = stage(source_rates(docs, weights, alpha, total, source_column))
    parts = F.greatest(F.ceil(F.col("mix_rate") / LARGEST_MEAN), F.lit(1)).cast("int")
    tables = stage(
        rates.withColumn("parts", parts).withColumn("upto", _cumulative(F.col("mix_rate") / F.col("parts")))
    )
    identity = F.coalesce(
        F.col(f"row.`{id_column}`").cast("string"),
        F.concat(F.lit("text "), F.md5(F.coalesce(F.col("row.text").cast("string"), F.lit("")))) if "text" in docs.columns else F.lit("null"),
    )
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")).withColumn(
        "mix_source", F.col(f"row.`{source_column}`").cast("string")
    )
    drawn = attach(rows, tables, ["mix_source"]).withColumn("id", identity)
    count = F.aggregate(
        F.transform(
            F.sequence(F.lit(1), F.col("parts")),
            lambda part: F.size(F.filter("upto", lambda edge: edge <= _uniform(seed, part, F.col("id")))),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )
    copies = (
        drawn.withColumn("count", count)
        .where("count > 0")
        .withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
        .withColumn("mix_place", F.md5(F.concat_ws("|", F.lit(f"{seed} place"), "id", F.col("mix_copy").cast("string"))))
    )
    if shuffled:
        copies = copies.repartition("mix_place").sortWithinPartitions("mix_place")
    return copies.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *OUTPUTS)
