"""Conversations from messages that quote each other.

Lines that begin with ``>`` marks are quotes; the number of marks is the level. Every line is
normalised and hashed. A line's original is the first message of its conversation that has it
as a line of its own, so quotes are joined to originals by hash with one row per line, never
pair by pair. A message replies to the earlier message from which the most characters of its
outermost linked quote level come. Threads follow the replies, ordered by turn, without quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.operators.ordering import RANK, lay_out, with_ranks
from panelspark.sources import stage

_MARKS = r"^\s*((?:>\s?)+)"
_ATTRIBUTION = r"(?i)^\s*(on\b.*\bwrote|.*\bwrote|.*\bschrieb|.*\ba écrit|.*\bescribió)\s*:\s*$"


def _normal(line: Column) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))


def parse_lines(text: Column) -> Column:
    """array<struct<level, line>>: the quote level of each line and the line without marks.

    A line that announces a quote ("On ... wrote:") has the level of the quote below it.
    """
    lines = F.split(text, r"\r?\n", -1)
    parsed = F.transform(
        lines,
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, _MARKS, 1), r"\s", "")).alias("level"),
            F.regexp_replace(line, _MARKS, "").alias("line"),
        ),
    )

    def announced(item: Column, at: Column) -> Column:
        below = F.try_element_at(parsed, at + 2)
        leads = item["line"].rlike(_ATTRIBUTION) & (below["level"] > item["level"])
        return F.struct(
            F.when(F.coalesce(leads, F.lit(False)), below["level"]).otherwise(item["level"]).alias("level"),
            item["line"].alias("line"),
        )

    return F.transform(parsed, announced)


def _roots(parents: DataFrame) -> DataFrame:
    """(conv, turn, root, depth) by pointer doubling over (conv, turn, parent)."""
    hops = parents.select("conv", "turn", F.col("parent").alias("root"), F.lit(1).alias("depth"))
    hops = stage(hops)
    while True:
        after = hops.select(
            F.col("conv").alias("c"), F.col("turn").alias("root"), F.col("root").alias("r"), F.col("depth").alias("d")
        )
        joined = hops.join(after, F.col("conv").eqNullSafe(F.col("c")) & (hops["root"] == after["root"]), "left")
        hops_next = stage(
            joined.select(
                "conv",
                "turn",
                F.coalesce("r", hops["root"]).alias("root"),
                (F.col("depth") + F.coalesce("d", F.lit(0))).alias("depth"),
                F.col("r").isNotNull().alias("moved"),
            )
        )
        moved = not hops_next.where("moved").isEmpty()
        hops = hops_next.drop("moved")
        if not moved:
            return hops


def link_quotes(
    messages: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per message: its own words, what it replies to, and its place in its thread.

    Returns conv_id, turn, role, text (own lines joined, quotes and their announcements gone),
    n_quoted (quoted lines with a word), n_linked (those found in an earlier message),
    parent_turn (null if it quotes nothing known), thread_turn (the first turn of the thread; a
    message that replies to nothing belongs to its conversation's main thread, whose
    thread_turn is null), depth (replies up to the thread's first message) and position (from 1
    in its conversation by turn, role and text; null for null turns).

    Ties: of originals with equally many characters the latest counts. Null conversations are
    one conversation. Null texts have no lines, null turns quote nothing and are quoted by none.
    Messages that share conversation and turn are read as one when links are sought. Other
    columns are ignored. An empty table gives an empty one. Runs its joins when called.
    """
    rows = messages.select(
        F.col(conversation).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.col(role).cast("string").alias("role"),
        parse_lines(F.col(text).cast("string")).alias("lines"),
    ).withColumn(
        "own", F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["line"]), "\n")
    )
    lines = (
        rows.where("turn IS NOT NULL")
        .select("conv", "turn", F.explode("lines").alias("item"))
        .select("conv", "turn", "item.level", _normal(F.col("item.line")).alias("words"))
        .where(F.length("words") > 0)
        .select("conv", "turn", "level", F.length("words").alias("size"), F.md5("words").alias("hash"))
    )
    quoted = stage(lines.where("level > 0"))
    wanted = quoted.select("hash").distinct()
    first = (
        lines.where("level = 0")
        .join(wanted, "hash", "left_semi")
        .groupBy(F.col("conv").alias("conv_first"), "hash")
        .agg(F.min("turn").alias("original"))
    )
    linked = stage(
        quoted.join(first, ["hash"], "left")
        .where(F.col("conv").eqNullSafe(F.col("conv_first")) & (F.col("original") < F.col("turn")))
        .groupBy("conv", "turn", "level", "original")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    )
    best = F.min(F.struct("level", (-F.col("size")).alias("size"), (-F.col("original")).alias("original")))
    parents = linked.groupBy("conv", "turn").agg(
        (-best["original"]).alias("parent"), F.sum("n").alias("n_linked")
    )
    parents = stage(parents)
    threads = _roots(parents)
    links = threads.join(
        parents.select(F.col("conv").alias("c"), F.col("turn").alias("t"), "parent", "n_linked"),
        F.col("conv").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t")),
    ).select(F.col("conv").alias("conv_link"), F.col("turn").alias("turn_link"), "parent", "n_linked", "root", "depth")

    n_quoted = F.size(F.filter("lines", lambda x: (x["level"] > 0) & (F.length(F.trim(x["line"])) > 0)))
    narrow = rows.select("conv", "turn", "role", F.col("own").alias("text"), F.coalesce(n_quoted, F.lit(0)).alias("n_quoted"))
    ranked = with_ranks(lay_out(narrow, ["conv"], "turn", ["role", "text"]), ["conv"], "turn")
    joined = ranked.join(
        links, F.col("conv").eqNullSafe(F.col("conv_link")) & (F.col("turn") == F.col("turn_link")), "left"
    )
    return joined.select(
        F.col("conv").alias("conv_id"),
        "turn",
        "role",
        "text",
        F.col("n_quoted").cast("bigint").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        F.col("parent").alias("parent_turn"),
        F.col("root").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.col(RANK).alias("position"),
    )
