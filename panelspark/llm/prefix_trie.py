"""The trie of conversation prefixes: which conversations share their first turns.

A node is a distinct sequence of first turns; its members are the conversations that start
with it. Work goes in two parts, neither of which gathers a node's members:

*Discovery.* Each turn becomes a digest of (role, text), and each prefix the running XOR of
position-salted hashes of its turns, 128 bits wide, so a turn's row says which node it reaches
and which it comes from. One aggregation over these narrow rows, combined on the map side, finds
all nodes with their member count and smallest member. The nodes with the same smallest member
are one path, the lower part of that member's own conversation.

*Truncation peeling.* From the greatest depth up, the paths that end their private part at the
depth are truncated there and merged with the surviving node that they leave from: their
leaves and saved bytes are summed by surviving path, with map-side combine. Stretches in which
nothing merges are stripped in one step, so there are as many rounds as depths at which
conversations part, however long the conversations are, and each path's row is read in one
round only. A last window along each path turns what has been merged into subtree sums.

The digest of a node's ended members is streamed over their sorted ids, without holding them.

Defined results: turns go by turn (null first), ties by role, then the text's MD5; null role and
text are empty. A null ``conv_id`` is one conversation, smallest of all, written as ``null`` in
digests, with h 0. An empty table has no nodes. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import attach
from panelspark.sources.staging import new_path, scope, stage

_NODE = ["depth", "k1", "k2"]


def prefix_turns(rows: DataFrame) -> DataFrame:
    """(conv, place, item, n_bytes): conversations as numbered turns, conv null-safe and ordered.

    conv is a struct of (given, id), so a null id is an ordinary key; item identifies role and
    text, n_bytes is the text's length in UTF-8.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(text)
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return (
        rows.select(
            F.struct(F.col("conv_id").isNotNull().alias("given"), F.col("conv_id").alias("id")).alias("conv"),
            "turn",
            role.alias("role"),
            digest.alias("digest"),
            F.octet_length(text).cast("bigint").alias("n_bytes"),
        )
        .withColumn("place", F.row_number().over(order).cast("bigint"))
        .select("conv", "place", F.concat("digest", "role").alias("item"), "n_bytes")
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """Conversations that begin with turns of another one, then go on with their own.

    Conversation c takes the first h turns of conversation c - c % 5 (fewer if it is shorter)
    and its own turns after the first h, where h is the CRC-32 of the decimal c modulo 9.
    Every conversation of ``turns`` has at least one row here: one without turns has place 0.
    """
    convs = turns.where("place = 1").select("conv")
    h = F.coalesce(F.crc32(F.col("conv.id").cast("string")) % 9, F.lit(0))
    asked = convs.select(
        F.col("conv.id").alias("taker"), (F.col("conv.id") - F.col("conv.id") % 5).alias("giver"), h.alias("h")
    ).where("giver IS NOT NULL")
    # At most nine rows of a giver, read by at most nine takers (five, for ids above zero).
    head = turns.where("place <= 8 AND conv.given").select(
        F.col("conv.id").alias("giver"), "place", "item", "n_bytes"
    )
    borrowed = (
        asked.join(head, "giver")
        .where(F.col("place") <= F.col("h"))
        .select(F.struct(F.lit(True).alias("given"), F.col("taker").alias("id")).alias("conv"), "place", "item", "n_bytes")
    )
    own = turns.where(F.col("place") > h)
    bare = convs.select("conv", F.lit(0).cast("bigint").alias("place"), F.lit("").alias("item"), F.lit(0).cast("bigint").alias("n_bytes"))
    order = Window.partitionBy("conv").orderBy("_kept", "place")
    return (
        bare.withColumn("_kept", F.lit(0))
        .unionByName(borrowed.withColumn("_kept", F.lit(1)))
        .unionByName(own.withColumn("_kept", F.lit(2)))
        .withColumn("place", F.row_number().over(order).cast("bigint") - 1)
        .drop("_kept")
    )


def _salted(seed: int) -> Column:
    return F.when(F.col("place") == 0, F.lit(0).cast("bigint")).otherwise(
        F.xxhash64(F.lit(seed), F.col("place"), F.col("item"))
    )


def _reached(turns: DataFrame) -> DataFrame:
    """For each turn, and the start, of a conversation: the node it reaches, by key.

    s1 and s2 are the turn's own hashes: key XOR hash is the parent's key.
    """
    order = Window.partitionBy("conv").orderBy("depth")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = turns.select(
        "conv", F.col("place").alias("depth"), "n_bytes", _salted(11).alias("s1"), _salted(12).alias("s2")
    )
    return hashed.select(
        "conv",
        "depth",
        "n_bytes",
        F.bit_xor("s1").over(running).alias("k1"),
        F.bit_xor("s2").over(running).alias("k2"),
        "s1",
        "s2",
        F.lead("depth").over(order).isNull().alias("ended"),
    )


def _nodes(reached: DataFrame) -> DataFrame:
    """One row per node, with its place on the path of its smallest member.

    top is the least depth of the path, last says that the path goes no deeper; saved is the
    node's own share.
    """
    found = reached.groupBy(*_NODE).agg(
        F.min("conv").alias("path"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("n_bytes").alias("n_bytes"),
        F.max("s1").alias("s1"),
        F.max("s2").alias("s2"),
    )
    path = Window.partitionBy("path")
    return found.select(
        *_NODE,
        F.col("k1").bitwiseXOR(F.col("s1")).alias("up1"),
        F.col("k2").bitwiseXOR(F.col("s2")).alias("up2"),
        "path",
        "n_convs",
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        F.min("depth").over(path).alias("top"),
        (F.max("depth").over(path) == F.col("depth")).alias("last"),
    )


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the comma-joined ids of each node, ids arriving in order, batch by batch."""
    key, digest = None, None
    for batch in batches:
        done = []
        for *now, text in zip(*(batch[c].tolist() for c in [*_NODE, "text"]), strict=True):
            if now != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = now, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
        if done:
            yield pd.DataFrame(done, columns=[*_NODE, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*_NODE, "ends_sha256"])


def _ends(reached: DataFrame) -> DataFrame:
    """The digest of each node where conversations end, made from a sorted stream of their ids."""
    shown = F.coalesce(F.col("conv.id").cast("string"), F.lit("null"))
    return (
        reached.where("ended")
        .repartition(*_NODE)
        .sortWithinPartitions(*_NODE, "conv")
        .select(*_NODE, shown.alias("text"))
        .mapInPandas(_digests, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")
    )


def _peel(paths: DataFrame) -> DataFrame:
    """(path, depth, leaves_below, saved_below): what merges into a path at a depth, subtrees included.

    ``paths`` has each path's own ``leaves`` and ``saved``, the path ``into`` which it merges,
    the depth ``at`` which it does, and the depth ``then`` at which that one merges in turn. A
    path merges at a greater depth than the path that it merges into, so one round a depth,
    greatest first, meets every path when all below it have been added. The driver holds one
    number a depth.
    """
    at = [r[0] for r in paths.where("into IS NOT NULL").select("at").distinct().collect()]
    merged: list[DataFrame] = []
    for depth in sorted(at, reverse=True):
        ripe = paths.where(F.col("at") == depth).select("path", "into", "then", "leaves", "saved")
        for earlier in merged:
            ripe = ripe.unionByName(
                earlier.where(F.col("then") == depth).select("path", "leaves", "saved"), allowMissingColumns=True
            )
        whole = ripe.groupBy("path").agg(
            F.max("into").alias("into"),
            F.max("then").alias("then"),
            F.sum("leaves").alias("leaves"),
            F.sum("saved").alias("saved"),
        )
        merged.append(
            stage(
                whole.groupBy(F.col("into").alias("path"), "then").agg(
                    F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")
                ).withColumn("depth", F.lit(depth).cast("bigint"))
            )
        )
    if not merged:
        return paths.where("false").select("path", F.col("at").alias("depth"), F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))
    every = merged[0]
    for one in merged[1:]:
        every = every.unionByName(one)
    return every.select("path", "depth", F.col("leaves").alias("leaves_below"), F.col("saved").alias("saved_below"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv, place, item, n_bytes; place 0 is the start).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves
    (childless nodes of the subtree), saved_tokens (over the subtree, bytes of each node's last
    text times its members but one) and ends_sha256 (of the sorted ids that end at the node).
    """
    path = new_path(turns.sparkSession, "trie")
    with scope(turns.sparkSession):
        return stage(_trie(turns), path)


def _trie(turns: DataFrame) -> DataFrame:
    reached = stage(_reached(turns))
    found = stage(_nodes(reached))
    # Nodes into which paths merge: one row per node, however many paths do.
    joints = (
        found.where("depth = top AND depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2"))
        .agg(F.count(F.lit(1)).alias("n_merging"))
    )
    nodes = stage(
        found.join(joints, _NODE, "left").withColumn("n_merging", F.coalesce("n_merging", F.lit(0).cast("bigint")))
    )
    at_top = F.col("depth") == F.col("top")
    paths = nodes.groupBy("path").agg(
        F.max(F.when(at_top, F.col("up1"))).alias("_up1"),
        F.max(F.when(at_top, F.col("up2"))).alias("_up2"),
        (F.min("top") - 1).alias("at"),
        F.max(F.when(F.col("last") & (F.col("n_merging") == 0), 1).otherwise(0)).cast("bigint").alias("leaves"),
        F.sum("saved").alias("saved"),
    )
    onto = nodes.where("n_merging > 0").select(
        F.col("depth").alias("at"),
        F.col("k1").alias("_up1"),
        F.col("k2").alias("_up2"),
        F.col("path").alias("into"),
        (F.col("top") - 1).alias("then"),
    )
    paths = stage(attach(stage(paths), stage(onto), ["at", "_up1", "_up2"]))
    merged = _peel(paths)
    below = (
        Window.partitionBy("path").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ends_here = F.when(F.col("last") & (F.col("n_merging") == 0), 1).otherwise(0)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        nodes.join(merged, ["path", "depth"], "left")
        .join(paths.select("path", "into"), "path")
        .join(_ends(reached), _NODE, "left")
        .select(
            F.col("path.id").alias("conv_id"),
            "depth",
            F.when(~at_top, F.col("path.id")).otherwise(F.col("into.id")).alias("parent_conv_id"),
            "n_convs",
            (F.col("n_merging") + F.when(F.col("last"), 0).otherwise(1)).alias("n_children"),
            F.sum(ends_here + F.coalesce("leaves_below", F.lit(0))).over(below).alias("n_leaves"),
            F.sum(F.col("saved") + F.coalesce("saved_below", F.lit(0))).over(below).alias("saved_tokens"),
            F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
        )
    )


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = prefix_turns(rows)
    start = turns.where("place = 1").select(
        "conv", F.lit(0).cast("bigint").alias("place"), F.lit("").alias("item"), F.lit(0).cast("bigint").alias("n_bytes")
    )
    return prefix_trie(turns.unionByName(start))


def rebuilt_prefixes(rows: DataFrame) -> DataFrame:
    """The trie of conversations that begin with turns of another one, see ``rebuilt_turns``."""
    path = new_path(rows.sparkSession, "trie")
    with scope(rows.sparkSession):
        return stage(_trie(rebuilt_turns(stage(prefix_turns(rows)))), path)
