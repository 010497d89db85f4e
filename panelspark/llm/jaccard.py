"""Exact n-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct word shingles, as 64-bit hashes; equal sets are one node
(a 64-bit fingerprint) from the start, so exact copies never form pairs. Two nodes with
similarity of at least ``percent`` miss few of each other's tokens: of a set of n tokens at
most slack = n - ceil(n * percent / 100). That gives prefixes under a global token order:

* Frequencies come from a count sketch (a fixed number of counters over all documents). Its
  frequent tokens sort last; rare ones, and frequent ones among themselves, by hash.
* A rare token is a signature by itself. Frequent tokens are split into classes by their
  leading hash bits, about 2 to 4 tokens of a document each, and every pair of tokens of one
  class is a signature. Leaving no signature of a class with m tokens takes the loss of m - 1.
* A prefix extends until slack + 1 losses would be needed to miss all of its signatures. Two
  similar sets therefore share one. Classes depend on the size level (power of two) of the
  larger set, so a set that can be similar to one on the next level signs for both levels.

Candidates that share a signature are verified on their whole texts. A group of near copies
would be quadratic in pairs, so hubs come first: each node is measured against the group
hub (its most central node) with which it shares most signatures, then against that one's
hub, and links join components. What is left of a hub's nodes is compared by their differences
from the hub: two nodes that link though one is not linked to the hub share a number of
differences, so an index on prefixes of the difference lists finds them (the same prefix rule,
one level down). Only pairs of nodes of different hubs, or far from their hub, that still cross
components are formed from the signatures, past a size filter and a parity-bitmap filter (an
upper bound, so nothing is lost), and verified. Components are therefore exactly those of all
links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import attach
from panelspark.llm.graph import connected_components
from panelspark.llm.kernels import (
    U64,
    Texts,
    by_size,
    mix,
    over_texts,
    shingle_sets,
    signed,
    take,
)
from panelspark.sources import new_path, scope, stage

# Counters of the frequency sketch: 2**22 of 16 bits, 8 MB in a task, 0.5 MB of flags sent out.
_COUNTERS = 1 << 22
_CHUNK = 1 << 14
_FREQUENT = 32
_SINGLES_BELOW = 4
_SALT = U64(0x5851F42D4C957F2D)


def _class_shift(percent: int) -> int:
    """How far the number of token classes stays below the size level.

    A set of at least percent of 2**level tokens in 2**(level - shift) classes must be able
    to reach slack + 1 losses.
    """
    share = percent / 100
    for shift in range(1, _SINGLES_BELOW + 1):
        if share >= 1 / (2**shift * share) + 1 / (share * 2**_SINGLES_BELOW):
            return shift
    raise ValueError("percent must be at least 55")


def _sums(values: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Sum of 64-bit values per owner, modulo 2**64; owners ascend."""
    total = np.r_[U64(0), np.cumsum(values, dtype=U64)]
    edges = np.searchsorted(owner, np.arange(count + 1))
    return total[edges[1:]] - total[edges[:-1]]


def _nodes(owner: np.ndarray, hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, size) of each set."""
    sizes = np.bincount(owner, minlength=count).astype(np.int64)
    return mix(_sums(mix(hashes + _SALT), owner, count) + mix(sizes.astype(U64))), sizes


def _members_and_counts(docs: DataFrame, shingle: int) -> DataFrame:
    """One scan: a row per document (node and size), and the counters of each task in chunks."""

    def scan(batches):
        counters = np.zeros(_COUNTERS, dtype=np.uint16)
        names = ["doc_id", "text_key", "node", "size", "chunk", "counts"]
        kind = None
        for batch in by_size(batches):
            kind = batch.column("doc_id").type
            owner, hashes = shingle_sets(Texts(batch.column("text")), shingle)
            nodes, sizes = _nodes(owner, hashes, batch.num_rows)
            spots, seen = np.unique((hashes & U64(_COUNTERS - 1)).astype(np.int64), return_counts=True)
            counters[spots] = np.minimum(counters[spots] + seen, 65535)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_key"),
                    pa.array(nodes.view(np.int64), mask=sizes == 0),
                    pa.array(sizes),
                    pa.nulls(rows, pa.int32()),
                    pa.nulls(rows, pa.binary()),
                ],
                names=names,
            )
        for chunk in np.flatnonzero(counters.reshape(-1, _CHUNK).any(axis=1)):
            part = counters[chunk * _CHUNK : (chunk + 1) * _CHUNK]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(1, kind),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()),
                    pa.nulls(1, pa.int64()),
                    pa.array([chunk], pa.int32()),
                    pa.array([part.tobytes()], pa.binary()),
                ],
                names=names,
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        scan, f"doc_id {kind}, text_key bigint, node bigint, size bigint, chunk int, counts binary"
    )


def _frequent_flags(spark: SparkSession, counts: DataFrame, total: int) -> np.ndarray:
    """True for the counters that stand out: 2**22 bits, whatever the table's size."""
    load = total / _COUNTERS
    least = int(_FREQUENT + load + 6 * load**0.5)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, part in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                have = sums.setdefault(chunk, np.zeros(_CHUNK, dtype=np.int64))
                have += np.frombuffer(part, dtype=np.uint16)
        for chunk, have in sums.items():
            flags = np.packbits(have >= least).tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int32()), pa.array([flags], pa.binary())], names=["chunk", "flags"]
            )

    flags = np.zeros(_COUNTERS, dtype=bool)
    for row in counts.repartition("chunk").mapInArrow(add, "chunk int, flags binary").collect():
        flags[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.unpackbits(
            np.frombuffer(row.flags, dtype=np.uint8)
        )
    return flags


def _combinations(frequent: np.ndarray, need: int, level: int, shift: int) -> list[np.uint64]:
    """Signatures of frequent tokens (by hash) on one level, until ``need`` losses are covered."""
    if level < _SINGLES_BELOW:
        return list(mix(frequent[:need] + U64(level + 1)))
    bits = level - shift
    classes = frequent >> U64(64 - bits)
    gained = np.r_[False, classes[1:] == classes[:-1]].cumsum()
    stop = int(np.searchsorted(gained, need)) + 1
    left, right = [], []
    edges = np.flatnonzero(np.r_[True, classes[1:stop] != classes[: stop - 1], True])
    for a, b in zip(edges, edges[1:]):
        for i, j in combinations(range(a, b), 2):
            left.append(i)
            right.append(j)
    return list(mix(mix(frequent[left] + U64(level + 1)) ^ (frequent[right] * _SALT)))


def _signatures(
    owner: np.ndarray, hashes: np.ndarray, count: int, flags: np.ndarray, percent: int, shift: int
) -> tuple[np.ndarray, np.ndarray]:
    """(set, signature) of every prefix signature."""
    sizes = np.bincount(owner, minlength=count).astype(np.int64)
    losses = sizes - (sizes * percent + 99) // 100 + 1
    often = flags[(hashes & U64(_COUNTERS - 1)).astype(np.int64)]
    rare = np.flatnonzero(~often)
    rares = np.bincount(owner[rare], minlength=count)
    rank = np.arange(len(rare)) - (np.cumsum(rares) - rares)[owner[rare]]
    chosen = rare[rank < losses[owner[rare]]]
    sets, signs = [owner[chosen]], [hashes[chosen]]
    begin = np.searchsorted(owner, np.arange(count + 1))
    for one in np.flatnonzero((rares < losses) & (sizes > 0)):
        a, b = begin[one], begin[one + 1]
        frequent = hashes[a:b][often[a:b]]
        need = int(losses[one] - rares[one])
        level = int(sizes[one]).bit_length() - 1
        levels = [level]
        if sizes[one] * 100 >= percent * (1 << (level + 1)):
            levels.append(level + 1)
        found = [s for at in levels for s in _combinations(frequent, need, at, shift)]
        sets.append(np.full(len(found), one))
        signs.append(np.array(found, dtype=U64))
    return np.concatenate(sets), np.concatenate(signs)


def _postings(docs: DataFrame, flags: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """(sign, node, size): the prefix signatures of every node."""
    shift = _class_shift(percent)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def make(batch, texts):
        owner, hashes = shingle_sets(texts, shingle)
        nodes, sizes = _nodes(owner, hashes, texts.count)
        _, once = np.unique(nodes, return_index=True)
        alone = np.zeros(texts.count, dtype=bool)
        alone[once] = True
        mine = alone[owner]
        often = np.unpackbits(shared.value).astype(bool)
        sets, signs = _signatures(owner[mine], hashes[mine], texts.count, often, percent, shift)
        return pa.RecordBatch.from_arrays(
            [signed(signs), signed(nodes[sets]), pa.array(sizes[sets])], names=["sign", "node", "size"]
        )

    return docs.select("text").mapInArrow(over_texts(make), "sign bigint, node bigint, size bigint")


def _bitmaps(batches, shingle):
    """Adds the parity bitmap of each node: about one bit per token, by the tokens' low bits."""
    for batch in by_size(batches):
        owner, hashes = shingle_sets(Texts(batch.column("text")), shingle)
        edges = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        maps = []
        for a, b in zip(edges, edges[1:]):
            width = 1 << max(6, int(b - a).bit_length())
            seen = np.bincount((hashes[a:b] & U64(width - 1)).astype(np.int64), minlength=width)
            maps.append(np.packbits((seen & 1).astype(np.uint8), bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), batch.column("size"), pa.array(maps, pa.binary()), batch.column("text")],
            names=["node", "size", "bits", "text"],
        )


def _fold(bits: int, width: int, target: int) -> int:
    while width > target:
        width //= 2
        bits = (bits >> width) ^ (bits & ((1 << width) - 1))
    return bits


def _may_link(batches, percent):
    """Drops pairs whose bitmaps differ in more bits than linked sets may differ in tokens."""
    for batch in batches:
        a, b = batch.column("size_a").to_pylist(), batch.column("size_b").to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())):
            width = 8 * min(len(x), len(y))
            one = _fold(int.from_bytes(x, "little"), 8 * len(x), width)
            two = _fold(int.from_bytes(y, "little"), 8 * len(y), width)
            common = -(-percent * (a[i] + b[i]) // (100 + percent))
            if (one ^ two).bit_count() <= a[i] + b[i] - 2 * common:
                keep.append(i)
        if keep:
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _both_sets(batch, shingle):
    """(owner, hash, is text_b) of the shingles of both texts of every pair, sorted by owner and hash."""
    ours, left = shingle_sets(Texts(batch.column("text_a")), shingle)
    theirs, right = shingle_sets(Texts(batch.column("text_b")), shingle)
    owner = np.concatenate([ours, theirs])
    hashes = np.concatenate([left, right])
    second = np.r_[np.zeros(len(ours), dtype=bool), np.ones(len(theirs), dtype=bool)]
    order = np.lexsort((second, hashes, owner))
    return owner[order], hashes[order], second[order]


def _common(owner, hashes, rows):
    twin = (owner[1:] == owner[:-1]) & (hashes[1:] == hashes[:-1])
    return twin, np.bincount(owner[1:][twin], minlength=rows)


def _verified(batches, shingle, percent):
    """Pairs whose whole texts reach the similarity."""
    for batch in by_size(batches, "text_a", 1 << 20):
        owner, hashes, _ = _both_sets(batch, shingle)
        _, common = _common(owner, hashes, batch.num_rows)
        union = np.bincount(owner, minlength=batch.num_rows) - common
        linked = (union > 0) & (100 * common >= percent * union)
        if linked.any():
            yield batch.select(["a", "b"]).take(pa.array(np.flatnonzero(linked)))


def _measured(batches, shingle):
    """Every pair with the number of shingles that its texts have in common."""
    for batch in by_size(batches, "text_a", 1 << 20):
        owner, hashes, _ = _both_sets(batch, shingle)
        _, common = _common(owner, hashes, batch.num_rows)
        columns = [batch.column(c) for c in ("a", "b", "size_a", "size_b")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(common)], names=["a", "b", "size_a", "size_b", "common"])


def _differences(batches, shingle):
    """(node, hub, token): the shingles that only one of a node a and its hub b has, told apart."""
    for batch in by_size(batches, "text_a", 1 << 20):
        owner, hashes, second = _both_sets(batch, shingle)
        twin, _ = _common(owner, hashes, batch.num_rows)
        alone = ~(np.r_[False, twin] | np.r_[twin, False])
        tokens = np.where(second, mix(hashes ^ _SALT), hashes)[alone]
        who = owner[alone]
        yield pa.RecordBatch.from_arrays(
            [take(batch, "a", who), take(batch, "b", who), signed(tokens)], names=["node", "hub", "token"]
        )


class _Verifier:
    """Checks candidate pairs of nodes against the nodes' texts."""

    def __init__(self, texts: DataFrame, shingle: int, percent: int):
        self.texts, self.shingle, self.percent = texts, shingle, percent

    def _attach(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        for side in ("a", "b"):
            names = [F.col(c).alias(f"{c}_{side}") for c in columns]
            pairs = pairs.join(self.texts.select(F.col("node").alias(side), *names), side)
        return pairs

    def filtered(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        return self._attach(pairs, ["size", "bits"]).mapInArrow(
            lambda batches: _may_link(batches, percent), "a bigint, b bigint"
        )

    def measured(self, pairs: DataFrame) -> DataFrame:
        shingle = self.shingle
        return self._attach(pairs.select("a", "b"), ["size", "text"]).mapInArrow(
            lambda batches: _measured(batches, shingle), "a bigint, b bigint, size_a bigint, size_b bigint, common bigint"
        )

    def differences(self, pairs: DataFrame) -> DataFrame:
        shingle = self.shingle
        return self._attach(pairs.select("a", "b"), ["text"]).mapInArrow(
            lambda batches: _differences(batches, shingle), "node bigint, hub bigint, token bigint"
        )

    def links(self, pairs: DataFrame) -> DataFrame:
        shingle, percent = self.shingle, self.percent
        return self._attach(pairs.select("a", "b"), ["text"]).mapInArrow(
            lambda batches: _verified(batches, shingle, percent), "a bigint, b bigint"
        )


def _fits(percent: int, one: str, two: str):
    """Sizes that two linked sets can have."""
    return F.expr(f"100 * least({one}, {two}) >= {percent} * greatest({one}, {two})")


def _hub_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the group hub it shares most signatures with.

    A hub is the most central node of its group: the one whose signatures are shared most often
    for its size, by salted hash among equals. The text that near copies were made from comes
    first, though two copies may be too far from each other to link. Hubs rank before their
    nodes, so following them ends.
    """
    central = live.groupBy("node").agg(F.expr("-(1000 * sum(n) div first(size))").alias("distance"))
    rank = F.struct("distance", F.xxhash64("node", F.lit(1)).alias("rank"), "node", "size", "label")
    hubs = (
        live.join(central, "node")
        .groupBy("sign")
        .agg(F.min(rank).alias("hub"), F.min("label").alias("low"), F.max("label").alias("high"))
        .where("low < high")
        .select("sign", "hub")
    )
    shared = (
        live.join(hubs, "sign")
        .where(F.col("label") != F.col("hub.label"))
        .where(_fits(percent, "size", "hub.size"))
        .groupBy("node", F.col("hub.node").alias("hub"))
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    best = shared.groupBy("node").agg(F.max(F.struct("shared", "hub")).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.hub").alias("b"))


# How a node lies to its hub: linked, too far to link but near enough that a node linked to the
# hub may link with it, or beyond that.
_NEAR, _MID, _FAR = 0, 1, 2


def _placed(verifier: _Verifier, pairs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links, places) of nodes and their hubs.

    ``pairs`` (a, b) has one hub b per node a. Hubs that are linked with a hub of their own hand
    their nodes on to it, so a group of near copies has one hub in the end. places (node, hub,
    place, size, hub_size, common) has the last hub of each node; links has every pair that was
    found to link on the way.
    """
    linked = F.expr(f"100 * common >= {percent} * (size_a + size_b - common)")
    first = stage(verifier.measured(pairs))
    above = first.where(linked).select(F.col("a").alias("top"), F.col("b").alias("next"))
    top = first.select("a", F.col("b").alias("top"))
    for _ in range(2):
        top = top.join(above, "top", "left").select("a", F.coalesce("next", "top").alias("top"))
    moved = top.join(first.select("a", "b"), "a").where("top <> b AND top <> a")
    second = stage(verifier.measured(moved.select("a", F.col("top").alias("b"))))
    kept = first.join(second.select("a"), "a", "left_anti").unionByName(second)
    union = "(size_a + size_b - common)"
    place = (
        F.when(linked, _NEAR)
        # The triangle inequality of Jaccard distances parts the far ones from the linked ones.
        .when(F.expr(f"100 * common >= {2 * percent - 100} * {union}"), _MID)
        .otherwise(_FAR)
    )
    places = kept.select(
        F.col("a").alias("node"),
        F.col("b").alias("hub"),
        place.alias("place"),
        F.col("size_a").alias("size"),
        F.col("size_b").alias("hub_size"),
        "common",
    )
    return first.unionByName(second).where(linked).select("a", "b"), places


def _difference_pairs(verifier: _Verifier, places: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes of one hub that may link though one of them is not linked to it.

    Seen from the hub a node is a short list of differences: shingles that it lacks and shingles
    that it adds. Two nodes x and y with c common shingles with a hub of H have
    c(x) + c(y) - H + (differences that both have) in common, so linking takes a least number of
    shared differences: it is at least 1 when one node is not linked to the hub, and grows
    with the distance to it. That bound, taken against the closest node of the other side,
    gives each node a prefix of its differences, rarest within the hub first; nodes that may
    link share a token of their prefixes. Thousands of copies with edits of their own share the
    text, but not the edits, so the lists hardly meet.
    """
    hubs = places.where(F.col("place") == _MID)
    # G is additive: nodes x and y need (100 + p) * H - G(x) - G(y) over 100 + p shared differences.
    good = F.expr(f"(100 + {percent}) * common - {percent} * size")
    best = hubs.groupBy("hub").agg(F.max(good).alias("best_mid"))
    here = places.where(F.col("place") <= _MID).join(best, "hub").withColumn("good", good)

    def need(other: str) -> Column:
        missing = f"greatest(1, -floor((good + {other} - (100 + {percent}) * hub_size) / (100D + {percent})))"
        return F.expr(f"hub_size + size - 2 * common - CAST({missing} AS BIGINT) + 1")

    # The hub is the closest of those linked to it: its G is 100 H.
    sized = stage(
        here.withColumn("to_mid", need("best_mid"))
        .withColumn("to_near", F.when(F.col("place") == _MID, need("100 * hub_size")).otherwise(F.lit(0)))
        .where("to_mid > 0 OR to_near > 0")
        .select("node", "hub", "place", "size", "to_mid", "to_near")
    )
    tokens = stage(verifier.differences(sized.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    often = tokens.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    order = Window.partitionBy("node").orderBy("often", "token")
    ranked = (
        attach(tokens, stage(often), ["hub", "token"])
        # Tokens that one node alone has come first in its prefix and are in no other.
        .withColumn("often", F.coalesce("often", F.lit(1)))
        .withColumn("at", F.row_number().over(order))
        .where("often > 1")
        .join(sized, ["node", "hub"])
    )
    marked = stage(
        ranked.select(
            "hub", "token", "node", "size", "place", (F.col("at") <= F.col("to_mid")).alias("for_mid"), (F.col("at") <= F.col("to_near")).alias("for_near")
        ).where("for_mid OR for_near")
    )

    def side(name: str) -> DataFrame:
        return marked.select("hub", "token", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "place", "for_mid", "for_near")])

    near = f"place_b = {_NEAR} AND for_near_a AND for_mid_b"
    mid = f"place_b = {_MID} AND for_mid_a AND for_mid_b AND node_a < node_b"
    return (
        side("a").where(f"place_a = {_MID}").join(side("b").where("for_mid_b"), ["hub", "token"])
        .where(f"({near}) OR ({mid})")
        .where(_fits(percent, "size_a", "size_b"))
        .select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
        .distinct()
    )


def _crossing_pairs(live: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs that share a signature, lie in two components and are not told by a hub.

    A hub tells for two of its nodes unless one is far and the other not linked to it. In each
    signature group the largest block of nodes with one hub that are not far makes no pairs
    with itself; only what lies outside the block meets the group.

    A pair that shares many signatures comes up once for each. Where both nodes also have the
    same signature just before, the pair has come up there, so it is left out here.
    """
    block = F.when(F.col("place") <= _MID, F.col("hub"))
    mixed = live.groupBy("sign").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("sign")
    few = stage(live.drop("n").join(mixed, "sign"))
    counts = few.withColumn("block", block).where("block IS NOT NULL").groupBy("sign", "block").agg(F.count(F.lit(1)).alias("held"))
    bulk = counts.groupBy("sign").agg(F.max(F.struct("held", "block")).alias("most"))
    rest = (
        few.join(bulk.select("sign", F.col("most.block").alias("bulk")), "sign", "left")
        .withColumn("outside", ~F.coalesce(block == F.col("bulk"), F.lit(False)))
        .withColumn("before", F.lag("sign").over(Window.partitionBy("node").orderBy("sign")))
    )
    rest = stage(rest)

    def side(name: str) -> DataFrame:
        return rest.select("sign", *[F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "label", "hub", "place", "before", "outside")])

    fresh = "before_a IS NULL OR before_b IS NULL OR before_a <> before_b"
    told = f"hub_a = hub_b AND place_a + place_b <= {2 * _MID}"
    pairs = (
        side("a").where("outside_a").join(side("b"), "sign")
        .where("label_a <> label_b AND (node_a < node_b OR NOT outside_b)")
        .where(f"NOT ({told})").where(fresh)
    )
    return (
        pairs.where(_fits(percent, "size_a", "size_b"))
        .select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
        .distinct()
    )


def _hub_labels(links: DataFrame, jumps: int = 2) -> DataFrame:
    """(node, label) from links (a, b) with one hub b per node a: hubs of hubs are followed."""
    up = stage(links.select(F.col("a").alias("node"), F.col("b").alias("label")))
    for _ in range(jumps):
        above = up.select(F.col("node").alias("label"), F.col("label").alias("higher"))
        joined = up.join(above, "label", "left")
        up = stage(joined.select("node", F.coalesce("higher", "label").alias("label")))
    return up


def _live_postings(docs: DataFrame, flags: np.ndarray, shingle: int, percent: int) -> DataFrame:
    """The postings of signatures that are found more than once, with that number (n); the others are deleted."""
    path = new_path(docs.sparkSession, "live")
    with scope(docs.sparkSession):
        postings = stage(_postings(docs, flags, shingle, percent))
        groups = postings.groupBy("sign").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        return stage(postings.join(groups, "sign").distinct(), path)


def _labels(
    source: DataFrame, members: DataFrame, flags: np.ndarray, shingle: int, percent: int, hubs: bool
) -> DataFrame:
    """(node, label): the component of every node that links with another."""
    live = _live_postings(source, flags, shingle, percent)
    nodes = live.select("node").distinct()
    keys = members.join(nodes, "node").groupBy("node").agg(F.min("text_key").alias("text_key"), F.min("size").alias("size"))
    texts = stage(
        source.select("text_key", "text")
        .join(keys, "text_key")
        .dropDuplicates(["node"])
        .select("node", "size", "text")
        .mapInArrow(
            lambda batches: _bitmaps(batches, shingle), "node bigint, size bigint, bits binary, text string"
        )
    )
    verifier = _Verifier(texts, shingle, percent)

    alone = [F.col("node").alias("hub"), F.lit(_NEAR).alias("place")]
    labelled = live.withColumn("label", F.col("node"))
    path = new_path(source.sparkSession, "candidates")
    with scope(source.sparkSession):
        if hubs:
            links, places = _placed(verifier, _hub_pairs(labelled, percent), percent)
            places, links = stage(places), stage(links)
            one = links.groupBy("a").agg(F.min("b").alias("b"))
            placed = places.join(_hub_labels(one), "node", "left")
            labelled = (
                live.join(placed.select("node", "hub", "place", "label"), "node", "left")
                .withColumn("label", F.coalesce("label", "node"))
                .withColumn("hub", F.coalesce("hub", "node"))
                .withColumn("place", F.coalesce("place", F.lit(_NEAR)))
            )
            told = _difference_pairs(verifier, places, percent)
        else:
            labelled = labelled.select("*", *alone)
            links = told = None
        candidates = verifier.filtered(_crossing_pairs(labelled, percent))
        found = verifier.links(stage(candidates if told is None else candidates.unionByName(told).distinct()))
        found = stage(found if links is None else found.unionByName(links), path)
    return connected_components(found)


def _labelled(docs: DataFrame, shingle: int, percent: int, hubs: bool) -> tuple[DataFrame, DataFrame]:
    """(members, labels) of ``docs`` (doc_id, text): doc_id, text_key, node, size; node, label."""
    spark = docs.sparkSession
    source = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    scanned = stage(_members_and_counts(source, shingle))
    members = scanned.where("chunk IS NULL").select("doc_id", "text_key", "node", "size")
    total = members.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    flags = _frequent_flags(spark, scanned.where("chunk IS NOT NULL").select("chunk", "counts"), total)

    path = new_path(spark, "labels")
    with scope(spark):
        labels = stage(_labels(source, members, flags, shingle, percent, hubs), path)
    return members, labels


def jaccard_components(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 75,
    hubs: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Groups documents by chains of links between similar shingle sets.

    Two documents link when 100 * common shingles >= percent * all shingles of both, over sets
    of distinct ``shingle``-word runs of the whole texts (A-Z lower-cased, words
    ``[^\\x20\\x09-\\x0D]+``); a shorter text is one shingle. Returns one row per input row:
    the id, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Null texts and texts without words have no shingles and link with nothing: their
    component_id is their own id. Null ids are kept and ignored when the smallest id is sought
    (a component of null ids only has none); repeated ids and rows each count. Other columns
    are ignored, whatever their names. An empty table gives an empty one. Runs its rounds when
    called.
    """
    source = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    members, labels = _labelled(source, shingle, percent, hubs)
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = placed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("smallest"))
    return placed.join(smallest, "label", "left").select(
        F.col("doc_id").alias(id_column),
        F.col("size").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 75) -> DataFrame:
    """One row of every component of similar texts, all columns as they are; reads column text.

    Components are those of ``jaccard_components``, by text: rows that share an id, or have
    none, stay apart unless their texts are linked. The row that stays is the least by doc_id
    (nulls last), then by the other columns in order. Rows without words are linked with
    nothing and all stay, repeated ones too. ``docs`` should be a scan; an empty table gives an
    empty one.
    """
    text = F.col("text").cast("string")
    path = new_path(docs.sparkSession, "labels")
    with scope(docs.sparkSession):
        members, labels = _labelled(docs.select(F.lit(0).cast("bigint").alias("doc_id"), text.alias("text")), shingle, percent, True)
        texts = members.where("node IS NOT NULL").select("text_key", "node").distinct()
        keys = texts.join(labels, "node", "left").select(
            F.col("text_key").alias("_key"), F.coalesce("label", "node").alias("_component")
        )
        keys = stage(keys, path)
    keyed = docs.withColumn("_text_key", F.xxhash64(text)).join(keys, F.col("_text_key") == F.col("_key"), "left")
    order = ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    whole = F.struct(F.col("doc_id").isNull().alias("_none"), *[F.col(f"`{c}`") for c in order])
    first = (
        keyed.where("_component IS NOT NULL")
        .groupBy("_component")
        .agg(F.min(whole).alias("_first"))
        .select(*[F.col(f"_first.`{c}`").alias(c) for c in docs.columns])
    )
    return keyed.where("_component IS NULL").select(docs.columns).unionByName(first)
