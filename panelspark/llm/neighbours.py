"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Each vector is divided by its length, rotated by a seeded random orthogonal matrix and kept as
the signs of its coordinates, 64 to a word. With o the turned unit vector, b = signs / sqrt(dim) its
code and c = <b, o> (the correction scalar), <b, q> / c estimates <o, q>, and for a random
rotation the error is below ``width`` * sqrt((1 - c^2) / c^2) / sqrt(dim - 1) but for a
vanishing share of pairs. Queries are quantised to ``_LEVELS`` levels, so <b, q> is a few
population counts of packed words; the quantisation error is added to the bound.

Codes, correction scalars and lengths are computed once per vector and staged packed, a block of
vectors a row, the original components beside them. Every block of queries is handed to every
block of vectors; the vectors themselves are dealt out once. Inside a block the k vectors with
the largest estimates are scored exactly, and then those whose upper bound reaches the k-th of
these scores: no other can be among the best k, but for the bounds' chance. The best k of each
block leave it, and the best k of all blocks are the result, so what is shuffled grows with the
queries and not with the vectors that bounds let through. Of equal vectors only the k + 1 smallest ids can be
among the best k of any query, so the rest of a large group of copies is not searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources import stage

_BITS = 4
_LEVELS = (1 << _BITS) - 1


def rotation(dimension: int, seed: int, expansion: int) -> np.ndarray:
    """Rows of a random orthogonal matrix: turns vectors into a space ``expansion`` times as wide.

    Padding with zeros before the rotation gives longer codes and so tighter bounds.
    """
    wide = dimension * expansion
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, wide)))
    return (q * np.sign(np.diag(r)))[:dimension]


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as 64-bit words."""
    spare = -bits.shape[1] % 64
    padded = np.pad(bits, ((0, 0), (0, spare)))
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Codes:
    """One-bit codes, correction scalars and lengths of a block of vectors."""

    def __init__(self, words: np.ndarray, correction: np.ndarray, lengths: np.ndarray, dimension: int):
        self.words, self.correction, self.lengths = words, correction, lengths
        self.dimension = dimension
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, vectors: np.ndarray, turn: np.ndarray) -> Codes:
        lengths = np.linalg.norm(vectors, axis=1)
        turned = (vectors / lengths[:, None]) @ turn
        dimension = turned.shape[1]
        return cls(_packed(turned > 0), np.abs(turned).sum(axis=1) / np.sqrt(dimension), lengths, dimension)

    def bounds(self, query: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products with one rotated query."""
        dim = self.dimension
        low, high = query.min(), query.max()
        step = (high - low) / _LEVELS or 1.0
        levels = np.rint((query - low) / step).astype(np.int64)
        planes = _packed(((levels >> np.arange(_BITS)[:, None]) & 1).astype(bool))
        hits = np.zeros(len(self.words))
        for place, plane in enumerate(planes):
            hits += np.bitwise_count(self.words & plane).sum(axis=1, dtype=np.int64) << place
        # sum over coordinates of sign * (low + step * level)
        total = low * (2 * self.ones - dim) + step * (2 * hits - levels.sum())
        estimate = total / np.sqrt(dim) / self.correction
        spread = np.linalg.norm(query) * width / np.sqrt(max(dim - 1, 1))
        error = spread * np.sqrt(np.maximum(1 - self.correction**2, 0)) / self.correction
        error += width * step / np.sqrt(12) / self.correction  # of rounding to levels
        return self.lengths * (estimate - error), self.lengths * (estimate + error)


def _search(ids, codes, vectors, query_ids, queries, turned, k, width):
    """(query, vector, score, reranked) of the best k of one block for each query."""
    for number, query_id in enumerate(query_ids):
        lower, upper = codes.bounds(turned[number], width)
        own = ids == query_id
        lower[own] = upper[own] = -np.inf
        others = len(ids) - int(own.sum())
        if not others:
            continue
        chosen = np.flatnonzero(~own)
        if others > k:
            first = np.argpartition(lower + upper, len(ids) - k)[len(ids) - k :]
            least = _products(vectors[first], queries[number]).min()
            chosen = np.union1d(first, np.flatnonzero(upper >= least))
        scores = _products(vectors[chosen], queries[number])
        order = np.lexsort((ids[chosen], -scores))[:k]
        yield np.full(len(order), query_id), ids[chosen][order], scores[order], np.full(len(order), len(chosen))


def _products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of original vectors; equal vectors give equal values."""
    return (vectors * query).sum(axis=1)


def _usable(column: str) -> Column:
    """Neither null nor zero, and no component null, NaN or infinite."""
    finite = F.forall(
        column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    return F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0)


def nearest_neighbours(
    vectors: DataFrame,
    k: int = 20,
    query_every: int = 20,
    width: float = 2.0,
    expansion: int = 4,
    block_rows: int = 1 << 15,
    query_rows: int = 2048,
    seed: int = 7,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The ``k`` rows with the largest inner product for every query row.

    Queries are rows whose id is divisible by ``query_every``; candidates all rows but the
    query's own id. Returns query_id, rank (from 1), vec_id, score (double, on the original
    vectors) and reranked (vectors of its block that were scored), nearest first, ties to the
    smaller id. Fewer than k candidates are all returned.

    Rows with a null id or vector, a zero vector, a null or non-finite component, or a length
    other than the most frequent one (the smaller of ties) take no part. Rows that repeat id
    and vector count once; of different vectors with one id the smallest (as an array) stays.
    Other columns are ignored. An empty table gives an empty one. Memory is bounded by one
    block of vectors (``block_rows`` at most, fewer if there would be fewer blocks than tasks can
    run) and one of queries; ``width`` sets the chance to miss a neighbour (2: a few
    in 100 for a neighbour just at the threshold, less above), ``expansion`` the bits per component.
    """
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("v")
    ).where(F.col("id").isNotNull() & _usable("v"))
    rows = stage(rows.groupBy("id").agg(F.min("v").alias("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.orderBy(F.desc("n"), "d").first()
    spark = vectors.sparkSession
    if top is None:
        empty = "query_id bigint, rank int, vec_id bigint, score double, reranked bigint"
        return spark.createDataFrame([], empty)
    dimension = top.d
    rows = rows.where(F.size("v") == dimension)
    total = rows.count()
    slots = spark.sparkContext.defaultParallelism
    block_rows = max(1024, min(block_rows, total // (2 * slots) + 1))
    # One matrix for the whole run, so tasks do not factor it again.
    turn = spark.sparkContext.broadcast(rotation(dimension, seed, expansion))

    def packed(source: DataFrame, count: int, name: str, pack, schema: str) -> DataFrame:
        """Blocks of rows, one a row, as bytes."""
        dealt = source.withColumn(name, F.pmod(F.xxhash64("id", F.lit(name)), F.lit(count)).cast("int"))

        def run(batches):
            held, now = [], None

            def done():
                packs = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in zip(*held, strict=True)]
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), *packs], names=schema_names)

            for batch in batches:
                blocks = batch.column(name).to_numpy()
                ids = batch.column("id").to_numpy()
                values = batch.column("v").flatten().to_numpy().reshape(-1, dimension)
                edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
                for a, b in zip(edges, edges[1:]):
                    if a == b:
                        continue
                    if now is not None and blocks[a] != now:
                        yield done()
                        held.clear()
                    now = int(blocks[a])
                    held.append((ids[a:b], *pack(values[a:b])))
            if held:
                yield done()

        schema_names = [part.split()[0] for part in schema.split(", ")]
        return stage(dealt.repartition(name).sortWithinPartitions(name).select("id", "v", name).mapInArrow(run, schema))

    def codes_of(values):
        codes = Codes.of(values, turn.value)
        return codes.words, codes.correction, codes.lengths, values

    # Of equal vectors the k + 1 smallest ids; a large group is thinned in parts before it meets.
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    searched = rows
    for key in ([F.col("v"), part], [F.col("v")]):
        first = Window.partitionBy(*key).orderBy("id")
        searched = searched.withColumn("_nth", F.row_number().over(first)).where(F.col("_nth") <= k + 1).drop("_nth")
    searched = stage(searched)
    asking = rows.where(F.col("id") % query_every == 0)
    blocks, query_blocks = total // block_rows + 1, total // query_every // query_rows + 1
    data = packed(searched, blocks, "block", codes_of, "block int, ids binary, words binary, corrections binary, lengths binary, vectors binary")
    queries = packed(asking, query_blocks, "queries", lambda v: (v,), "queries int, query_ids binary, query_values binary")
    # Every query block is handed to every block of codes: a stated query set against all rows.
    dealt = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tasks = min(blocks * query_blocks, max(4 * slots, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = dealt.join(data, "block").repartition(tasks, "block", "queries")

    def search(batches):
        width_bits = dimension * expansion
        for batch in batches:
            for i in range(batch.num_rows):

                def of(column, kind, batch=batch, i=i):
                    return np.frombuffer(batch.column(column)[i].as_py(), dtype=kind)

                ids = of("ids", np.int64)
                codes = Codes(of("words", np.uint64).reshape(len(ids), -1), of("corrections", float), of("lengths", float), width_bits)
                vectors = of("vectors", float).reshape(-1, dimension)
                query_ids = of("query_ids", np.int64)
                queries = of("query_values", float).reshape(-1, dimension)
                held = list(_search(ids, codes, vectors, query_ids, queries, queries @ turn.value, k, width))
                if held:
                    yield _batch(held)

    found = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double, reranked bigint")
    best = Window.partitionBy("query_id")
    order = best.orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score", "reranked")
    )


def _batch(held) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(c)) for c in zip(*held, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score", "reranked"])
