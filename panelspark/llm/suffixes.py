"""Removal of repeated byte passages by a depth-limited radix sort of suffixes.

Only the first ``threshold`` bytes of a suffix matter, so suffixes are never fully ordered: a
few most-significant-digit passes split them into groups, every pass drops the suffixes that
are alone in their group, and what is equal after the last pass are exactly the repeated
windows.

One row per suffix would be many times the text. So the digits are read relative to an
anchor: in every window the position whose ``gram`` bytes have the smallest hash (leftmost of
equals). Equal windows have the same anchor at the same offset, and one anchor serves a run
of about 40 consecutive windows, which travel as one row.

1. First digit: the gram at the anchor. Runs whose gram occurs once end here.
2. Runs equal in all their bytes collapse: each but the earliest is repeated throughout. The
   earliest of each class goes on if other classes share its gram.
3. Second digit: the bytes common to a block of up to 16 neighbouring windows of a run.
4. Last digit: the whole window. In a group of equals each but the earliest is repeated.

Groups are compared by 64-bit hashes in the passes and 96 bits in the last one. Every group
is reduced to its minimum with map-side combine, then joined back, so a passage in a third of
all documents never meets in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import key_id, key_type, keyed_texts
from panelspark.llm.kernels import U64, RangeHash, Texts, by_size, mix, over_texts, signed, take
from panelspark.sources import new_path, scope, stage

_FIELD = 12
_LOW = U64((1 << 32) - 1)


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _anchored_runs(texts: Texts, threshold: int, gram: int):
    """(owner, start in text, windows, anchor offset, gram hash, class hash) of every run."""
    empty = np.zeros(0, dtype=np.int64)
    if len(texts.data) < threshold:
        return empty, empty, empty, empty, empty.view(U64), empty.view(U64)
    hashed = RangeHash(texts.data, seed=3)
    grams = hashed.windows(gram)
    ranked = (grams & ~_LOW) | np.arange(len(grams), dtype=U64)
    anchors = (_sliding_minimum(ranked, threshold - gram + 1) & _LOW).astype(np.int64)
    edges = np.zeros(len(anchors) + 1, dtype=np.int64)
    long = texts.ends - texts.starts >= threshold
    edges[texts.starts[long]] += 1
    edges[texts.ends[long] - threshold + 1] -= 1
    anchors[np.cumsum(edges[:-1]) == 0] = -1
    first = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    after = np.r_[first[1:], len(anchors)]
    whole = anchors[first] >= 0
    first, after = first[whole], after[whole]
    anchor = anchors[first]
    owner = texts.owner(first)
    bytes_hash = hashed(first, after - 1 + threshold)
    classes = mix(bytes_hash + mix((anchor - first).astype(U64)))
    return owner, first - texts.starts[owner], after - first, anchor - first, grams[anchor], classes


def _pack(start: np.ndarray, windows: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (start << (2 * _FIELD)) | ((windows - 1) << _FIELD) | offset


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    mask = (1 << _FIELD) - 1
    return place >> (2 * _FIELD), ((place >> _FIELD) & mask) + 1, place & mask


def _expand(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number inside the row) for rows repeated ``lengths`` times."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def repeated_spans(keyed: DataFrame, threshold: int = 100) -> DataFrame:
    """(key, start, end) byte ranges, end exclusive, that cover every repeated window.

    ``keyed`` has columns key and text (null counts as empty); a window is repeated if the same
    ``threshold`` bytes start earlier, at a smaller key or in the same text further left.
    Ranges may overlap. Runs its passes when called.
    """
    if not 4 <= threshold <= 1 << _FIELD:
        raise ValueError(f"threshold must lie in 4..{1 << _FIELD}")
    spark = keyed.sparkSession
    path = new_path(spark, "spans")
    with scope(spark):
        return stage(_spans(keyed, threshold), path)


def _spans(keyed: DataFrame, threshold: int) -> DataFrame:
    gram = max(2, threshold // 4)
    kind = key_type(keyed)

    def runs_of(batch, texts):
        owner, start, windows, offset, grams, classes = _anchored_runs(texts, threshold, gram)
        return pa.RecordBatch.from_arrays(
            [take(batch, "key", owner), signed(grams), signed(classes), pa.array(_pack(start, windows, offset))],
            names=["key", "gram", "class", "place"],
        )

    runs = keyed.mapInArrow(over_texts(runs_of), f"key {kind}, gram bigint, class bigint, place bigint")
    grams = (
        runs.groupBy("gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"))
        .where("n > 1")
        .select("gram", (F.col("low") != F.col("high")).alias("mixed"))
    )
    kept = stage(runs.join(grams, "gram"))
    place = F.struct("key", "place")
    classes = stage(
        kept.groupBy("gram", "class")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("mixed").alias("mixed"))
        .where("mixed OR first < last")
    )
    copies = (
        kept.join(classes.where("first < last").select("gram", "class", "first"), ["gram", "class"])
        .where(place > F.col("first"))
        .select("key", "place")
    )
    mask = (1 << _FIELD) - 1
    start = F.shiftright("place", 2 * _FIELD)
    windows = F.shiftright("place", _FIELD).bitwiseAND(F.lit(mask)) + 1
    whole_runs = stage(copies.select("key", start.alias("start"), (start + windows - 1 + threshold).alias("end")))

    contexts = stage(_contexts(keyed, classes.where("mixed").select("first.*"), threshold))
    return whole_runs.unionByName(_repeated_windows(contexts, threshold, gram))


def _contexts(keyed: DataFrame, runs: DataFrame, threshold: int) -> DataFrame:
    """The bytes of the given runs: (key, place, bytes)."""

    def cut(batches):
        for batch in by_size(batches):
            texts = Texts(batch.column("text"))
            lists = batch.column("places")
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            counts = np.diff(np.asarray(lists.offsets))
            rows = np.repeat(np.arange(batch.num_rows), counts)
            places = np.asarray(lists.flatten())
            start, windows, _ = _unpack(places)
            begin = texts.starts[rows] + start
            length = windows - 1 + threshold
            _, inner = _expand(length)
            data = texts.data[np.repeat(begin, length) + inner]
            offsets = np.r_[0, np.cumsum(length)].astype(np.int32)
            binary = pa.Array.from_buffers(
                pa.binary(), len(places), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
            )
            yield pa.RecordBatch.from_arrays(
                [take(batch, "key", rows), pa.array(places), binary], names=["key", "place", "bytes"]
            )

    wanted = runs.groupBy("key").agg(F.collect_list("place").alias("places"))
    joined = keyed.dropDuplicates(["key"]) if key_type(keyed).startswith("struct") else keyed
    return joined.join(wanted, "key").mapInArrow(
        cut, f"key {key_type(keyed)}, place bigint, bytes binary"
    )


def _repeated_windows(contexts: DataFrame, threshold: int, gram: int) -> DataFrame:
    """The last two passes, over runs with their bytes."""
    kind = key_type(contexts)
    offsets = threshold - gram + 1
    width = max(16, -(-offsets // 60))

    def blocks(batches):
        for batch in by_size(batches, "bytes"):
            texts = Texts(batch.column("bytes"))
            _, windows, lead = _unpack(np.asarray(batch.column("place")))
            low, high = (lead - windows + 1) // width, lead // width
            rows, inner = _expand(high - low + 1)
            block = low[rows] + inner
            least = block * width
            most = np.minimum(least + width, offsets) - 1
            anchor = texts.starts[rows] + lead[rows]
            digit = RangeHash(texts.data, seed=5)(anchor - least, anchor - most + threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    take(batch, "key", rows),
                    take(batch, "place", rows),
                    pa.array(block.astype(np.int32)),
                    signed(mix(digit + mix(block.astype(U64)))),
                ],
                names=["key", "place", "block", "digit"],
            )

    def last_digits(batches):
        for batch in by_size(batches, "bytes"):
            texts = Texts(batch.column("bytes"))
            start, windows, lead = _unpack(np.asarray(batch.column("place")))
            rows, inner = _expand(windows)
            live = np.asarray(batch.column("blocks"))[rows] >> ((lead[rows] - inner) // width) & 1
            rows, inner = rows[live == 1], inner[live == 1]
            begin = texts.starts[rows] + inner
            one = RangeHash(texts.data, seed=11)(begin, begin + threshold)
            two = RangeHash(texts.data, seed=13)(begin, begin + threshold)
            yield pa.RecordBatch.from_arrays(
                [
                    take(batch, "key", rows),
                    pa.array(start[rows] + inner),
                    signed(one),
                    pa.array((two >> U64(33)).astype(np.int32)),
                ],
                names=["key", "start", "one", "two"],
            )

    cells = contexts.mapInArrow(blocks, f"key {kind}, place bigint, block int, digit bigint")
    shared = cells.groupBy("digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digit")
    live = (
        cells.join(shared, "digit")
        .groupBy("key", "place")
        .agg(F.expr("bit_or(shiftleft(1L, block))").alias("blocks"))
    )
    windows = stage(
        contexts.join(live, ["key", "place"]).mapInArrow(
            last_digits, f"key {kind}, start bigint, one bigint, two int"
        )
    )
    spot = F.struct("key", "start")
    first = (
        windows.groupBy("one", "two")
        .agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
        .where("first < last")
        .select("one", "two", "first")
    )
    later = windows.join(first, ["one", "two"]).where(spot > F.col("first"))
    return later.select("key", "start", (F.col("start") + threshold).alias("end"))


def remove_repeated_passages(
    docs: DataFrame, threshold: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Each document without the bytes of passages that also start earlier.

    Returns one row per input row: the id, ``n_bytes``, ``spans`` (maximal removed byte ranges,
    array of (start, end), end exclusive) and ``kept`` (the other bytes, joined; binary, as a
    cut may split a character). A byte goes if some ``threshold`` bytes around it also start
    earlier: in a row with a smaller id, or further left in the same text. Passages are judged
    on the input, never cross documents, and may overlap.

    Null texts count as empty; texts shorter than the threshold keep everything. Rows with the
    same id and text are one document and get the same result; rows with the same id and
    different texts are ordered by a hash of the text, and null ids come first. Other columns
    are ignored, whatever their names. An empty table gives an empty one.
    """
    keyed = keyed_texts(docs, id_column, text_column)
    spans = repeated_spans(keyed, threshold)
    packed = F.shiftleft("start", 2 * _FIELD).bitwiseOR(F.col("end") - F.col("start"))
    by_key = spans.select("key", packed.alias("span")).groupBy("key").agg(F.collect_list("span").alias("spans"))
    kind = key_type(keyed)
    joined = keyed.join(by_key, "key", "left").select("key", "text", "spans")

    def apply(batches):
        for batch in by_size(batches):
            texts = Texts(batch.column("text"))
            lists = batch.column("spans").to_pylist() if batch.column("spans").null_count < batch.num_rows else [None] * batch.num_rows
            found, kept = [], []
            for a, b, packed_spans in zip(texts.starts, texts.ends, lists):
                data = texts.data[a:b]
                if not packed_spans:
                    found.append([])
                    kept.append(data.tobytes())
                    continue
                edges = np.array(packed_spans, dtype=np.int64)
                start = edges >> (2 * _FIELD)
                end = start + (edges & ((1 << 2 * _FIELD) - 1))
                change = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, end, -1)
                gone = np.cumsum(change[:-1]) > 0
                turns = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                found.append([{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])])
                kept.append(data[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    pa.array(texts.ends - texts.starts),
                    pa.array(found, type=pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    pa.array(kept, type=pa.binary()),
                ],
                names=["key", "n_bytes", "spans", "kept"],
            )

    out = joined.mapInArrow(
        apply, f"key {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    )
    return out.select(key_id(out).alias(id_column), "n_bytes", "spans", "kept")
