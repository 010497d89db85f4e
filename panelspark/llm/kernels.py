"""Array kernels shared by the text operators.

Each kernel works on one Arrow batch of texts at a time, as flat numpy arrays over the UTF-8
bytes of all its texts, so the cost per text is a few vector operations and memory follows
the batch, not the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_ODD_INT = 0x9E3779B97F4A7C15
_ODD = U64(_ODD_INT)
_STEP = U64(0xD6E8FEB86659FD93)
_SEPARATORS = np.zeros(256, dtype=bool)
_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_POWERS: dict[tuple[int, int], np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    out = values ^ (values >> U64(32))
    out *= _STEP
    out ^= out >> U64(29)
    out *= _ODD
    out ^= out >> U64(32)
    return out


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit values."""
    return mix(np.arange(1, 257, dtype=U64) * U64(2 * seed + 3)) | U64(1)


def powers(base: int, count: int) -> np.ndarray:
    """base**0 .. base**(count - 1) modulo 2**64; kept, as every batch needs them."""
    size = 1 << max(16, (count - 1).bit_length())
    if (base, size) not in _POWERS:
        steps = np.full(size, base, dtype=U64)
        steps[0] = 1
        _POWERS[base, size] = np.multiply.accumulate(steps)
    return _POWERS[base, size][:count]


class RangeHash:
    """64-bit hashes of arbitrary byte ranges of one array, by prefix sums of a polynomial."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        self.base = int(mix(np.array([seed], dtype=U64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        terms = byte_table(seed)[data]
        terms *= powers(self.base, max(1, len(data)))[: len(data)]
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(terms, out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of data[start:end] for each pair; it does not depend on the place."""
        value = self.sums[ends] - self.sums[starts]
        value *= powers(self.inverse, len(self.sums))[starts]
        value += (ends - starts).astype(U64) * _ODD
        return mix(value)

    def windows(self, length: int) -> np.ndarray:
        """Hash of data[i:i + length] for every i."""
        count = len(self.sums) - length
        if count <= 0:
            return np.zeros(0, dtype=U64)
        value = self.sums[length:] - self.sums[:count]
        value *= powers(self.inverse, len(self.sums))[:count]
        value += U64(length * _ODD_INT % (1 << 64))
        return mix(value)


class Texts:
    """The bytes of a batch of texts end to end, with the bounds of each; null counts as empty."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
        column = column.cast(pa.large_binary())
        valid = ~np.asarray(column.is_null())
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[
            column.offset : column.offset + len(column) + 1
        ] if len(column) else np.zeros(1, dtype=np.int64)
        raw = column.buffers()[2]
        whole = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.valid = valid
        self.bounds = offsets - offsets[0]
        self.count = len(column)

    @property
    def starts(self) -> np.ndarray:
        return self.bounds[:-1]

    @property
    def ends(self) -> np.ndarray:
        return self.bounds[1:]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.bounds, positions, side="right") - 1


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: start, end, owner and hash of each."""

    def __init__(self, texts: Texts, lower: bool = False, hashed: bool = True):
        data = LOWER[texts.data] if lower else texts.data
        solid = ~_SEPARATORS[data]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        inner = texts.starts[(texts.starts < len(data)) & (texts.starts < texts.ends)]
        first[inner] = solid[inner]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        last[texts.ends[texts.ends > texts.starts] - 1] = solid[texts.ends[texts.ends > texts.starts] - 1]
        self.solid = solid
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.owner = texts.owner(self.starts)
        self.counts = np.bincount(self.owner, minlength=texts.count).astype(np.int64)
        self.hashed = RangeHash(data, seed=7) if hashed else None
        self.hashes = self.hashed(self.starts, self.ends) if hashed else None

    def shingles(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``length`` words inside one text."""
        count = len(self.hashes) - length + 1
        if count <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
        value = np.zeros(count, dtype=U64)
        for i in range(length):
            value = (value ^ self.hashes[i : i + count]) * _STEP
            value ^= value >> U64(31)
        whole = np.flatnonzero(self.owner[:count] == self.owner[length - 1 :])
        return whole, mix(value[whole])


def shingle_sets(texts: Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) of the distinct word shingles of each text, by owner and hash.

    Letters A-Z count as a-z. A text with fewer words has its whole word sequence as the one
    shingle, a text without words none.
    """
    words = Words(texts, lower=True)
    first, hashes = words.shingles(length)
    owner = words.owner[first]
    short = np.flatnonzero((words.counts > 0) & (words.counts < length))
    if len(short):
        begin = np.searchsorted(words.owner, short)
        extra = np.array(
            [hash_sequence(words.hashes[b : b + words.counts[s]]) for s, b in zip(short, begin)],
            dtype=U64,
        )
        owner = np.concatenate([owner, short])
        hashes = np.concatenate([hashes, extra])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    return owner[new], hashes[new]


def hash_sequence(hashes: np.ndarray) -> np.uint64:
    """One hash of a short word sequence, its length included."""
    value = U64(len(hashes))
    with np.errstate(over="ignore"):
        for word in hashes:
            value = (value ^ word) * _ODD
            value ^= value >> U64(30)
    return mix(np.array([value], dtype=U64))[0]


def by_size(
    batches: Iterable[pa.RecordBatch], column: str = "text", most_bytes: int = 1 << 20
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds at most ``most_bytes`` of text, or a single row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        lengths = batch.column(column).cast(pa.large_binary())
        sizes = np.diff(
            np.frombuffer(lengths.buffers()[1], dtype=np.int64)[
                lengths.offset : lengths.offset + len(lengths) + 1
            ]
        )
        group = np.cumsum(sizes) // most_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(int(a), int(b - a))


def over_texts(
    make: Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None],
) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapInArrow function that applies ``make`` to size-limited batches with column text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            out = make(batch, Texts(batch.column("text")))
            if out is not None and out.num_rows:
                yield out

    return run


def take(batch: pa.RecordBatch, column: str, rows: np.ndarray) -> pa.Array:
    """Column values of chosen rows, repeats allowed."""
    return batch.column(column).take(pa.array(rows, type=pa.int64()))


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's BIGINT."""
    return pa.array(values.view(np.int64))
