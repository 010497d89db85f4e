"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over bytes: a byte is predicted from the
longest known context of up to ``order`` bytes, and a context that has not seen it escapes to
the next shorter one (method C: the escape weighs as much as the number of different bytes
seen; bytes the longer context knows are excluded below). Statistics are frozen after
training, so the exact code length of every (context, byte) is worked out once into a table,
and a text's code length is a sum of look-ups. The language with the shortest code wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.kernels import LOWER, Texts, by_size

ALPHABET = 40
ORDER = 3


def byte_classes(counts: np.ndarray) -> np.ndarray:
    """Class of each byte: the most frequent bytes alone, 1 for all others, 0 means text start."""
    ranked = np.argsort(-counts, kind="stable")[: ALPHABET - 2]
    classes = np.ones(256, dtype=np.int32)
    alone = ranked[counts[ranked] > 0]
    classes[alone] = np.arange(2, 2 + len(alone))
    return classes[LOWER]


def contexts(texts: Texts, classes: np.ndarray) -> np.ndarray:
    """For each byte the code of its ``ORDER`` preceding classes and its own."""
    own = classes[texts.data].astype(np.int32)
    code = own.copy()
    filled = texts.starts[texts.starts < texts.ends]
    for back in range(1, ORDER + 1):
        before = np.zeros(len(own), dtype=np.int32)
        before[back:] = own[:-back]
        for lead in range(back):
            spots = filled + lead
            before[spots[spots < len(own)]] = 0
        code += before * ALPHABET**back
    return code


def code_lengths(grams: np.ndarray) -> np.ndarray:
    """Bits of every (context, class) from counts indexed by ``contexts`` codes."""
    shape = (ALPHABET,) * (ORDER + 1)
    counts = grams.reshape(shape).astype(np.float64)
    chance = np.full(ALPHABET, 1 / (ALPHABET - 1))
    chance[0] = 0  # a text start is never coded
    for order in range(ORDER + 1):
        seen = counts.sum(axis=tuple(range(ORDER - order))) if order < ORDER else counts
        total = seen.sum(axis=-1, keepdims=True)
        kinds = (seen > 0).sum(axis=-1, keepdims=True)
        left = np.where(seen > 0, 0, np.broadcast_to(chance, seen.shape))
        rest = left.sum(axis=-1, keepdims=True)
        weight = total + np.where(rest > 0, kinds, 0)
        own = np.divide(seen, weight, out=np.zeros_like(seen), where=weight > 0)
        escape = np.divide(kinds, weight, out=np.ones_like(total), where=weight > 0)
        below = np.divide(left, rest, out=np.zeros_like(left), where=rest > 0)
        chance = own + escape * below
    return -np.log2(np.maximum(chance, 1e-12)).astype(np.float32).ravel()


def _learning(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    return docs.where(fold != 2).where("text IS NOT NULL AND lang IS NOT NULL").select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )


def train(docs: DataFrame, most_texts: int = 1500) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, classes of bytes, code lengths per language) from (lang, text) rows.

    A bounded sample is used: about ``most_texts`` texts per language, chosen by a hash of the
    text (all, where there are fewer). Each language's counts are summed on the executors; the
    driver gets its nonzero ones, at most ALPHABET**(ORDER + 1), and every task 10 MB of code
    lengths per language.
    """
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    languages = sorted(r.lang for r in sizes)
    rate = F.lit(0.0)
    for r in sizes:
        rate = F.when(F.col("lang") == r.lang, most_texts / r.n).otherwise(rate)
    share = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = docs.where(share < rate)

    def bytes_of(batches):
        counts = np.zeros(256, dtype=np.int64)
        for batch in by_size(batches):
            counts += np.bincount(LOWER[Texts(batch.column("text")).data], minlength=256)
        spots = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(spots), pa.array(counts[spots])], names=["byte", "n"])

    def grams_of(batches):
        for batch in by_size(batches):
            texts = Texts(batch.column("text"))
            names = np.array(batch.column("lang").to_pylist(), dtype=object)
            code = contexts(texts, classes)
            owner = np.repeat(np.arange(texts.count), texts.ends - texts.starts)
            for name in dict.fromkeys(names):
                found, n = np.unique(code[(names == name)[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(found), pa.string()), pa.array(found), pa.array(n)],
                    names=["lang", "code", "n"],
                )

    by_byte = sample.mapInArrow(bytes_of, "byte bigint, n bigint").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(256, dtype=np.int64)
    for r in by_byte:
        counts[r.byte] = r.n
    classes = byte_classes(counts)

    def packed(table: pa.Table) -> pa.Table:
        grams = np.zeros(ALPHABET ** (ORDER + 1), dtype=np.int64)
        grams[np.asarray(table.column("code"))] = np.asarray(table.column("n"))
        bits = code_lengths(grams).astype(np.float16)
        return pa.table({"lang": table.column("lang")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

    summed = (
        sample.mapInArrow(grams_of, "lang string, code int, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang")
        .applyInArrow(packed, "lang string, bits binary")
    )
    found = {r.lang: np.frombuffer(r.bits, dtype=np.float16) for r in summed.collect()}
    languages = [name for name in languages if name in found]
    return languages, classes, np.stack([found[n] for n in languages]) if languages else np.zeros((0, 1), np.float16)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learns from text and lang of rows with a lang whose crc32(doc_id as text) mod 4 is not 2;
    the others are held out. The prediction comes from the text alone. score is the share of
    the best language if code-length differences, at most 64 bytes' worth, are read as odds.
    lang_pred is ``und`` with score 0 if the text is null or has no letter, or if no language
    was learned.

    Null ids are held out. Ties go to the language that sorts first. Repeated rows each count,
    other columns are ignored. An empty table gives an empty one. Trains when called.
    """
    languages, classes, bits = train(_learning(docs))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    text = F.col("text").cast("string")
    rows = docs.select(
        "doc_id",
        held.alias("held_out"),
        text.alias("text"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
    )
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tables = [row.astype(np.float32) for row in shared.value]
        for batch in by_size(batches):
            texts = Texts(batch.column("text"))
            code = contexts(texts, classes)
            sizes = texts.ends - texts.starts
            names = np.full(texts.count, "und", dtype=object)
            score, least = np.zeros(texts.count), np.zeros(texts.count)
            if tables:
                sums = np.empty((len(tables), texts.count))
                for i, table in enumerate(tables):
                    upto = np.r_[0.0, np.cumsum(table[code], dtype=np.float64)]
                    sums[i] = upto[texts.ends] - upto[texts.starts]
                best = sums.argmin(axis=0)
                low = sums.min(axis=0)
                scale = np.minimum(1, 64 / np.maximum(sizes, 1))
                share = 1 / np.exp2(-(sums - low) * scale).sum(axis=0)
                clear = np.asarray(batch.column("lettered"))
                names[clear] = np.array(languages, dtype=object)[best[clear]]
                score[clear] = share[clear]
                least = low / np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(names.tolist(), pa.string()),
                    pa.array(score),
                    pa.array(least),
                ],
                names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits_per_byte double"
    )
