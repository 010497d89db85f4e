"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on ordinary and one on toxic text. A window of a
few words is compressed once with the ordinary dictionary and once with the ordinary one
preceded by the toxic one: what it gains is toxic content that ordinary text does not explain.
Counts of windows whose gain passes a few thresholds, weighed by a calibrated logistic
function, give the document's score.

The method named for this operator trains both dictionaries with zstandard, each on its own
class. That was tried: the lengths under two trained dictionaries part the classes poorly (area
under the curve 0.74 at best, see the README), as both fill up with what toxic and ordinary text
share. So the toxic dictionary's content is learned as the words that are several times as frequent in
toxic texts as in ordinary ones, the most frequent last; zstandard's own trainer makes
the ordinary dictionary.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.kernels import by_size

WINDOW = 8
LEVEL = 6
THRESHOLD = 0.7
_ORDINARY_BYTES = 32 << 10
_TOXIC_BYTES = 4 << 10
_EDGE = ".,;:!?*#$%&\"'()[]"
_GAINS = (1, 2, 3, 5)


def _windows(text: str) -> list[bytes]:
    """Distinct windows of consecutive words, lower-cased."""
    words = text.lower().split()
    cut = (" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW))
    return [f" {w} ".encode("utf-8", "replace") for w in dict.fromkeys(cut)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL,
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
        min_match=3,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary's bytes; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=32).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """The pair of dictionaries, and the measures of a text under them."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        # Content of at least 8 bytes, as zstandard asks for.
        base = ordinary + b" of the and to in "
        self.plain, self.both = _compressor(base), _compressor(toxic + base)

    def measures(self, text: str) -> list[float]:
        plain, both = self.plain.compress, self.both.compress
        gains = np.array([len(plain(w)) - len(both(w)) for w in _windows(text)] or [0])
        counts = [(gains >= g).sum() for g in _GAINS]
        return [*counts, gains[gains > 0].sum(), -gains[gains < 0].sum(), len(gains)]


def _spread(rows: list[list[float]]) -> np.ndarray:
    """Measures as calibrated: logarithms, rates per window, and a constant."""
    counts = np.array(rows, dtype=float)
    rates = counts[:, :5] / np.maximum(counts[:, -1:], 1)
    return np.c_[np.log1p(counts), np.log1p(20 * rates), np.ones(len(counts))]


def _probability(weights: np.ndarray, rows: list[list[float]]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_spread(rows) @ weights, -30, 30)))


def _calibrated(rows: list[list[float]], labels: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights of a penalised logistic regression, by Newton steps."""
    x, w = _spread(rows), None
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (labels - p) - penalty * w)
    return w


def fit(toxic: list[str], ordinary: list[str]) -> tuple[bytes, bytes, np.ndarray] | None:
    """(ordinary dictionary, toxic dictionary, weights), or None if a class has no text.

    Two thirds of each class train the dictionaries, the rest calibrates (all of it, where
    there are under ten texts).
    """
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if not toxic or not ordinary:
        return None

    def parts(texts: list[str]) -> tuple[list[str], list[str]]:
        if len(texts) < 10:
            return texts, texts
        return [t for i, t in enumerate(texts) if i % 3], texts[::3]

    (toxic, toxic_rest), (ordinary, ordinary_rest) = parts(toxic), parts(ordinary)

    def frequency(texts: list[str]) -> Counter:
        return Counter(w for t in texts for w in {x.strip(_EDGE) for x in t.lower().split()})

    ours, theirs = frequency(toxic), frequency(ordinary)
    least = max(2, 0.012 * len(toxic))
    marked = {
        w: n
        for w, n in ours.items()
        if len(w) >= 3 and n >= least and n / len(toxic) > 8 * (theirs[w] + 0.5) / len(ordinary)
    }
    chosen, held = [], 0
    for word in sorted(marked, key=lambda w: (-marked[w], w)):
        entry = f" {word} ".encode()
        if held + len(entry) > _TOXIC_BYTES:
            break
        chosen.append(entry)
        held += len(entry)
    toxic_content = b"".join(reversed(chosen))
    ordinary_content = _trained([w for t in ordinary for w in _windows(t)], _ORDINARY_BYTES)
    distance = Distance(ordinary_content, toxic_content)
    rows = [distance.measures(t) for t in toxic_rest + ordinary_rest]
    labels = np.r_[np.ones(len(toxic_rest)), np.zeros(len(ordinary_rest))]
    return ordinary_content, toxic_content, _calibrated(rows, labels)


def training_ids(labels: DataFrame, most_toxic: int, most_ordinary: int) -> DataFrame:
    """(doc_id, toxic): the ids to train on, chosen by a hash of the id from ``labels`` alone.

    About ``most_toxic`` and ``most_ordinary`` of them (all, where there are fewer), each once.
    """
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    wanted = F.when(F.col("toxic"), most_toxic / max(1, sizes.get(True, 0))).otherwise(
        most_ordinary / max(1, sizes.get(False, 0))
    )
    return labels.where(share < wanted)


def train(
    docs: DataFrame,
    labels: DataFrame,
    most_toxic: int = 2000,
    most_ordinary: int = 4000,
    most_text_bytes: int = 200_000,
    most_bytes: int = 48 << 20,
) -> bytes:
    """The pickled model from texts (doc_id, text) and their labels (doc_id, toxic, a boolean, ids once).

    A bounded, documented sample is used: about ``most_toxic`` and ``most_ordinary`` ids, whose
    list is broadcast, so that only their texts are read out of the table and shuffled. Of the
    rows of one id the least text counts. Texts of over ``most_text_bytes`` bytes are no samples;
    beyond ``most_bytes`` in all, the texts with the largest hashes are none. Training takes one
    task, within these bounds; only the model, under 100 kB, reaches the driver.
    """
    ids = training_ids(labels, most_toxic, most_ordinary)
    text = F.col("text").cast("string")
    sample = (
        docs.select("doc_id", text.alias("text"))
        .where(text.isNotNull() & (F.octet_length(text) <= most_text_bytes))
        .join(F.broadcast(ids), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
    )
    order = Window.orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounded = sample.withColumn("upto", F.sum(F.octet_length("text")).over(order)).where(F.col("upto") <= most_bytes)

    def make(table: pa.Table) -> pa.Table:
        texts, toxic = table.column("text").to_pylist(), table.column("toxic").to_pylist()
        model = fit([t for t, y in zip(texts, toxic) if y], [t for t, y in zip(texts, toxic) if not y])
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    models = bounded.select("text", "toxic", F.lit(1).alias("part")).groupBy("part").applyInArrow(make, "model binary").collect()
    return models[0].model if models else pickle.dumps(None)


def _crc_fold(column: str, folds: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % folds


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every document: doc_id, held_out, score, predicted.

    Learns from the rows of ``labels`` (doc_id, toxic) whose crc32(doc_id as text) mod 3 is not
    1; the others are held out. The score (0 to 1, higher: likelier toxic) comes from the text
    alone; predicted is 1 from 0.7 on.

    Null texts count as empty; they and texts without words get the score of no evidence. Null
    ids are held out. Of several labels of one id the largest counts. Without a learned text of
    either class every score is 0. Repeated rows each count, other columns are ignored. An
    empty table gives an empty one. Trains when called.
    """
    held = F.coalesce(_crc_fold("doc_id", 3) == 1, F.lit(True))
    known = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.where(_crc_fold("doc_id", 3) != 1).groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    model = train(docs, known)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        learned = pickle.loads(model)
        distance = None if learned is None else Distance(*learned[:2])
        for batch in by_size(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if learned is None:
                score = np.zeros(len(texts))
            else:
                score = _probability(learned[2], [distance.measures(t) for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score)],
                names=["doc_id", "held_out", "score"],
            )

    scored = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
