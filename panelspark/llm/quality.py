"""Quality rules with thresholds that adapt to each language and source.

Per document, measures come from the whole text. Each measure's distribution per (lang,
source) is held in a mergeable quantile sketch: a histogram whose buckets are exact below 64
and have a relative width of at most 1/64 above, so counts of two sketches simply add up.
A group with few documents takes the merged sketch of its language, or of everything. Fences
come from the sketches' quantiles and are joined back to the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import attach
from panelspark.llm.kernels import Texts, Words, over_texts
from panelspark.sources import stage

_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
WINDOW = 8

# measure: (numerator, denominator, upper side?, width in median-to-quartile distances, least margin); all
# are integers, per thousand.
FENCES = {
    "symbols": ("n_symbols", "word_chars", True, 4, 40),
    "repeats": ("n_repeat_words", "n_words", True, 4, 150),
    "dup_lines": ("n_dup_lines", "n_words", True, 4, 100),
    "long_words": ("word_chars", "n_words", True, 4, 1500),
    "short_words": ("word_chars", "n_words", False, 4, 1000),
}


def _repeated(owner: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(occurs again or before, occurs before) within the owner, in input order."""
    order = np.lexsort((hashes, owner))
    same = (owner[order][1:] == owner[order][:-1]) & (hashes[order][1:] == hashes[order][:-1])
    before = np.zeros(len(owner), dtype=bool)
    before[order[1:]] = same
    anywhere = before.copy()
    anywhere[order[:-1]] |= same
    return anywhere, before


def _measure(texts: Texts) -> dict[str, np.ndarray]:
    words = Words(texts)
    data, count = texts.data, texts.count
    solid = np.r_[0, np.cumsum(words.solid & ((data & 0xC0) != 0x80))]
    symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]

    breaks = np.flatnonzero(data == 0x0A)
    begin = np.r_[texts.starts, breaks + 1]
    owner = np.r_[np.arange(count), texts.owner(breaks)]
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    end = np.r_[begin[1:] - 1, 0]
    last = np.r_[owner[1:] != owner[:-1], True] if len(owner) else np.zeros(0, dtype=bool)
    end[last] = texts.ends[owner[last]]
    solid_bytes = np.r_[0, np.cumsum(words.solid)]
    worded = solid_bytes[end] > solid_bytes[begin]
    begin, end, owner = begin[worded], end[worded], owner[worded]
    _, again = _repeated(owner, words.hashed(begin, end))
    n_dup_lines = np.bincount(owner[again], minlength=count)

    first, hashes = words.shingles(WINDOW)
    anywhere, _ = _repeated(words.owner[first], hashes)
    edges = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(edges, first[anywhere], 1)
    np.add.at(edges, first[anywhere] + WINDOW, -1)
    covered = np.cumsum(edges[:-1]) > 0
    n_repeat = np.bincount(words.owner[covered], minlength=count)
    return {
        "n_words": words.counts,
        "word_chars": solid[texts.ends] - solid[texts.starts],
        "n_symbols": symbols[texts.ends] - symbols[texts.starts],
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with the measures of its column ``text``."""

    def make(batch, texts):
        columns = {c: batch.column(c) for c in keep}
        columns |= {c: pa.array(v.astype(np.int64)) for c, v in _measure(texts).items()}
        return pa.RecordBatch.from_pydict(columns)

    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    kinds += [f"{c} bigint" for c in MEASURES]
    return docs.mapInArrow(over_texts(make), ", ".join(kinds))


def _rate(measure: str) -> Column:
    top, bottom, *_ = FENCES[measure]
    return F.expr(f"{top} * 1000 div greatest({bottom}, 1)")


def _bucket(value: str) -> Column:
    """Lower edge of a sketch bucket: the value with all but its leading 7 bits cleared."""
    spare = f"greatest(length(bin({value})) - 7, 0)"
    return F.expr(f"shiftleft(shiftright({value}, {spare}), {spare})")


def quality_sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): the mergeable sketch of every group and measure."""
    pairs = ", ".join(f"'{m}', {FENCES[m][0]} * 1000 div greatest({FENCES[m][1]}, 1)" for m in FENCES)
    long = rows.where("NOT base_failed").select(
        "lang", "source", F.expr(f"stack({len(FENCES)}, {pairs}) AS (measure, value)")
    )
    return (
        long.select("lang", "source", "measure", _bucket("value").alias("bucket"))
        .groupBy("lang", "source", "measure", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, size, one fence per measure) from sketches merged over the other columns."""
    merged = sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
    key = [*groups, "measure"]
    ordered = Window.partitionBy(*key).orderBy("bucket")
    ranked = merged.withColumn("upto", F.sum("n").over(ordered)).withColumn(
        "size", F.sum("n").over(Window.partitionBy(*key))
    )

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.expr(f"100 * upto >= {percent} * size"), F.col("bucket")))

    points = ranked.groupBy(*key, "size").agg(
        quantile(25).alias("q25"), quantile(50).alias("q50"), quantile(75).alias("q75")
    )
    fence = F.lit(None).cast("bigint")
    for measure, (_, _, upper, width, margin) in FENCES.items():
        formula = (
            f"q75 + {width} * (q75 - q50) + {margin}" if upper else f"q25 - {width} * (q50 - q25) - {margin}"
        )
        fence = F.when(F.col("measure") == measure, F.expr(formula)).otherwise(fence)
    cells = points.withColumn("fence", fence)
    columns = [F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"f_{m}") for m in FENCES]
    return cells.groupBy(*groups).agg(F.max("size").alias("size"), *columns)


def quality_rules(docs: DataFrame, least_rows: int = 50) -> DataFrame:
    """Measures and verdict of each document: columns doc_id, lang, source, text are read.

    Returns doc_id, n_words, word_chars (code points in words), n_symbols,
    n_dup_lines, n_repeat_words, base_failed (under 20 words, or over 30 % of them inside
    repeated 8-word windows), kept, lang and source. A document is kept if it passes the base rule and every
    measure lies inside the fences of its (lang, source), or of its lang, or of all documents,
    whichever is the first with ``least_rows`` documents. Fences are learned from documents
    that pass the base rule.

    Null texts have no words and fail. Null lang or source is a group of its own. Repeated rows
    and ids each count. Other columns are ignored, whatever their names. An empty table gives
    an empty one. Scans the texts once, when called.
    """
    source = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("text").cast("string"))
    rows = stage(_based(measured(source, ["doc_id", "lang", "source"])))
    judged = _judged(rows, thresholds(rows, least_rows))
    return judged.select("doc_id", *MEASURES, "base_failed", "kept", "lang", "source")


def _based(rows: DataFrame) -> DataFrame:
    return rows.withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))


def _judged(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """``rows`` with column kept, the fences of their (lang, source) attached."""
    inside = F.lit(True)
    for measure, (_, _, upper, *_) in FENCES.items():
        rate, fence = _rate(measure), F.col(f"f_{measure}")
        inside = inside & (rate <= fence if upper else rate >= fence)
    return attach(rows, fences, ["lang", "source"]).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))
    )


def keep_good(docs: DataFrame, least_rows: int = 50) -> DataFrame:
    """The rows of ``docs`` that the rules keep, each judged by its own text, all columns as they are.

    Fences are learned in one scan of the texts; a second one measures each text again and
    judges it on the spot, so no text crosses a shuffle. ``docs`` should be a scan. Columns named
    like a measure are refused. Other odd rows as in ``quality_rules``.
    """
    clash = {*MEASURES, "base_failed", "kept", *(f"f_{m}" for m in FENCES)} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are named like measures")
    source = docs.withColumn("text", F.col("text").cast("string"))
    narrow = source.select(F.col("lang").cast("string"), F.col("source").cast("string"), "text")
    fences = thresholds(_based(measured(narrow, ["lang", "source"])), least_rows)
    judged = _judged(_based(measured(source, docs.columns)), fences)
    return judged.where("kept").select(docs.columns)


def thresholds(rows: DataFrame, least_rows: int) -> DataFrame:
    """(lang, source, one fence per measure) for every group among ``rows`` that pass the base rule; reads them once."""
    sketches = stage(quality_sketches(rows))
    names = [f"f_{m}" for m in FENCES]
    cells = sketches.select("lang", "source").distinct().select("lang", "source")
    levels = []
    for i, groups in enumerate((["lang", "source"], ["lang"], [])):
        fences = _fences(sketches, groups)
        levels.append(fences.select(*groups, F.col("size").alias(f"size{i}"), *[F.col(n).alias(f"{n}{i}") for n in names]))
    own, lang, everything = levels
    lang = lang.withColumnRenamed("lang", "lang1")
    table = (
        attach(cells, own, ["lang", "source"])
        .join(lang, F.col("lang").eqNullSafe(F.col("lang1")), "left")
        .crossJoin(everything)  # one row
    )

    def chosen(name: str) -> Column:
        return (
            F.when(F.col("size0") >= least_rows, F.col(f"{name}0"))
            .when(F.col("size1") >= least_rows, F.col(f"{name}1"))
            .otherwise(F.col(f"{name}2"))
        )

    return stage(table.select("lang", "source", *[chosen(n).alias(n) for n in names]))
