"""The query of each text operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import statements
from panelspark.llm.jaccard import jaccard_components
from panelspark.llm.language import identify_languages
from panelspark.llm.mixing import mix_sources
from panelspark.llm.neighbours import nearest_neighbours
from panelspark.llm.packing import pack_by_length, word_count
from panelspark.llm.page_text import page_texts
from panelspark.llm.prefix_trie import rebuilt_prefixes
from panelspark.llm.quality import quality_rules
from panelspark.llm.quotes import link_quotes
from panelspark.llm.repair import damage, repair_report
from panelspark.llm.secret_scan import BASE_RULES, find_secrets, found_of, told
from panelspark.llm.suffixes import remove_repeated_passages
from panelspark.llm.toxicity import score_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules(_table(spark, sf, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = remove_repeated_passages(_table(spark, sf, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return cut.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(_table(spark, sf, "documents"))


def op5_length_buckets(spark: SparkSession, sf: str) -> DataFrame:
    lengths = _table(spark, sf, "documents").select("doc_id", word_count().alias("words"))
    return pack_by_length(lengths, tokens=F.col("words")).drop("words")


def op6_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(_table(spark, sf, "documents"))


def op7_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = find_secrets(_table(spark, sf, "documents").select("doc_id", "text")).drop("text")
    base = told(F.col("secret_spans"), BASE_RULES)
    counts = [
        found_of(F.col("secret_spans"), rule).alias(f"n_{rule.kind}")
        for rule in BASE_RULES
    ]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), told(F.col("secret_spans")).alias("spans"))


def op8_quote_links(spark: SparkSession, sf: str) -> DataFrame:
    return link_quotes(_table(spark, sf, "conversations"))


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return identify_languages(_table(spark, sf, "documents"))


def op11_structure_repair(spark: SparkSession, sf: str) -> DataFrame:
    return repair_report(damage(_table(spark, sf, "conversations")))


def op12_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return page_texts(_table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return rebuilt_prefixes(_table(spark, sf, "conversations"))


def corpus_queries() -> dict[str, Query]:
    """Each operator's query by name."""
    chosen = (
        op1_quality_rules,
        op2_suffix_dedup,
        op3_nearest_neighbours,
        op4_jaccard_join,
        op5_length_buckets,
        op6_source_mix,
        op7_secret_scan,
        op8_quote_links,
        op9_toxicity,
        op10_language_id,
        op11_structure_repair,
        op12_page_text,
        op13_prefix_trie,
    )
    return {query.__name__: query for query in chosen}


def corpus_statements() -> dict[str, str]:
    """The DuckDB statement of each query that SQL expresses over whole tables."""
    return statements.all_statements()
