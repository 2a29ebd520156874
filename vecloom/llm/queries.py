"""The registered queries of this subpackage, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.conversation_repair import damaged, repair_report
from vecloom.llm.decontamination import decontamination_report
from vecloom.llm.hamming_search import hamming_top_k, sign_code
from vecloom.llm.html_extraction import extract_text
from vecloom.llm.interpolated_lm import interpolated_scores
from vecloom.llm.jaccard_join import jaccard_components
from vecloom.llm.line_dedup import line_dedup
from vecloom.llm.packing import pack_documents, word_tokenizer
from vecloom.llm.substring_dedup import substring_dedup
from vecloom.llm.target_resampling import resample_to_target
from vecloom.llm.toxicity import toxicity_scores
from vecloom.llm.url_filter import filter_urls, host_of
from vecloom.llm.zip_archives import archived_pages
from vecloom.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def captures_and_entries(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetch times and a dated list that the pages' own URLs and hosts give by their digests.

    The tables hold neither. A capture's time is a second of 2023 or 2024; a host has up to six
    entries in that time, on the host, its parent domain or its English part.
    """
    start = F.lit("2023-01-01 00:00:00").cast("timestamp")
    hex_number = lambda text, at, n: F.conv(F.substring(text, at, n), 16, 10).cast("long")
    seconds = hex_number(F.md5(F.col("url").cast("binary")), 1, 7) % F.lit(730 * 86400)
    captures = pages.select(
        "page_id", "url", F.timestamp_seconds(F.unix_timestamp(start) + seconds).alias("fetched_at")
    )
    digest = F.col("digest")
    entries = (
        pages.select(host_of(F.col("url")).alias("host"))
        .dropna()
        .distinct()
        .select("host", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
        .withColumn("digest", F.md5(F.concat_ws("#", "host", "i").cast("binary")))
        .filter(F.substring(digest, 7, 1) < "8")
        .select(
            F.when(F.substring(digest, 9, 1) < "8", "abuse").otherwise("adult").alias("list"),
            F.when(F.substring(digest, 10, 1) <= "9", F.col("host"))
            .when(F.substring(digest, 10, 1) <= "c", F.regexp_replace("host", r"^[^.]*\.", ""))
            .otherwise(F.concat("host", F.lit("/en")))
            .alias("key"),
            F.when(F.substring(digest, 8, 1) <= "7", "block")
            .when(F.substring(digest, 8, 1) <= "a", "allow")
            .otherwise("clear")
            .alias("action"),
            F.timestamp_seconds(F.unix_timestamp(start) + (hex_number(digest, 1, 6) % F.lit(730 * 24)) * 3600).alias(
                "listed_at"
            ),
        )
    )
    return captures, entries


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(*captures_and_entries(read_table(spark, sf_dir, "pages")))
    # Seconds, so that the rows compare alike in any session time zone.
    return judged.withColumn("fetched_at", F.unix_timestamp("fetched_at")).withColumn(
        "valid_from", F.unix_timestamp("valid_from")
    )


@query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(read_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup(read_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(
        read_table(spark, sf_dir, "documents"),
        word_tokenizer(tokenizer_path("word_bpe_49k.json")),
        id_bytes=2,
        with_ids=False,
    )
    return pieces.drop("ids")


@query
def op4_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolated_scores(read_table(spark, sf_dir, "documents"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "item_id", "item_tokens", "covered", "coverage", "n_tiles", "item_rank")


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=4, threshold=(85, 100))


@query
def op10_hamming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), sign_code(F.col("embedding")).alias("code")
    )
    return hamming_top_k(codes, codes.filter(F.col("id") % 20 == 0))


@query
def op11_zip_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived_pages(read_table(spark, sf_dir, "pages"))


@query
def op12_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample_to_target(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return repair_report(rows, absent=F.col("gone")).drop("most_open")
