"""Queries over the driver's tables, one per operator, and the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    centroids, chat, decontam, exact_dedup, html_text, infill, jaccard_join, lm, mixing, packing, quality, sharding,
    token_counts)
from .batches import prepare
from .checks import CHECKS  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @functools.wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = run
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Formatted conversations, read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql(
        r"""SELECT CAST(-7 AS BIGINT) AS conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
        FROM VALUES (CAST(0 AS BIGINT), 'user'), (CAST(1 AS BIGINT), 'assistant') AS t(turn, role)""")
    return chat.digests(chat.format_conversations(turns.unionByName(odd)))


@query
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = token_counts.with_token_counts(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = quality.with_scores(docs, table(spark, folder, "labels"))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = sharding.shard(table(spark, folder, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    marked = decontam.mark(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), "contaminated")


@query
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Links of texts with a similarity of 0.8 or more over shingles of five words."""
    return jaccard_join.similar_texts(table(spark, folder, "documents"))


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return mixed.select(
        "doc_id", "source", "lang", "topic", "tokens", F.round("factor", 6).alias("factor"),
        F.round("probability", 6).alias("probability"), "sampled", F.round("missed", 6).alias("missed"))


@query
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


@query
def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Each document under the model of all others, by trigrams that back off twice."""
    return lm.score(table(spark, folder, "documents"), order=3)


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Fill-in-middle forms of whole texts and the texts rebuilt from them."""
    made = infill.fill_in_middle(table(spark, folder, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 1024 tokens; the other two limits cannot bind before that of the tokens."""
    pieces = packing.pack(table(spark, folder, "documents"))
    return pieces.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op13_centroid_clustering(spark: SparkSession, folder: str) -> DataFrame:
    found = centroids.cluster(table(spark, folder, "embeddings"))
    return found.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia",
        F.sha2(F.array_join("centroid", ","), 256).alias("centroid_sha256"))
