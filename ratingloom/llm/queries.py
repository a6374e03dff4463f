"""The registered queries over whole tables, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm import (
    bitplane, bloom_lm, curve, forest, mining, mixing, ngram_join, packing, pages, quality, repeats, topk, toxic,
)
from ratingloom.llm.rows import table

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def query(function: Query) -> Query:
    """Register under the function's name."""
    _REGISTRY[function.__name__] = function
    return function


def registered() -> dict[str, Query]:
    """All queries by name."""
    return dict(_REGISTRY)


@query
def op4_retrieval_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


@query
def op7_bitplane_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bitplane.round_trip(table(spark, sf, "documents"))


@query
def op8_apportioned_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op6_bloom_lm(spark: SparkSession, sf: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf, "documents"))


@query
def op10_attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op9_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.join(table(spark, sf, "documents"))


@query
def op1_threshold_topk(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(table(spark, sf, "embeddings"))


@query
def op3_forest_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf, "embeddings"))


@query
def op2_wrapper_text(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_text(table(spark, sf, "pages"))


@query
def op11_curve_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return curve.cluster(table(spark, sf, "embeddings")).drop("compared")


@query
def op12_crf_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    judged = toxic.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


@query
def op13_slot_negatives(spark: SparkSession, sf: str) -> DataFrame:
    return mining.hard_negatives(table(spark, sf, "embeddings"))
