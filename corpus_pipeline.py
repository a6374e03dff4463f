"""A training corpus from the documents table, in five stages.

Every stage takes the documents that the one before it kept; what it decides takes
effect on them.  All but the last return the columns of ``documents``.  A stage's
result is to be written before the next stage is called on it, which deletes
what the one before has staged.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratingloom.llm import mixing, ngram_join, packing, quality, repeats
from ratingloom.llm.rows import table
from ratingloom.session import collected_scratch, delete_scratch, stage

#: Near duplicates: words of a shingle, and the similarity in hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: what it rejects goes."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    return judged.filter("predicted = 1").select(docs.columns)


def keep_one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the smallest id stays, once; rows without id stay."""
    joined = ngram_join.join(docs, NEAR_WORDS, NEAR_PERCENT)
    chosen = joined.filter("doc_id = component_id").select("doc_id").distinct()
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns)))
    first = docs.join(chosen, "doc_id", "left_semi").withColumn("_turn", turn).filter("_turn = 1")
    return first.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: long runs that an earlier document has are cut out; all other words keep their white space."""
    cut = repeats.remove_repeats(docs, spaces=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cut = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
        cut = cut.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return cut.select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a text becomes the blocks that the mix draws of its row; with none it goes."""
    mixed = mixing.mixed_texts(docs)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed.select(docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: one row per piece of a document in a training window."""
    return packing.pack(docs)


_STAGED: list[str] = []


def _step(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes what the stage before it has staged, unless ``docs`` still reads that."""

    @wraps(function)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = docs.inputFiles()
        unread = [f for f in _STAGED if not any(f"{f.split('://')[-1]}/" in name for name in read)]
        delete_scratch(spark, unread)
        with collected_scratch() as folders:
            result = function(spark, docs, sf_dir)
        _STAGED[:] = [f for f in _STAGED if f not in unread] + folders
        return result

    return run_step


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", _step(keep_good)),
    ("n-gram Jaccard join", _step(keep_one_of_a_kind)),
    ("substring dedup", _step(cut_repeats)),
    ("mixing", _step(mix_sources)),
    ("packing", _step(pack_windows)),
]

#: A trained classifier and a tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
