import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, a clashing extra column."""
    long = " ".join(f"w{i % 977}" for i in range(9000))
    rows = [
        (1, "one two three four five six", "en", "a", 1), (2, "one two three four five six", "en", "a", 2),
        (2, "one two three four five six", "en", "a", 2), (3, None, "en", "b", 3), (4, "", "de", None, 4),
        (5, " \n\t ", None, None, 5), (None, "one two three four five six", "en", "a", 6), (7, long, "en", "b", 7),
        (8, long + " tail", "en", "b", 8), (9, "ONE Two three", "en", "c", 9), (10, "é ü İ ΑΣ x y", "en", "c", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumn("score", F.lit("clash")).withColumn("shard", F.lit(1)).withColumn("n_words", F.lit(2)).cache()


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
