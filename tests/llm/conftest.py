import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns with names used inside the operators."""
    words = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, "a b c d e f g h i j k"), (2, None), (3, ""), (4, " \n\t "), (5, words), (5, words), (6, "a b c d e f g h i j k"), (7, "x"), (None, "l m n o p q r s t u v"), (8, "<|endoftext|> é ñ 日本語 a  b\n\nc"), (9, "a b c")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    return d.select("*", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars"), F.lit(1).alias("n"), F.lit(2).alias("cid"), F.lit(3).alias("rank"), F.lit(4).alias("stratum"), F.lit(5).alias("bucket"), F.lit(6).alias("n_words"))
