import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

CLASHING = ("row", "node", "range", "mix", "epoch", "near_row", "labels", "features", "part", "h")


@pytest.fixture(scope="session")
def awkward(spark):
    """Null ids and texts, empty and very long texts, repeated rows, and columns with names that the operators use themselves."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    copy = " ".join(word() for _ in range(60))
    rows = [
        (1, copy), (1, copy), (2, copy + " more"), (None, copy), (3, None), (4, ""), (5, " \n\t"), (6, long), (7, "x" * 200_000), (8, "one two"), (9, "one two"),
        (10, "é ü 中文 😀 one"), (None, None), (None, "alone here"), (11, "a@b.co +1 (555) 123-4567"), (12, "word " * 300),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    lang = F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "de")
    return df.select("doc_id", "text", lang.alias("lang"), F.lit(None).cast("string").alias("source"), *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """The driver's smallest documents."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
