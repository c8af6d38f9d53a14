"""Helpers of the corpus operators: row keys, written intermediates, joins with small sides, edge columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

BROADCAST_ROWS = 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(doc_id: str, text: str) -> Column:
    """A number for a row's content: equal rows share it, whatever their order or file."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def bucket(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id has bucket 0 of its empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a table below the checkpoint folder and read it back: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder is None:
        cut_lineage(spark.range(1))
        folder = sc.getCheckpointDir()
    path = f"{folder.rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_small(df: DataFrame, small: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """Join with a narrow side of known row count: sent to every executor up to BROADCAST_ROWS rows, shuffled beyond."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)
