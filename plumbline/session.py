"""Session settings this package relies on, and the few it likes."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from typing import TypeVar

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

R = TypeVar("R")

# Runtime SQL settings; safe to set on a shared cluster session. A top-1,000 per column is pruned
# before its shuffle only while the limit stays below the group-limit threshold.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.windowGroupLimitThreshold": "2000",
    "spark.sql.codegen.maxFields": "400",
}


# Cells that one task combines in memory before a shuffle: about 100 bytes each.
CELLS_PER_TASK = 1_000_000


def tune(spark: SparkSession) -> SparkSession:
    """Apply the recommended runtime settings to a session."""
    for key, value in RECOMMENDED.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str | int = "*", partitions: int | None = None, app: str = "plumbline") -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    n = partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.showConsoleProgress", "false")
        # The call site of every Column expression costs several JVM round trips; plans here have hundreds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    return tune(builder.getOrCreate())


def local_frame(spark: SparkSession, rows: list, schema: str | T.StructType) -> DataFrame:
    """Driver-side metadata (one row per table, column or check) as a DataFrame.

    Sent as Arrow it becomes a local relation, which needs no job of its own; in a single partition, the
    joins, groupings and windows over such frames need no exchange."""
    schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    table = pa.Table.from_pylist([_plain(r, schema) for r in rows], schema=to_arrow_schema(schema))
    return spark.createDataFrame(table, schema).coalesce(1)


def collect_small(df: DataFrame) -> DataFrame:
    """Materialise a frame of at most one row per table, column or check as a local one."""
    return local_frame(df.sparkSession, df.collect(), df.schema)


def instant(t: datetime) -> Column:
    """A zone-less timestamp literal. It is sent as text, so no time zone of Python or Java shifts it."""
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def run_together(tasks: list[Callable[[], R]]) -> list[R]:
    """Run independent Spark actions at once, so that small jobs share the cluster; results in order."""
    if len(tasks) < 2:
        return [t() for t in tasks]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(max_workers=len(tasks)) as pool:
        return [f.result() for f in [pool.submit(inherit(t)) for t in tasks]]


def deal(df: DataFrame, cells: int, most: int | None = None) -> DataFrame:
    """Rows dealt evenly over enough tasks that each gets about `most` of `cells` cells, whatever the files or their row groups hold.

    What a task combines before a shuffle is then bounded in memory. Fewer cells stay where they are."""
    parts = -(-cells // (most or CELLS_PER_TASK))
    if parts < 2:
        return df
    return df.withColumn("_row", F.monotonically_increasing_id()).repartition(parts, "_row").drop("_row")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and continue from there.

    The folder is the one the cluster names; a temporary one stands in where none is set, in local mode."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def _plain(value, dt: T.DataType):
    if value is None:
        return None
    if isinstance(dt, T.StructType):
        items = [value.get(n) for n in dt.names] if isinstance(value, dict) else list(value)
        return {f.name: _plain(v, f.dataType) for f, v in zip(dt.fields, items, strict=True)}
    if isinstance(dt, T.ArrayType):
        return [_plain(v, dt.elementType) for v in value]
    return value


def require_utc(spark: SparkSession) -> None:
    """Zone-less timestamps are compared with the scan time as UTC; another zone would shift them."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"set spark.sql.session.timeZone to UTC (it is {zone})")
